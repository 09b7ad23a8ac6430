"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree hold (rank, position) of each adjacent pair, inner nodes the minimum of
their children, so the root is the leftmost pair of lowest rank. Merging it changes three leaves, each
updated on its path to the root in logarithmic time, until the root holds no mergeable pair. Words of
like size go through their trees in lock step, as rows of one array; a long word has a tree of its own.

Texts fall into white-space chunks that no pre-token crosses; chunks and pre-tokens are kept in bounded
caches, so each is merged about once per worker. Whole texts are encoded, never prefixes.

Cases: null counts as empty; an empty text has no ids and decodes to the empty text; strings of added
tokens inside a text become their ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reused, rows_of
from .vocab import CONTRACTIONS, LETTER, NUMBER, ODD, LibrarySplitter, Vocabulary

LONG = 64
"""Symbols from which a word gets a tree of its own."""
CACHE = 250_000
"""Chunks and pre-tokens each that a worker keeps at most."""
SHIFT = 24


def merge_one(vocab: Vocabulary, symbols: list[int]) -> list[int]:
    """Ids of one word, by a segment tree in lists."""
    n = len(symbols)
    if n < 2:
        return list(symbols)
    width = vocab.width
    size = 1 << (n - 2).bit_length()
    none = vocab.no_rank << SHIFT
    sym = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * size)
    get = vocab.rank_of.get
    for i in range(n - 1):
        if (r := get(sym[i] * width + sym[i + 1])) is not None:
            tree[size + i] = (r << SHIFT) | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(leaf: int, value: int) -> None:
        i = size + leaf
        tree[i] = value
        while i > 1:
            i >>= 1
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low

    while (top := tree[1]) < none:
        at, gone = top & ((1 << SHIFT) - 1), after[top & ((1 << SHIFT) - 1)]
        sym[at] = int(vocab.merged[top >> SHIFT])
        follow = after[at] = after[gone]
        if gone < n - 1:
            put(gone, none)
        if follow < n:
            before[follow] = at
            r = get(sym[at] * width + sym[follow])
            put(at, none if r is None else (r << SHIFT) | at)
        else:
            put(at, none)
        if (prev := before[at]) >= 0:
            r = get(sym[prev] * width + sym[at])
            put(prev, none if r is None else (r << SHIFT) | prev)
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = after[i]
    return out


def merge_many(vocab: Vocabulary, words: list[np.ndarray]) -> list[np.ndarray]:
    """Ids of many words of at most LONG symbols; trees of the same size advance together."""
    out: list[np.ndarray] = [w for w in words]
    sizes = np.array([len(w) for w in words])
    for level in range(0, LONG.bit_length()):
        size = 1 << level  # leaves, for size / 2 < pairs <= size
        pick = np.flatnonzero((sizes - 1 <= size) & (sizes - 1 > (size >> 1 if level else 0)))
        for lo in range(0, len(pick), 1 << 14):
            part = pick[lo : lo + (1 << 14)]
            for i, ids in zip(part.tolist(), _lock_step(vocab, [words[i] for i in part], size), strict=True):
                out[i] = ids
    return out


def _lock_step(vocab: Vocabulary, words: list[np.ndarray], size: int) -> list[np.ndarray]:
    n = np.array([len(w) for w in words])
    rows = np.arange(len(words))
    cols = size + 2
    none = vocab.no_rank << SHIFT
    held = np.arange(cols)[None, :] < n[:, None]
    sym = np.full((len(words), cols), -1, dtype=np.int64)
    sym[held] = np.concatenate(words)
    after = np.tile(np.arange(1, cols + 1), (len(words), 1))
    before = np.tile(np.arange(-1, cols - 1), (len(words), 1))
    tree = np.full((len(words), 2 * size), none, dtype=np.int64)
    ranks = vocab.pair_ranks(sym[:, :size], sym[:, 1 : size + 1])
    ranks[~held[:, 1 : size + 1]] = vocab.no_rank
    tree[:, size:] = np.where(ranks < vocab.no_rank, (ranks << SHIFT) | np.arange(size), none)
    for i in range(size - 1, 0, -1):
        tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])

    def put(r: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = size + leaf
        tree[r, node] = value
        for _ in range(size.bit_length() - 1):
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

    def keyed(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        ranks = vocab.pair_ranks(left, right)
        return np.where(ranks < vocab.no_rank, (ranks << SHIFT) | at, none)

    live = rows[tree[:, 1] < none]
    while len(live):
        top = tree[live, 1]
        at = top & ((1 << SHIFT) - 1)
        gone = after[live, at]
        sym[live, at] = vocab.merged[top >> SHIFT]
        follow = after[live, gone]
        after[live, at] = follow
        inside = follow < n[live]
        before[live[inside], follow[inside]] = at[inside]
        right = np.where(inside, sym[live, np.minimum(follow, cols - 1)], -1)
        inner = gone < size  # the last symbol starts no pair
        put(live[inner], gone[inner], np.full(int(inner.sum()), none))
        put(live, at, np.where(inside, keyed(sym[live, at], right, at), none))
        prev = before[live, at]
        some = prev >= 0
        put(live[some], prev[some], keyed(sym[live[some], prev[some]], sym[live[some], at[some]], prev[some]))
        live = live[tree[live, 1] < none]
    alive = np.zeros((len(words), cols), dtype=bool)
    now, going = np.zeros(len(words), dtype=np.int64), rows
    while len(going):
        alive[going, now[going]] = True
        now[going] = after[going, now[going]]
        going = going[now[going] < n[going]]
    flat, ends = sym[alive], np.cumsum(alive.sum(axis=1))[:-1]
    return np.split(flat, ends)


class Encoder:
    """Texts to ids and back, for word-level BPE files that normalise to lower case."""

    def __init__(self, data: bytes) -> None:
        self.vocab = Vocabulary(data)
        self.library = LibrarySplitter(data, self.vocab)
        other = f"[^\\s{LETTER}{NUMBER}]+"
        self.pattern = re.compile(f"{CONTRACTIONS}|[{LETTER}]+|[{NUMBER}]|{other}")
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.tokens: dict[bytes, tuple[bytes, str]] = {}

    def entry(self, ids: Iterable[int]) -> tuple[bytes, str]:
        ids = [int(i) for i in ids]
        return np.array(ids, dtype="<u4").tobytes(), " ".join(self.vocab.text_of[i] for i in ids)

    def learn_tokens(self, tokens: set[bytes]) -> None:
        """Merges the pre-tokens that are not in the cache yet."""
        new = [t for t in tokens if t not in self.tokens]
        if len(self.tokens) + len(new) > CACHE:
            self.tokens.clear()
            new = list(tokens)
        short = [t for t in new if len(t) <= LONG]
        for t, ids in zip(short, merge_many(self.vocab, [self.vocab.symbols(t) for t in short]), strict=True):
            self.tokens[t] = self.entry(ids)
        for t in new:
            if len(t) > LONG:
                self.tokens[t] = self.entry(merge_one(self.vocab, self.vocab.symbols(t).tolist()))

    def learn_chunks(self, chunks: set[str]) -> None:
        """Splits and merges the chunks that are not in the cache yet."""
        new = chunks.difference(self.chunks)
        if len(self.chunks) + len(new) > CACHE:
            self.chunks.clear()
            new = chunks
        split = {c: [t.encode() for t in self.pattern.findall(c)] for c in new}
        self.learn_tokens({t for v in split.values() for t in v})
        get = self.tokens.__getitem__
        for c, v in split.items():
            if len(v) == 1:
                self.chunks[c] = get(v[0])
            else:
                found = [get(t) for t in v]
                self.chunks[c] = (b"".join(x for x, _ in found), " ".join(x for _, x in found))

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit bytes, decoded text) of each text."""
        plain: list[list[str] | None] = []
        for text in texts:
            lowered = text.lower()
            common = ODD.search(text) is None and "<|" not in lowered
            plain.append(lowered.split() if common else None)
        for lo in range(0, len(texts), 64):
            self.learn_chunks(set().union(*(x for x in plain[lo : lo + 64] if x)))
            for i in range(lo, min(lo + 64, len(texts))):
                if plain[i] is not None:
                    found = list(map(self.chunks.__getitem__, plain[i]))
                    plain[i] = (b"".join([x for x, _ in found]), " ".join([x for _, x in found]))
        return [p if p is not None else self.encode_odd(t) for p, t in zip(plain, texts, strict=True)]

    def encode_odd(self, text: str) -> tuple[bytes, str]:
        """As ``encode_many`` for one text of any characters, added tokens included."""
        out = []
        for piece, special in self.vocab.pieces(text):
            if special is not None:
                out.append(self.entry([special]))
                continue
            tokens = self.library(piece)
            self.learn_tokens(set(tokens))
            out += [self.tokens[t] for t in tokens]
        return b"".join(x for x, _ in out), " ".join(x for _, x in out)


def decode_ids(vocab: Vocabulary, ids: Iterable[int]) -> str:
    """Texts of the ids joined by spaces: what the library's decode gives where a file names no decoder."""
    return " ".join(vocab.text_of[int(i)] for i in ids)


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids (array<int>), decoded`` of every row. The vocabulary is broadcast; nothing is shuffled."""
    data = df.sparkSession.sparkContext.broadcast(open(vocab_path, "rb").read())

    def run(batches):
        encoder = reused(f"Encoder {zlib.crc32(data.value)}", lambda: Encoder(data.value))
        for held in _held(batches):
            coded = encoder.encode_many([t for _, t in held])
            ids = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b, _ in coded]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in held], type=pa.int64()), pa.array(ids, type=pa.list_(pa.int32())), pa.array([d for _, d in coded])],
                names=["id", "ids", "decoded"],
            )

    return _source(df, id_col, text_col).mapInArrow(run, "id long, ids array<int>, decoded string")


def encode_digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: the digests of ``encode``, without carrying its arrays."""
    data = df.sparkSession.sparkContext.broadcast(open(vocab_path, "rb").read())

    def run(batches):
        encoder = reused(f"Encoder {zlib.crc32(data.value)}", lambda: Encoder(data.value))
        for held in _held(batches):
            coded = encoder.encode_many([t for _, t in held])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in held], type=pa.int64()),
                    pa.array([len(b) // 4 for b, _ in coded], type=pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b, _ in coded]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in coded]),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _source(df, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _held(batches, rows: int = 256, chars: int = 2 << 20):
    """Rows as (id, text) lists of bounded size; null texts become empty."""
    held, size = [], 0
    for batch in batches:
        for ident, text in rows_of(batch, 64):
            held.append((ident, text or ""))
            size += len(text or "")
            if len(held) >= rows or size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held
