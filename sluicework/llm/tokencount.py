"""Token counts by rank-synchronous merging of pre-tokens held as ragged arrays.

The pre-tokens of a batch lie end to end in one array of symbols. In every round each pre-token finds the
lowest rank among its adjacent pairs, merges that pair, and the array is compacted; all pre-tokens move
together. Where every token of the vocabulary has one merge only (checked on load), all occurrences of the
lowest pair merge in the same round, else the leftmost. When no pair is left, the surviving symbols are
counted. Counts of chunks (a word with the space before it, or a run of white space) are kept in a bounded
cache per worker. Whole texts are counted, never prefixes.

Cases: null counts as empty; an empty text has no bytes and no tokens; strings of added tokens inside a
text count as one token each, as the library does by default.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import _held, _source
from .common import reused
from .vocab import CONTRACTIONS, LETTER, NUMBER, ODD, LibrarySplitter, Vocabulary

CACHE = 600_000
"""Chunks that a worker keeps at most."""
ROUND = 1 << 20
"""Symbols that are merged together at most (a single longer pre-token goes alone)."""


def count_ragged(vocab: Vocabulary, tokens: list[bytes]) -> np.ndarray:
    """Surviving symbols of each pre-token."""
    out = np.zeros(len(tokens), dtype=np.int64)
    size = np.array([len(t) for t in tokens], dtype=np.int64)
    lo = 0
    ends = np.cumsum(size)
    while lo < len(tokens):
        base = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + ROUND, side="right")))
        out[lo:hi] = _merge_rounds(vocab, tokens[lo:hi], size[lo:hi])
        lo = hi
    return out


def _merge_rounds(vocab: Vocabulary, tokens: list[bytes], size: np.ndarray) -> np.ndarray:
    out = size.copy()
    raw = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    sym = vocab.inner[raw]
    last = np.cumsum(size) - 1
    sym[last[size > 0]] = vocab.final[raw[last[size > 0]]]
    owner = np.repeat(np.arange(len(tokens)), size)
    while len(sym) > 1:
        ranks = np.full(len(sym), vocab.no_rank, dtype=np.int64)
        same = owner[:-1] == owner[1:]
        ranks[:-1][same] = vocab.pair_ranks(sym[:-1][same], sym[1:][same])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        low = np.minimum.reduceat(ranks, starts)
        live = low < vocab.no_rank
        lengths = np.diff(np.append(starts, len(sym)))
        if not live.all():  # what has no pair left is counted and leaves the array
            out[owner[starts[~live]]] = lengths[~live]
            keep = np.repeat(live, lengths)
            sym, owner, ranks = sym[keep], owner[keep], ranks[keep]
            low, lengths = low[live], lengths[live]
            if not len(sym):
                return out
        hit = ranks == np.repeat(low, lengths)
        at = np.flatnonzero(hit)
        if vocab.one_merge_each:  # of pairs that overlap (as in "aaa"), every other one from the left
            run = np.cumsum(np.concatenate([[True], (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])])) - 1
            first = at[np.concatenate([[True], np.diff(run) != 0])]
            at = at[(at - first[run]) % 2 == 0]
        else:
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
        sym[at] = vocab.merged[ranks[at]]
        stay = np.ones(len(sym), dtype=bool)
        stay[at + 1] = False
        sym, owner = sym[stay], owner[stay]
    if len(sym):
        out[owner] = 1
    return out


class Counter:
    """Token counts of texts for byte-level BPE files without normalisation."""

    def __init__(self, data: bytes) -> None:
        self.vocab = Vocabulary(data)
        self.library = LibrarySplitter(data, self.vocab)
        self.chunk = re.compile(r" ?\S+|\s+(?!\S)|\s+")
        self.inside = re.compile(f"{CONTRACTIONS}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\\s{LETTER}{NUMBER}]+|\\s+")
        self.counts: dict[str, int] = {}

    def learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.counts)
        if len(self.counts) + len(new) > CACHE:
            self.counts.clear()
            new = chunks
        split = [(c, self.inside.findall(c)) for c in new]
        distinct = {t: k for k, t in enumerate({t for _, v in split for t in v})}
        counts = count_ragged(self.vocab, [t.encode() for t in distinct]).tolist()
        for c, v in split:
            self.counts[c] = sum(counts[distinct[t]] for t in v)

    def count_many(self, texts: list[str]) -> list[int]:
        plain = [self.chunk.findall(t) if ODD.search(t) is None and "<|" not in t else None for t in texts]
        self.learn(set().union(*(x for x in plain if x)))
        get = self.counts.__getitem__
        return [sum(map(get, p)) if p is not None else self.count_odd(t) for p, t in zip(plain, texts, strict=True)]

    def count_odd(self, text: str) -> int:
        total = 0
        for piece, special in self.vocab.pieces(text):
            total += 1 if special is not None else int(count_ragged(self.vocab, self.library(piece)).sum())
        return total


def token_counts(df: DataFrame, vocab_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row; nothing is shuffled."""
    data = df.sparkSession.sparkContext.broadcast(open(vocab_path, "rb").read())

    def run(batches):
        counter = reused(f"Counter {zlib.crc32(data.value)}", lambda: Counter(data.value))
        for held in _held(batches, 128):
            texts = [t for _, t in held]
            n = counter.count_many(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in held], type=pa.int64()),
                    pa.array([len(t.encode()) for t in texts], type=pa.int64()),
                    pa.array(n, type=pa.int64()),
                    pa.array([x > limit for x in n], type=pa.bool_()),
                ],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    return _source(df, id_col, text_col).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
