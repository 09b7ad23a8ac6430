"""Phrase collocation mining with compressed position bitmaps, depth-first, in the way of SPAM.

A shard is the words of one part (language) that a task reads, laid out in a row; a place that holds no word lies between
pieces. Each frequent word has a bitmap of its places, compressed to the 16-bit blocks that aren't zero. To extend a
phrase, its bitmap of last places is shifted by one and ANDed with the bitmaps of the words that have a block there; the
popcounts are the occurrences of the longer phrases, and what is left of the AND are their bitmaps. A shift never crosses
the end of a piece, as the place behind it belongs to no word. Phrases are extended depth-first in groups whose bitmaps
have a bounded size. Popcounts are summed over shards, which is where a count is known to reach the least support; no
shard cuts by its own counts, so a phrase of one occurrence a shard is found as well.

Three passes over the texts: words; pairs of frequent words; phrases of 3 words and more, extended only along frequent
pairs. A pass knows the frequent words and pairs of the one before by a bit map of bounded size, which may let others pass
(they fail the sum later) and never stops one. A pass gives at most a row for each word and length.

The weakest cut of a phrase, its score and its loss to longer phrases of equal count are joins on counts. One extension by
a word decides the loss: between a phrase and any longer one of equal count lies one longer by a word, of equal count too.
Products are decimals of 38 digits.

Cases: null text is empty, null part is ``und``; rows that repeat are counted each; a piece of any length is one piece; no
frequent phrase, or an empty table, gives no rows; other columns, clashing names included, are left out; ties of score and
count are ordered by phrase as UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_map, dropped, in_map, map_size, written
from .exactdedup import _batches

SHARD = 2_000_000
"""Places of a shard from which it is counted and begun anew."""
GROUP = 1 << 16
"""Blocks of bitmaps that are extended together; bounds the memory of a step, not its result."""
BLOCK = 4
"""Block of a place: place >> BLOCK; blocks have 16 bits."""
END = b"\xff"
"""Stands between pieces: a byte that UTF-8 never has."""
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", END * 10)
"""What ends a piece, as that byte."""
COUNTS = "part string, phrase string, words int, n long"


def place_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Position of 64-bit hashes in a bit map."""
    return (hashes % np.uint64(size)).astype(np.int64)


def word_hash(part: str, word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(part.encode() + b"\0" + word)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of two words in a row from their hashes."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a lower-cased text in a row, with END between pieces and at the end."""
    tokens = text.translate(ENDS).replace(END, b" \xff ").split()
    tokens.append(END)
    return tokens


class Shard:
    """Bitmaps of the frequent words of one part, and the extension of phrases."""

    def __init__(self, ids: np.ndarray, words: int) -> None:
        at = np.flatnonzero(ids)
        order = np.argsort(ids[at], kind="stable")
        at = at[order]
        word, block = ids[at].astype(np.int64), at >> BLOCK
        new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])])) if len(at) else at
        bits = (np.uint16(1) << (at & 15).astype(np.uint16)).astype(np.uint16)
        self.bits = np.bitwise_or.reduceat(bits, new) if len(at) else bits
        self.word, self.block = word[new].astype(np.int32), block[new].astype(np.int32)
        self.starts = np.searchsorted(self.word, np.arange(words + 1))  # bitmaps of a word: starts[w] to starts[w + 1]
        by = np.argsort(self.block, kind="stable")
        self.by_word, self.by_bits = self.word[by], self.bits[by]
        self.first = np.searchsorted(self.block[by], np.arange(len(ids) // 16 + 3))

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray):
        """``phrase, word, count`` of the phrases longer by a word that occur, and the entries of their bitmaps: for
        each which of these it belongs to, block and bits. Arguments are the entries of the phrases' bitmaps."""
        inside, over = bits << np.uint16(1), bits >> np.uint16(15)
        kept, carried = np.flatnonzero(inside), np.flatnonzero(over)
        phrase = np.concatenate([phrase[kept], phrase[carried]])
        block = np.concatenate([block[kept], block[carried] + 1])
        bits = np.concatenate([inside[kept], over[carried]])
        sizes = self.first[block + 1] - self.first[block]
        ends = np.cumsum(sizes)
        entry = np.repeat(self.first[block] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        both = np.repeat(bits, sizes) & self.by_bits[entry]
        hit = np.flatnonzero(both)
        which = np.repeat(np.arange(len(sizes)), sizes)[hit]
        word, both = self.by_word[entry[hit]], both[hit]
        key = phrase[which].astype(np.int64) << 32 | word
        order = np.argsort(key, kind="stable")
        key, which, both = key[order], which[order], both[order]
        if not len(key):
            return key, key, key, key, block[which], both
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        count = np.add.reduceat(np.bitwise_count(both).astype(np.int64), starts)
        return key[starts] >> 32, key[starts] & 0xFFFFFFFF, count, np.cumsum(new) - 1, block[which], both


def mine(shard: Shard, hashes: np.ndarray, pairs: np.ndarray | None, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(words of each phrase, count)`` by length: all pairs, or with a bit map of ``pairs`` all phrases of 3 words and
    more whose pairs it holds."""
    words = np.arange(1, len(shard.starts) - 1)
    sizes = shard.starts[words + 1] - shard.starts[words]
    stack = [(words[:, None].astype(np.int32), np.repeat(np.arange(len(words)), sizes), shard.block, shard.bits)]
    while stack:
        names, phrase, block, bits = stack.pop()
        if len(phrase) > GROUP and len(names) > 1:  # the first phrases of the group now, the others later
            cut = max(1, int(phrase[GROUP]))
            at = int(np.searchsorted(phrase, cut))
            stack.append((names[cut:], phrase[at:] - cut, block[at:], bits[at:]))
            names, phrase, block, bits = names[:cut], phrase[:at], block[:at], bits[:at]
        prefix, word, count, owner, block, bits = shard.extend(phrase, block, bits)
        if pairs is not None and len(prefix):
            kept = in_map(pairs, place_of(pair_hash(hashes[names[prefix, -1]], hashes[word]), 8 * len(pairs)))
            entries = np.flatnonzero(kept[owner])
            owner, block, bits = (np.cumsum(kept) - 1)[owner[entries]], block[entries], bits[entries]
            prefix, word, count = prefix[kept], word[kept], count[kept]
        if not len(prefix):
            continue
        longer = np.concatenate([names[prefix], word[:, None].astype(np.int32)], axis=1)
        length = longer.shape[1]
        if pairs is None or length > 2:
            yield longer, count
        if pairs is not None and length < longest:
            stack.append((longer, owner, block, bits))


def _batch(part: str, phrases: pa.Array, length: int, counts: np.ndarray) -> pa.RecordBatch:
    n = len(counts)
    columns = [pa.array([part]).take(pa.array(np.zeros(n, dtype=np.int32))), phrases, pa.array(np.full(n, length, dtype=np.int32)), pa.array(counts)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "phrase", "words", "n"])


def _source(df: DataFrame, text_col: str, part_col: str) -> DataFrame:
    part, text = F.coalesce(df[part_col].cast("string"), F.lit("und")), F.coalesce(df[text_col].cast("string"), F.lit(""))
    return df.select(part.alias("part"), text.alias("text"))


def word_counts(source: DataFrame) -> DataFrame:
    """``part, phrase, words (1), n`` of every word, summed over shards."""

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def out():
            for part, counts in held.items():
                del counts[END]
                listed = list(counts)
                yield _batch(part, pa.array(listed, type=pa.binary()).cast(pa.string()), 1, np.fromiter(counts.values(), dtype=np.int64, count=len(listed)))
            held.clear()

        for batch in batches:
            for rows in _batches(batch):
                for part, text in rows:
                    held[part].update(tokens_of(text))
                if sum(map(len, held.values())) > SHARD // 2:
                    yield from out()
        yield from out()

    return source.mapInArrow(run, COUNTS).groupBy("part", "phrase", "words").agg(F.sum("n").alias("n"))


def phrase_counts(source: DataFrame, words: np.ndarray, pairs: np.ndarray | None, longest: int) -> DataFrame:
    """``part, phrase, words, n`` of the pairs of words in the bit map ``words``, or with ``pairs`` of longer phrases."""
    sc = source.sparkSession.sparkContext
    shared = sc.broadcast((words, pairs))

    def run(batches):
        frequent, paired = shared.value
        size = 8 * len(frequent)
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        names: dict[str, list[bytes]] = defaultdict(lambda: [b""])
        hashes: dict[str, list[int]] = defaultdict(lambda: [0])
        held: dict[str, list[np.ndarray]] = defaultdict(list)

        def number(part: str, new: set[bytes]) -> None:
            """Numbers words not seen before: from 1 if they may be frequent, else 0."""
            listed = list(new)
            found = np.fromiter((word_hash(part, w) for w in listed), dtype=np.uint64, count=len(listed))
            hit = in_map(frequent, place_of(found, size)).tolist()
            ids = known[part]
            for word, h, yes in zip(listed, found.tolist(), hit, strict=True):
                if yes:
                    ids[word] = len(names[part])
                    names[part].append(word)
                    hashes[part].append(h)
                else:
                    ids[word] = 0

        def out(part: str):
            ids, text = np.concatenate(held.pop(part)), pa.array(names[part], type=pa.binary()).cast(pa.string())
            shard = Shard(ids, len(names[part]))
            for phrases, counts in mine(shard, np.array(hashes[part], dtype=np.uint64), paired, longest):
                columns = [text.take(pa.array(phrases[:, k])) for k in range(phrases.shape[1])]
                yield _batch(part, pc.binary_join_element_wise(*columns, " "), phrases.shape[1], counts)
            known.pop(part), names.pop(part), hashes.pop(part)

        for batch in batches:
            for rows in _batches(batch):
                for part, text in rows:
                    tokens, ids = tokens_of(text), known[part]
                    ids[END] = 0
                    new = set(tokens).difference(ids)
                    if new:
                        number(part, new)
                    held[part].append(np.fromiter(map(ids.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
                for part in [p for p, arrays in held.items() if sum(map(len, arrays)) > SHARD or len(known[p]) > SHARD // 2]:
                    yield from out(part)
        for part in list(held):
            yield from out(part)

    return source.mapInArrow(run, COUNTS).groupBy("part", "phrase", "words").agg(F.sum("n").alias("n"))


def _map(found: DataFrame) -> np.ndarray:
    """Bit map of words or of pairs of words."""
    size = map_size(found.count())

    def run(batches):
        for batch in batches:
            at = np.empty(batch.num_rows, dtype=np.int64)
            for k, (part, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                h = [np.uint64(word_hash(part, w)) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")]
                at[k] = place_of(h[0] if len(h) == 1 else pair_hash(*(x[None] for x in map(np.array, h)))[0], size)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    return bit_map(found.select("part", "phrase").mapInArrow(run, "at long"), size)


def frequent_phrases(df: DataFrame, support: int, longest: int, text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``part, phrase, words, n`` of all phrases of 1 to ``longest`` words that occur ``support`` times, and
    ``part, total``: the occurrences of all words."""
    source = _source(df, text_col, part_col)
    counts = written(word_counts(source), "word-counts")
    totals = written(counts.groupBy("part").agg(F.sum("n").alias("total")), "word-totals")
    enough = F.col("n") >= support
    found = [written(counts.filter(enough), "frequent-words")]
    dropped(counts)
    words = _map(found[0])
    if longest > 1:
        found.append(written(phrase_counts(source, words, None, 2).filter(enough), "frequent-pairs"))
    if longest > 2:
        found.append(written(phrase_counts(source, words, _map(found[1]), longest).filter(enough), "frequent-phrases"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def collocations(df: DataFrame, support: int = 100, longest: int = 5, most: int = 2000, text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, rank, phrase, a, l, r, n, score``: the first ``most`` phrases of each part by their weakest cut.

    Cut after its first k words, a phrase scores floor(1000 * a * n / (l * r)) with its count a, those of its sides l and
    r, and all words n; the lowest score counts, of equal ones that of the smallest k. Phrases inside a longer one of the
    same count are left out."""
    found, totals = frequent_phrases(df, support, longest, text_col, part_col)
    both = found.filter("words > 1")
    split = both.select("part", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cut = split.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    side = lambda w: F.concat_ws(" ", w)
    cut = cut.select("part", "phrase", "a", "k", side(F.slice("w", F.lit(1), F.col("k"))).alias("left"), side(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k"))).alias("right"))
    for name, count in (("left", "l"), ("right", "r")):
        cut = cut.join(found.select("part", F.col("phrase").alias(name), F.col("n").alias(count)), ["part", name])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.join(totals.withColumnRenamed("total", "n"), "part").withColumn("up", (wide("a") * wide("n")).cast("decimal(34,0)")).withColumn("down", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cut = cut.withColumn("score", F.expr("(up * 1000bd) div down"))
    best = cut.groupBy("part", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    longer = split.filter("words > 2")
    inside = longer.select("part", F.col("a"), F.inline(F.array(*[F.struct(side(F.slice("w", F.lit(s), F.col("words") - 1)).alias("phrase")) for s in (1, 2)])))
    best = best.join(inside.distinct(), ["part", "phrase", "a"], "left_anti").select("part", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = Window.partitionBy("part").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("part", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
