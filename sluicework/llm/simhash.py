"""SimHash fingerprints and their near-duplicate groups, by generalised pigeonhole search.

The 64 bits are cut into partitions of correlated bits; partition i gets a threshold t_i (-1: not probed)
with sum(t_i) = d - m + 1 for m partitions. Two fingerprints that differ in at most d bits then differ in
at most t_i bits of some partition i, so probing each partition to its own radius loses no link. Bits are
grouped by their correlations and thresholds are allotted by dynamic programming on the candidate counts
and signatures that each (partition, threshold) is expected to cost; m is the cheapest found. These
estimates come from a bounded sample and steer cost only: every plan finds every link.

Only distinct fingerprints are searched. Rows of one bucket lie together in a sorted stream, candidates
are verified by the number of differing bits, and a task gives out tree links only, never all pairs; a
bucket of over HOT rows is split by exact pieces of the remaining bits over several tasks.

Cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any other;
a text of fewer words than a shingle is one shingle; equal ids and repeated rows keep their rows; null ids
never name a component; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_map, digest_place, in_map, map_size, written
from .components import components, spanning, tree_links
from .exactdedup import _batches

SAMPLE = 8192
"""Fingerprints, at most, from which costs are estimated."""
HOT = 200_000
"""Rows of a bucket from which it is split over tasks."""
CHECK_NS, ROW_NS = 3.0, 1500.0
"""Rough cost of verifying a candidate and of making and moving a signature, in nanoseconds."""


def shingle_digests(data: bytes, width: int) -> list[bytes]:
    """XXH64 (seed 42) of each shingle, big-endian."""
    from xxhash import xxh64_digest

    words = data.split()  # of bytes: at 0x20 and 0x09-0x0D only
    if not words:
        return []
    if len(words) < width:
        return [xxh64_digest(b" ".join(words), 42)]
    return [xxh64_digest(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(width)), strict=False)]


def fingerprint_many(texts: list[bytes], width: int) -> np.ndarray:
    """64-bit fingerprints as unsigned numbers."""
    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for i, text in enumerate(texts):
        digests = shingle_digests(text, width)
        n = len(digests)
        if not n:
            continue
        raw = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(n, 8)
        total = np.zeros(64, dtype=np.int64)
        for lo in range(0, n, 1 << 15):
            total += np.unpackbits(raw[lo : lo + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
        out[i] = weights[2 * total > n].sum()
    return out


BINS = 128
"""Bytes of a sketch: one-permutation minima of shingle hashes, a byte a bin, 0 where a bin is empty."""


BAND, BANDS = 4, 20
"""Bins of a band, and bands of a text with nearly all bins filled; a shorter text has all BINS / BAND."""
_EMPTY = np.iinfo(np.uint64).max


def minima(data: bytes, width: int) -> np.ndarray:
    """Least shingle hash of each bin, all ones where a bin is empty."""
    digests = shingle_digests(data, width)
    low = np.full(BINS, _EMPTY, dtype=np.uint64)
    if digests:
        h = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64)
        np.minimum.at(low, (h % np.uint64(BINS)).astype(np.int64), h >> np.uint64(7))
    return low


def sketch(low: np.ndarray) -> bytes:
    """Sketch of the set of shingles, from which the Jaccard similarity of two texts is estimated."""
    return np.where(low != _EMPTY, 1 + (low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(255), 0).astype(np.uint8).tobytes()


def band_keys(low: np.ndarray) -> bytes:
    """64-bit keys of the bands that hold a shingle, from the whole hashes; one key that all texts without shingles share."""
    rows = low.reshape(-1, BAND)
    full = np.flatnonzero((rows != _EMPTY).any(axis=1))
    if not len(full):
        return np.zeros(1, dtype=np.uint64).tobytes()
    if (low == _EMPTY).sum() < BINS // 4:
        full = full[full < BANDS]
    key = full.astype(np.uint64)
    for c in range(BAND):
        key = (key ^ rows[full, c]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.tobytes()


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarities of one sketch with others; two empty sets are alike."""
    either = np.maximum(((one | many) != 0).sum(axis=1), 1)
    same = ((one == many) & (many != 0)).sum(axis=1)
    return np.where(((one | many) != 0).any(axis=1), (same / either - 1 / 255) / (1 - 1 / 255), 1.0)


def fingerprints(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text", sketch_width: int = 0) -> DataFrame:
    """``id, fp`` of every row, fp as a signed long; with ``sketch_width`` also ``sketch``, ``bands`` and ``text_sha256``."""

    def run(batches):
        for batch in batches:
            for held in _batches(batch):
                fps = fingerprint_many([t for _, t in held], width)
                lows = [minima(t, sketch_width) for _, t in held] if sketch_width else []
                sketches, bands = ([f(x) for x in lows] or [b""] * len(held) for f in (sketch, band_keys))
                keys = [hashlib.sha256(t).hexdigest() if sketch_width else "" for _, t in held]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in held], type=pa.int64()), pa.array(fps.view(np.int64)), pa.array(sketches, type=pa.binary()), pa.array(bands, type=pa.binary()), pa.array(keys)],
                    names=["id", "fp", "sketch", "bands", "text_sha256"],
                )

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, fp long, sketch binary, bands binary, text_sha256 string")


def _bits(fps: np.ndarray) -> np.ndarray:
    return (fps[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1)


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Cuts the 64 bits into parts of like size, correlated bits together."""
    if len(bits) > 1:
        x = bits - bits.mean(axis=0)
        scale = np.sqrt((x * x).sum(axis=0))
        like = np.abs((x.T @ x) / np.maximum(np.outer(scale, scale), 1e-9))
    else:
        like = np.zeros((64, 64))
    np.fill_diagonal(like, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        want = len(left) // (parts - k)
        rest = sorted(left)
        group = [max(rest, key=lambda j: (like[j, rest].sum(), -j))]
        while len(group) < want:
            rest = sorted(left.difference(group))
            group.append(max(rest, key=lambda j: (like[j, group].sum(), -j)))
        left.difference_update(group)
        out.append(sorted(group))
    return out


def near_shares(bits: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Estimated share of all pairs that differ in at most 0, 1, ... ``most`` of the group's bits."""
    p = bits[:, group].mean(axis=0) if len(bits) else np.full(len(group), 0.5)
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for d in 2 * p * (1 - p):  # as if bits were independent
        dist = dist * (1 - d) + np.concatenate([[0], dist[:-1]]) * d
    shares = np.cumsum(dist)
    if len(bits) > 1:
        rng = np.random.default_rng(7)
        a, b = rng.integers(0, len(bits), (2, 200_000))
        differ = (bits[a[a != b]][:, group] != bits[b[a != b]][:, group]).sum(axis=1)
        shares = np.maximum(shares, [(differ <= t).mean() for t in range(most + 1)])
    return shares


def allot(bits: np.ndarray, count: int, most: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, cheapest over the number of partitions."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, most + 2):
        groups = group_bits(bits, m)
        need = most - m + 1
        table = {0: (0.0, [])}  # sum of (t + 1) so far -> cost, thresholds
        for g in groups:
            shares = near_shares(bits, g, min(3, most))
            costs = {-1: 0.0}
            for t in range(0, min(3, most) + 1):
                ball = sum(comb(len(g), r) for r in range(t + 1))
                costs[t] = count * ball * ROW_NS + count * count / 2 * shares[t] * CHECK_NS * (1 + (t > 0))
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in table.items():
                for t, extra in costs.items():
                    if s + t + 1 <= need + m and (s + t + 1 not in new or c + extra < new[s + t + 1][0]):
                        new[s + t + 1] = (c + extra, [*ts, t])
            table = new
        if need + m in table and (best is None or table[need + m][0] < best[0]):
            cost, ts = table[need + m]
            best = (cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def _project(fps: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for k, j in enumerate(group):
        out |= ((fps >> np.uint64(j)) & np.uint64(1)) << np.uint64(k)
    return out


ROWS = "bucket long, fp long, own boolean, sketch binary"


def signatures(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """``bucket, fp, own, sketch``: each fingerprint under its own value and those within the threshold."""

    def run(batches):
        masks = []
        for group, t in plan:
            own = [0]
            for r in range(1, t + 1):
                own += [sum(1 << k for k in c) for c in combinations(range(len(group)), r)]
            masks.append(np.array(own, dtype=np.uint64))
        for batch in batches:
            column = batch.column(0).to_numpy()
            for lo in range(0, len(column), 2048):
                values = column[lo : lo + 2048].view(np.uint64)
                for i, ((group, _), mask) in enumerate(zip(plan, masks, strict=True)):
                    key = (_project(values, group)[:, None] ^ mask[None, :]) | (np.uint64(i) << np.uint64(56))
                    own = np.broadcast_to(np.arange(len(mask)) == 0, key.shape)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.ravel().view(np.int64)),
                            pa.array(np.repeat(values.view(np.int64), len(mask))),
                            pa.array(own.ravel()),
                            batch.column(1).take(pa.array(np.repeat(np.arange(lo, lo + len(values)), len(mask)))),
                        ],
                        names=["bucket", "fp", "own", "sketch"],
                    )

    return fps.select("fp", "sketch").mapInArrow(run, ROWS)


def split_hot(rows: DataFrame, plan: list[tuple[list[int], int]], most: int) -> DataFrame:
    """Rows of buckets over HOT go to smaller ones: within d differing bits, one of d + 1 pieces is equal."""
    hot = written(rows.groupBy("bucket").count().filter(F.col("count") > HOT).select("bucket", F.lit(True).alias("hot")), "hot-buckets")
    if hot.isEmpty():
        return rows

    def cut(batches):
        rest = [[j for j in range(64) if j not in set(group)] for group, _ in plan]
        pieces = [[r[k :: most + 1] for k in range(most + 1)] for r in rest]
        for batch in batches:
            bucket, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            which = (bucket.view(np.uint64) >> np.uint64(56)).astype(np.int64)
            for i in np.unique(which).tolist():
                at = np.flatnonzero(which == i)
                for k, piece in enumerate(pieces[i]):
                    sub = _project(fp[at], piece) | np.uint64((k + 1) << 40)
                    mixed = (bucket[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (sub * np.uint64(0xC2B2AE3D27D4EB4F))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mixed.view(np.int64)), pa.array(fp[at].view(np.int64)), *(c.take(pa.array(at)) for c in batch.columns[2:])],
                        names=["bucket", "fp", "own", "sketch"],
                    )

    marked = rows.join(hot, "bucket", "left")
    return (
        marked.filter("hot is null")
        .select("bucket", "fp", "own", "sketch")
        .union(marked.filter("hot").select("bucket", "fp", "own", "sketch").mapInArrow(cut, ROWS))
    )


SMALL = 48
"""Rows of a bucket up to which it is compared together with other small ones."""


def bucket_links(bucket: np.ndarray, fp: np.ndarray, own: np.ndarray, sketches: np.ndarray, most: int, alike: float) -> tuple[np.ndarray, np.ndarray]:
    """Tree links among the fingerprints of whole buckets (sorted) that differ in at most ``most`` bits.

    With ``alike``, linked fingerprints also have sketches of at least that similarity."""
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(starts, len(bucket)))
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    b, f, o = bucket[small], fp[small], own[small]
    left, right = [], []
    top = int(sizes[sizes <= SMALL].max(initial=0))
    for shift in range(1, top):
        at = np.flatnonzero((b[:-shift] == b[shift:]) & (o[:-shift] | o[shift:]))
        at = at[np.bitwise_count(f[at] ^ f[at + shift]) <= most]
        if alike and len(at):
            at = at[similarity(sketches[small[at]], sketches[small[at + shift]]) >= alike]
        left.append(f[at])
        right.append(f[at + shift])
    for k in np.flatnonzero(sizes > SMALL).tolist():
        part = slice(starts[k], starts[k] + sizes[k])
        for members in _search(fp[part], own[part], sketches[part] if alike else None, most, alike):
            a, c = tree_links(members)
            left.append(a)
            right.append(c)
    if not left:
        return fp[:0], fp[:0]
    return spanning(np.concatenate(left), np.concatenate(right))


def _search(fps: np.ndarray, own: np.ndarray, sketches: np.ndarray | None, most: int, alike: float):
    """Components of one large bucket, breadth first: each member is compared with those not reached yet."""
    order = np.argsort(~own, kind="stable")  # a fingerprint that is there both ways counts as own
    fps, first = np.unique(fps[order], return_index=True)
    own, place = own[order][first], order[first]
    left = np.arange(len(fps))
    free = fps
    while len(left):
        found, queue = [left[0]], [left[0]]
        left, free = left[1:], free[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(free ^ fps[at]) <= most
            if not near.any():
                continue
            if not own[at]:  # two rows that only probe here meet elsewhere
                near &= own[left]
            if sketches is not None:
                which = np.flatnonzero(near)
                near[which] = similarity(sketches[place[at]][None, :], sketches[place[left[which]]]) >= alike
            if near.any():
                found += left[near].tolist()
                queue += left[near].tolist()
                left, free = left[~near], free[~near]
        if len(found) > 1:
            yield fps[np.array(found)]


def near_links(fps: DataFrame, most: int, alike: float = 0.0) -> DataFrame:
    """Tree links ``a, b`` that connect all distinct fingerprints differing in at most ``most`` bits."""
    if most < 1:  # equal fingerprints need no link
        return fps.sparkSession.createDataFrame([], "a long, b long")
    fps = written(fps.groupBy("fp").agg(F.min("sketch").alias("sketch")), "distinct-fingerprints")
    count = fps.count()
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    plan = allot(_bits(sample).astype(np.float64), count, most)
    return _linked(split_hot(signatures(fps, plan), plan, most), most, alike)


def _linked(rows: DataFrame, most: int, alike: float) -> DataFrame:
    """Tree links ``a, b`` of the rows that meet in a bucket."""

    def run(batches):
        carry: list[tuple[np.ndarray, ...]] = []
        held = 0

        def out(parts):
            bucket, fp, own, sketches = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = bucket_links(bucket, fp.view(np.uint64), own, sketches, most, alike)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]]
            data = b"".join(batch.column(3).to_pylist()) if alike else b""
            cols.append(np.frombuffer(data, dtype=np.uint8).reshape(batch.num_rows, -1) if alike else np.zeros((batch.num_rows, 0), np.uint8))
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))  # the last bucket may go on
            if cut and held + cut >= 50_000:
                yield out([*carry, tuple(c[:cut] for c in cols)])
                carry, held = [tuple(c[cut:] for c in cols)], len(cols[0]) - cut
            else:
                carry.append(tuple(cols))
                held += len(cols[0])
        if carry:
            yield out(carry)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def near_groups(df: DataFrame, width: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp (long), component_id`` of every row: the smallest id reachable over links of ``most`` bits."""
    prints = written(fingerprints(df, width, id_col, text_col), "simhash")
    roots = components(written(near_links(prints, most), "simhash-links"))
    named = prints.groupBy("fp").agg(F.min("id").alias("low")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = written(named.select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    lowest = written(named.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lowest")
    table = written(named.join(lowest, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(table, "fp").select("id", "fp", "component_id")


LOOSE = 0.62
"""Sketched similarity of candidates: five standard errors (0.035) under 0.8. Most texts of just 0.8 differ in more
fingerprint bits than a search can afford; they meet in bands: all are missed with probability (1 - 0.8^4)^20 = 3e-5."""
LARGE, PIVOTS = 64, 16
"""Members of a candidate group up to which one task compares all of them; first pivots of larger groups."""


def shingle_set(data: bytes, width: int) -> bytes:
    """The distinct shingles of a text as sorted 64-bit numbers."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(data, width)), dtype=np.uint64)).tobytes()


def jaccard_from(one: np.ndarray, other: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity; two empty sets are alike."""
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    if len(small) < least * len(large):
        return False
    if not len(small):
        return True
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both >= least * (len(small) + len(large) - both)


def band_links(nodes: DataFrame) -> DataFrame:
    """Tree links of the ``node``s that share one of their ``bands`` and have sketches of LOOSE similarity.

    Only keys and nodes are shuffled first; sketches are joined to what shares a key."""

    def spread(batches):
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(1)]
            sizes = [len(x) for x in held]
            if sizes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], names=["bucket", "node"])

    def shared(batches):
        key, first = None, None  # the last row: its node is given out once another of its key follows
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, node = (batch.column(k).to_numpy() for k in (0, 1))
            same = np.concatenate([[bucket[0] == key], bucket[1:] == bucket[:-1]])
            out = same.copy()
            out[:-1] |= same[1:]
            rows, names = bucket[out], node[out]
            if same[0] and first is not None:
                rows, names = np.append(rows, key), np.append(names, first)
            key, first = bucket[-1], None if same[-1] else node[-1]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(names)], names=["bucket", "node"])

    shape = "bucket long, node long"
    keys = nodes.select("node", "bands").mapInArrow(spread, shape).repartition("bucket").sortWithinPartitions("bucket")
    meet = keys.mapInArrow(shared, shape).join(nodes.select("node", "sketch"), "node")
    return _linked(meet.select("bucket", F.col("node").alias("fp"), F.lit(True).alias("own"), "sketch"), 64, LOOSE)


def _candidates(nodes: DataFrame, most: int) -> DataFrame:
    """``node, root`` of the candidate groups: near fingerprints or a common band, and LOOSE similarity of the sketches."""
    by_bits = written(near_links(nodes, most, LOOSE), "near-bits")
    first = written(nodes.groupBy("fp").agg(F.min_by("node", F.struct("sketch", "node")).alias("node")), "near-first")
    for side in ("a", "b"):
        named = first.select(F.col("fp").alias(side), F.col("node").alias("n"))
        by_bits = by_bits.join(named, side).drop(side).withColumnRenamed("n", side)
    return components(written(by_bits.select("a", "b").union(band_links(nodes)), "near-candidates"))


def _sets(df: DataFrame, groups: DataFrame, width: int, text_col: str, repeated: bool) -> DataFrame:
    """``node, root, size, shingles`` of the nodes of the groups, one row each; texts may be ``repeated``.

    Texts are read where they lie: a bit map of the digests wanted (16 bits for each, at most 32 MB) lets the others pass
    by, and only shingle sets are shuffled."""
    size = map_size(groups.count())
    shared = df.sparkSession.sparkContext.broadcast(bit_map(groups.select(digest_place(F.col("text_sha256"), size).alias("at")), size))

    def run(batches):
        on = shared.value
        for batch in batches:
            for part in _batches(batch):
                keys = [hashlib.sha256(t).hexdigest() for _, t in part]
                hit = np.flatnonzero(in_map(on, np.array([int(k[:8], 16) % (8 * len(on)) for k in keys], dtype=np.int64))).tolist()
                if hit:
                    sets = [shingle_set(part[i][1], width) for i in hit]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit]), pa.array(sets, type=pa.binary())], names=["text_sha256", "shingles"])

    source = df.select(F.lit(None).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = source.mapInArrow(run, "text_sha256 string, shingles binary").join(groups, "text_sha256")
    held = held.select("node", "root", "size", "shingles")
    return held.dropDuplicates(["node"]) if repeated else held


def _arrays(table: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    return table["node"].to_pylist(), [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["shingles"]]


def _as_links(pairs: list[tuple[int, int]]) -> pa.Table:
    """Tree links of what the pairs connect."""
    both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    a, b = spanning(both[:, 0], both[:, 1])
    return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})


def _small_links(sets: DataFrame, least: float) -> DataFrame:
    """Links of the groups of up to LARGE members, breadth first: each member is compared with those not reached yet."""

    def run(table: pa.Table) -> pa.Table:
        names, held = _arrays(table)
        left, pairs = list(range(len(names))), []
        while left:
            queue = [left.pop()]
            while queue and left:
                at = queue.pop()
                near = [k for k in left if jaccard_from(held[at], held[k], least)]
                pairs += [(names[at], names[k]) for k in near]
                queue += near
                left = [k for k in left if k not in set(near)]
        return _as_links(pairs)

    return sets.filter(F.col("size") <= LARGE).groupBy("root").applyInArrow(run, "a long, b long")


def _large_links(sets: DataFrame, least: float) -> DataFrame | None:
    """Links of larger groups, in rounds: all members, dealt over tasks, are compared with some pivots.

    Afterwards only members outside the largest part of their group become pivots; when all of those have been,
    no pair of different parts is left untested."""
    hot = written(sets.filter(F.col("size") > LARGE), "near-large")
    if hot.isEmpty():
        return None
    shares = F.ceil(F.col("size") / LARGE)
    members = hot.withColumn("salt", F.pmod(F.xxhash64("node"), shares))
    turn = Window.partitionBy("root").orderBy(F.xxhash64("node"), "node")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, held = _arrays(left)
        pivots, theirs = _arrays(right)
        return _as_links([(n, p) for n, x in zip(names, held, strict=True) for p, y in zip(pivots, theirs, strict=True) if n != p and jaccard_from(x, y, least)])

    waiting, used, links, most = hot.select("node", "root"), None, None, PIVOTS
    while True:
        chosen = waiting.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= most).select("node")
        chosen = written(chosen, "near-pivots")
        if chosen.isEmpty():
            return links
        used = chosen if used is None else used.union(chosen)
        pivots = written(hot.join(chosen, "node").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))), "near-pivot-sets")
        found = members.groupBy("root", "salt").cogroup(pivots.groupBy("root", "salt")).applyInArrow(run, "a long, b long")
        found = written(found, "near-pivot-links")
        links = found if links is None else links.union(found)
        parts = components(links).withColumnRenamed("root", "part")
        named = written(hot.select("node", "root").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "near-parts")
        counts = named.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"))
        largest = counts.groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
        waiting = named.join(largest, "root").filter("part <> largest").select("node", "root").join(used, "node", "left_anti")
        most *= 4


def near_copies(
    df: DataFrame, width: int, most: int, least: float, set_width: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, text_sha256`` of the rows that are near copies of a row that stays.

    Two texts are near copies if their whole sets of shingles of ``set_width`` words have a Jaccard similarity of
    ``least`` or more; of all that are linked so, over any number of steps, the row of the least id stays (null ids last,
    then by digest). Fingerprints and sketches only find candidates; every link is decided on the sets."""
    prints = written(fingerprints(df, width, id_col, text_col, set_width), "near-prints")
    nodes = prints.groupBy("text_sha256").agg(F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    groups = _candidates(nodes, most)
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    groups = written(groups.join(sizes, "root").join(nodes.select("node", "text_sha256"), "node"), "near-groups")
    sets = written(_sets(df, groups, set_width, text_col, prints.count() > nodes.count()), "near-sets")
    links, large = _small_links(sets, least), _large_links(sets, least)
    roots = components(written(links if large is None else links.union(large), "near-links"))
    named = nodes.select("node", "text_sha256").join(roots, "node", "left").select("text_sha256", F.coalesce("root", "node").alias("root"))
    rows = written(prints.select("id", "text_sha256").distinct().join(named, "text_sha256"), "near-rows")
    order = F.struct(F.col("id").isNull(), "id", "text_sha256")
    lowest = rows.groupBy("root").agg(F.min(order).alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(lowest, "root").filter(~F.struct("id", "text_sha256").eqNullSafe(F.struct("low.id", "low.text_sha256"))).select("id", "text_sha256")


def as_hex(fp):
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
