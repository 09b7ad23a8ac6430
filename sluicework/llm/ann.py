"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns a unit vector with three rounds of random signs and a fast Hadamard transform and takes the
nearest signed axis: 2d values. A table joins two such hashes. Queries probe, in every table, the SHARE of all
axis pairs with the least loss against their own, at every size of the input alike. What is sent to the tables
is a short code of each vector, a byte a component, with a bound of its error; so a task can tell which
candidates may be among the best, without loss, and only their full vectors are joined for the exact cosines.

Rows of a table meet in blocks of axis pairs: as many blocks as keep one at about BLOCK vectors, further split
by salt where one holds more. A block's vectors come first in a sorted stream, its queries after them. A bounded
sample of the index gives each query a floor that its k-th best can't fall under, so few candidates leave a task.

Equal vectors are one class with its smallest ids, as many as a result can hold, so copies of any number
cost one row. A query for which the tables hold fewer candidates than there are is answered by an exact pass
over all vectors, in blocks of such queries.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, neither as query
nor candidate; vectors are compared with those of equal length only; a repeated id counts once per distinct
vector; ties of score go to the smaller id; fewer candidates than wanted give fewer rows; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TABLES, SHARE = 6, 1 / 16
"""Tables, and the share of each table's axis pairs that a query probes."""
GROUPS, BLOCK = 16, 16384
"""Blocks of first axes that a table has at least; vectors that a block holds at most, on average or by salt."""
SAMPLE_BYTES = 4 << 20
"""Size of the sample of vectors from which queries get their floors."""
SEED = 20_240_601


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """Signed coordinates (2d of them) of each row after the pseudo-rotation of one hash."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, table, part, size])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], size))
    return np.concatenate([y, -y], axis=1)


def probed(first: np.ndarray, second: np.ndarray, count: int) -> np.ndarray:
    """(rows, axes, axes): for each row the ``count`` axis pairs of least squared loss against its own."""
    loss = ((first.max(axis=1, keepdims=True) - first) ** 2)[:, :, None] + ((second.max(axis=1, keepdims=True) - second) ** 2)[:, None, :]
    flat = loss.reshape(len(first), -1)
    if count >= flat.shape[1]:
        return np.ones(loss.shape, dtype=bool)
    return (flat <= np.partition(flat, count - 1, axis=1)[:, count - 1 : count]).reshape(loss.shape)


def levelled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares stay in range; the cosine is the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of a vector (or of one for each row) with others in double precision, summed from left to right."""
    query, rows = levelled(query), levelled(rows)
    total = lambda x: np.cumsum(x, axis=-1)[..., -1]
    return total(rows * query) / (np.sqrt(total(query * query)) * np.sqrt(total(rows * rows)))


def matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and rows (as doubles) of the non-null lists of a column, by their length."""
    starts = column.offsets.to_numpy()
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        out[n] = (at, values[starts[at][:, None] + np.arange(n)])
    return out


def units(x: np.ndarray) -> np.ndarray:
    x = levelled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, scale and error bound of unit vectors: ``|unit - scale * bytes| <= error``."""
    scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    code = np.rint(unit / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    error = np.sqrt(((unit - code * scale[:, None].astype(np.float64)) ** 2).sum(axis=1))
    return code, scale, (error * 1.001 + 1e-6).astype(np.float32)


class Blocks:
    """Where axis pairs of vectors of one length meet; ``count`` vectors have this length."""

    def __init__(self, dims: int, count: int) -> None:
        self.axes = 2 << max(0, (dims - 1).bit_length())
        self.rows = min(self.axes, GROUPS)
        while self.rows < self.axes and count > BLOCK * self.rows:
            self.rows *= 2
        self.cols = 1
        while self.cols < self.axes and count > BLOCK * self.rows * self.cols:
            self.cols *= 2
        self.shape = (self.axes // self.rows, self.axes // self.cols)  # axis pairs of a block

    def of(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block within the table, and pair within the block."""
        block = first % self.rows * self.cols + second % self.cols
        return block, first // self.rows * self.shape[1] + second // self.cols

    def masks(self, pairs: np.ndarray) -> np.ndarray:
        """(rows, blocks, pairs of a block) of probed pairs (rows, axes, axes)."""
        cut = pairs.reshape(len(pairs), self.shape[0], self.rows, self.shape[1], self.cols)
        return cut.transpose(0, 2, 4, 1, 3).reshape(len(pairs), self.rows * self.cols, -1)


def classes(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vkey, dims, vec`` of every usable vector; equal vectors have equal keys."""
    kind = "float" if dict(df.dtypes)[vec_col] == "array<float>" else "double"

    def run(batches):
        width = pa.float32() if kind == "float" else pa.float64()
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for n, (at, x) in matrices(batch.column(1)).items():
                fit = known[at] & np.isfinite(x).all(axis=1) & x.any(axis=1)
                at, x = at[fit], x[fit] + 0.0  # no negative zeros
                data = np.ascontiguousarray(x)
                keys = [hashlib.blake2b(row, digest_size=16).digest() for row in data]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), pa.array(x.ravel()).cast(width))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(keys, type=pa.binary()), pa.array(np.full(len(at), n, dtype=np.int32)), rows],
                    names=["vec_id", "vkey", "dims", "vec"],
                )

    source = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    return source.mapInArrow(run, f"vec_id long, vkey binary, dims int, vec array<{kind}>")


MEET = "bucket long, salt int, asks int, node long, pair int, payload binary"
_MEET = ["bucket", "salt", "asks", "node", "pair", "payload"]


def _payload(*parts: np.ndarray) -> pa.Array:
    """Rows of fixed-size parts as binary values of one width."""
    data = np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(len(p), -1) for p in parts], axis=1)
    size = pa.array(np.arange(len(data) + 1, dtype=np.int32) * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(data), [None, size.buffers()[1], pa.py_buffer(data.tobytes())])


def _meeting(bucket, salt, asks, node, pair, payload) -> pa.RecordBatch:
    n = len(bucket)
    small = lambda x: pa.array(np.broadcast_to(np.asarray(x, dtype=np.int32), (n,)))
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), small(salt), small(asks), pa.array(node), small(pair), payload], names=_MEET)


def _bucket(dims: int, table: int, block: np.ndarray) -> np.ndarray:
    return np.int64(dims) << 44 | np.int64(table) << 36 | block.astype(np.int64)


def hot_salts(sample: dict[int, tuple[np.ndarray, np.ndarray]], blocks: dict[int, Blocks], totals: dict[int, int], tables: int) -> dict[int, int]:
    """Salts of the blocks that, going by the sample, hold over twice BLOCK vectors; they steer balance, not results."""
    out = {}
    for n, (unit, _) in sample.items():
        for t in range(tables):
            block, _ = blocks[n].of(*(rotated(unit, t, j).argmax(axis=1) for j in (0, 1)))
            which, seen = np.unique(_bucket(n, t, block), return_counts=True)
            held = seen * (totals[n] / len(unit))
            out |= {int(b): int(np.ceil(h / BLOCK)) for b, h in zip(which, held, strict=True) if h > 2 * BLOCK}
    return out


def placed(index: DataFrame, blocks: dict[int, Blocks], tables: int, salts: dict[int, int]) -> DataFrame:
    """Codes of all indexed vectors in the blocks of every table."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                for n, (at, x) in matrices(part.column(1)).items():
                    unit, node = units(x), part.column(0).to_numpy()[at]
                    load = _payload(*coded(unit))
                    for t in range(tables):
                        block, pair = blocks[n].of(*(rotated(unit, t, j).argmax(axis=1) for j in (0, 1)))
                        bucket = _bucket(n, t, block)
                        salt = node * 0x9E3779B1 >> 16 & 0xFFFF if salts else np.zeros(len(node), dtype=np.int64)
                        many = np.array([salts.get(b, 1) for b in bucket.tolist()]) if salts else 1
                        yield _meeting(bucket, salt % many, 0, node, pair, load)

    return index.select("row", "vec").mapInArrow(run, MEET)


def asking(queries: DataFrame, blocks: dict[int, Blocks], tables: int, share: float, sample: dict[int, tuple[np.ndarray, np.ndarray]], salts: dict[int, int], k: int) -> DataFrame:
    """Codes of the queries, with their probes and floors, in every block that they probe."""

    def floors(n: int, unit: np.ndarray, node: np.ndarray) -> np.ndarray:
        rows, known = sample.get(n, (np.zeros((0, n)), np.zeros(0, dtype=np.int64)))
        if len(rows) <= k:
            return np.full(len(unit), -2, dtype=np.float32)
        scores = np.where(known[None, :] == node[:, None], -2.0, unit @ rows.T)
        return (np.partition(scores, -k, axis=1)[:, -k] - 1e-5).astype(np.float32)

    def run(batches):
        for batch in batches:
            for n, (at, x) in matrices(batch.column(1)).items():
                cut, unit, node = blocks[n], units(x), batch.column(0).to_numpy()[at]
                code, scale, error = coded(unit)
                floor = np.concatenate([floors(n, unit[lo : lo + 512], node[lo : lo + 512]) for lo in range(0, len(node), 512)])
                many = max(1, (1 << 22) // cut.axes**2)
                for lo in range(0, len(node), many):
                    part = slice(lo, lo + many)
                    for t in range(tables):
                        pairs = probed(rotated(unit[part], t, 0), rotated(unit[part], t, 1), max(1, round(share * cut.axes**2)))
                        mask = cut.masks(pairs)
                        row, block = np.nonzero(mask.any(axis=2))
                        bits = np.packbits(mask[row, block], axis=1)
                        bucket, row = _bucket(n, t, block), row + lo
                        load = _payload(code[row], scale[row], error[row], floor[row], bits)
                        copies = np.array([salts.get(b, 1) for b in bucket.tolist()])
                        for s in range(int(copies.max(initial=0))):
                            held = np.flatnonzero(copies > s)
                            yield _meeting(bucket[held], s, 1, node[row[held]], 0, load.take(pa.array(held)))

    return queries.select("row", "vec").mapInArrow(run, MEET)


def _rows(payload: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coded vectors, their errors and what else the payloads of one block hold."""
    data = np.frombuffer(b"".join(payload.to_pylist()), dtype=np.uint8).reshape(len(payload), -1)
    scale, error = (np.ascontiguousarray(data[:, dims + 4 * i : dims + 4 * i + 4]).view(np.float32)[:, 0] for i in (0, 1))
    return data[:, :dims].view(np.int8) * scale[:, None], error, data[:, dims + 8 :]


def _best(score, slack, floor, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) positions of what may be among the k best of a query: not under its floor, and not surely under
    its k-th best here; ``score`` is -4 where a pair was not probed."""
    query, found = np.nonzero(score + slack >= np.maximum(floor, -3)[:, None])
    counts = np.bincount(query, minlength=len(score))
    for i in np.flatnonzero(counts > 4 * k).tolist():  # many: those of this block that k others surely beat can go
        mine = np.flatnonzero(query == i)
        sure = score[i, found[mine]] - slack[i, found[mine]]
        high = score[i, found[mine]] + slack[i, found[mine]]
        query[mine[high < np.partition(sure, -k)[-k]]] = -1
    return query[query >= 0], found[query >= 0]


def matched(rows: DataFrame, k: int) -> DataFrame:
    """``qnode, node, low, high``: candidates of the queries of each block, with bounds of their cosines."""

    def compare(bucket: int, held: list[tuple], asks: pa.RecordBatch):
        dims = bucket >> 44
        nodes, pairs, x, error = (np.concatenate(c) for c in zip(*held, strict=True))
        node = asks.column(3).to_numpy()
        many = max(1, (1 << 22) // len(nodes))
        for lo in range(0, len(node), many):
            q, qerror, rest = _rows(asks.column(5).slice(lo, many), dims)
            floor = np.ascontiguousarray(rest[:, :4]).view(np.float32)[:, 0]
            open_ = np.unpackbits(rest[:, 4:], axis=1)[:, pairs].astype(bool)
            score = np.where(open_, q @ x.T, np.float32(-4))
            slack = qerror[:, None] + error[None, :] * (1 + qerror[:, None]) + np.float32(1e-5)
            at, found = _best(score, slack, floor, k)
            near, off = score[at, found].astype(np.float64), slack[at, found].astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[lo + at]), pa.array(nodes[found]), pa.array(near - off), pa.array(near + off)], names=["qnode", "node", "low", "high"]
            )

    def run(batches):
        now, held = None, []
        for batch in batches:
            keys = [c.to_numpy() for c in batch.columns[:3]]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows else []
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                part, here = batch.slice(lo, hi - lo), (int(keys[0][lo]), int(keys[1][lo]))
                if here != now:
                    now, held = here, []
                if not keys[2][lo]:
                    x, error, _ = _rows(part.column(5), here[0] >> 44)
                    held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), x, error))
                elif held:
                    yield from compare(here[0], held, part)

    return rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "asks").mapInArrow(run, "qnode long, node long, low double, high double")


def _scored(pairs: DataFrame) -> DataFrame:
    """``qnode, node, score`` of rows ``qnode, node, qvec, vec``: exact cosines."""

    def run(batches):
        for batch in batches:
            score = np.zeros(batch.num_rows)
            left, right = matrices(batch.column(2)), matrices(batch.column(3))
            for n, (at, q) in left.items():
                score[at] = cosines(q, right[n][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["qnode", "node", "score"])

    return pairs.select("qnode", "node", "qvec", "vec").mapInArrow(run, "qnode long, node long, score double")


EXACT_BLOCK = 1024
"""Queries of one exact pass, about."""


def exact_best(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``qnode, node, score`` of the k best classes of each query ``row, dims, vec``, by passes over the whole index."""
    spark = index.sparkSession
    blocks = -(-queries.count() // EXACT_BLOCK)
    out = None
    for b in range(blocks):
        asked: dict[int, tuple[list, list]] = {}
        for row, dims, vec in queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect():  # about EXACT_BLOCK rows
            held = asked.setdefault(dims, ([], []))
            held[0].append(row)
            held[1].append(vec)
        shared = spark.sparkContext.broadcast({n: (r, np.array(v, dtype=np.float64)) for n, (r, v) in asked.items()})

        def run(batches, shared=shared):
            for batch in batches:
                for n, (at, x) in matrices(batch.column(2)).items():
                    if n not in shared.value:
                        continue
                    names, vecs = shared.value[n]
                    node, ids, unit = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at], units(x)
                    found = []
                    for lo in range(0, len(names), 64):
                        rough = units(vecs[lo : lo + 64]) @ unit.T
                        least = np.partition(rough, -k, axis=1)[:, -k] if len(unit) > k else np.full(len(rough), -2.0)
                        for i, row in enumerate(names[lo : lo + 64]):
                            near = np.flatnonzero(rough[i] >= least[i] - 1e-9)
                            score = cosines(vecs[lo + i], x[near])
                            top = np.lexsort((ids[near], -score))[:k]
                            found.append((np.full(len(top), row), node[near[top]], ids[near[top]], score[top]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["qnode", "node", "vec_id", "score"])

        passed = index.filter(F.col("dims").isin(*asked)).select("row", "vec_id", "vec")
        found = written(passed.mapInArrow(run, "qnode long, node long, vec_id long, score double"), "exact-found")
        best = Window.partitionBy("qnode").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("qnode", "node", "score")
        out = found if out is None else out.unionByName(found)
    return out


def nearest(
    df: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = TABLES,
    share: float = SHARE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row for which ``is_query`` holds.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = df.sparkSession
    rows = written(classes(df, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # classes of more than one row: the row that stands for all, and their smallest ids
    same = rows.groupBy("vkey").agg(F.min(F.struct("vec_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = written(same.select("vkey", F.col("first.row").alias("node")), "repeated-vectors")
    repeated = not same.isEmpty()
    small = rows.select("vec_id", "row", "vkey", "dims")
    if repeated:
        tagged = written(small.join(same, "vkey", "left").withColumn("node", F.coalesce("node", "row")), "tagged-vectors")
        index = written(rows.join(tagged.filter("node <> row").select("row"), "row", "left_anti"), "distinct-vectors")
        least = Window.partitionBy("node").orderBy("vec_id")
        shared_ids = tagged.join(same.select("node"), "node").select("node", "vec_id").distinct()
        members = written(shared_ids.withColumn("i", F.row_number().over(least)).filter(F.col("i") <= k + 1).select("node", "vec_id"), "class-members")
        available = tagged.select("dims", "vec_id", "node").distinct().groupBy("dims").count()
    else:
        tagged, index, members = small.withColumn("node", F.col("row")), rows, None
        available = rows.groupBy("dims").count()
    index = index.select("row", "vec_id", "dims", "vec")
    asked = written(tagged.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("qnode"), "dims").distinct(), "queries")
    # one row a vector length, and of these the lengths that queries have
    totals = {d: n for d, n in available.join(asked.select("dims").distinct(), "dims").collect()}
    index = index.filter(F.col("dims").isin(*totals)) if totals else index.limit(0)
    blocks = {d: Blocks(d, n) for d, n in totals.items()}
    most = max(1, SAMPLE_BYTES // (8 * max(totals, default=1)))
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    picked = index.orderBy(F.xxhash64("row"), "row").limit(most).select("row", "vec").toArrow()
    for batch in picked.to_batches():
        for n, (at, x) in matrices(batch.column(1)).items():
            old = sample.get(n, (np.zeros((0, n)), np.zeros(0, dtype=np.int64)))
            sample[n] = (np.concatenate([old[0], units(x)]), np.concatenate([old[1], batch.column(0).to_numpy()[at]]))
    salts = hot_salts(sample, blocks, totals, tables)
    codes = placed(index, blocks, tables, salts)
    wanted = asked.select(F.col("qnode").alias("row")).distinct()
    queries = written(index.join(wanted, "row", "left_semi"), "query-vectors")
    meeting = codes.unionByName(asking(queries, blocks, tables, share, sample, salts, k + 1))
    pairs = matched(meeting, k + 1).groupBy("qnode", "node").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    # of those, the ones that k + 1 others don't surely beat
    surest = Window.partitionBy("qnode").orderBy(F.desc("low"), "node")
    ranked = pairs.withColumn("sure", F.nth_value("low", k + 1).over(surest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pairs = written(ranked.filter(F.col("sure").isNull() | (F.col("high") >= F.col("sure"))).select("qnode", "node"), "candidates")
    full = pairs.join(queries.select(F.col("row").alias("qnode"), F.col("vec").alias("qvec")), "qnode")
    full = full.join(index.select(F.col("row").alias("node"), "vec"), "node")
    close = written(_scored(full), "near-classes")

    def results(close: DataFrame, asked: DataFrame) -> DataFrame:
        ids = index.select(F.col("row").alias("node"), "vec_id")
        found = close.join(ids, "node")
        if members is not None:
            found = found.join(members.withColumnRenamed("vec_id", "other"), "node", "left").withColumn("vec_id", F.coalesce("other", "vec_id"))
        ranked = Window.partitionBy("query_id", "qnode").orderBy(F.desc("score"), "vec_id")
        out = asked.select("query_id", "qnode").join(found.select("qnode", "vec_id", "score"), "qnode").filter("query_id <> vec_id")
        return out.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)

    out = written(results(close, asked), "nearest")
    got = out.groupBy("query_id", "qnode").agg(F.count(F.lit(1)).alias("got"))
    want = F.create_map(*[F.lit(x) for d, n in totals.items() for x in (d, min(k, max(n - 1, 0)))]) if totals else F.create_map(F.lit(0), F.lit(0))
    few = asked.join(got, ["query_id", "qnode"], "left").filter(F.coalesce("got", F.lit(0)) < want[F.col("dims")])
    few = written(few.select("query_id", "qnode", "dims"), "short-queries")
    if not few.isEmpty():
        unanswered = few.select(F.col("qnode").alias("row")).distinct()
        again = exact_best(queries.join(unanswered, "row", "left_semi").select("row", "dims", "vec"), index, k + 1)
        out = out.join(few.select("query_id", "qnode"), ["query_id", "qnode"], "left_anti").unionByName(results(written(again, "exact-best"), few))
    return out.select("query_id", "rank", "vec_id", "score")
