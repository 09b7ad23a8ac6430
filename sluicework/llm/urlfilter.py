"""URL rules looked up in a Bloom filter cascade.

A rule names a host and the beginning of a path; it fits its host and all subdomains. Every url has a few
candidate keys: its host's endings with as many labels as some rule has, each with the beginning of the
path that is as long as some rule's. The candidate keys of all urls are the corpus's key universe.

Level 0 of the cascade encodes the listed keys. Level 1 encodes those keys of the universe that are not
listed but pass level 0, level 2 the listed keys that pass level 1, and so on until a level lets no wrong
key pass. Over that universe membership is then exact, and urls are judged without a join: the longest
candidate key that is listed is the rule. A second cascade, over the rules themselves, tells block from
allow. A url that no rule fits gets the verdict of a key that is not listed: allow.

Keys, listed ones and those of the universe, are a table of digests; every level is built on the executors from it
as bit maps of 4 KB. Only the levels travel: some ten bits for each listed key (ten million rules: 12 MB) and for each
key that passes wrongly, which the first level's size keeps at about as many; nothing grows with the urls.

Cases: null urls and those without ``://`` have empty host and path and no rule; rows repeat as they are;
of rules of the same length the one with the longer host wins; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digests(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a 128-bit digest of each key."""
    from xxhash import xxh3_128_digest

    data = bytearray().join(xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys)
    halves = np.frombuffer(data, dtype="<i8").reshape(-1, 2) if keys else np.zeros((0, 2), dtype=np.int64)
    return halves[:, 0].copy(), halves[:, 1].copy()


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit numbers, another one for each salt."""
    x = h.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bloom:
    """A Bloom filter sized for a count of keys and a rate of false positives; levels hash unlike one another."""

    def __init__(self, count: int, rate: float, level: int) -> None:
        self.size = max(64, int(np.ceil(-max(count, 1) * np.log(rate) / np.log(2) ** 2)))
        self.hashes = min(30, max(1, round(self.size / max(count, 1) * np.log(2))))
        self.level = level
        self.bits = np.zeros(-(-self.size // MAP) * MAP // 8, dtype=np.uint8)

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """(keys, hashes) positions."""
        a, b = _mixed(high, 2 * self.level), _mixed(low, 2 * self.level + 1) | np.uint64(1)
        return ((a[:, None] + np.arange(self.hashes, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(self.size)).astype(np.int64)

    def has(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        at = self.places(high, low)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool).all(axis=1)


MAP = 32768
"""Bits of one bit map."""
DEEPEST = 60
"""Levels after which building gives up; each lets a hundredth of the wrong keys pass, so a handful is enough."""


class Cascade:
    """Levels of Bloom filters; exact over the keys it was built from."""

    def __init__(self) -> None:
        self.levels: list[Bloom] = []

    def passes(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether each key is in all levels."""
        out = np.ones(len(high), dtype=bool)
        for level in self.levels:
            at = np.flatnonzero(out)
            out[at] = level.has(high[at], low[at])
        return out

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether each key is listed: those that stop at an even level are not, those at an odd one are."""
        out = np.full(len(high), len(self.levels) % 2 == 1)
        left = np.arange(len(high))
        for i, level in enumerate(self.levels):
            held = level.has(high[left], low[left])
            out[left[~held]] = i % 2 == 1
            left = left[held]
        return out


def cascade(keys: DataFrame) -> Cascade:
    """A cascade over a table of distinct digests ``high, low, listed``, which stays on the executors.

    The first level's rate is chosen so that about as many keys pass wrongly as are listed.
    """
    spark = keys.sparkSession
    out = Cascade()
    counts = {bool(x): n for x, n in keys.groupBy("listed").count().collect()}
    waiting = {True: counts.get(True, 0), False: counts.get(False, 0)}
    while count := waiting[turn := len(out.levels) % 2 == 0]:
        level = len(out.levels)
        if level > DEEPEST:
            raise RuntimeError("the cascade doesn't end: digests of a listed and another key are equal")
        rate = 0.01 if level else float(np.clip(count / max(waiting[False], 1), 1e-6, 0.05))
        bloom = Bloom(count, rate, level)
        before = spark.sparkContext.broadcast(out)

        def places(batches, before=before, bloom=bloom):
            for batch in batches:
                high, low = (batch.column(k).to_numpy() for k in (0, 1))
                on = before.value.passes(high, low)
                at = np.unique(bloom.places(high[on], low[on]))
                yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

        set_bits = keys.filter(F.col("listed") == turn).select("high", "low").mapInArrow(places, "at long")
        maps = set_bits.groupBy(F.expr(f"at div {MAP}").alias("part")).agg(F.bitmap_construct_agg(F.expr(f"at % {MAP}")).alias("bits"))
        for part, bits in maps.collect():
            bloom.bits[part * MAP // 8 : (part + 1) * MAP // 8] = np.frombuffer(bytes(bits), dtype=np.uint8)
        out.levels.append(bloom)
        after = spark.sparkContext.broadcast(out)

        def passing(batches, after=after):
            for batch in batches:
                n = int(after.value.passes(batch.column(0).to_numpy(), batch.column(1).to_numpy()).sum())
                yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

        rest = keys.filter(F.col("listed") != turn).select("high", "low").mapInArrow(passing, "n long")
        waiting[not turn] = rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return out


def host_and_path(url):
    """Host and path columns of a url column."""
    whole = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, whole, 1), AZ, az), F.regexp_extract(text, whole, 2)


def candidates(host: str, path: str, shapes: list[tuple[int, int]]) -> list[str]:
    """Candidate keys of a url, longest first; ``shapes`` are the (labels, path length) of the rules."""
    labels = host.split(".")
    found = []
    for many, size in shapes:
        if many <= len(labels) and size <= len(path):
            ending = ".".join(labels[len(labels) - many :])
            found.append((len(ending) + size, len(ending), ending + path[:size]))
    return [k for _, _, k in sorted(found, reverse=True)]


def listed_keys(spark, keys: set[str], marked: set[str]) -> DataFrame:
    """Digests of rule keys, with whether each is marked."""
    names = sorted(keys)
    high, low = digests(names)
    rows = [(int(a), int(b), k in marked) for k, a, b in zip(names, high, low, strict=True)]
    return spark.createDataFrame(rows, "high long, low long, listed boolean")


def judge(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict`` of every row; rules are (verdict, host, path)."""
    spark = df.sparkSession
    shapes = sorted({(host.count(".") + 1, len(path)) for _, host, path in rules})
    listed = {host + path for _, host, path in rules}
    blocked = {host + path for verdict, host, path in rules if verdict == "block"}
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))

    def keys(batches):
        for batch in batches:
            found = {k for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in candidates(h, p, shapes)}
            high, low = digests(list(found))
            yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], names=["high", "low"])

    seen = urls.select("host", "path").mapInArrow(keys, "high long, low long").withColumn("listed", F.lit(False))
    # a key that is listed and in the corpus too counts as listed
    universe = seen.unionByName(listed_keys(spark, listed, listed)).groupBy("high", "low").agg(F.max("listed").alias("listed"))
    universe = written(universe, "url-keys")
    shared = spark.sparkContext.broadcast((cascade(universe), cascade(listed_keys(spark, listed, blocked))))
    dropped(universe)

    def run(batches):
        inside, block = shared.value
        for batch in batches:
            found = [candidates(h, p, shapes) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            high, low = digests([k for f in found for k in f])
            hit = np.flatnonzero(inside.contains(high, low))
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])[hit]
            rows, first = np.unique(row, return_index=True)  # the longest key that is listed
            hit = hit[first]
            bad = block.contains(high[hit], low[hit])
            start = np.cumsum([0, *(len(f) for f in found)])
            rule, verdict = [None] * len(found), ["allow"] * len(found)
            for i, at, is_bad in zip(rows.tolist(), hit.tolist(), bad.tolist(), strict=True):
                rule[i] = found[i][at - start[i]]
                verdict[i] = "block" if is_bad else "allow"
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, type=pa.string()), pa.array(verdict, type=pa.string())], names=["id", "host", "path", "rule", "verdict"]
            )

    kind = dict(urls.dtypes)["id"]
    return urls.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
