"""Exact dedup by composable polynomial fingerprints, confirmed by a chunkwise comparison.

A text is a row of bytes b_0..b_(n-1). Its fingerprint modulo a prime p is sum(b_i * B^(n-1-i)) mod p.
Fingerprints compose: ``fp(x + y) = fp(x) * B^len(y) + fp(y)``, so chunks are hashed in parallel (one
matrix product per batch) and folded afterwards with length-shifted arithmetic; a text of any length is
only ever held as bytes. Texts with equal fingerprints and lengths are then compared chunk by chunk, as
a sort-based aggregation that streams over the chunks of each group; the fingerprint is never trusted
alone. Groups that fail the comparison are split by the SHA-256 of their texts.

Cases: null counts as empty text; a null id never wins against another id; rows that repeat an id count
as one document (``kept`` holds for each of them); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, digest_place, in_map, map_size, rows_of, written

CHUNK = 4096
"""Bytes hashed by one row of the matrix product: 4096 * 255 * 2^31 < 2^53, so float64 sums are exact."""
COMPARE_CHUNK = 1 << 16
"""Bytes in one row of the chunkwise comparison."""
PRIMES = (2147483629, 2147483587)
BASES = (911382323, 972663749)


def _powers(count: int, base: int, prime: int) -> list[int]:
    out = [1]
    for _ in range(count - 1):
        out.append(out[-1] * base % prime)
    return out


class Fingerprinter:
    """Polynomial fingerprints of many byte strings at once, one per prime."""

    def __init__(self) -> None:
        up = [_powers(CHUNK, b, p) for b, p in zip(BASES, PRIMES, strict=True)]
        self.weights = np.array([x[::-1] for x in up], dtype=np.float64).T.copy()
        self.shift = [pow(b, CHUNK, p) for b, p in zip(BASES, PRIMES, strict=True)]

    def chunk_hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of each row of a (chunks, CHUNK) byte matrix, per prime."""
        out = np.empty((len(data), len(PRIMES)), dtype=np.int64)
        for lo in range(0, len(data), 512):
            sums = data[lo : lo + 512].astype(np.float64) @ self.weights
            out[lo : lo + 512] = sums.astype(np.int64) % np.array(PRIMES, dtype=np.int64)
        return out

    def many(self, texts: list[bytes]) -> np.ndarray:
        """(texts, primes) fingerprints. Each text is padded with zero bytes in front, which add nothing."""
        counts = [max(1, -(-len(t) // CHUNK)) for t in texts]
        data = np.frombuffer(b"".join(t.rjust(c * CHUNK, b"\0") for t, c in zip(texts, counts, strict=True)), dtype=np.uint8)
        hashes = self.chunk_hashes(data.reshape(-1, CHUNK))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        out = hashes[starts].copy()
        counts_a = np.array(counts)
        for k in range(1, max(counts, default=1)):  # fold the k-th chunk of every text that has one
            long = np.flatnonzero(counts_a > k)
            out[long] = self.combine(out[long], hashes[starts[long] + k], self.shift)
        return out

    @staticmethod
    def combine(left: np.ndarray, right: np.ndarray, shift: list[int]) -> np.ndarray:
        """Fingerprint of a concatenation; ``shift`` is B^len(right) modulo each prime."""
        return (left * np.array(shift, dtype=np.int64) + right) % np.array(PRIMES, dtype=np.int64)


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased and nothing else changed; null gives no bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def text_sha256(text):
    """SHA-256 of the normalised text as a column; equals that of ``fingerprints``."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.length(text) == F.octet_length(text)  # only then does lower() change nothing but A-Z
    return F.sha2(F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase)).cast("binary"), 256)


def _batches(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[list[tuple]]:
    held, size = [], 0
    for ident, text in rows_of(batch, 64):
        held.append((ident, data := normalised(text)))
        size += len(data)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp0, fp1, n_bytes, text_sha256`` of every row; no shuffle."""

    def run(batches):
        hasher = Fingerprinter()
        for batch in batches:
            for held in _batches(batch):
                fps = hasher.many([t for _, t in held])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in held], type=pa.int64()),
                        pa.array(fps[:, 0], type=pa.int64()),
                        pa.array(fps[:, 1], type=pa.int64()),
                        pa.array([len(t) for _, t in held], type=pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for _, t in held], type=pa.string()),
                    ],
                    names=["id", "fp0", "fp1", "n_bytes", "text_sha256"],
                )

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, fp0 long, fp1 long, n_bytes long, text_sha256 string")


KEY = ["fp0", "fp1", "n_bytes"]


def _position(fp0, fp1, n_bytes, bits):
    return (fp0 * 1000003 + fp1 * 7919 + n_bytes) % bits


def repeated_map(groups: DataFrame) -> np.ndarray:
    """Bit map of the fingerprints that repeat."""
    repeated = groups.filter("group_size > 1")
    size = map_size(repeated.count())
    return bit_map(repeated.select(_position(F.col("fp0"), F.col("fp1"), F.col("n_bytes"), F.lit(size)).alias("at")), size)


def mismatched(df: DataFrame, groups: DataFrame, text_col: str = "text") -> DataFrame:
    """Fingerprint keys whose texts differ: chunk rows of repeated fingerprints, compared in sorted streams.

    Each task collapses equal chunks of a group before the shuffle, so a group of any size sends one row
    per chunk and task.
    """
    bits = df.sparkSession.sparkContext.broadcast(repeated_map(groups))

    def run(batches):
        hasher, seen = Fingerprinter(), bits.value
        for batch in batches:
            for held in _batches(batch):
                texts = [t for _, t in held]
                fps = hasher.many(texts)
                size = np.array([len(t) for t in texts], dtype=np.int64)
                hit = np.flatnonzero(in_map(seen, _position(fps[:, 0], fps[:, 1], size, 8 * len(seen))))
                for i in hit.tolist():
                    text = texts[i]
                    n = max(1, -(-len(text) // COMPARE_CHUNK))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(x)] * n, type=pa.int64()) for x in (fps[i, 0], fps[i, 1], len(text))]
                        + [
                            pa.array(range(n), type=pa.int32()),
                            pa.array([text[k * COMPARE_CHUNK : (k + 1) * COMPARE_CHUNK] for k in range(n)], type=pa.binary()),
                        ],
                        names=["fp0", "fp1", "n_bytes", "chunk_no", "chunk"],
                    )

    source = df.select(F.lit(None).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chunks = source.mapInArrow(run, "fp0 long, fp1 long, n_bytes long, chunk_no int, chunk binary")
    return (
        chunks.groupBy(*KEY, "chunk_no")
        .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        .filter("low <> high")
        .select(*KEY)
        .distinct()
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``."""
    prints = written(fingerprints(df, id_col, text_col), "fingerprints")
    groups = written(
        prints.groupBy(*KEY).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "fingerprint-groups"
    )
    wrong = written(mismatched(df, groups, text_col), "fingerprint-collisions")
    if wrong.isEmpty():
        joined = prints.join(groups, KEY)
    else:  # equal fingerprints, unlike texts: those keys are split by the digest of the whole text
        marked = prints.join(wrong.withColumn("clash", F.lit(True)), KEY, "left").withColumn(
            "digest", F.when(F.col("clash"), F.col("text_sha256")).otherwise("")
        )
        marked = written(marked.drop("clash"), "fingerprint-split")
        regrouped = written(
            marked.groupBy(*KEY, "digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
            "fingerprint-regrouped",
        )
        joined = marked.join(regrouped, [*KEY, "digest"])
    return joined.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def rows_without(df: DataFrame, copies: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id (null included) and text aren't among ``copies (id, text_sha256)``, a written table.

    Rows whose digest a bit map of the copies doesn't hold stay where they are; only the others are shuffled to the copies."""
    size = map_size(copies.count())
    shared = df.sparkSession.sparkContext.broadcast(bit_map(copies.select(digest_place(F.col("text_sha256"), size).alias("at")), size))

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        return pd.Series(in_map(shared.value, at.to_numpy()))

    columns = df.columns
    marked = df.select(F.struct(*columns).alias("r"), F.col(id_col).cast("long").alias("id"), text_sha256(F.col(text_col)).alias("sha"))
    marked = marked.withColumn("hit", held(digest_place(F.col("sha"), size)))
    other = copies.select(F.col("id").alias("copy_id"), "text_sha256").distinct()
    same = F.col("id").eqNullSafe(F.col("copy_id")) & (F.col("sha") == F.col("text_sha256"))
    stay = marked.filter(~F.col("hit")).unionByName(marked.filter("hit").join(other, same, "left_anti"))
    return stay.select("r.*")
