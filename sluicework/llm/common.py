"""Helpers that the training-data operators share: shared-folder tables and Arrow row access."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    ``spark.checkpoint.dir`` of the session is used where it is set, else a folder in the warehouse.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._sluice_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table behind a frame that ``written`` gave, once nothing reads it any more."""
    path = getattr(df, "_sluice_path", None)
    if path:
        _delete(df.sparkSession, path)
        _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return


LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def map_size(count: int) -> int:
    """Positions of a bit map for so many keys: 16 for each, from 128 KB up to 32 MB whatever the count. A fuller map lets
    more keys pass that aren't in it, never fewer that are."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))


def bit_map(places: DataFrame, size: int) -> np.ndarray:
    """Bits of the positions in column ``at``, built on the executors; at most size / 32768 rows of 4 KB reach the driver."""
    maps = places.groupBy(F.expr("at div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("at % 32768")).alias("bits")).collect()
    out = np.zeros(size // 8, dtype=np.uint8)
    for part, bits in maps:
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(bytes(bits), dtype=np.uint8)
    return out


def in_map(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether positions are set."""
    return (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def digest_place(sha256, size: int):
    """Position of a hexadecimal digest, as a column."""
    return F.conv(F.substring(sha256, 1, 8), 16, 10).cast("long") % size


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """The rows of a batch as tuples, turned into Python objects ``step`` rows at a time."""
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def doc_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: whatever else the table holds, clashing names included, is left out."""
    return df.select(*[df[n] for n in names])


_LAST: dict[str, object] = {}


def reused(key: str, make):
    """What ``make`` gives, kept in a Python worker for later tasks that ask for the same key; one at a time."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = make()
    return _LAST[key]
