"""Catalogue tables: best row per page, upsert, publish, site registry checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order, and ``n_rows`` of the key.

    The first rows are cut down before the shuffle (limit by group), and counts are summed in part there, so
    a key that holds much of the table costs each task one row.
    """
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return first.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")), keys)


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key by an order column, as one aggregation; of equal order the greatest row."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.to_json(F.struct(*rest)))).alias("r"))
    return found.select(*keys, "r.*")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``target`` with the rows of ``batch`` in place of those of equal key; the batch's last row of a key wins.

    Columns in ``keep`` stay as they are in the target where they are set there.
    """
    new = latest_by(batch, keys, order).alias("n")
    old = target.alias("o")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    has_new = F.col("n._new").isNotNull()
    new = new.withColumn("_new", F.lit(True)).alias("n")
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        elif c in keep:
            cols.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        else:
            cols.append(F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return old.join(new, cond, "full_outer").select(*cols)


def published(records: DataFrame) -> DataFrame:
    """The approved rows: recomputed, so withdrawn approvals leave."""
    return records.filter(F.col("approval_status") == "approved")


def published_changes(final: DataFrame, changes: DataFrame, key: str = "program_id", order: str = "seq", now=None) -> DataFrame:
    """``final`` (approved rows with ``published_at`` and ``source_approval_status``) after a feed of row changes (``op`` insert,
    update or delete, ``order``, and the row): a change takes the key's published row away and, unless it deletes or the row
    isn't approved, puts the new one in its place.

    Only the last change of a key counts, as each undoes the one before; one aggregation of the feed and one anti-join. A
    status of null is pending. Changes of one key and place are taken by the greatest row."""
    now = F.current_timestamp() if now is None else now
    last = latest_by(changes, [key], order)
    kept = final.join(last.select(key), key, "left_anti")
    new = last.filter((F.lower("op") != "delete") & (F.coalesce("approval_status", F.lit("pending")) == "approved"))
    new = new.withColumns({"published_at": now, "source_approval_status": F.col("approval_status")})
    return kept.select(*final.columns).unionByName(new.select(*final.columns))


def backfill(final: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Adds approved rows that are not published yet; those that are stay untouched."""
    return final.unionByName(published(records).join(final.select(*keys), keys, "left_anti").select(*final.columns))


def replace_partition(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Stored rows without the batch's domains, and the batch."""
    return stored.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def with_parent(children: DataFrame, parents: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Children with the newest parent of equal lower-cased keys; without one they stay with a note."""
    low = lambda df: df.select("*", *[F.lower(F.trim(k)).alias(f"_{k}") for k in keys])
    newest = low(parents).withColumn("_n", F.row_number().over(Window.partitionBy(*[f"_{k}" for k in keys]).orderBy(*order))).filter("_n = 1")
    found = low(children).join(newest.select(*[f"_{k}" for k in keys], F.col("program_id").alias("parent_id")), [f"_{k}" for k in keys], "left")
    note = F.when(F.col("parent_id").isNull(), F.lit("parent not found"))
    return found.withColumn("parent_note", note).drop(*[f"_{k}" for k in keys])


def duplicates_of(rows: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the names of the columns whose lower-cased value is taken by a stored row."""
    out = rows
    for c in columns:
        taken = stored.select(F.lower(c).alias(f"_{c}")).distinct().withColumn(f"_t_{c}", F.lit(True))
        out = out.withColumn(f"_{c}", F.lower(c)).join(taken, f"_{c}", "left").drop(f"_{c}")
    names = F.array_compact(F.array(*[F.when(F.col(f"_t_{c}"), F.lit(c)) for c in columns]))
    return out.withColumn("taken", names).drop(*[f"_t_{c}" for c in columns])
