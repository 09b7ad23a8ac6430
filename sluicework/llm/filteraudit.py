"""Filter interaction audit by lattice-edge aggregation.

Filters that run one after another hide each other's work: what a filter removes depends on what ran before it. With m
filters, the sets already applied form a lattice, and an edge (applied set, next filter) knows all a step can know: who is
left, who fails. Documents are first counted by their class (part, filters failed, labels); every class then adds itself to
the m * 2^(m-1) edges (80 for five filters), and an order of all filters is a path of m edges, so the steps of all m!
orders (600 for five) are joined from aggregated edges and no order is ever run.

A document's class needs nothing but its own row, save for copies: those are found by the digest of the whole text, with
copies of one task counted together before the shuffle, so a text of any number of copies sends a row a task.

Cases: null text is empty, and empty texts are copies of each other; a null part is the empty string; rows that repeat an
id are documents each, and of equal texts all rows of the smallest id stay; a row without id is larger than all ids, and
several of them don't make each other copies; several labels of one id count if any is 1; an id without labels has none;
texts of any length are read whole; other columns, clashing names included, are left out; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text alone: too short, repetitive, shouting, symbols."""
    words = F.array_remove(F.split(text, SPACES), "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * distinct.cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def classes(docs: DataFrame, labels: DataFrame, filters=text_filters, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, failed, good, toxic, n``: documents counted by what they fail (bit k: the k-th of ``filters``; the bit after
    the last: an equal text of a smaller id) and by their labels."""
    source = docs.select(
        docs[id_col].cast("long").alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )
    conditions = list(filters(F.col("text")).values())
    failed = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))
    rows = source.select("id", "part", failed.alias("failed"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    one = lambda c: F.max(F.coalesce(labels[c] == 1, F.lit(False)))
    marks = labels.groupBy(labels[id_col].cast("long").alias("mark")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = rows.join(marks, F.col("id") == F.col("mark"), "left").select("id", "part", "failed", "sha", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    kind = ["sha", "part", "failed", "good", "toxic"]
    by_id = rows.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("id").isNull().alias("none"), "id")
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct(place.alias("place"), F.col("n").alias("n"))).alias("low"))
    # rows of one text differ in part and labels at most, so its window is small however many copies it has
    first = F.col("low.place") == F.min("low.place").over(Window.partitionBy("sha"))
    counted = by_text.withColumn("firsts", F.when(first, F.col("low.n")).otherwise(0))
    copies = F.struct((F.col("failed") + (1 << len(conditions))).alias("failed"), (F.col("n") - F.col("firsts")).alias("n"))
    split = counted.select("part", "good", "toxic", F.inline(F.array(F.struct("failed", F.col("firsts").alias("n")), copies)))
    return split.filter("n > 0").groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges(found: DataFrame, filters: int) -> DataFrame:
    """``part, applied, bit`` and the counts of every edge, zeros included."""
    edges = [(s, k) for k in range(filters) for s in range(1 << filters) if not s >> k & 1]
    orders = {(s, k): factorial(s.bit_count()) * factorial(filters - 1 - s.bit_count()) for s, k in edges}
    listed = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(k).alias("bit"), F.lit(orders[s, k]).cast("long").alias("orders")) for s, k in edges])
    rows = found.select("*", F.inline(listed))
    fails = F.col("failed").bitwiseAND(F.expr("shiftleft(1, bit)")) != 0
    left = F.col("failed").bitwiseAND(F.col("applied")) == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    out = rows.groupBy("part", "applied", "bit", "orders").agg(
        count(left & ~fails).alias("kept"),
        count(left & fails).alias("removed"),
        count(~left & fails).alias("redundant"),
        count(F.col("failed") == F.expr("shiftleft(1, bit)")).alias("unique_fails"),
        count(left & fails & F.col("good")).alias("good_lost"),
        count(left & fails & F.col("toxic")).alias("toxic_lost"),
    )
    shapley = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "bit"))
    return out.select("*", shapley.alias("shapley")).drop("orders")


def paths(edges: DataFrame, letters: str) -> DataFrame:
    """``part, filter_order, step`` and the counts of the edge that each step of each order takes."""
    steps = []
    for order in permutations(range(len(letters))):
        applied = 0
        for n, k in enumerate(order):
            steps.append(("".join(letters[x] for x in order), n + 1, applied, k))
            applied |= 1 << k
    table = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, bit int")
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return edges.join(F.broadcast(table), ["applied", "bit"]).select("part", "filter_order", "step", *counts)


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The audit of the five filters, per part, order and step."""
    return paths(lattice_edges(classes(docs, labels, **columns), 5), "ABCDE")
