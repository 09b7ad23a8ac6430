"""Corpus pipeline: toxicity, language ID, exact dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and reread
as the next stage's docs. All but the last return the columns of ``documents``.

Cases, for every stage: a null text is an empty one; a null id is an id of its own for each text; an id that occurs
with several texts counts as several documents, and what is decided on one of them leaves the others; rows that repeat
wholly fare alike; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import exactdedup, langid, toxicity
from sluicework.llm.common import written
from sluicework.llm.packing import pack
from sluicework.llm.simhash import near_copies

TOXIC_FROM = 0.7
"""Documents of this score and more go."""
NEAR_BITS, NEAR_SIMILARITY = 11, 0.8
"""Near copies have this Jaccard similarity of their whole sets of 5-word shingles; candidates differ in at most so many
fingerprint bits (3-word shingles) or share a band of their sketches."""


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; without labelled rows of both classes it rejects none or all of a
    corpus whose labels are all toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~langid.held_out("doc_id"))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, docs.columns, below=TOXIC_FROM)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model accepts; with no labelled row there is no model, and all stay."""
    model = langid.fit(docs.filter(~langid.held_out("doc_id")))
    if model is None:
        return docs
    return langid.identify(docs, model, docs.columns, accepted_only=True)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the greatest id, a row without id only if none has one.

    An id that occurs with several texts counts as several documents."""
    groups = written(exactdedup.exact_groups(docs), "exact-groups")
    rest = exactdedup.rows_without(docs, written(groups.filter(~F.col("kept")).select("id", "text_sha256").distinct(), "exact-copies"))
    repeated = groups.filter("kept").groupBy("id", "text_sha256").count().filter("count > 1")
    if repeated.isEmpty():
        return rest
    return rest.withColumn("text_sha256", exactdedup.text_sha256(F.col("text"))).dropDuplicates(["doc_id", "text_sha256"]).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by id and text as above; rows that repeat both stay."""
    return exactdedup.rows_without(docs, written(near_copies(docs, 3, NEAR_BITS, NEAR_SIMILARITY, 5), "near-copies"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed into sequences of 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", simhash_stage),
    ("packing", packing_stage),
]

#: SQL can't express training, tokenising and packing; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
