"""Dedup stages of the pipeline: whole shingle sets decide, per row of id and text."""

import random

import pytest

import corpus_pipeline
from sluicework.llm import exactdedup, simhash

COLUMNS = "doc_id long, text string, lang string"


def stage(spark, f, rows):
    return sorted(((r.doc_id, r.text) for r in f(spark, spark.createDataFrame([(*r, "n") for r in rows], COLUMNS), "").collect()), key=repr)


def test_equal_fingerprints_of_unlike_texts_stay(spark):
    rng = random.Random(2)
    line = "one line of common words"
    rows = [(i, " ".join([line] * 200 + [str(rng.random()) for _ in range(100)])) for i in range(6)]
    prints = simhash.fingerprint_many([t.encode() for _, t in rows], 3)
    assert len(set(prints.tolist())) == 1
    rows.append((9, rows[0][1] + " end"))
    assert [i for i, _ in stage(spark, corpus_pipeline.simhash_stage, rows)] == [0, 1, 2, 3, 4, 5]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("large", [64, 4])
def test_near_copies_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    rng, rows = random.Random(5), []
    for g in range(40):
        base = [str(rng.random()) for _ in range(rng.randrange(60, 300))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(25 if g < 3 else 3):
            words = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 14))):
                words[rng.randrange(len(words))] = str(rng.random())
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, " "), (902, "one"), (903, "One "), (None, "one"), (None, rows[0][1].replace("0.1", "0.10", 1))]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if near(sets[x], sets[y]):
                root[find(x)] = find(y)
    want = {}
    for k, row in enumerate(rows):
        want[find(k)] = min(want.get(find(k), row), row, key=lambda r: (r[0] is None, r[0]))
    assert len(want) > 60
    assert stage(spark, corpus_pipeline.simhash_stage, rows) == sorted(want.values(), key=repr)


def test_no_documents(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert corpus_pipeline.simhash_stage(spark, empty, "").count() == 0
    assert corpus_pipeline.exact_stage(spark, empty, "").count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "first"), (None, "second"), (None, "second"), (7, "copied text"), (9, "Copied text"), (7, "only here"), (7, "only here"), (8, "ÉA"), (3, "Éa"), (2, "éa"), (None, "éa")]
    left = [(2, "éa"), (7, "only here"), (8, "ÉA"), (9, "Copied text"), (None, "first"), (None, "second")]
    assert stage(spark, corpus_pipeline.exact_stage, rows) == left
    assert stage(spark, corpus_pipeline.simhash_stage, left) == left
    same = " ".join(str(k) for k in range(80))
    rows = [(4, same), (5, same + " end"), (5, "other"), (None, same + " End."), (None, "rest")]
    assert stage(spark, corpus_pipeline.simhash_stage, rows) == [(4, same), (5, "other"), (None, "rest")]


def test_text_digest_as_in_groups(spark):
    rows = [(1, "AbC"), (2, None), (3, "ÄÖ İ K"), (4, "\x00Z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exactdedup.fingerprints(df).join(df.select("doc_id", exactdedup.text_sha256(exactdedup.F.col("text")).alias("d")), exactdedup.F.col("id") == exactdedup.F.col("doc_id"))
    assert sum(r.d == r.text_sha256 for r in got.collect()) == 4
