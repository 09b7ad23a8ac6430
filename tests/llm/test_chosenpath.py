"""Chosen-path join: against all pairs of whole sets."""

import random

import numpy as np
import pytest

from sluicework.llm import chosenpath

COLUMNS = "doc_id long, text string, id string, n string, key string"


def brute(rows, width=5, percent=85):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k)) if sets[k] else i, i == (low.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows)), key=repr)


def joined(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], COLUMNS).repartition(3)
    return sorted((tuple(r) for r in chosenpath.similar_groups(df).collect()), key=repr)


@pytest.mark.parametrize("leaf", [256, 6])
def test_equals_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(chosenpath, "LEAF", leaf)
    rng = random.Random(3)
    word = lambda: str(rng.randrange(10**9))
    passage, rows = [word() for _ in range(40)], []
    for g in range(25):
        base = [word() for _ in range(rng.randrange(30, 260))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(60 if g == 0 else 4):
            words = list(base)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + k, " ".join(passage + [word() for _ in range(4 * (k % 6))])) for k in range(50)]  # a shared passage
    chain = [word() for _ in range(100)]
    rows += [(2000 + k, " ".join(chain[3 * k :] + [word() for _ in range(3 * k)])) for k in range(12)]
    rows += [(3000, None), (3001, ""), (3002, " \t "), (3003, "one two"), (3004, "One  TWO"), (3005, "ONE"), (None, "one"), (None, "alone here"), (3003, "one two"), (7, rows[9][1])]
    rng.shuffle(rows)
    assert joined(spark, rows) == brute(rows)


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], COLUMNS)
    found = chosenpath.similar_groups(empty)
    assert found.columns == ["id", "n_shingles", "component_id", "kept"] and found.count() == 0
    long = " ".join(map(str, range(150_000)))
    assert joined(spark, [(4, long), (2, long + " end")]) == [(2, 149_997, 2, True), (4, 149_996, 2, False)]


def test_tokens_estimate_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    same = [(chosenpath.minwise(np.unique(h[: 1000 + k])) == chosenpath.minwise(np.unique(h[k : 1000 + k]))).mean() for k in (0, 100, 300, 1000)]
    assert np.allclose(same, [1000 / (1000 + k) for k in (0, 100, 300, 1000)], atol=0.13)
    assert 8 <= chosenpath.trees_for(0.85) <= 20
    assert chosenpath.trees_for(0.85, 0.9) < chosenpath.trees_for(0.85)
