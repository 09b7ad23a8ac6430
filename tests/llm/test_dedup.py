"""Exact and near dedup against brute force."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from sluicework.llm import components, exactdedup, simhash
from sluicework.llm.common import written


def test_fingerprints_compose():
    h, rng = exactdedup.Fingerprinter(), random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5, 4095, 4096, 4097, 9000)]
    got = h.many(texts)
    for t, row in zip(texts, got.tolist(), strict=True):
        for p, b, x in zip(exactdedup.PRIMES, exactdedup.BASES, row, strict=True):
            want = 0
            for byte in t:
                want = (want * b + byte) % p
            assert x == want
    left, right = h.many([b"abc", b"defgh"])
    shift = [pow(b, 5, p) for b, p in zip(exactdedup.BASES, exactdedup.PRIMES, strict=True)]
    assert h.combine(left, right, shift).tolist() == h.many([b"abcdefgh"])[0].tolist()


def documents(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta"]) for _ in range(rng.randrange(40))) for _ in range(30)]
    rows = [(i, rng.choice(base) if i % 3 else base[0].upper()) for i in range(300)]
    rows += [(500, None), (501, ""), (502, "É"), (503, "é"), (504, "x" * 200_000), (505, "X" * 200_000), (506, "x" * 199_999 + "y"), (None, ""), (501, "")]
    return rows, spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, kept string")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def check_groups(rows, got):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    want = sorted((i or -1, max((x for x in groups[lowered(t)] if x is not None), default=None), len(groups[lowered(t)])) for i, t in rows)
    assert sorted((r.id or -1, r.keep_id, r.group_size) for r in got) == want
    assert all(r.kept == (r.id == r.keep_id) for r in got)


def test_exact_groups(spark):
    rows, df = documents(spark)
    check_groups(rows, exactdedup.exact_groups(df).collect())
    assert exactdedup.exact_groups(df.limit(0)).count() == 0


def coarse():
    """A class (local, so that workers get it by value) of fingerprints that collide: the length modulo 7 alone."""

    class Coarse:
        def many(self, texts):
            return np.array([[len(t) % 7, 1] for t in texts], dtype=np.int64).reshape(-1, 2)

    return Coarse


def test_comparison_finds_unlike_texts_of_equal_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "Fingerprinter", coarse())
    monkeypatch.setattr(exactdedup, "COMPARE_CHUNK", 4)
    long = "z" * 1000
    rows = [(1, "ab"), (2, "AB"), (3, "abc"), (4, "abd"), (5, "abc"), (6, long), (7, long[:-1] + "y"), (8, "same"), (9, "same"), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = exactdedup.fingerprints(df)
    groups = prints.groupBy(*exactdedup.KEY).agg(exactdedup.F.count("*").alias("group_size"))
    wrong = {r.n_bytes for r in exactdedup.mismatched(df, groups).collect()}
    assert wrong == {3, 1000}  # a single byte, the last one, sets those of 1000 apart
    check_groups(rows, exactdedup.exact_groups(df).collect())


def test_exact_groups_with_colliding_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "Fingerprinter", coarse())
    rows, df = documents(spark)
    check_groups(rows, exactdedup.exact_groups(df).collect())


def test_spanning_and_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = written(spark.createDataFrame(edges, "a long, b long"), "t")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    a, b = components.spanning(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert len(a) == len({n for e in edges for n in e}) - len({find(n) for e in edges for n in e})


def plain_fingerprint(text, width):
    words = lowered(text).encode().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else ([b" ".join(words)] if words else [])
    return sum(1 << k for k in range(64) if 2 * sum(xxh64_intdigest(s, 42) >> k & 1 for s in shingles) > len(shingles))


@pytest.mark.parametrize("most", [0, 3, 8])
def test_near_groups_equal_brute_force(spark, most):
    rng = random.Random(most)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    for i in range(40, 160):
        w = rows[rng.randrange(i)][1].split()
        if w:
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, " "), (202, "one"), (203, "One"), (None, "one"), (204, rows[3][1]), (205, "é é \x1c x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    fps = [plain_fingerprint(t, 3) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= most:
                root[find(x)] = find(y)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    got = sorted((r.id if r.id is not None else -1, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(df, 3, most).collect())
    assert got == sorted((i if i is not None else -1, fps[k], low.get(find(k))) for k, (i, _) in enumerate(rows))
    assert simhash.near_groups(df.limit(0), 3, most).count() == 0


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    monkeypatch.setattr(simhash, "SMALL", 4)
    test_near_groups_equal_brute_force(spark, 3)


def test_plan_covers_the_radius():
    rng = np.random.default_rng(0)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    for most in (0, 1, 3, 7, 11):
        plan = simhash.allot(bits, 100_000, most) if most else simhash.allot(bits, 1000, 1)
        cut = sorted(b for g, _ in plan for b in g)
        assert len(cut) == len(set(cut))
        if most:
            assert sum(t + 1 for _, t in plan) >= most + 1


def test_sketches_estimate_jaccard():
    rng = random.Random(3)
    words = [str(rng.random()) for _ in range(1000)]
    one, two = " ".join(words).encode(), " ".join(words[:900]).encode()
    a, b = (np.frombuffer(simhash.sketch(simhash.minima(x, 5)), np.uint8) for x in (one, two))
    assert abs(float(simhash.similarity(a, b[None, :])[0]) - 896 / 996) < 0.12
    assert float(simhash.similarity(a, a[None, :])[0]) == pytest.approx(1)
