"""Phrase mining: against plain counts."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import pytest

from sluicework.llm import phrases

COLUMNS = "doc_id long, text string, lang string, phrase string, words string"


def brute(rows, support, longest, most):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    good = {p: c for p, c in counts.items() if c >= support and len(p[1]) > 1}
    out = {}
    for (lang, p), a in good.items():
        if any(l2 == lang and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (l2, q), c in good.items()):
            continue
        cuts = [(floor(Fraction(1000 * a * total[lang], counts[lang, p[:k]] * counts[lang, p[k:]])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted(
        (lang, n + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for n, (s, a, p, left, right) in enumerate(sorted(found)[:most])
    )


@pytest.mark.parametrize("group", [1 << 16, 8])
def test_equals_plain_counts(spark, monkeypatch, group):
    monkeypatch.setattr(phrases, "GROUP", group)
    rng, rows = random.Random(4), []
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "ÉA", "İ", "\x00", "#", "日本"]
    for n in range(120):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else "Hello New World" for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "\x0b"]) for w in words)
        rows.append((text, [None, "en", "fr", "und"][n % 4]))
    rows += [("same same same same same same", "en")] * 6 + [(None, "en"), ("", None), (" . ", "fr"), ("a b " * 40_000, "de")]
    df = spark.createDataFrame([(n, *r, "x", "y") for n, r in enumerate(rows)], COLUMNS).repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, support=5, most=60).collect())
    assert got == brute(rows, 5, 5, 60)


def test_counts_add_up_over_shards(spark):
    rows = [("ab cd ef", "en")] * 7 + [("ab cd", "en")]
    df = spark.createDataFrame([(n, *r, "x", "y") for n, r in enumerate(rows)], COLUMNS).repartition(8)
    got = sorted(tuple(r) for r in phrases.collocations(df, support=7).collect())
    assert got == brute(rows, 7, 5, 2000) and [r[2] for r in got] == ["ab cd", "ab cd ef"]


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], COLUMNS)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "a b", "en", "", "")], COLUMNS)).collect() == []
