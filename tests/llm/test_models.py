"""Toxicity and language ID: held-out accuracy, defined results for odd rows."""

import random

import numpy as np
import pytest

from sluicework.llm import langid, toxicity

WORDS = {
    "aa": ["kala", "maki", "tuli", "vesi", "puu", "ilta", "kivi"],
    "bb": ["strom", "wald", "licht", "berg", "nacht", "haus", "tief"],
    "cc": ["queso", "noche", "fuego", "arbol", "piedra", "lluvia", "cielo"],
}


def said(rng, lang, n=30):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(1, 3))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, said(rng, lang := rng.choice(list(WORDS))), lang) for i in range(300)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, "²³", None), (904, said(rng, "cc", 30_000), None), (905, "kala", None), (None, "wald haus", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    model = langid.fit(df.filter("doc_id % 2 = 0 and doc_id < 900"))
    got = {r.doc_id: r for r in langid.identify(df, model, ["doc_id"]).collect()}
    held = [r for r in rows if r[0] % 2]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.97
    for i in (900, 901, 902, 903):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[904].lang_pred == "cc" and got[905].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.identify(df, model, df.columns, accepted_only=True)
    assert kept.columns == df.columns and not {900, 901, 902, 903} & {r.doc_id for r in kept.collect()}
    assert langid.identify(df.limit(0), model, ["doc_id"]).count() == 0
    assert langid.fit(df.filter("lang = 'zz'")) is None
    assert langid.identify(df, None, ["doc_id"]).filter("lang_pred = 'und'").count() == df.count()


def toxic_rows(seed=2, n=900):
    rng = random.Random(seed)
    fillers = [a + b for a in ("ka", "mu", "ti", "ro", "se", "vo") for b in ("lan", "per", "dis", "mon", "gur")]
    rows = []
    for i in range(n):
        words = [rng.choice(fillers) + rng.choice(["", "a", "en", "is"]) for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), "grumf" + rng.choice(["a", "el", "ort", "ik"]) if i % 2 else rng.choice(["blargh!", "zonk"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    odd = [(2000, None), (2001, ""), (2002, "zonk " * 20_000 + "blargh"), (2003, "karlan muper"), (None, "tilan")]
    docs = spark.createDataFrame([(i, t, 1.0, "s") for i, t, _ in rows] + [(*r, 1.0, "s") for r in odd], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i % 3] + [(0, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [(k, got[i]) for i, _, k in rows if i % 3 == 0]
    assert np.mean([s >= 0.7 for k, s in held if k]) > 0.9
    assert np.mean([s >= 0.7 for k, s in held if not k]) < 0.02
    assert got[2002] > 0.7 and got[2000] == got[2001] == got[2003] < 0.3
    kept = toxicity.score(docs, model, docs.columns, below=0.7)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("labels", [[], [0, 0, 0], [1, 1]])
def test_toxicity_without_both_classes(labels):
    model = toxicity.train([f"text {i}" for i in range(len(labels))], labels)
    score = toxicity.Scorer(model).score("text zonk")
    assert score == pytest.approx(np.mean(labels) if labels else 0.0, abs=1e-3)


def test_label_model_learns_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = (rng.random(2000) < 0.3).astype(int)
    vote = lambda p: np.where(rng.random(2000) < p, y, 1 - y)
    poor = vote(0.6)
    votes = np.stack([vote(0.95), vote(0.9), vote(0.85), poor, poor, poor, np.full(2000, -1)], axis=1)
    model = toxicity.LabelModel(votes, 0.3)
    assert model.weights[0] > 2 * model.weights[3]
    assert np.mean((model.posterior > 0.5) == y) > 0.93


def test_long_words_in_parts():
    rng = random.Random(3)
    for size in (1, 3, 4096, 4097, 9000):
        word = "".join(rng.choice("abcdé") for _ in range(size))
        assert sorted(i for part in langid.long_subwords(word) for i in part) == sorted(langid.subwords(word))


def test_scores_equal_plain_sums():
    rng = random.Random(6)
    langs = [rng.choice(list(WORDS)) for _ in range(120)]
    model = langid.train([said(rng, lang) for lang in langs], langs)
    texts = [said(rng, "aa"), "kala strom noche " * 50, "x" * 9000, said(rng, "bb") + " " + "wald" * 3000, "Kala kala KALA"]
    for text in texts + texts:  # again, from the cache
        ids = [i for w in text.lower().split() for i in langid.subwords(w)]
        p = model.probabilities(model.logits[ids].astype(float).mean(axis=0))
        name, score, _ = langid.Scorer(model).score(text)
        assert name == model.names[int(np.argmax(p))] and score == pytest.approx(float(p.max()), abs=1e-4)


def test_toxicity_scores_equal_plain_sums():
    rows = toxic_rows()
    model = toxicity.train([t for _, t, _ in rows], [k for _, _, k in rows])
    scorer = toxicity.Scorer(model)
    for _, text, _ in rows[:100] + [rows[3]]:
        terms = [t for w in {x for c in set(text.lower().split()) for x in toxicity._WORD.findall(c)} for t in toxicity.terms_of(w)]
        z = model.bias + sum(model.weights.get(t, 0.0) for t in toxicity.counted(terms))
        assert scorer.score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_samples_are_bounded_in_characters(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, said(rng, lang := rng.choice(list(WORDS))), lang) for i in range(600)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")  # repeated rows
    got = {}
    for module in (langid, toxicity):
        monkeypatch.setattr(module, "LEARN_CHARS", 30_000)
        monkeypatch.setattr(module, "train", lambda texts, marks, module=module: got.setdefault(module, sum(map(len, texts))))
    langid.fit(df)
    toxicity.fit(df, spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int"))
    assert all(5_000 < n < 60_000 for n in got.values())
