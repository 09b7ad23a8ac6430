"""Filter audit: against every order run step by step."""

import random
import re
from itertools import permutations

from sluicework.llm import filteraudit

DOCS = "doc_id long, text string, lang string, n long, good string, failed string"


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        low = least.get(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": low is not None and (i is None or i > low)}
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for n, f in enumerate(order):
                before = set(order[:n])
                mine = [d for d in docs if d[0] == part]
                left = [d for d in mine if not d[1] & before]
                here = [d for d in left if f in d[1]]
                out[part, "".join(order), n + 1] = [
                    len(left) - len(here), len(here), sum(f in d[1] for d in mine) - len(here), sum(d[1] == {f} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here)
                ]
    shapley = {}
    for (part, order, n), v in out.items():
        shapley[part, order[n - 1]] = shapley.get((part, order[n - 1]), 0) + v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_equals_every_order(spark):
    rng, rows = random.Random(8), []
    for i in range(150):
        words = [rng.choice(["#", "A&B", "x"]) if rng.random() < 0.01 else rng.choice("ABC").join(["", ""]) + str(rng.randrange(400)) for _ in range(rng.choice([0, 5, 99, 100, 101, 130, 600]))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), rng.choice(["en", "fr", None, ""])))
    rows += [(rng.randrange(150, 170), rows[k % 7][1], rng.choice(["en", "fr"])) for k in range(60)]
    rows += [(None, rows[0][1], "en"), (None, "own", "en"), (None, "own", "en"), (3, rows[3][1], "en"), (400, None, "de"), (401, "", "de"), (402, "É" * 50 + "A" * 5, "de"), (500, "a b " * 100_000, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 180, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS).repartition(3)
    marks = spark.createDataFrame([(*r, "en") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filteraudit.filter_audit(docs, marks).collect()}
    assert got == brute(rows, labels)


def test_no_documents_and_no_labels(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.filter_audit(spark.createDataFrame([], DOCS), marks).count() == 0
    one = spark.createDataFrame([(1, "word", "en", 1, "", "")], DOCS)
    found = filteraudit.filter_audit(one, marks).collect()
    assert len(found) == 600 and sum(r.removed for r in found) == 120 and all(r.shapley == (120 if r.filter_order[r.step - 1] == "A" else 0) for r in found)
