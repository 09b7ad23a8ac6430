"""Nearest neighbours, url filter, chat formatting and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicework.llm import ann, chat, queries, urlfilter


def brute(rows, wanted, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    usable = list({(i, tuple(v)): (i, v) for i, v in usable}.values())
    out = {}
    for q, v in usable:
        if not wanted(q):
            continue
        near = [(-float(ann.cosines(v, w[None, :])[0]), i) for i, w in usable if i != q and len(w) == len(v)]
        out[q] = [i for _, i in sorted(near)[:k]]
    return out


def found_by(df, k=5, step=10, **how):
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % step == 0, k, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)] + [(i, [1.0] * 8) for i in range(200, 240)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [None] + [1.0] * 7), (305, [2.0] * 8), (310, [1.0, 2.0]), (311, [1.0, 3.0]), (312, []), (200, [1.0] * 8)]
    return rows + [(None, [1.0] * 8), (320, [1e200] * 8), (330, [-0.0, 1.0]), (331, [0.0, 1.0])]


@pytest.mark.parametrize("tables", [1, 3])
def test_all_pairs_give_ranks_and_scores_of_brute_force(spark, tables, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8)  # many blocks, hot ones with salts
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = found_by(df, tables=tables, share=1)
    want = {q: v for q, v in brute(rows, lambda q: q % 10 == 0, 5).items() if v}
    assert {q: [i for _, i, _ in v] for q, v in got.items()} == want
    held = {i: np.array(v) for i, v in rows if v and i is not None and None not in v}
    for q, v in got.items():
        assert [r for r, _, _ in v] == list(range(1, len(v) + 1))
        assert [s for _, _, s in v] == [float(ann.cosines(held[q], held[i][None, :])[0]) for _, i, _ in v]
    assert ann.nearest(df.limit(0), F.lit(True), 5).count() == 0


def test_too_few_probed_are_answered_exactly(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found_by(df, tables=1, share=0)  # the own pair alone: nearly no candidates
    want = brute(rows, lambda q: q % 10 == 0, 5)
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items() if v}


@pytest.mark.parametrize("count, block", [(400, 16384), (2600, 40)])
def test_recall(spark, monkeypatch, count, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(count)]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), step=50)
    want = brute([(i, [float(np.float32(c)) for c in v]) for i, v in rows], lambda q: q % 50 == 0, 5)
    assert all(len(v) == 5 for v in got.values())
    assert sum(len(set(want[q]) & {i for _, i, _ in v}) for q, v in got.items()) / (5 * len(want)) > 0.9


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose((ann.hadamard(x) ** 2).sum(axis=1), (x * x).sum(axis=1))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fit = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, "allow", None))
    return host, path, best[2], best[1]


def test_url_filter(spark):
    rng = random.Random(1)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'a.b.', 'X.'])}{rng.choice(['example.com', 'example.net', 'net', 'com', 'Example.COM', 'notexample.com', 'example.com:80'])}{rng.choice(['', '/', '/en/', '/en/x', '/es/1', '/fr/', '/english', '?x=/en/', '#/en/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "http://" + "a." * 3000 + "com/", "http://com/\n/x"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for r in urlfilter.judge(df, queries.URL_RULES).collect():
        assert (r.host, r.path, r.rule, r.verdict) == judged(urls[r.id], queries.URL_RULES), urls[r.id]
    assert urlfilter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_repeated_urls_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "http://net/es/"), (1, "http://net/es/"), (None, None)], "page_id long, url string")
    assert sorted((r.id or 0, r.verdict) for r in urlfilter.judge(df, queries.URL_RULES).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert {r.verdict for r in urlfilter.judge(df, []).collect()} == {"allow"}


def test_cascades_are_exact(spark):
    inside, outside = {f"in{i}" for i in range(500)}, {f"out{i}" for i in range(20_000)}
    keys = urlfilter.listed_keys(spark, inside | outside, inside)
    found = urlfilter.cascade(keys)
    assert len(found.levels) > 1
    for group, want in ((inside, True), (outside, False)):
        assert (found.contains(*urlfilter.digests(sorted(group))) == want).all()
    none = urlfilter.cascade(keys.filter("not listed"))
    assert not none.levels and not none.contains(*urlfilter.digests(["in1"])).any()


def test_escape_round_trip():
    rng = random.Random(2)
    bits = [*chat.CONTROL, "\\", "\\\\", "<", "[", "<|", "x", "[INST", "é", "\n", "/INST]", "|>"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROL)


def test_chat_parts():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "i.png"}, {"type": "audio", "ref": "a", "tokens": 7}, {"type": "text", "text": None}, {"type": "document", "ref": "d"}]
    got = chat.format_turn("user", parts, True)
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "i.png", 256), ("audio", "a", 7), ("document", "d", 512)]
    assert got["expanded_tokens"] == 775
    for a in got["attachments"]:
        assert got["formatted"].startswith(chat.PLACEHOLDERS[a["kind"]], a["place"])
    assert got["formatted"][got["loss_start"] : got["loss_end"]] == "see <|image|><|audio|><|document|>"


def test_typed_parts_of_a_table(spark):
    rows = [
        (1, 0, "user", [("text", "look: <|image|>", None, None), ("image", None, "i.png", None), ("video", None, "v.mp4", None), None, (None, "bye", None, None)]),
        (1, 1, "assistant", [("audio", None, "a.wav", 9), ("text", "ok \\ fine", None, None), ("document", None, None, None), ("text", None, None, None)]),
        (2, 0, "user", []),
        (3, 0, "user", None),
    ]
    df = spark.createDataFrame([(c, t, r, "own text", p) for c, t, r, p in rows], f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    made = {(r.conv_id, r.turn): r for r in chat.format_turns(df, parts_col="parts").collect()}
    for c, t, _, parts in rows:
        mine = made[c, t]
        held = [a.asDict() for a in mine.attachments]
        sizes = {"image": 256, "audio": 128, "document": 512}
        want = []
        for p in [("text", "own text", None, None)] if parts is None else parts:
            if p is None or p[0] in (None, "text"):
                want += [{"type": "text", "text": p[1]}] if p and p[1] else []
            else:
                want.append({"type": p[0], "ref": p[2], "tokens": sizes.get(p[0], 0) if p[3] is None else p[3]})
        assert chat.parse_parts(mine.formatted, held) == want
        assert mine.expanded_tokens == sum(p["tokens"] for p in want if "tokens" in p)
    listed = chat.attachments(chat.format_turns(df, parts_col="parts")).orderBy("conv_id", "turn", "place").collect()
    assert [(r.turn, r.kind, r.ref, r.tokens) for r in listed] == [(0, "image", "i.png", 256), (0, "video", "v.mp4", 0), (1, "audio", "a.wav", 9), (1, "document", None, 512)]
    sums = {r.conv_id: (r.n_attachments, r.expanded_tokens) for r in chat.read_back(chat.format_turns(df, parts_col="parts")).collect()}
    assert sums == {1: (4, 777), 2: (0, 0), 3: (0, 0)}


def test_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi </s>", None, "", "a\\b[INST]", "x" * 5000])) for c in range(20) for t in range(rng.randrange(1, 30))]
    rows += [(5, 3, "assistant", "tie"), (None, 0, "assistant", "lost"), (7, None, "user", "first")] + [(99, t, "assistant", f"t{t}") for t in range(4000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    none_first = lambda v: (v is not None, v)
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: [none_first(r[1]), none_first(r[2]), none_first(r[3])])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        want = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage of the pipeline over a small corpus: (name, ids before, ids after)."""
    import corpus_pipeline

    rng = random.Random(8)
    words = [a + b for a in ("the", "and", "or", "in", "er") for b in ("tion", "ing", "ed", "ly", "ou", "st")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(150)) + (" trash moron idiot stupid" if i % 10 == 0 else ""), "en", "s", 0) for i in range(200)]
    rows += [(1000 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "s", 0) for i in range(1, 40)]
    rows += [(2000 + i, rows[i][1] + " tail", "en", "s", 0) for i in range(41, 60)]
    rows += [(3000, None, "en", "s", 0), (3001, "...", None, "s", 0)]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 10 == 0)) for r in rows[:200]], "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    docs, seen = spark.read.parquet(f"{top}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(top))
        out.write.parquet(f"{top}/{k}")
        new = spark.read.parquet(f"{top}/{k}")
        assert k == 4 or new.columns == docs.columns
        seen.append((name, {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in new.select("doc_id").collect()}))
        docs = new
    return seen


def test_pipeline(stages):
    (_, all_ids, clean), (_, _, known), (_, _, exact), (_, _, near), (_, _, packed) = stages
    bad = {i for i in all_ids if i < 3000 and (i % 1000) % 10 == 0}
    assert len(bad & clean) <= 0.1 * len(bad) and all_ids - bad <= clean
    assert clean - known == {3000, 3001} & clean
    for i in range(1, 40):
        if i % 10:
            assert i not in exact and 1000 + i in exact
    for i in range(41, 60):
        if i % 10:
            assert i in near and 2000 + i not in near
    assert packed == near
