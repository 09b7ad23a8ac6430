"""Each registered query over the smallest tables: against its SQL, a library, or brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from sluicework.llm import ann, queries

SF = "/root/testdata/sf0.001"


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df()


def run(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def texts():
    d = table("documents")
    return {int(i): "" if t is None else t for i, t in zip(d.doc_id, d.text, strict=True)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = run(spark, name), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_op4_and_op7_equal_the_library(spark, texts):
    word, byte = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for r in run(spark, "op4_bpe").itertuples():
        ids = word.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = word.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    for r in run(spark, "op7_token_counts").itertuples():
        n = len(byte.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)


def test_op2_packs_all(spark, texts):
    library, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), run(spark, "op2_packing")
    want = {}
    for i, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want |= {(i, k): (a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq.length.cumsum() - seq.length == seq.offset).all() and seq.length.sum() <= 4096
    assert got.sequence_id.nunique() <= 1.02 * np.ceil(got.length.sum() / 4096) + 1


def test_op3_against_all_pairs(spark):
    d = table("embeddings")
    vecs = {int(i): np.array(v, dtype=np.float64) for i, v in zip(d.vec_id, d.embedding, strict=True) if v is not None and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)}
    ids, x = np.array(list(vecs)), np.array(list(vecs.values()))
    got, hit, wanted = run(spark, "op3_ann"), 0, 0
    for q in ids[ids % 50 == 0].tolist():
        score = ann.cosines(vecs[q], x)
        order = [int(k) for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(order) + 1))
        assert all(s == float(ann.cosines(vecs[q], vecs[v][None, :])[0]) for s, v in zip(mine.score, mine.vec_id, strict=True))
        hit += len(set(mine.vec_id) & set(ids[order].tolist()))
        wanted += len(order)
    assert hit >= 0.9 * wanted


def test_op10_against_all_pairs(spark, texts):
    prints = {}
    for i, t in texts.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        h = [xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and find(a) != find(b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op10_simhash").itertuples()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def test_op1_and_op9_on_held_out_rows(spark, texts):
    marks = table("labels").dropna(subset=["toxic"]).set_index("doc_id").toxic
    scored = run(spark, "op1_toxicity")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert sorted(scored.doc_id) == sorted(texts) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored.itertuples())
    mine = scored[scored.held_out & scored.doc_id.isin(marks.index)]
    assert (mine.predicted.to_numpy() == marks[mine.doc_id].to_numpy()).mean() > 0.85
    langs = table("documents").set_index("doc_id").lang
    found = run(spark, "op9_language_id")
    assert sorted(found.doc_id) == sorted(texts) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in found.itertuples())
    assert set(found.lang_pred) <= set(langs.dropna()) | {"und"}
    mine = found[found.held_out & langs[found.doc_id].notna().to_numpy() & (found.lang_pred != "und")]
    assert (mine.lang_pred.to_numpy() == langs[mine.doc_id].to_numpy()).mean() > 0.9
