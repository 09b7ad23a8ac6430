"""BPE encoding, token counts and packing against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sluicework.llm import bpe, packing, tokencount

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
CASES = [
    "", " ", "Hello, World's end. It's 12.5 % of   all\n\nlines\t!", "Élan fraîche œuvre ß ŉ İ", "don't we'll I'd", "a" * 3000, "<|endoftext|> x <|startoftext|>y", "中文 русский ﬁ é",
    "\x1c\x85  odd space", "aaaa aaaaa aaaaaaaaaa", "  two  spaces \n x", "!!!???...", "word\n\n\n  word", "😀😀 ok",
]


def some(n=400, seed=1):
    rng = random.Random(seed)
    pool = [chr(c) for c in [*range(32, 0x250), *range(0x300, 0x310), 0x3A3, 0x2019, 0x20AC, 0x3000, 0x1F600]] + ["'s", "<|endoftext|>", " ", "  ", "\n", "the "] * 12
    return CASES + ["".join(rng.choice(pool) for _ in range(rng.randrange(50))) for _ in range(n)]


def test_encoder_equals_library():
    library = Tokenizer.from_file(WORD)
    texts = some()
    got = bpe.Encoder(open(WORD, "rb").read()).encode_many(texts)
    for text, (ids, decoded) in zip(texts, got, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_trees_agree():
    vocab = bpe.Vocabulary(open(WORD, "rb").read())
    rng = random.Random(5)
    words = ["".join(rng.choice("theinanouer") for _ in range(rng.randrange(1, 60))).encode() for _ in range(300)]
    many = bpe.merge_many(vocab, [vocab.symbols(w) for w in words])
    assert [m.tolist() for m in many] == [bpe.merge_one(vocab, vocab.symbols(w).tolist()) for w in words]


def test_counter_equals_library():
    library = Tokenizer.from_file(BYTE)
    texts = some()
    got = tokencount.Counter(open(BYTE, "rb").read()).count_many(texts)
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_library_ids():
    library = Tokenizer.from_file(WORD)
    texts = some()
    got = packing.LibraryIds(open(WORD, "rb").read()).many(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def table(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, "null id", "x"), (100, None, "x"), (0, CASES[0], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_encode_tables(spark):
    df = table(spark)
    got = {r.id: r for r in bpe.encode(df, WORD).collect()}
    dig = {r.id: r for r in bpe.encode_digests(df, WORD).collect()}
    assert got[100].ids == [] and dig[100].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert dig[2].n_tokens == len(got[2].ids)
    assert bpe.encode_digests(df.limit(0), WORD).count() == 0 and len(dig) == len(got)
    counts = {r.id: r for r in tokencount.token_counts(df, BYTE, 3).collect()}
    assert (counts[100].n_bytes, counts[100].n_tokens, counts[100].over_limit) == (0, 0, False)
    assert tokencount.token_counts(df.limit(0), BYTE, 3).count() == 0


def brute(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [(g, i) for i, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def pieces_of(spark, lengths):
    return spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long").selectExpr("id", "0 AS piece", "0L AS start", "length", "id AS ids_crc32")


def packed(spark, monkeypatch, lengths, capacity):
    monkeypatch.setattr(packing, "pieces", lambda df, *rest: df)
    return packing.pack(pieces_of(spark, lengths), "", capacity).toPandas()


def whole(got, lengths, capacity):
    """All pieces are there once, gapless in their sequences; the number of sequences."""
    assert sorted(zip(got.id, got.length, strict=True)) == list(enumerate(lengths))
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq.length.cumsum() - seq.length == seq.offset).all() and seq.length.sum() <= capacity
    return got.sequence_id.nunique()


@pytest.mark.parametrize("seed", range(6))
def test_sweeps_equal_best_fit_decreasing(spark, monkeypatch, seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 100, 500])
    lengths = [rng.randint(1, rng.choice([capacity, capacity // 2, max(1, capacity // 5)])) for _ in range(200)]
    assert whole(packed(spark, monkeypatch, lengths, capacity), lengths, capacity) == brute(lengths, capacity)


@pytest.mark.parametrize("kinds", ["mixed", "equal", "small"])
def test_sweeps_over_many_tasks(spark, monkeypatch, kinds):
    monkeypatch.setattr(packing, "SEQUENCES", 4)
    monkeypatch.setattr(packing, "ROWS", 300)
    rng = random.Random(4)
    lengths = {"mixed": [rng.choice([rng.randint(1, 100), rng.randint(1, 20)]) for _ in range(3000)], "equal": [30] * 900 + [7] * 900, "small": [rng.randint(1, 9) for _ in range(3000)]}[kinds]
    assert whole(packed(spark, monkeypatch, lengths, 100), lengths, 100) <= 1.02 * brute(lengths, 100) + 2


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("theinan"[: rng.randrange(1, 7)] for _ in range(rng.randrange(60)))) for i in range(200)] + [(7, None), (7, None), (None, "a b"), (900, "word " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, WORD, 64, 1).toPandas()
    library = Tokenizer.from_file(WORD)
    for i, text in rows[:50]:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        mine = got[got.id == i].sort_values("piece")
        if i != 7:
            assert [(r.start, r.length, r.ids_crc32) for r in mine.itertuples()] == [(a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for a in range(0, len(ids), 64)]
    assert len(got[got.id == 7]) >= 3
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq.length.cumsum() - seq.length == seq.offset).all() and seq.length.sum() <= 64
    assert got.sequence_id.nunique() == brute(got.length.tolist(), 64)
    assert packing.pack(df.limit(0), WORD, 64, 1).count() == 0
