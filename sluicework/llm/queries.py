"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, toxicity
from .ann import nearest
from .bpe import encode_digests
from .chosenpath import similar_groups
from .exactdedup import exact_groups
from .filteraudit import filter_audit
from .packing import pack
from .phrases import collocations
from .simhash import as_hex, near_groups
from .tokencount import token_counts
from .urlfilter import judge


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all ``documents``; only labelled rows that are not held out teach."""
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels").filter(~langid.held_out("doc_id")))
    scored = toxicity.score(documents, model, ["doc_id"])
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return scored.select("doc_id", langid.held_out("doc_id").alias("held_out"), "score", predicted)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``; only rows with a language that are not held out teach."""
    documents = _table(spark, sf_dir, "documents")
    model = langid.fit(documents.filter(~langid.held_out("doc_id")))
    found = langid.identify(documents, model, ["doc_id"])
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 4096 tokens."""
    packed = pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 4096, 1)
    return packed.withColumnRenamed("id", "doc_id")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every row of ``embeddings`` whose id is divisible by 50."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all ``documents``, as digests."""
    documents = _table(spark, sf_dir, "documents")
    return encode_digests(documents, _vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


#: Fixed values: (verdict, host, path) of the rules.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every url of ``pages``."""
    return judge(_table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal whole texts of ``documents``."""
    return exact_groups(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``."""
    documents = _table(spark, sf_dir, "documents")
    return token_counts(documents, _vocabulary("byte_bpe_50k.json"), 1024).withColumnRenamed("id", "doc_id")


SAMPLE_TEXT = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one that holds control strings, formatted and read back."""
    own = [(-1, 0, "user", SAMPLE_TEXT), (-1, 1, "assistant", SAMPLE_TEXT)]
    own = spark.createDataFrame(own, "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    rows = rows.withColumn("parts", chat.text_parts(F.col("text")))  # the table holds no other kind
    return chat.read_back(chat.format_turns(rows, parts_col="parts"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all ``documents``: 3-word shingles, 3 bits."""
    found = near_groups(_table(spark, sf_dir, "documents"), 3, 3)
    return found.select(F.col("id").alias("doc_id"), as_hex("fp").alias("fingerprint"), "component_id")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all ``documents``: 5-word shingles, similarity 0.85."""
    return similar_groups(_table(spark, sf_dir, "documents"), 5, 85).withColumnRenamed("id", "doc_id")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of ``documents``."""
    return collocations(_table(spark, sf_dir, "documents")).withColumnRenamed("part", "lang")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of all 120 orders of the five filters on all ``documents``, per language."""
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_ann": op3_ann,
    "op4_bpe": op4_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_chat": op8_chat,
    "op9_language_id": op9_language_id,
    "op10_simhash": op10_simhash,
    "op11_minhash": op11_minhash,
    "op12_phrases": op12_phrases,
    "op13_filter_audit": op13_filter_audit,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def _chat_sql() -> str:
    marks = " + ".join(
        f"(length({{x}}) - length(replace({{x}}, '{c}', ''))) // {len(c)}" for c in (*chat.CONTROL, "\\")
    )
    size = lambda x: f"length({x}) + " + marks.replace("{x}", x)
    frame = len(chat.START + chat.SAYS + chat.END)
    return f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '{SAMPLE_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{SAMPLE_TEXT}'),
        g AS (SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
            sum({frame} + {size('role')} + {size('text')})::BIGINT AS formatted_chars
          FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
          0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
        FROM g"""


def _rules_sql() -> str:
    order = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in order)
    at = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    return f"""
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{at}', 1), {_AZ}) AS host,
            regexp_extract(coalesce(url, ''), '{at}', 2) AS path FROM pages)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM u"""


def _audit_sql() -> str:
    """Every order run on every class of documents, step by step."""
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
    lost = lambda c: f"coalesce(sum(n) FILTER (WHERE here AND left_ AND {c}), 0)::BIGINT"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, {words} AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END)
            || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
            || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
            || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
            || (CASE WHEN doc_id > low OR (doc_id IS NULL AND low IS NOT NULL) THEN 'E' ELSE '' END) AS failed
          FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, good, toxic, failed, count(*) AS n FROM f GROUP BY ALL),
        o AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS now,
            '[_' || substr(filter_order, 1, step::INT - 1) || ']' AS before
          FROM (VALUES {orders}) AS v(filter_order), range(1, 6) AS r(step)),
        s AS (SELECT part, filter_order, step, now, good, toxic, n, failed = now AS only_, contains(failed, now) AS here,
            NOT regexp_matches(failed, before) AS left_ FROM c, o),
        g AS (SELECT part, filter_order, step, now, coalesce(sum(n) FILTER (WHERE left_ AND NOT here), 0)::BIGINT AS kept,
            {lost('true')} AS removed, coalesce(sum(n) FILTER (WHERE here AND NOT left_), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (WHERE only_), 0)::BIGINT AS unique_fails, {lost('good')} AS good_lost, {lost('toxic')} AS toxic_lost
          FROM s GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
          (sum(removed) OVER (PARTITION BY part, now))::BIGINT AS shapley FROM g"""


def _phrases_sql() -> str:
    """All phrases listed and counted."""
    return f"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
        s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
        g AS (SELECT lang, k::INT AS k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, range(1, 6) AS r(k) WHERE i + k - 1 <= len(w)),
        n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT f.lang, f.phrase, f.a, cut, n.n, lf.a AS l, rf.a AS r,
            (1000::HUGEINT * f.a * n.n // (lf.a::HUGEINT * rf.a))::BIGINT AS score
          FROM f JOIN n USING (lang), range(1, 5) AS x(cut), f AS lf, f AS rf
          WHERE f.k > cut AND lf.lang = f.lang AND rf.lang = f.lang
            AND lf.phrase = array_to_string(string_split(f.phrase, ' ')[1:cut], ' ')
            AND rf.phrase = array_to_string(string_split(f.phrase, ' ')[cut + 1:], ' ')),
        b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        z AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f AS o WHERE o.lang = b.lang AND o.a >= b.a
            AND length(o.phrase) > length(b.phrase) AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM z QUALIFY rank <= 2000"""


def _near_sql() -> str:
    """All pairs of sets that share a shingle, and what they reach."""
    return f"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        e AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM e),
        c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s AS x JOIN s AS y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN c AS x ON a = x.doc_id JOIN c AS y ON b = y.doc_id WHERE 100 * m >= 85 * (x.n + y.n - m)),
        r(doc_id, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.doc_id WHERE r.low < l.b),
        m AS (SELECT doc_id, min(low) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN c USING (doc_id)"""


ORACLE_SQL = {
    "op11_minhash": _near_sql(),
    "op12_phrases": _phrases_sql(),
    "op13_filter_audit": _audit_sql(),
    "op5_url_filter": _rules_sql(),
    "op8_chat": _chat_sql(),
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_AZ})) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
}
