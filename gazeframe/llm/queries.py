"""The registered queries of this subpackage and, where SQL can express them, the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL query (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.common import crc_mod
    from gazeframe.llm.lm_scoring import learn, score_texts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score_texts(docs, learn(docs, crc_mod("doc_id", 5) != 1))
    return got.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.url_filter import judge_urls

    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"{r}" for r in URL_RULES) + " AS r(host, path, verdict)")
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.decontaminate import decontaminate

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.common import crc_mod
    from gazeframe.llm.language_id import identify, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, crc_mod("doc_id", 3) != 1)
    got = identify(docs.select("doc_id", "text"), model, out=("lang_pred", "score"))
    return got.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.common import crc_mod
    from gazeframe.llm.toxicity import score_toxicity, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"), crc_mod("doc_id", 4) != 2)
    got = score_toxicity(docs, model, out=("score", "predicted", "evidence"))
    return got.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "evidence")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.fingerprint import fingerprint

    return fingerprint(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.chat_format import rotate

    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    got = rotate(_table(spark, sf_dir, "conversations"))
    return got.select("conv_id", "participant", "chunk", "n_turns", "n_chars", "n_learnt", "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), spans.alias("spans"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazeframe.llm.html_text import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


SQL: dict[str, str] = {}

SQL["op2_url_filter"] = """
WITH r(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT i, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
m AS (SELECT v.i, v.page_id, v.host, v.path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY v.i ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
      FROM v LEFT JOIN r ON (v.host = rh OR ends_with(v.host, '.' || rh)) AND starts_with(v.path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1
"""

SQL["op3_mixing"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'n' || md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS i FROM d GROUP BY source),
t AS (SELECT source, source_size, CASE (i - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / w AS fill FROM t),
l AS (SELECT *, ((SELECT 1.5::DOUBLE * sum(source_size) FROM t) - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(w) FROM t) - coalesce(sum(w) OVER o, 0)) AS lev FROM f WINDOW o AS (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap, coalesce(w * (SELECT lev FROM l WHERE fill >= lev ORDER BY fill, lev LIMIT 1), cap)) END AS target FROM l),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - pos)))::BIGINT AS taken FROM e
"""

SQL["op5_chat_format"] = r"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(text, '')), coalesce(role, 'unknown')) - 1 AS place FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
v AS (SELECT t.conv_id, p.participant, place // 64 AS chunk, place, speaker = participant AS me,
        CASE WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10) WHEN speaker = participant THEN '<|im_start|>assistant' || chr(10)
             ELSE '<|im_start|>user name=' || replace(regexp_replace(speaker, '\s', '_', 'g'), '<|', '< |') || chr(10) END AS head,
        replace(body, '<|', '< |') || '<|im_end|>' AS content
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(content) + 1) OVER (PARTITION BY conv_id, participant, chunk ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS b FROM v)
SELECT conv_id, participant, chunk::BIGINT AS chunk, count(*)::BIGINT AS n_turns, sum(length(head) + length(content) + 1)::BIGINT AS n_chars,
  coalesce(sum(length(content)) FILTER (WHERE me), 0)::BIGINT AS n_learnt, string_agg(head || content || chr(10), '' ORDER BY place) AS text, sha256(string_agg(head || content || chr(10), '' ORDER BY place)) AS text_sha256,
  coalesce(string_agg((b::BIGINT)::VARCHAR || '-' || (b + length(content))::BIGINT::VARCHAR, ',' ORDER BY place) FILTER (WHERE me), '') AS spans
FROM o GROUP BY conv_id, participant, chunk
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
