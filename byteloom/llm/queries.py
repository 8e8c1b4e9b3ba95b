"""The queries of this subpackage: each applies one operator to the whole of its table with production parameters.

They derive the columns that are asked for from the operators' own results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.llm import ann, html, langid, mixing, packing, pii, pivots, quality, simhash, urlfilter
from byteloom.llm.common import crc_fold, table

TOKENIZER = "word_bpe_49k.json"
URL_RULES = [
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
]
#: What hosts say that they sell, for URLs that no rule fits: whole words of a host, which dots and hyphens part.
URL_WORDS = ("adult", "bets", "casino", "pills", "poker", "porn", "xxx")
URL_GLOBS = [f"{before}{word}{after}" for word in URL_WORDS for before in ("", "*.", "*-") for after in ("", ".**", "-**", "/**")]
#: Equal shares for the sources named; all others share a fifth of one source's.
SOURCE_WEIGHTS = {f"src{i}": 10 for i in range(20)} | {mixing.OTHER: 2}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    scored = langid.classify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS, keep=["page_id"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False))
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score_texts(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, SOURCE_WEIGHTS).select("doc_id", "source", "pool", "block", "slot", "place")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(pii.BASE))

    def count(kind: str) -> Column:  # a lambda's second parameter would be the element's place
        number = pii.KINDS.index(kind)
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_language_id, op3_url_filter, op4_quality, op5_nearest_neighbours, op6_source_mixing, op7_html_extraction, op8_pii, op9_simhash, op10_exact_topk)
}

_WORDS = "|".join(URL_WORDS)
ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_replace(substr(url, strpos(url, '://') + 3), '(?s)[?#].*$', '') ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id,
         translate(CASE WHEN strpos(r, '/') > 0 THEN substr(r, 1, strpos(r, '/') - 1) ELSE coalesce(r, '') END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/')) ELSE '' END AS path
  FROM rest),
rules(h, p, action) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in URL_RULES)}),
fits AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT parts.page_id, host, path, rule,
       coalesce(action, CASE WHEN regexp_matches(host, '(^|[.-])({_WORDS})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)""",
    "op10_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
