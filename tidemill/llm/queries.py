"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontam, html, langid, licences, mixing, neardup, pii, quality, topk, urls
from tidemill.llm.common import read

#: A fifth of the documents, by their id, is held out of all learning.
FOLDS = 5


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text is divisible by FOLDS; true for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(True))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), docs.where(~held_out()))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(~held_out())
    return quality.score(docs.select("doc_id", held_out().alias("held_out"), "text"), labels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_html_extraction, op3_licence_scan, op4_decontamination, op5_source_mixing, op6_pii, op7_language_id, op8_near_duplicates, op9_top_k, op10_quality)}


def _op1_sql() -> str:
    def hits(terms: tuple[str, ...]) -> str:
        return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms)

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"

    longest = sorted(urls.RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in longest)
    names = sorted({*urls.STRICT, *urls.SOFT})
    terms = ", ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN '{t}' END" for t in names)
    soft = tuple(t for t in urls.SOFT if t not in urls.STRICT)
    return f"""
WITH split AS (SELECT page_id, lower(coalesce(url, '')) AS u, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM split),
parts AS (SELECT *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
ruled AS (SELECT *, CASE {rule} END AS rule, {urls.LIMIT} * ({hits(urls.STRICT)}) + {urls.SOFT_WEIGHT} * ({hits(soft)}) AS weight FROM parts)
SELECT page_id, host, path, rule, CASE {verdict} WHEN weight >= {urls.LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  array_to_string(list_filter([{terms}], lambda x: x IS NOT NULL), ',') AS terms, CAST(weight AS DOUBLE) AS weight FROM ruled"""


_OP9_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id, CAST(list_dot_product(q.v, b.v) AS BIGINT) AS score
  FROM whole q JOIN whole b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _op1_sql(), "op9_top_k": _OP9_SQL}
