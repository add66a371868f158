"""The operators' queries over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, exact_dedup, langid, line_dedup, merkle, mixing, simhash, toxicity, url_filter, warc
from textloom.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"


def vocabulary() -> str:
    """Where the public word vocabulary lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold(folds: int) -> Column:
    """Which fold a document is in."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


#: Fixed values of the contract: host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.decide(table(spark, sf_dir, "documents")).drop("t")
    return lines.withColumnsRenamed({"no": "line_no", "class_key": "class_doc_id", "class_no": "class_line_no"})


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sizes(table(spark, sf_dir, "documents"))
    return mixing.assign(sized, key="doc_id", source="source", size="size").drop("source")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"), fold(3) == 1)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captured = F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(F.crc32("url"), 31_536_000))
    return warc.capture_history(pages, time=F.coalesce(captured, F.timestamp_seconds(F.lit(1_577_836_800))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5) == 0)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocabulary(), ids=None, digests=True).drop("text")


OP1_SQL = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS nth
  FROM parsed LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE nth = 1
"""

OP3_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, source IS NULL AS none,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 16) AS rand
  FROM documents),
sources AS (
  SELECT none, coalesce(source, '') AS name, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY none, coalesce(source, '')) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY 1, 2),
filled AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS fill FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY fill, none, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY fill, none, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filled),
budgets AS (
  SELECT none, name, source_size,
         CASE WHEN fill <= level THEN most
              ELSE weight * (SELECT level FROM levels WHERE fill > level ORDER BY fill, none, name LIMIT 1) END AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY s.none, coalesce(source, '') ORDER BY rand, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN budgets b ON s.none = b.none AND coalesce(s.source, '') = b.name)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, round(target - whole * source_size) - before)) AS BIGINT) AS taken
FROM placed
"""

OP7_SQL = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM hashed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_language": op4_language,
    "op5_simhash": op5_simhash,
    "op6_merkle": op6_merkle,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op3_mix_sources": OP3_SQL, "op7_exact_dedup": OP7_SQL}
