"""Postings and related tables derived from the test tables, which hold none."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import truncate

AS_OF = datetime(2026, 3, 31, 12, 0)
KEYWORDS = ["ndre", "Thtion", "éré", "lich", "ndrea", "casa"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting for each document: its beginning as title, its source as site, dates by its id."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.pmod("doc_id", F.lit(90)).cast("int")).cast("string")
    return d.select(
        F.col("source").alias("site_id"), F.substring("source", 4, 10).cast("int").alias("site_ord"), F.concat(F.lit("Board "), "source").alias("site_name"),
        F.col("doc_id").alias("post_ord"), truncate("text").alias("title"), F.col("lang").alias("organization"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(day).alias("reg_date"), F.when(F.col("doc_id") % 7 == 0, day).alias("deadline_date"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://x/"), F.col("doc_id").cast("string"))).alias("url"), F.lit(None).cast("string").alias("status"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of the postings, and one that has none."""
    named = table(spark, sf_dir, "documents").select("source").distinct()
    named = named.union(spark.range(1).select(F.lit("src99")))
    o = F.substring("source", 4, 10).cast("int")
    return named.select(F.col("source").alias("site_id"), o.alias("site_ord"), F.concat(F.lit("Board "), "source").alias("site_name"), F.concat(F.lit("https://x/"), "source").alias("site_url"), F.lit("2026-03-31T12:00:00Z").alias("crawled_at"), F.when(o % 9 == 4, "timeout").alias("error"))


def raw_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in six shapes."""
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    shapes = [
        F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy.M.d"), F.concat(F.date_format(d, "yyyy. M. d"), F.lit(".")),
        F.concat(F.lit(" "), F.date_format(d, "yy.MM.dd"), F.lit("　")), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" ~ "), F.date_format(d, "yyyy-MM-dd")),
        F.concat(F.lit(" "), F.date_format(d, "yyyy/MM/dd"), F.lit(" ")),
    ]
    raw = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        raw = F.when(F.col("o_orderkey") % 6 == k, shape).otherwise(raw)
    return o.select("o_orderkey", raw.alias("raw"))


#: The same tables for DuckDB, as common table expressions.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^{WS}+|{WS}+\z', '', 'g')"


def squeeze_sql(c: str) -> str:
    return trim_sql(f"regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g')")


DAY_SQL = "strftime(DATE '2026-01-01' + CAST(doc_id % 90 AS INTEGER), '%Y-%m-%d')"
POSTINGS_SQL = f"""
squeezed AS (SELECT *, {squeeze_sql("text")} AS s FROM documents),
postings AS (
  SELECT source AS site_id, CAST(substr(source, 4) AS INTEGER) AS site_ord, 'Board ' || source AS site_name, doc_id AS post_ord,
    CASE WHEN length(s) > 80 THEN left(s, 80) || '...' ELSE s END AS title, lang AS organization,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE {DAY_SQL} END AS reg_date, CASE WHEN doc_id % 7 = 0 THEN {DAY_SQL} END AS deadline_date,
    CASE WHEN doc_id % 3 <> 0 THEN 'https://x/' || doc_id END AS url, CAST(NULL AS VARCHAR) AS status
  FROM squeezed)"""
SITES_SQL = """
sites AS (
  SELECT source AS site_id, CAST(substr(source, 4) AS INTEGER) AS site_ord, 'Board ' || source AS site_name, 'https://x/' || source AS site_url,
    '2026-03-31T12:00:00Z' AS crawled_at, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 9 = 4 THEN 'timeout' END AS error
  FROM (SELECT DISTINCT source FROM documents UNION ALL SELECT 'src99'))"""
RAW_DATES_SQL = """
raw_dates AS (
  SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y.%-m.%-d') WHEN 2 THEN strftime(o_orderdate, '%Y. %-m. %-d') || '.'
    WHEN 3 THEN chr(160) || strftime(o_orderdate, '%y.%m.%d') || chr(12288) WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || ' ~ ' || strftime(o_orderdate, '%Y-%m-%d')
    ELSE ' ' || strftime(o_orderdate, '%Y/%m/%d') || ' ' END AS raw
  FROM orders)"""
