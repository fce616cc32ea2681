"""The queries of this package, as the driver's contract names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.llm.common import table
from postmill.llm.decontaminate import contamination
from postmill.llm.fixity import page_audit
from postmill.llm.hard_negatives import mined_embeddings
from postmill.llm.infilling import infilling_report
from postmill.llm.languages import languages
from postmill.llm.licenses import license_report, tagged_scan
from postmill.llm.mixing import domain_column, mixing_rates
from postmill.llm.partenum import similar_texts
from postmill.llm.quality_classifier import quality_scores
from postmill.llm.quality_rules import quality_verdicts
from postmill.llm.sharding import shard_table
from postmill.llm.simhash import near_duplicates
from postmill.llm.sql import ORACLE_SQL
from postmill.llm.substrings import removal_report


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op3_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_audit(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id", domain_column().alias("domain"))
    return mixing_rates(table(spark, sf_dir, "documents"), labelled)[0]


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(table(spark, sf_dir, "documents"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined_embeddings(table(spark, sf_dir, "embeddings"))


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling_report(table(spark, sf_dir, "documents"))


def license_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_licenses": op2_licenses,
    "op3_fixity": op3_fixity,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_languages": op6_languages,
    "op7_quality": op7_quality,
    "op8_substrings": op8_substrings,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_jaccard": op11_jaccard,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_infilling": op13_infilling,
    "license_tags": license_tags,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
