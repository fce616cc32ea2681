"""The corpus pipeline: STAGES in order, each one operator of postmill.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The first
four drop (or, mixing, also repeat) whole documents and return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from postmill.llm.common import removed, shared_folder, table, written
from postmill.llm.decontaminate import remove_contaminated
from postmill.llm.mixing import domain_column, mixed
from postmill.llm.quality_classifier import keep_good
from postmill.llm.sharding import shard_table
from postmill.llm.simhash import deduplicate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the rule allows."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates in the target mix say."""
    labelled = table(spark, sf_dir, "labels").select("doc_id", domain_column().alias("domain"))
    return mixed(docs, labelled)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document."""
    return shard_table(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifiers and the shuffle can't be said in SQL; the stages are tested one by one and together.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, with a written table between them; a table goes when the next is there.

    An empty table runs through all stages; rows without text or id are kept or dropped as each stage's operator says.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before:
            removed(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
