import random
import zlib

import numpy as np
import pytest

from postmill.llm.quality_classifier import estimate_prior, keep_good, minimise, quality_scores
from postmill.llm.text_features import STYLE, bounded_sample, style
from tests.llm.fixtures import awkward, docs, prose


def good(rng):
    return prose(rng, rng.randrange(30, 200)).capitalize() + "."


def bad(rng):
    words = prose(rng, rng.randrange(30, 200)).split()
    return rng.choice([" | ".join, lambda w: "!! ".join(w).upper(), lambda w: " ".join(x + "***" for x in w)])(words)


def corpus(spark, n=900, extra=()):
    rng = random.Random(7)
    kinds = [int(rng.random() < 0.7) for _ in range(n)]
    texts = [good(rng) if k else bad(rng) for k in kinds]
    labels = [(i, k) for i, k in enumerate(kinds) if rng.random() < 0.5]
    table = docs(spark, texts + list(extra))
    return table, spark.createDataFrame(labels, "doc_id long, quality int"), kinds


def test_prior_of_a_mixture():
    rng = np.random.default_rng(1)
    p, u = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 3000), rng.normal(-3, 1, 1000)])
    assert estimate_prior(p, u) == pytest.approx(0.75, abs=0.06)


def test_risk_separates_without_negatives():
    rng = np.random.default_rng(2)
    p = rng.normal(1, 0.5, (500, 2))
    u = np.concatenate([rng.normal(1, 0.5, (500, 2)), rng.normal(-1, 0.5, (500, 2))])
    w, b = minimise(p, u, 0.5)
    assert ((p @ w + b > 0).mean() + (u[500:] @ w + b < 0).mean()) / 2 > 0.95


def test_held_out_accuracy(spark):
    table, labels, kinds = corpus(spark, extra=awkward())
    got = {r["doc_id"]: r for r in quality_scores(table, labels).collect()}
    assert len(got) == 900 + len(awkward())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(900))
    assert np.mean([got[i]["predicted"] == kinds[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_labels_of_the_held_out_fold_change_nothing(spark):
    from pyspark.sql import functions as F

    table, labels, _ = corpus(spark, 300)
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    other = labels.withColumn("quality", F.when(fold == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality_scores(table, labels).collect()) == sorted(quality_scores(table, other).collect())


def test_filter_keeps_columns_and_rows(spark):
    table, labels, kinds = corpus(spark, 300)
    kept = keep_good(table, labels)
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert np.mean([(i in ids) == bool(k) for i, k in enumerate(kinds)]) > 0.95


def test_repeated_ids_are_learnt_from_alike(spark):
    table, labels, _ = corpus(spark, 300)
    twice = table.union(table.withColumn("text", table["text"].substr(1, 40)))
    first, second = (sorted(quality_scores(x, labels).collect()) for x in (twice.orderBy("text"), twice.orderBy("n_chars").repartition(5)))
    assert first == second and len(first) == 600


def test_filter_of_awkward_rows(spark):
    table, labels, _ = corpus(spark, 300, extra=awkward())
    loose = table.withColumn("doc_id", table["doc_id"] * 0 + 5)
    assert keep_good(table.limit(0), labels).count() == 0 and keep_good(loose, labels.limit(0)).count() == 300 + len(awkward())
    from pyspark.sql import functions as F

    kept = keep_good(table.withColumn("doc_id", F.when(F.col("doc_id") < 300, F.col("doc_id"))), labels)
    assert kept.columns == table.columns and 0 < kept.where("doc_id is null").count() <= len(awkward())


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_scores(docs(spark, awkward(), ids=[None] * len(awkward())), none).collect()
    assert {r["score"] for r in got} == {0.5} and {r["held_out"] for r in got} == {False}
    assert quality_scores(docs(spark, []), none).count() == 0


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    first = sorted(r[0] for r in bounded_sample(rows.repartition(7), "doc_id", 100).collect())
    assert len(first) == 100 and first == sorted(r[0] for r in bounded_sample(rows, "doc_id", 100).collect())


def test_style_of_nothing():
    assert style(None).tolist() == [0] * len(STYLE) == style(b"").tolist()
    assert np.isfinite(style(b" \n ")).all()
