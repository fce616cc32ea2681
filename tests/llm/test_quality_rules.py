import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmill.llm.quality_rules import ALPHA, DELTA, LEVELS, POWER, RULES, _log_binomial_cdf, certified_levels, cutoffs, features, level_of, quality_verdicts
from tests.llm.fixtures import awkward, docs, prose


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(wins)
    hit = {j for i, w in enumerate(wins) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = awkward() + [prose(rng, 50, 3) for _ in range(20)] + ["a|b <c> #d &e *f $g %h\n" * 3, "x " * 100]
    got = {r[0]: tuple(r)[1:6] for r in features(docs(spark, texts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.01), (500, 1, 0.01), (2000, 12, 0.01), (300, 299, 0.5)])
def test_binomial_tail(spark, n, k, p):
    exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    got = spark.range(1).select(_log_binomial_cdf(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
    assert math.exp(got) == pytest.approx(exact, rel=1e-9)


def test_levels_are_certified_and_catch_what_the_strictest_does(spark):
    rng = random.Random(1)
    levels = [rng.randrange(1, LEVELS + 1) if i % 20 == 0 else LEVELS + 1 for i in range(3000)]
    poor = [rng.choice([3, 4, 5]) for _ in range(300)]
    rows = [(0, 1, x) for x in levels] + [(0, 0, x) for x in poor] + [(1, 1, LEVELS + 1) for _ in range(66)] + [(1, 0, 1)] + [(2, 1, LEVELS + 1) for _ in range(67)] + [(2, 0, 9)]
    labelled = spark.createDataFrame(rows, "band int, quality int, level int")
    certified = []
    for x in range(1, LEVELS + 1):
        k = sum(i <= x for i in levels)
        if math.fsum(math.comb(3000, i) * ALPHA**i * (1 - ALPHA) ** (3000 - i) for i in range(k + 1)) > DELTA / 3:
            break
        certified.append(x)
    caught = [sum(p <= x for p in poor) for x in certified]
    want = next(x for x, n in zip(certified, caught, strict=True) if n >= POWER * caught[-1])
    got = {r["band"]: r["used"] for r in certified_levels(labelled).collect()}
    assert got[0] == want == 5 and certified[-1] > want
    assert got[1] is None and got[2] == 9  # 66 good documents certify nothing, 67 do
    assert certified_levels(labelled.where("quality = 0")).where("used is not null").count() == 0


def test_levels_of_ratios(spark):
    """A document is rejected at a level if one of its ratios is above that level's cutoff."""
    rng = random.Random(4)
    rows = [tuple(rng.choice([0.0, rng.random() * 0.6, rng.choice(cutoffs(r))]) if rng.random() < 0.4 else 0.0 for r in RULES) for _ in range(300)]
    table = spark.createDataFrame(rows, ", ".join(f"{r} double" for r in RULES))
    got = [r[0] for r in table.select(level_of({r: F.col(r) for r in RULES})).collect()]
    assert got == [next((k for k in range(1, LEVELS + 1) if any(x > cutoffs(r)[k - 1] for r, x in zip(RULES, row, strict=True))), LEVELS + 1) for row in rows]
    assert all(cutoffs(r) == sorted(set(cutoffs(r)), reverse=True) and len(cutoffs(r)) == LEVELS for r in RULES)


def test_verdicts(spark):
    rng = random.Random(2)
    clean = [prose(rng, 60, 4000) for _ in range(700)]
    texts = clean + [" ".join(f"{w}###$$$" for w in prose(rng, 60, 4000).split()) for _ in range(20)] + awkward()
    labels = spark.createDataFrame([(i, 1) for i in range(690)] + [(0, 1), (700, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_verdicts(docs(spark, texts), labels).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["kept"] for i in range(700))
    assert not any(got[i]["kept"] for i in range(700, 720))
    assert all(not r["kept"] for r in got.values() if r["base_failed"])


def test_empty_tables_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_verdicts(docs(spark, []), labels).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in quality_verdicts(docs(spark, awkward() * 2, ids=[*range(12), None] * 2), labels).collect()}
    assert kept[6] and not kept[0]


def test_few_labels_certify_on_the_test_tables(spark):
    """The green row of the driver's comparison covers the method: more is rejected than the base rules reject."""
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_verdicts(table, labels).collect()}
    rejected = {i for i, r in got.items() if not r["kept"] and not r["base_failed"]}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if not got[r["doc_id"]]["base_failed"]}
    assert rejected and sum(known.get(i) == 0 for i in rejected) > 0.5 * sum(i in known for i in rejected)
    assert sum(q == 1 and i in rejected for i, q in known.items()) <= ALPHA * sum(q == 1 for q in known.values())
