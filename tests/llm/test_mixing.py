import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm.mixing import DOMAINS, TARGETS, copies, domain_column, fit_rates, marks, mixed, mixing_rates, rate, softmax_regression
from tests.llm.fixtures import awkward, docs, prose


def posterior_table(spark, rng, n, shares):
    rows = []
    for _ in range(n):
        p = np.array([rng.gammavariate(a, 1) + 1e-9 for a in shares])
        rows.append((rng.randrange(5, 500), (p / p.sum()).tolist()))
    return spark.createDataFrame(rows, "n_tokens long, p array<double>"), rows


def literal(rows, steps):
    out = []
    for _, p in rows:
        r = 1.0
        for g in steps:
            r = max(0.0, r - float(np.dot(p, g)))
        out.append(r)
    return out


def test_rates_meet_reachable_targets(spark):
    table, rows = posterior_table(spark, random.Random(1), 500, [0.4, 0.2, 0.2])
    held = np.array([np.array(p) * n for n, p in rows]).sum(0)
    targets = [held[0] * 0.9, held[1] * 0.7, held[2] * 1.4]
    steps = fit_rates(table, targets)
    rates = np.array(literal(rows, steps))
    got = (rates[:, None] * np.array([np.array(p) * n for n, p in rows])).sum(0)
    assert got == pytest.approx(targets, rel=1e-4)
    assert [r["r"] for r in table.select(rate("p", steps).alias("r")).collect()] == pytest.approx(rates.tolist(), abs=1e-9)


def test_constraint_holds_and_the_gap_shrinks(spark):
    table, rows = posterior_table(spark, random.Random(2), 300, [0.3, 0.3])
    mass = np.array([np.array(p) * n for n, p in rows])
    targets = [mass[:, 0].sum(), mass[:, 1].sum() * 0.02]  # most of the second must go
    rates = np.array(literal(rows, fit_rates(table, targets)))
    assert (rates >= 0).all() and (rates == 0).any()
    gap = lambda r: np.abs((r[:, None] * mass).sum(0) - targets).sum()
    assert gap(rates) < 0.2 * gap(np.ones(len(rows)))


def test_a_domain_nobody_has_is_left_out(spark):
    table, rows = posterior_table(spark, random.Random(3), 200, [0.5, 0.5, 1e-7])
    held = np.array([np.array(p) * n for n, p in rows]).sum(0)
    rates = np.array(literal(rows, fit_rates(table, [held[0], held[1] * 0.5, held[0]])))
    assert rates.max() < 2


def test_copies_average_to_the_rate(spark):
    wanted = {"a": 1.3, "b": 0.04, "c": 0.95, "d": 1.0, "e": 0.0, "f": 2.06}
    table = spark.range(20000).select(*(F.lit(r).alias(c) for c, r in wanted.items()), F.rand(1).alias("u"))
    got = table.select(*(F.avg(copies(c, F.col("u"))) for c in wanted)).first()
    assert list(got) == pytest.approx(list(wanted.values()), abs=0.015) and got[3] == 1.0 and got[4] == 0.0


def test_softmax_finds_classes():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 600)
    x = rng.normal(0, 0.3, (600, 3)) + np.eye(3)[y]
    w = softmax_regression(x, y, 3)
    assert ((np.hstack([x, np.ones((600, 1))]) @ w).argmax(1) == y).mean() > 0.95


def test_marks():
    assert marks([b"abcdef", b"abcde", b"abcdef"]) == {b"abcdef", b"abcde", b"abcde*"}


def corpus(spark):
    rng = random.Random(5)
    kinds = [rng.choices(range(4), [70, 15, 12, 3])[0] for _ in range(800)]
    texts = []
    for k in kinds:
        words = prose(rng, rng.randrange(20, 120)).split()
        if k % 2:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "vile"])
            words.append("vile")
        texts.append(" ".join(words) if k < 2 else " | ".join(words))
    labels = [(i, 1 - k // 2, k % 2) for i, k in enumerate(kinds) if i % 2] + [(None, 1, 1), (2, None, 0)]
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", domain_column().alias("domain"))
    return texts, kinds, labelled


def test_mix_of_a_corpus(spark):
    texts, kinds, labelled = corpus(spark)
    table = docs(spark, texts + awkward()).repartition(3)
    shown, _ = mixing_rates(table, labelled)
    got = {r["doc_id"]: r for r in shown.collect()}
    assert len(got) == len(texts) + len(awkward())
    assert all(sum(r[f"p_{d}"] for d in DOMAINS) == pytest.approx(1) for r in got.values())
    best = [max(range(4), key=lambda d, r=got[i]: r[f"p_{DOMAINS[d]}"]) for i in range(len(texts))]
    assert np.mean([b == k for b, k in zip(best, kinds, strict=True)]) > 0.97
    tokens = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got.values()) for d in DOMAINS}
    assert tokens["good_toxic"] / tokens["good_clean"] == pytest.approx(TARGETS["good_toxic"] / TARGETS["good_clean"], rel=0.3)
    out = mixed(table, labelled)
    assert out.columns == table.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert np.mean([i in kept for i, k in enumerate(kinds) if k == 0]) > 0.9
    assert np.mean([i in kept for i, k in enumerate(kinds) if k == 1]) < 0.2


def test_drawn_totals_meet_the_targets(spark):
    texts, _, labelled = corpus(spark)
    table = docs(spark, texts * 6, ids=range(6 * len(texts)))
    shown, mix = mixing_rates(table, labelled, {"good_clean": 0.6, "good_toxic": 0.1, "poor_clean": 0.25, "poor_toxic": 0.05})
    assert mix.settled and not mix.unmet
    rows = shown.collect()
    drawn = np.array([sum(r["copies"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) for d in DOMAINS])
    assert drawn / drawn.sum() == pytest.approx([0.6, 0.1, 0.25, 0.05], rel=0.1)


def test_mixed_rows_without_ids_or_text(spark):
    _, _, labelled = corpus(spark)
    table = docs(spark, ["same words here", "same words here", None, ""], ids=[None, None, None, 4])
    rates = mixing_rates(table, labelled)[0].collect()
    assert [r["n_tokens"] for r in rates] == [3, 3, 0, 0] and rates[0]["copies"] == rates[1]["copies"]
    out = mixed(table, labelled)
    assert out.columns == table.columns and out.count() == sum(r["copies"] for r in rates)
    assert mixed(table.limit(0), labelled).count() == 0


def test_drawn_copies_are_those_of_the_rates(spark):
    texts, _, labelled = corpus(spark)
    table = docs(spark, texts)
    rates = {r["doc_id"]: r["copies"] for r in mixing_rates(table, labelled)[0].collect()}
    drawn = {r["doc_id"]: r["count"] for r in mixed(table, labelled).groupBy("doc_id").count().collect()}
    assert drawn == {i: n for i, n in rates.items() if n}


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, domain int")
    assert mixing_rates(docs(spark, []), none)[0].count() == 0
    got = mixing_rates(docs(spark, awkward()), none)[0].collect()
    assert len(got) == len(awkward()) and all(r["p_good_clean"] == 0.25 for r in got)


def sure_table(spark, rng, n, shares, noise):
    """Documents of one domain each, whose posteriors are moderately sure."""
    rows = []
    for _ in range(n):
        z = rng.normal(0, noise, len(shares))
        z[rng.choice(len(shares), p=shares)] += 4
        rows.append((int(rng.integers(5, 500)), (np.exp(z) / np.exp(z).sum()).tolist()))
    return spark.createDataFrame(rows, "n_tokens long, p array<double>"), rows


def brute(mass, weights, targets):
    """Expected totals of non-negative least squares, by active sets (Lawson and Hanson)."""
    a, b = mass.T * weights[:, None], np.array(targets) * weights
    free, r = np.zeros(a.shape[1], bool), np.zeros(a.shape[1])
    for _ in range(200):
        pull = a.T @ (b - a @ r)
        pull[free] = -np.inf
        if pull.max() <= 1e-9 * np.abs(a.T @ b).max():
            break
        free[pull.argmax()] = True
        while True:
            s = np.zeros_like(r)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (s[free] > 0).all():
                break
            low = free & (s <= 0)
            r = r + (r[low] / (r[low] - s[low])).min() * (s - r)
            free &= r > 1e-12
            r[~free] = 0
        r = s
    return mass.T @ r


@pytest.mark.parametrize("noise", [0.5, 1.0])
def test_totals_equal_brute_force_where_many_rates_are_zero(spark, noise):
    table, rows = sure_table(spark, np.random.default_rng(4), 1500, [0.7, 0.15, 0.12, 0.03], noise)
    mass = np.array([np.array(p) * n for n, p in rows])
    targets = [mass[:, 0].sum() * TARGETS[d] / TARGETS["good_clean"] for d in DOMAINS]
    rates = np.array(literal(rows, fit_rates(table, targets)))
    square = np.array([n * np.array(p) ** 2 for n, p in rows]).sum(0)
    assert (rates == 0).mean() > 0.1
    assert rates @ mass == pytest.approx(brute(mass, square**-0.5, targets), rel=2e-3)


def test_rare_domains_are_aimed_at(spark):
    rows = [(100, [0.9999, 0.0001])] * 1999 + [(100, [0.01, 0.99])]  # 0.05 % by tokens, 0.1 % wanted
    table = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    mass = np.array([np.array(p) * n for n, p in rows])
    targets = [mass[:, 0].sum(), mass[:, 0].sum() * 0.001]
    assert np.array(literal(rows, fit_rates(table, targets))) @ mass == pytest.approx(targets, rel=1e-3)


def test_what_is_not_met_is_told(spark):
    from postmill.llm.mixing import solve

    table = spark.createDataFrame([(100, [0.7, 0.3, 0.0]), (50, [0.6, 0.4, 0.0])] * 20, "n_tokens long, p array<double>")
    found = solve(table, [1000.0, 0.0, 10.0])
    assert found.settled and found.unmet().tolist() == [0, 1, 2]
    assert solve(table, [1400.0, 900.0, 0.0]).unmet().tolist() == []
