import math
import random

import numpy as np
import pytest

from postmill.llm import hard_negatives as hn
from postmill.llm.hard_negatives import Pivots, farthest_first, mined_embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec int, anchor string, h int"


def brute(rows):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in kept if i % 50 == 0}:
        dot = lambda w: sum(a * b for a, b in zip(v, w, strict=False))  # noqa: B023, E731
        best = sorted((-dot(w), j) for j, other, w in kept if other == label and j != i)[:5]
        for p, pid in best:
            p = -p
            fit = sorted((-dot(w), j) for j, other, w in kept if other != label and 50 * p <= 100 * dot(w) <= 95 * p)[:3]
            out += [(i, pid, rank, n, p, -s) for rank, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, v, label in rows], SCHEMA)


def vectors(seed, n=400, width=8):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(width)]
        scale = rng.choice([1, 1, 1, 0.2, 3]) / math.sqrt(sum(x * x for x in v))
        rows.append((i, [x * scale for x in v], rng.randrange(4)))
    return rows


def got(frame):
    return sorted(tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(hn, "BLOCK", block)
    rows = vectors(seed)
    found = mined_embeddings(table(spark, rows).repartition(3))
    assert dict(found.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert got(found) == brute(rows) != []


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(3, 160)
    rows += [(50, None, 1), (100, [nan] * 8, 1), (150, [inf] * 8, 2), (200, [0.5, None] * 4, 2), (None, [0.1] * 8, 1), (250, [0.1] * 8, None)]
    rows += [(300, [], 1), (301, [0.5], 1), (302, [0.5, 0.1], 2), (350, [0.9] * 3, 2)]  # shorter vectors
    rows += [rows[i] for i in (0, 0, 3, 50, 51, 52, 52)]  # repeated rows, anchors too
    rows += [(400 + i, [0.25] * 8, i % 3) for i in range(60)]  # one vector, many rows: ties
    assert got(mined_embeddings(table(spark, rows))) == brute(rows) != []


def test_groups_of_anchors_give_the_same(spark):
    rows = vectors(4, 600)
    want = brute(rows)
    base = table(spark, rows)
    label = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label"
    plain = base.selectExpr("vec_id as id", label, "embedding").withColumn("vec", hn.integer_vector("embedding"))
    assert got(hn.hard_negatives(plain, plain["id"] % 50 == 0, group=4)) == want


def test_none_to_mine(spark):
    assert mined_embeddings(table(spark, [])).count() == 0
    assert mined_embeddings(table(spark, [(1, [1.0], 1)])).count() == 0
    assert mined_embeddings(table(spark, [(50, [1.0], 1)])).count() == 0
    assert mined_embeddings(table(spark, [(50, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)])).count() == 1  # scores of zero


def test_brackets_hold():
    rng = np.random.default_rng(1)
    x, q = np.floor(256 * rng.normal(size=(200, 8))), np.floor(256 * rng.normal(size=(20, 8)))
    length = float((x * x).sum(1).max())
    pivots = Pivots(farthest_first(np.c_[x, np.sqrt(length - (x * x).sum(1))], 5), length, 8)
    rows, queries = pivots.row_distances(x), pivots.query_distances(q)
    score = q @ x.T
    size = (q * q).sum(1)[:, None] + length
    for j in range(5):
        near, far = np.abs(queries[:, j, None] - rows[:, j]), queries[:, j, None] + rows[:, j]
        assert ((size - far**2) / 2 <= score + 1e-3).all() and (score <= (size - near**2) / 2 + 1e-3).all()


def test_near_blocks_are_passed_over():
    """Rows in clusters: most blocks can't hold what an anchor wants."""
    rng = np.random.default_rng(2)
    centres = np.floor(4096 * rng.normal(size=(16, 32)))
    x = np.floor(np.repeat(centres, 64, 0) + 16 * rng.normal(size=(1024, 32)))
    length = float((x * x).sum(1).max())
    pivots = Pivots(farthest_first(np.c_[x, np.sqrt(length - (x * x).sum(1))], 16), length, 32)
    far, q = pivots.row_distances(x), x[::64]
    held = hn.Queries(np.arange(16), np.zeros(16), q, pivots.query_distances(q), (q * q).sum(1) + length)
    passed = 0
    for k in range(16):
        rows = far[64 * k : 64 * k + 64]
        block = hn.Block(np.arange(64), np.zeros(64), x[64 * k : 64 * k + 64], rows.min(0), rows.max(0), 0, np.sort(rows[:, 0]))
        _, most = held.brackets(block)
        passed += int((most < (q * q).sum(1) * 0.8).sum())
    assert passed > 16 * 16 / 2


def test_too_long_vectors_are_an_error(spark):
    with pytest.raises(ValueError, match="too long"):
        mined_embeddings(table(spark, [(50, [1e8], 1), (1, [1e8], 1)]))
