import random
import zlib
from collections import Counter

import numpy as np

from postmill.llm.sharding import communication_matrix, exact_shuffle, hypergeometric, shard_table
from tests.llm.fixtures import awkward, docs


def test_hypergeometric_has_the_right_distribution():
    rng, ref = random.Random(4), np.random.default_rng(4)
    for good, bad, draws in ((5, 7, 6), (40, 3, 20), (1000, 50_000, 800), (0, 4, 2), (4, 0, 3)):
        got = np.array([hypergeometric(rng, good, bad, draws) for _ in range(20_000)])
        want = ref.hypergeometric(good, bad, draws, 20_000)
        spread = max(want.std(), 1e-9)
        assert abs(got.mean() - want.mean()) < 0.05 * spread + 1e-9
        assert abs(got.std() - want.std()) < 0.05 * spread + 1e-9
    x = hypergeometric(rng, 10**12, 3 * 10**12, 10**11)  # beyond what numpy draws
    assert abs(x - 0.25 * 10**11) < 10**6


def test_matrix_sums_are_exact():
    parts, sizes = {0: 17, 3: 0, 5: 100, 9: 1}, [40, 40, 38]
    matrix = communication_matrix(parts, sizes)
    assert {p: sum(r) for p, r in matrix.items()} == parts
    assert [sum(c) for c in zip(*matrix.values(), strict=True)] == sizes


def test_every_place_is_as_likely(spark):
    counts = Counter()
    rows = spark.range(0, 12, numPartitions=3)
    for seed in range(30):
        for r in exact_shuffle(rows, 4, seed).collect():
            counts[r["id"], r["shard"]] += 1
    # 30 draws of 12 ids in 4 shards: each pair is expected 7.5 times.
    assert sum((counts[i, s] - 7.5) ** 2 / 7.5 for i in range(12) for s in range(4)) < 80


def test_shards_of_awkward_rows(spark):
    texts = awkward() * 10
    table = docs(spark, texts, ids=[None if i % 9 == 0 else i // 2 for i in range(len(texts))])
    got = shard_table(table.repartition(5)).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    by = Counter(r["shard"] for r in got)
    assert set(by) == set(range(40)) and max(by.values()) - min(by.values()) <= 1
    for s, n in by.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_few_rows_and_none(spark):
    assert shard_table(docs(spark, [])).count() == 0
    got = shard_table(docs(spark, ["a", "b"])).collect()
    assert sorted(r["slot"] for r in got) == [0, 0] and len({r["shard"] for r in got}) == 2


def test_columns_of_clashing_names_are_replaced(spark):
    rows = spark.range(50).selectExpr("id", "-1 AS shard", "'x' AS slot", "id AS _row", "id AS part")
    got = exact_shuffle(rows, 4)
    assert got.columns == ["id", "_row", "part", "shard", "slot"]
    assert {r["shard"] for r in got.collect()} == {0, 1, 2, 3} and all(r["id"] == r["_row"] == r["part"] for r in got.collect())
