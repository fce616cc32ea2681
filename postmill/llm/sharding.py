"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

In a uniform permutation of all rows, the number of rows that go from a partition to a shard
is multivariate hypergeometric. So the matrix of these counts is drawn first (at most 1024 x
shards numbers, on the driver, from the partitions' row counts alone). Each partition then
permutes its rows and deals the next so many to each shard, and each shard permutes what it
got. Rows move as DataFrame columns and windows only.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import checkpoint

SHARDS = 40
SEED = 20
#: Rows of the communication matrix at most: input partitions beyond are taken together.
PARTS = 1024
#: Rows of a shard that one window sorts, about.
BUCKET_ROWS = 250_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """The number of good items among `draws` taken without replacement; exact for any size.

    Rejection below a flat middle and exponential tails, which covers every log-concave
    distribution on the integers once its mode's probability is known (Devroye, "A simple
    generator for discrete log-concave distributions", 1987).
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    log_c = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    log_p = lambda x: log_c(good, x) + log_c(bad, draws - x)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    top = log_p(mode)
    peak = math.exp(top - log_c(good + bad, draws))
    width = 1 + peak / 2
    while True:
        if rng.random() <= width / (1 + width):
            y = rng.random() * width / peak
        else:
            y = (width + rng.expovariate(1)) / peak
        x = mode + (round(y) if rng.random() < 0.5 else -round(y))
        if low <= x <= high and rng.random() * min(1.0, math.exp(width - peak * y)) <= math.exp(log_p(x) - top):
            return x


def communication_matrix(parts: dict[int, int], sizes: list[int], seed: int = SEED) -> dict[int, list[int]]:
    """Rows that each partition (id and rows) sends to each shard; sums are exact both ways."""
    rng = random.Random(seed)
    room = list(sizes)
    left = sum(room)
    matrix = {}
    for part, rows in sorted(parts.items()):
        sent, others = [], left
        to_draw = rows
        for shard, free in enumerate(room):
            others -= free
            n = hypergeometric(rng, free, others, to_draw)
            room[shard] -= n
            to_draw -= n
            sent.append(n)
        left -= rows
        matrix[part] = sent
    return matrix


def _drawn(*what: str | int) -> Column:
    """A random number that the row's place in the input and the seed decide."""
    return F.xxhash64(*(F.lit(w) if isinstance(w, int) else F.col(w) for w in what))


def exact_shuffle(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """`rows` with `shard` (0 to `shards` - 1, row counts at most one apart) and `slot` (the place
    in the shard, gapless from 0), a uniform random permutation given the seed and input order.

    Any columns, nulls and repeated rows pass unchanged; columns of these two names are replaced. With fewer rows
    than shards some shards stay empty; an empty table gives an empty result. `rows` should be narrow: it is written to
    the checkpoint folder, which also keeps partition numbers stable when executors are lost.
    """
    rows = rows.drop("shard", "slot")
    part, row, rank, order, bucket, counted, start = (f"_{x}" + "_" * max(map(len, rows.columns), default=0) for x in ("part", "row", "rank", "order", "bucket", "counted", "start"))
    found = checkpoint(rows.withColumn(part, F.pmod(F.spark_partition_id(), F.lit(PARTS))).withColumn(row, F.monotonically_increasing_id()))
    parts = {r[part]: r["count"] for r in found.groupBy(part).count().collect()}
    total = sum(parts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(parts, sizes, seed)
    ends = [{"part": p, "ends": [sum(sent[: s + 1]) for s in range(shards)]} for p, sent in matrix.items()]
    plan = found.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<part:int,ends:array<long>>>")))

    # Permute locally, then deal: the next so many rows go to the next shard.
    local = Window.partitionBy(part).orderBy(_drawn(row, seed), row)
    ranked = found.withColumn(rank, F.row_number().over(local) - 1)
    # The plan has at most PARTS rows of `shards` numbers.
    dealt = ranked.join(F.broadcast(plan.withColumnRenamed("part", part).withColumnRenamed("ends", start)), part)
    buckets = max(16, -(-total // (shards * BUCKET_ROWS)))
    dealt = dealt.withColumn("shard", F.size(F.filter(start, lambda e: e <= F.col(rank))))
    dealt = dealt.withColumn(order, _drawn(row, seed + 1)).withColumn(bucket, F.pmod(_drawn(row, seed + 2), F.lit(buckets)).cast("int"))
    dealt = checkpoint(dealt.drop(part, rank, start))

    # Permute again: random buckets follow each other in a shard, each in random order.
    counts = dealt.groupBy("shard", bucket).agg(F.count("*").alias(counted))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", bucket, F.coalesce(F.sum(counted).over(before), F.lit(0)).alias(start))
    own = Window.partitionBy("shard", bucket).orderBy(order, row)
    placed = dealt.withColumn(rank, F.row_number().over(own) - 1).join(counts, ["shard", bucket])
    return placed.select(*(c for c in rows.columns), "shard", (F.col(start) + F.col(rank)).alias("slot"))


def shard_table(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """For each row of `docs`: `id_col`, `size` (UTF-8 bytes of the text plus 16), `text_crc32`, the law
    (`rows`), `shard`, `slot` and `grown_shard` (null: only the law `key` has it).

    A null text has no bytes and the checksum 0, as an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(id_col, (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return exact_shuffle(narrow, shards, seed).select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
