"""Hard-negative mining with a pivot table.

Scores are inner products, and a search by inner product becomes one by distance: each row gets a further component
that makes all rows equally long (as long as the longest), each query a zero. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x.
The distances of every row to a few pivots are stored; by the triangle inequality they bracket the distance of a row to
any query whose own distances to the pivots are known, and so its score. Rows are kept in blocks of rows that are near
each other, with the least and greatest distance of a block to each pivot: a block whose brackets leave no score that is
wanted is passed over, of the others the rows that the distance to the block's own pivot allows are checked exactly.

The queries are a stated set, the anchors. They are taken in groups of bounded size, each against all blocks: first for
the best rows of the anchor's own label (its positives), then for the best of other labels in the range of scores that
each positive allows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import checkpoint, shared_folder

#: Positives of an anchor, negatives of a positive, and shares of a positive's score between which its negatives score.
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = (50, 100), (95, 100)
#: Pivots, and rows of the sample that they are chosen from.
PIVOTS, SAMPLE = 16, 2048
#: Rows of a block.
BLOCK = 512
#: Anchors that are searched for at a time, about, and whose scores a task holds at a time.
GROUP, STEP = 8192, 512
#: Above this scores are not exact in floating point.
MOST_SCORE = 1 << 52
#: Found rows that a task holds before it drops those that can't be among the best.
HELD = 1 << 18


def integer_vector(vector: Column | str, scale: int = 256) -> Column:
    """Each component x as floor(scale * x); null for a null vector or one with a null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end with zeros."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    flat = np.asarray(lists.flatten()).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of a sample, each as far as can be from those before it."""
    if not len(sample):
        return sample
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


@dataclass
class Pivots:
    """The pivots, as rows with the further component; the common squared length; components of a vector."""

    rows: np.ndarray
    length: float
    width: int

    def row_distances(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.length - (x * x).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.length - 2 * (x @ self.rows[:, :-1].T + np.outer(more, self.rows[:, -1])), 0))

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.length - 2 * q @ self.rows[:, :-1].T, 0))


class Best:
    """The best `count` of what was added for each of some slots: greatest scores, ties by smaller ids."""

    def __init__(self, slots: int, count: int, least: np.ndarray):
        self.count, self.slots = count, slots
        self.least = least.astype(np.float64)  # scores below can't be among a slot's best
        self.rows = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        self.added: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.added.append((slot, score, ids))
        self.waiting += len(slot)
        if self.waiting > HELD:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        slot, score, ids = (np.concatenate([r, *(a[k] for a in self.added)]) for k, r in enumerate(self.rows))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.searchsorted(slot, slot)
        nth = np.arange(len(slot)) - starts
        last = nth == self.count - 1
        self.least[slot[last]] = np.maximum(self.least[slot[last]], score[last])
        keep = nth < self.count
        self.rows, self.added, self.waiting = [slot[keep], score[keep], ids[keep]], [], 0
        return self.rows


@dataclass
class Block:
    """Near rows: their ids, labels and vectors, in the order of their distances to the block's own pivot; ranges of the distances to all pivots."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    own: int
    near: np.ndarray


_BLOCK_SCHEMA = "ids binary, labels binary, x binary, low binary, high binary, own int, near binary"


def _blocks_of(batches: Iterator[pa.RecordBatch], pivots: Pivots) -> Iterator[pa.RecordBatch]:
    """Sorted rows (`own`, `near`, `id`, `label`, `vec`, `far`) as packed blocks; one ends where the pivot changes."""
    held: pa.Table | None = None

    def packed(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        far = np.frombuffer(b"".join(rows["far"].to_pylist())).reshape(len(rows), -1)
        x = _matrix(rows["vec"].combine_chunks(), pivots.width)
        made = {"ids": np.asarray(rows["id"]), "labels": np.asarray(rows["label"]), "x": x, "low": far.min(0), "high": far.max(0), "near": np.asarray(rows["near"])}
        return pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()]) for k, v in made.items() if k != "near"} | {"own": pa.array([rows["own"][0].as_py()], pa.int32()), "near": pa.array([made["near"].tobytes()])})

    for batch in batches:
        held = pa.concat_tables([t for t in (held, pa.Table.from_batches([batch])) if t is not None])
        while len(held):
            own = np.asarray(held["own"])
            end = int(np.searchsorted(own, own[0], "right"))
            if end < BLOCK and end == len(held):
                break  # it may go on
            yield packed(held.slice(0, min(end, BLOCK)))
            held = held.slice(min(end, BLOCK))
    if held is not None and len(held):
        yield packed(held)


def _read_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            yield Block(ids, np.frombuffer(r["labels"], np.int64), np.frombuffer(r["x"]).reshape(len(ids), width), np.frombuffer(r["low"]), np.frombuffer(r["high"]), r["own"], np.frombuffer(r["near"]))


@dataclass
class Queries:
    """Anchors of a group: ids, labels, vectors, and their distances to the pivots."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    far: np.ndarray
    size: np.ndarray  # |q|^2 + M^2

    def brackets(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a row of the block can have with each anchor, a little widened for rounding."""
        least = np.maximum(np.maximum(self.far - block.high, block.low - self.far), 0).max(1)
        most = (self.far + block.high).min(1)
        slack = 1e-9 * self.size + 1
        return (self.size - most * most) / 2 - slack, (self.size - least * least) / 2 + slack

    def scores(self, block: Block, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, slice]:
        """Exact scores of anchors `at` with those rows of the block whose distance to its pivot allows a score of `wanted`."""
        far = self.far[at, block.own]
        reach = np.sqrt(np.maximum(self.size[at] - 2 * np.maximum(wanted, -self.size[at]), 0)) * (1 + 1e-9) + 1
        rows = slice(int(np.searchsorted(block.near, (far - reach).min())), int(np.searchsorted(block.near, (far + reach).max(), "right")))
        return self.q[at] @ block.x[rows].T, rows


def _positives(batches: Iterator[pa.RecordBatch], held: Queries, width: int, count: int) -> Iterator[pa.RecordBatch]:
    best = Best(len(held.ids), count, np.full(len(held.ids), -np.inf))
    for block in _read_blocks(batches, width):
        _, most = held.brackets(block)
        there = np.flatnonzero((most >= best.least) & np.isin(held.labels, block.labels))
        for i in range(0, len(there), STEP):
            at = there[i : i + STEP]
            score, rows = held.scores(block, at, best.least[at])
            fit = (score >= best.least[at, None]) & (block.labels[rows] == held.labels[at, None]) & (block.ids[rows] != held.ids[at, None])
            a, b = np.nonzero(fit)
            best.add(at[a], score[a, b], block.ids[rows][b])
        best.settle()
    slot, score, ids = best.settle()
    yield pa.RecordBatch.from_pydict({"slot": pa.array(slot), "score": pa.array(score.astype(np.int64)), "id": pa.array(ids)})


def _negatives(batches: Iterator[pa.RecordBatch], held: Queries, width: int, count: int, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """`low` and `high`: the range of scores for each anchor and place of a positive, empty where there is none."""
    places = low.shape[1]
    best = Best(low.size, count, low.ravel())
    for block in _read_blocks(batches, width):
        least, most = held.brackets(block)
        wanted = best.least.reshape(low.shape)
        open_ = wanted <= high
        low_end, high_end = np.where(open_, wanted, np.inf).min(1), np.where(open_, high, -np.inf).max(1)
        there = np.flatnonzero((most >= low_end) & (least <= high_end))
        for i in range(0, len(there), STEP):
            at = there[i : i + STEP]
            score, rows = held.scores(block, at, low_end[at])
            other = block.labels[rows] != held.labels[at, None]
            for place in range(places):
                a, b = np.nonzero(other & (score >= wanted[at, place, None]) & (score <= high[at, place, None]))
                best.add(at[a] * places + place, score[a, b], block.ids[rows][b])
        best.settle()
    slot, score, ids = best.settle()
    yield pa.RecordBatch.from_pydict({"slot": pa.array(slot), "score": pa.array(score.astype(np.int64)), "id": pa.array(ids)})


_FOUND = "slot long, score long, id long"


def _first(found: DataFrame, count: int) -> DataFrame:
    """The best of all tasks' best, with their `place` from 1."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def index(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """All `rows` (`id`, `label`, `vec`) in packed blocks."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = pivots.row_distances(_matrix(batch.column("vec"), pivots.width))
            own = far.argmin(1) if far.shape[1] else np.zeros(len(far), np.int64)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "label": batch.column("label"), "vec": batch.column("vec"), "own": pa.array(own.astype(np.int32)),
                "near": pa.array(far[np.arange(len(far)), own]), "far": pa.array([f.tobytes() for f in far], pa.binary()),
            })

    near = rows.mapInArrow(measured, "id long, label long, vec array<long>, own int, near double, far binary")
    # By ranges, so that rows of one vector, however many, are dealt out too.
    dealt = near.repartitionByRange("own", "near", "id").sortWithinPartitions("own", "near", "id")
    return checkpoint(dealt.mapInArrow(lambda batches: _blocks_of(batches, pivots), _BLOCK_SCHEMA))


def fit_pivots(rows: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> Pivots | None:
    """Pivots chosen from a sample of at most `sample` rows; None for an empty table."""
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    length, width = rows.agg(F.max(square), F.max(F.size("vec"))).first()
    if width is None:
        return None
    if length > MOST_SCORE:
        raise ValueError(f"vectors are too long for exact scores: squared length {length:.3g}")
    some = rows.select("vec", F.xxhash64("id", "vec").alias("h")).orderBy("h").limit(sample).toArrow()
    x = _matrix(some["vec"].combine_chunks(), width)
    longer = np.sqrt(np.maximum(length - (x * x).sum(1), 0))
    return Pivots(farthest_first(np.c_[x, longer], count), float(length), width)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH, group: int = GROUP
) -> DataFrame:
    """Negatives of each anchor and positive, from `rows` (`id` long, `label` long, `vec` array<long>).

    An anchor's positives are the `positives` best other rows of its label; a positive's negatives the `negatives` best
    rows of other labels whose scores are between the shares `low` and `high` of the positive's (none if that is
    negative). Greater scores come first, ties by smaller ids. Gives `anchor_id`, `positive_id`, `rank` (from 1),
    `negative_id`, `positive_score` and `negative_score`. Every row is indexed and every result exact.

    Rows with a null in any of the three columns, or in the vector, take no part. Shorter vectors count as ending with zeros. Of
    equal anchors one is mined; repeated rows count each as positives and negatives, but rows of the anchor's own id are
    never its positives. Other columns are ignored; empty tables and tables without anchors give empty results.
    Squared lengths must not exceed 2**52, as scores beyond are not exact: an error otherwise.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    clean = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<long>").alias("vec"), is_anchor.alias("anchor"))
    clean = checkpoint(clean.where("id is not null and label is not null and vec is not null and forall(vec, x -> x is not null)"))
    pivots = fit_pivots(clean)
    if pivots is None:
        return spark.createDataFrame([], schema)
    blocks = index(clean.select("id", "label", "vec"), pivots)
    anchors = clean.where("anchor").select("id", "label", "vec").distinct().withColumn("h", F.xxhash64("id", "label", "vec"))
    anchors = checkpoint(anchors)
    groups = -(-anchors.count() // group)
    folder, width, parts = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}", pivots.width, []
    for g in range(groups):
        # A group is a hash's share of the anchors: `group` of them, give or take.
        some = anchors.where(F.pmod("h", F.lit(groups)) == g).toArrow()
        q = _matrix(some["vec"].combine_chunks(), width) if len(some) else np.empty((0, width))
        held = Queries(np.asarray(some["id"]), np.asarray(some["label"]), q, pivots.query_distances(q), (q * q).sum(1) + pivots.length)
        shared = spark.sparkContext.broadcast(held)
        best = _first(blocks.mapInArrow(lambda b, s=shared: _positives(b, s.value, width, positives), _FOUND), positives).toArrow()
        slot, place = np.asarray(best["slot"]), np.asarray(best["place"]) - 1
        names, scores = (np.zeros((len(held.ids), positives), np.int64) for _ in range(2))
        names[slot, place], scores[slot, place] = np.asarray(best["id"]), np.asarray(best["score"])
        bottom, top = np.full(scores.shape, np.inf), np.full(scores.shape, -np.inf)
        known = scores[slot, place]
        bottom[slot, place], top[slot, place] = -(-low[0] * known // low[1]), high[0] * known // high[1]
        bottom[bottom > top] = np.inf
        found = _first(blocks.mapInArrow(lambda b, s=shared, x=bottom, y=top: _negatives(b, s.value, width, negatives, x, y), _FOUND), negatives)
        anchored = pa.table({"slot": np.arange(names.size), "anchor_id": np.repeat(held.ids, positives), "positive_id": names.ravel(), "positive_score": scores.ravel()})
        made = found.join(spark.createDataFrame(anchored), "slot")
        made = made.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        if groups == 1:
            return made
        parts.append(f"{folder}/{g}")
        made.write.parquet(parts[-1])
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def mined_embeddings(embeddings: DataFrame) -> DataFrame:
    """`hard_negatives` of `embeddings` (`vec_id`, `embedding`, `label`): the result of the registered query.

    Anchors are rows whose id is divisible by 50; labels of ids divisible by 7 are moved on by one, modulo 10.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), integer_vector("embedding").alias("vec"))
    return hard_negatives(rows, F.coalesce(F.col("id") % 50 == 0, F.lit(False)))
