"""Near copies by the Jaccard similarity of word shingles: MinHash bands find pairs, exact sets decide.

Texts whose sets of five-word shingles have a similarity of 0.8 or more are linked. Signatures of
BANDS x ROWS minima meet in the bucket of each band that agrees: 99.9 % of pairs at 0.8 do, and more above.
Texts of equal sets are one node from the start, and buckets of equal members are compared once. Within a
bucket a spanning forest of exactly verified links is emitted; large buckets are tiled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bounded, checkpoint, lower_words, mix, over_texts, texts, window_hashes
from postmill.llm.components import named_components

SHINGLE, SEED = 5, 42
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 14, 4
#: Sets of one bucket that a task compares with each other; larger buckets are tiled.
TILE = 2048
#: Bits of the filter of texts whose sets are compared; what passes it by chance falls in a join.
FILTER_BITS = 1 << 24
#: Shingles whose minima are taken at a time.
CHUNK = 4096

_A, _B = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `length` words; of all words if there are fewer, none without words."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < length:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    # Words are hashed once each, and runs from the hashes of their words.
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(window_hashes(hashed, length))


def bands(found: np.ndarray) -> np.ndarray:
    """The key of each band of a set; none for an empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    parts = [(found[i : i + CHUNK, None] * _A + _B).min(0) for i in range(0, len(found), CHUNK)]
    least = np.minimum.reduce(parts).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.T:
        key = mix(key, row)
    return key.view(np.int64)


def tiled(keyed: DataFrame, tile: int) -> DataFrame:
    """`fp`, `key` and `side`: rows of equal `key` meet, those of very common keys in tiles of about `tile` rows."""
    sizes = keyed.groupBy("key").count().where(F.col("count") > tile)
    sizes = checkpoint(sizes.select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    if sizes.isEmpty():
        return keyed.select("fp", F.xxhash64("key").alias("key"), F.lit(-1).alias("side"))
    # A tile meets itself (side -1) and every other tile (sides 0 and 1) in a key of its own.
    own = keyed.join(sizes, "key", "left").withColumn("tile", F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1),
        lambda t: F.struct(
            F.xxhash64("key", F.least(t, "tile"), F.greatest(t, "tile")).alias("key"),
            F.when(t == F.col("tile"), -1).otherwise((t < F.col("tile")).cast("int")).alias("side"),
        ),
    )
    return own.select("fp", F.explode(others).alias("o")).select("fp", "o.key", "o.side")


def forest(sets: list[np.ndarray], sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of similarity LEAST or more, as many as join what is linked; with `sides`, only across the two.

    Breadth first: each set reached is compared with all that are not, so that a bucket of near
    copies takes one comparison a set.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x = reached.pop()
            fit = LEAST[1] * np.minimum(sizes[left], sizes[x]) >= LEAST[0] * np.maximum(sizes[left], sizes[x])
            if sides is not None:
                fit &= sides[left] != sides[x]
            near = left[fit]
            if not len(near):
                continue
            flat = np.concatenate([sets[i] for i in near])
            at = np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)
            common = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            close = near[LEAST[1] * common >= LEAST[0] * (sizes[near] + sizes[x] - common)]
            out += [(x, i) for i in close.tolist()]
            reached += close.tolist()
            left = left[~np.isin(left, close)]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by key; a run goes on over batches."""
    key, fps, sets, sides = None, [], [], []

    def out() -> tuple[list[int], list[int]]:
        found = forest(sets, None if sides[0] < 0 else np.array(sides)) if len(fps) > 1 else []
        return [min(fps[a], fps[b]) for a, b in found], [max(fps[a], fps[b]) for a, b in found]

    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for k, fp, side, found in zip(*(batch.column(c).to_pylist() for c in ("key", "fp", "side", "found")), strict=True):
            if k != key and fps:
                for to, more in zip((a, b), out(), strict=True):
                    to += more
                fps, sets, sides = [], [], []
            key = k
            fps.append(fp)
            sides.append(side)
            sets.append(np.frombuffer(found, np.uint64))
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    if fps:
        a, b = out()
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """`fp` and `found` (the set's hashes) of the texts whose `content` is needed, and of a few others."""
    cell = F.pmod("content", F.lit(FILTER_BITS))
    words = needed.select(cell.alias("c")).select(F.shiftright("c", 6).alias("w"), F.expr("shiftleft(1L, cast(c & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[np.asarray(got["w"])] = np.asarray(got["b"])
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = shared.value, set()
        for batch in bounded(batches):
            content = np.asarray(batch.column("content"))
            at = content % FILTER_BITS
            hit = np.flatnonzero((held[at >> 6] >> (at & 63)) & 1)
            new = [i for i, c in zip(hit.tolist(), content[hit].tolist(), strict=True) if not (c in seen or seen.add(c))]
            found = [shingles(t) for t in texts(batch.take(pa.array(new, pa.int64())))]
            prints = np.array([node(x) for x in found], np.int64)
            yield pa.RecordBatch.from_pydict({"fp": pa.array(prints), "found": pa.array([x.tobytes() for x in found], pa.binary())})

    return docs.select(F.xxhash64("text").alias("content"), "text").mapInArrow(run, "fp long, found binary").dropDuplicates(["fp"])


def node(found: np.ndarray) -> int:
    """The name of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar enough."""
    for batch in batches:
        sets = zip(*(batch.column(c).to_pylist() for c in ("x", "y")), strict=True)
        close = [bool(forest([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])) for x, y in sets]
        yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))


def _verified(likely: DataFrame, prints: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (`a`, `b`) among `likely` pairs of texts (`x`, `y`, their `content`), by their exact sets."""
    named = prints.select("content", "fp").distinct()
    ends = likely.join(named.withColumnsRenamed({"content": "x", "fp": "p"}), "x").join(named.withColumnsRenamed({"content": "y", "fp": "q"}), "y").where("p <> q")
    pairs = checkpoint(ends.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min("x").alias("x"), F.min("y").alias("y")))
    sets = checkpoint(_sets(docs, pairs.select(F.explode(F.array("x", "y")).alias("content"))))
    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"fp": "a", "found": "x"}), "a").join(sets.withColumnsRenamed({"fp": "b", "found": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", tile: int = TILE, likely: DataFrame | None = None) -> DataFrame:
    """`id_col` and `component_id` (the smallest `id_col` of what is linked, directly or through others) of each row.

    Texts without words are near copies of each other; repeated rows each give a row; a null id is
    never the smallest unless alone. `likely` are pairs of texts (`x`, `y`: `xxhash64` of each) found otherwise, whose
    exact sets decide too.
    """

    def step(batch: list[bytes | None]) -> dict:
        found = [shingles(t) for t in batch]
        return {"fp": pa.array(np.array([node(x) for x in found], np.int64)), "bands": pa.array([bands(x) for x in found], pa.list_(pa.int64()))}

    named = docs.select(id_col, "text", F.xxhash64("text").alias("content"))
    prints = checkpoint(over_texts(named, [id_col, "content"], "fp long, bands array<long>", step))
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.min("content").alias("content"), F.min("bands").alias("bands"))
    nodes = checkpoint(nodes)
    keyed = nodes.select("fp", "content", F.explode("bands").alias("key"))
    same = (F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"), F.count("*").alias("n"))
    buckets = keyed.groupBy("key").agg(*same).where("n > 1").groupBy("x", "y", "n").agg(F.min("key").alias("key"))
    meet = checkpoint(keyed.join(buckets.select("key"), "key").select("fp", "content", "key"))
    sets = _sets(docs, meet.select("content"))
    dealt = tiled(meet.select("fp", "key"), tile).join(sets, "fp").repartition("key").sortWithinPartitions("key", "fp")
    links = checkpoint(dealt.select("fp", "key", "side", "found").mapInArrow(_links, "a long, b long").distinct())
    if likely is not None:
        links = checkpoint(links.union(_verified(likely, prints, docs)).distinct())
    return prints.select(id_col, "fp").join(named_components(nodes, links), "fp").select(id_col, "component_id")
