"""SimHash near-duplicate detection with pigeonhole blocks.

Fingerprints of 64 bits that differ in at most 4 bits agree on at least 3 of 7 blocks, so
every close pair meets under one of the 35 keys made of 3 blocks (27 or 28 bits each). Keys
of that width leave few pairs by chance, so that the work follows the number of texts.

Equal fingerprints are one node from the start. Within a key only a spanning forest of the
verified links is emitted, never all pairs; keys with very many fingerprints are compared in
tiles that different tasks take.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import checkpoint, lower_words, over_texts
from postmill.llm.components import named_components
from postmill.llm.jaccard import near_copies, tiled

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Bits of the seven blocks, from the lowest.
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
#: Fingerprints of one key that a task compares with each other; larger keys are tiled.
TILE = 2048

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text; zero if it has no words.

    A bit is 1 if it is set in over half of the XXH64 hashes of the shingles, repeats included.
    """
    words = lower_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    lanes = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(ones.ravel() * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`id_col` and `fp` (the fingerprint's 64 bits as a long) of each row."""

    def step(batch: list[bytes | None]) -> dict:
        return {"fp": pa.array(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))}

    return over_texts(docs, [id_col], "fp long", step)


def _keys(fp: str) -> F.Column:
    """The 35 keys of a fingerprint: three whole blocks and which they are."""
    starts = np.cumsum([0, *BLOCKS])
    blocks = [F.shiftrightunsigned(fp, int(s)).bitwiseAND(F.lit((1 << b) - 1)) for s, b in zip(starts, BLOCKS, strict=False)]
    keys = []
    for k, (i, j, m) in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE)):
        joined = F.shiftleft(blocks[i], 20).bitwiseOR(F.shiftleft(blocks[j], 10)).bitwiseOR(blocks[m])
        keys.append(joined.bitwiseOR(F.lit(k << 32)))
    return F.array(*keys)


def _forest(fps: np.ndarray, runs: np.ndarray, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal `runs`, as many as join what is linked.

    Compares neighbours at distance 1, 2, ... while any run is that long, so that all short
    runs of a batch go together. With `sides`, a run compares only across its two sides.
    """
    a, b = [], []
    for step in range(1, len(fps)):
        same = np.flatnonzero(runs[step:] == runs[:-step])
        if not len(same):
            break
        close = np.bitwise_count(fps[same] ^ fps[same + step]) <= DISTANCE
        if sides is not None:
            close &= sides[same] != sides[same + step]
        a.append(same[close])
        b.append(same[close] + step)
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return a[kept], b[kept]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by key; a run goes on over batches."""
    held: list[np.ndarray] | None = None

    def out(fps: np.ndarray, keys: np.ndarray, sides: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in (sides < 0, sides >= 0):
            if part.any():
                f, k = fps[part], keys[part]
                a, b = _forest(f.view(np.uint64), k, None if sides[part][0] < 0 else sides[part])
                yield pa.RecordBatch.from_pydict({"a": np.minimum(f[a], f[b]), "b": np.maximum(f[a], f[b])})

    for batch in batches:
        now = [np.asarray(batch.column(c)) for c in ("fp", "key", "side")]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = int(np.searchsorted(held[1], held[1][-1])) if len(held[1]) else 0
        if last:
            yield from out(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield from out(*held)


def links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (`a`, `b`) that join all distinct `fp` of at most 4 differing bits.

    Every pair that is linked is connected through the rows returned; pairs that others
    connect are left out.
    """
    keyed = fps.select("fp", F.explode(_keys("fp")).alias("key"))
    dealt = tiled(keyed, tile).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`id_col`, `fingerprint` (16 hex digits) and `component_id` of each row of `docs`.

    A component holds the rows whose fingerprints are linked, directly or through others; its
    id is its smallest `id_col`. Null and empty texts have the fingerprint zero and are linked
    like any other; repeated rows each give a row; a null id gives a row, but is never the
    smallest unless alone; an empty table gives an empty result. Other columns are ignored.
    """
    fps = checkpoint(fingerprints(docs, id_col))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min(id_col).alias("first")))
    named = named_components(nodes, links(nodes.select("fp")))
    return fps.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def likely_copies(docs: DataFrame) -> DataFrame:
    """Pairs (`x`, `y`: `xxhash64` of two texts) that join all texts of linked fingerprints: a forest of links, and a star for each fingerprint."""
    fps = checkpoint(fingerprints(docs.select(F.xxhash64("text").alias("content"), "text"), "content").distinct())
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("content").alias("first")))
    first = lambda fp, to: nodes.select(F.col("fp").alias(fp), F.col("first").alias(to))
    across = links(nodes.select("fp")).join(first("a", "x"), "a").join(first("b", "y"), "b").select("x", "y")
    return across.union(fps.join(nodes, "fp").where("content <> first").select("first", "content"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each group of near copies: the one of the smallest id; the same columns.

    The query's blocks find texts whose fingerprints differ in at most 4 bits, and exact sets of five-word shingles decide
    which of them are copies: those that share 0.8 or more. Copies whose fingerprints differ in more bits are added by `near_copies`. Texts
    without words are copies of each other. Rows without id come after all others; of rows with equal id and text
    one stays; an empty table gives an empty one. Texts move once, to meet the keys that stay.
    """
    key, content = (f"_{x}" + "_" * max(map(len, docs.columns), default=0) for x in ("key", "content"))
    text = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1))
    named = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text.alias("content")).alias("key"), "text")
    kept = near_copies(named, "key", likely=likely_copies(docs)).where("key = component_id").select(F.xxhash64("key.id").alias(key), F.col("key.content").alias(content)).distinct()
    found = docs.withColumn(key, F.xxhash64(id_col)).withColumn(content, text).join(kept, [key, content], "left_semi")
    once = Window.partitionBy(key, content).orderBy(content)
    nth = key + "_"
    return found.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).select(*docs.columns)
