"""N-gram Jaccard join with PartEnum signatures.

Sets of four-word shingles link at a Jaccard similarity of 0.85 or more. Equal sets are one node. Linked sets differ in
size by a bounded factor, so sets are put into bands of sizes, and a set also counts in the next band if it can link to
one there. Within a band of sets of at most `u` shingles linked sets differ in at most `k = 6u/37` of them. The domain
of shingle hashes is dealt into `k // 2 + 1` parts (and SPARE more) of three cells each: some part holds at most one of
the differences, so the sets agree on two of its three cells. Every pair of cells of every part is a signature; linked sets share one.

Sets that share signatures are compared in two ways, and each link that isn't implied by others is verified on the whole sets:

1. Stars: in each bucket of a signature all sets are compared with the first one.
2. In buckets that are still of several components sets of different components are compared, first by a
   lower bound of their distance (bits of parity), in tiles that different tasks take: at first as many pairs as may join
   the components, then, of what is still apart, all that the bound allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bounded, checkpoint, mix, over_texts, texts
from postmill.llm.components import connected_components
from postmill.llm.jaccard import node, shingles

SHINGLE = 4
#: The least similarity of a link, as a fraction.
LEAST = (85, 100)
#: Parts beyond the least number, so that a set with so many parts of empty cells can leave their signatures out.
SPARE = 1
#: Sets of fewer shingles are linked to equal ones alone.
LEAST_SIZE = LEAST[0] // (LEAST[1] - LEAST[0]) + 1
#: Rows of one bucket that a task compares with each other; larger buckets are tiled.
TILE = 2048
#: Bits of the filter of texts whose sets are compared; what passes it by chance falls in a join.
FILTER_BITS = 1 << 24
#: Most bits of parity; sets of more shingles are compared by these and then whole.
MOST_BITS = 1 << 16


def band(size: int) -> tuple[int, int, int]:
    """Number, least and greatest size of the band of `size`: each reaches over two steps of the similarity."""
    low, number = LEAST_SIZE, 0
    while True:
        high = low * LEAST[1] ** 2 // LEAST[0] ** 2
        if size <= high:
            return number, low, high
        low, number = high + 1, number + 1


@cache
def tags(size: int) -> list[tuple[int, int]]:
    """Bands (number, greatest size) in which a set of `size` may meet linked ones."""
    if size < LEAST_SIZE:
        return []
    number, _, high = band(size)
    _, above, top = band(high + 1)
    return [(number, high)] + [(number + 1, top)] * (LEAST[1] * size >= LEAST[0] * above)


def parts(high: int) -> int:
    """Parts of the domain for sets of at most `high` shingles: one has at most one of the differences, with SPARE to spare."""
    differences = (LEAST[1] - LEAST[0]) * 2 * high // (LEAST[0] + LEAST[1])
    return differences // 2 + 1 + SPARE


#: The pairs of a part's cells, first ones and second ones.
_ONE, _OTHER = [0, 0, 1], [1, 2, 2]


def signatures(found: np.ndarray) -> np.ndarray:
    """Keys of a set (sorted distinct hashes), for each band that it counts in.

    A pair of empty cells says nothing. A set that has them in at most SPARE parts leaves them out: one part without
    remains in which linked sets agree. Only sets with more keep them.
    """
    out = []
    mixed = mix(found, np.uint64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    for number, high in tags(len(found)):
        n = parts(high)
        cell = ((found >> np.uint64(32)) * np.uint64(3 * n)) >> np.uint64(32)
        sizes = np.bincount(cell.astype(np.int64), minlength=3 * n)
        ends = np.cumsum(sizes)
        content = (sums[ends] - sums[ends - sizes]).reshape(n, 3)
        empty = (sizes == 0).reshape(n, 3)
        part = np.arange(n, dtype=np.uint64) * np.uint64(4) + np.uint64(number << 40)
        none = empty[:, _ONE] & empty[:, _OTHER]
        keys = mix(mix(content[:, _ONE], content[:, _OTHER]), part[:, None] + np.arange(3, dtype=np.uint64))
        out.append(keys[~none] if none.any(1).sum() <= SPARE else keys.ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def parity(found: np.ndarray) -> bytes:
    """Whether each of some cells holds an odd number of a set's hashes, a bit each; the number of cells is a power of two."""
    bits = 64
    while bits < len(found) and bits < MOST_BITS:
        bits *= 2
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Lower bounds of the number of elements in which sets differ, by their parities (rows of words); wider ones are folded."""
    while one.shape[-1] > many.shape[-1]:
        one = one[..., : one.shape[-1] // 2] ^ one[..., one.shape[-1] // 2 :]
    while many.shape[-1] > one.shape[-1]:
        many = many[..., : many.shape[-1] // 2] ^ many[..., many.shape[-1] // 2 :]
    return np.bitwise_count(one ^ many).sum(-1, dtype=np.int64)


def most_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many elements linked sets of sizes `a` and `b` may differ; below zero if their sizes forbid a link."""
    allowed = (LEAST[1] - LEAST[0]) * (a + b) // (LEAST[0] + LEAST[1])
    return np.where(LEAST[1] * np.minimum(a, b) >= LEAST[0] * np.maximum(a, b), allowed, -1)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`bucket`, `first` and `fp` of keys that several rows of a sorted partition have.

    A bucket of up to TILE rows is named by its members, so that of keys with the same ones a task tells one; in a
    larger one rows pass in steps, each with the first of all.
    """
    seen: set[int] = set()
    kind = {c: pa.int64() for c in ("bucket", "first", "fp")}
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 2
    going: tuple[int, int] | None = None  # key and first row of a large bucket that is not at its end

    def out(keys: np.ndarray, fps: np.ndarray, closed: bool) -> tuple[list[np.ndarray], int]:
        """Rows of buckets, and how many rows are done with."""
        nonlocal going
        made, starts = [], np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        ends = np.r_[starts[1:], len(keys)]
        done = 0
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            at_end = e < len(keys) or closed
            key, run = int(keys[s]), fps[s:e]
            if going and going[0] == key:
                made.append(np.stack([np.full(e - s, key), np.full(e - s, going[1]), run]))
                done = e
            elif not at_end and e - s <= TILE:
                return made, s
            elif e - s > TILE:
                going = (key, int(run[0]))
                made.append(np.stack([np.full(e - s, key), np.full(e - s, run[0]), run]))
                done = e
            else:
                done = e
                if e - s > 1:
                    bucket = int(mix(run.view(np.uint64), np.uint64(7)).sum(dtype=np.uint64).astype(np.int64))
                    if bucket not in seen:
                        seen.add(bucket)
                        made.append(np.stack([np.full(e - s, bucket), np.full(e - s, run[0]), run]))
            if at_end and going and going[0] == key:
                going = None
        return made, done

    def batch_of(made: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array(x, kind[c]) for c, x in zip(kind, np.concatenate(made, 1), strict=True)})

    for batch in batches:
        held = [np.concatenate([h, np.asarray(batch.column(c))]) for h, c in zip(held, ("key", "fp"), strict=True)]
        # Copies of one text that different tasks read.
        once = np.r_[True, (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])][: len(held[0])]
        held = [h[once] for h in held]
        made, done = out(*held, False)
        held = [h[done:] for h in held]
        if len(seen) > 1 << 20:
            seen.clear()
        if made:
            yield batch_of(made)
    made, _ = out(*held, True)
    if made:
        yield batch_of(made)


def signature_rows(docs: DataFrame) -> DataFrame:
    """`key` and `fp`: the signatures of each distinct set; texts that several tasks read give theirs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in bounded(batches):
            keys, fps = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for text, content in zip(texts(batch), batch.column("content").to_pylist(), strict=True):
                if content not in seen:
                    seen.add(content)
                    found = shingles(text, SHINGLE)
                    keys.append(signatures(found))
                    fps.append(np.full(len(keys[-1]), node(found), np.int64))
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys).view(np.int64)), "fp": pa.array(np.concatenate(fps))})

    return docs.select(F.xxhash64("text").alias("content"), "text").mapInArrow(run, "key long, fp long")


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
            found = [shingles(t, SHINGLE) for t in texts(batch.take(pa.array(new, pa.int64())))]
            yield pa.RecordBatch.from_pydict({"fp": pa.array(np.array([node(x) for x in found], np.int64)), "found": pa.array([x.tobytes() for x in found], pa.binary())})

    return docs.select(F.xxhash64("text").alias("content"), "text").mapInArrow(run, "fp long, found binary").dropDuplicates(["fp"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities allow a link."""
    for batch in batches:
        sides = zip(*(batch.column(c).to_pylist() for c in ("pa", "pb")), strict=True)
        bound = np.fromiter((least_distances(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sides), np.int64, batch.num_rows)
        keep = bound <= most_distance(np.asarray(batch.column("sa")), np.asarray(batch.column("sb")))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar enough; the two rows of a pair follow each other in a partition, over batches too."""
    before: tuple[int, int, np.ndarray] | None = None
    for batch in batches:
        a, b = [], []
        for x, y, found in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("found"), strict=True):
            one = np.frombuffer(found.as_buffer(), np.uint64)
            if before and before[:2] == (x, y):
                two = before[2]
                at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                common = int((two[at] == one).sum())
                if LEAST[1] * common >= LEAST[0] * (len(one) + len(two) - common):
                    a.append(x)
                    b.append(y)
                before = None
            else:
                before = (x, y, one)
        if before:
            before = (*before[:2], before[2].copy())
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of distinct `pairs` (`a`, `b`) that are links: by parities, then by their whole sets."""
    side = lambda x: nodes.select(F.col("fp").alias(x), F.col("size").alias("s" + x), F.col("parity").alias("p" + x))
    close = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "pa", "pb").mapInArrow(_close, "a long, b long")
    close = checkpoint(close)
    ends = close.select(F.explode(F.array("a", "b")).alias("fp"), "a", "b")
    sets = _sets(docs, ends.select("fp").distinct().join(nodes.select("fp", "content"), "fp"))
    both = ends.join(sets, "fp").select("a", "b", "found").repartition("a", "b").sortWithinPartitions("a", "b")
    return both.mapInArrow(_verified, "a long, b long")


def _across(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket's rows of different components that sizes and parities allow; runs go on over batches.

    Unless all of them are asked for (`whole`), only as many as would join the components if all were links: of a row's
    pairs with a component the one that parities say is nearest.
    """
    names = ("key", "fp", "comp", "size", "side", "parity")

    def out(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        fp, comp, size, side = (np.array(rows[c], np.int64) for c in ("fp", "comp", "size", "side"))
        widths = np.array([len(p) for p in rows["parity"]])
        tables = [(np.flatnonzero(widths == w), np.frombuffer(b"".join(p for p in rows["parity"] if len(p) == w), np.uint64).reshape(-1, w // 8)) for w in set(widths.tolist())]
        a, b = [], []
        for i in range(len(fp) - 1):
            one = np.frombuffer(rows["parity"][i], np.uint64)
            near, far = [], []
            for at, table in tables:
                ok = (at > i) & (comp[at] != comp[i]) & ((side[at] < 0) | (side[at] != side[i]))
                if ok.any():
                    spare = most_distance(size[at[ok]], size[i]) - least_distances(one, table[ok])
                    near.append(at[ok][spare >= 0])
                    far.append(spare[spare >= 0])
            if not near:
                continue
            found, spare = np.concatenate(near), np.concatenate(far)
            if not whole:
                chosen = []
                while len(found):
                    j = int(found[spare.argmax()])
                    chosen.append(j)
                    comp[comp == comp[j]] = comp[i]
                    left = comp[found] != comp[i]
                    found, spare = found[left], spare[left]
                found = np.array(chosen, np.int64)
            b.append(fp[found])
            a.append(np.full(len(found), fp[i]))
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    key, held = None, {c: [] for c in names}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[0] != key and held["fp"]:
                yield from out(held)
                held = {c: [] for c in names}
            key = row[0]
            for c, v in zip(names, row, strict=True):
                held[c].append(v)
    if held["fp"]:
        yield from out(held)


def _tiled(rows: DataFrame, tile: int) -> DataFrame:
    """Rows (`bucket`, `fp`, `comp`) with `key` and `side`: those of a bucket meet, in tiles of about `tile` rows if they are more."""
    sizes = rows.groupBy("bucket").count().where(F.col("count") > tile)
    sizes = sizes.select("bucket", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    own = rows.join(sizes, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = own.withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda t: F.struct(F.xxhash64("bucket", F.least(t, "tile"), F.greatest(t, "tile")).alias("key"), F.when(t == F.col("tile"), -1).otherwise((t < F.col("tile")).cast("int")).alias("side")),
    )
    return own.select("fp", "comp", F.explode(others).alias("o")).select("fp", "comp", "o.key", "o.side")


def _pairs_left(members: DataFrame, comps: DataFrame, nodes: DataFrame, tried: DataFrame, whole: bool, tile: int) -> DataFrame:
    """Untried pairs (`a`, `b`) of sets that share a bucket and are of different components (`fp`, `comp`), as `_across` tells them."""
    named = checkpoint(members.select("bucket", "fp").join(comps, "fp", "left").select("bucket", "fp", F.coalesce("comp", "fp").alias("comp")))
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    left = _tiled(named.join(mixed, "bucket"), tile).join(nodes.select("fp", "size", "parity"), "fp")
    dealt = left.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp", "comp", "size", "side", "parity")
    return checkpoint(dealt.mapInArrow(lambda batches: _across(batches, whole), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"))


def _hops(found: DataFrame) -> DataFrame:
    """`comp` of each linked `fp`: the least that two links lead to. Not always one for a component, which costs comparisons, but loses none."""
    both = found.select(F.col("a").alias("fp"), F.col("b").alias("m")).union(found.select("b", "a"))
    least = checkpoint(both.groupBy("fp").agg(F.least(F.min("m"), "fp").alias("comp")))
    second = least.select(F.col("fp").alias("comp"), F.col("comp").alias("next"))
    return least.join(second, "comp").select("fp", F.col("next").alias("comp"))


def _rooted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """`fp` and `root` (the least of its component, by ids) of each node."""
    named = nodes.select("fp", F.struct(F.col("first").isNull().alias("none"), "first", "fp").alias("node"))
    ends = found.join(named.withColumnsRenamed({"fp": "a", "node": "x"}), "a").join(named.withColumnsRenamed({"fp": "b", "node": "y"}), "b")
    roots = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "of")
    return named.join(roots, F.col("node") == F.col("of"), "left").select("fp", F.coalesce("root", "node").alias("root"))


def components(docs: DataFrame, nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """`fp` and `component_id`, the smallest `first` of what is linked, of each of `nodes`, the distinct sets of `docs`."""
    keyed = signature_rows(docs).repartition("key").sortWithinPartitions("key", "fp")
    members = checkpoint(keyed.mapInArrow(_members, "bucket long, first long, fp long").distinct())
    stars = members.where("first <> fp").select(F.least("first", "fp").alias("a"), F.greatest("first", "fp").alias("b")).distinct()
    found = checkpoint(verified(stars, nodes, docs))
    likely = _pairs_left(members, _hops(found), nodes, stars, False, tile)
    rooted = checkpoint(_rooted(nodes, found.union(verified(likely, nodes, docs))))
    rest = _pairs_left(members, rooted.select("fp", F.col("root.fp").alias("comp")), nodes, stars.union(likely), True, tile)
    more = checkpoint(verified(rest, nodes, docs))
    ends = more.join(rooted.withColumnsRenamed({"fp": "a", "root": "x"}), "a").join(rooted.withColumnsRenamed({"fp": "b", "root": "y"}), "b")
    if more.isEmpty():
        return rooted.select("fp", F.col("root.first").alias("component_id"))
    # Components are joined, as nodes of their own.
    joined = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return rooted.join(joined, "root", "left").select("fp", F.coalesce("last", "root")["first"].alias("component_id"))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", tile: int = TILE) -> DataFrame:
    """`id_col`, `n_shingles` and `component_id` (the smallest `id_col` reachable by links) of each row of `docs`.

    Null and empty texts, and those without words, have empty sets and are linked with nothing, not with each other
    either. Texts of fewer words than a shingle have one shingle of all their words. Sets are compared by 64-bit hashes
    of their shingles. Repeated rows each give a row; a null id gives a row, but is never the smallest unless alone; an
    empty table gives an empty result. Other columns are ignored.
    """

    def step(batch: list[bytes | None]) -> dict:
        found = [shingles(t, SHINGLE) for t in batch]
        return {
            "fp": pa.array(np.array([node(x) for x in found], np.int64)), "size": pa.array(np.array([len(x) for x in found], np.int64)), "parity": pa.array([parity(x) for x in found], pa.binary())
        }

    named = docs.select(id_col, "text", F.xxhash64("text").alias("content"))
    prints = checkpoint(over_texts(named, [id_col, "content"], "fp long, size long, parity binary", step))
    nodes = prints.where("size > 0").groupBy("fp").agg(F.min(id_col).alias("first"), F.min("content").alias("content"), F.max("size").alias("size"), F.max("parity").alias("parity"))
    nodes = checkpoint(nodes)
    roots = components(docs, nodes, tile).withColumnRenamed("component_id", "root")
    return prints.join(roots, "fp", "left").select(id_col, F.col("size").alias("n_shingles"), F.coalesce("root", id_col).alias("component_id"))
