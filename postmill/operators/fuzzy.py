"""Removal of postings whose titles share telling words, decided as if by one pass in order.

Two postings are alike if the tokens of the earlier one (repeats included) that the later one has
come to ten characters or more. In order of place, a posting that is still there removes all alike
later ones, except that one without URL yields to the first alike one with URL. That pass is a greedy
choice, not a grouping, and is decided here in parts:

1. Postings with URL: one stays unless an earlier one that stays is alike.
2. One without URL yields to the first alike later posting with URL that no earlier kept one removes.
3. One without URL is removed by an alike earlier one with URL that stays, or by one without URL that is
   not itself removed and does not yield before it.

1 and 3 are greedy choices: postings are compared with those that stay, not with each other. Blocks in order are each decided by
one task, and what stays of a block is broadcast and removes alike ones from all that is left (`first_removers`). If a block
removes next to none, halves are decided instead (`active`): what stays of the earlier half removes alike ones from the later half
by joins on tokens, before that is looked at; rows with few likely pairs are decided in rounds over these pairs. Alike pairs are never written
out for a group of alike titles: a group leaves one posting in the first part that has any of it, and that removes the rest.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import title_tokens, units
from postmill.operators.dedup import ORDER, has_url
from postmill.operators.tables import checkpoint

ALIKE_LENGTH = 10
#: Rows that one task decides in order; pairs for each row up to which more rows are decided in rounds, all at once.
LEAF, PAIRS = 4096, 32
#: Postings with one token that meet in one place; those of a more common token are dealt by salt.
SALT = 8192
#: A block's rows, in leaves; the part by which each block has to lessen what is left; blocks of rows that yield at most; rows a task.
BLOCK, SHARE, BLOCKS, ROWS = 2, 32, 16, 8192
#: Titles of a block of `alike_pairs`; pairs that a task gives out at once, or a title's if it has more.
TILE, GIVEN = 32768, 1 << 16


def alike_pairs(tokens: DataFrame, least: int = ALIKE_LENGTH, tile: int = TILE) -> DataFrame:
    """Pairs `i`, `j` (places, i before j) and `overlap`, from `place` and `tokens`.

    Titles are dealt into blocks of about `tile` by ranges of places, and each two blocks meet in one row of a join. A title is shuffled once
    for each block and pairs never are; a task holds two blocks and a batch of pairs, however many are alike.
    """
    known = checkpoint(tokens.where("place is not null and size(tokens) > 0").groupBy("place").agg(F.flatten(F.collect_list("tokens")).alias("tokens")))  # titles of one place
    count, parts = known.count(), int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few bytes but much work for each two blocks: at least as many as the session shuffles to, however few the titles.
    ends = max(-(-count // tile), isqrt(2 * parts), 2)
    bounds = sorted(set(known.agg(F.percentile_approx("place", [k / ends for k in range(1, ends)])).first()[0] or [0]))
    own = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda bound: bound < F.col("place")))
    blocks = known.groupBy(own.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "tokens"))).alias("titles"))  # about `tile` of a group
    blocks, tiles = checkpoint(blocks), max(parts, (len(bounds) + 1) * (len(bounds) + 2) // 2)
    earlier = blocks.select(F.col("block").alias("a"), F.explode(F.sequence("block", F.lit(len(bounds)))).alias("b"), F.col("titles").alias("earlier"))
    later = blocks.select(F.explode(F.sequence(F.lit(0), "block")).alias("a"), F.col("block").alias("b"), F.col("titles").alias("later"))
    met = earlier.repartition(tiles, "a", "b").hint("merge").join(later.repartition(tiles, "a", "b"), ["a", "b"])
    return met.select("earlier", "later", (F.col("a") == F.col("b")).alias("same")).mapInArrow(lambda batches: _pairs(batches, least), "i long, j long, overlap long")


def _pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Alike pairs of blocks (`earlier`, `later`: titles in order, `same`: one block twice)."""
    for batch in batches:
        for earlier, later, same in zip(*map(batch.column, ("earlier", "later", "same")), strict=True):
            yield from _block_pairs(earlier.values, later.values, same.as_py(), least)


def _block_pairs(earlier: pa.StructArray, later: pa.StructArray, same: bool, least: int) -> Iterator[pa.RecordBatch]:
    """Alike pairs of two blocks of titles: for each earlier one, the lists of later ones that have its tokens are counted."""
    sides = [earlier] if same else [earlier, later]
    early, first = len(earlier), 0 if same else len(earlier)
    places = np.concatenate([side.field("place").to_numpy() for side in sides])
    sizes = np.concatenate([side.field("tokens").value_lengths().to_numpy() for side in sides])
    words = pa.concat_arrays([side.field("tokens").flatten() for side in sides]).dictionary_encode()
    length = np.array([len(t.encode("utf-16-le")) // 2 for t in words.dictionary.to_pylist()], np.int64)
    held, times = np.unique(np.repeat(np.arange(len(places)), sizes) * len(length) + words.indices.to_numpy(), return_counts=True)
    title, token = np.divmod(held, len(length))
    weight = (times * length[token]).astype(np.float64)
    # The later ones that have a token, in order; and each title's tokens.
    by_token = np.argsort(token[title >= first], kind="stable")
    lists = (title[title >= first] - first)[by_token]
    start = np.searchsorted(token[title >= first][by_token], np.arange(len(length) + 1))
    begin = np.searchsorted(title, np.arange(early + 1)).tolist()
    found, count = [], 0
    for k in range(early):
        own = slice(begin[k], begin[k + 1])
        low, high = start[token[own]], start[token[own] + 1]
        met = np.concatenate([lists[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)])
        overlap = np.bincount(met, np.repeat(weight[own], high - low), len(places) - first)
        alike = np.flatnonzero(overlap >= max(least, 1))
        if same:
            alike = alike[alike > k]
        found.append((np.full(len(alike), places[k]), places[first + alike], overlap[alike].astype(np.int64)))
        count += len(alike)
        if count >= GIVEN or k == early - 1:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], ["i", "j", "overlap"])
            found, count = [], 0


def _known(words: DataFrame) -> DataFrame:
    """`words` (`place`, `t`, and `w`, its weight in the title) with the `count` of titles that have the token, and `rest`, the weight of it and of all that are more common."""
    common = words.groupBy("t").count()
    rare_first = Window.partitionBy("place").orderBy(F.col("count").desc(), "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return words.join(common, "t").withColumn("rest", F.sum("w").over(rare_first))


def _overlap(earlier: str, later: str) -> Column:
    """Characters of the earlier one's tokens, repeats included, that the later one has."""
    length = lambda tokens: F.aggregate(tokens, F.lit(0), lambda n, t: n + units(t))
    return length(F.filter(earlier, lambda t: F.array_contains(later, t))).cast("long")


@dataclass(frozen=True)
class Titles:
    """Postings as they are compared: `leads` (`i`, `t`, `salt`: each salt of a token, `ti`: all tokens) are tokens by which an earlier posting is
    found, `words` (`j`, `t`, `salt`, `tj`) all tokens of a later one; a pair that is alike meets in one of them."""

    leads: DataFrame
    words: DataFrame
    least: int

    @classmethod
    def of(cls, rows: DataFrame, least: int) -> Titles:
        """From `place` and `tokens`, each with tokens."""
        words = rows.select("place", F.explode("tokens").alias("t")).groupBy("place", "t").agg((F.count("*") * units(F.col("t"))).alias("w"))
        known = _known(words).withColumn("salts", F.ceil(F.col("count") / SALT).cast("int")).join(rows, "place")
        known = checkpoint(known.select("place", "t", "salts", "rest", "tokens"))
        leads = known.where(F.col("rest") >= least).select(F.col("place").alias("i"), "t", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("tokens").alias("ti"))
        held = known.select(F.col("place").alias("j"), "t", F.pmod(F.xxhash64("place"), "salts").cast("int").alias("salt"), F.col("tokens").alias("tj"))
        return cls(leads, held, least)

    def alike(self, earlier: DataFrame, later: DataFrame, where: str = "true") -> DataFrame:
        """Alike pairs `i`, `j` of `earlier` (`i` and more) and `later` (`j` and more) with these columns; one may come twice. `where` is looked at before titles are."""
        met = self.leads.join(earlier, "i").join(self.words.join(later, "j"), ["t", "salt"]).where("i < j").where(where)
        return met.where(_overlap("ti", "tj") >= self.least).drop("t", "salt", "ti", "tj")

    def likely(self, nodes: DataFrame) -> int:
        """How many pairs of `nodes` (`n`) meet in tokens."""
        first = self.leads.where("salt = 0").join(nodes.withColumnRenamed("n", "i"), "i").groupBy("t").count()
        second = self.words.join(nodes.withColumnRenamed("n", "j"), "j").groupBy("t").agg(F.count("*").alias("more"))
        return first.join(second, "t").agg(F.coalesce(F.sum(F.col("count") * F.col("more")), F.lit(0))).first()[0]


class Earlier:
    """Postings in order, by which alike later ones are found: `add` and `alike` need no others than those of one block."""

    def __init__(self, least: int, titles: list[list[str]]):
        self.least, self.common = least, Counter(t for tokens in titles for t in set(tokens))
        self.places: list[int] = []
        self.bounds: list[int | None] = []
        self.weights: list[dict[str, int]] = []
        self.leads: dict[str, list[int]] = defaultdict(list)

    def add(self, n: int, to: int | None, tokens: list[str]) -> None:
        weights = {t: len(t.encode("utf-16-le")) // 2 * times for t, times in Counter(tokens).items()}
        rest = 0
        for t in sorted(weights, key=lambda t: (-self.common[t], t)):
            rest += weights[t]
            if rest >= self.least:
                self.leads[t].append(len(self.places))
        self.places.append(n)
        self.bounds.append(to)
        self.weights.append(weights)

    def alike(self, n: int, tokens: list[str], before: int, bounds: list[int | None]) -> Iterator[int]:
        """Which ones whose place is less than `before` and whose bound is null or behind `n` are alike, in order."""
        own = set(tokens)
        for k in sorted(set().union(*(self.leads[t] for t in own if t in self.leads))):
            if self.places[k] >= before:
                return
            if (bounds[k] is None or n < bounds[k]) and sum(self.weights[k][t] for t in self.weights[k].keys() & own) >= self.least:
                yield k


class Block:
    """At most a block's rows (`n`, `to`, `tokens`, in order), as they are broadcast; each Python worker that uses them makes `earlier` once."""

    def __init__(self, rows: list[tuple], least: int):
        self.rows, self.least = rows, least

    @cached_property
    def earlier(self) -> Earlier:
        found = Earlier(self.least, [tokens for _, _, tokens in self.rows])
        for row in self.rows:
            found.add(*row)
        return found


def _lists(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _in_order(batches: Iterator[pa.RecordBatch], least: int, size: int) -> Iterator[pa.RecordBatch]:
    """Active ones of the first `size` rows (`n`, `to`, `tokens`, in order) of one task, and at last one without tokens: the last place looked at."""
    rows = list(islice(_lists(batches, "n", "to", "tokens"), size))
    found, active = Earlier(least, [tokens for _, _, tokens in rows]), []
    for n, to, tokens in rows:
        if next(found.alike(n, tokens, n, found.bounds), None) is None:
            found.add(n, to, tokens)
            active.append((n, to, tokens))
    columns = zip(*active, (rows[-1][0], None, None), strict=True) if rows else ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], ["n", "to", "tokens"])


def _firsts(batches: Iterator[pa.RecordBatch], block: Broadcast[Block]) -> Iterator[pa.RecordBatch]:
    """Each row (`n`, `tokens` and more) with `first`: the place of the first one of the block that removes it."""
    earlier = block.value.earlier
    for batch in batches:
        ks = (next(earlier.alike(n, tokens, n, earlier.bounds), None) for n, tokens in _lists([batch], "n", "tokens"))
        first = pa.array([None if k is None else earlier.places[k] for k in ks], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, first], [*batch.schema.names, "first"])


def _next(batches: Iterator[pa.RecordBatch], block: Broadcast[Block]) -> Iterator[pa.RecordBatch]:
    """For those of the block, the first of a task's rows (`n`, `first`, `tokens`) that is alike, later, and not removed before by its `first`."""
    earlier = block.value.earlier
    to = list(earlier.bounds)
    for n, first, tokens in _lists(batches, "n", "first", "tokens"):
        for k in earlier.alike(n, tokens, n if first is None else first, to):
            to[k] = n
    told = [(i, j) for i, j in zip(earlier.places, to, strict=True) if j is not None]
    yield pa.RecordBatch.from_pydict({"i": pa.array([i for i, _ in told], pa.int64()), "to": pa.array([j for _, j in told], pa.int64())})


def _settled(nodes: DataFrame, kills: DataFrame) -> DataFrame:
    """Those of `nodes` (`n`) that no pair of `kills` (`i` removes `j`, i before j) removes whose `i` isn't removed itself, in rounds."""
    state = nodes.select("n", F.lit(None).cast("boolean").alias("stays"))
    left = checkpoint(kills.select("i", F.col("j").alias("k"), F.lit(None).cast("boolean").alias("by")))
    while not left.isEmpty():
        seen = left.groupBy("k").agg(F.max(F.coalesce("by", F.lit(False))).alias("killed"), F.max(F.col("by").isNull()).alias("open"))
        now = state.join(seen, state["n"] == seen["k"], "left")
        settled = F.when(F.col("stays").isNotNull(), F.col("stays")).when(F.coalesce("killed", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        # The first open node is always settled, so this ends.
        state = checkpoint(now.select("n", settled.alias("stays")))
        by = left.drop("by").join(state.select(F.col("n").alias("i"), F.col("stays").alias("by")), "i")
        open_ends = state.where("stays is null").select(F.col("n").alias("k"))
        left = checkpoint(by.where("coalesce(by, true)").join(open_ends, "k", "left_semi"))
    return state.where("coalesce(stays, true)").select("n")


def _decided(rows: DataFrame, least: int, size: int) -> DataFrame:
    """Active ones of the first `size` rows (`n`, `to`, `tokens`), decided by one task in order, and a last row without tokens."""
    return rows.repartition(1).sortWithinPartitions("n").mapInArrow(lambda batches: _in_order(batches, least, size), "n long, to long, tokens array<string>")


def active(titles: Titles, nodes: DataFrame, tokens: DataFrame, leaf: int = LEAF, pairs: int = PAIRS) -> DataFrame:
    """Those of `nodes` (`n`, `to`) that no earlier active one removes: an alike one whose `to` is null or behind.

    `tokens` (`place`, `tokens`) are of all of them. The result is the same whatever `leaf` and `pairs` are.
    """
    nodes = checkpoint(nodes.select("n", "to"))
    count, low, high, middle = nodes.agg(F.count("*"), F.min("n"), F.max("n"), F.percentile_approx("n", 0.5)).first()
    if count <= max(leaf, 1):
        rows = nodes.join(tokens.withColumnRenamed("place", "n"), "n").select("n", "to", "tokens")
        return _decided(rows, titles.least, count).where("tokens is not null").select("n")
    if titles.likely(nodes.select("n")) <= pairs * count:
        kills = titles.alike(nodes.select(F.col("n").alias("i"), "to"), nodes.select(F.col("n").alias("j")), "to is null or j < to")
        return _settled(nodes, kills.select("i", "j").distinct())
    middle = middle if middle < high else low + (high - low) // 2
    first = checkpoint(active(titles, nodes.where(F.col("n") <= middle), tokens, leaf, pairs))
    later = nodes.where(F.col("n") > middle)
    removers = nodes.join(first, "n").select(F.col("n").alias("i"), "to")
    gone = titles.alike(removers, later.select(F.col("n").alias("j")), "to is null or j < to").select(F.col("j").alias("n")).distinct()
    return first.union(active(titles, later.join(gone, "n", "left_anti"), tokens, leaf, pairs))


def first_removers(nodes: DataFrame, least: int, leaf: int = LEAF, pairs: int = PAIRS) -> DataFrame:
    """`nodes` (`n`, `to`, `tokens`, `own`) with `first`: the first active one that removes it. Of those that are `own` the ones without are `active`; others remove nothing.

    Block by block: one task decides the first rows that are left, and its active ones are broadcast to all others, of which those that are
    removed are gone before the next block. So most rows of a table of alike titles are looked at once and never shuffled. Blocks go on as
    long as each leaves a `SHARE`-th less, so all together look at no more than `SHARE` times the rows; titles that few others are alike to are left to `active`.
    """
    context, left, done = nodes.sparkSession.sparkContext, nodes.select("n", "to", "tokens", "own"), []
    rows, own = left.agg(F.count("*"), F.count_if("own")).first()
    size = BLOCK * max(leaf, 1)
    while own:
        end = left.where("own").agg(F.percentile_approx("n", min(size / own, 1.0))).first()[0]
        *found, last = _decided(left.where(F.col("own") & (F.col("n") <= end)).select("n", "to", "tokens"), least, size).collect()
        block = context.broadcast(Block([tuple(row) for row in found], least))
        seen = left.coalesce(rows // ROWS + 1).mapInArrow(lambda batches, block=block: _firsts(batches, block), "n long, to long, tokens array<string>, own boolean, first long")
        seen = checkpoint(seen)
        block.unpersist()
        settled = F.col("first").isNotNull() | (F.col("n") <= last["n"])
        done.append(seen.where(settled))
        left, before = seen.where(~settled).drop("first"), rows
        rows, own = left.agg(F.count("*"), F.count_if("own")).first()
        if own and (before - rows) * SHARE < before:
            titles = Titles.of(left.select(F.col("n").alias("place"), "tokens"), least)
            kept = checkpoint(active(titles, left.where("own"), left.select(F.col("n").alias("place"), "tokens"), leaf, pairs))
            removers = left.join(kept, "n").select(F.col("n").alias("i"), "to")
            reached = titles.alike(removers, left.join(kept, "n", "left_anti").select(F.col("n").alias("j")), "to is null or j < to").groupBy("j").agg(F.min("i").alias("first"))
            return reduce(DataFrame.union, done, checkpoint(left.join(reached, F.col("n") == F.col("j"), "left").drop("j")))
    return reduce(DataFrame.union, done, left.withColumn("first", F.lit(None).cast("long")))


def yields_to(rows: DataFrame, later: DataFrame, least: int, leaf: int = LEAF) -> DataFrame:
    """For `rows` (`n`, `tokens`) the first alike one of `later` (`n`, `first`, `tokens`) behind it that is still there, as its `first` is none or behind it: `i`, `to`."""
    context, size, count = rows.sparkSession.sparkContext, BLOCK * max(leaf, 1), rows.count()
    if count > BLOCKS * size:
        return _yields_by_tokens(rows, later, least)
    ends = rows.agg(F.percentile_approx("n", [min(k * size / count, 1.0) for k in range(1, -(-count // size) + 1)])).first()[0] if count else []
    found = rows.sparkSession.createDataFrame([], "i long, to long")
    for low, high in zip([None, *ends], ends):
        inside = F.col("n") <= high if low is None else F.col("n").between(low + 1, high)
        block = sorted((row["n"], None, row["tokens"]) for row in rows.where(inside).select("n", "tokens").collect())
        if block:
            told = context.broadcast(Block(block, least))
            open_ = later.where((F.col("n") > block[0][0]) & (F.col("first").isNull() | (F.col("first") > block[0][0]))).select("n", "first", "tokens")
            found = found.union(open_.mapInArrow(lambda batches, told=told: _next(batches, told), "i long, to long"))
    return found.groupBy("i").agg(F.min("to").alias("to"))


def _yields_by_tokens(rows: DataFrame, later: DataFrame, least: int) -> DataFrame:
    """The same by joins on tokens, for many rows: first one of `later` that stays, then one before that."""
    titles = Titles.of(rows.union(later.select("n", "tokens")).withColumnRenamed("n", "place"), least)
    to_kept = titles.alike(rows.select(F.col("n").alias("i")), later.where("first is null").select(F.col("n").alias("j"))).groupBy("i").agg(F.min("j").alias("bound"))
    to_kept = checkpoint(rows.select(F.col("n").alias("i")).join(to_kept, "i", "left"))
    losers = later.where("first is not null").select(F.col("n").alias("j"), "first")
    to_other = titles.alike(to_kept, losers, "first > i and (bound is null or j < bound)").groupBy("i").agg(F.min("j").alias("other"))
    return to_kept.join(to_other, "i", "left").select("i", F.coalesce("other", "bound").alias("to"))


def removed_places(rows: DataFrame, least: int = ALIKE_LENGTH, leaf: int = LEAF, pairs: int = PAIRS) -> DataFrame:
    """Places (`n`) that the pass removes, from `place`, `tokens` and `url` (has one)."""
    nodes = rows.where((F.size("tokens") > 0) & F.col("place").isNotNull()).select(F.col("place").alias("n"), F.lit(None).cast("long").alias("to"), "tokens", F.col("url").alias("own"))
    known = first_removers(nodes, least, leaf, pairs)
    # Those without URL that no kept one removes; nothing that comes later looks at one that is removed.
    open_ = checkpoint(known.where("not own and first is null").select("n", "tokens"))
    to = yields_to(open_, known.where("own").select("n", "first", "tokens"), least, leaf)
    yields = checkpoint(open_.join(to.withColumnRenamed("i", "n"), "n", "left").withColumn("own", F.lit(True)))
    staying = first_removers(yields, least, leaf, pairs)
    return known.where("first is not null").select("n").union(staying.where("first is not null or to is not null").select("n"))


def place_of(rows: DataFrame) -> Column:
    """One number that orders sites first and postings within: posting numbers are below 2**40, others are an error."""
    post = F.col(ORDER[1]).cast("long")
    bounded = F.when(post.isNull() | post.between(0, (1 << 40) - 1), post).otherwise(F.raise_error(F.lit("a posting's number is not below 2**40")).cast("long"))
    return F.shiftleft(F.col(ORDER[0]).cast("long"), 40) + bounded


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `_place`: numbers that rise in their order, whatever their own numbers are. Ranges of the order are numbered side by side."""
    known = F.col(ORDER[0]).isNotNull() & F.col(ORDER[1]).isNotNull()
    return rows.orderBy(*ORDER).withColumn("_place", F.when(known, F.monotonically_increasing_id()))


def dedup_fuzzy(postings: DataFrame, least: int = ALIKE_LENGTH, leaf: int = LEAF, pairs: int = PAIRS, bounded: bool = True) -> DataFrame:
    """`postings` without those that the pass removes; titles without tokens are never alike to others.

    Numbers of postings that are not `bounded`, as those of a run's pages, are put in their order first.
    """
    placed = checkpoint(postings.withColumn("_place", place_of(postings)) if bounded else numbered(postings))
    rows = checkpoint(placed.select(F.col("_place").alias("place"), title_tokens("title").alias("tokens"), has_url().alias("url")))
    removed = removed_places(rows, least, leaf, pairs)
    return placed.join(removed.withColumnRenamed("n", "_place"), "_place", "left_anti").drop("_place")
