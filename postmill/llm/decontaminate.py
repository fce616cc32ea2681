"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Test windows are 13 words (a shorter item is one window). Documents are scanned in place: a
rolling hash of the words asks a small bitmap of window hashes, and each positive is verified
against the exact window. Nothing of the documents is shuffled. The broadcast is bounded: beyond `limit` windows
only the bitmap is broadcast, which has a fixed size, and the document windows that it lets through meet the
test windows in a join on the windows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bounded, checkpoint, item_words, mix, texts, window_hashes

WINDOW = 13
#: Distinct windows that are broadcast at most (about 150 bytes each); more are joined.
LIMIT = 1_000_000
#: Bits of the bitmap of window hashes: beside the broadcast set, and where windows are joined.
_MAP_BITS, FILTER_BITS = 24, 26


def _place(hashes: np.ndarray, length: int, bits: int) -> np.ndarray:
    """The bit of each window of a length."""
    return (mix(hashes, np.uint64(2 * length + 1)) >> np.uint64(64 - bits)).astype(np.int64)


class WindowSet:
    """Distinct windows of a test set with the items that hold them."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        self.items = {bytes(window): ids for window, ids in rows}
        self.words = {w: i + 1 for i, w in enumerate(sorted({w for key in self.items for w in key.split(b" ")}))}
        self.lengths = sorted({key.count(b" ") + 1 for key in self.items})
        self.bits = np.zeros(1 << _MAP_BITS, bool)
        for key in self.items:
            ids = np.fromiter((self.words[w] for w in key.split(b" ")), np.uint64)
            self.bits[_place(window_hashes(ids, len(ids)), len(ids), _MAP_BITS)] = True

    def find(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """Start, length and items of each occurrence of a window."""
        ids = np.fromiter(map(self.words.get, words, repeat(0)), np.uint64, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        found = []
        for length in self.lengths:
            if len(words) < length:
                continue
            starts = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(starts):
                continue
            if len(starts) > 64:
                starts = starts[self.bits[_place(window_hashes(ids, length)[starts], length, _MAP_BITS)]]
            for s in starts.tolist():
                if (items := self.items.get(b" ".join(words[s : s + length]))) is not None:
                    found.append((s, length, items))
        return found


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (`window`, its words joined) and `items`, the ids that hold them as strings.

    A null text has no words; an item without id can make hits but is in no list of items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), texts(batch), strict=True):
                words = item_words(text)
                size = min(window, len(words))
                rows += [(b" ".join(words[i : i + size]), item) for i in range(len(words) - size + 1) if size]
            rows = list(dict.fromkeys(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["window", "item"]
            )

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return named.mapInArrow(run, "window binary, item string").groupBy("window").agg(F.collect_set("item").alias("items"))


def window_set(windows: DataFrame) -> Broadcast:
    """All of these test windows in one broadcast."""
    return windows.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in windows.collect()]))


_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])


def _hits(shared: Broadcast) -> Column:
    """Number of words, of hit words, and items of `text`."""

    @F.arrow_udf("n_words long, n_hit long, items array<string>")
    def scan(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in column:
            n_words, n_hit, found = [], [], []
            for text in array.cast(pa.large_binary()).to_pylist():
                words = item_words(text)
                spans = shared.value.find(words)
                hit = np.zeros(len(words), bool)
                for start, length, _ in spans:
                    hit[start : start + length] = True
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                found.append(sorted({i for _, _, ids in spans for i in ids}))
            yield pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((n_words, n_hit, found), _HITS, strict=True)], fields=list(_HITS))

    return scan("text")


def _keyed(docs: DataFrame, id_col: str, names: tuple[str, str]) -> DataFrame:
    """`docs` with two numbers that name a row's id and text; rows with equal ones have equal hits."""
    return docs.withColumn(names[0], F.xxhash64(id_col)).withColumn(names[1], F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)))


def _bitmap(windows: DataFrame) -> tuple[Broadcast, list[int]]:
    """The bits of all test windows, and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, at = [], []
            for window in batch.column("window").to_pylist():
                codes = np.fromiter(map(xxhash.xxh3_64_intdigest, window.split(b" ")), np.uint64)
                lengths.append(len(codes))
                at.append(int(_place(window_hashes(codes, len(codes)), len(codes), FILTER_BITS)[0]))
            yield pa.RecordBatch.from_pydict({"n": pa.array(lengths, pa.int32()), "w": pa.array([a >> 6 for a in at], pa.int64()), "b": pa.array([np.int64(np.uint64(1 << (a & 63))) if a & 63 < 63 else np.iinfo(np.int64).min for a in at], pa.int64())})

    placed = windows.select("window").mapInArrow(run, "n int, w long, b long")
    lengths = [r["n"] for r in placed.select("n").distinct().orderBy("n").collect()]  # at most WINDOW numbers
    got = placed.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[np.asarray(got["w"])] = np.asarray(got["b"])
    return windows.sparkSession.sparkContext.broadcast(bits), lengths


def joined_spans(keyed: DataFrame, windows: DataFrame, names: tuple[str, str]) -> DataFrame:
    """`spans` (start and length in words) and `items` of each text that holds test windows, by the columns `names`."""
    shared, lengths = _bitmap(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        for batch in bounded(batches):
            if len(codes) > 200_000:
                codes.clear()
            rows, starts, sizes, found = [], [], [], []
            for k, text in enumerate(texts(batch)):
                words = item_words(text)
                for w in words:
                    if w not in codes:
                        codes[w] = xxhash.xxh3_64_intdigest(w)
                own = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
                for n in lengths:
                    at = _place(window_hashes(own, n), n, FILTER_BITS)
                    for s in np.flatnonzero((shared.value[at >> 6] >> (at & 63)) & 1).tolist():
                        rows.append(k)
                        starts.append(s)
                        sizes.append(n)
                        found.append(b" ".join(words[s : s + n]))
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(found, pa.binary())], [*names, "start", "n", "window"])

    a, b = names
    asked = keyed.select(a, b, "text").mapInArrow(run, f"`{a}` long, `{b}` long, start int, n int, window binary")
    return asked.join(windows, "window").groupBy(a, b).agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _covered(spans: str) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.lit(0)

    def add(a: Column, x: Column) -> Column:
        end = x["start"] + x["n"]
        return F.struct((a["n"] + F.greatest(zero, end - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(end, a["end"]).alias("end"))

    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("end")), add, lambda a: a["n"].cast("long"))


def _word_count(text: str) -> Column:
    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        return pa.array([len(item_words(t)) for t in column.cast(pa.large_binary()).to_pylist()], pa.int64())

    return count(text)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """For each row of `docs`: `id_col`, `n_words`, `n_hit` (words inside an occurrence of a test
    window), `n_items`, `items_sha256` (of the sorted item ids, comma-joined) and `contaminated`
    (at least a twentieth of its words is hit).

    Null or empty texts have no words and aren't contaminated; repeated rows each give a row; with
    an empty test set nothing is hit; other columns are ignored.
    """
    hits = hit_rows(docs.select(id_col, "text"), benchmark, window, limit, id_col=id_col)
    return hits.select(
        id_col, "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), is_contaminated("hits").alias("contaminated"),
    )


def is_contaminated(hits: str) -> Column:
    n_hit = F.col(f"{hits}.n_hit")
    return (n_hit > 0) & (20 * n_hit >= F.col(f"{hits}.n_words"))


def _named(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of `docs` has."""
    return [f"_{n}" + "_" * max(map(len, docs.columns), default=0) for n in names]


def hit_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT, into: str = "hits", id_col: str = "doc_id") -> DataFrame:
    """`docs` with a struct `into`: `n_words`, `n_hit` and `items`."""
    windows = checkpoint(test_windows(benchmark, window))
    if windows.count() <= limit:
        return docs.withColumn(into, _hits(window_set(windows)))
    a, b = _named(docs, "doc", "content")
    keyed = _keyed(docs, id_col, (a, b))
    spans = joined_spans(keyed, windows, (a, b)).select(a, b, _covered("spans").alias("_n_hit"), F.col("items").alias("_items"))
    found = keyed.join(spans.withColumnsRenamed({"_n_hit": a + "n", "_items": a + "i"}), [a, b], "left")
    hits = F.struct(_word_count("text").alias("n_words"), F.coalesce(a + "n", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(a + "i", F.array().cast("array<string>")).alias("items"))
    return found.withColumn(into, hits).select(*docs.columns, into)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """`docs` without contaminated documents; the same columns.

    Null and empty texts stay, rows without id are judged by their text, repeated rows alike; with an empty test
    set all stay; an empty table gives an empty one.
    """
    (name,) = _named(docs, "hits")
    return hit_rows(docs, benchmark, window, limit, name, id_col).where(~is_contaminated(name)).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """`docs` with hit words, and what stands between neighbouring hit words, cut from `text`.

    Texts without hits, null and empty ones among them, and all other columns stay as they are; a text that is one
    hit becomes empty; repeated rows are cut alike; with an empty test set nothing is cut.
    """
    windows = checkpoint(test_windows(benchmark, window))
    if windows.count() <= limit:
        shared = window_set(windows)

        @F.arrow_udf("string")
        def cut(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for array in column:
                yield pa.array([_without_spans(t, [(s, n) for s, n, _ in shared.value.find(item_words(t))]) for t in array.cast(pa.large_binary()).to_pylist()], pa.string())

        return docs.withColumn("text", cut("text"))
    a, b = _named(docs, "doc", "content")
    keyed = _keyed(docs, id_col, (a, b))

    @F.arrow_udf("string")
    def cut_at(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, spans in columns:
            rows = zip(column.cast(pa.large_binary()).to_pylist(), spans.to_pylist(), strict=True)
            yield pa.array([_without_spans(t, [(x["start"], x["n"]) for x in found or ()]) for t, found in rows], pa.string())

    found = keyed.join(joined_spans(keyed, windows, (a, b)).select(a, b, F.col("spans").alias(a + "s")), [a, b], "left")
    return found.withColumn("text", cut_at("text", a + "s")).select(*docs.columns)


def _without_spans(text: bytes | None, spans: list[tuple[int, int]]) -> str | None:
    if text is None or not spans:
        return text if text is None else text.decode()
    spans = sorted((s, s + n) for s, n in spans)
    at = word_offsets(text)
    out, done = [], 0
    for first, end in spans:
        start, stop = at[first][0], at[end - 1][1]
        if start > done:
            out.append(text[done:start])
        done = max(done, stop)
    return b"".join([*out, text[done:]]).decode()


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the item words of a text."""
    from postmill.llm.common import _ITEM_BYTES

    space = np.frombuffer(text.translate(_ITEM_BYTES), np.uint8) == 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def items_digest(items: list[str]) -> str:
    """What `items_sha256` holds for these ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
