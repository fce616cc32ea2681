"""Substring deduplication: a count-min prefilter and an exact second pass.

A window of 35 words is repeated if its word sequence starts at two places. The sketch counts
anchors: of the 18-word runs in a window the one with the least hash. Equal windows have their
anchor at the same offset, so at distinct starts they count distinct anchor places, and the
anchor's count is never below the window's; there are about ten times fewer anchors than windows.
The partitions' counts are merged by adding them cell by cell; what is kept is one bit a cell for a count of two
or more, and one for eight cells if one of them holds a very common anchor.

The second pass sends only windows whose anchor is estimated repeated, with their words. They are dealt by
anchor, those of very common anchors each by itself, brought together by hashes and then compared word by word. What a
task has seen twice itself it settles and tells once, so a passage in very many documents reaches its group once
from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bounded, checkpoint, mix, plain_words, texts, window_hashes

WINDOW = 35
#: Cells of a sketch row for each word of the corpus, about.
CELLS_PER_WORD = 0.25
#: Bits of a sketch row's size, at least and at most. The largest sketch is a broadcast of 512 MB;
#: with more anchors than it tells apart the second pass sends more windows, and stays exact.
MIN_BITS, MAX_BITS = 16, 31
ROWS = 2
#: Places from which on an anchor's windows are dealt one by one, and cells that share a bit for that.
COMMON, COMMON_CELLS = 2048, 3
#: Counts of a cell are kept up to this.
FULL = 0xFFFF
#: Windows that a task remembers to have told.
TOLD = 100_000
#: Bits of a block: its cells are numbered by 16 bits.
_BLOCK = 16
#: Text of one step; what it has seen twice it settles itself.
STEP_BYTES = 4 << 20
#: Anchors that a partition gathers for one sketch.
STEP_ANCHORS = 2_000_000


class _Codes(dict):
    """Numbers of words, and their hashes, remembered for the words of a batch."""

    def __init__(self):
        self.words: list[bytes] = []
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return code

    def of(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all lists one after another, and where each begins."""
        if len(self) > 200_000:
            self.clear()
            self.words.clear()
            self.hashes.clear()
        parts = [np.fromiter(map(self.__getitem__, words), np.int32, len(words)) for words in lists]
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), np.cumsum([0, *map(len, parts)])


def _words_of(batch: pa.RecordBatch, codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and numbers of all words of a batch, text after text, and where each text begins."""
    numbers, starts = codes.of([*map(plain_words, texts(batch))])
    return np.array(codes.hashes, np.uint64)[numbers] if len(numbers) else np.empty(0, np.uint64), numbers, starts


def _groups(keys: tuple[np.ndarray, ...], words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows that brings equal ones together, and the number of each one's group in it.

    Windows have equal `keys` and begin at `at` in `words`; those of equal keys are compared word by word.
    """
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], 0)
    group = np.cumsum(new) - 1
    place, differs = at[order], np.zeros(len(order), bool)
    for i in range(1, len(order), 1 << 16):
        k = i + np.flatnonzero(~new[i : i + (1 << 16)])
        differs[k] = (words[place[k][:, None] + np.arange(window)] != words[place[k - 1][:, None] + np.arange(window)]).any(1)
    for g in np.unique(group[differs]).tolist():  # hashes agree and words don't
        members = np.flatnonzero(group == g)
        names: dict[bytes, int] = {}
        for m in members.tolist():
            group[m] = names.setdefault(words[place[m] : place[m] + window].tobytes(), len(order) + g * len(order) + len(names))
    if differs.any():
        again = np.argsort(group, kind="stable")
        order, group = order[again], np.unique(group[again], return_inverse=True)[1]
    return order, group


def _sliding(a: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each n consecutive values."""
    size = 1
    while 2 * size <= n:
        a = pick(a[:-size], a[size:])
        size *= 2
    return pick(a[: len(a) - (n - size)], a[n - size :]) if n > size else a


def _inside(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of the first n starts of runs of `length` words end in the text that they begin in."""
    ok = np.ones(n, bool)
    for end in starts[1:-1].tolist():
        ok[max(0, end - length + 1) : end] = False
    return ok


class _Windows:
    """Windows of a batch by the place of their first word: anchor, whole hash, and whether in one text."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, window: int):
        self.run = (window + 1) // 2
        self.n = max(0, len(words) - window + 1)
        if self.n:
            self.runs = mix(window_hashes(words, self.run), np.uint64(0xA24BAED4963EE407))
            self.anchors = _sliding(self.runs, window - self.run + 1, np.minimum)
            self.ok = _inside(starts, window, self.n)

    def anchor_places(self) -> np.ndarray:
        """Anchors of the windows, once for each place where one stands."""
        if not self.n:
            return np.empty(0, np.uint64)
        of = len(self.runs) - self.n + 1  # runs of a window
        # A run is an anchor if some window around it has it for its least.
        least = np.where(self.ok, self.anchors, np.uint64(0))
        around = np.concatenate([np.zeros(of - 1, np.uint64), least, np.zeros(of - 1, np.uint64)])
        return self.runs[_sliding(around, of, np.maximum) == self.runs]


def _cell(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each anchor in a row of the sketch, from its hash with the row's constant."""
    return (mix(anchors, np.uint64(0x9FB21C651E98DF25 + 2 * row)) >> np.uint64(64 - bits)).astype(np.int64)


def merged_sketch(docs: DataFrame, window: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The count-min sketch of all partitions, as far as it is used later.

    For each row packed bits of the cells counted twice or more; and, of the first row, a packed bit for
    each 2 ** COMMON_CELLS cells of which one is counted COMMON times or more.
    """

    size = 1 << min(bits, _BLOCK)

    def lines(places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The sketch of these anchors: of each block the cells that are counted, and their counts."""
        for row in range(ROWS):
            cells, counts = np.unique(_cell(np.concatenate(places), row, bits), return_counts=True)
            ends = np.searchsorted(cells, np.arange(size, (1 << bits) + size, size))
            starts = np.append(0, ends[:-1])
            blocks = np.flatnonzero(ends > starts)
            cells, counts, starts, ends = (cells & (size - 1)).astype(np.uint16), np.minimum(counts, FULL).astype(np.uint16), starts[blocks], ends[blocks]
            yield pa.RecordBatch.from_pydict({
                "line": pa.array(np.full(len(blocks), row, np.int32)), "block": pa.array(blocks.astype(np.int32)),
                "cells": pa.array([cells[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
                "counts": pa.array([counts[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
            })

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = _Codes(), []
        for batch in bounded(batches, limit=STEP_BYTES):
            hashes, _, starts = _words_of(batch, codes)
            held.append(_Windows(hashes, starts, window).anchor_places())
            if sum(map(len, held)) > STEP_ANCHORS:
                yield from lines(held)
                held = []
        if sum(map(len, held)):
            yield from lines(held)

    def together(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in parts:  # one row of each task's step
            for cells, counts in zip(batch.column("cells").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint16)
            np.minimum(total, FULL, out=total)
        common = (total >= COMMON).reshape(-1, 1 << min(COMMON_CELLS, bits)).any(1)
        yield pa.RecordBatch.from_pydict({"line": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "bits": [np.packbits(total > 1).tobytes()], "common": [np.packbits(common).tobytes()]})

    sparse = docs.select("text").mapInArrow(partial, "line int, block int, cells binary, counts binary")
    dense = sparse.groupBy("line", "block").applyInArrow(together, "line int, block int, bits binary, common binary")
    rows = [np.zeros(max(1, (1 << bits) >> 3), np.uint8) for _ in range(ROWS)]
    often = np.zeros(max(1, (1 << bits) >> (3 + COMMON_CELLS)), np.uint8)
    # At most ROWS << MAX_BITS bits and an eighth of a row more, whatever the corpus.
    for line, block, data, common in dense.toLocalIterator():
        for whole, part in ((rows[line], data), *([(often, common)] if line == 0 else [])):
            part = np.frombuffer(part, np.uint8)
            whole[block * len(part) : (block + 1) * len(part)] = part
    return rows, often


def _bit(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _repeated(anchors: np.ndarray, sketch: list[np.ndarray], bits: int) -> np.ndarray:
    """Whether the sketch estimates an anchor at two or more."""
    out = np.ones(len(anchors), bool)
    for row, packed in enumerate(sketch):
        out &= _bit(packed, _cell(anchors, row, bits))
    return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs begin: places whose values don't go on from those before, the last column by one."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = columns[-1][1:] != columns[-1][:-1] + 1
    for c in columns[:-1]:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


_ROUTED = "route long, doc long, content long, start int, kind byte, n int, wins binary, said binary"
#: Kinds of rows: windows that ask, windows known to be repeated, and starts that are settled.
ASKS, KNOWN, SETTLED = 0, 1, 2


class _Told:
    """Windows that a task has told to be repeated, with their words; forgets all when full."""

    def __init__(self):
        self.said: dict[int, bytes] = {}
        self.keys = np.empty(0, np.uint64)

    def has(self, keys: np.ndarray, said) -> np.ndarray:
        """Which windows are among them; `said` gives the words of one."""
        out = np.isin(keys, self.keys)
        for k in np.flatnonzero(out).tolist():
            out[k] = self.said[int(keys[k])] == said(k)
        return out

    def add(self, keys: np.ndarray, said) -> None:
        if len(self.said) + len(keys) > TOLD:
            self.said.clear()
        self.said.update({int(x): said(k) for k, x in enumerate(keys[:TOLD])})
        self.keys = np.sort(np.fromiter(self.said, np.uint64, len(self.said)))


def _candidates(docs: DataFrame, window: int, shared: Broadcast, bits: int) -> DataFrame:
    """Runs of windows with one route whose anchor is estimated repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, told = _Codes(), _Told()
        sketch, often = shared.value
        for batch in bounded(batches, limit=STEP_BYTES):
            hashes, numbers, starts = _words_of(batch, codes)
            found = _Windows(hashes, starts, window)
            if not found.n:
                continue
            new = np.concatenate([[True], found.anchors[1:] != found.anchors[:-1]])
            each = found.anchors[new]
            run_of = np.cumsum(new) - 1
            at = np.flatnonzero(_repeated(each, sketch, bits)[run_of] & found.ok)
            if not len(at):
                continue
            common = _bit(often, _cell(each, 0, bits) >> COMMON_CELLS)[run_of[at]]
            anchor, win = found.anchors[at], window_hashes(hashes, window)[at]
            route = np.where(common, mix(anchor, win), anchor)
            order, group = _groups((win, anchor), numbers, at, window)
            same = group[1:] == group[:-1]
            first = np.concatenate([[True], ~same])
            known, sent = np.zeros(len(at), bool), np.zeros(len(at), bool)
            known[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            sent[order] = first
            words = codes.words
            say = lambda a, n=window: b" ".join([words[i] for i in numbers[a : a + n].tolist()])
            # What this task told before need not be told nor asked again.
            one = np.flatnonzero(sent)
            again = told.has(mix(anchor[one], win[one]), lambda k, one=one: say(at[one[k]]))
            sent[one[again]] = False
            repeated = np.zeros(group[-1] + 1, bool)
            inverse = np.empty(len(at), np.int64)
            inverse[order] = group
            repeated[inverse[one[again]]] = True
            known |= repeated[inverse]
            tells = np.flatnonzero(sent & known)
            told.add(mix(anchor[tells], win[tells]), lambda k, tells=tells: say(at[tells[k]]))
            text = np.searchsorted(starts, at, "right") - 1
            ids, content = (np.asarray(batch.column(c).fill_null(0)) for c in ("doc", "content"))
            start = (at - starts[text]).astype(np.int32)
            # Settled starts, as runs.
            k = np.flatnonzero(known)
            begin = _runs(text[k], at[k])
            if len(begin):
                t, n = text[k][begin], np.diff([*begin, len(k)])
                none = pa.nulls(len(t), pa.binary())
                yield _rows(content[t], ids[t], content[t], start[k][begin], SETTLED, n, none, none)
            for kind, mask in ((ASKS, sent & ~known), (KNOWN, sent & known)):
                k = np.flatnonzero(mask)
                begin = _runs(text[k], route[k], at[k])
                if len(begin):
                    t, n = text[k][begin], np.diff([*begin, len(k)])
                    offsets = pa.py_buffer((np.append(begin, len(k)) * 8).astype(np.int32))
                    wins = pa.Array.from_buffers(pa.binary(), len(begin), [None, offsets, pa.py_buffer(np.ascontiguousarray(win[k]))])
                    said = pa.array([say(a, m + window - 1) for a, m in zip(at[k][begin].tolist(), n.tolist(), strict=True)], pa.binary())
                    yield _rows(route[k][begin].view(np.int64), ids[t], content[t], start[k][begin], kind, n, wins, said)

    return docs.select("doc", "content", "text").mapInArrow(run, _ROUTED)


def _rows(route, doc, content, start, kind, n, wins, said) -> pa.RecordBatch:
    columns = [pa.array(route, pa.int64()), pa.array(doc, pa.int64()), pa.array(content, pa.int64()), pa.array(start, pa.int32()), pa.array(np.full(len(n), kind, np.int8)), pa.array(n, pa.int32()), wins, said]
    return pa.RecordBatch.from_arrays(columns, ["route", "doc", "content", "start", "kind", "n", "wins", "said"])


def _settle(window: int):
    """Starts of repeated windows, of a partition sorted by route; a route goes on over batches."""
    names = ["doc", "content", "start", "n"]

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = np.asarray(table.column("kind"))
        yield from table.filter(pa.array(kind == SETTLED)).select(names).to_batches()
        table = table.filter(pa.array(kind != SETTLED)).combine_chunks()
        if not table.num_rows:
            return
        n = np.asarray(table.column("n"))
        row = np.repeat(np.arange(len(n)), n)
        win = np.frombuffer(b"".join(table.column("wins").to_pylist()), np.uint64)
        route = np.asarray(table.column("route"))[row]
        known = (np.asarray(table.column("kind")) == KNOWN)[row]
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        words, begins = _Codes().of([x.split(b" ") for x in table.column("said").to_pylist()])
        order, group = _groups((win, route), words, begins[row] + nth, window)
        often = (np.bincount(group) > 1) | (np.bincount(group, known[order]) > 0)
        hit = np.zeros(len(row), bool)
        hit[order] = often[group]
        place = np.asarray(table.column("start"))[row] + nth
        k = np.flatnonzero(hit)
        begin = _runs(row[k], place[k])
        if len(begin):
            made = table.select(names[:2]).take(pa.array(row[k][begin]))
            yield from pa.table([*made.columns, pa.array(place[k][begin], pa.int32()), pa.array(np.diff([*begin, len(k)]), pa.int32())], names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            routes = np.asarray(now.column("route"))
            last = int(np.searchsorted(routes, routes[-1])) if len(routes) else 0
            if last:
                yield from out(now.slice(0, last))
                now = now.slice(last)
            held = now
        if held is not None and held.num_rows:
            yield from out(held)

    return run


def repeated_starts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Starts of repeated windows of `docs` (`doc` and `content`, two numbers that name a row, and `text`).

    Gives `doc`, `content`, `start` (word) and `n` (so many windows in a row); a start may come twice.
    """
    spark = docs.sparkSession
    # Sizes only the sketch: spaces tell the words, without splitting.
    words = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(MAX_BITS, max(MIN_BITS, int(np.ceil(np.log2(max(1, words / 6 * CELLS_PER_WORD))))))
    shared = spark.sparkContext.broadcast(merged_sketch(docs, window, bits))
    routed = _candidates(docs, window, shared, bits)
    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(_settle(window), "doc long, content long, start int, n int")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """For each row of `docs`: `id_col`, `n_words`, `n_removed` and `kept`, its words that are in no
    repeated window, joined by spaces.

    Null, empty and short texts have no windows and keep their words; repeated rows repeat each
    other's windows and each give a row; null ids are kept; other columns are ignored.
    """
    keyed = docs.select(id_col, "text", F.xxhash64(id_col).alias("doc"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias("content"))
    spans = repeated_starts(keyed, window).groupBy("doc", "content").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    joined = keyed.join(spans, ["doc", "content"], "left").select(id_col, "text", "spans")
    kinds = dict(docs.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(texts(batch), batch.column("spans"), strict=True):
                words = plain_words(text)
                n = len(words)
                if spans.is_valid:
                    edges = np.zeros(n + 1, np.int64)
                    runs = spans.values
                    first, many = (np.asarray(runs.field(k)) for k in (0, 1))
                    np.add.at(edges, first, 1)
                    np.add.at(edges, first + many + window - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string(), safe=False)})

    return joined.mapInArrow(cut, f"`{id_col}` {kinds[id_col]}, n_words long, n_removed long, kept string")


def removal_report(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """`without_repeats` with a digest in place of the words that are kept."""
    return without_repeats(docs, window, id_col).select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def digest(words: list[bytes]) -> str:
    """What `kept_sha256` holds for these words."""
    return hashlib.sha256(b" ".join(words)).hexdigest()
