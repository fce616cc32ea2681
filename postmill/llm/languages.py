"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a sample of its labelled text. A text
is parsed greedily into the longest phrases that occur in the sample (Ziv and Merhav, "A measure of
relative entropy between individual sequences", 1993); with c phrases over n letters and a sample of
N letters, c log2(N) / n estimates the bits a letter costs. The language of the least cost wins.

Texts are parsed whole, many pieces of them in step: one table lookup moves every piece on by a letter. A piece is
parsed first as if a phrase began with it; then the phrase that runs into it from the piece before goes on until both
parses are in one state, from where they are the same. So the counts are those of one parse from letter to letter.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import BATCH_BYTES, bounded, over_texts, texts
from postmill.llm.text_features import fold

FOLDS, HELD_OUT = 4, 2
#: Labelled documents of a language that its automaton is built from at most, and letters of each.
SAMPLE_DOCS, DOC_LETTERS = 64, 512
#: Stretches of a longer text that these letters are taken from.
WINDOWS = 4
#: Languages whose tables are sent to executors together; more are sent in further groups.
GROUP = 32
#: Places that are tried for a state's moves before the table grows.
TRIES = 200
#: Letters of the pieces that long texts are parsed in, side by side.
PIECE = 256
#: How fast other languages lose credit for each bit a letter.
SHARPNESS = 6.0


@cache
def _lower_letters() -> np.ndarray:
    """For every code point the lower case of a letter, and 0 for what is none."""
    points = (ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000))
    return np.fromiter(points, np.uint32, 0x110000)


def letters(text: bytes | None) -> np.ndarray:
    """The letters of a text in lower case, with one 0 for each stretch of anything else."""
    if not text:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    out = _lower_letters()[points]
    return out[(out > 0) | np.concatenate([[False], out[:-1] > 0])]


def windows(text: bytes | None) -> str:
    """The letters of a text; of a longer one as many as DOC_LETTERS, in windows at offsets that its hash draws.

    Each window falls in its own part of the text, so that beginnings weigh no more than the rest.
    """
    found = letters(text)
    if len(found) > DOC_LETTERS:
        size, ends = DOC_LETTERS // WINDOWS, [len(found) * i // WINDOWS for i in range(WINDOWS + 1)]
        starts = [a + xxhash.xxh64_intdigest(text, i) % (b - a - size + 1) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
        found = np.concatenate([np.append(found[a : a + size], np.uint32(0)) for a in starts])
    return "".join(map(chr, np.where(found > 0, found, 32).tolist()))


def automaton_moves(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """The same as a dense table (states x `size`, -1 where none)."""
    moves = automaton_moves(symbols)
    table = np.full((len(moves), size), -1, np.int32)
    for state, out in enumerate(moves):
        for c, to in out.items():
            table[state, c] = to
    return table


def parser(table: np.ndarray) -> np.ndarray:
    """A flat table for parsing: twice the next state, and one more where a phrase begins with this symbol.

    One further state follows symbols that the sample lacks; each of these is a phrase of its own.
    """
    states, size = table.shape
    lost = states
    start = np.where(table[0] >= 0, table[0], lost)
    full = np.vstack([table, np.full(size, -1, np.int32)])
    return np.where(full >= 0, 2 * full, 2 * start + 1).astype(np.int32).ravel()


class Compact:
    """An automaton whose states share one table: the move of a state by a symbol is at its base plus the symbol, if `owner` says so.

    The size follows the transitions, not states times symbols, so alphabets may be large.
    """

    def __init__(self, moves: list[dict[int, int]], size: int):
        rng = random.Random(0)
        slots = max(64, 2 * sum(map(len, moves[1:])))
        owner, to, base = [-1] * (slots + size), [0] * (slots + size), [0] * (len(moves) + 1)
        for state in sorted(range(1, len(moves)), key=lambda s: -len(moves[s])):
            out = moves[state]
            for _ in range(TRIES):
                at = rng.randrange(slots)
                if all(owner[at + c] < 0 for c in out):
                    break
            else:
                at = len(owner)
                slots += 2 * size
                owner += [-1] * (2 * size)
                to += [0] * (2 * size)
            base[state] = at
            for c, target in out.items():
                owner[at + c], to[at + c] = state, target
        self.base, self.owner, self.to = (np.array(x, np.int32) for x in (base, owner, to))
        self.lost = len(moves)  # follows symbols that the sample lacks; from here each symbol begins a phrase
        self.start = np.full(size, self.lost, np.int32)
        for c, target in moves[0].items():
            self.start[c] = target

    def step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins with these symbols."""
        at = self.base[state] + symbols
        begins = self.owner[at] != state
        return np.where(begins, self.start[symbols], self.to[at]), begins


def _parsed(table: Compact, rows: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Phrases that begin in each piece: `rows` has a step's symbols, `size` falls, `before` is the piece before or -1."""
    states = np.full((PIECE + 1, len(size)), table.lost, np.int32)
    begun = np.zeros((PIECE + 1, len(size)), np.int16)  # phrases begun so far
    for t in range(PIECE):
        m = np.searchsorted(-size, -t, "left")  # pieces that go on at this step
        if not m:
            break
        states[t + 1, :m], begins = table.step(states[t, :m], rows[t, :m])
        begun[t + 1, :m] = begun[t, :m] + begins
    count = begun[size, np.arange(len(size))].astype(np.int64)
    alone, ends = count.copy(), states[PIECE].copy()  # only whole pieces run into another
    after = np.full(len(size), -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    waiting = np.flatnonzero(before >= 0)
    while len(waiting):
        # In the first round all pieces go on from what the one before came to alone; then those whose one before came to something else.
        changed = []
        at, state, extra = waiting, ends[before[waiting]], np.zeros(len(waiting), np.int64)
        for t in range(PIECE):
            over = size[at] <= t
            if over.any():
                count[at[over]] = extra[over]
                at, state, extra = at[~over], state[~over], extra[~over]
            met = state == states[t, at]
            if met.any():
                done = at[met]
                count[done] = extra[met] + alone[done] - begun[t, done]
                changed.append(done[ends[done] != states[PIECE, done]])
                ends[done] = states[PIECE, done]
                at, state, extra = at[~met], state[~met], extra[~met]
            if not len(at):
                break
            state, begins = table.step(state, rows[t, at])
            extra += begins
        if len(at):  # whole pieces in which the parses never met
            count[at] = extra
            changed.append(at[ends[at] != state])
            ends[at] = state
        changed = np.concatenate([*changed, np.empty(0, np.int64)]).astype(np.int64)
        waiting = after[changed]
        waiting = waiting[waiting >= 0]
    return count


class Model:
    """Parsing tables of the languages learnt, and the symbols of letters."""

    def __init__(self, samples: dict[str, list[str | None]]):
        found = {lang: [letters((t or "").encode()) for t in kept] for lang, kept in sorted(samples.items())}
        joined = {lang: np.concatenate([np.append(x, 0) for x in kept]) for lang, kept in found.items() if any(map(len, kept))}
        self.langs = list(joined)
        own = np.union1d(np.concatenate([*joined.values(), [0]]), [0]).astype(np.int64)  # 0 comes first
        self.size = len(own) + 1
        self.symbols = np.full(0x110000, self.size - 1, np.int32)  # the last symbol: letters of no sample
        self.symbols[own] = np.arange(len(own))
        self.bits = {lang: math.log2(len(x) + 1) for lang, x in joined.items()}
        self.tables = {lang: Compact(automaton_moves(self.symbols[x].tolist()), self.size) for lang, x in joined.items()}

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each sequence of symbols (rows) in each language (columns)."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.zeros((len(parts), len(self.langs)), np.int64)
        if not lengths.sum():
            return out
        flat = np.concatenate([*parts, np.zeros(PIECE, np.int32)])
        pieces = -(-lengths // PIECE)
        owner = np.repeat(np.arange(len(parts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(lengths) - lengths)[owner] + nth * PIECE
        size = np.minimum(PIECE, lengths[owner] - nth * PIECE)
        order = np.argsort(-size, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        before = np.where(nth > 0, rank[np.arange(len(order)) - 1], -1)[order]  # the piece that runs into this one
        owner, size = owner[order], size[order]
        rows = flat[start[order] + np.arange(PIECE)[:, None]].astype(np.int32)  # a row for each step
        for j, lang in enumerate(self.langs):
            count = _parsed(self.tables[lang], rows, size, before)
            out[:, j] = np.bincount(owner, count, len(parts)).astype(np.int64)
        return out

    def predict(self, batch: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """A language, a score and the bits a letter costs for each text."""
        parts = [self.symbols[letters(t)] for t in batch]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        has_letter = np.fromiter(((p > 0).any() for p in parts), bool, len(parts))
        names, scores, bits = np.full(len(parts), "und", object), np.zeros(len(parts)), np.zeros(len(parts))
        if self.langs:
            cost = self.phrases(parts) * np.array([self.bits[lang] for lang in self.langs]) / np.maximum(1, lengths)[:, None]
            best = cost.argmin(1)  # the first of equals, by name
            weights = np.exp2(-SHARPNESS * (cost - cost.min(1, keepdims=True)))
            names[has_letter] = np.array(self.langs, object)[best[has_letter]]
            scores[has_letter] = 1 / weights.sum(1)[has_letter]
            bits[has_letter] = cost.min(1)[has_letter]
        return names.tolist(), scores, bits


def training_samples(docs: DataFrame, id_col: str = "doc_id") -> dict[str, list[str]]:
    """Letters of at most SAMPLE_DOCS labelled texts of each language outside the held-out fold.

    The ids of a language are dealt to as many groups by hash, and the least hash of each group wins;
    this gathers ids only, combines before it shuffles, and then reads the texts chosen.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col("lang").isNotNull() & (fold(id_col, FOLDS) != HELD_OUT))
    ids = known.select(F.col(id_col).alias("id"), F.col("lang").alias("l"))
    group, order = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SAMPLE_DOCS)), F.xxhash64("id", F.lit(2))
    chosen = ids.groupBy("l", group.alias("g")).agg(F.min(F.struct(order, "id"))["id"].alias("id")).select("l", "id")
    # At most SAMPLE_DOCS ids of a language.
    rows = known.join(F.broadcast(chosen), (F.col(id_col) == F.col("id")) & (F.col("lang") == F.col("l"))).select("l", "id", "text")
    taken = over_texts(rows, ["l", "id"], "t string", lambda batch: {"t": pa.array([windows(t) for t in batch], pa.string())})
    samples: dict[str, list[str]] = {}
    for lang, one in taken.groupBy("l", "id").agg(F.min("t").alias("t")).orderBy("l", "id").select("l", "t").collect():
        samples.setdefault(lang, []).append(one)
    return samples


def _predicted(docs: DataFrame, id_col: str, model: Model) -> DataFrame:
    """`id_col`, `content` (the text's hash), `lang_pred`, `score` and `bits` of each row among the languages of one model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, limit=BATCH_BYTES // 2):
            names, scores, bits = shared.value.predict(texts(batch))
            kept = {c: batch.column(c) for c in (id_col, "content")}
            yield pa.RecordBatch.from_pydict(kept | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores), "bits": pa.array(bits)})

    rows = docs.select(id_col, F.xxhash64("text").alias("content"), "text")
    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, content long, lang_pred string, score double, bits double")


def languages(docs: DataFrame, id_col: str = "doc_id", group: int = GROUP) -> DataFrame:
    """For each row of `docs`: `id_col`, `held_out`, `lang_pred` and `score` (0 to 1).

    Texts that are null or have no letter are `und` with score 0, as all are if nothing could be
    learnt. Rows without id or language are not learnt from and are not held out; repeated rows each
    give a row, an empty table none. All languages with labelled text are learnt; beyond `group` of them,
    tasks hold one group's tables each and the groups' answers meet by id and text.
    """
    samples = training_samples(docs, id_col)
    names = sorted(samples)
    models = (Model({n: samples[n] for n in names[i : i + group]}) for i in range(0, max(1, len(names)), group))
    parts = [_predicted(docs, id_col, m).withColumn("part", F.lit(k)) for k, m in enumerate(models)]
    predicted = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            predicted = predicted.union(more)
        # A group whose languages had no letters knows none and has score 0.
        one = F.struct(F.col("score") == 0, "bits", "lang_pred", "score")
        best = predicted.groupBy(id_col, "content", "part").agg(F.min(one).alias("o"), F.count("*").alias("n"))
        best = best.groupBy(id_col, "content").agg(F.min("o").alias("o"), F.collect_list("o").alias("all"), F.min("n").alias("n"))
        weight = lambda x: F.when(x["score"] > 0, F.pow(F.lit(2.0), F.lit(-SHARPNESS) * (x["bits"] - F.col("o.bits"))) / x["score"]).otherwise(0.0)
        total = F.aggregate("all", F.lit(0.0), lambda a, x: a + weight(x))
        best = best.select(id_col, "n", F.col("o.lang_pred").alias("lang_pred"), F.when(total > 0, 1 / total).otherwise(0.0).alias("score"))
        predicted = best.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    held = F.coalesce(fold(id_col, FOLDS) == HELD_OUT, F.lit(False))
    return predicted.select(id_col, held.alias("held_out"), "lang_pred", "score")
