"""Mixing documents to target weights by soft domain membership.

A classifier fitted on a labelled table gives each document a posterior over domains. With n_i
tokens and posterior p_i, a document kept at rate r_i >= 0 adds r_i n_i p_i expected tokens. The rates are the
nonnegative least squares fit of the domains' expected totals to their targets t that is nearest to rates of 1.
It is found by projected gradient in its lazy form, where gradients add up before they are projected:

    r_i = max(0, 1 - p_i . g),    g <- g + H (sum_i n_i r_i p_i - t)

The sum in brackets is the gradient of the squares by the totals, one distributed sum over the documents for a
step. H is the inverse of the moments of the documents whose rate is above zero, of which the same
pass takes the sums, so that few steps do (a projected Newton step; its length is chosen among several in one pass). A small
ridge on g makes what cannot be met be met as nearly as least squares can. A rate depends on its document's
posterior and g alone, so it can be recomputed anywhere.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import checkpoint, item_words, over_texts
from postmill.llm.text_features import STYLE, bounded_sample, style

_LOG = logging.getLogger(__name__)

#: Labelled rows that the classifier is fitted on at most, and words that it looks for.
SAMPLE, VOCABULARY = 20_000, 96
#: Bytes of a word's beginning that counts as a mark of its own.
PREFIX = 5
#: Documents of the sample that hold a word at least.
LEAST_DOCS = 5
STEPS = 100
#: Domains with a smaller part of all tokens, by posteriors, have no text; their targets are reported as unmet.
NOTHING = 1e-6
#: Weight of the ridge on g against the domains' second moments.
RIDGE = 1e-9
#: The part of its target by which a domain's gradient may differ from zero at the end.
TOLERANCE = 1e-6
#: The part of its target by which a domain's expected total may differ before it is reported as unmet.
UNMET = 1e-3
#: Lengths of a step that are tried in one pass.
LENGTHS = 0.5 ** np.arange(10)

#: Domains of the labels' two marks, and the share of tokens that the production mix aims at.
DOMAINS = ("good_clean", "good_toxic", "poor_clean", "poor_toxic")
TARGETS = {"good_clean": 0.98, "good_toxic": 0.004, "poor_clean": 0.015, "poor_toxic": 0.001}


def domain_column(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The index in DOMAINS of a row's labels; null if one is missing."""
    return (2 * (1 - F.col(quality)) + F.col(toxic)).cast("int")


def marks(words: list[bytes]) -> set[bytes]:
    """The distinct words, and the beginnings of longer ones followed by a star."""
    found = set(words)
    return found | {w[:PREFIX] + b"*" for w in found if len(w) > PREFIX}


@dataclass
class Classifier:
    """Softmax regression of style and of marks: words and word beginnings that tell domains apart."""

    words: dict[bytes, int]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (features + 1) x domains

    def raw(self, text: bytes | None) -> tuple[int, np.ndarray]:
        """Words of a text, and its features."""
        words = item_words(text)
        x = np.zeros(len(STYLE) + len(self.words), np.float32)
        x[: len(STYLE)] = style(text)
        for w in self.words.keys() & marks(words):
            x[len(STYLE) + self.words[w]] = 1
        return len(words), x

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.centre) / self.scale, np.ones((len(x), 1))]) @ self.weights
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def telling_marks(rows: DataFrame, domains: int, count: int = VOCABULARY, least: int = LEAST_DOCS) -> list[bytes]:
    """Marks whose presence tells domains apart best, from labelled `text` and `domain`.

    A mark's value is the G statistic of its documents' domains against those of all documents.
    """
    totals = dict(rows.groupBy("domain").count().collect())  # one row for each domain
    total = sum(totals.values())
    if not total:
        return []

    def step(batch: list[bytes | None]) -> dict:
        return {"words": pa.array([sorted(marks(item_words(t))) for t in batch], pa.list_(pa.binary()))}

    held = over_texts(rows, ["domain"], "words array<binary>", step).select("domain", F.explode("words").alias("word"))
    counts = held.groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"n{d}") for d in range(domains)))
    n = sum((F.col(f"n{d}") for d in range(domains)), F.lit(0))
    gain = F.lit(0.0)
    for d in range(domains):
        got, share = F.col(f"n{d}"), totals.get(d, 0) / total
        if share:
            gain = gain + F.when(got > 0, got * F.log(got / (n * share))).otherwise(0.0)
    best = counts.where(n >= least).orderBy(gain.desc(), "word").limit(count)
    return [bytes(r["word"]) for r in best.select("word").collect()]


def softmax_regression(x: np.ndarray, y: np.ndarray, domains: int, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights of least mean log loss plus a small decay, by Adam on the whole sample."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    want = np.eye(domains, dtype=np.float32)[y]
    w = np.zeros((x.shape[1], domains))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = x @ w
        e = np.exp(z - z.max(1, keepdims=True))
        step = x.T @ (e / e.sum(1, keepdims=True) - want) / len(x) + decay * w
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step**2
        w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labelled: DataFrame, domains: int, id_col: str = "doc_id", sample: int = SAMPLE) -> Classifier:
    """The classifier of `labelled` (`id_col`, `domain` from 0), fitted on at most `sample` of its rows.

    Of several labels of a document the least counts; null ids and domains are not learnt from.
    Without labelled rows all domains are equally likely.
    """
    one = labelled.where("domain is not null").groupBy(id_col).agg(F.min("domain").alias("domain"))
    ids = docs.select(id_col).distinct().join(one, id_col)
    # At most `sample` rows of an id and a number.
    chosen = F.broadcast(bounded_sample(ids, id_col, sample))
    rows = checkpoint(docs.select(id_col, "text").join(chosen, id_col).groupBy(id_col, "domain").agg(F.min("text").alias("text")))
    words = telling_marks(rows, domains)
    plain = Classifier({w: i for i, w in enumerate(words)}, *(np.zeros(0) for _ in range(3)))

    def step(batch: list[bytes | None]) -> dict:
        return {"x": pa.array([plain.raw(t)[1] for t in batch], pa.list_(pa.float32()))}

    found = over_texts(rows, [id_col, "domain"], "x array<float>", step).orderBy(id_col).collect()
    width = len(STYLE) + len(words)
    x = np.array([r["x"] for r in found], np.float32).reshape(-1, width)
    y = np.array([r["domain"] for r in found], int)
    centre, scale = (x.mean(0), x.std(0) + 1e-2) if len(x) else (np.zeros(width), np.ones(width))
    weights = softmax_regression((x - centre) / scale, y, domains) if len(x) else np.zeros((width + 1, domains))
    return Classifier(plain.words, centre, scale, weights)


def rates_of(p: np.ndarray, steps: list[list[float]]) -> np.ndarray:
    """The rates of documents with these posteriors (rows) after the steps."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ np.array(g))
    return r


def membership(classifier: Classifier, steps: list[list[float]] | None = None) -> Column:
    """`n_tokens`, `p` (the posterior of each domain) and `rate` (after the steps) of `text`.

    Marked as not repeatable so that the planner asks for it once for each row.
    """

    @F.arrow_udf("n_tokens long, p array<double>, rate double")
    def of(column: pa.Array) -> pa.Array:
        raw = [classifier.raw(t) for t in column.cast(pa.large_binary()).to_pylist()]
        p = classifier.posteriors(np.array([r[1] for r in raw], np.float32).reshape(len(raw), -1)) if raw else np.zeros((0, 1))
        fields = [pa.array([r[0] for r in raw], pa.int64()), pa.array(list(p), pa.list_(pa.float64())), pa.array(rates_of(p, steps or []))]
        return pa.StructArray.from_arrays(fields, ["n_tokens", "p", "rate"])

    return of.asNondeterministic()("text")


def rate(p: str, steps: list[list[float]]) -> Column:
    """The rate of a document with posterior `p` after these steps."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(rates_of(np.array(column.to_pylist(), float).reshape(len(column), -1), steps))

    return of.asNondeterministic()(p)


@dataclass
class Fit:
    """The steps found, each domain's expected and target total, and whether the optimum was reached."""

    steps: list[list[float]]
    expected: np.ndarray
    targets: np.ndarray
    settled: bool = True

    def unmet(self) -> np.ndarray:
        """Domains whose expected total is not the target."""
        return np.flatnonzero(np.abs(self.expected - self.targets) > UNMET * self.targets)


def _sums(members: DataFrame, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each g of `tried` (rows): the sums of n r^2, of n r p, and of n p p' where r > 0, for r = max(0, 1 - p . g)."""
    count, domains = tried.shape
    width = 1 + domains + domains**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((count, width))
        for batch in batches:
            p = np.asarray(batch.column("p").flatten(), float).reshape(batch.num_rows, domains)
            n = np.asarray(batch.column("n_tokens"), float)
            for k, g in enumerate(tried):
                r = np.maximum(0.0, 1 - p @ g)
                out[k] += [n @ r**2, *((n * r) @ p), *(p.T @ (p * (n * (r > 0))[:, None])).ravel()]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(out.size), pa.int32()), "v": pa.array(out.ravel())})

    out = np.zeros(count * width)
    for at, v in members.select("n_tokens", "p").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    out = out.reshape(count, width)
    return out[:, 0], out[:, 1 : domains + 1], out[:, domains + 1 :].reshape(count, domains, domains)


def solve(members: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """The rates that bring expected totals of `members` (`n_tokens`, `p`) to `targets`, or as near as least squares can."""
    want = np.array(targets, float)
    g = np.zeros(len(want))
    _, sums, moments = (x[0] for x in _sums(members, g[None]))
    aimed = np.flatnonzero(sums > NOTHING * sums.sum())
    if not len(aimed):
        return Fit([], sums, want)
    ridge = RIDGE * np.diag(moments)[aimed]
    unit = want[aimed] + sums[aimed]

    def slope(sums: np.ndarray, g: np.ndarray) -> np.ndarray:
        return want[aimed] - sums[aimed] + ridge * g[aimed]

    value, settled = np.inf, False
    for _ in range(steps):
        down = slope(sums, g)
        settled = bool((np.abs(down) <= tolerance * unit).all())
        if settled:
            break
        scale = ridge**-0.5
        curve = moments[np.ix_(aimed, aimed)] * np.outer(scale, scale) + np.eye(len(aimed))
        tried = np.repeat(g[None], len(LENGTHS), 0)
        tried[:, aimed] -= np.outer(LENGTHS, scale * np.linalg.solve(curve, scale * down))
        squares, all_sums, all_moments = _sums(members, tried)
        values = squares / 2 + tried[:, aimed] @ want[aimed] + (ridge * tried[:, aimed] ** 2).sum(1) / 2
        # Of lengths whose values differ by rounding only, the one of the least slope.
        best = np.flatnonzero(values <= values.min() + 1e-13 * abs(values.min()))
        k = min(best.tolist(), key=lambda i: np.abs(slope(all_sums[i], tried[i]) / unit).max())
        if values[k] > value + 1e-13 * abs(value):
            break
        g, value, sums, moments = tried[k], values[k], all_sums[k], all_moments[k]
    return Fit([g.tolist()] if g.any() else [], sums, want, settled)


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """The steps that `solve` finds."""
    return solve(members, targets, steps, tolerance).steps


@dataclass
class Mix:
    """What decides rates: the classifier and the steps; and for each domain not met its expected and target tokens."""

    classifier: Classifier
    steps: list[list[float]]
    unmet: dict[str, tuple[float, float]]
    settled: bool


def _draw(id_col: str) -> Column:
    """A uniform number that the row decides."""
    return F.pmod(F.xxhash64(id_col, "text", F.lit(9)), F.lit(1 << 53)) / float(1 << 53)


def copies(rate_col: str, draw: Column) -> Column:
    """How often a document is drawn: its rate, rounded at random so that it is met on average."""
    r = F.col(rate_col)
    return (F.floor(r) + (draw < r - F.floor(r)).cast("int")).cast("long")


def _members(docs: DataFrame, classifier: Classifier, id_col: str) -> DataFrame:
    found = docs.select(id_col, _draw(id_col).alias("draw"), membership(classifier).alias("m"))
    return found.select(id_col, "draw", "m.n_tokens", "m.p")


def totals(members: DataFrame, targets: dict[str, float], anchor: str) -> list[float]:
    """Target totals: weights scaled so that the domain `anchor` keeps the tokens it has."""
    names = list(targets)
    held = members.agg(F.sum(F.col("n_tokens") * F.col("p")[names.index(anchor)])).first()[0] or 0.0
    return [held * targets[n] / targets[anchor] for n in names]


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = "good_clean", id_col: str = "doc_id") -> tuple[DataFrame, Mix]:
    """For each row of `docs`: `id_col`, `n_tokens`, `rate`, `copies` and `p_<domain>`; and the mix.

    `labelled` has `id_col` and `domain`, an index into `targets`. Null and empty texts have no tokens,
    so any rate suits them; repeated rows each give a row with the same numbers; an empty table gives
    none. If not all targets can be met, they are met as nearly as least squares can; the mix lists those
    that are not, among them those of domains without text.
    """
    classifier = fit(docs, labelled, len(targets), id_col)
    members = checkpoint(_members(docs, classifier, id_col))
    found = solve(members, totals(members, targets, anchor))
    names, steps = list(targets), found.steps
    unmet = {names[d]: (float(found.expected[d]), float(found.targets[d])) for d in found.unmet()}
    if unmet or not found.settled:
        _LOG.warning("mix %s; expected and target tokens of domains not met: %s", "settled" if found.settled else "not settled", unmet)
    rated = members.withColumn("rate", rate("p", steps)).withColumn("copies", copies("rate", F.col("draw")))
    shown = rated.select(id_col, "n_tokens", "rate", "copies", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(targets)))
    return shown, Mix(classifier, steps, unmet, found.settled)


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = "good_clean", id_col: str = "doc_id") -> DataFrame:
    """`docs` as the mix draws them: each row as often as its copies; the same columns.

    Rows are scored again where they stand, as their rate follows from the text; no text is shuffled. Null
    and empty texts have a rate like any other, by the posterior of a text without words; rows that repeat with
    their id are drawn alike; rows without id are drawn by their text alone; an empty table gives an empty one.
    """
    _, mix = mixing_rates(docs, labelled, targets, anchor, id_col)
    m, r, n = (f"_{c}" + "_" * max(map(len, docs.columns), default=0) for c in "mrn")
    drawn = docs.withColumn(m, membership(mix.classifier, mix.steps)).withColumn(r, F.col(f"{m}.rate"))
    drawn = drawn.withColumn(n, copies(r, _draw(id_col)))
    return drawn.where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), n))).drop(m, r, n)
