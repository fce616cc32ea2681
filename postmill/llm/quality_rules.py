"""Quality rules whose cutoffs limit false rejections, with DataFrame functions only.

Each rule is a ratio of a text, and has cutoffs from a lenient to a strict one. The rules' cutoffs of one
level are used together, so the levels are one chain of joint decisions, each of which rejects all that the one before
rejects. Labelled good documents show, in each stratum (length band), how many a level would reject. A level is certified
if the exact binomial test refutes that it rejects more than `alpha` of the good documents. Levels are tested from the
most lenient on, and stop at the first failure (fixed-sequence testing, which needs no further correction within a
stratum); the error `delta` is divided by the number of strata (Bonferroni). So with probability 1 - `delta`, in every
stratum at most `alpha` of the good documents that pass the base rules are rejected. 67 good documents of a stratum, none
of them rejected, are enough for a level. Of the certified levels the most lenient one is used that still rejects
nearly all the labelled poor documents that the strictest one does; all are certified at once, so the choice is free.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import checkpoint

WINDOW = 8
ALPHA = 0.05
DELTA = 0.1
#: Part of the poor documents caught by the strictest certified cutoff that a more lenient one must catch.
POWER = 0.98
#: Words at which the next length band begins.
BANDS = (200, 1000)
#: Rules and their most lenient and strictest cutoffs: a document is rejected if the ratio is above the cutoff.
RULES = {"symbol_share": (0.5, 0.01), "capital_share": (0.5, 0.1), "exclaimed_words": (0.5, 0.02), "dup_line_share": (0.5, 0.1), "repeat_share": (0.3, 0.1)}
#: Levels of the chain.
LEVELS = 12


def cutoffs(rule: str) -> list[float]:
    """The cutoffs of a rule, level by level, in equal ratios."""
    lenient, strict = RULES[rule]
    return [round(lenient * (strict / lenient) ** (k / (LEVELS - 1)), 6) for k in range(LEVELS)]


_SPACE = r"[\x20\x09-\x0D]+"


def _count(text: str, kind: str) -> Column:
    """Characters of a class in a text."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`id_col`, the counts of each whole text (a null is an empty text) and the `level` from which on it is rejected.

    Windows of eight words are compared by 64-bit hashes within a text. Only texts where a hash
    comes twice get sorted, so the work stays near-linear for very long ones.
    """
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    # Hashes of runs twice as long, from those of neighbouring runs.
    doubled = lambda a, n: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0))), F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    zero, last = F.lit(0).cast("long"), F.size("wins")
    d = docs.select(id_col, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("*", F.filter(F.split("text", _SPACE), lambda w: w != "").alias("words"), F.filter(F.split("text", r"\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        id_col, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count("text", r"#*$%&|<>").alias("n_symbols"), _count("text", r"\p{Lu}").alias("n_capitals"),
        F.size(F.filter("words", lambda w: F.endswith(w, F.lit("!")))).cast("long").alias("n_exclaimed"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    d = d.withColumn("pairs", doubled("codes", 1)).drop("codes").withColumn("fours", doubled("pairs", 2)).drop("pairs").withColumn("wins", doubled("fours", 4)).drop("fours")
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("wins")) < last, F.sort_array(F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("wins")
    twin = lambda x, k: ((k > 0) & (at(F.col("sorted"), F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | ((k + 1 < F.size("sorted")) & (at(F.col("sorted"), F.least(k + 1, F.size("sorted") - 1))["h"] == x["h"]))
    d = d.withColumn("starts", F.sort_array(F.transform(F.filter("sorted", twin), lambda x: x["i"].cast("long")))).drop("sorted")
    covered = F.aggregate("starts", F.struct(zero.alias("n"), F.lit(-WINDOW).cast("long").alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("long"), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.coalesce(covered, zero)).drop("starts")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    ratios = (share("n_symbols", "word_chars"), share("n_capitals", "word_chars"), share("n_exclaimed", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    band = sum(((F.col("n_words") >= b).cast("int") for b in BANDS), F.lit(0))
    return d.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), band.alias("band"), level_of(dict(zip(RULES, ratios, strict=True))).alias("level"))


def level_of(ratios: dict[str, Column]) -> Column:
    """The first level (from 1) at which one of the ratios is above its rule's cutoff; one more than LEVELS if none."""
    firsts = []
    for rule, ratio in ratios.items():
        first = F.lit(LEVELS + 1)
        for k, c in reversed(list(enumerate(cutoffs(rule), 1))):
            first = F.when(ratio > c, k).otherwise(first)
        firsts.append(first)
    return F.least(*firsts)


def _log_binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """The logarithm of P(X <= k) for X ~ Binomial(n, p), by summing the terms in logarithms."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (F.greatest(a["total"], term) + F.log1p(F.exp(-F.abs(a["total"] - term)))).alias("total"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, add, lambda a: a["total"])


def certified_levels(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """`band` and `used`, the level that is applied (null where none is certified), from features with `quality`.

    At most one row for each length band. Only good documents (quality 1) certify; poor ones (0) choose among
    certified levels, and without any the most lenient is used. A band without good documents has no level.
    """
    error = math.log(delta / (len(BANDS) + 1))
    over = [F.array(*(F.count_if((F.col("quality") == q) & (F.col("level") <= k)) for k in range(1, LEVELS + 1))).alias(f"over_{q}") for q in (0, 1)]
    counts = labelled.groupBy("band").agg(F.count_if(F.col("quality") == 1).alias("n"), *over)
    # k above its expectation can't pass, and isn't summed.
    passed = F.transform("over_1", lambda k: F.when(k < F.col("n") * alpha, _log_binomial_cdf(F.col("n"), k, alpha) <= error).otherwise(False))
    fails = F.array_position(passed, F.lit(False))  # 0 if all pass
    strictest = F.when(fails == 0, LEVELS).otherwise(fails - 1).cast("int")
    enough = F.element_at("over_0", F.greatest(strictest, F.lit(1))) * POWER
    used = F.array_position(F.transform("over_0", lambda k: k >= enough), F.lit(True))
    return counts.select("band", F.when(strictest > 0, used.cast("int")).alias("used"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id") -> DataFrame:
    """For each row of `docs`: `id_col`, its counts, `base_failed` and `kept`.

    `labels` (`doc_id`, `quality`) says which documents are good (1) and poor (0); of several labels the
    lowest counts, null ones none. Null and empty texts fail the base rules; repeated rows each give a row
    and count each; without labels, or with too few to certify anything, only the base rules reject.
    """
    found = checkpoint(features(docs, id_col))
    known = labels.groupBy(F.col("doc_id").alias(id_col)).agg(F.min("quality").alias("quality"))
    labelled = found.where(~F.col("base_failed")).join(known, id_col)
    # One row for each length band: len(BANDS) + 1 at most.
    ruled = found.join(F.broadcast(certified_levels(labelled, alpha, delta)), "band", "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("level") <= F.col("used"), F.lit(False))
    return ruled.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
