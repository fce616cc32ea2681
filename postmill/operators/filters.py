"""Which postings are kept when boards are gathered."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.times import within_month
from postmill.operators.tables import checkpoint

# What titles of jobs speak of.
JOB_WORDS = ("채용", "모집", "공고")


def minimal(keywords: list[str]) -> list[str]:
    """Keywords without those that contain another one, as these can't change an answer."""
    kept: list[str] = []
    for word in sorted(set(filter(None, keywords)), key=lambda w: (len(w), w)):
        if not any(k in word for k in kept):
            kept.append(word)
    return kept


def mentions(c: Column | str, keywords: list[str]) -> Column:
    """Whether a text contains a keyword, case and all, by one pattern of literals; a null has none."""
    words = minimal(keywords)
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    if not words:
        return F.lit(False)
    return text.rlike("|".join(map(re.escape, words)))


def is_job_title(title: Column | str) -> Column:
    """Whether a title speaks of a job at all; some boards mix in other news."""
    return mentions(title, list(JOB_WORDS))


#: Characters by which keywords of a table are looked up; shorter ones by all that they have.
GRAM = 3
#: Bytes of keywords up to which they are sent to the tasks; beyond, grams of texts are shuffled.
HELD = 8 << 20


def _grams(text: Column, length: Column) -> Column:
    """Distinct runs of so many characters in a text; none if it is shorter."""
    places = F.when(F.length(text) >= length, F.sequence(F.lit(1), F.length(text) - length + 1))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, length)))


def without_keywords(rows: DataFrame, column: str, keywords: DataFrame, held: int = HELD) -> DataFrame:
    """`rows` whose text in `column` contains no `word` of the table `keywords`, case and all; a null has none.

    A keyword is looked up by the one of its grams that the fewest texts have, and then compared whole. Equal texts are looked at once.
    Texts are never gathered, nor are more keywords than `held` bytes: grams are many times their texts, which estimates of size don't
    know, so how the two meet is said here.
    """
    words = keywords.select("word").where("coalesce(word, '') <> ''").distinct()
    words = words.withColumn("n", F.least(F.length("word"), F.lit(GRAM)))
    own = checkpoint(words.select("word", "n", F.explode(_grams(F.col("word"), F.col("n"))).alias("gram")))
    texts = checkpoint(rows.select(F.col(column).alias("_text")).where("_text is not null").distinct())
    lengths = F.array(*map(F.lit, range(1, GRAM + 1)))
    found = texts.select("_text", F.explode(lengths).alias("n")).select("_text", F.explode(_grams(F.col("_text"), F.col("n"))).alias("gram"))
    common = found.groupBy("gram").count()
    rarest = own.join(common.hint("merge"), "gram", "left").groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("count", F.lit(0)), "gram")).alias("gram"))
    rarest = checkpoint(rarest)
    size = rarest.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("gram")), F.lit(0))).first()[0]
    met = found.join(rarest.hint("broadcast" if size <= held else "merge"), "gram")
    noisy = met.where(F.contains("_text", F.col("word"))).select("_text").distinct()
    return rows.join(noisy, rows[column] == noisy["_text"], "left_anti")


def relevant_postings(postings: DataFrame, keywords: list[str] | DataFrame, as_of: datetime, spare_organizations: tuple[str, ...] = (), zone: str = "UTC") -> DataFrame:
    """`postings` with no noise keyword in `title` or `organization`, registered within a month.

    Keywords, a list or a table of `word`, also count inside the names of organizations; `spare_organizations` are exempt from that.
    """
    recent = postings.where(within_month("reg_date", as_of, zone=zone))
    if isinstance(keywords, DataFrame):
        kept = without_keywords(recent, "title", keywords)
        spared = F.coalesce(F.col("organization").isin(*spare_organizations), F.lit(False))
        rest = without_keywords(kept.where(~spared), "organization", keywords)
        return rest.unionByName(kept.where(spared)) if spare_organizations else rest
    noisy = mentions("organization", keywords)
    if spare_organizations:
        noisy = noisy & ~F.col("organization").isin(*spare_organizations)
    return recent.where(~mentions("title", keywords) & ~noisy)
