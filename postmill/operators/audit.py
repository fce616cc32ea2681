"""Audit of what was gathered against the text that a page shows."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import title_core, trim, units
from postmill.operators.filters import JOB_WORDS
from postmill.operators.tables import checkpoint

# Shares of matched titles from which a site passes, or is warned of.
PASS_SHARE, WARN_SHARE = 0.7, 0.3


def job_lines(text: str) -> F.Column:
    """Lines of a text that speak of jobs and have more than five characters."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.size(F.filter(lines, lambda x: x.rlike("|".join(JOB_WORDS)) & (units(trim(x)) > 5)))


#: Distinct cores of one automaton; those of a site with more are dealt to several, each with the site's text.
MOST_CORES = 100_000


def _shown(cores: pa.Table, pages: pa.Table) -> pa.Table:
    """Cores of a site that its texts hold, by one automaton of all of them."""
    machine = ahocorasick.Automaton()
    for core in cores["core"].to_pylist():
        machine.add_word(core, core)
    found: set[str] = set()
    if len(machine):
        machine.make_automaton()
        for text in pages["page_text"].to_pylist():
            found.update(core for _, core in machine.iter(text or ""))
    site = cores["site_id"][:1].to_pylist() * len(found)
    return pa.table({"site_id": pa.array(site, pa.string()), "core": pa.array(sorted(found), pa.string())})


def shown_cores(cores: DataFrame, pages: DataFrame) -> DataFrame:
    """Those of distinct `cores` (`site_id`, `core`) that stand in the text of their site's page (`site_id`, `page_text`).

    The cores of a site are one automaton, through which its text runs once; no text is copied for a title.
    """
    salts = cores.groupBy("site_id").agg(F.ceil(F.count("*") / MOST_CORES).cast("int").alias("salts"))
    dealt = cores.join(salts, "site_id").select("site_id", "core", F.pmod(F.xxhash64("core"), "salts").cast("int").alias("salt"))
    texts = pages.select("site_id", "page_text").join(salts, "site_id").select("site_id", "page_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return dealt.groupBy("site_id", "salt").cogroup(texts.groupBy("site_id", "salt")).applyInArrow(_shown, "site_id string, core string")


def judged(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """`site_id`, `post_ord`, `title` and `hit` of each posting: whether its title's core stands in the text of its site's page."""
    items = postings.select("site_id", "post_ord", "title", title_core("title").alias("core"))
    shown = shown_cores(items.where("core <> ''").select("site_id", "core").distinct(), pages).withColumn("_shown", F.lit(True))
    return items.join(shown, ["site_id", "core"], "left").select("site_id", "post_ord", "title", F.coalesce("_shown", F.lit(False)).alias("hit"))


def audit(postings: DataFrame, pages: DataFrame, titles: bool = True) -> DataFrame:
    """A verdict for each row of `pages` (`site_id`, `page_text`, `crawl_error`, `check_error`).

    Every site of `pages` is judged, without postings too. A title counts as matched if its core
    stands in the page's text. Sites that failed to crawl are skipped, those that failed to be checked fail. Without `titles`
    there are only counts, and no list of unmatched titles is gathered.
    """
    items = checkpoint(judged(postings, pages))
    counts = items.groupBy("site_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("m"))
    sites = pages.select("site_id", job_lines("page_text").alias("lines"), "crawl_error", "check_error").join(counts, "site_id", "left")
    sites = sites.withColumns({"n": F.coalesce("n", F.lit(0)).cast("int"), "m": F.coalesce("m", F.lit(0)).cast("int")})
    if titles:
        missed = items.where("not hit").groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("post_ord", "title"))).alias("missed"))
        sites = sites.join(missed.withColumn("missed", F.transform("missed", lambda x: x["title"])), "site_id", "left").withColumn("missed", F.coalesce("missed", F.array().cast("array<string>")))
    n, m = F.col("n"), F.col("m")
    skipped, broken = F.coalesce("crawl_error", F.lit("")) != "", F.coalesce("check_error", F.lit("")) != ""
    status = (
        F.when(skipped, "skip").when(broken, "fail").when((n == 0) & (F.col("lines") == 0), "pass").when(n == 0, "warn")
        .when(m == n, "pass").when(m >= n * F.lit(PASS_SHARE), "pass").when(m >= n * F.lit(WARN_SHARE), "warn").otherwise("fail")
    )
    off = skipped | broken
    share = F.floor(m / n * 100 + 0.5).cast("int").cast("string")
    text = lambda c: c.cast("string")
    # What a verdict says.
    message = (
        F.when(skipped, F.concat(F.lit("크롤링 에러로 스킵: "), "crawl_error")).when(broken, F.concat(F.lit("검증 중 에러: "), "check_error"))
        .when((n == 0) & (F.col("lines") == 0), "공고 없음 확인 (정상)").when(n == 0, F.concat(F.lit("크롤링 0건이나 페이지에 채용 키워드 "), text(F.col("lines")), F.lit("건 감지")))
        .when(m == n, F.concat(F.lit("전체 "), text(n), F.lit("건 제목 매칭 성공")))
        .when(m >= n * F.lit(PASS_SHARE), F.concat(text(n), F.lit("건 중 "), text(m), F.lit("건 매칭 ("), share, F.lit("%)")))
        .when(m >= n * F.lit(WARN_SHARE), F.concat(text(n), F.lit("건 중 "), text(m), F.lit("건만 매칭 ("), share, F.lit("%)")))
        .otherwise(F.concat(text(n), F.lit("건 중 "), text(m), F.lit("건만 매칭 - 크롤러 점검 필요")))
    )
    zero, none = F.lit(0), F.array().cast("array<string>")
    unmatched = [F.when(off, none).otherwise(F.col("missed")).alias("unmatched")] if titles else []
    return sites.select(
        "site_id", status.alias("status"), F.when(skipped, zero).otherwise(n).alias("crawled"), F.when(off, zero).otherwise(F.col("lines")).alias("actual"),
        F.when(off, zero).otherwise(m).alias("matched"), *unmatched,
        F.when(off | (n == 0), None).otherwise(F.floor(m / n * 100 + 0.5)).cast("int").alias("percent"), message.alias("message"),
    )


def audit_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail", "skip")))


def shown_unmatched(postings: DataFrame, pages: DataFrame, most: int = 3) -> DataFrame:
    """Unmatched titles of judged sites that have one to `most` of them, in order: sites are chosen by their counts, and only their titles numbered."""
    items = checkpoint(judged(postings, pages))
    few = items.where("not hit").groupBy("site_id").count().where(F.col("count") <= most).select("site_id")
    ok = pages.where("coalesce(crawl_error, '') = '' and coalesce(check_error, '') = ''").select("site_id")
    nth = F.row_number().over(Window.partitionBy("site_id").orderBy("post_ord")) - 1
    return items.where("not hit").join(few, "site_id").join(ok, "site_id").select("site_id", nth.alias("nth"), "title")
