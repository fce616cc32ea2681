"""`python -m postmill CAPTURED OUT --keywords FILE [--site ID] [--as-of TIME]`: one run from captured pages to stored results."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from postmill.plans.whole_run import summary, whole_run
from postmill.sources.snapshots import read_keywords


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="postmill", description=__doc__)
    parser.add_argument("captured", help="folder of captured pages")
    parser.add_argument("out", help="folder of stored runs")
    parser.add_argument("--keywords", help="file of noise keywords, one a line")
    parser.add_argument("--site", help="only this board")
    parser.add_argument("--as-of", help="time of the run, as 2026-03-31T12:00:00 (UTC); now if it isn't given")
    parser.add_argument("--answers", help="table of `page` and `body`, the JSON answers of the board that gives them")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("postmill").getOrCreate()
    as_of = datetime.fromisoformat(given.as_of) if given.as_of else datetime.now(timezone.utc).replace(tzinfo=None)
    keywords = read_keywords(spark, given.keywords) if given.keywords else []
    answers = spark.read.parquet(given.answers) if given.answers else None
    try:
        stored = whole_run(spark, given.captured, given.out, keywords, as_of, given.site, answers)
    except ValueError as e:  # no such board
        print(e)
        return 1
    print(json.dumps(summary(spark, stored) | {"version": stored.version}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
