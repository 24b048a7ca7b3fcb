"""Command line: summary, bin statistics and maxima of each mission's analysed table."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.time import BUCKETS
from ..operators.binstats import bin_stats, maxima, metric_columns, mission_summary, printed, with_bins
from ..operators.filters import mission_filter
from ..schemas import METRICS, MISSIONS
from ..session import session
from ..sources.tables import scan


def report(spark: SparkSession, mission: str, path: str, metric: str, exclude_2005: bool) -> dict[str, object]:
    """The three tables of a mission: summary, bins (by bucket and bin) and maxima."""
    rows = scan(spark, path).where(mission_filter(mission, exclude_2005))
    metric_columns(rows, {"x": metric})
    stats = bin_stats(with_bins(rows).where("bucket is not null"), metric)
    return {"summary": mission_summary(rows), "bins": printed(stats).orderBy("bucket", "bin"), "maxima": maxima(stats)}


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("tables", nargs="+", metavar="MISSION=PATH", help=f"analysed tables of {', '.join(MISSIONS)}")
    parser.add_argument("--exclude-champ-2005", action="store_true")
    parser.add_argument("--metric", choices=METRICS, default=METRICS[1])
    given = parser.parse_args(arguments)
    spark = session("stats")
    for table in given.tables:
        mission, _, path = table.partition("=")
        tables = report(spark, mission, path, given.metric, given.exclude_champ_2005)
        print(f"## {mission}")
        tables["summary"].show(truncate=False)
        for bucket in BUCKETS:
            print(f"F10.7a {bucket}")
            tables["bins"].where(F.col("bucket") == bucket).drop("bucket").show(20, truncate=False)
            tables["maxima"].where(F.col("bucket") == bucket).drop("bucket").show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
