"""The seasonal figure: missions by solar activity, in one job, and its drawing."""

from __future__ import annotations

import argparse
import importlib.util

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import row_label
from ..functions.time import BUCKETS
from ..operators.binstats import figure_bins, metric_columns, mission_summary, with_bins, with_midpoint
from ..operators.filters import mission_filter
from ..operators.ratios import with_mission
from ..schemas import ALTITUDE
from ..session import session
from ..sources.tables import scan, write

#: Aliases of the metrics in the figure, and those that may be missing.
RATIOS = {"msis_00": "ln_density_ratio_0", "msis_20": "ln_density_ratio_2.0", "msis_21": "ln_density_ratio_2.1", "matlab": "ln_density_ratio_matlab_density"}
OPTIONAL = ("msis_21", "matlab")


def figure_data(missions: Mapping[str, DataFrame], mode: str = "uncertainty_of_mean", metrics: Mapping[str, str] = RATIOS, optional: Sequence[str] = OPTIONAL) -> tuple[DataFrame, DataFrame]:
    """The points of the figure (mission, bucket, seasonal_bin, day_of_year, <alias>_mean, <alias>_std, count), and its
    row labels (mission, label).  One plan for all missions and buckets."""
    rows = with_mission(dict(missions))
    points = with_midpoint(figure_bins(with_bins(rows), metric_columns(rows, metrics, optional), mode, ("mission", "bucket")))
    summary = mission_summary(rows, keys=("mission",))
    labels = summary.select("mission", row_label(F.col("mission"), F.col("min_alt_km") * 1000, F.col("max_alt_km") * 1000, F.col("start"), F.col("end")).alias("label"))
    return points.orderBy("mission", "bucket", "seasonal_bin"), labels


def sample_observations(spark: SparkSession, n: int = 5_000, start: str = "2003-01-01", hours: int = 8_760, seed: int = 42) -> DataFrame:
    """Made-up observations to try the figure on: ``n`` hours, drawn with replacement from ``hours`` in a row, with flux,
    altitude and log ratios that follow the season."""
    at = F.expr(f"timestamp_ntz '{start}'") + F.make_interval(hours=F.floor(F.rand(seed) * hours).cast("int"))
    season = F.sin(F.dayofyear("timestamp") * 0.0172)
    rows = spark.range(n).select(at.alias("timestamp"), (70 + 150 * F.rand(seed + 1)).alias("f107a"), (3e5 + 1e5 * F.rand(seed + 2)).alias(ALTITUDE))
    return rows.withColumns({RATIOS["msis_00"]: 0.1 * season + 0.05 * F.randn(seed + 3), RATIOS["msis_20"]: 0.08 * season + 0.05 * F.randn(seed + 4)})


def draw(points: DataFrame, labels: DataFrame, path: str, title: str | None = None) -> None:
    """Draws the figure to a file; needs matplotlib.  At most 12 points for each panel come to the driver."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    data, names = points.toPandas(), dict(labels.orderBy("mission").toPandas().itertuples(index=False))
    fig, axes = plt.subplots(len(names), len(BUCKETS), figsize=(12, 3.5 * len(names)), squeeze=False, sharex=True)
    for row, (mission, label) in enumerate(names.items()):
        for column, bucket in enumerate(BUCKETS):
            axis, own = axes[row][column], data[(data["mission"] == mission) & (data["bucket"] == bucket)]
            for name in [x.removesuffix("_mean") for x in own.columns if x.endswith("_mean")]:
                axis.errorbar(own["day_of_year"], own[f"{name}_mean"], yerr=own[f"{name}_std"], marker="o", capsize=2, label=name)
            axis.axhline(0, linewidth=0.5)
            axis.set_title(f"({chr(ord('a') + row * len(BUCKETS) + column)}) F10.7a {bucket}" + (f"\n{label}" if not column else ""), fontsize=9)
    axes[0][0].legend(fontsize=8)
    fig.suptitle(title or "")
    fig.savefig(path, dpi=300, bbox_inches="tight")
    plt.close(fig)


#: The three comparisons: file name, uncertainty, and whether 2005 is left out of the first mission.
VARIANTS = (
    ("daily_mean_sem_from_2006", "uncertainty_of_mean", False),
    ("daily_mean_sem_from_2005", "uncertainty_of_mean", True),
    ("raw_observation_sem_from_2006", "raw_observation_uncertainty", False),
)


def comparisons(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Points and labels of each of ``VARIANTS`` for the analysed tables at ``paths`` (by mission)."""
    out = {}
    for name, mode, exclude_2005 in VARIANTS:
        missions = {m: scan(spark, p).where(mission_filter(m, exclude_2005)) for m, p in paths.items()}
        out[name] = figure_data(missions, mode)
    return out


def main(arguments: Sequence[str] | None = None) -> int:
    """Saves the points and labels of the three comparisons as Parquet, and draws them where matplotlib is installed."""
    parser = argparse.ArgumentParser(prog="figure", description=main.__doc__)
    parser.add_argument("tables", nargs="+", metavar="MISSION=PATH", help="analysed tables")
    parser.add_argument("--folder", required=True)
    given = parser.parse_args(arguments)
    spark = session("figure")
    for name, (points, labels) in comparisons(spark, dict(t.split("=", 1) for t in given.tables)).items():
        write(points, f"{given.folder}/{name}/points")
        write(labels, f"{given.folder}/{name}/labels")
        if importlib.util.find_spec("matplotlib"):
            draw(points, labels, f"{given.folder}/{name}.png", name.replace("_", " "))
        print(f"{given.folder}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
