"""Every query with SQL gives the rows of its SQL."""

import pytest

from orbiteer import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(spark, sf_dir, same_rows, name):
    assert name in queries.ORACLES
    same_rows(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_paper_mode_is_close_to_the_population_deviation(spark, sf_dir):
    from pyspark.sql import functions as F

    paper, sample = queries.fig_paper(spark, sf_dir), queries.fig_sample_std(spark, sf_dir)
    both = paper.alias("p").join(sample.alias("s"), ["bucket", "seasonal_bin"]).where("p.count > 1")
    off = F.abs(F.col("p.msis_20_std") - F.col("s.msis_20_std") * F.sqrt((F.col("p.count") - 1) / F.col("p.count")))
    assert both.agg(F.max(off)).first()[0] < 1e-5


def test_pruned_scan(spark, sf_dir):
    """A two-column figure doesn't read the table's other columns."""
    plan = queries.fig_uncertainty_of_mean(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" not in plan and "l_suppkey" not in plan
