"""Runs read the fact tables a fixed number of times, and their fits have tasks by the size of what they read."""

import pytest
from pyspark.sql import functions as F

from tessara.operators import forecast, heads
from tessara.plans import domains
from tessara.plans.queries import QUERIES

D = "/root/testdata/sf0.001"
FACTS = ("orders.parquet", "lineitem.parquet", "customer.parquet", "supplier.parquet")


def facts_read(df):
    return [f for f in df.inputFiles() if any(x in f for x in FACTS)]


@pytest.mark.parametrize("name", ["r8_r10_run_naive", "r9_m11_run_panel_naive", "r9_packed_run_naive", "m10_scrps_by_level", "r1_seasonal_naive"])
def test_results_come_from_stored_tables(spark, name):
    assert facts_read(QUERIES[name](spark, D)) == []


def test_stored_tables_are_those_of_the_plan(spark):
    both = [(domains.orders_seg(spark, D), domains.orders_seg(spark, D, keep=True)), (domains.parts_panel(spark, D), domains.parts_panel(spark, D, keep=("y", "promo")))]
    for lazy, kept in both:
        assert lazy.keys() == kept.keys()
        for name in kept.keys() - {"lines"}:
            own = lazy[name].select(*kept[name].columns)
            assert facts_read(kept[name]) == []
            assert sorted(own.collect(), key=str) == sorted(kept[name].collect(), key=str), name


def test_fits_read_a_stored_table(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(heads, "skew_t_fit", lambda rows: (seen.append(rows), (0.0, 1.0, 5.0, 0.0))[1])
    monkeypatch.setattr(forecast, "skew_t_fit", heads.skew_t_fit)
    spread_out = spark.range(60).select(F.lit("").alias("group_id"), (F.col("id") % 10).cast("int").alias("t"), F.lit(0).alias("h"), F.concat(F.lit("s"), F.col("id") % 3).alias("series_id"), F.rand(3).alias("r")).repartition(64)
    forecast.heads_of(spread_out, [forecast.Candidate("skew_t", "skew_t")], 1, 2)
    assert seen[0].rdd.getNumPartitions() < 64 and seen[0].inputFiles() != []
