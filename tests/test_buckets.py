"""Panels in buckets: the same rows, and no shuffle of obs by the columns of its buckets."""

import pytest
from pyspark.sql import functions as F

from tessara.operators import design, windows
from tessara.sources import panel

ROWS = "group_id string, series_id string, ds date, t int, y double"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    obs = spark.range(1800).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("group_id"), F.concat(F.lit("s"), (F.col("id") / 30).cast("int")).alias("series_id"),
        F.lit(None).cast("date").alias("ds"), (F.col("id") % 30).cast("int").alias("t"), (F.col("id") % 17).cast("double").alias("y"))
    obs = obs.withColumn("group_id", F.when(F.substring("series_id", 2, 5).cast("int") % 3 == 0, "hot").otherwise(F.lit("cold")))
    folder = f"{tmp_path_factory.mktemp('panel')}/p"
    panel.write_panel({"obs": obs}, folder, buckets=6)
    return obs, folder


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_rows_and_plans(spark, written):
    obs, folder = written
    own = panel.read_panel(spark, folder, ("obs",))["obs"]
    assert own.columns == obs.columns and own.exceptAll(obs).isEmpty() and obs.exceptAll(own).isEmpty()
    made = windows.packed_windows(own, 6, 2), design.series_arrays(own, {"y": "y"}), windows.rolling_windows(own, 6, 2)
    assert [exchanges(x) for x in made] == [0, 0, 0]
    want = windows.packed_windows(obs, 6, 2), design.series_arrays(obs, {"y": "y"}), windows.rolling_windows(obs, 6, 2)
    assert exchanges(want[0]) == exchanges(want[1]) == 1
    for got, rows in zip(made, want, strict=True):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    arrays = made[1]
    assert exchanges(arrays.hint("merge").join(design.series_arrays(own, {"z": "y"}), ["group_id", "series_id"])) == 0  # nor for joins


def test_another_session_opens_the_buckets(spark, written):
    _, folder = written
    other = spark.newSession()
    own = panel.read_panel(other, folder, ("obs",))["obs"]
    assert exchanges(design.series_arrays(own, {"y": "y"})) == 0 and own.count() == 1800
    again = panel.read_panel(other, folder, ("obs",))["obs"]
    assert again.count() == own.count() == 1800


def test_layouts_follow_each_other(spark, written, tmp_path):
    obs, _ = written
    for buckets in (None, 4, 3, None):
        panel.write_panel({"obs": obs}, f"{tmp_path}/p", buckets=buckets)
        own = panel.read_panel(spark, f"{tmp_path}/p", ("obs",))["obs"]
        assert sorted(own.columns) == sorted(obs.columns) and own.count() == 1800 and own.agg(F.sum("y")).first() == obs.agg(F.sum("y")).first()


def test_no_rows(spark, tmp_path):
    panel.write_panel({"obs": spark.createDataFrame([], ROWS)}, f"{tmp_path}/p", buckets=4)
    assert panel.read_panel(spark, f"{tmp_path}/p", ("obs",))["obs"].collect() == []
