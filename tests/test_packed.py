"""Draws as arrays against draws as rows."""

import math

import pytest
from pyspark.sql import functions as F

from tessara.operators import forecast, hierarchy, packed, sampling, scoring

KEYS = "group_id string, group_no long, t int, h int, series_id string, series_no int, mu double, sigma double"


def params(spark):
    rows = [(f"g{g}", g - 1, 5 * t, h, f"s{s}", s, 3.0 * s - 4, 0.5 + s) for g in range(3) for t in range(2) for h in range(3) for s in range(5)]
    return spark.createDataFrame(rows, KEYS).withColumn("loadings", F.array(F.lit(0.7), F.col("mu") / 3))


def kinds(spark):
    base = params(spark)
    skew = base.withColumn("nu", F.lit(7.0)).withColumn("lam", F.col("series_no") - 2.0)
    mixture = base.drop("mu", "sigma").withColumns({"mu_k": F.array(F.lit(1.0), F.lit(9.0)), "sigma_k": F.array(F.lit(0.5), F.lit(2.0)), "logits": F.array(F.lit(0.2), F.lit(0.4))})
    return base, skew, mixture


def edges(spark):
    bottom = spark.createDataFrame([(f"s{s}", "odd" if s % 2 else "even") for s in range(5)], "series_id string, parity string")
    return hierarchy.build_hierarchy(bottom, [("Total", []), ("Parity", ["parity"])])


def close(got, want, keys):
    a, b = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and a
    value = next(c for c in ("y", "crps", "spread", "score", "scrps") if c in got.columns and c in want.columns)
    assert all(math.isclose(a[k][value], b[k][value], rel_tol=1e-9, abs_tol=1e-9) for k in a)


@pytest.mark.parametrize("seed", [0, 11, -3])
def test_draws_of_each_kind_are_those_of_rows(spark, monkeypatch, seed):
    monkeypatch.setattr(packed, "AT_ONCE", 40)  # a few rows at once
    for rows, components in zip(kinds(spark), (0, 0, 2), strict=True):
        got = packed.unpacked(packed.sample_packed(rows, 9, seed, 2, components))
        close(got, sampling.sample(rows, 9, seed, 2, components), ["group_id", "t", "h", "series_id", "i"])


def test_kinds_and_seeds_in_one_pass(spark):
    made = [forecast.uniform(x).withColumn("candidate", F.lit(name)) for name, x in zip("fsm", kinds(spark), strict=True)]
    rows = made[0].unionByName(made[1]).unionByName(made[2]).crossJoin(spark.createDataFrame([(0,), (4,)], "seed int"))
    options = dict(components=2, keep=("candidate",))
    close(packed.unpacked(packed.sample_packed(rows, 7, "seed", 2, **options)), sampling.sample(rows, 7, "seed", 2, **options), ["candidate", "seed", "group_id", "t", "h", "series_id", "i"])


@pytest.mark.parametrize("clip", [True, False])
def test_sums_of_arrays_are_those_of_rows(spark, clip):
    _, below = edges(spark)
    below = below.withColumn("weight", F.when(F.col("node_id") == "odd", F.lit(-0.5)).otherwise(F.col("weight")))
    got = packed.unpacked(packed.coherent_packed(params(spark), below, 8, 2, 2, clip))
    close(got, sampling.sample_coherent(params(spark), below, 8, 2, 2, clip), ["group_id", "t", "h", "node_id", "i"])


def test_scores_take_arrays(spark):
    _, below = edges(spark)
    arrays, rows = packed.coherent_packed(params(spark), below, 12, 2, 2), sampling.sample_coherent(params(spark), below, 12, 2, 2)
    rows = rows.withColumn("y", F.round("y", 0))  # ties
    arrays = arrays.withColumn("ys", F.transform("ys", lambda y: F.round(y, 0)))
    truth = arrays.select("group_id", "t", "h", "node_id", (F.get("ys", F.lit(3)) + 0.3).alias("truth"))
    for score in (scoring.crps_quantile, scoring.crps_mc):
        close(score(arrays, truth), score(rows, truth), scoring.NODE)
    close(scoring.pairwise_abs_mean(arrays), scoring.pairwise_abs_mean(rows), scoring.NODE)
    close(scoring.energy_score(arrays, truth), scoring.energy_score(rows, truth), ["group_id", "t"])
    one = packed.coherent_packed(params(spark), below, 1, 2, 2)
    assert math.isfinite(scoring.crps_quantile(one, truth).first().crps)
    with pytest.raises(Exception, match="two samples or more"):
        scoring.crps_mc(one, truth).collect()


def test_evaluation_is_that_of_rows(spark):
    nodes, below = edges(spark)
    obs = spark.createDataFrame([(f"g{g}", f"s{s}", t, float((7 * s + 3 * t + g) % 11)) for g in range(3) for s in range(5) for t in range(9)], "group_id string, series_id string, t int, y double")
    at = spark.createDataFrame([(f"g{g}", t) for g in range(3) for t in (0, 5)], "group_id string, t int")
    for estimator in ("quantile", "mc"):
        got, want = (forecast.evaluate(params(spark), obs, at, below, nodes, 3, 15, 2, [0, 3], estimator, packed=p) for p in (True, False))
        close(got, want, ["seed", "level"])


def shuffled(df):
    """Rows that a finished query's exchanges wrote."""
    df.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_shuffle_carries_a_row_a_cell(spark):
    _, below = edges(spark)
    n = 40
    arrays, rows = (shuffled(draw(params(spark), below, n, 2, 2)) for draw in (packed.coherent_packed, sampling.sample_coherent))
    edge_rows = below.count() + params(spark).count()  # what a shuffled join would move
    assert 0 < arrays and rows > (n / 2) * max(1, arrays - edge_rows)


def test_rows_that_lack_something(spark):
    _, below = edges(spark)
    none = params(spark).where("false")
    assert packed.coherent_packed(none, below, 3, 1, 2).collect() == []
    some = params(spark).withColumn("mu", F.when(F.col("series_id") != "s1", F.col("mu"))).withColumn("loadings", F.when(F.col("series_id") != "s2", F.col("loadings")))
    got = {r.series_id: r.ys for r in packed.sample_packed(some, 3, 1, 2).where("group_id = 'g0' AND t = 0 AND h = 0").collect()}
    assert got["s1"] is None and len(got["s2"]) == 3 and all(map(math.isfinite, got["s2"]))
    nodes = {r.node_id for r in packed.coherent_packed(some, below, 3, 1, 2).collect()}
    assert "s1" not in nodes and {"odd", "Total", "s3"} <= nodes
    with pytest.raises(ValueError, match="lack"):
        packed.sample_packed(params(spark).drop("sigma"), 3, 1, 2)
    with pytest.raises(Exception, match="null series_no"):
        packed.sample_packed(params(spark).withColumn("series_no", F.lit(None).cast("int")), 3, 1, 2).collect()
