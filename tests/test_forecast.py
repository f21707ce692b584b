"""Feature assembly, heads and the choice between candidates."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessara.operators import design, features, forecast, heads, hierarchy, sampling, scaling, windows

STEPS, SIZE, H = 40, 6, 3


def made_panel(spark):
    """Two groups of four series whose values follow a static name, a static number, a calendar column and a promotion of the series."""
    draw = random.Random(1)
    series = [f"{r}-{s}" for r in ("north", "south") for s in ("p", "q")]
    weather = [draw.gauss(0, 1) for _ in range(STEPS)]
    promo = {(g, s, t): float(draw.random() < 0.3) for g in ("u", "v") for s in series for t in range(STEPS)}
    size = {"north-p": 3.0, "north-q": -1.0, "south-p": 0.5, "south-q": 2.0}
    y = {(g, s, t): 20 + 8 * s.startswith("north") + 2 * size[s] + 3 * weather[t] + 5 * promo[g, s, t] + draw.gauss(0, 0.1) for g in ("u", "v") for s in series for t in range(STEPS)}
    rows = lambda values, name: spark.createDataFrame([(*k, v) for k, v in values.items()], f"group_id string, series_id string, t int, {name} double")
    bottom = spark.createDataFrame([(s, s.split("-")[0]) for s in series], "series_id string, region string")
    nodes, edges = hierarchy.build_hierarchy(bottom, [("Total", []), ("Region", ["region"])])
    calendar = spark.createDataFrame([(f"2020-01-{1 + t:02d}" if t < 31 else f"2020-02-{t - 30:02d}", t) for t in range(STEPS)], "ds string, t int").withColumn("ds", F.col("ds").cast("date"))
    tables = {"obs": rows(y, "y"), "nodes": nodes, "edges": edges, "calendar": calendar}
    blocks = {
        "names": features.grouped_static_dummies(bottom, ["region"]),
        "identity": features.identity_dummies(bottom),
        "size": spark.createDataFrame(list(size.items()), "series_id string, size double"),
        "weather": spark.createDataFrame(list(enumerate(weather)), "t int, weather double"),
        "promo": rows(promo, "promo"),
    }
    return tables, blocks, y, weather, promo, size, series


def columns(vector):
    return vector.toArray().tolist()


def test_every_block_reaches_its_place_in_the_vector(spark):
    tables, b, y, weather, promo, size, series = made_panel(spark)
    anchors = features.seasonal_naive_anchor(tables["obs"], [4], H)
    blocks = features.build_features([("static", b["names"]), ("static", b["identity"]), ("static", b["size"]), ("future_shared", b["weather"]), ("future_series", anchors), ("future_series", b["promo"]), ("hist", b["promo"])])
    at = spark.createDataFrame([("u", 10), ("v", 37), ("v", 2), ("v", 38)], "group_id string, t int")
    got = {(r.group_id, r.t, r.h, r.series_id): r for r in design.design(tables["obs"], at, SIZE, H, "standard", design.prepared(blocks, 30)).collect()}
    assert {k[:2] for k in got} == {("u", 10), ("v", 37)} and len(got) == 2 * H * 4  # a window without a whole past or target is none
    known = [v for (_, _, t), v in promo.items() if t < 30]
    mean, deviation = np.mean(known), np.std(known) + 1e-6
    names = ["north-p", "north-q", "region=north", "region=south", "south-p", "south-q"]
    for (g, t, h, s), r in got.items():
        past = [y[g, s, i] for i in range(t - SIZE, t)]
        loc, scale = np.mean(past), np.std(past, ddof=1) + 1e-6
        want = [(x - loc) / scale for x in past] + [float(h == k) for k in range(H)] + [weather[t + h], (y[g, s, t + h - 4] - loc) / scale, promo[g, s, t + h]]
        want += [(promo[g, s, i] - mean) / deviation for i in range(t - SIZE, t)]
        want += [float(n in (s, f"region={s.split('-')[0]}")) for n in names] + [size[s]]
        assert np.allclose(columns(r.features), want, atol=1e-9) and math.isclose(r.label, (y[g, s, t + h] - loc) / scale, abs_tol=1e-9)


def test_array_statistics_equal_those_of_rows(spark):
    tables, *_ = made_panel(spark)
    rows = windows.rolling_windows(tables["obs"], SIZE, H)
    arrays = design.windows_of(design.series_arrays(tables["obs"], {"y": "y"}), rows.select("group_id", "t"), SIZE, H)
    for scaler in scaling.SCALERS:
        want = {tuple(r[:3]): tuple(r[3:]) for r in scaling.scale_stats(rows, scaler).collect()}
        loc, scale = scaling.array_stats(F.col("past"), scaler)
        got = {tuple(r[:3]): tuple(r[3:]) for r in arrays.select("group_id", "t", "series_id", loc, scale).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want), scaler
    with pytest.raises(Exception, match="missing or repeated"):
        design.series_arrays(tables["obs"].where("t <> 5"), {"y": "y"}).collect()


def test_only_features_carry_the_signal_and_the_fit_is_the_normal_equations(spark):
    tables, b, *_ = made_panel(spark)
    at = spark.createDataFrame([(g, t) for g in ("u", "v") for t in range(SIZE, STEPS - H + 1)], "group_id string, t int")

    def mse(blocks):
        rows = design.design(tables["obs"], at, SIZE, H, "identity", design.prepared(features.build_features(blocks)))
        fitted = forecast.predict_pooled(forecast.fit_pooled(rows, 1e-5), rows)
        one = rows.collect()
        x, y = np.array([columns(r.features) for r in one]), np.array([r.label for r in one])
        cx, cy = x - x.mean(0), y - y.mean()
        exact = float(np.mean((cy - cx @ np.linalg.solve(cx.T @ cx / len(y) + 1e-5 * np.eye(x.shape[1]), cx.T @ cy / len(y))) ** 2))
        got = fitted.agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2.0))).first()[0]
        assert math.isclose(got, exact, rel_tol=0.02, abs_tol=1e-6)
        return got

    none = mse([])
    static = mse([("static", b["names"]), ("static", b["size"])])
    future = mse([("future_shared", b["weather"]), ("future_series", b["promo"])])
    both = mse([("static", b["names"]), ("static", b["size"]), ("future_shared", b["weather"]), ("future_series", b["promo"])])
    assert both < 0.05 * none and future < 0.5 * none and both < future and static <= none + 1e-9


def test_a_run_sees_its_blocks(spark):
    tables, b, *_ = made_panel(spark)
    blocks = features.build_features([("static", b["names"]), ("future_shared", b["weather"]), ("future_series", b["promo"]), ("hist", b["promo"])])
    scores = {}
    for name, own in (("blind", None), ("seeing", blocks)):
        rows = forecast.run_panel(tables, SIZE, H, 4, [0], n=60, k=1, candidates=("pooled",), blocks=own).collect()
        scores[name] = next(r.scrps for r in rows if r.level == "Bottom")
    assert scores["seeing"] < 0.5 * scores["blind"]


def test_all_kinds_of_candidates_run_in_one_job(spark, monkeypatch):
    tables, b, *_ = made_panel(spark)
    seen, plans = [], []
    monkeypatch.setattr(forecast, "best_candidate", lambda scores, best=forecast.best_candidate: plans.append(scores._jdf.queryExecution().optimizedPlan().toString()) or seen.extend(scores.collect()) or best(scores))
    blocks = features.build_features([("future_shared", b["weather"]), ("future_series", b["promo"])])
    rows = forecast.run_panel(tables, SIZE, H, 4, [0, 1], n=40, k=1, candidates=("naive", "pooled", "mixture", "skew_t"), blocks=blocks).collect()
    by_name = {r.candidate: r.scrps for r in seen}
    assert set(by_name) == {"naive", "pooled", "mixture", "skew_t"} and all(by_name[k] < by_name["naive"] for k in ("pooled", "mixture", "skew_t"))
    assert {r.candidate for r in rows} == {min(by_name, key=by_name.get)} and {(r.seed, r.level) for r in rows} == {(s, x) for s in (0, 1) for x in ("Total", "Region", "Bottom", "Overall")}
    assert len(re.findall(r"Generate explode.*\[i#", plans[0])) == 1  # one sampling branch


def test_the_grid_of_scalers_and_lags(spark, monkeypatch):
    tables, *_ = made_panel(spark)
    seen = []
    monkeypatch.setattr(forecast, "best_candidate", lambda scores, best=forecast.best_candidate: seen.extend(scores.collect()) or best(scores))
    several = forecast.grid(["mean", "standard"], [3, 4, 12])
    forecast.run_panel(tables, SIZE, H, 4, [0], n=20, k=1, candidates=several).collect()
    by_name = {r.candidate: r.scrps for r in seen}
    assert set(by_name) == {"naive-3", "naive-4", "naive-12", "pooled-mean", "pooled-standard"}
    seen.clear()
    forecast.run_panel(tables, SIZE, H, 4, [0], n=20, k=1, candidates=(forecast.Candidate("a", "naive", lag=12), forecast.Candidate("b", "naive", lag=3))).collect()
    assert {r.candidate: round(r.scrps, 9) for r in seen} == {"a": round(by_name["naive-12"], 9), "b": round(by_name["naive-3"], 9)}
    with pytest.raises(ValueError, match="one name"):
        forecast.run_panel(tables, SIZE, H, 4, [0], candidates=("naive", "naive"))


def residual_rows(spark, matrix):
    n, w = matrix.shape
    return spark.createDataFrame([("", i // 3, i % 3, f"s{j:05d}", float(matrix[i, j])) for i in range(n) for j in range(w)], "group_id string, t int, h int, series_id string, r double")


def exact_factors(matrix, k):
    centred = matrix - matrix.mean(0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    return (v[:k] * s[:k, None]).T / math.sqrt(len(matrix) - 1), centred.var(0, ddof=1)


@pytest.mark.parametrize("wide", [25, 90])
def test_factors_are_the_principal_components(spark, wide):
    draw = np.random.default_rng(3)
    matrix = draw.normal(size=(200, 3)) @ draw.normal(size=(3, wide)) * np.array([3.0] * wide) + draw.normal(size=(200, wide)) + 2
    loads, variance = exact_factors(matrix, 2)
    got = {r.series_id: r for r in heads.factor_spread(residual_rows(spark, matrix), 2).collect()}
    mine = np.array([got[f"s{j:05d}"].loadings for j in range(wide)])
    assert np.allclose(mine @ mine.T, loads @ loads.T, rtol=1e-4, atol=1e-3 * variance.max())
    assert np.allclose([got[f"s{j:05d}"].sigma ** 2 for j in range(wide)], np.maximum(variance - (loads**2).sum(1), 1e-6), rtol=1e-3, atol=1e-3)


def test_a_missing_residual_counts_as_zero_and_few_series_pad_their_loadings(spark):
    matrix = np.random.default_rng(4).normal(size=(60, 2)) + 1
    rows = residual_rows(spark, matrix).where("NOT (series_id = 's00001' AND t = 3)")
    matrix[9:12, 1] = 0
    loads, variance = exact_factors(matrix, 2)
    got = {r.series_id: r for r in heads.factor_spread(rows, 3).collect()}
    mine = np.array([got[f"s{j:05d}"].loadings for j in range(2)])
    assert mine.shape == (2, 3) and np.allclose(mine @ mine.T, loads @ loads.T, atol=1e-6)
    with pytest.raises(ValueError, match="two steps"):
        heads.factor_spread(rows.limit(1), 1)


def test_factors_of_a_wide_hierarchy_need_no_wide_matrix(spark):
    wide, n = 20_000, 12
    cells = spark.range(n * wide, numPartitions=8).select(F.lit("").alias("group_id"), (F.col("id") % n).cast("int").alias("t"), F.lit(0).alias("h"), F.floor(F.col("id") / n).cast("string").alias("series_id"))
    shared = F.sin(1.0 + F.col("t") * 1.7) * (1 + F.col("series_id").cast("long") % 5)
    rows = cells.withColumn("r", shared + 0.01 * F.cos(F.col("series_id").cast("double") * 12.9 + F.col("t") * 78.2))
    got = heads.factor_spread(rows, 1, rounds=4)
    level = np.sin(1.0 + np.arange(n) * 1.7).std(ddof=1)
    off = got.select(F.max(F.abs(F.abs(F.col("loadings")[0]) - level * (1 + F.col("series_id").cast("long") % 5))), F.count("*")).first()
    assert off[1] == wide and off[0] < 0.05


def drawn_skew_t(spark, n, nu, lam, mu=0.0, sigma=1.0):
    params = spark.range(n).select(F.lit(0).alias("group_no"), F.col("id").cast("int").alias("series_no"), F.lit("").alias("group_id"), F.lit(0).alias("t"), F.lit(0).alias("h"), F.col("id").cast("string").alias("series_id"), F.lit(mu).alias("mu"), F.lit(sigma).alias("sigma"), F.array(F.lit(0.0)).alias("loadings"), F.lit(nu).alias("nu"), F.lit(lam).alias("lam"))
    return sampling.sample_skew_t(params, 1, 5, 0).select(F.col("y").alias("r"))


@pytest.mark.parametrize(("nu", "lam", "mu", "sigma"), [(6.0, 2.0, 0.0, 1.0), (12.0, -3.0, 4.0, 0.5)])
def test_likelihood_recovers_the_noise_that_was_drawn(spark, nu, lam, mu, sigma):
    xi, omega, got_nu, got_lam = heads.skew_t_fit(drawn_skew_t(spark, 40_000, nu, lam, mu, sigma))
    assert abs(xi - mu) < 0.06 * sigma and abs(omega - sigma) < 0.06 * sigma and abs(got_nu - nu) < 0.2 * nu and abs(got_lam - lam) < 0.15 * abs(lam)
    with pytest.raises(ValueError, match="differ"):
        heads.skew_t_fit(spark.range(5).select(F.lit(1.0).alias("r")))


def test_density_integrates_to_one():
    z = np.linspace(-400, 400, 400_001)
    for nu, lam in ((3.0, 4.0), (30.0, -2.0), (8.0, 0.0)):
        assert abs(np.exp(heads.log_skew_t(z, 0.3, 1.2, lam, nu)).sum() * (z[1] - z[0]) - 1) < 1e-3


def test_mixed_rows_are_drawn_as_their_own_kind_alone(spark):
    base = spark.createDataFrame([("", 0, t, h, "a", 3, 5.0, 2.0) for t in range(3) for h in range(2)], "group_id string, group_no int, t int, h int, series_id string, series_no int, mu double, sigma double").withColumn("loadings", F.array(F.lit(0.7)))
    skew = base.withColumn("nu", F.lit(7.0)).withColumn("lam", F.lit(1.5))
    mixture = base.drop("mu", "sigma").withColumns({"mu_k": F.array(F.lit(1.0), F.lit(9.0)), "sigma_k": F.array(F.lit(0.5), F.lit(2.0)), "logits": F.array(F.lit(0.2), F.lit(0.4))})
    take = lambda df: sorted((r.t, r.h, r.i, round(r.y, 9)) for r in df.collect())
    rows = [forecast.uniform(x).withColumn("candidate", F.lit(name)) for name, x in (("f", base), ("s", skew), ("m", mixture))]
    both = sampling.sample(rows[0].unionByName(rows[1]).unionByName(rows[2]), 9, 4, 1, components=2, keep=("candidate",))
    for name, alone in (("f", sampling.sample_factor(base, 9, 4, 1)), ("s", sampling.sample_skew_t(skew, 9, 4, 1)), ("m", sampling.sample_mixture(mixture, 9, 4, 1, 2))):
        assert take(both.where(F.col("candidate") == name)) == take(alone), name


def test_a_users_model_gets_batches_of_windows(spark):
    tables, _, y, *_ = made_panel(spark)
    at = spark.createDataFrame([(g, t) for g in ("u", "v") for t in range(SIZE, STEPS - H + 1)], "group_id string, t int")

    def model(frame):
        past = np.stack(frame["past"].to_numpy())
        return frame[["group_id", "t", "series_id"]].assign(mu=past.mean(axis=1), rows=len(frame))

    got = forecast.own_model_batches(tables["obs"], at, SIZE, H, model, "group_id string, t int, series_id string, mu double, rows long").collect()
    assert len(got) == 2 * 4 * (STEPS - H - SIZE + 1) and max(r["rows"] for r in got) > 8
    assert all(math.isclose(r.mu, sum(y[r.group_id, r.series_id, i] for i in range(r.t - SIZE, r.t)) / SIZE) for r in got)


def test_validation_windows_are_a_subsample(spark, monkeypatch):
    tables, *_ = made_panel(spark)
    taken = []
    monkeypatch.setattr(windows, "subsample", lambda w, limit, seed, f=windows.subsample: taken.append(f(w, limit, seed).count()) or f(w, limit, seed))
    forecast.run_panel(tables, SIZE, H, 4, [0], n=10, n_val=8, candidates=("naive",), val_windows=5)
    assert taken == [5]


