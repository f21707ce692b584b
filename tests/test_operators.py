"""Small exact cases, closed forms, invariants and error paths of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tessara.functions import draws, links
from tessara.operators import features, forecast, heads, hierarchy, panel, sampling, scaling, scoring, windows
from tessara.operators.checks import require_empty
from tessara.plans.domains import parts_panel
from tessara.plans.queries import N_DRAWS, QUERIES, _node_samples

SERIES, STEPS = ["coast-p1", "coast-p3", "inland-p2", "north-p1", "north-p2"], 72


@pytest.fixture(scope="module")
def small(spark):
    bottom = spark.createDataFrame([(s, s.split("-")[0]) for s in SERIES], "series_id string, grp string")
    nodes, edges = hierarchy.build_hierarchy(bottom, [("Total", []), ("Group", ["grp"])])
    obs = spark.range(STEPS).select(F.lit("").alias("group_id"), F.explode(F.array(*map(F.lit, SERIES))).alias("series_id"), F.col("id").cast("int").alias("t"), (F.col("id") * 4.0).alias("y"))
    obs = obs.withColumn("y", F.col("y") + F.substring("series_id", -1, 1).cast("int") - 1).cache()
    calendar = spark.range(STEPS).select(F.add_months(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("ds"), F.col("id").cast("int").alias("t"))
    return {"obs": obs, "nodes": nodes.cache(), "edges": edges.cache(), "calendar": calendar, "bottom": bottom}


def _params(spark, n_h=1, **more):
    rows = [("", 0, 5, h, s, k, 7.0, 0.8, [1.5, 0.0] if k % 2 == 0 else [0.0, -1.0]) for h in range(n_h) for k, s in enumerate(SERIES)]
    df = spark.createDataFrame(rows, "group_id string, group_no int, t int, h int, series_id string, series_no int, mu double, sigma double, loadings array<double>")
    return df.withColumns({k: v if hasattr(v, "alias") else F.lit(v) for k, v in more.items()})


def test_hierarchy_of_nine_nodes(small):
    rows = small["nodes"].orderBy("node_idx").collect()
    assert [r.node_id for r in rows] == ["Total", "coast", "inland", "north", *SERIES]
    assert small["edges"].count() == 15
    assert hierarchy.check_identity(small["nodes"], small["edges"]).count() == 0
    assert {r.level: (r.start, r.stop) for r in hierarchy.level_slices(small["nodes"]).collect()} == {"Total": (0, 1), "Group": (1, 4), "Bottom": (4, 9)}
    assert hierarchy.validate_levels(hierarchy.level_slices(small["nodes"]), 9).count() == 0
    assert hierarchy.validate_levels(hierarchy.level_slices(small["nodes"]), 10).count() == 1
    require_empty(hierarchy.verify_coherence(small["obs"], small["edges"], hierarchy.aggregate(small["obs"], small["edges"])), "gaps")
    with pytest.raises(ValueError, match="gaps"):
        require_empty(hierarchy.verify_coherence(small["obs"], small["edges"], hierarchy.aggregate(small["obs"], small["edges"]).withColumn("y", F.col("y") + 9)), "gaps")


def test_depths_in_two_runs_raise(spark):
    nodes = spark.createDataFrame([("t", 0), ("t-a", 1), ("u", 2)], "node_id string, node_idx int")
    with pytest.raises(ValueError, match="separate runs"):
        hierarchy.levels_from_depth(nodes, "-")


def test_clipping_comes_before_sums(spark, small):
    drawn = spark.createDataFrame([("", 0, 0, 0, s, y) for s, y in zip(SERIES, (-5.0, 10.0, 0.0, 2.0, 0.0), strict=True)], "group_id string, t int, h int, i int, series_id string, y double")
    total = lambda clip: {r.node_id: r.y for r in hierarchy.coherent_aggregate(drawn, small["edges"], clip).collect()}["Total"]
    assert total(True) == 12.0 and total(False) == 7.0


def test_windows_and_splits(spark, small):
    rows = windows.rolling_windows(small["obs"], 8, 4)
    assert rows.select("t").distinct().count() == STEPS - 8 - 4 + 1
    one = rows.where("t = 10 AND series_id = 'coast-p1'").orderBy("k").collect()
    assert [r.k for r in one] == list(range(-8, 4)) and one[8].y == 40.0
    split = windows.last_h_split(small["calendar"], 8, 4)
    assert {r.split: r.n for r in windows.split_sizes(split).collect()} == {"train": STEPS - 8 - 4 - 8 + 1, "val": 1, "test": 1}
    assert windows.leaked_targets(split, 4).count() == 0
    days = spark.range(95).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("ds"), F.col("id").cast("int").alias("t"))
    block = windows.block_split(days, 14, 1, 40, 38, 17)
    assert {r.split: r.n for r in windows.split_sizes(block).collect()} == {"train": 26, "val": 38, "test": 1}
    with pytest.raises(ValueError, match="is not 95"):
        windows.block_split(days, 14, 1, 40, 38, 12)
    with pytest.raises(ValueError, match="fewer"):
        windows.rolling_windows(small["obs"], STEPS - 2, 4)
    with pytest.raises(ValueError, match="empty blocks"):
        windows.last_h_split(small["calendar"], STEPS - 8, 4)
    groups = spark.range(6).select(F.concat(F.lit("g"), "id").alias("group_id"))
    sizes = {r.split: r.n for r in windows.split_sizes(windows.panel_split(groups, small["calendar"], 8, 4, 8, 4)).collect()}
    assert sizes == {"train": 6 * (STEPS - 12 - 4 - 8 + 1), "val": 6 * (8 - 4 + 1), "test": 6}


def test_states_do_not_repeat(spark):
    n = 3_000_000  # with 31 bits some 2,000 states would
    one = draws.hashed(spark.range(n), "x", ["id"], 5)
    two = draws.hashed(spark.range(n).select((F.col("id") % 1000 - 500).alias("a"), F.floor(F.col("id") / 1000).alias("b")), "x", ["a", "b"], 5)
    for rows in (one, two):
        assert rows.select("x").distinct().count() == n
        got = rows.agg(F.min("x"), F.max("x"), F.avg(draws.uniform("x")), F.stddev(draws.uniform("x")), F.count_distinct(F.shiftright("x", 31)), F.corr(draws.uniform("x"), F.col("x") % draws.HALF)).first()
        assert 0 <= got[0] < got[1] < 1 << 62 and abs(got[2] - 0.5) < 1e-3 and abs(got[3] - 12**-0.5) < 1e-3
        assert got[4] > n * 0.999 and abs(got[5]) < 3e-3
    cells = one.groupBy(F.floor(draws.uniform("x") * 16), F.floor((F.col("x") % 65536) / 4096)).count().agg(F.count("*"), F.min("count"), F.max("count")).first()
    assert cells[0] == 256 and cells[1] > n / 256 * 0.95 and cells[2] < n / 256 * 1.05
    following = one.join(one.select((F.col("id") - 1).alias("id"), F.col("x").alias("next")), "id").agg(F.corr(draws.uniform("x"), draws.uniform("next"))).first()[0]
    assert abs(following) < 3e-3


def test_subsamples_do_not_follow_partitions(spark):
    rows = spark.range(500).select((F.col("id") % 7).cast("string").alias("group_id"), F.col("id").cast("int").alias("t"))
    picks = [sorted(map(tuple, windows.subsample(r, 20, s).collect())) for r, s in ((rows, 1), (rows.repartition(13), 1), (rows, 2))]
    assert picks[0] == picks[1] != picks[2] and len(picks[0]) == 20


def test_fills_and_last_rows(spark):
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate([None, 1.0, None, 0.0, None])] + [("b", 0, None)], "s string, t int, v double")
    got = panel.fill_forward_backward(rows, ["s"], "t", "v").orderBy("s", "t").collect()
    assert [r.v for r in got] == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    latest = panel.latest(spark.createDataFrame([("k", 1, 5.0), ("k", 2, 7.0)], "k string, n int, y double"), ["k"], "y", "n")
    assert latest.first().y == 7.0


def test_panel_violations(spark, small):
    obs = small["obs"].join(small["calendar"], "t")
    assert panel.validate_panel(obs, small["nodes"], small["edges"], small["calendar"]).count() == 0
    broken = obs.where("NOT (t = 3 AND series_id = 'coast-p1')").unionByName(obs.where("t = 4 AND series_id = 'coast-p3'"))
    found = {r.problem: r.n for r in panel.validate_panel(broken, small["nodes"], small["edges"].where("series_id <> 'inland-p2'"), small["calendar"]).collect()}
    assert found == {"missing cell": 1, "repeated cell": 1, "bottom node without its edge": 1}


def test_features(spark, small):
    calendar = small["calendar"]
    assert features.quarter_dummies(calendar).select(F.sum("quarter_1"), F.sum("quarter_4")).first()[:] == (18.0, 18.0)
    days = spark.sql("SELECT date_add(DATE '2024-01-01', CAST(id AS INT)) AS ds, CAST(id AS INT) AS t FROM range(7)")  # a Monday first
    assert [r.saturday for r in features.saturday_proximity(days, normalize=False).orderBy("t").collect()] == [2, 3, 3, 2, 1, 0, 1]
    assert [r.weekend for r in features.weekend_indicator(days).orderBy("t").collect()] == [0, 0, 0, 0, 0, 1, 1]
    anchors = features.seasonal_naive_anchor(small["obs"], [4]).where("series_id = 'coast-p1'").orderBy("t").collect()
    assert [r.anchor_4 for r in anchors[:6]] == [0.0] * 5 + [4.0]
    for lags, h in (([0], None), ([STEPS], None), ([3], 4)):
        with pytest.raises(ValueError, match="lag"):
            features.seasonal_naive_anchor(small["obs"], lags, h)
    with pytest.raises(Exception, match="too few parts"):
        features.grouped_static_dummies(small["bottom"], ["a", "b", "c"]).collect()
    with pytest.raises(Exception, match="no known suffix"):
        features.prefix_suffix_dummies(small["bottom"], ["-p1"]).collect()
    both = features.prefix_suffix_dummies(spark.createDataFrame([("AAHol",), ("ABBus",)], "series_id string"), ["Hol", "Bus"]).where("value = 1").collect()
    assert {(r.series_id, r.feature) for r in both} == {("AAHol", "suffix=Hol"), ("AAHol", "state=A"), ("ABBus", "suffix=Bus"), ("ABBus", "state=A")}
    for blocks, message in (([("other", calendar)], "unknown kind"), ([("static", calendar)], "needs")):
        with pytest.raises(ValueError, match=message):
            features.build_features(blocks)


def test_scalers(spark, small):
    rows = spark.createDataFrame([("", 5, k, "s", y) for k, y in zip((-4, -3, -2, -1, 0), (1.0, 2.0, 3.0, 10.0, 99.0), strict=True)], "group_id string, t int, k int, series_id string, y double")
    stats = {s: tuple(scaling.scale_stats(rows, s).select("loc", "scale").first()) for s in scaling.SCALERS}
    assert stats["identity"] == (0.0, 1.0) and stats["mean_floor"] == (0.0, 4.0)
    assert stats["robust"] == (2.0, 1.0 + 1e-6)  # lower medians of an even count
    assert stats["standard"][0] == 4.0 and math.isclose(stats["standard"][1], math.sqrt(50 / 3) + 1e-6)
    zero = scaling.scale_stats(rows.withColumn("y", F.lit(0.0)), "mean_floor").first()
    assert zero.scale == 1.0
    for s in scaling.SCALERS:
        stats = scaling.scale_stats(rows, s)
        back = scaling.denormalize(scaling.normalize(rows, stats).drop("y"), stats).orderBy("k").collect()
        assert all(math.isclose(a.y, b, abs_tol=1e-9) for a, b in zip(back, (1.0, 2.0, 3.0, 10.0, 99.0), strict=True))
    with pytest.raises(ValueError, match="unknown scaler"):
        scaling.scale_stats(rows, "other")
    with pytest.raises(Exception, match="two steps"):
        scaling.scale_stats(rows.where("k = -1"), "standard").collect()
    params = _params(spark, mu_k=F.array(F.lit(1.0)), logits=F.array(F.lit(0.3)), nu=F.lit(5.0))
    stats = small["bottom"].select(F.lit("").alias("group_id"), F.lit(5).alias("t"), "series_id", F.lit(10.0).alias("loc"), F.lit(2.0).alias("scale"))
    r = scaling.denormalize_params(params, stats).where("series_id = 'coast-p1'").first()
    assert (r.mu, r.sigma, r.loadings, r.mu_k, r.logits, r.nu) == (24.0, 1.6, [3.0, 0.0], [12.0], [0.3], 5.0)


def test_nodes_of_equal_names_stay_apart(spark):
    bottom = spark.createDataFrame([("1", "Loja", "Loja"), ("2", "Loja", "Quito"), ("3", "a-b", "c"), ("4", "a", "b-c")], "series_id string, state string, city string")
    nodes, edges = hierarchy.build_hierarchy(bottom, [("Total", []), ("state", ["state"]), ("city", ["city"]), ("both", ["state", "city"])])
    below = {(r.level, r.node_id): r.s for r in nodes.join(edges, "node_id").groupBy("level", "node_id").agg(F.concat_ws("", F.sort_array(F.collect_list("series_id"))).alias("s")).collect()}
    assert below["state", "state=Loja"] == "12" and below["city", "city=Loja"] == "1" and below["both", "a\\-b-c"] == "3" and below["both", "a-b\\-c"] == "4"
    assert nodes.count() == nodes.select("node_id").distinct().count() == 1 + 3 + 4 + 4 + 4
    with pytest.raises(Exception, match="a null city"):
        hierarchy.build_hierarchy(bottom.withColumn("city", F.lit(None).cast("string")), [("city", ["city"])])[0].collect()
    with pytest.raises(ValueError, match="no levels"):
        hierarchy.validate_levels(hierarchy.level_slices(nodes).limit(0), 3)


def test_windows_given_are_those_of_all(spark, small):
    every = windows.rolling_windows(small["obs"], 8, 3)
    some = every.select("group_id", "t").where("t % 7 = 0").distinct()
    given = windows.expand(small["obs"], some.unionByName(spark.createDataFrame([("", 3), ("", STEPS - 1)], "group_id string, t int")), 8, 3)
    assert sorted(map(tuple, given.collect())) == sorted(map(tuple, every.where("t % 7 = 0").select(given.columns).collect()))
    with pytest.raises(ValueError, match="no lags"):
        features.seasonal_naive_anchor(small["obs"], [])


def test_factor_draws_have_their_moments_and_share_shocks(spark):
    rows = sampling.sample_factor(_params(spark), 4000, 1, 2).groupBy("i").pivot("series_id", SERIES).agg(F.first("y"))
    stats = rows.select(*(F.avg(f"`{s}`") for s in SERIES), *(F.variance(f"`{s}`") for s in SERIES), F.corr("`coast-p1`", "`inland-p2`"), F.corr("`coast-p1`", "`coast-p3`")).first()
    assert all(abs(m - 7) < 0.12 for m in stats[:5])
    assert abs(stats[5] - 2.89) < 0.3 and abs(stats[6] - 1.64) < 0.17
    assert abs(stats[10] - 2.25 / 2.89) < 0.04 and abs(stats[11]) < 0.06


def test_draws_follow_the_seed_and_not_the_partitions(spark, small):
    params = _params(spark, 2)
    sums = lambda df: sorted(map(tuple, df.withColumn("y", F.round("y", 9)).collect()))  # noqa: E731  draws are equal, sums of them up to their order
    take = lambda p, s: sums(sampling.sample_coherent(p, small["edges"], 5, s, 2))
    assert take(params, 3) == take(params.repartition(5), 3) != take(params, 4)
    seeds = params.crossJoin(spark.createDataFrame([(3,), (4,)], "seed int"))
    both = sampling.sample_coherent(seeds, small["edges"], 5, "seed", 2)
    assert sums(both.where("seed = 4").drop("seed")) == take(params, 4)
    with pytest.raises(ValueError, match="lack"):
        sampling.sample_factor(params.drop("sigma"), 3, 0, 2)


def test_skew_and_mixture_draws(spark):
    skew = lambda lam: sampling.sample_skew_t(_params(spark, nu=10.0, lam=lam).withColumn("loadings", F.array(F.lit(0.0))), 3000, 1, 0).agg(F.skewness("y")).first()[0]
    assert skew(5.0) > 0.5 and skew(-5.0) < -0.5 and abs(skew(0.0)) < 0.3
    mixed = _params(spark, mu_k=F.array(F.lit(-10.0), F.lit(10.0)), sigma_k=F.array(F.lit(0.1), F.lit(0.1)), logits=F.array(F.lit(0.0), F.lit(math.log(3)))).withColumn("loadings", F.array(F.lit(0.0)))
    got = sampling.sample(mixed, 1000, 1, 0, components=2).agg(F.avg((F.col("y") > 0).cast("double")), F.max(F.abs(F.abs("y") - 10))).first()
    assert abs(got[0] - 0.75) < 0.03 and got[1] < 1


def test_links(spark):
    r = spark.range(1).select(links.sigma_link(F.lit(0.0)), links.sigma_link(F.lit(50.0)), links.sigma_link(F.lit(99.0), "exp"), links.nu_link(F.lit(-40.0)), links.normal_cdf(F.lit(1.96)), links.normal_cdf(F.lit(-1.96))).first()
    assert math.isclose(r[0], math.log(2) + 1e-3) and math.isclose(r[1], 50.001) and math.isclose(r[2], math.exp(20) + 1e-3)
    assert r[3] >= 2 and abs(r[4] - 0.9750021) < 1e-6 and abs(r[5] - 0.0249979) < 1e-6
    with pytest.raises(ValueError, match="link"):
        links.sigma_link(F.lit(0.0), "other")


def _normal_samples(spark, n=40_000):
    rows = draws.hashed(spark.range(n).select(F.lit("").alias("group_id"), F.lit(0).alias("t"), F.lit(0).alias("h"), F.lit("n").alias("node_id"), F.col("id").cast("int").alias("i")), "x", ["i"], 1)
    return draws.with_normal(rows, "z", "x", 0).select("group_id", "t", "h", "node_id", "i", (1.2 + 0.6 * F.col("z")).alias("y"))


def test_scores_agree_with_the_closed_form(spark):
    drawn = _normal_samples(spark).cache()
    truth = spark.createDataFrame([("", 0, 0, "n", 1.0)], "group_id string, t int, h int, node_id string, truth double")
    exact = spark.range(1).select(scoring.gaussian_crps(F.lit(1.2), F.lit(0.6), F.lit(1.0))).first()[0]
    assert abs(scoring.crps_mc(drawn, truth).first().crps - exact) < 5e-3
    assert abs(scoring.crps_quantile(drawn, truth).first().crps - exact) < 5e-3
    few = drawn.where("i < 60")
    assert math.isclose(scoring.energy_score(few, truth).first().score, scoring.crps_mc(few, truth).first().crps, rel_tol=1e-9)
    with pytest.raises(Exception, match="two samples"):
        scoring.crps_mc(drawn.where("i = 0"), truth).collect()
    with pytest.raises(ValueError, match="reduction"):
        scoring.crps_objective(few, truth, "other")


def test_overall_is_no_mean_of_levels_and_mass_is_needed(spark, small):
    rows = spark.createDataFrame([("Total", 1.0, 10.0), ("coast", 2.0, 4.0), ("coast-p1", 3.0, 5.0)], "node_id string, crps double, truth double")
    got = {r.level: r.scrps for r in scoring.scrps_by_level(rows, small["nodes"]).collect()}
    assert got == {"Total": 0.1, "Group": 0.5, "Bottom": 0.6, "Overall": 6 / 19}
    with pytest.raises(Exception, match="no mass"):
        scoring.scrps(rows.withColumn("truth", F.lit(0.0))).collect()
    assert scoring.scrps(rows.withColumn("truth", F.lit(0.0)), floor=1e-12).first().scrps > 1e9
    keyed = rows.withColumn("group_id", F.lit(""))
    assert scoring.scaled_objective(keyed, "none").first().loss == 6.0 and math.isclose(scoring.scaled_objective(keyed, "series").first().loss, 0.1 + 0.5 + 0.6)
    assert scoring.quantile_grid()[:2] == [0.01, 0.02] and len(scoring.quantile_grid()) == 99


def test_factor_spread_keeps_variances(spark):
    base = spark.range(2000).select(F.lit("").alias("group_id"), F.col("id").cast("int").alias("t"), F.lit(0).alias("h"))
    wide = draws.with_normal(draws.hashed(base, "x", ["t"], 5), "e", "x", 0)
    wide = draws.with_normal(wide, "f", "x", 1)
    rows = wide.select("group_id", "t", "h", F.explode(F.array(*(F.struct(F.lit(s).alias("series_id"), (F.col("e") * (k + 1) + F.col("f") * 0.3).alias("r")) for k, s in enumerate(SERIES)))).alias("c")).select("group_id", "t", "h", "c.*")
    got = {r.series_id: r for r in heads.factor_spread(rows, 2).collect()}
    for r in rows.groupBy("series_id").agg(F.var_samp("r").alias("v")).collect():
        own = got[r.series_id]
        assert math.isclose(own.sigma**2 + sum(x * x for x in own.loadings), r.v, rel_tol=0.05)


def test_moments_of_residuals(spark):
    rows = draws.with_normal(draws.hashed(spark.range(6000), "x", ["id"], 9), "r", "x", 0)
    nu, lam = heads.skew_t_of(rows).first()
    assert nu > 20 and abs(lam) < 1.2
    mu, sigma, logits = heads.mixture_of(rows.withColumn("r", F.when(F.col("id") % 4 == 0, F.col("r") + 12).otherwise(F.col("r"))), 2)
    assert abs(mu[0]) < 0.3 and abs(mu[1] - 12) < 0.3 and abs(math.exp(logits[1]) - 0.25) < 0.03 and all(abs(s - 1) < 0.2 for s in sigma)
    with pytest.raises(ValueError, match="two components"):
        heads.mixture_of(rows, 1)


def test_a_run_from_load_to_scores(spark, small):
    season = small["obs"].withColumn("y", F.col("y") + 50 * F.sin(F.col("t") * math.pi / 6) + 100)
    tables = {**small, "obs": season}
    got = forecast.run(tables, 12, 4, 12, [0, 1], n=20, k=1).collect()
    assert {(r.seed, r.level) for r in got} == {(s, x) for s in (0, 1) for x in ("Total", "Group", "Bottom", "Overall")}
    assert all(0 < r.scrps < 1 for r in got)
    again = {(r.seed, r.level): r.scrps for r in forecast.run(tables, 12, 4, 12, [0], n=20, k=1).collect()}
    assert all(math.isclose(again[r.seed, r.level], r.scrps, rel_tol=1e-9) for r in got if r.seed == 0)
    groups = season.withColumn("group_id", F.lit("g1")).unionByName(season.withColumn("group_id", F.lit("g2")))
    panel_run = forecast.run_panel({**tables, "obs": groups}, 12, 4, 12, [0], n=20, candidates=("naive",)).collect()
    assert {r.level for r in panel_run} == {"Total", "Group", "Bottom", "Overall"}
    assert forecast.best_candidate(spark.createDataFrame([("b", 0.5), ("a", 0.5 + 1e-9), ("c", 0.4999)], "candidate string, scrps double"), 1e-3).first().candidate == "a"


def test_history_is_lifted_in_all_windows(spark):
    d = "/root/testdata/sf0.001"
    b = parts_panel(spark, d)
    y, steps, edges = {}, 0, b["edges"].collect()
    for r in b["obs"].collect():
        y[r.group_id, r.series_id, r.t] = r.y
        steps = max(steps, r.t + 1)
    one = min(g for g, _, _ in y)
    want = {}
    for t in range(12, steps - 3 + 1):
        for e in edges:
            past = [y[one, e.series_id, i] for i in range(t - 12, t)]
            scale = max(sum(map(abs, past)) / 12, 1)
            for k, v in zip(range(-12, 0), past, strict=True):
                want[t, k, e.node_id] = want.get((t, k, e.node_id), 0.0) + v / scale * e.weight
    rows = QUERIES["h11_lift_history_all"](spark, d)
    assert rows.select("group_id").distinct().count() == b["obs"].select("group_id").distinct().count()
    got = {(r.t, r.k, r.node_id): r.z for r in rows.where(F.col("group_id") == one).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-3) for x in want)
    both = {(r.t, r.k, r.node_id): r.z for r in QUERIES["h11_lift_history"](spark, d).where(F.col("group_id") == one).collect()}
    assert both.keys() == got.keys() and all(math.isclose(both[x], got[x], abs_tol=1e-3) for x in got)


def test_a_panel_run_chooses_between_its_candidates(spark, small):
    tables = {k: v for k, v in small.items() if k != "bottom"}
    season, trend = 50 * F.sin(F.col("t") * math.pi / 6) + 100, F.col("t") * 4.0 + 10
    for y, best in ((season, "naive"), (trend, "pooled")):
        obs = small["obs"].withColumn("y", y + F.substring("series_id", -1, 1).cast("int") - 1 + F.col("t") * F.col("t") % 3 * 0.1)
        groups = obs.withColumn("group_id", F.lit("g1")).unionByName(obs.withColumn("group_id", F.lit("g2")).withColumn("y", F.col("y") * 2))
        got = forecast.run_panel({**tables, "obs": groups}, 12, 4, 12, [0, 1], n=20, k=1).collect()
        assert {(r.seed, r.level) for r in got} == {(s, x) for s in (0, 1) for x in ("Total", "Group", "Bottom", "Overall")}
        assert {r.candidate for r in got} == {best}


def test_the_registered_panel_run_tries_all_candidates(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(forecast, "best_candidate", lambda scores, best=forecast.best_candidate: seen.extend(scores.collect()) or best(scores))
    rows = QUERIES["r9_m11_run_panel"](spark, "/root/testdata/sf0.001").collect()
    assert {r.candidate for r in seen} == {"naive", "pooled"} and {r.seed for r in rows} == {0, 1, 2}
    assert {r.candidate for r in rows} == {min(seen, key=lambda r: r.scrps).candidate}


def test_the_energy_score_takes_all_samples(spark):
    _, drawn, truth = _node_samples(spark, "/root/testdata/sf0.001")
    true = {(r.group_id, r.t, r.h, r.node_id): r.truth for r in truth.collect()}
    ys = {}
    for r in drawn.collect():
        ys.setdefault((r.group_id, r.t), {}).setdefault(r.i, {})[r.h, r.node_id] = r.y
    for r in QUERIES["m7_energy_score"](spark, "/root/testdata/sf0.001").collect():
        own = ys[r.group_id, r.t]
        assert len(own) == N_DRAWS
        near = [math.dist(list(s.values()), [true[r.group_id, r.t, *c] for c in s]) for s in own.values()]
        apart = [math.dist([own[i][c] for c in own[j]], list(own[j].values())) for i in own for j in own if i < j]
        want = sum(near) / len(own) - sum(apart) / (len(own) * (len(own) - 1))
        assert math.isclose(r.score, want, rel_tol=1e-6, abs_tol=0.1)
