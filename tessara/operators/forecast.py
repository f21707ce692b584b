"""Forecasters that give parameter rows, the choice between them, and whole runs.

Estimators are Spark ML's and fit on distributed rows. A user's own model plugs in by group or by batches of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import stored
from . import hierarchy, sampling, scoring, windows
from .design import STEP, design, prepared, series_arrays, windows_of
from .heads import factor_spread, mixture_of, skew_t_fit
from .packed import coherent_packed

#: Parameters of every kind, by name and type; a row has null where its kind has no such parameter.
KINDS = {"mu": "double", "sigma": "double", "loadings": "array<double>", "nu": "double", "lam": "double", "mu_k": "array<double>", "sigma_k": "array<double>", "logits": "array<double>"}


@dataclass(frozen=True)
class Candidate:
    """A forecaster to choose from. kind: naive (the value lag steps before), or a head on the pooled regression: pooled (factors), mixture, skew_t."""

    name: str
    kind: str
    scaler: str = "mean_floor"
    lag: int | None = None


def grid(scalers: list[str], lags: list[int], kinds: tuple[str, ...] = ("naive", "pooled")) -> list[Candidate]:
    """A candidate for each lag (naive) and each scaler and head."""
    naive = [Candidate(f"naive-{lag}", "naive", lag=lag) for lag in lags] if "naive" in kinds else []
    return naive + [Candidate(f"{kind}-{scaler}", kind, scaler) for kind, scaler in product(kinds, scalers) if kind != "naive"]


def numbered(params: DataFrame, series: DataFrame, groups: DataFrame) -> DataFrame:
    """params with the numbers that key draws. series: (series_id, series_no), groups: (group_id, group_no)."""
    return params.join(series.select("series_id", "series_no"), "series_id").join(groups.select("group_id", "group_no"), "group_id")


def targets(obs: DataFrame, at: DataFrame, h: int) -> DataFrame:
    """group_id, t, h, series_id, truth: the target rows of windows at, h in [0, horizon)."""
    steps = at.select("group_id", "t", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h")).withColumn("idx", F.col("t") + F.col("h"))
    return steps.join(obs.select("group_id", "series_id", F.col("t").alias("idx"), F.col("y").alias("truth")), ["group_id", "idx"]).select(*STEP, "truth")


def seasonal_naive(obs: DataFrame, train: DataFrame, at: DataFrame, lag: int, h: int) -> DataFrame:
    """STEP, mu (the value lag steps before), sigma (deviation of training residuals by series and h), loadings (none)."""
    if lag < h:
        raise ValueError(f"lag {lag} is shorter than the horizon {h}")
    by = Window.partitionBy("group_id", "series_id").orderBy("t")
    anchored = obs.select("group_id", "series_id", "t", "y", F.coalesce(F.lag("y", lag).over(by), F.first("y").over(by)).alias("mu"))

    def rows(which: DataFrame) -> DataFrame:
        steps = which.select("group_id", "t", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h")).withColumn("idx", F.col("t") + F.col("h"))
        return steps.join(anchored.withColumnRenamed("t", "idx"), ["group_id", "idx"])

    spread = rows(train).groupBy("group_id", "series_id", "h").agg(F.stddev_samp(F.col("y") - F.col("mu")).alias("sigma"))
    out = rows(at).join(spread, ["group_id", "series_id", "h"], "left")
    return out.select(*STEP, "mu", F.coalesce("sigma", F.lit(0.0)).alias("sigma"), F.array().cast("array<double>").alias("loadings"))


def fit_pooled(rows: DataFrame, regularisation: float = 1e-3) -> LinearRegressionModel:
    """One direct multi-horizon regression for all series."""
    return LinearRegression(regParam=regularisation, standardization=False).fit(rows)


def predict_pooled(model: LinearRegressionModel, rows: DataFrame) -> DataFrame:
    """STEP, mu (raw units), label, loc, scale."""
    return model.transform(rows).select(*STEP, (F.col("prediction") * F.col("scale") + F.col("loc")).alias("mu"), "prediction", "label", "loc", "scale")


def heads_of(residuals: DataFrame, candidates: list[Candidate], k: int, components: int) -> DataFrame:
    """series_id, candidate and its parameters in normalised units around a prediction, fitted to residual rows (STEP, r).

    pooled: factors; mixture and skew_t: one shape for all series, of residuals over each series' deviation.
    """
    kinds = {c.kind for c in candidates}
    spread = residuals.groupBy("series_id").agg(F.greatest(F.stddev_samp("r"), F.lit(1e-3)).alias("d"))
    shape = stored(residuals.join(spread, "series_id").select((F.col("r") / F.col("d")).alias("r")), "shape") if kinds & {"mixture", "skew_t"} else None  # read in each round of both fits
    made = []
    for kind in sorted(kinds):
        if kind == "pooled":
            rows = factor_spread(residuals, k).select("series_id", F.lit(0.0).alias("mu"), "sigma", "loadings")
        elif kind == "skew_t":
            xi, omega, nu, lam = skew_t_fit(shape)
            rows = spread.select("series_id", (F.col("d") * xi).alias("mu"), (F.col("d") * omega).alias("sigma"), F.lit(nu).alias("nu"), F.lit(lam).alias("lam"))
        elif kind == "mixture":
            mu, sigma, logits = mixture_of(shape, components)
            scaled = lambda values: F.transform(F.array(*map(F.lit, values)), lambda x: x * F.col("d"))
            rows = spread.select("series_id", scaled(mu).alias("mu_k"), scaled(sigma).alias("sigma_k"), F.array(*map(F.lit, logits)).alias("logits"))
        else:
            raise ValueError(f"unknown kind {kind!r}")
        for c in candidates:
            if c.kind == kind:
                made.append(uniform(rows).withColumn("candidate", F.lit(c.name)))
    return reduce(DataFrame.unionByName, made)


def uniform(params: DataFrame) -> DataFrame:
    """params with the columns of all kinds, null where a kind has none."""
    return params.withColumns({c: F.lit(None).cast(kind) for c, kind in KINDS.items() if c not in params.columns})


def around(predictions: DataFrame, heads: DataFrame) -> DataFrame:
    """candidate, STEP and parameters in raw units: predictions (STEP, prediction, loc, scale) with the heads of their series, all candidates in one join."""
    p, loc, scale = F.col("prediction"), F.col("loc"), F.col("scale")
    rows = predictions.select(*STEP, "prediction", "loc", "scale").join(heads, "series_id")
    raw = {"mu": (p + F.col("mu")) * scale + loc, "sigma": F.col("sigma") * scale, "loadings": F.transform("loadings", lambda x: x * scale)}
    raw |= {"mu_k": F.transform("mu_k", lambda x: (p + x) * scale + loc), "sigma_k": F.transform("sigma_k", lambda x: x * scale)}
    return rows.select("candidate", *STEP, *((raw[c] if c in raw else F.col(c)).alias(c) for c in KINDS))


def best_candidate(scores: DataFrame, margin: float = 1e-6) -> DataFrame:
    """candidate, scrps with the lowest validation score; among those within margin of it, the first by name."""
    lowest = scores.agg(F.min("scrps").alias("lowest"))  # one row
    near = scores.crossJoin(lowest).where(F.col("scrps") <= F.col("lowest") + margin)
    return near.agg(F.min("candidate").alias("candidate"), F.min_by("scrps", "candidate").alias("scrps"))


def own_model(window_rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's model for the windows of each (group, t): it gets their rows as pandas and returns parameter rows."""
    return window_rows.groupBy("group_id", "t").applyInPandas(model, schema)


def own_model_batches(obs: DataFrame, at: DataFrame, size: int, h: int, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's model for batches of windows: it gets a pandas frame group_id, t, series_id, past (array), next (array) of many windows at once, and
    returns parameter rows. Rows come in Arrow batches as they are: the model must not need a group's windows together."""
    rows = windows_of(series_arrays(obs, {"y": "y"}), at, size, h).select("group_id", "t", "series_id", "past", "next")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield model(frame)

    return rows.mapInPandas(run, schema)


def evaluate(params: DataFrame, obs: DataFrame, at: DataFrame, edges: DataFrame, nodes: DataFrame, h: int, n: int, k: int, seeds: list[int], estimator: str = "quantile", truth: DataFrame | None = None, floor: float | None = 1e-12, components: int = 0, packed: bool = False) -> DataFrame:
    """(candidate,) seed, level, crps_sum, abs_sum, scrps: ratio of sums over all groups, windows and horizons of the windows at.

    truth (group_id, t, h, node_id, truth): stored aggregates; else bottom targets are summed up. All seeds and, where params
    have a column candidate, all candidates run in one job: they are keys of draws and scores. packed: a cell's n draws are one array
    (``packed``), so that shuffles carry a row a cell and not a row a draw; scores agree but for rounding.
    """
    keep = ("candidate",) if "candidate" in params.columns else ()
    of_seed = F.broadcast(params.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "seed int"))  # a row a seed
    draw = coherent_packed if packed else sampling.sample_coherent
    drawn = draw(params.crossJoin(of_seed), edges, n, "seed", k, components=components, keep=keep)
    if truth is None:
        truth = hierarchy.aggregate(targets(obs, at, h), edges, "truth", ("group_id", "t", "h"))
    crps = scoring.crps_quantile if estimator == "quantile" else scoring.crps_mc
    scored = crps(drawn, truth, [*keep, "seed", "group_id", "t", "h", "node_id"])
    by = [*keep, "seed"]
    levels = scored.join(nodes.select("node_id", "level"), "node_id").groupingSets([[*by, "level"], by], *by, "level").agg(F.sum("crps").alias("crps_sum"), F.sum(F.abs("truth")).alias("abs_sum"))
    return levels.withColumn("level", F.coalesce("level", F.lit("Overall"))).withColumn("scrps", scoring._ratio(floor))


def run(tables: dict[str, DataFrame], size: int, h: int, lag: int, seeds: list[int], n: int = 100, candidates: tuple[str | Candidate, ...] = ("naive", "pooled"), scaler: str = "mean_floor", split: DataFrame | None = None, groups: DataFrame | None = None, k: int = 2, estimator: str = "quantile", blocks: dict[str, DataFrame] | None = None, components: int = 2, val_windows: int | None = None, packed: bool = False) -> DataFrame:
    """dataset run: split, fit the candidates, choose by validation, draw for the test windows, score each seed by level.

    tables: obs, nodes, edges, calendar. groups (group_id, group_no) makes it a panel run; split: (group_id, t, split).
    candidates: names of kinds, or Candidates with scalers and lags of their own; those of one scaler share a design and a fit, and all are drawn and
    scored by one job. blocks: of features.build_features, seen by the pooled fits; historical columns are scaled by the steps before
    validation. val_windows: so many validation windows, drawn with the first seed. packed: as in evaluate.
    """
    obs, nodes, edges, calendar = (tables[x] for x in ("obs", "nodes", "edges", "calendar"))
    spark = obs.sparkSession
    split = windows.last_h_split(calendar, size, h) if split is None else split
    groups = spark.createDataFrame([("", 0)], "group_id string, group_no int") if groups is None else groups
    bottom = nodes.where("is_bottom").select(F.col("node_id").alias("series_id"), F.col("node_idx").alias("series_no"))
    train, val, test = (split.where(F.col("split") == s).select("group_id", "t") for s in ("train", "val", "test"))
    if val_windows is not None:
        val = windows.subsample(val, val_windows, seeds[0])
    named = [Candidate(c, c, scaler, lag) if isinstance(c, str) else c for c in candidates]
    if len({c.name for c in named}) < len(named):
        raise ValueError("two candidates of one name")
    fitted = {}
    pooled = [c for c in named if c.kind != "naive"]
    ready = prepared(blocks, split.where("split = 'val'").agg(F.min("t")).first()[0]) if pooled else None
    for s in sorted({c.scaler for c in pooled}):
        rows = stored(design(obs, train, size, h, s, ready), "design")  # read by the fit and for its residuals; a stored table has as many tasks as its size asks for
        model = fit_pooled(rows)
        residuals = stored(predict_pooled(model, rows).select(*STEP, (F.col("label") - F.col("prediction")).alias("r")), "residuals")
        fitted[s] = model, stored(heads_of(residuals, [c for c in pooled if c.scaler == s], k, components), "heads")

    def params(at: DataFrame, which: list[Candidate]) -> DataFrame:
        """The parameter rows of the candidates for windows at."""
        names = [c.name for c in which]
        made = [uniform(seasonal_naive(obs, train, at, c.lag or lag, h)).withColumn("candidate", F.lit(c.name)) for c in which if c.kind == "naive"]
        for s, (model, heads) in fitted.items():
            if any(c.scaler == s and c.kind != "naive" for c in which):
                made.append(around(predict_pooled(model, design(obs, at, size, h, s, ready)), heads.where(F.col("candidate").isin(names))))
        return numbered(reduce(DataFrame.unionByName, made).drop(*absent), bottom, groups)

    kinds = {c.kind for c in named}  # no stream is drawn for a kind that no candidate has
    absent = [c for kind, columns in (("skew_t", ("nu", "lam")), ("mixture", ("mu_k", "sigma_k", "logits"))) if kind not in kinds for c in columns]
    mixed = components if "mixture" in kinds else 0
    chosen = named[0]
    if len(named) > 1:
        scores = evaluate(params(val, named), obs, val, edges, nodes, h, n, k, seeds[:1], "quantile", floor=1e-8, components=mixed, packed=packed)
        best = best_candidate(scores.where("level = 'Overall'").select("candidate", "scrps")).first()["candidate"]
        chosen = next(c for c in named if c.name == best)
    result = evaluate(params(test, [chosen]), obs, test, edges, nodes, h, n, k, seeds, estimator, components=mixed, packed=packed)
    return result.select("seed", "level", "crps_sum", "abs_sum", "scrps", "candidate")


def run_panel(tables: dict[str, DataFrame], size: int, h: int, lag: int, seeds: list[int], n_val: int | None = None, n_test: int | None = None, val_windows: int | None = 256, **options) -> DataFrame:
    """run() over groups that share one calendar and hierarchy; validation takes at most val_windows windows of all groups."""
    names = tables["obs"].select("group_id").distinct()
    groups = names.withColumn("group_no", F.row_number().over(Window.orderBy("group_id")) - 1)  # a row a group
    split = windows.panel_split(names, tables["calendar"], size, h, n_val or h, n_test or h)
    return run(tables, size, h, lag, seeds, split=split, groups=groups, val_windows=val_windows, **options)
