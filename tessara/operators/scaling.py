"""Scalers: statistics of a window's history alone, and what is normalised by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["group_id", "t", "series_id"]
SCALERS = ("identity", "standard", "robust", "mean", "mean_floor")


def scale_stats(window_rows: DataFrame, scaler: str) -> DataFrame:
    """group_id, t, series_id, loc, scale from rows with k < 0."""
    if scaler not in SCALERS:
        raise ValueError(f"unknown scaler {scaler!r}")
    history = window_rows.where("k < 0")
    if scaler == "robust":  # lower medians
        middle = history.groupBy(*KEYS).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY y)").alias("loc"))
        apart = history.join(middle, KEYS).withColumn("apart", F.abs(F.col("y") - F.col("loc")))
        return apart.groupBy(*KEYS).agg(F.first("loc").alias("loc"), (F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY apart)") + 1e-6).alias("scale"))
    size = F.avg(F.abs("y"))
    loc, scale = {
        "identity": (F.lit(0.0), F.lit(1.0)),
        "standard": (F.avg("y"), F.stddev_samp("y") + 1e-6),
        "mean": (F.lit(0.0), size + 1e-6),
        "mean_floor": (F.lit(0.0), F.greatest(size, F.lit(1.0))),
    }[scaler]
    stats = history.groupBy(*KEYS).agg(loc.alias("loc"), scale.alias("scale"), F.count("*").alias("n"))
    if scaler == "standard":  # one step of history has no deviation
        stats = stats.withColumn("scale", F.when(F.col("n") < 2, F.raise_error(F.lit("standard needs two steps of history"))).otherwise(F.col("scale")))
    return stats.drop("n")


def array_stats(history: Column, scaler: str) -> tuple[Column, Column]:
    """(loc, scale) of a history array, as scale_stats() has them of rows."""
    if scaler not in SCALERS:
        raise ValueError(f"unknown scaler {scaler!r}")
    n = F.size(history)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    middle = lambda values: F.element_at(F.array_sort(values), F.ceil(F.size(values) / 2).cast("int"))  # noqa: E731  lower median
    size = total(F.transform(history, lambda x: F.abs(x))) / n
    if scaler == "identity":
        return F.lit(0.0), F.lit(1.0)
    if scaler in ("mean", "mean_floor"):
        return F.lit(0.0), size + 1e-6 if scaler == "mean" else F.greatest(size, F.lit(1.0))
    if scaler == "robust":
        loc = middle(history)
        return loc, middle(F.transform(history, lambda x: F.abs(x - loc))) + 1e-6
    loc = total(history) / n
    spread = F.sqrt(total(F.transform(history, lambda x: (x - loc) * (x - loc))) / (n - 1)) + 1e-6
    return loc, F.when(n < 2, F.raise_error(F.lit("standard needs two steps of history")).cast("double")).otherwise(spread)


def normalize(rows: DataFrame, stats: DataFrame, column: str = "y", out: str = "z") -> DataFrame:
    return rows.join(stats, KEYS).withColumn(out, (F.col(column) - F.col("loc")) / F.col("scale")).drop("loc", "scale")


def denormalize(rows: DataFrame, stats: DataFrame, column: str = "z", out: str = "y") -> DataFrame:
    return rows.join(stats, KEYS).withColumn(out, F.col(column) * F.col("scale") + F.col("loc")).drop("loc", "scale")


def denormalize_params(params: DataFrame, stats: DataFrame) -> DataFrame:
    """mu, mu_k: affine; sigma, sigma_k, loadings: by scale; nu, lam, logits: as they are."""
    rows = params.join(stats, KEYS)
    affine, spread = lambda x: x * F.col("scale") + F.col("loc"), lambda x: x * F.col("scale")
    for name, f in (("mu", affine), ("sigma", spread)):
        if name in params.columns:
            rows = rows.withColumn(name, f(F.col(name)))
    for name, f in (("mu_k", affine), ("sigma_k", spread), ("loadings", spread)):
        if name in params.columns:
            rows = rows.withColumn(name, F.transform(name, f))
    return rows.drop("loc", "scale")
