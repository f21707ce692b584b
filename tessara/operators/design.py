"""Design rows of pooled regressions: one vector a (window, horizon, series) from series arrays and feature blocks.

A series is one array, so a window is a slice of it, its statistics are array functions, and nothing is exploded
by the window's length. What is exploded is what the estimator needs: a row for each horizon.

Blocks are those of ``features.build_features``: static (wide numbers, or long one-hot names that become a sparse vector), future columns
shared by all series, future columns of a series, historical covariates. A window sees future columns at its target steps and
historical ones at its past steps alone. Columns named ``anchor_*`` carry the target's unit and follow the window's scale.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scaling

STEP = ["group_id", "t", "h", "series_id"]
SERIES = ["group_id", "series_id"]
LONG = {"series_id", "feature", "value"}


def series_arrays(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """group_id, series_id and an array a column (its name: the column), in the order of t from 0. A series with a gap raises."""
    rows = F.array_sort(F.collect_list(F.struct("t", *(F.col(c).alias(name) for name, c in columns.items()))))
    made = frame.groupBy(*SERIES).agg(rows.alias("_rows"))
    gap = (F.size("_rows") != F.element_at("_rows", -1)["t"] + 1) | (F.element_at("_rows", 1)["t"] != 0)
    whole = F.when(gap, F.raise_error(F.concat(F.lit("steps are missing or repeated in series "), "series_id"))).otherwise(F.col("_rows"))
    made = made.withColumn("_rows", whole)
    return made.select(*SERIES, *(F.col("_rows").getField(name).alias(name) for name in columns))


def windows_of(arrays: DataFrame, at: DataFrame, size: int, h: int) -> DataFrame:
    """arrays with a row for each window t of at (group_id, t): past and next are slices of y. Windows that don't fit are left out."""
    held = at.select("group_id", "t").distinct()
    rows = arrays.join(held, "group_id").where((F.col("t") >= size) & (F.col("t") + h <= F.size("y")))
    return rows.withColumns({"past": F.slice("y", F.col("t") - (size - 1), size), "next": F.slice("y", F.col("t") + 1, h)})


def _static(blocks: dict[str, DataFrame]) -> list[tuple[DataFrame, list[str], str]]:
    """(keys and a vector column, keys, its name) of the static blocks."""
    out = []
    if "static_names" in blocks:
        long = blocks["static_names"]
        names = [r["feature"] for r in long.select("feature").distinct().orderBy("feature").collect()]  # as wide as the model
        known = F.when(~F.col("value").isin(0.0, 1.0), F.raise_error(F.lit("names have value 0 or 1"))).when(F.col("value") == 1, F.col("feature"))
        lists = long.groupBy("series_id").agg(F.collect_list(known).alias("_list"))
        coded = CountVectorizerModel.from_vocabulary(names, inputCol="_list", outputCol="_names").transform(lists)
        out.append((coded.select("series_id", "_names"), ["series_id"], "_names"))
    if "static" in blocks:
        keys = [c for c in SERIES if c in blocks["static"].columns]
        numbers = [c for c in blocks["static"].columns if c not in keys]
        out.append((blocks["static"].select(*keys, array_to_vector(F.array(*(F.col(c).cast("double") for c in numbers))).alias("_static")), keys, "_static"))
    return out


def prepared(blocks: dict[str, DataFrame] | None, upto_t: int | None = None) -> dict[str, Any]:
    """Blocks made ready for design(): vectors, arrays, and the historical columns' mean and deviation over the steps before upto_t."""
    blocks = blocks or {}
    if unknown := set(blocks) - {"static", "static_names", "future_shared", "future_series", "hist"}:
        raise ValueError(f"unknown blocks {sorted(unknown)}")
    out: dict[str, Any] = {"static": _static(blocks)}
    if "future_shared" in blocks:
        columns = [c for c in blocks["future_shared"].columns if c not in ("ds", "t")]
        out["shared"] = blocks["future_shared"].select(F.col("t").alias("_idx"), F.array(*(F.col(c).cast("double") for c in columns)).alias("_shared"))
    if "future_series" in blocks:
        columns = [c for c in blocks["future_series"].columns if c not in (*SERIES, "t", "ds")]
        out["own"] = series_arrays(blocks["future_series"], {f"_own{i}": c for i, c in enumerate(columns)})
        out["anchors"] = [c.startswith("anchor_") for c in columns]
    if "hist" in blocks:
        hist = blocks["hist"]
        columns = [c for c in hist.columns if c not in (*SERIES, "t", "ds")]
        known = hist if upto_t is None else hist.where(F.col("t") < upto_t)
        row = known.agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        out["hist_stats"] = [(row[f"m{i}"] or 0.0, (row[f"s{i}"] or 0.0) + 1e-6) for i in range(len(columns))]
        out["hist"] = series_arrays(hist, {f"_hist{i}": c for i, c in enumerate(columns)})
    return out


def design(obs: DataFrame, at: DataFrame, size: int, h: int, scaler: str, ready: dict[str, Any] | None = None) -> DataFrame:
    """STEP, features, label (normalised), loc, scale. ready: of prepared().

    features: normalised history, horizon dummies, shared future columns of the target step, the series' own ones (anchors
    rescaled), historical columns over the past, then static names (sparse) and numbers.
    """
    ready = ready or {"static": []}
    arrays = series_arrays(obs, {"y": "y"})
    for kind in ("own", "hist"):  # by the same keys: no further shuffle
        if kind in ready:
            arrays = arrays.join(ready[kind], SERIES)
    rows = windows_of(arrays, at, size, h)
    loc, scale = scaling.array_stats(F.col("past"), scaler)
    rows = rows.withColumns({"loc": loc, "scale": scale})
    scaled = lambda values, m, s: F.transform(values, lambda x: (x - m) / s)
    hist = [scaled(F.slice(f"_hist{i}", F.col("t") - (size - 1), size), m, s) for i, (m, s) in enumerate(ready.get("hist_stats", []))]
    own = [F.slice(f"_own{i}", F.col("t") + 1, h) for i in range(len(ready.get("anchors", [])))]
    own = [scaled(x, F.col("loc"), F.col("scale")) if anchor else x for x, anchor in zip(own, ready.get("anchors", []), strict=True)]
    past_z, next_z = (scaled(F.col(c), F.col("loc"), F.col("scale")) for c in ("past", "next"))
    made = rows.select("group_id", "t", "series_id", "loc", "scale", past_z.alias("_past"), F.concat(F.array().cast("array<double>"), *hist).alias("_hist"), F.array(*own).alias("_own") if own else F.lit(None).alias("_own"), F.posexplode(next_z).alias("h", "label"))
    parts = [F.col("_past"), F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda k: (k == F.col("h")).cast("double"))]
    if "shared" in ready:
        made = made.withColumn("_idx", F.col("t") + F.col("h")).join(ready["shared"], "_idx")
        parts.append(F.col("_shared"))
    if own:
        parts.append(F.transform("_own", lambda x: F.get(x, F.col("h")).cast("double")))
    parts.append(F.col("_hist"))
    made = made.withColumn("_dense", array_to_vector(F.concat(*parts)))
    if not ready["static"]:
        return made.select(*STEP, F.col("_dense").alias("features"), "label", "loc", "scale")
    made = reduce(lambda rows, s: rows.join(s[0], s[1], "left"), ready["static"], made)
    joined = VectorAssembler(inputCols=["_dense", *(s[2] for s in ready["static"])], outputCol="features", handleInvalid="error").transform(made)
    return joined.select(*STEP, "features", "label", "loc", "scale")
