"""Exogenous features: calendar columns, lagged anchors, static dummies, and their blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _dummies(calendar: DataFrame, number, values: list[int], prefix: str) -> DataFrame:
    return calendar.select("ds", "t", *((number == v).cast("double").alias(f"{prefix}_{v}") for v in values))


def quarter_dummies(calendar: DataFrame) -> DataFrame:
    return _dummies(calendar, F.quarter("ds"), [1, 2, 3, 4], "quarter")


def month_dummies(calendar: DataFrame) -> DataFrame:
    return _dummies(calendar, F.month("ds"), list(range(1, 13)), "month")


def dayofweek_dummies(calendar: DataFrame) -> DataFrame:
    """Monday is 0."""
    return _dummies(calendar, F.weekday("ds"), list(range(7)), "dow")


def weekend_indicator(calendar: DataFrame) -> DataFrame:
    return calendar.select("ds", "t", F.weekday("ds").isin(5, 6).cast("double").alias("weekend"))


def saturday_proximity(calendar: DataFrame, normalize: bool = True) -> DataFrame:
    """Days to the nearest Saturday around the week, of at most 3."""
    apart = F.abs(F.weekday("ds") - 5)
    return calendar.select("ds", "t", (F.least(apart, 7 - apart) / (3.0 if normalize else 1.0)).alias("saturday"))


def seasonal_naive_anchor(obs: DataFrame, lags: list[int], h: int | None = None) -> DataFrame:
    """anchor_<lag>: the value lag steps before; the first lag steps take the series' first value. A lag under h would leak."""
    if not lags:
        raise ValueError("no lags")
    steps = obs.agg(F.countDistinct("t")).first()[0]
    for lag in lags:
        if not 1 <= lag < steps:
            raise ValueError(f"lag {lag} is not in [1, {steps})")
        if h is not None and lag < h:
            raise ValueError(f"lag {lag} is shorter than the horizon {h}")
    by = Window.partitionBy("group_id", "series_id").orderBy("t")
    return obs.select("group_id", "series_id", "t", *(F.coalesce(F.lag("y", n).over(by), F.first("y").over(by)).alias(f"anchor_{n}") for n in lags))


def grouped_static_dummies(series: DataFrame, keys: list[str], sep: str = "-", positions: list[int] | None = None) -> DataFrame:
    """series_id, feature, value: one-hot of the parts of names; keys name the positions, categories are read off the data. Short names raise."""
    positions = positions or list(range(len(keys)))
    if len(positions) != len(keys):
        raise ValueError("keys and positions differ in number")
    parts = series.select("series_id", F.split("series_id", f"\\Q{sep}\\E").alias("parts"))
    short = F.size("parts") <= max(positions)
    rows = [parts.select("series_id", F.when(short, F.raise_error(F.concat(F.lit("too few parts in "), "series_id")).cast("string")).otherwise(F.concat(F.lit(f"{k}="), F.get("parts", F.lit(p)))).alias("feature")) for k, p in zip(keys, positions, strict=True)]
    return _one_hot(reduce(DataFrame.unionByName, rows), series)


def _one_hot(present: DataFrame, series: DataFrame) -> DataFrame:
    """series_id, feature, value 0 or 1 for all series and features. Features are a dimension's categories, so the grid is small."""
    grid = series.select("series_id").crossJoin(present.select("feature").distinct())
    return grid.join(present.withColumn("value", F.lit(1.0)), ["series_id", "feature"], "left").select("series_id", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))


def identity_dummies(series: DataFrame) -> DataFrame:
    """series_id, feature, value: the ones of a one-hot by series."""
    return series.select("series_id", F.col("series_id").alias("feature"), F.lit(1.0).alias("value"))


def prefix_suffix_dummies(series: DataFrame, suffixes: list[str]) -> DataFrame:
    """One-hot of a name's suffix (the first match in order) and of the first letter of what stands before it. Names without one raise."""
    suffix = F.coalesce(*(F.when(F.col("series_id").endswith(s) & (F.length("series_id") > len(s)), F.lit(s)) for s in suffixes))
    known = F.when(suffix.isNull(), F.raise_error(F.concat(F.lit("no known suffix in "), "series_id")).cast("string")).otherwise(suffix)
    state = F.concat(F.lit("state="), F.substring("series_id", 1, 1))
    rows = series.select("series_id", F.explode(F.array(F.concat(F.lit("suffix="), known), state)).alias("feature"))
    return _one_hot(rows, series)


def dimension_dummies(dimension: DataFrame, key: str, column: str) -> DataFrame:
    """series_id, feature, value: one-hot of a dimension's column."""
    rows = dimension.select(F.col(key).cast("string").alias("series_id"), F.concat(F.lit(f"{column}="), F.col(column).cast("string")).alias("feature"))
    return _one_hot(rows, rows.select("series_id").distinct())


KINDS = {"static": ["series_id"], "static_names": ["series_id", "feature", "value"], "future_shared": ["t"], "future_series": ["group_id", "series_id", "t"], "hist": ["group_id", "series_id", "t"]}


def build_features(blocks: list[tuple[str, DataFrame]]) -> dict[str, DataFrame]:
    """Blocks of one kind joined on their keys, columns in the given order. blocks: (kind, frame); a frame without its kind's keys raises.

    Static one-hot rows (series_id, feature, value) stay long: those of all blocks are together under static_names.
    """
    out: dict[str, DataFrame] = {}
    for kind, frame in blocks:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        if missing := set(KINDS[kind]) - set(frame.columns):
            raise ValueError(f"a {kind} block needs {sorted(missing)}")
        if kind == "static" and set(frame.columns) == set(KINDS["static_names"]):
            kind = "static_names"
        if kind == "static_names":
            frame = frame.select(*KINDS[kind])
            out[kind] = out[kind].unionByName(frame) if kind in out else frame
            continue
        frame = frame.drop("ds")
        out[kind] = out[kind].join(frame, KINDS[kind]) if kind in out else frame
    return out


def future_features(windows: DataFrame, size: int, h: int, shared: DataFrame, per_series: DataFrame) -> DataFrame:
    """group_id, t, k, series_id and the columns of shared (by t), then per_series (by group_id, series_id, t), for k in [-size, h)."""
    rows = windows.select("group_id", "t", F.explode(F.sequence(F.lit(-size), F.lit(h - 1))).alias("k")).withColumn("idx", F.col("t") + F.col("k"))
    own = per_series.withColumnRenamed("t", "idx")
    wide = rows.join(shared.drop("ds").withColumnRenamed("t", "idx"), "idx").join(own, ["group_id", "idx"])
    ends = [c for c in wide.columns if c not in ("group_id", "t", "k", "series_id", "idx")]
    return wide.select("group_id", "t", "k", "series_id", *ends)


def rescale_anchors(future: DataFrame, stats: DataFrame, anchors: list[str]) -> DataFrame:
    """Anchor columns by their window's (loc, scale); other columns stay."""
    rows = future.join(stats, ["group_id", "t", "series_id"])
    return rows.withColumns({a: (F.col(a) - F.col("loc")) / F.col("scale") for a in anchors}).drop("loc", "scale")


def static_features(groups: DataFrame, series: DataFrame) -> DataFrame:
    """Every group with every series: the group's columns, then the series'."""
    return groups.crossJoin(series)


def hist_features(window_rows: DataFrame, hist: DataFrame, column: str, upto_t: int | None = None) -> DataFrame:
    """A historical covariate over k < 0, by one mean and population deviation over all of hist (or its steps before upto_t)."""
    known = hist if upto_t is None else hist.where(F.col("t") < upto_t)
    stats = known.agg(F.avg(column).alias("_mean"), (F.stddev_pop(column) + 1e-6).alias("_std"))  # one row
    rows = window_rows.where("k < 0").select("group_id", "t", "k", "series_id", (F.col("t") + F.col("k")).alias("idx"))
    own = hist.select("group_id", "series_id", F.col("t").alias("idx"), column)
    scaled = rows.join(own, ["group_id", "series_id", "idx"]).crossJoin(F.broadcast(stats))
    return scaled.select("group_id", "t", "k", "series_id", ((F.col(column) - F.col("_mean")) / F.col("_std")).alias(column))
