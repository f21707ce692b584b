"""Rolling windows and splits by time. A window at t has history k in [-size, 0) and target k in [0, h)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import hashed


def n_steps(obs: DataFrame) -> int:
    last = obs.agg(F.max("t")).first()[0]
    return 0 if last is None else last + 1


def _valid(steps: int, size: int, h: int) -> None:
    if steps < size + h:
        raise ValueError(f"{steps} steps are fewer than {size} + {h}")


def expand(obs: DataFrame, windows: DataFrame | None, size: int, h: int, steps: int | None = None) -> DataFrame:
    """group_id, t, k, series_id, y, by an explode and without a range join: of the steps of windows (group_id, t), if given, which
    then meet obs on equal keys; else of obs, each row going to all windows that hold it."""
    steps = n_steps(obs) if steps is None else steps
    _valid(steps, size, h)
    if windows is not None:
        held = windows.where(F.col("t").between(size, steps - h)).select("group_id", "t", F.explode(F.sequence(F.lit(-size), F.lit(h - 1))).alias("k")).distinct()
        return held.withColumn("idx", F.col("t") + F.col("k")).join(obs.select("group_id", "series_id", F.col("t").alias("idx"), "y"), ["group_id", "idx"]).select("group_id", "t", "k", "series_id", "y")
    first = F.greatest(F.col("t") - (h - 1), F.lit(size))
    last = F.least(F.col("t") + size, F.lit(steps - h))
    rows = obs.where(first <= last).select("group_id", "series_id", F.explode(F.sequence(first, last)).alias("w"), F.col("t").alias("idx"), "y")
    return rows.select("group_id", F.col("w").alias("t"), (F.col("idx") - F.col("w")).alias("k"), "series_id", "y")


def rolling_windows(obs: DataFrame, size: int, h: int) -> DataFrame:
    """All windows, t in [size, steps - h]."""
    return expand(obs, None, size, h)


def packed_windows(obs: DataFrame, size: int, h: int) -> DataFrame:
    """One row a window and series: history and target as arrays."""
    steps = n_steps(obs)
    _valid(steps, size, h)
    by = Window.partitionBy("group_id", "series_id").orderBy("t")
    packed = obs.select("group_id", "series_id", "t", F.collect_list("y").over(by.rowsBetween(-size, -1)).alias("history"), F.collect_list("y").over(by.rowsBetween(0, h - 1)).alias("target"))
    return packed.where((F.col("t") >= size) & (F.col("t") <= steps - h))


def _times(calendar: DataFrame) -> tuple[DataFrame, int]:
    steps = calendar.agg(F.max("t")).first()[0] + 1
    return calendar.select(F.lit("").alias("group_id"), "t"), steps


def _split(times: DataFrame, rule) -> DataFrame:
    return times.withColumn("split", rule).where(F.col("split").isNotNull())


def _all_blocks(windows: DataFrame) -> DataFrame:
    found = {r["split"] for r in windows.groupBy("split").count().collect()}
    if missing := {"train", "val", "test"} - found:
        raise ValueError(f"empty blocks: {sorted(missing)}")
    return windows


def last_h_split(calendar: DataFrame, size: int, h: int) -> DataFrame:
    """test: the last window; val: the one h before; train: those whose targets end before val's begin."""
    times, steps = _times(calendar)
    _valid(steps, size, h)
    t = F.col("t")
    rule = F.when(t == steps - h, "test").when(t == steps - 2 * h, "val").when((t >= size) & (t + h <= steps - 2 * h), "train")
    return _all_blocks(_split(times.where(t >= size), rule))


def block_split(calendar: DataFrame, size: int, h: int, train: int, val: int, test: int) -> DataFrame:
    """Blocks of train, val and test steps; a window belongs to the block that holds its whole target (test: the last window only)."""
    times, steps = _times(calendar)
    if train + val + test != steps:
        raise ValueError(f"{train} + {val} + {test} is not {steps}")
    t = F.col("t")
    rule = F.when((t >= size) & (t + h <= train), "train").when((t >= train) & (t + h <= train + val), "val").when(t + h == steps, "test")
    return _all_blocks(_split(times.where(t >= size), rule))


def leaked_targets(windows: DataFrame, h: int) -> DataFrame:
    """group_id, idx of the steps that are targets in more than one split."""
    steps = windows.select("group_id", "split", F.explode(F.sequence(F.col("t"), F.col("t") + (h - 1))).alias("idx"))
    return steps.groupBy("group_id", "idx").agg(F.countDistinct("split").alias("n")).where("n > 1").select("group_id", "idx")


def target_indices(windows: DataFrame, h: int) -> DataFrame:
    """split, idx: the steps that are targets."""
    return windows.select("split", F.explode(F.sequence(F.col("t"), F.col("t") + (h - 1))).alias("idx")).distinct()


def panel_split(groups: DataFrame, calendar: DataFrame, size: int, h: int, n_val: int, n_test: int) -> DataFrame:
    """For each group: train [size, val_start - h], val [val_start, test_start - h], test {test_start}."""
    _, steps = _times(calendar)
    test_start, val_start = steps - n_test, steps - n_test - n_val
    if val_start - h < size or test_start - h < val_start or steps - h < test_start:
        raise ValueError("too few steps for this split")
    t = F.col("t")
    rule = F.when((t >= size) & (t <= val_start - h), "train").when((t >= val_start) & (t <= test_start - h), "val").when(t == test_start, "test")
    return _split(groups.select("group_id").crossJoin(calendar.select("t")), rule)


def split_sizes(windows: DataFrame) -> DataFrame:
    return windows.groupBy("split").agg(F.count("*").alias("n"))


def subsample(windows: DataFrame, limit: int, seed: int) -> DataFrame:
    """limit windows by a draw on (seed, t, group's number); the same for any partitioning."""
    keyed = hashed(windows.withColumn("_g", F.crc32(F.col("group_id").cast("binary"))), "_draw", [seed, "_g", "t"])
    return keyed.orderBy("_draw", "group_id", "t").limit(limit).drop("_draw", "_g")
