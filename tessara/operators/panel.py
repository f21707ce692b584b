"""Panels from fact logs: dense grids, fills, dimensions on dates, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["group_id", "series_id"]


def with_t(dates: DataFrame) -> DataFrame:
    """calendar (ds, t): t numbers the distinct dates, gaps or not. Dates are few, one row each."""
    return dates.select("ds").distinct().withColumn("t", (F.row_number().over(Window.orderBy("ds")) - 1).cast("int"))


def latest(facts: DataFrame, keys: list[str], value: str, order_col: str) -> DataFrame:
    """One row a key: the value of the row that comes last in order_col."""
    return facts.groupBy(*keys).agg(F.max_by(value, order_col).alias(value))


def known_facts(facts: DataFrame, groups: DataFrame, series: DataFrame, calendar: DataFrame) -> DataFrame:
    """Facts whose group, series and date are on the grid."""
    for dim, key in ((groups, "group_id"), (series, "series_id"), (calendar, "ds")):
        facts = facts.join(dim.select(key), key, "left_semi")
    return facts


def occurring(dim: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The rows of a dimension that facts mention."""
    return dim.join(facts.select(key), key, "left_semi")


def densify(facts: DataFrame, groups: DataFrame, series: DataFrame, calendar: DataFrame, value: str = "y", order_col: str | None = None, fill: float | None = 0.0) -> DataFrame:
    """The full grid group x series x date; absent facts become fill (None: stay null). With order_col later rows of a key win, else keys are unique."""
    own = known_facts(facts, groups, series, calendar)
    if order_col:
        own = latest(own, [*KEYS, "ds"], value, order_col)
    grid = groups.select("group_id").crossJoin(series.select("series_id")).crossJoin(calendar.select("ds", "t"))
    filled = F.col(value) if fill is None else F.coalesce(value, F.lit(fill))
    return grid.join(own.select(*KEYS, "ds", value), [*KEYS, "ds"], "left").select(*KEYS, "ds", "t", filled.alias(value))


def fill_forward_backward(df: DataFrame, keys: list[str], order: str, col: str, default: float = 0.0) -> DataFrame:
    """Nulls take the last value before them, else the first after them, else default."""
    by = Window.partitionBy(*keys).orderBy(order)
    before = F.last(col, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(col, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(col, F.coalesce(before, after, F.lit(default)))


def daily_from_weekly(prices: DataFrame, calendar: DataFrame, key: str) -> DataFrame:
    """Rows per week key put on each of its dates."""
    return prices.join(calendar.select(key, "ds", "t"), key).drop(key)


def broadcast_flag(flags: DataFrame, stores: DataFrame, on: str, prefix: str) -> DataFrame:
    """Columns prefix + state of a calendar, as rows (ds, store_id, flag) of each store of that state."""
    wide = [c for c in flags.columns if c.startswith(prefix)]
    long = flags.unpivot(["ds"], wide, "_name", "flag").select("ds", F.substring("_name", len(prefix) + 1, 100).alias(on), "flag")
    return stores.select("store_id", on).join(long, on).select("ds", "store_id", "flag")


def validate_panel(obs: DataFrame, nodes: DataFrame, edges: DataFrame, calendar: DataFrame) -> DataFrame:
    """problem, n: grid cells missing or repeated, unknown keys, bottom nodes without their own edge, names that repeat."""
    bottom = nodes.where("is_bottom").select(F.col("node_id").alias("series_id"))
    want = obs.select("group_id").distinct().crossJoin(bottom).crossJoin(calendar.select("ds"))
    have = obs.groupBy(*KEYS, "ds").agg(F.count("*").alias("n"))

    def say(problem: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(problem).alias("problem"), "n")

    own = edges.where("node_id = series_id").groupBy("node_id").agg(F.max("weight").alias("w"))
    rows = [
        say("missing cell", want.join(have, [*KEYS, "ds"], "left_anti")),
        say("repeated cell", have.where("n > 1")),
        say("unknown cell", have.join(want, [*KEYS, "ds"], "left_anti")),
        say("bottom node without its edge", bottom.join(own.where("w = 1"), F.col("series_id") == F.col("node_id"), "left_anti")),
        say("repeated node", nodes.groupBy("node_id").count().where("count > 1")),
        say("edge of unknown node", edges.join(nodes, "node_id", "left_anti")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where("n > 0")


def shape_counts(obs: DataFrame, nodes: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """n_groups, n_steps, n_bottom, n_nodes, and a column for each named width."""
    counted = obs.agg(F.countDistinct("group_id").alias("n_groups"), F.countDistinct("t").alias("n_steps"), F.countDistinct("series_id").alias("n_bottom"))
    return counted.crossJoin(nodes.agg(F.count("*").alias("n_nodes"))).select("*", *(F.lit(n).cast("long").alias(f"n_{k}") for k, n in (widths or {}).items()))


def money(col: Column | str) -> Column:
    """An exact sum of money, as a double."""
    return F.sum((F.col(col) if isinstance(col, str) else col).cast("decimal(18,2)")).cast("double")
