"""One query for each operator or close pair, named by its place in the inventory, with its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws, links
from ..operators import design, features, forecast, heads, hierarchy, packed, panel, sampling, scaling, scoring, windows
from ..sources import facts as fact_sources
from ..sources import hierarchy_csv
from ..sources import panel as panel_source
from .domains import A_END, A_SQL, B_SQL, C_SQL, events_daily, hash_sql, month, normal_sql, one_group, orders_seg, parts_panel, read, scratch, uniform_sql, until

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SIZE, H, LAG = 24, 6, 12


def twin(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def twin_by_date(sql: str) -> Callable[[Query], Query]:
    """The same for rows with a date ds, which both sides give as text."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(spark, d).withColumn("ds", F.col("ds").cast("string"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        twin(f"SELECT * REPLACE (CAST(CAST(ds AS DATE) AS VARCHAR) AS ds) FROM ({sql})")(run)
        return run

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


# Sources


@twin_by_date(f"WITH {A_SQL} SELECT node_id, ds, t, round(y, 2) AS y FROM (SELECT series_id AS node_id, ds, t, y FROM obs UNION ALL SELECT node_id, ds, t, y FROM agg JOIN cal USING (t) JOIN nodes USING (node_id) WHERE NOT is_bottom)")
def s1_wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    """A wide table, one column a node, back to long rows."""
    a = orders_seg(spark, d)
    nodes = [r["node_id"] for r in a["nodes"].orderBy("node_idx").collect()]
    wide = hierarchy.aggregate(a["obs"], a["edges"]).join(a["calendar"], "t").groupBy("ds").pivot("node_id", nodes).agg(F.first("y"))
    long = hierarchy_csv._long(wide, "ds", nodes, "node_id", "y")
    return rounded(long.join(panel.with_t(wide), "ds").select("node_id", "ds", "t", "y"), 2)


@twin(f"WITH {A_SQL} SELECT node_id, series_id, 1.0::DOUBLE AS weight FROM edges")
def s2_matrix_to_edges(spark: SparkSession, d: str) -> DataFrame:
    a = orders_seg(spark, d)
    names = [r["series_id"] for r in a["series"].orderBy("series_no").collect()]
    matrix = a["edges"].groupBy("node_id").pivot("series_id", names).agg(F.first("weight")).na.fill(0.0)
    return hierarchy_csv._long(matrix, "node_id", names, "series_id", "weight").where("weight <> 0")


@twin(f"WITH {A_SQL}, o AS (SELECT node_id, node_idx, CASE WHEN node_idx = 1 THEN 2 WHEN node_idx = 2 THEN 1 ELSE node_idx END AS place FROM nodes WHERE node_idx <> 5) SELECT coalesce(o.node_id, n.node_id) AS node_id, rank_ AS in_data, n.node_idx AS in_matrix FROM (SELECT node_id, CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS rank_ FROM o) o FULL JOIN nodes n ON o.node_id = n.node_id WHERE rank_ IS DISTINCT FROM n.node_idx")
def s3_name_contract(spark: SparkSession, d: str) -> DataFrame:
    """Names out of place: two are exchanged and one is left out of the data's columns."""
    nodes = orders_seg(spark, d)["nodes"]
    names = [r["node_id"] for r in nodes.orderBy("node_idx").collect()]
    names[1], names[2] = names[2], names[1]
    del names[5]
    return hierarchy_csv.name_mismatches(names, nodes)


@twin_by_date(f"WITH {A_SQL} SELECT series_id, ds, t, round(y, 2) AS y FROM obs WHERE ds <= DATE '2000-12-31'")
def s1_s4_read_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """A wide series table and its matrix, written as CSV files and read up to an end date."""
    a, path = orders_seg(spark, d), scratch(spark, "hierarchy")
    nodes = [r["node_id"] for r in a["nodes"].orderBy("node_idx").collect()]
    names = [r["series_id"] for r in a["series"].orderBy("series_no").collect()]
    hierarchy.aggregate(a["obs"], a["edges"]).join(a["calendar"], "t").groupBy("ds").pivot("node_id", nodes).agg(F.first("y")).orderBy("ds").coalesce(1).write.csv(f"{path}/data", header=True)
    matrix = a["edges"].groupBy("node_id").pivot("series_id", names).agg(F.first("weight")).na.fill(0.0)
    matrix.join(a["nodes"].select("node_id", "node_idx"), "node_id").orderBy("node_idx").drop("node_idx").coalesce(1).write.csv(f"{path}/matrix", header=True)
    levels = [(r["level"], r["start"], r["stop"]) for r in hierarchy.level_slices(a["nodes"]).orderBy("level_idx").collect()]
    return rounded(hierarchy_csv.read_hierarchy(spark, f"{path}/data", f"{path}/matrix", levels, "2000-12-31").obs.drop("group_id"), 2)


@twin_by_date("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1")
def s4_truncate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where(until("o_orderdate", A_END)).groupBy(month("o_orderdate").alias("ds")).agg(F.count("*").alias("n"))


@twin("SELECT l_shipdate, CAST(l_suppkey AS INTEGER) AS store, CAST(l_partkey AS INTEGER) AS item, l_quantity AS sales, l_discount >= 0.05 AS promo FROM lineitem")
def s5_fact_log(spark: SparkSession, d: str) -> DataFrame:
    """Five columns with pinned types of a CSV log that has more."""
    path = scratch(spark, "facts")
    read(spark, d, "lineitem").select("l_tax", "l_shipdate", F.col("l_suppkey").alias("store"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("sales"), (F.col("l_discount") >= 0.05).alias("promo")).write.csv(path, header=True)
    return fact_sources.read_facts(spark, path, "l_shipdate TIMESTAMP, store INT, item INT, sales DOUBLE, promo BOOLEAN", ["l_shipdate", "store", "item", "sales", "promo"])


@twin_by_date(f"WITH {C_SQL} SELECT series_id, ds, t, y FROM obs")
def s6_unpivot_days(spark: SparkSession, d: str) -> DataFrame:
    c = events_daily(spark, d)
    calendar = c["calendar"].withColumn("d", F.concat(F.lit("d_"), F.col("t") + 1))
    days = [r["d"] for r in calendar.orderBy("t").collect()]
    wide = c["obs"].join(calendar.select("t", "d"), "t").groupBy("series_id").pivot("d", days).agg(F.first("y"))
    return fact_sources.unpivot_days(wide, ["series_id"], calendar)


@twin("SELECT n_name, r_name, count(s_suppkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def s7_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions read from CSV files with pinned types."""
    path = scratch(spark, "dimensions")
    for name in ("nation", "region"):
        read(spark, d, name).write.csv(f"{path}/{name}", header=True)
    nation = fact_sources.read_csv(spark, f"{path}/nation", "n_nationkey INT, n_name STRING, n_regionkey INT")
    dims = nation.join(fact_sources.read_csv(spark, f"{path}/region", "r_regionkey INT, r_name STRING"), F.col("n_regionkey") == F.col("r_regionkey"))
    return dims.join(read(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count("s_suppkey").alias("n"))


@twin_by_date(f"WITH {B_SQL} SELECT group_id, series_id, ds, t, y FROM obs")
def s8_s10_panel_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A panel written as tables and opened again."""
    path = scratch(spark, "panel")
    panel_source.write_panel(parts_panel(spark, d), path)
    return panel_source.read_panel(spark, path)["obs"].select("group_id", "series_id", "ds", "t", "y")


# Panels


@twin_by_date(f"WITH {B_SQL} SELECT group_id, series_id, ds, t, y FROM obs")
def p1_densify(spark: SparkSession, d: str) -> DataFrame:
    return parts_panel(spark, d)["obs"]


@twin_by_date(f"WITH {B_SQL} SELECT group_id, series_id, ds, y FROM fact JOIN cal USING (ds) WHERE t >= 12 AND series_id IN (SELECT series_id FROM ser WHERE region <> 'ASIA')")
def p2_known_facts(spark: SparkSession, d: str) -> DataFrame:
    b = parts_panel(spark, d)
    return panel.known_facts(b["facts"], b["groups"], b["bottom"].where("region <> 'ASIA'"), b["calendar"].where("t >= 12")).select("group_id", "series_id", "ds", "y")


@twin_by_date("SELECT l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds, max(k) AS last_line, max_by(l_quantity, k) AS y FROM (SELECT *, l_orderkey * 100 + l_linenumber AS k FROM lineitem) GROUP BY ALL")
def p3_last_row_wins(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select("l_partkey", month("l_shipdate").alias("ds"), F.col("l_quantity").alias("y"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"))
    order = lines.groupBy("l_partkey", "ds").agg(F.max("k").alias("last_line"))
    return panel.latest(lines, ["l_partkey", "ds"], "y", "k").join(order, ["l_partkey", "ds"])


@twin("SELECT p_partkey, p_type FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01')")
def p4_occurring(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").where("l_shipdate < TIMESTAMP '1996-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return panel.occurring(read(spark, d, "part").select("p_partkey", "p_type"), lines, "p_partkey")


def _fill_sql(column: str) -> str:
    by = "PARTITION BY group_id, series_id ORDER BY t"
    return f"""WITH {B_SQL} SELECT group_id, series_id, t, coalesce(last_value({column} IGNORE NULLS) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value({column} IGNORE NULLS) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {column} FROM grid LEFT JOIN fact USING (group_id, series_id, ds)"""


def _filled(spark: SparkSession, d: str, column: str) -> DataFrame:
    b = parts_panel(spark, d)
    sparse = panel.densify(b["facts"], b["groups"], b["bottom"], b["calendar"], column, fill=None)
    return panel.fill_forward_backward(sparse, ["group_id", "series_id"], "t", column).select("group_id", "series_id", "t", column)


@twin(_fill_sql("promo"))
def p5_promotion_fill(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d, "promo")


@twin(f"WITH {B_SQL} SELECT series_id, t, coalesce(n, 0.0) AS footfall FROM ser CROSS JOIN cal LEFT JOIN (SELECT series_id, ds, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS n FROM line GROUP BY ALL) f USING (series_id, ds)")
def p6_footfall(spark: SparkSession, d: str) -> DataFrame:
    b = parts_panel(spark, d)
    seen = b["lines"].groupBy(F.lit("").alias("group_id"), F.col("nation").alias("series_id"), "ds").agg(F.countDistinct("l_orderkey").cast("double").alias("footfall"))
    return panel.densify(seen, one_group(spark), b["bottom"], b["calendar"], "footfall").select("series_id", "t", "footfall")


@twin_by_date(f"WITH {C_SQL}, wk AS (SELECT event_type AS series_id, date_diff('day', DATE '1970-01-05', CAST(ts AS DATE)) // 7 AS week, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS price FROM events GROUP BY ALL) SELECT series_id, ds, t, price FROM wk JOIN (SELECT ds, t, date_diff('day', DATE '1970-01-05', ds) // 7 AS week FROM cal) USING (week)")
def p7_weekly_to_daily(spark: SparkSession, d: str) -> DataFrame:
    week = F.floor(F.datediff(F.col("ds"), F.lit("1970-01-05").cast("date")) / 7).alias("week")
    events = read(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("ds"), "value")
    prices = events.groupBy("series_id", week).agg(panel.money("value").alias("price"))
    calendar = panel.with_t(events).select("ds", "t", week)
    return panel.daily_from_weekly(prices, calendar, "week").select("series_id", "ds", "t", "price")


@twin(_fill_sql("price"))
def p8_price_fill(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d, "price")


@twin_by_date(f"WITH {C_SQL} SELECT s_suppkey AS store_id, ds, CASE r_name WHEN 'ASIA' THEN CAST(day(ds) % 2 = 0 AS INTEGER) ELSE CAST(day(ds) % 3 = 0 AS INTEGER) END AS flag FROM cal CROSS JOIN supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def p9_state_flag(spark: SparkSession, d: str) -> DataFrame:
    flags = events_daily(spark, d)["calendar"].select("ds", (F.day("ds") % 2 == 0).cast("int").alias("snap_ASIA"), (F.day("ds") % 3 == 0).cast("int").alias("snap_EUROPE"))
    stores = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return panel.broadcast_flag(flags, stores.select(F.col("s_suppkey").alias("store_id"), F.col("r_name").alias("state")), "state", "snap_").select("store_id", "ds", "flag")


@twin(f"WITH {B_SQL} SELECT * FROM (SELECT 'missing cell' AS problem, count(*) AS n FROM grid LEFT JOIN fact USING (group_id, series_id, ds) WHERE y IS NULL UNION ALL SELECT 'bottom node without its edge', count(*) FROM ser WHERE region = 'ASIA') WHERE n > 0")
def p10_validate(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the sparse facts as a panel whose ASIA series have lost their own edges."""
    b = parts_panel(spark, d)
    asia = b["bottom"].where("region = 'ASIA'").select(F.col("series_id").alias("node_id"))
    return panel.validate_panel(b["facts"], b["nodes"], b["edges"].join(asia, "node_id", "left_anti"), b["calendar"])


@twin(f"WITH {B_SQL} SELECT (SELECT count(*) FROM grp) AS n_groups, (SELECT count(*) FROM cal) AS n_steps, (SELECT count(*) FROM ser) AS n_bottom, (SELECT count(*) FROM nodes) AS n_nodes, CAST(7 AS BIGINT) AS n_future, CAST(1 AS BIGINT) AS n_hist")
def p11_shape_counts(spark: SparkSession, d: str) -> DataFrame:
    b = parts_panel(spark, d)
    return panel.shape_counts(b["obs"], b["nodes"], {"future": 7, "hist": 1})


# Hierarchies


@twin(f"WITH {A_SQL} SELECT n.node_id, node_idx, n.level, n.level_idx, is_bottom, series_id FROM nodes n JOIN edges USING (node_id)")
def h1_build_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    a = orders_seg(spark, d)
    return a["nodes"].join(a["edges"], "node_id").drop("weight")


@twin_by_date(f"WITH {A_SQL} SELECT ds, region, segment, grouping(region) + 2 * grouping(segment) AS level_bits, round(sum(y), 2) AS y FROM fact GROUP BY GROUPING SETS ((ds), (ds, region), (ds, segment), (ds, region, segment))")
def h2_grouped_levels(spark: SparkSession, d: str) -> DataFrame:
    a = orders_seg(spark, d)
    rows = a["facts"].join(a["bottom"], "series_id")
    return rounded(hierarchy.aggregate_by_attributes(rows, ["ds"], [[], ["region"], ["segment"], ["region", "segment"]]), 2).withColumn("level_bits", F.col("level_bits").cast("long"))


@twin(f"WITH {A_SQL} SELECT n.node_id, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS weight FROM nodes n WHERE is_bottom AND n.node_id LIKE 'ASIA-%' UNION ALL SELECT node_id, 1, 2.0 FROM nodes WHERE is_bottom AND node_id LIKE 'EUROPE-%'")
def h3_identity(spark: SparkSession, d: str) -> DataFrame:
    """Bottom nodes whose own edge was taken away (ASIA) or doubled in weight (EUROPE)."""
    a = orders_seg(spark, d)
    own = F.col("node_id") == F.col("series_id")
    edges = a["edges"].where(~(own & F.col("node_id").startswith("ASIA"))).withColumn("weight", F.when(own & F.col("node_id").startswith("EUROPE"), 2.0).otherwise(F.col("weight")))
    return hierarchy.check_identity(a["nodes"], edges)


@twin(f"WITH {A_SQL} SELECT group_id, t, node_id, round(y, 2) AS y, round(y * 1.01, 2) AS stored FROM agg WHERE t % 10 = 0 AND y > 0")
def h4_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Stored values that are 1 % off at every tenth step."""
    a = orders_seg(spark, d)
    stored = hierarchy.aggregate(a["obs"], a["edges"]).withColumn("y", F.when(F.col("t") % 10 == 0, F.col("y") * 1.01).otherwise(F.col("y")))
    return rounded(hierarchy.verify_coherence(a["obs"], a["edges"], stored).drop("gap"), 2)


@twin(f"WITH {A_SQL} SELECT group_id, t, node_id, round(y, 2) AS y FROM agg")
def h5_aggregate(spark: SparkSession, d: str) -> DataFrame:
    a = orders_seg(spark, d)
    return rounded(hierarchy.aggregate(a["obs"], a["edges"]), 2)


@twin(f"WITH {B_SQL} SELECT o.group_id, o.t, 0 AS h, i, node_id, round(sum(greatest(o.y - 40 * i, 0)), 2) AS y FROM obs o CROSS JOIN (SELECT unnest(range(3))::INTEGER AS i) JOIN edges USING (series_id) GROUP BY ALL")
def h6_clip_then_sum(spark: SparkSession, d: str) -> DataFrame:
    b = parts_panel(spark, d)
    drawn = b["obs"].select("group_id", "series_id", "t", F.lit(0).alias("h"), "y", F.explode(F.array(*map(F.lit, range(3)))).alias("i")).withColumn("y", F.col("y") - 40 * F.col("i"))
    return rounded(hierarchy.coherent_aggregate(drawn, b["edges"]), 2)


@twin(f"WITH {A_SQL}, s AS (SELECT level, level_idx, min(node_idx) AS start, max(node_idx) + 1 AS stop FROM nodes GROUP BY ALL), m AS (SELECT level, level_idx, start, CASE WHEN level = 'Region' THEN stop - 1 ELSE stop END AS stop FROM s) SELECT level, start, stop FROM (SELECT *, coalesce(lag(stop) OVER (ORDER BY level_idx), 0) AS want FROM m) WHERE start <> want")
def h7_level_slices(spark: SparkSession, d: str) -> DataFrame:
    """A slice that was cut short leaves a gap before the next."""
    nodes = orders_seg(spark, d)["nodes"]
    slices = hierarchy.level_slices(nodes).withColumn("stop", F.when(F.col("level") == "Region", F.col("stop") - 1).otherwise(F.col("stop")))
    return hierarchy.validate_levels(slices, nodes.count())


@twin(f"WITH {A_SQL} SELECT node_id, node_idx FROM nodes WHERE level = 'Segment'")
def h8_level_mask(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.level_mask(orders_seg(spark, d)["nodes"], "Segment").select("node_id", "node_idx")


@twin(f"WITH {A_SQL} SELECT level, string_agg(node_id, ',' ORDER BY node_idx) AS names FROM nodes GROUP BY level")
def h9_level_tags(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.level_tags(orders_seg(spark, d)["nodes"]).select("level", F.array_join("names", ",").alias("names"))


@twin(f"WITH {A_SQL} SELECT node_id, node_idx, CAST(len(string_split(node_id, '-')) - 1 AS INTEGER) AS depth FROM nodes")
def h10_levels_from_depth(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.levels_from_depth(orders_seg(spark, d)["nodes"], "-")


def _stats_sql(loc: str, scale: str) -> str:
    return f"SELECT group_id, t, series_id, {loc} AS loc, {scale} AS scale FROM win WHERE k < 0 GROUP BY ALL"


def _windows_sql(size: int, h: int) -> str:
    return f"lim AS (SELECT max(t) + 1 AS steps FROM cal), win AS (SELECT group_id, w.t, CAST(o.t - w.t AS INTEGER) AS k, series_id, y FROM obs o JOIN (SELECT t FROM cal) w ON o.t >= w.t - {size} AND o.t < w.t + {h} CROSS JOIN lim WHERE w.t >= {size} AND w.t <= steps - {h})"


#: Sums of ratios of whole numbers are often exact halves of the last digit, which rounding errors would tip: both sides are moved off them.
_OFF_HALVES = 1.2345e-6
_H11_SQL = f"WITH {B_SQL}, {_windows_sql(12, 3)}, st AS ({_stats_sql('0.0', 'greatest(avg(abs(y)), 1)')}) SELECT group_id, t, k, node_id, round(sum((y - loc) / scale) + {_OFF_HALVES}, 4) AS z FROM win JOIN st USING (group_id, t, series_id) JOIN edges USING (series_id) WHERE k < 0 GROUP BY ALL"


@twin(_H11_SQL)
def h11_lift_history(spark: SparkSession, d: str) -> DataFrame:
    """The history of all windows of all groups for all nodes."""
    b = parts_panel(spark, d)
    rows = windows.rolling_windows(b["obs"], 12, 3).where("k < 0")
    return rounded(hierarchy.lift_history(scaling.normalize(rows, scaling.scale_stats(rows, "mean_floor")), b["edges"]).withColumn("z", F.col("z") + _OFF_HALVES))


@twin(_H11_SQL)
def h11_lift_history_all(spark: SparkSession, d: str) -> DataFrame:
    """The same from series arrays: windows are slices and their statistics array functions."""
    b = parts_panel(spark, d)
    arrays = design.series_arrays(b["obs"], {"y": "y"})
    steps = F.explode(F.sequence(F.lit(12), F.size("y") - 3)).alias("t")
    rows = arrays.where(F.size("y") >= 15).select("group_id", "series_id", "y", steps).withColumn("past", F.slice("y", F.col("t") - 11, 12))
    loc, scale = scaling.array_stats(F.col("past"), "mean_floor")
    long = rows.select("group_id", "t", "series_id", F.posexplode(F.transform("past", lambda x: (x - loc) / scale)).alias("k", "z")).withColumn("k", F.col("k") - 12)
    return rounded(hierarchy.lift_history(long, b["edges"]).withColumn("z", F.col("z") + _OFF_HALVES))


@twin(f"WITH {B_SQL} SELECT g.group_id, g.t, node_id, coalesce(f.promo, 0.0) AS promo FROM (SELECT DISTINCT group_id, t FROM fact JOIN cal USING (ds)) g CROSS JOIN nodes LEFT JOIN (SELECT group_id, t, series_id, promo FROM fact JOIN cal USING (ds)) f ON f.group_id = g.group_id AND f.t = g.t AND f.series_id = node_id")
def h12_lift_historical(spark: SparkSession, d: str) -> DataFrame:
    b = parts_panel(spark, d)
    return hierarchy.lift_historical(b["facts"].join(b["calendar"], "ds").select("group_id", "t", "series_id", "promo"), b["nodes"], "promo")


# Windows and splits


@twin(f"WITH {C_SQL}, {_windows_sql(14, 7)} SELECT group_id, t, k, series_id, y FROM win")
def w1_rolling_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.rolling_windows(events_daily(spark, d)["obs"], 14, 7)


@twin(f"WITH {C_SQL}, {_windows_sql(14, 7)} SELECT group_id, series_id, t, string_agg(CAST(CAST(y AS INTEGER) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k < 0) AS history, string_agg(CAST(CAST(y AS INTEGER) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k >= 0) AS target FROM win GROUP BY ALL")
def w1_packed_windows(spark: SparkSession, d: str) -> DataFrame:
    said = lambda c: F.array_join(F.transform(c, lambda y: y.cast("int").cast("string")), ",").alias(c)
    return windows.packed_windows(events_daily(spark, d)["obs"], 14, 7).select("group_id", "series_id", "t", said("history"), said("target"))


@twin(f"WITH {C_SQL}, {_windows_sql(14, 7)} SELECT group_id, series_id, t, string_agg(CAST(CAST(y AS INTEGER) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k < 0) AS history, string_agg(CAST(CAST(y AS INTEGER) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k >= 0) AS target FROM win GROUP BY ALL")
def w1_bucketed_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same over a panel in buckets of its series, whose rows are not shuffled for it."""
    path = scratch(spark, "buckets")
    panel_source.write_panel({"obs": events_daily(spark, d)["obs"]}, path, buckets=8)
    obs = panel_source.read_panel(spark, path, ("obs",))["obs"]
    said = lambda c: F.array_join(F.transform(c, lambda y: y.cast("int").cast("string")), ",").alias(c)
    return windows.packed_windows(obs, 14, 7).select("group_id", "series_id", "t", said("history"), said("target"))


@twin(f"WITH {A_SQL}, lim AS (SELECT max(t) + 1 AS s FROM cal) SELECT '' AS group_id, t, CASE WHEN t = s - 6 THEN 'test' WHEN t = s - 12 THEN 'val' ELSE 'train' END AS split FROM cal CROSS JOIN lim WHERE t >= 24 AND (t = s - 6 OR t = s - 12 OR t + 6 <= s - 12)")
def w2_last_h_split(spark: SparkSession, d: str) -> DataFrame:
    return windows.last_h_split(orders_seg(spark, d)["calendar"], SIZE, H)


@twin(f"WITH {A_SQL}, lim AS (SELECT max(t) + 1 AS s FROM cal), r AS (SELECT t, CASE WHEN t + 6 <= s - 30 THEN 'train' WHEN t >= s - 30 AND t + 6 <= s - 10 THEN 'val' WHEN t + 6 = s THEN 'test' END AS split FROM cal CROSS JOIN lim WHERE t >= 24) SELECT '' AS group_id, t, split FROM r WHERE split IS NOT NULL")
def w3_block_split(spark: SparkSession, d: str) -> DataFrame:
    calendar = orders_seg(spark, d)["calendar"]
    return windows.block_split(calendar, SIZE, H, calendar.count() - 30, 20, 10)


@twin(f"WITH {A_SQL}, lim AS (SELECT max(t) + 1 AS s FROM cal), r AS (SELECT t, CASE WHEN t + 6 <= s - 30 THEN 'train' WHEN t >= s - 30 AND t + 6 <= s - 10 THEN 'val' WHEN t + 6 = s THEN 'test' END AS split FROM cal CROSS JOIN lim WHERE t >= 24), bad AS (SELECT t, split FROM r WHERE split IS NOT NULL UNION ALL SELECT s - 33, 'val' FROM lim) SELECT '' AS group_id, idx FROM (SELECT split, CAST(t AS INTEGER) + unnest(range(6))::INTEGER AS idx FROM bad) GROUP BY idx HAVING count(DISTINCT split) > 1")
def w5_leaked_targets(spark: SparkSession, d: str) -> DataFrame:
    """A validation window that reaches into training targets is found out."""
    calendar = orders_seg(spark, d)["calendar"]
    n = calendar.count()
    split = windows.block_split(calendar, SIZE, H, n - 30, 20, 10)
    return windows.leaked_targets(split.unionByName(spark.range(1).select(F.lit("").alias("group_id"), F.lit(n - 33).alias("t"), F.lit("val").alias("split"))), H)


_PANEL_SPLIT_SQL = f"WITH {B_SQL}, lim AS (SELECT max(t) + 1 AS s FROM cal), r AS (SELECT group_id, t, CASE WHEN t <= s - 18 - 6 THEN 'train' WHEN t >= s - 18 AND t <= s - 6 - 6 THEN 'val' WHEN t = s - 6 THEN 'test' END AS split FROM grp CROSS JOIN cal CROSS JOIN lim WHERE t >= 24)"


@twin(f"{_PANEL_SPLIT_SQL} SELECT group_id, t, split FROM r WHERE split IS NOT NULL")
def w6_panel_split(spark: SparkSession, d: str) -> DataFrame:
    b = parts_panel(spark, d)
    return windows.panel_split(b["groups"], b["calendar"], SIZE, H, 12, H)


@twin(f"{_PANEL_SPLIT_SQL} SELECT split, count(*) AS n FROM r WHERE split IS NOT NULL GROUP BY split")
def w7_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return windows.split_sizes(w6_panel_split(spark, d))


#: A text's CRC-32 bit by bit, for one-byte characters.
_CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(group_id) + 1), lambda i: [ord(substr(group_id, i::BIGINT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
_VAL_SQL = f"SELECT group_id, t, split, {_CRC_SQL} AS g FROM r WHERE split = 'val'"


@twin(f"{_PANEL_SPLIT_SQL} SELECT group_id, t, split FROM ({hash_sql(_VAL_SQL, 'draw', ['3', 'g', 't'], '0')}) ORDER BY draw, group_id, t LIMIT 16")
def w8_subsample(spark: SparkSession, d: str) -> DataFrame:
    return windows.subsample(w6_panel_split(spark, d).where("split = 'val'"), 16, 3)


# Features


def _calendar_sql(columns: str) -> str:
    return f"WITH {C_SQL} SELECT ds, t, {columns} FROM cal"


@twin_by_date(f"WITH {A_SQL} SELECT ds, t, {', '.join(f'(quarter(ds) = {q})::INTEGER::DOUBLE AS quarter_{q}' for q in range(1, 5))} FROM cal")
def f1_quarter(spark: SparkSession, d: str) -> DataFrame:
    return features.quarter_dummies(orders_seg(spark, d)["calendar"])


@twin_by_date(f"WITH {A_SQL} SELECT ds, t, {', '.join(f'(month(ds) = {m})::INTEGER::DOUBLE AS month_{m}' for m in range(1, 13))} FROM cal")
def f2_month(spark: SparkSession, d: str) -> DataFrame:
    return features.month_dummies(orders_seg(spark, d)["calendar"])


@twin_by_date(_calendar_sql(", ".join(f"(isodow(ds) - 1 = {w})::INTEGER::DOUBLE AS dow_{w}" for w in range(7))))
def f3_dayofweek(spark: SparkSession, d: str) -> DataFrame:
    return features.dayofweek_dummies(events_daily(spark, d)["calendar"])


@twin_by_date(_calendar_sql("(isodow(ds) >= 6)::INTEGER::DOUBLE AS weekend"))
def f4_weekend(spark: SparkSession, d: str) -> DataFrame:
    return features.weekend_indicator(events_daily(spark, d)["calendar"])


@twin_by_date(_calendar_sql("round(least(abs(isodow(ds) - 6), 7 - abs(isodow(ds) - 6)) / 3.0, 6) AS saturday"))
def f5_saturday(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.saturday_proximity(events_daily(spark, d)["calendar"]), 6)


@twin(f"WITH {A_SQL} SELECT group_id, series_id, t, {', '.join(f'coalesce(lag(y, {n}) OVER w, first_value(y) OVER w) AS anchor_{n}' for n in (6, 12))} FROM obs WINDOW w AS (PARTITION BY group_id, series_id ORDER BY t)")
def f6_anchor(spark: SparkSession, d: str) -> DataFrame:
    return features.seasonal_naive_anchor(orders_seg(spark, d)["obs"], [6, 12], H)


_NAMED = "SELECT series_id, 'region=' || region AS f FROM ser UNION ALL SELECT series_id, 'segment=' || segment FROM ser"


@twin(f"WITH {A_SQL}, own AS ({_NAMED}) SELECT s.series_id, c.f AS feature, CASE WHEN o.f IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM ser s CROSS JOIN (SELECT DISTINCT f FROM own) c LEFT JOIN own o ON o.series_id = s.series_id AND o.f = c.f")
def f8_grouped_static(spark: SparkSession, d: str) -> DataFrame:
    return features.grouped_static_dummies(orders_seg(spark, d)["series"], ["region", "segment"])


@twin(f"WITH {A_SQL} SELECT series_id, series_id AS feature, 1.0::DOUBLE AS value FROM ser")
def f9_identity(spark: SparkSession, d: str) -> DataFrame:
    return features.identity_dummies(orders_seg(spark, d)["series"])


@twin(f"WITH {A_SQL}, own AS (SELECT series_id, 'suffix=' || segment AS f FROM ser UNION ALL SELECT series_id, 'state=' || left(series_id, 1) FROM ser) SELECT s.series_id, c.f AS feature, CASE WHEN o.f IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM ser s CROSS JOIN (SELECT DISTINCT f FROM own) c LEFT JOIN own o ON o.series_id = s.series_id AND o.f = c.f")
def f10_prefix_suffix(spark: SparkSession, d: str) -> DataFrame:
    a = orders_seg(spark, d)
    return features.prefix_suffix_dummies(a["series"], sorted(r["segment"] for r in a["bottom"].select("segment").distinct().collect()))


@twin("WITH own AS (SELECT CAST(p_partkey AS VARCHAR) AS series_id, 'p_type=' || p_type AS f FROM part) SELECT s.series_id, c.f AS feature, CASE WHEN o.f IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM (SELECT DISTINCT series_id FROM own) s CROSS JOIN (SELECT DISTINCT f FROM own) c LEFT JOIN own o ON o.series_id = s.series_id AND o.f = c.f")
def f11_dimension(spark: SparkSession, d: str) -> DataFrame:
    return features.dimension_dummies(read(spark, d, "part"), "p_partkey", "p_type")


@twin(f"WITH {C_SQL} SELECT t, (isodow(ds) >= 6)::INTEGER::DOUBLE AS weekend, round(least(abs(isodow(ds) - 6), 7 - abs(isodow(ds) - 6)) / 3.0, 6) AS saturday FROM cal")
def f12_blocks(spark: SparkSession, d: str) -> DataFrame:
    calendar = events_daily(spark, d)["calendar"]
    made = features.build_features([("future_shared", features.weekend_indicator(calendar)), ("future_shared", features.saturday_proximity(calendar))])
    return rounded(made["future_shared"], 6)


_FUTURE_SQL = f"""WITH {C_SQL}, {_windows_sql(14, 7)}, anc AS (SELECT group_id, series_id, t, coalesce(lag(y, 7) OVER w, first_value(y) OVER w) AS anchor_7 FROM obs WINDOW w AS (PARTITION BY group_id, series_id ORDER BY t)),
fut AS (SELECT win.group_id, win.t, win.k, win.series_id, (isodow(ds) >= 6)::INTEGER::DOUBLE AS weekend, anchor_7 FROM win JOIN anc ON anc.group_id = win.group_id AND anc.series_id = win.series_id AND anc.t = win.t + win.k JOIN cal ON cal.t = win.t + win.k)"""


def _future(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = events_daily(spark, d)
    rows = windows.rolling_windows(c["obs"], 14, 7)
    anchors = features.seasonal_naive_anchor(c["obs"], [7], 7)
    return features.future_features(rows.select("group_id", "t").distinct(), 14, 7, features.weekend_indicator(c["calendar"]), anchors), rows


@twin(f"{_FUTURE_SQL}, st AS ({_stats_sql('0.0', 'greatest(avg(abs(y)), 1)')}) SELECT group_id, t, k, series_id, weekend, round((anchor_7 - loc) / scale, 4) AS anchor_7 FROM fut JOIN st USING (group_id, t, series_id)")
def f14_rescaled_anchors(spark: SparkSession, d: str) -> DataFrame:
    future, rows = _future(spark, d)
    return rounded(features.rescale_anchors(future, scaling.scale_stats(rows, "mean_floor"), ["anchor_7"])).select("group_id", "t", "k", "series_id", "weekend", "anchor_7")


@twin(f"WITH {B_SQL} SELECT group_id, length(group_id) AS group_size, series_id, region FROM grp CROSS JOIN ser")
def f15_static(spark: SparkSession, d: str) -> DataFrame:
    b = parts_panel(spark, d)
    return features.static_features(b["groups"].withColumn("group_size", F.length("group_id").cast("long")), b["bottom"])


@twin(f"{_FUTURE_SQL} SELECT group_id, t, k, series_id, weekend, anchor_7 FROM fut")
def f16_future(spark: SparkSession, d: str) -> DataFrame:
    return _future(spark, d)[0]


@twin(f"WITH {C_SQL}, {_windows_sql(14, 7)}, s AS (SELECT avg(y) AS m, stddev_pop(y) + 1e-6 AS d FROM obs) SELECT group_id, t, k, series_id, round((y - m) / d, 4) AS y FROM win CROSS JOIN s WHERE k < 0")
def f17_hist(spark: SparkSession, d: str) -> DataFrame:
    obs = events_daily(spark, d)["obs"]
    return rounded(features.hist_features(windows.rolling_windows(obs, 14, 7), obs, "y"))


# Scaling

_SCALERS = {
    "n1_identity": ("identity", _stats_sql("0.0", "1.0")),
    "n2_standard": ("standard", _stats_sql("avg(y)", "stddev_samp(y) + 1e-6")),
    "n3_robust": ("robust", "SELECT group_id, t, series_id, loc, quantile_disc(abs(y - loc), 0.5) + 1e-6 AS scale FROM win JOIN (SELECT group_id, t, series_id, quantile_disc(y, 0.5) AS loc FROM win WHERE k < 0 GROUP BY ALL) USING (group_id, t, series_id) WHERE k < 0 GROUP BY ALL"),
    "n4_mean": ("mean", _stats_sql("0.0", "avg(abs(y)) + 1e-6")),
    "n5_mean_floor": ("mean_floor", _stats_sql("0.0", "greatest(avg(abs(y)), 1)")),
}


def _scaler(name: str, scaler: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(scaling.scale_stats(windows.rolling_windows(events_daily(spark, d)["obs"], 14, 7), scaler))

    run.__name__ = name
    twin(f"WITH {C_SQL}, {_windows_sql(14, 7)} SELECT group_id, t, series_id, round(loc, 4)::DOUBLE AS loc, round(scale, 4)::DOUBLE AS scale FROM ({sql})")(run)


for _name, (_kind, _sql) in _SCALERS.items():
    _scaler(_name, _kind, _sql)


@twin(f"WITH {C_SQL}, {_windows_sql(14, 7)}, st AS ({_stats_sql('avg(y)', 'stddev_samp(y) + 1e-6')}) SELECT group_id, t, k, series_id, round((y - loc) / scale, 4) AS z, round(y, 4) AS y FROM win JOIN st USING (group_id, t, series_id)")
def n7_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.rolling_windows(events_daily(spark, d)["obs"], 14, 7)
    stats = scaling.scale_stats(rows, "standard")
    there = scaling.normalize(rows, stats).drop("y")
    return rounded(scaling.denormalize(there, stats).select("group_id", "t", "k", "series_id", "z", "y"))


# Parameters on domain A's last window: mu the value a year before, sigma and loadings shares of it.

_PARAMS_SQL = f"""WITH {A_SQL}, lim AS (SELECT max(t) + 1 AS s FROM cal),
par AS (SELECT group_id, 0 AS group_no, CAST(s - 6 AS INTEGER) AS t, h, series_id, node_idx AS series_no, o.y AS mu, 0.1 * o.y + 1 AS sigma, 0.05 * o.y AS f0, 0.02 * o.y * (node_idx % 3) AS f1, 0.5 + h AS lam, 5.0 + h AS nu
        FROM (SELECT unnest(range(6))::INTEGER AS h) CROSS JOIN lim JOIN obs o ON o.t = s - 6 + h - 12 JOIN nodes ON node_id = series_id)"""
N_DRAWS = 40


def _params(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    a = orders_seg(spark, d, keep=True)
    t = a["calendar"].count() - H
    own = a["obs"].where(F.col("t").between(t - LAG, t - LAG + H - 1)).join(a["series"], "series_id").withColumn("h", F.col("t") - (t - LAG))
    loadings = F.array(0.05 * F.col("y"), 0.02 * F.col("y") * (F.col("series_no") % 3))
    return a, own.select("group_id", F.lit(0).alias("group_no"), F.lit(t).alias("t"), "h", "series_id", "series_no", F.col("y").alias("mu"), (0.1 * F.col("y") + 1).alias("sigma"), loadings.alias("loadings"))


def _draw_sql(streams: list[int], extra: str = "") -> str:
    rows = hash_sql(hash_sql(f"SELECT par.*, i FROM par CROSS JOIN (SELECT unnest(range({N_DRAWS}))::INTEGER AS i)", "shared", ["7", "group_no", "t", "h", "i"], "0"), "own", ["series_no"], "shared")
    for j in range(2):
        rows = normal_sql(rows, f"e{j}", "shared", 100 + j)
    for s in streams:
        rows = normal_sql(rows, f"z{s}", "own", s)
    return f"SELECT *, f0 * e0 + f1 * e1 AS f{extra} FROM ({rows})"


_FACTOR_SQL = f"{_PARAMS_SQL}, smp AS (SELECT group_id, t, h, series_id, i, mu + sigma * z0 + f AS y FROM ({_draw_sql([0])}))"
_NODE_SQL = f"{_FACTOR_SQL}, nsm AS (SELECT group_id, t, h, i, node_id, sum(greatest(y, 0)) AS y FROM smp JOIN edges USING (series_id) GROUP BY ALL), tru AS (SELECT group_id, CAST(s - 6 AS INTEGER) AS t, CAST(agg.t - (s - 6) AS INTEGER) AS h, node_id, y AS truth FROM agg CROSS JOIN lim WHERE agg.t >= s - 6)"


@twin(f"{_FACTOR_SQL} SELECT group_id, t, h, series_id, i, round(y, 2) AS y FROM smp")
def d1_factor_draws(spark: SparkSession, d: str) -> DataFrame:
    _, params = _params(spark, d)
    return rounded(sampling.sample_factor(params, N_DRAWS, 7, 2), 2)


@twin(f"{_PARAMS_SQL}, q AS (SELECT *, lam / sqrt(1 + lam * lam) AS dl, greatest(1 - 2 / (9 * nu) + z2 * sqrt(2 / (9 * nu)), 1e-3) AS c0 FROM ({_draw_sql([0, 1, 2])})) SELECT group_id, t, h, series_id, i, round(mu + sigma * (dl * abs(z0) + sqrt(1 - dl * dl) * z1) / sqrt(greatest(nu * c0 * c0 * c0, 1e-6) / nu) + f, 2) AS y FROM q")
def d2_skew_t_draws(spark: SparkSession, d: str) -> DataFrame:
    _, params = _params(spark, d)
    params = params.withColumn("nu", 5.0 + F.col("h")).withColumn("lam", 0.5 + F.col("h"))
    return rounded(sampling.sample_skew_t(params, N_DRAWS, 7, 2), 2)


_GUMBEL = hash_sql(hash_sql(_draw_sql([0]), "g0", ["50"], "own"), "g1", ["51"], "own")


@twin(f"{_PARAMS_SQL}, g AS (SELECT *, ln(0.3::DOUBLE) - ln(-ln({uniform_sql('g0')})) > ln(0.7::DOUBLE) - ln(-ln({uniform_sql('g1')})) AS first_one FROM ({_GUMBEL})) SELECT group_id, t, h, series_id, i, round(CASE WHEN first_one THEN mu + sigma * z0 ELSE 2 * mu + 0.5 * sigma * z0 END + f, 2) AS y FROM g")
def d3_mixture_draws(spark: SparkSession, d: str) -> DataFrame:
    _, params = _params(spark, d)
    mixed = params.withColumn("mu_k", F.array("mu", 2 * F.col("mu"))).withColumn("sigma_k", F.array("sigma", 0.5 * F.col("sigma"))).withColumn("logits", F.array(F.log(F.lit(0.3)), F.log(F.lit(0.7)))).drop("mu", "sigma")
    return rounded(sampling.sample_mixture(mixed, N_DRAWS, 7, 2, 2), 2)


def _truth(spark: SparkSession, a: dict[str, DataFrame]) -> DataFrame:
    t = a["calendar"].count() - H
    at = spark.range(1).select(F.lit("").alias("group_id"), F.lit(t).alias("t"))
    return hierarchy.aggregate(forecast.targets(a["obs"], at, H), a["edges"], "truth", ("group_id", "t", "h"))


def _node_samples(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    a, params = _params(spark, d)
    return a, sampling.sample_coherent(params, a["edges"], N_DRAWS, 7, 2), _truth(spark, a)


@twin(f"{_NODE_SQL} SELECT group_id, t, h, i, node_id, round(y, 2) AS y FROM nsm")
def d4_coherent_draws(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_node_samples(spark, d)[1], 2)


def _node_arrays(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The draws of _node_samples as an array a cell, and their truth."""
    a, params = _params(spark, d)
    return packed.coherent_packed(params, a["edges"], N_DRAWS, 7, 2), _truth(spark, a)


@twin(f"{_NODE_SQL} SELECT group_id, t, h, i, node_id, round(y, 2) AS y FROM nsm")
def d4_packed_draws(spark: SparkSession, d: str) -> DataFrame:
    """The same draws by arrays, which are summed up element by element."""
    return rounded(packed.unpacked(_node_arrays(spark, d)[0]).select("group_id", "t", "h", "i", "node_id", "y"), 2)


@twin(f"WITH r AS ({normal_sql(hash_sql('SELECT o_orderkey, o_custkey FROM orders', 'x_', ['o_orderkey', 'o_custkey'], '11'), 'z', 'x_', 1)}) SELECT o_orderkey, o_custkey, round({uniform_sql('x_')}, 6) AS u, round(z, 6) AS z FROM r")
def d5_draws(spark: SparkSession, d: str) -> DataFrame:
    rows = draws.hashed(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "x", ["o_orderkey", "o_custkey"], 11)
    return rounded(draws.with_normal(rows, "z", "x", 1).select("o_orderkey", "o_custkey", draws.uniform("x").alias("u"), "z"), 6)


@twin("SELECT o_orderkey, round(ln(1 + exp(-abs(x))) + greatest(x, 0) + 1e-3, 6) AS soft, round(exp(least(x, 20)) + 1e-3, 4) AS expo, round(ln(1 + exp(-abs(x))) + greatest(x, 0) + 2, 6) AS nu FROM (SELECT o_orderkey, (o_totalprice - 150000) / 50000 AS x FROM orders)")
def d6_d7_links(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("o_totalprice") - 150000) / 50000
    return read(spark, d, "orders").select("o_orderkey", F.round(links.sigma_link(x), 6).alias("soft"), F.round(links.sigma_link(x, "exp"), 4).alias("expo"), F.round(links.nu_link(x), 6).alias("nu"))


@twin(f"{_PARAMS_SQL}, win AS (SELECT group_id, t, series_id FROM par GROUP BY ALL), st AS (SELECT p.group_id, CAST(s - 6 AS INTEGER) AS t, series_id, avg(y) AS loc, stddev_samp(y) + 1e-6 AS scale FROM obs p CROSS JOIN lim WHERE p.t >= s - 30 AND p.t < s - 6 GROUP BY ALL) SELECT group_id, t, h, series_id, round(mu / 1e6 * scale + loc, 2) AS mu, round(sigma / 1e6 * scale, 2) AS sigma, round(f0 / 1e6 * scale, 2) AS f0, round(f1 / 1e6 * scale, 2) AS f1 FROM par JOIN st USING (group_id, t, series_id)")
def n8_d8_denormalised_params(spark: SparkSession, d: str) -> DataFrame:
    a, params = _params(spark, d)
    t = a["calendar"].count() - H
    at = spark.range(1).select(F.lit("").alias("group_id"), F.lit(t).alias("t"))
    stats = scaling.scale_stats(windows.expand(a["obs"], at, SIZE, H), "standard")
    small = params.withColumns({"mu": F.col("mu") / 1e6, "sigma": F.col("sigma") / 1e6, "loadings": F.transform("loadings", lambda x: x / 1e6)})
    rows = scaling.denormalize_params(small, stats)
    return rounded(rows.select("group_id", "t", "h", "series_id", "mu", "sigma", F.get("loadings", F.lit(0)).alias("f0"), F.get("loadings", F.lit(1)).alias("f1")), 2)


# Scores

_GRID = "[" + ", ".join(f"{g}::DOUBLE" for g in scoring.quantile_grid()) + "]"
_QUANTILE_SQL = f"{_NODE_SQL}, qs AS (SELECT group_id, t, h, node_id, quantile_cont(y, {_GRID}) AS q, {_GRID} AS grid FROM nsm GROUP BY ALL), crp AS (SELECT group_id, t, h, node_id, truth, list_sum(list_transform(range(1, 100), lambda i: greatest(grid[i] * (truth - q[i]), (grid[i] - 1) * (truth - q[i])))) * 2 / 99 AS crps FROM qs JOIN tru USING (group_id, t, h, node_id))"
_MC_SQL = f"{_NODE_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY group_id, t, h, node_id ORDER BY y) AS k FROM nsm), crp AS (SELECT group_id, t, h, node_id, truth, avg(abs(y - truth)) - sum(y * (2 * k - {N_DRAWS} - 1)) / ({N_DRAWS} * ({N_DRAWS} - 1)) AS crps FROM rk JOIN tru USING (group_id, t, h, node_id) GROUP BY ALL)"


@twin(f"{_QUANTILE_SQL} SELECT group_id, t, h, node_id, round(truth, 2) AS truth, round(crps, 2) AS crps FROM crp")
def m2_crps_quantile(spark: SparkSession, d: str) -> DataFrame:
    _, drawn, truth = _node_samples(spark, d)
    return rounded(scoring.crps_quantile(drawn, truth), 2)


@twin(f"{_MC_SQL} SELECT group_id, t, h, node_id, round(truth, 2) AS truth, round(crps, 2) AS crps FROM crp")
def m3_crps_monte_carlo(spark: SparkSession, d: str) -> DataFrame:
    _, drawn, truth = _node_samples(spark, d)
    return rounded(scoring.crps_mc(drawn, truth), 2)


@twin(f"{_QUANTILE_SQL} SELECT group_id, t, h, node_id, round(truth, 2) AS truth, round(crps, 2) AS crps FROM crp")
def m2_packed_quantile(spark: SparkSession, d: str) -> DataFrame:
    """From arrays: each is sorted once for all quantiles."""
    return rounded(scoring.crps_quantile(*_node_arrays(spark, d)), 2)


@twin(f"{_MC_SQL} SELECT group_id, t, h, node_id, round(truth, 2) AS truth, round(crps, 2) AS crps FROM crp")
def m3_packed_monte_carlo(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.crps_mc(*_node_arrays(spark, d)), 2)


@twin(f"{_NODE_SQL} SELECT a.group_id, a.t, a.h, a.node_id, count(DISTINCT a.i) AS n, round(avg(abs(a.y - b.y)), 2) AS spread FROM nsm a JOIN nsm b ON a.h = b.h AND a.node_id = b.node_id AND a.i <> b.i GROUP BY ALL")
def m4_pairwise_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.pairwise_abs_mean(_node_samples(spark, d)[1]), 2)


@twin(f"{_MC_SQL} SELECT round(sum(crps), 1) AS crps FROM crp")
def m6_crps_objective(spark: SparkSession, d: str) -> DataFrame:
    _, drawn, truth = _node_samples(spark, d)
    return rounded(scoring.crps_objective(drawn, truth, "sum"), 1)


_ENERGY_SQL = f"{_NODE_SQL}, near AS (SELECT group_id, t, avg(x) AS near FROM (SELECT group_id, t, i, pow(sum((y - truth) * (y - truth)), @beta / 2) AS x FROM nsm JOIN tru USING (group_id, t, h, node_id) GROUP BY ALL) GROUP BY ALL), apart AS (SELECT group_id, t, sum(x) AS apart FROM (SELECT a.group_id, a.t, a.i, b.i AS j, pow(sum((a.y - b.y) * (a.y - b.y)), @beta / 2) AS x FROM nsm a JOIN nsm b ON a.group_id = b.group_id AND a.t = b.t AND a.h = b.h AND a.node_id = b.node_id AND a.i < b.i GROUP BY ALL) GROUP BY ALL) SELECT group_id, t, round(near - apart / ({N_DRAWS} * ({N_DRAWS} - 1)), 1) AS score FROM near JOIN apart USING (group_id, t)"


@twin(_ENERGY_SQL.replace("@beta", "1.0::DOUBLE"))
def m7_energy_score(spark: SparkSession, d: str) -> DataFrame:
    """From all samples that the other scores take."""
    _, drawn, truth = _node_samples(spark, d)
    return rounded(scoring.energy_score(drawn, truth), 1)


@twin(_ENERGY_SQL.replace("@beta", "0.5::DOUBLE"))
def m7_energy_score_all(spark: SparkSession, d: str) -> DataFrame:
    """The same with distances to the power one half."""
    _, drawn, truth = _node_samples(spark, d)
    return rounded(scoring.energy_score(drawn, truth, beta=0.5), 1)


@twin("WITH x AS (SELECT o_orderkey, o_totalprice / 1e4 AS y, (o_custkey % 30) + 1.0 AS mu, (o_custkey % 7) + 0.5 AS sigma FROM orders), z AS (SELECT *, (y - mu) / sigma AS z, 1 / (1 + 0.3275911 * (abs((y - mu) / sigma) / 1.4142135623730951)) AS k FROM x), c AS (SELECT *, k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-z * z / 2) / 2 AS tail FROM z) SELECT o_orderkey, round(sigma * (z * (2 * (CASE WHEN z >= 0 THEN 1 - tail ELSE tail END) - 1) + 2 * exp(-z * z / 2) / 2.5066282746310002 - 0.5641895835477563), 6) AS crps FROM c")
def m8_gaussian_crps(spark: SparkSession, d: str) -> DataFrame:
    mu, sigma = (F.col("o_custkey") % 30) + 1.0, (F.col("o_custkey") % 7) + 0.5
    return read(spark, d, "orders").select("o_orderkey", F.round(scoring.gaussian_crps(mu, sigma, F.col("o_totalprice") / 1e4), 6).alias("crps"))


@twin(f"{_QUANTILE_SQL} SELECT round(sum(crps), 1) AS crps_sum, round(sum(abs(truth)), 1) AS abs_sum, round(sum(crps) / sum(abs(truth)), 6) AS scrps FROM crp JOIN nodes USING (node_id) WHERE level = 'Region'")
def m9_scrps_of_level(spark: SparkSession, d: str) -> DataFrame:
    a, drawn, truth = _node_samples(spark, d)
    rows = scoring.crps_quantile(drawn, truth).join(hierarchy.level_mask(a["nodes"], "Region").select("node_id"), "node_id", "left_semi")
    made = scoring.scrps(rows)
    return made.select(F.round("crps_sum", 1).alias("crps_sum"), F.round("abs_sum", 1).alias("abs_sum"), F.round("scrps", 6).alias("scrps"))


@twin(f"{_QUANTILE_SQL} SELECT coalesce(level, 'Overall') AS level, round(sum(crps), 1) AS crps_sum, round(sum(abs(truth)), 1) AS abs_sum, round(sum(crps) / sum(abs(truth)), 6) AS scrps FROM crp JOIN nodes USING (node_id) GROUP BY GROUPING SETS ((level), ())")
def m10_scrps_by_level(spark: SparkSession, d: str) -> DataFrame:
    a, drawn, truth = _node_samples(spark, d)
    made = scoring.scrps_by_level(scoring.crps_quantile(drawn, truth), a["nodes"])
    return made.select("level", F.round("crps_sum", 1).alias("crps_sum"), F.round("abs_sum", 1).alias("abs_sum"), F.round("scrps", 6).alias("scrps"))


@twin(f"{_MC_SQL} SELECT round(sum(crps) / greatest(sum(abs(truth)), 1e-8), 6) AS scrps FROM crp")
def m12_validation(spark: SparkSession, d: str) -> DataFrame:
    _, drawn, truth = _node_samples(spark, d)
    return rounded(scoring.validation_scrps(drawn, truth), 6)


@twin(f"{_QUANTILE_SQL} SELECT round(sum(part), 6) AS loss FROM (SELECT sum(crps) / greatest(sum(abs(truth)), 1e-8) AS part FROM crp GROUP BY group_id, node_id)")
def m13_objective_by_series(spark: SparkSession, d: str) -> DataFrame:
    _, drawn, truth = _node_samples(spark, d)
    return rounded(scoring.scaled_objective(scoring.crps_quantile(drawn, truth), "series"), 6)


# Forecasters and runs


def _b_run(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    b = parts_panel(spark, d, keep=("y",))
    split = windows.panel_split(b["groups"], b["calendar"], SIZE, H, H, H)
    return b, split.where("split = 'train'").select("group_id", "t"), split.where("split = 'test'").select("group_id", "t")


_R1_SQL = f"""WITH {B_SQL}, lim AS (SELECT max(t) + 1 AS s FROM cal), anc AS (SELECT group_id, series_id, t, y, coalesce(lag(y, 12) OVER w, first_value(y) OVER w) AS mu FROM obs WINDOW w AS (PARTITION BY group_id, series_id ORDER BY t)),
spread AS (SELECT a.group_id, series_id, h, stddev_samp(y - mu) AS sigma FROM anc a JOIN (SELECT cal.t, h, cal.t + h AS idx FROM cal CROSS JOIN lim CROSS JOIN (SELECT unnest(range(6))::INTEGER AS h) WHERE t >= 24 AND t <= s - 12 - 6) w ON a.t = w.idx GROUP BY ALL)"""


@twin(f"{_R1_SQL} SELECT a.group_id, CAST(s - 6 AS INTEGER) AS t, h, series_id, mu, round(sigma, 4) AS sigma FROM anc a CROSS JOIN lim JOIN spread USING (group_id, series_id) WHERE a.t = s - 6 + h")
def r1_seasonal_naive(spark: SparkSession, d: str) -> DataFrame:
    b, train, test = _b_run(spark, d)
    return rounded(forecast.seasonal_naive(b["obs"], train, test, LAG, H).drop("loadings"))


def _pooled(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    a = orders_seg(spark, d, keep=True)
    split = windows.last_h_split(a["calendar"], SIZE, H)
    blocks = features.build_features([("future_shared", features.month_dummies(a["calendar"]))])
    rows = design.design(a["obs"], split.where("split = 'train'"), SIZE, H, "mean_floor", design.prepared(blocks))
    return a, forecast.predict_pooled(forecast.fit_pooled(rows), rows)


@twin()
def r2_pooled_regression(spark: SparkSession, d: str) -> DataFrame:
    return _pooled(spark, d)[1].groupBy("h").agg(F.round(F.avg(F.pow(F.col("label") - F.col("prediction"), 2.0)), 4).alias("mse"), F.count("*").alias("n"))


@twin()
def r3_factor_spread(spark: SparkSession, d: str) -> DataFrame:
    a, fitted = _pooled(spark, d)
    residuals = fitted.select(*forecast.STEP, (F.col("label") - F.col("prediction")).alias("r"))
    return heads.factor_spread(residuals, 2)


@twin()
def r4_mixture(spark: SparkSession, d: str) -> DataFrame:
    residuals = _pooled(spark, d)[1].select((F.col("label") - F.col("prediction")).alias("r"))
    mu, sigma, logits = heads.mixture_of(residuals, 2)
    return spark.createDataFrame(list(zip(range(2), mu, sigma, logits, strict=True)), "component int, mu double, sigma double, logit double")


@twin()
def r5_skew_t(spark: SparkSession, d: str) -> DataFrame:
    return heads.skew_t_of(_pooled(spark, d)[1].select((F.col("label") - F.col("prediction")).alias("r")))


@twin(
    f"""WITH {A_SQL}, r AS (SELECT y - coalesce(lag(y, 12) OVER w, first_value(y) OVER w) AS r FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)), c AS (SELECT r - (SELECT avg(r) FROM r) AS x FROM r),
m AS (SELECT avg(x * x * x) / pow(avg(x * x), 1.5) AS s, avg(x * x * x * x) / pow(avg(x * x), 2) - 3 AS e FROM c), p AS (SELECT *, pow(least(abs(s), 0.99), 2.0 / 3) AS size FROM m),
d AS (SELECT *, sqrt(pi() / 2 * size / (size + pow((4 - pi()) / 2, 2.0 / 3))) AS d FROM p)
SELECT round(CASE WHEN e > 0 THEN least(4 + 6 / e, 200.0) ELSE 200.0 END, 6)::DOUBLE AS nu, round(sign(s) * d / sqrt(1 - d * d), 6) AS lam FROM d"""
)
def r5_skew_t_moments(spark: SparkSession, d: str) -> DataFrame:
    """nu and lam of the seasonal naive residuals of all series and steps, by moments."""
    obs = orders_seg(spark, d)["obs"]
    anchored = features.seasonal_naive_anchor(obs, [LAG], H).join(obs, ["group_id", "series_id", "t"])
    return rounded(heads.skew_t_of(anchored.select((F.col("y") - F.col(f"anchor_{LAG}")).alias("r"))), 6)


@twin(f"{_R1_SQL}, c AS (SELECT 'lag ' || lag_ AS candidate, avg(abs(o.y - p.y)) / avg(abs(o.y)) AS scrps FROM (SELECT unnest([6, 12, 24]) AS lag_) CROSS JOIN obs o JOIN obs p ON p.group_id = o.group_id AND p.series_id = o.series_id AND p.t = o.t - lag_ WHERE o.t >= 24 GROUP BY ALL) SELECT candidate, round(scrps, 6) AS scrps FROM c ORDER BY c.scrps LIMIT 1")
def r6_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    obs = parts_panel(spark, d)["obs"]
    lags = F.explode(F.array(*map(F.lit, (6, 12, 24)))).alias("lag")
    old = obs.select("group_id", "series_id", "t", F.col("y").alias("p"), lags).withColumn("t", F.col("t") + F.col("lag"))
    pairs = obs.where("t >= 24").join(old, ["group_id", "series_id", "t"])
    scores = pairs.groupBy(F.concat(F.lit("lag "), "lag").alias("candidate")).agg((F.avg(F.abs(F.col("y") - F.col("p"))) / F.avg(F.abs("y"))).alias("scrps"))
    return rounded(forecast.best_candidate(scores), 6)


@twin(f"WITH {C_SQL}, {_windows_sql(14, 7)} SELECT group_id, t, series_id, h, round(avg(y), 4) AS mu, round(stddev_samp(y), 4) AS sigma FROM win CROSS JOIN (SELECT unnest(range(7))::INTEGER AS h) WHERE k < 0 GROUP BY ALL")
def r7_own_model(spark: SparkSession, d: str) -> DataFrame:
    """A user's model: mean and deviation of the history, for all horizons."""

    def model(rows):
        import pandas as pd

        past = rows[rows["k"] < 0].groupby(["group_id", "t", "series_id"])["y"].agg(["mean", "std"]).reset_index()
        return pd.concat([past.assign(h=h) for h in range(7)])[["group_id", "t", "series_id", "h", "mean", "std"]].set_axis(["group_id", "t", "series_id", "h", "mu", "sigma"], axis=1)

    rows = windows.rolling_windows(events_daily(spark, d)["obs"], 14, 7)
    return rounded(forecast.own_model(rows, model, "group_id string, t int, series_id string, h int, mu double, sigma double"))


@twin()
def r8_r10_run_with_seeds(spark: SparkSession, d: str) -> DataFrame:
    """All kinds of candidates; the pooled ones see each series' region and segment, the month and last year's value."""
    a = orders_seg(spark, d, keep=True)
    blocks = features.build_features([("static", features.grouped_static_dummies(a["series"], ["region", "segment"])), ("future_shared", features.month_dummies(a["calendar"])), ("future_series", features.seasonal_naive_anchor(a["obs"], [LAG], H))])
    return forecast.run(a, SIZE, H, LAG, [0, 1, 2], n=30, candidates=("naive", "pooled", "mixture", "skew_t"), blocks=blocks)


@twin()
def r9_m11_run_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel run; the pooled fit sees each nation, the month, last year's value and past promotions."""
    b = parts_panel(spark, d, keep=("y", "promo"))
    promo = panel.densify(b["facts"], b["groups"], b["bottom"], b["calendar"], "promo").select("group_id", "series_id", "t", "promo")
    blocks = features.build_features([("static", features.identity_dummies(b["bottom"])), ("future_shared", features.month_dummies(b["calendar"])), ("future_series", features.seasonal_naive_anchor(b["obs"], [LAG], H)), ("hist", promo)])
    return forecast.run_panel(b, SIZE, H, LAG, [0, 1, 2], n=30, blocks=blocks, packed=True)


def _naive_sql(domain: str, groups: str, n: int, seeds: str) -> str:
    """Samples of all nodes (nsm) and their truth (tru) for the test window, drawn around the seasonal naive forecast."""
    drawn = hash_sql(hash_sql(f"SELECT par.*, i, seed FROM par CROSS JOIN (SELECT unnest(range({n}))::INTEGER AS i) CROSS JOIN (SELECT unnest({seeds})::INTEGER AS seed)", "shared", ["seed", "group_no", "t", "h", "i"], "0"), "own", ["series_no"], "shared")
    return f"""{_R1_SQL.replace(B_SQL, domain)}, gno AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS group_no FROM {groups}),
par AS (SELECT a.group_id, group_no, CAST(s - 6 AS INTEGER) AS t, h, a.series_id, node_idx AS series_no, mu, coalesce(sigma, 0) AS sigma FROM anc a CROSS JOIN lim JOIN spread USING (group_id, series_id) JOIN gno USING (group_id) JOIN nodes ON node_id = a.series_id WHERE a.t = s - 6 + h),
nsm AS (SELECT seed, group_id, t, h, i, node_id, sum(greatest(mu + sigma * z0, 0)) AS y FROM ({normal_sql(drawn, "z0", "own", 0)}) JOIN edges USING (series_id) GROUP BY ALL),
tru AS (SELECT group_id, CAST(s - 6 AS INTEGER) AS t, CAST(obs.t - (s - 6) AS INTEGER) AS h, node_id, sum(y) AS truth FROM obs CROSS JOIN lim JOIN edges USING (series_id) WHERE obs.t >= s - 6 GROUP BY ALL)"""


def _scores_sql(samples: str) -> str:
    return f"""{samples}, qs AS (SELECT seed, group_id, t, h, node_id, quantile_cont(y, {_GRID}) AS q, {_GRID} AS grid FROM nsm GROUP BY ALL),
crp AS (SELECT seed, node_id, truth, list_sum(list_transform(range(1, 100), lambda i: greatest(grid[i] * (truth - q[i]), (grid[i] - 1) * (truth - q[i])))) * 2 / 99 AS crps FROM qs JOIN tru USING (group_id, t, h, node_id))
SELECT seed, coalesce(level, 'Overall') AS level, round(sum(crps), 1) AS crps_sum, round(sum(abs(truth)), 1) AS abs_sum, round(sum(crps) / sum(abs(truth)), 6) AS scrps, 'naive' AS candidate FROM crp JOIN nodes USING (node_id) GROUP BY GROUPING SETS ((seed, level), (seed))"""


_NAIVE_A, _NAIVE_B = (_naive_sql(sql, groups, 30, "[0, 1, 2]") for sql, groups in ((A_SQL, "(SELECT '' AS group_id)"), (B_SQL, "grp")))


def _by_seed(rows: DataFrame) -> DataFrame:
    return rows.select("seed", "level", F.round("crps_sum", 1).alias("crps_sum"), F.round("abs_sum", 1).alias("abs_sum"), F.round("scrps", 6).alias("scrps"), "candidate")


@twin(_scores_sql(_NAIVE_A))
def r8_r10_run_naive(spark: SparkSession, d: str) -> DataFrame:
    """The run of one hierarchy with the one candidate that SQL can state."""
    return _by_seed(forecast.run(orders_seg(spark, d, keep=True), SIZE, H, LAG, [0, 1, 2], n=30, candidates=("naive",)))


@twin(_scores_sql(_NAIVE_B))
def r9_m11_run_panel_naive(spark: SparkSession, d: str) -> DataFrame:
    """The panel run with the one candidate that SQL can state."""
    return _by_seed(forecast.run_panel(parts_panel(spark, d, keep=("y",)), SIZE, H, LAG, [0, 1, 2], n=30, candidates=("naive",)))


@twin(_scores_sql(_NAIVE_B))
def r9_packed_run_naive(spark: SparkSession, d: str) -> DataFrame:
    """The same with draws as arrays."""
    return _by_seed(forecast.run_panel(parts_panel(spark, d, keep=("y",)), SIZE, H, LAG, [0, 1, 2], n=30, candidates=("naive",), packed=True))


@twin(f"{_NAIVE_B} SELECT seed, group_id, t, h, i, node_id, round(y, 3) AS y FROM nsm")
def d8_forecast_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of all nodes, in raw units, for the test window of each group."""
    b, train, test = _b_run(spark, d)
    bottom = b["nodes"].where("is_bottom").select(F.col("node_id").alias("series_id"), F.col("node_idx").alias("series_no"))
    groups = b["groups"].select("group_id").withColumn("group_no", F.row_number().over(Window.orderBy("group_id")) - 1)  # a row a group
    params = forecast.numbered(forecast.seasonal_naive(b["obs"], train, test, LAG, H), bottom, groups)
    seeds = spark.createDataFrame([(0,), (1,), (2,)], "seed int")
    return rounded(sampling.sample_coherent(params.crossJoin(F.broadcast(seeds)), b["edges"], 30, "seed", 0), 3)


@twin(f"WITH {C_SQL}, {_windows_sql(14, 7)} SELECT group_id, t, series_id, h, round(avg(y), 4) AS mu, round(stddev_samp(y), 4) AS sigma FROM win CROSS JOIN (SELECT unnest(range(7))::INTEGER AS h) WHERE k < 0 GROUP BY ALL")
def r7_own_model_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same model as r7_own_model, given many windows at once."""

    def model(frame):
        import numpy as np

        past = np.stack(frame["past"].to_numpy())
        own = frame[["group_id", "t", "series_id"]].assign(mu=past.mean(axis=1), sigma=past.std(axis=1, ddof=1))
        return own.loc[own.index.repeat(7)].assign(h=np.tile(np.arange(7), len(own)))[["group_id", "t", "series_id", "h", "mu", "sigma"]]

    c = events_daily(spark, d)
    at = c["calendar"].select(F.lit("").alias("group_id"), "t")
    return rounded(forecast.own_model_batches(c["obs"], at, 14, 7, model, "group_id string, t int, series_id string, h int, mu double, sigma double"))


@twin(f"WITH {A_SQL}, o AS (SELECT series_id, t, y, coalesce(lag(y, 12) OVER w, first_value(y) OVER w) AS anchor_12 FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)), st AS (SELECT w.t, o.series_id, avg(y) AS loc, stddev_samp(y) + 1e-6 AS scale FROM cal w JOIN o ON o.t >= w.t - 24 AND o.t < w.t GROUP BY ALL) SELECT w.t, h, o.series_id, round((anchor_12 - loc) / scale, 4) AS anchor, round((y - loc) / scale, 4) AS label, CAST(month(w.ds + to_months(h)) AS INTEGER) AS month, split_part(o.series_id, '-', 1) AS region FROM cal w CROSS JOIN (SELECT unnest(range(6))::INTEGER AS h) JOIN o ON o.t = w.t + h JOIN st ON st.t = w.t AND st.series_id = o.series_id WHERE w.t >= 24 AND w.t <= (SELECT max(t) + 1 - 6 FROM cal)")
def f12_design_rows(spark: SparkSession, d: str) -> DataFrame:
    """Design vectors of all windows, read back: the rescaled anchor, the month and the region that each holds, and the label."""
    a = orders_seg(spark, d)
    blocks = features.build_features([("static", features.grouped_static_dummies(a["series"], ["region"])), ("future_shared", features.month_dummies(a["calendar"])), ("future_series", features.seasonal_naive_anchor(a["obs"], [LAG], H))])
    rows = design.design(a["obs"], a["calendar"].select(F.lit("").alias("group_id"), "t"), SIZE, H, "standard", design.prepared(blocks))
    v = vector_to_array("features")
    at = SIZE + H
    names = [r["region"] for r in a["bottom"].select("region").distinct().orderBy("region").collect()]
    region = F.element_at(F.array(*map(F.lit, names)), F.array_position(F.slice(v, at + 14, len(names)), F.lit(1.0)).cast("int"))
    return rows.select("t", "h", "series_id", F.round(v[at + 12], 4).alias("anchor"), F.round("label", 4).alias("label"), F.array_position(F.slice(v, at + 1, 12), F.lit(1.0)).cast("int").alias("month"), region.alias("region"))


_BY_NATION = "SELECT r_name AS level, o_orderkey % 5 AS seed, avg(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE / 1e6 AS scrps FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    """Scores by level and seed, made of orders."""
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("level"), (F.col("o_orderkey") % 5).alias("seed")).agg((panel.money("o_totalprice") / F.count("*") / 1e6).alias("scrps"))


@twin(f"SELECT level, round(avg(scrps), 6) AS mean, round(stddev_pop(scrps), 6) AS std, count(*) AS n FROM ({_BY_NATION}) GROUP BY level")
def m14_results_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.results_table(_seeded(spark, d)), 6)


@twin(f"SELECT level, round(avg(scrps), 6) AS mean, round(stddev_pop(scrps), 6) AS std FROM ({_BY_NATION}) GROUP BY level")
def s11_written_results(spark: SparkSession, d: str) -> DataFrame:
    """The summary of scores, written as CSV and read again."""
    table, _ = panel_source.write_results(_seeded(spark, d), scratch(spark, "results"))
    return rounded(spark.read.csv(table, header=True, inferSchema=True).select("level", "mean", "std"), 6)


@twin(f"WITH s AS ({_BY_NATION}) SELECT 'all' AS dataset, level, round(avg(scrps), 6) AS mean, count(*) AS n FROM s GROUP BY level UNION ALL SELECT 'even', level, round(avg(scrps), 6), count(*) FROM s WHERE seed % 2 = 0 GROUP BY level")
def m15_combined_table(spark: SparkSession, d: str) -> DataFrame:
    scores = _seeded(spark, d)
    both = scoring.combined_table({"all": scoring.results_table(scores), "even": scoring.results_table(scores.where("seed % 2 = 0"))})
    return rounded(both.select("dataset", "level", "mean", "n"), 6)
