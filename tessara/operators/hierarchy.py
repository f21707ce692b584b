"""Hierarchies: nodes and edges, aggregation, levels and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _name(attributes: list[str]) -> Column:
    if not attributes:
        return F.lit("Total")
    known = [F.when(F.col(a).isNull(), F.raise_error(F.lit(f"a null {a}")).cast("string")).otherwise(F.col(a).cast("string")) for a in attributes]
    return known[0] if len(known) == 1 else F.concat_ws("-", *(F.regexp_replace(a, r"([\\-])", r"\\$1") for a in known))


def build_hierarchy(bottom: DataFrame, levels: list[tuple[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of bottom (series_id and attributes). levels: (level, attributes) from the top down; no attributes: one node 'Total'.

    A node is named by its own attributes; the last level is the series themselves. Any set of attributes
    may be a level, so crossed hierarchies need nothing more. Of several attributes those with "-" or "\\" have these led by "\\"; a name
    that two levels share is led by its level and "=" above the bottom, so that no two nodes are one. A null attribute raises.
    """
    parts = []
    for k, (level, attributes) in enumerate(levels):
        name = _name(attributes)
        parts.append(bottom.select(name.alias("node_id"), "series_id", F.lit(level).alias("level"), F.lit(k).alias("level_idx"), F.lit(False).alias("is_bottom")))
    parts.append(bottom.select(F.col("series_id").alias("node_id"), "series_id", F.lit("Bottom").alias("level"), F.lit(len(levels)).alias("level_idx"), F.lit(True).alias("is_bottom")))
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.unionByName(p)
    shared = all_rows.select("node_id", "level_idx").distinct().groupBy("node_id").count().where("count > 1").select("node_id", F.lit(True).alias("shared"))
    led = F.when(F.col("shared") & ~F.col("is_bottom"), F.concat("level", F.lit("="), "node_id")).otherwise(F.col("node_id"))
    all_rows = all_rows.join(shared, "node_id", "left").withColumn("node_id", led).drop("shared")
    nodes = all_rows.select("node_id", "level", "level_idx", "is_bottom").distinct()
    nodes = nodes.withColumn("node_idx", (F.row_number().over(Window.orderBy("level_idx", "node_id")) - 1).cast("int"))
    return nodes.select("node_id", "node_idx", "level", "level_idx", "is_bottom"), all_rows.select("node_id", "series_id", F.lit(1.0).alias("weight")).distinct()


def aggregate_by_attributes(rows: DataFrame, keys: list[str], sets: list[list[str]], value: str = "y") -> DataFrame:
    """Sums for each set of attributes in one pass (grouping sets): keys, the attributes (null where rolled up), level_bits, value."""
    attributes = list(dict.fromkeys(a for s in sets for a in s))
    grouped = rows.groupingSets([[*keys, *s] for s in sets], *keys, *attributes)
    bits = sum(((F.grouping(a).cast("int") * (1 << i)) for i, a in enumerate(attributes)), F.lit(0))
    return grouped.agg(F.sum(value).alias(value), bits.alias("level_bits")).select(*keys, *attributes, "level_bits", value)


def check_identity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bottom nodes whose edges are not just their own with weight 1."""
    own = edges.groupBy("node_id").agg(F.count("*").alias("n"), F.max("weight").alias("weight"), F.max((F.col("node_id") == F.col("series_id")).cast("int")).alias("self"))
    bottom = nodes.where("is_bottom").join(own, "node_id", "left")
    return bottom.where("coalesce(n, 0) <> 1 OR weight <> 1 OR self <> 1").select("node_id", "n", "weight")


def aggregate(obs: DataFrame, edges: DataFrame, value: str = "y", keys: tuple[str, ...] = ("group_id", "t")) -> DataFrame:
    """keys, node_id, value: sums of the bottom series below each node."""
    return obs.join(edges, "series_id").groupBy(*keys, "node_id").agg(F.sum(F.col("weight") * F.col(value)).alias(value))


def coherent_aggregate(samples: DataFrame, edges: DataFrame, clip: bool = True, keys: tuple[str, ...] = ("group_id", "t", "h", "i")) -> DataFrame:
    """Samples (series_id, y) of all nodes: bottom draws are cut at 0 first, then summed."""
    y = F.greatest("y", F.lit(0.0)) if clip else F.col("y")
    return aggregate(samples.withColumn("y", y), edges, "y", keys)


def coherence_gaps(obs: DataFrame, edges: DataFrame, stored: DataFrame) -> DataFrame:
    """group_id, t, node_id, y (sum), stored, gap, for the nodes of stored (group_id, t, node_id, y)."""
    made = aggregate(obs, edges)
    return made.join(stored.withColumnRenamed("y", "stored"), ["group_id", "t", "node_id"]).withColumn("gap", F.abs(F.col("y") - F.col("stored")))


def verify_coherence(obs: DataFrame, edges: DataFrame, stored: DataFrame, atol: float = 1e-3, rtol: float = 1e-4) -> DataFrame:
    """The gaps that exceed atol + rtol * |stored|."""
    return coherence_gaps(obs, edges, stored).where(F.col("gap") > atol + rtol * F.abs("stored"))


def level_slices(nodes: DataFrame) -> DataFrame:
    """level, level_idx, start, stop over node_idx."""
    return nodes.groupBy("level", "level_idx").agg(F.min("node_idx").alias("start"), (F.max("node_idx") + 1).alias("stop"))


def validate_levels(levels: DataFrame, n_nodes: int) -> DataFrame:
    """Slices (level, level_idx, start, stop) that don't follow on each other, are empty, or don't end at n_nodes."""
    if levels.isEmpty():
        raise ValueError("no levels")
    by = Window.orderBy("level_idx")  # a row a level
    row = levels.withColumn("want", F.coalesce(F.lag("stop").over(by), F.lit(0))).withColumn("last", F.lead("stop").over(by).isNull())
    return row.where((F.col("start") != F.col("want")) | (F.col("stop") <= F.col("start")) | (F.col("last") & (F.col("stop") != n_nodes))).select("level", "start", "stop")


def level_mask(nodes: DataFrame, level: str) -> DataFrame:
    return nodes.where(F.col("level") == level)


def level_tags(nodes: DataFrame) -> DataFrame:
    """level, names: its nodes in order."""
    ordered = F.sort_array(F.collect_list(F.struct("node_idx", "node_id")))
    return nodes.groupBy("level").agg(F.transform(ordered, lambda x: x["node_id"]).alias("names"))


def levels_from_depth(nodes: DataFrame, sep: str) -> DataFrame:
    """node_id, node_idx, depth: how many separators its name has. A depth in two separate runs of node_idx raises."""
    rows = nodes.select("node_id", "node_idx", (F.size(F.split("node_id", f"\\Q{sep}\\E")) - 1).alias("depth"))
    opens = (F.col("depth") != F.lag("depth").over(Window.orderBy("node_idx"))).cast("int")
    split = rows.withColumn("opens", F.coalesce(opens, F.lit(1))).groupBy("depth").agg(F.sum("opens").alias("runs")).where("runs > 1")
    found = split.collect()
    if found:
        raise ValueError(f"depths in separate runs: {sorted(r['depth'] for r in found)}")
    return rows


def lift_history(normalised: DataFrame, edges: DataFrame) -> DataFrame:
    """Sums of normalised values z for all nodes: group_id, t, k, node_id, z."""
    return aggregate(normalised, edges, "z", ("group_id", "t", "k"))


def lift_historical(features: DataFrame, nodes: DataFrame, column: str, keys: tuple[str, ...] = ("group_id", "t")) -> DataFrame:
    """A bottom covariate for all nodes; nodes above the bottom get 0."""
    every = features.select(*keys).distinct().crossJoin(nodes.select("node_id"))
    own = features.select(*keys, F.col("series_id").alias("node_id"), column)
    return every.join(own, [*keys, "node_id"], "left").withColumn(column, F.coalesce(column, F.lit(0.0)))
