"""Single hierarchies from a pair of CSV files: a wide series table and an aggregation matrix."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checks import require_empty
from ..operators.panel import with_t


class Hierarchy(NamedTuple):
    obs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    calendar: DataFrame
    stored: DataFrame


def _wide(spark: SparkSession, path: str, first: T.StructField) -> tuple[DataFrame, list[str]]:
    """The file with its first column named and typed by first, all others double."""
    names = spark.read.csv(path, header=True).columns
    schema = T.StructType([first, *(T.StructField(n, T.DoubleType()) for n in names[1:])])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True), names[1:]


def _long(wide: DataFrame, key: str, names: list[str], name: str, value: str) -> DataFrame:
    return wide.unpivot([key], [F.col(f"`{n}`") for n in names], name, value)


def name_mismatches(data_names: list[str], rows: DataFrame) -> DataFrame:
    """node_id, in_data, in_matrix: where the names of the data's columns and the matrix's rows differ in place or at all. rows: node_id, node_idx."""
    own = rows.sparkSession.createDataFrame(list(enumerate(data_names)), "node_idx int, node_id string")
    both = own.select("node_id", F.col("node_idx").alias("in_data")).join(rows.select("node_id", F.col("node_idx").alias("in_matrix")), "node_id", "full")
    return both.where("NOT (in_data <=> in_matrix)")


def read_hierarchy(spark: SparkSession, data_csv: str, agg_csv: str, levels: list[tuple[str, int, int]], end_date: str | None = None) -> Hierarchy:
    """levels: (name, start, stop) over the matrix's rows. Dates after end_date are left out before t is given."""
    wide, columns = _wide(spark, data_csv, T.StructField("ds", T.DateType()))
    matrix, bottom = _wide(spark, agg_csv, T.StructField("node_id", T.StringType()))
    if end_date:
        wide = wide.where(F.col("ds") <= F.lit(end_date).cast("date"))
    order = [r["node_id"] for r in matrix.select("node_id").collect()]  # a matrix's rows: the hierarchy's nodes
    rows = spark.createDataFrame([(n, i, next((x for x, a, b in levels if a <= i < b), None), next((k for k, (_, a, b) in enumerate(levels) if a <= i < b), None), n in set(bottom)) for i, n in enumerate(order)], "node_id string, node_idx int, level string, level_idx int, is_bottom boolean")
    require_empty(name_mismatches(columns, rows), "names of data and matrix differ")
    edges = _long(matrix, "node_id", bottom, "series_id", "weight").where("weight <> 0")
    calendar = with_t(wide)
    long = _long(wide, "ds", columns, "node_id", "y").join(calendar, "ds").select(F.lit("").alias("group_id"), "node_id", "ds", "t", "y")
    below = long.join(rows.where("is_bottom").select("node_id"), "node_id", "left_semi").withColumnRenamed("node_id", "series_id")
    above = long.join(rows.where("NOT is_bottom").select("node_id"), "node_id", "left_semi")
    return Hierarchy(below.select("group_id", "series_id", "ds", "t", "y"), rows, edges, calendar, above.select("group_id", "t", "node_id", "y"))
