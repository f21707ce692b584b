"""Fact logs and dimensions with pinned types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the usual files of a store panel.
FACTS = "date DATE, store_nbr SMALLINT, item_nbr INT, unit_sales FLOAT, onpromotion BOOLEAN"
STORES = "store_nbr INT, city STRING, state STRING, type STRING, cluster INT"
ITEMS = "item_nbr INT, family STRING, class INT, perishable INT"
TRANSACTIONS = "date DATE, store_nbr INT, transactions INT"
PRICES = "store_id STRING, item_id STRING, wm_yr_wk INT, sell_price DOUBLE"


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header. Columns are matched by name, typed by schema (others as text), and pruned to columns."""
    wanted = {f.strip().split()[0]: f.strip().split()[1] for f in schema.split(",")}
    header = spark.read.csv(path, header=True).columns
    if missing := [c for c in (columns or wanted) if c not in header]:
        raise ValueError(f"{path} lacks {missing}")
    typed = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` {wanted.get(c, 'STRING')}" for c in header))
    return typed.select(*(columns or [c for c in header if c in wanted]))


def read_facts(spark: SparkSession, path: str, schema: str = FACTS, columns: list[str] | None = None) -> DataFrame:
    return read_csv(spark, path, schema, columns)


def preferred_path(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists in its file system."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(f"none of {paths}")


def unpivot_days(wide: DataFrame, id_cols: list[str], calendar: DataFrame, prefix: str = "d_") -> DataFrame:
    """id_cols, ds, t, y of columns d_1, d_2, ..; calendar: d, ds, t."""
    days = [c for c in wide.columns if c.startswith(prefix)]
    return wide.unpivot(id_cols, days, "d", "y").join(calendar.select("d", "ds", "t"), "d").select(*id_cols, "ds", "t", F.col("y").cast("double").alias("y"))
