"""Built panels as folders of Parquet tables, and results as CSV and JSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.scoring import results_table

TABLES = ("obs", "nodes", "edges", "calendar")
#: How obs was written; buckets 0: by bands.
LAYOUT = "buckets int, cluster array<string>, columns string"


def write_panel(tables: dict[str, DataFrame], folder: str, bands: int = 64, buckets: int | None = None, cluster: tuple[str, ...] = ("group_id", "series_id")) -> None:
    """obs is laid out by bands of group_id, so that reads of some groups open few files; the other tables are small.

    With buckets, obs is a bucketed table instead, one sorted file a bucket of the columns of cluster, and ``read_panel`` opens it as such: what is
    grouped, windowed or joined by those columns is not shuffled again. A bucket is read by one task, so their number grows with
    obs, and cluster should name no column alone one of whose values holds a large share of the rows: hence the series by default.
    """
    for name, df in tables.items():
        path = f"{folder}/{name}"
        if name == "obs" and buckets:
            table = _table(path)
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
            rows = df.repartition(buckets, *cluster).write.mode("overwrite").format("parquet").bucketBy(buckets, *cluster)
            rows.sortBy(*dict.fromkeys((*cluster, "t"))).option("path", path).saveAsTable(table)
        elif name == "obs":
            banded = df.withColumn("band", F.pmod(F.crc32(F.col("group_id").cast("binary")), F.lit(bands)).cast("int"))
            banded.repartition("band", "group_id").sortWithinPartitions("group_id", "series_id", "t").write.mode("overwrite").partitionBy("band").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)
    if "obs" in tables:
        spark = tables["obs"].sparkSession
        spark.createDataFrame([(buckets or 0, list(cluster), tables["obs"].schema.json())], LAYOUT).coalesce(1).write.mode("overwrite").json(f"{folder}/layout")


def _table(path: str) -> str:
    """The name by which a session's catalog knows the bucketed table at path."""
    return f"panel_{hashlib.md5(path.encode()).hexdigest()}"


def _quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_panel(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables of a built panel; the missing ones are named in the error. A bucketed obs is entered in the session's catalog, in any session."""
    if missing := [t for t in tables if not _exists(spark, f"{folder}/{t}")]:
        raise FileNotFoundError(f"{folder} lacks {missing}")
    known = spark.read.schema(LAYOUT).json(f"{folder}/layout").first() if "obs" in tables and _exists(spark, f"{folder}/layout") else None
    found = {t: spark.read.parquet(f"{folder}/{t}").drop("band") for t in tables if t != "obs" or not (known and known["buckets"])}
    if known and known["buckets"]:
        path, cluster = f"{folder}/obs", known["cluster"]
        table, at = _table(path), path.replace("\\", "\\\\").replace("'", "\\'")
        columns, by, order = (", ".join(x) for x in ((f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(known["columns"]))), map(_quoted, cluster), map(_quoted, dict.fromkeys((*cluster, "t")))))
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {known['buckets']} BUCKETS LOCATION '{at}'")
        found["obs"] = spark.table(table)
    return found


def write_results(scores: DataFrame, folder: str) -> tuple[str, str]:
    """One CSV of mean and deviation for each level, and JSON files by seed. scores: seed, level, scrps."""
    table, by_seed = f"{folder}/summary", f"{folder}/by_seed"
    results_table(scores).orderBy("level").coalesce(1).write.mode("overwrite").csv(table, header=True)  # a row a level
    scores.write.mode("overwrite").partitionBy("seed").json(by_seed)
    return table, by_seed
