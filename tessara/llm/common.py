"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class body.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Characters that end a word when words are letters, digits and non-ASCII characters.
BREAK = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


#: Spark's setting by which a finished query's shuffle files are removed at once and not with the driver's next garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def no_gc() -> Iterator[None]:
    """Without the collector of cycles, which slows tables of many strings down; what a task leaves is collected at its end."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows some at a time, so that a task turns only these into Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where in it a new key begins. numpy's own unique() takes a stable sort or a hash table, which cost three times and more."""
    order = np.argsort(keys)
    return order, begins(keys[order])


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, ascending."""
    keys = np.sort(keys)
    return keys[begins(keys)]


def begins(ascending: np.ndarray) -> np.ndarray:
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return new


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir).

    Only on one machine without that setting, as in tests, a temporary folder is set; a cluster without it raises.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        conf = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if "://" not in conf and not conf.startswith("file:"):  # as Spark takes it: in the cluster's default file system, which Python's readers can't know
        where = spark._jvm.org.apache.hadoop.fs.Path(conf)
        conf = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(conf)
    return f"{conf.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and so do the shuffle files that it took."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def remainder(n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def text_words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def text_key() -> Column:
    """A digest of the whole text, null for a null one: with doc_id it tells rows apart that share an id or have none."""
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key")


def named(*columns: str) -> list[Column]:
    """Columns by their whole names, which may hold dots or backticks."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


#: Bits of the bitmap by which rows that certainly stay are told without a shuffle: MOST of them are 64 MB in each task.
LEAST, MOST = 1 << 15, 1 << 29


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text_key are not in keys.

    Texts are not shuffled to find that out: each task gets a bitmap with the hashes of keys (16 bits a key, MOST at most), and a row
    whose bit is not set stays where it is. The others, nearly all of them to be removed, meet the keys exactly.
    """
    gone = keys.select(F.col("doc_id").alias("_gone_doc_id"), F.col("text_key").alias("_gone_text_key")).distinct()
    wanted = 16 * gone.count()
    bits = LEAST
    while bits < min(wanted, MOST):
        bits *= 2

    def place(*key: Column) -> Column:
        return F.xxhash64(*key).bitwiseAND(F.lit(bits - 1))

    at = place(F.col("_gone_doc_id"), F.col("_gone_text_key"))
    maps = gone.groupBy(F.shiftright(at, 15).alias("_block")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(LEAST - 1))).alias("_bits"))
    rows = docs.withColumn("_at", place(F.col("doc_id"), text_key())).join(F.broadcast(maps), F.shiftright("_at", 15) == F.col("_block"), "left")
    inside = F.col("_at").bitwiseAND(F.lit(LEAST - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = F.col("_bits").isNotNull() & (F.expr("shiftright(_byte, _inside & 7) & 1") == 1)
    rows = rows.withColumns({"_inside": inside, "_byte": byte}).withColumn("_met", F.coalesce(met, F.lit(False))).drop("_at", "_block", "_bits", "_inside", "_byte")
    same = F.col("doc_id").eqNullSafe(F.col("_gone_doc_id")) & text_key().eqNullSafe(F.col("_gone_text_key"))
    return rows.where("NOT _met").drop("_met").union(rows.where("_met").drop("_met").join(gone, same, "left_anti"))


def by_text(docs: DataFrame, *columns: str | Column, key: str = "doc_id") -> DataFrame:
    """The key as text and the columns: whole numbers beside nulls would go through Python as floats and lose digits. typed() turns the key back."""
    return docs.select(F.col(key).cast("string").alias(key), *columns)


def typed(rows: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows with the key in the type that it has in docs."""
    return rows.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fits(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, and else as it is: Spark then shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def plain_words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case, as an array; a null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, f"[{BREAK}]+"), "")
