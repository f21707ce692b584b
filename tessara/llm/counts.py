"""Token counts of texts through a cache of digests.

The cache is a folder of Parquet files, ``version=<hex>/``: digest (SHA-256 of a text's normalised content) and n_tokens.
The version is a digest of the tokenizer's file and of the way contents are normalised, so counts of another tokenizer
never mix with it. ``count`` joins the texts' digests with the cache, encodes one text of each digest that is not there,
appends those counts, and reads all of them back.

Texts of one content are one before anything is shuffled (partial aggregation), so a copy in a third of all rows costs a text a
task. If few digests are missing, Spark tells them to the scan and only their texts move; else the distinct texts
move once. An append that fails leaves no files; two appends of one digest are harmless, as reading aggregates them.

Contents: for word tokenizers that drop white space and case (``bpe.WordBpe``) ASCII white space is trimmed and joined and A-Z
lowered, which changes no token; texts with "<|" (added tokens are found in the text as it is) or with
combining marks (which compose with some small letters only) stay as they are. For all other files the content is the text.

Words of such tokenizers are encoded by ``bpe.WordBpe``; other JSON files by the tokenizers library and .model files by
sentencepiece, all without begin, end or added special tokens, truncation or padding; special strings inside texts are what the library makes of them.

A null text counts as empty: no bytes, no tokens. Repeated rows give repeated rows; null ids stay; very long texts are encoded
whole, one at a time; an empty table gives no rows and appends nothing; ids keep their type and other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import LOWER, SPACE, SPACE_CHARS, UPPER, no_gc, stored

#: Goes into the version: raise it when contents or counts of a file would change.
FORMAT = 1
_CACHED = "digest binary, n_tokens long"


def drops_space_and_case(path: str) -> bool:
    """Whether the file is of the kind that bpe.WordBpe encodes."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    pieces = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    dropped = any(p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] for p in pieces)
    return bool([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and dropped and spec["model"].get("end_of_word_suffix"))


def content(text: Column, folded: bool) -> Column:
    """A text's normalised content; folded: white space and case of ASCII characters don't matter."""
    plain = F.coalesce(text, F.lit(""))
    if not folded:
        return plain
    same = F.translate(F.regexp_replace(F.btrim(plain, F.lit(SPACE_CHARS)), f"[{SPACE}]+", " "), UPPER, LOWER)
    return F.when(plain.rlike(r"<\||\p{M}"), plain).otherwise(same)


def version_of(path: str) -> str:
    """The cache's key for a tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\0{FORMAT} {drops_space_and_case(path)}".encode()).hexdigest()


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one version; no rows before the first append."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={version}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], _CACHED)
    rows = spark.read.schema(_CACHED).parquet(f"{cache}/version={version}")
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


@lru_cache(2)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of a batch of texts, one counter for all tasks of a worker."""
    if drops_space_and_case(path):
        words = bpe.coder(path, False)
        return lambda texts: [sum(words.ids[p].count(" ") for p in pieces) for pieces in words.batch(texts)]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    import tokenizers

    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda texts: [len(x.ids) for t in texts for x in library.encode_batch_fast([t], add_special_tokens=False)]


def _encode(rows: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens of rows (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_gc():
            for part, texts in bpe._batches(batches):
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(_counter(path)(texts), pa.int64())], names=["digest", "n_tokens"])

    return rows.select("digest", "text").mapInArrow(run, _CACHED)


def append_misses(docs: DataFrame, path: str, cache: str, digests: DataFrame | None = None) -> str:
    """Encodes one text of each content of docs that the cache has not, appends the counts and returns the version."""
    spark, version = docs.sparkSession, version_of(path)
    folded = drops_space_and_case(path)
    texts = docs.select(_digest(folded), F.coalesce("text", F.lit("")).alias("text"))
    digests = texts.select("digest") if digests is None else digests
    missing = stored(digests.select("digest").distinct().join(cached(spark, cache, version), "digest", "left_anti"), "token-misses")
    one_each = texts.groupBy("digest").agg(F.min("text").alias("text")).join(missing, "digest", "left_semi")
    _encode(one_each, path).write.mode("append").parquet(f"{cache}/version={version}")
    return version


def _digest(folded: bool) -> Column:
    return F.unhex(F.sha2(content(F.col("text"), folded).cast("binary"), 256)).alias("digest")


def count(docs: DataFrame, path: str, cache: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), n_tokens, over_limit (n_tokens > limit) of each row of docs (doc_id, text)."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    keys = stored(docs.select("doc_id", size, _digest(drops_space_and_case(path))), "token-keys")
    version = append_misses(docs, path, cache, keys)
    # Of a table of its own, so that both sides of the join are plain and Spark can split a digest with many rows.
    known = stored(cached(docs.sparkSession, cache, version).join(keys.select("digest").distinct(), "digest", "left_semi"), "token-counts")
    rows = keys.join(known, "digest")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def compact(spark: SparkSession, cache: str, version: str, into: str, files: int) -> None:
    """Writes a version of a cache to another folder as so many files, one row a digest: appends leave many small files."""
    cached(spark, cache, version).repartition(files, "digest").write.parquet(f"{into}/version={version}")
