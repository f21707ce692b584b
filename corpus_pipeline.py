"""The corpus pipeline: quality rules, language, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
``documents``; the last returns the kept documents' token ids. run() writes every stage's rows to the
shared folder and reads them again, so a lost executor costs at most one stage's work.

For all stages: a null text counts as an empty one; null ids stay null and tell no rows apart, so decisions go by id and text;
repeated rows are judged alike, and only near_copies leaves one of them; texts are taken whole, however long; an empty table gives an
empty one; further columns of any name and type pass through. In quality_rules and language_id empty texts go; in near_copies
texts without words are copies of none; ties between copies go to the smallest id, null last, then to the smallest digest of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.llm import bpe, decontaminate, jaccard, langid, quality
from tessara.llm.common import remainder, stored, table, text_key, tokenizer_path, without

#: Share of the code lengths' evidence that a language needs, and share of a document's words in benchmark passages from which it goes.
LEAST_SCORE, MOST_HIT = 0.5, 0.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of policy v1. The verdict is computed in each row: nothing is shuffled or read twice."""
    return docs.where(quality.kept("v1"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language told with LEAST_SCORE or more; languages are learned from three quarters of docs."""
    model = langid.fit(docs.where(remainder(4) != 2))
    return langid.keep(docs, model, LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that links of similarity 0.8 or more over five words join."""
    return jaccard.keep_one(docs, jaccard.join(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    rows = decontaminate.phrase_matches(docs.select("doc_id", "text", text_key()), table(spark, sf_dir, "benchmark"), keep=("text_key",))
    return without(docs, stored(rows.where(F.col("n_hit") > MOST_HIT * F.col("n_words")).select("doc_id", "text_key"), "contaminated"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of each document."""
    rows = bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("token_ids", token_ids)]
#: Tokens, code lengths and MinHash have no SQL form; tests/llm/test_pipeline.py has a brute-force twin of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
