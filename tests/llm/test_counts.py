import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tessara.llm import counts
from tessara.llm.common import shared_dir

WORDS, BYTES, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    "The  cat\tsat on\nthe mat.", "the cat sat on the mat.", " THE CAT SAT ON THE MAT. ", "", None, "   \n", "J̌ J̌ T̈ café café STRAßE İstanbul ΣΟΦΟΣ",
    "a <|endoftext|> b", "a <|ENDOFTEXT|> b", "A <|endoftext|> B", "x y   z \x1c w", "It's we'll 12345 $#@!! don't", "你好世界 مرحبا", "word " * 30_000, "q" * 5_000,
]


def library_counts(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(sp.encode(t or "")) for t in texts]
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_counts_are_the_librarys(spark, path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in counts.count(docs, path, shared_dir(spark, "cache"), 100).collect()}
    for k, (text, n) in enumerate(zip(TEXTS, library_counts(path, TEXTS), strict=True)):
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((text or "").encode()), n > 100), (k, text and text[:40])


def test_query_equals_the_library_on_the_given_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    from tessara.llm.queries import op11_token_counts

    got = {r.doc_id: r.n_tokens for r in op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip([r.doc_id for r in rows], library_counts(WORDS, [r.text for r in rows]), strict=True))


def test_equal_contents_are_encoded_once_and_hits_never(spark):
    cache = shared_dir(spark, "cache")
    docs = spark.createDataFrame([(1, TEXTS[0]), (2, TEXTS[1]), (2, TEXTS[1]), (None, TEXTS[2]), (5, None), (6, "")], "doc_id long, text string")
    first = counts.count(docs, WORDS, cache)
    assert sorted(map(tuple, first.collect()), key=str) == sorted([(1, 24, 7, False), (2, 23, 7, False), (2, 23, 7, False), (None, 25, 7, False), (5, 0, 0, False), (6, 0, 0, False)], key=str)
    version = counts.version_of(WORDS)
    stored_rows = spark.read.parquet(f"{cache}/version={version}")
    assert stored_rows.count() == 2  # one sentence and the empty text
    # What is stored is believed: a changed count comes back for the old text, and only the new text is encoded.
    changed = shared_dir(spark, "cache")
    stored_rows.select("digest", (F.col("n_tokens") + 1000).alias("n_tokens")).write.parquet(f"{changed}/version={version}")
    more = docs.union(spark.createDataFrame([(7, "new words")], docs.schema))
    got = {(r.doc_id, r.n_tokens) for r in counts.count(more, WORDS, changed).collect()}
    assert got == {(1, 1007), (2, 1007), (None, 1007), (5, 1000), (6, 1000), (7, 2)}
    assert spark.read.parquet(f"{changed}/version={version}").count() == 3


def test_two_appends_of_one_digest_and_compaction(spark):
    cache, into = shared_dir(spark, "cache"), shared_dir(spark, "cache")
    docs = spark.createDataFrame([("a", "one two"), ("b", "three")], "doc_id string, text string")
    version = counts.append_misses(docs, WORDS, cache)
    spark.read.parquet(f"{cache}/version={version}").write.mode("append").parquet(f"{cache}/version={version}")
    assert {tuple(r) for r in counts.count(docs, WORDS, cache, 1).collect()} == {("a", 7, 2, True), ("b", 5, 1, False)}
    counts.compact(spark, cache, version, into, 1)
    assert spark.read.parquet(f"{into}/version={version}").count() == 2


def test_versions_of_tokenizers_differ():
    assert len({counts.version_of(p) for p in (WORDS, BYTES, PIECES)}) == 3


def test_empty_table_and_clashing_columns(spark):
    cache = shared_dir(spark, "cache")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert counts.count(empty, WORDS, cache).collect() == []
    docs = spark.createDataFrame([(1, "a b", b"x", 9, {"k": 1}, 3)], "doc_id long, text string, digest binary, n_tokens long, `a.b` map<string,int>, version int")
    assert [tuple(r) for r in counts.count(docs, WORDS, cache).collect()] == [(1, 3, 2, False)]
