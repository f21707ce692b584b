"""Large ids beside nulls keep every digit through each operator that goes through Python."""

import pytest
from pyspark.sql import functions as F

from tessara.llm import bpe, jaccard, langid, licences, lm, tokens, toxicity, warc
from tessara.llm.common import tokenizer_path

BIG = 2**60
IDS = [BIG + 1, BIG + 2, None, BIG + 4]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"some plain words of text number {k}", "en") for k, i in enumerate(IDS)], "doc_id long, text string, lang string").coalesce(1)


def same(rows, column="doc_id"):
    return sorted((r[column] for r in rows.collect()), key=str) == sorted(IDS, key=str)


def test_ids_keep_their_digits(spark, docs):
    assert same(jaccard.join(docs)) and same(lm.scored(docs, F.lit(True))) and same(licences.scan(docs))
    assert same(tokens.read(tokens.write(docs, tokenizer_path("byte_bpe_50k.json"), end=0)))
    assert same(bpe.digests(docs, tokenizer_path("word_bpe_49k.json"))) and same(bpe.encode(docs, tokenizer_path("word_bpe_49k.json")))
    assert same(langid.predict(docs, langid.fit(docs)))
    labels = spark.createDataFrame([(BIG + 1, 1), (BIG + 2, 0)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert same(scored) and {e.doc_id for r in scored.collect() for e in r.evidence} <= {BIG + 1, BIG + 2}


def test_archives_refer_to_exact_ids(spark):
    pages = spark.createDataFrame([(i, "http://a.example/", "same") for i in IDS[:2]] + [(None, None, None), (BIG + 4, "http://b.example/x", "other")], "page_id long, url string, html string").coalesce(1)
    rows = warc.read(warc.lookup(warc.build_index(warc.write(pages)), pages)).collect()
    assert sorted((r.page_id for r in rows), key=str) == sorted(IDS, key=str)
    assert {r.page_id: r.refers_to for r in rows} == {BIG + 1: None, BIG + 2: BIG + 1, None: None, BIG + 4: None}


def test_shared_paths_name_their_file_system(spark):
    from tessara.llm import files
    from tessara.llm.common import shared_dir

    path = shared_dir(spark, "x")
    assert path.startswith("file:/")
    files.put(f"{path}/a", [b"one", b"two"])
    assert files.get(f"{path}/a") == b"onetwo" and spark.read.text(path).first()[0] == "onetwo"
