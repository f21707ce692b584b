import hashlib

import pytest

from tessara.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", "  ", "Hello\x1cWorld", "ΑΣ ΟΔΟΣ. Σ", "é café İstanbul", "<|endoftext|>Hi<|startoftext|> a<|endoftext|>", "<|ENDOFTEXT|> a<|endoftext|>b",
    "a b c\u0085d", "'S'Ll it's WE'RE don’t", "１２ ½ 3²", "aaaaaaaaaaaa bbbbbb abababab", "😀😀 ‍👩‍👧", "tab\tnew\nline\r\n", "ẞ ß ﬁ ǅ", "한국어 각", "\x00\x01", "ab " * 3000,
]


def test_ids_and_text_equal_the_tokenizer_library():
    ours, theirs = bpe.WordBpe(PATH), tokenizers.Tokenizer.from_file(PATH)
    for text in HARD:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids, text
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_tables_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    ours = bpe.WordBpe(PATH)
    assert [ours.encode(t) for t in ("one two three four", "five <|endoftext|>", "one")] == [bpe.WordBpe(PATH).encode(t) for t in ("one two three four", "five <|endoftext|>", "one")]
    assert len(ours.ids) < 8


def test_digests_over_nulls_repeats_and_more_columns(spark):
    theirs = tokenizers.Tokenizer.from_file(PATH)
    rows = [(i, t, "x") for i, t in enumerate([*HARD, None, HARD[4]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH).collect() == []
    assert {r.doc_id: list(r.ids) for r in bpe.encode(docs, PATH).collect()}[4] == theirs.encode(HARD[4], add_special_tokens=False).ids
