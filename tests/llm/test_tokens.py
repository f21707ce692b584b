import zlib

import numpy as np
import pytest

from tessara.llm import files, rans, tokens

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", "  ", " a", "a ", "a  b", " \n x", "foo\n bar", "foo \nbar  ", "a  b  c", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>c", "it's 'tis '' s",
    "x\x1c y", "\n\n\n", " 12 345", "don't  we'll", "😀 é ñ", "a   ", "  x  ", "one two " * 4000, "Hello, world! a.b, c.. d; É, 12, x1.",
]


def test_pieces_equal_the_tokenizer_library():
    coder, theirs = tokens.Pieces(PATH), tokenizers.Tokenizer.from_file(PATH)
    for batch in (HARD, HARD[::-1], HARD):
        for text, ids in zip(batch, coder.batch(batch), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_full_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 12)
    coder, theirs = tokens.Pieces(PATH), tokenizers.Tokenizer.from_file(PATH)
    for batch in (HARD, HARD[::-1], HARD[:5], HARD):
        for text, ids in zip(batch, coder.batch(batch), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == theirs.encode(text, add_special_tokens=False).ids, text
    assert len(coder.known) < 40


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1025, rans.BLOCK + 7])
def test_files_round_trip_and_damage_is_found(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50256).astype(np.uint32)
    data = b"".join(rans.pack(np.arange(2), np.array([True, False]), np.array([0, n]), ids))
    get = lambda d: lambda at, size: d[at : at + size] if at >= 0 else d[len(d) + at : len(d) + at + size]
    file = rans.Reader(get(data))
    assert file.n == n and np.array_equal(np.concatenate([file.block(k) for k in range(len(file.directory))] or [ids]), ids)
    if n > 1:
        bad = bytearray(data)
        bad[20] ^= 1
        with pytest.raises(ValueError, match="damaged|decodes"):
            rans.Reader(get(bytes(bad))).block(0)


def test_one_symbol_only():
    ids = np.full(5000, 7, np.uint32)
    data = b"".join(rans.pack(np.arange(1), np.ones(1, bool), np.array([5000]), ids))
    assert np.array_equal(rans.Reader(lambda at, size: data[at : at + size] if at >= 0 else data[len(data) + at :][:size]).block(0), ids)


def test_files_of_documents_with_nulls_and_repeats(spark):
    theirs = tokenizers.Tokenizer.from_file(PATH)
    rows = [(i, t, 1) for i, t in enumerate(HARD)] + [(None, "no id", 1), (3, "again", 1), (99, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)
    got = tokens.read(tokens.write(docs, PATH, end=0, partitions=3)).collect()
    start = 0
    for (i, t, _), r in zip(sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], x[1] or "")), sorted(got, key=lambda r: r.start), strict=True):
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    checked = {(r.doc_id, r.start): r.ids_crc32 for r in tokens.read(tokens.write(docs, PATH, end=0), crc=True).collect()}
    assert checked == {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in got}


def test_an_empty_table_gives_no_rows(spark):
    assert tokens.read(tokens.write(spark.createDataFrame([], "doc_id long, text string"), PATH, end=0)).collect() == []


def test_put_replaces_a_file(tmp_path):
    files.put(f"file://{tmp_path}/a/b", [b"one"])
    files.put(f"{tmp_path}/a/b", [b"tw", b"o!"])
    assert files.get(f"file://{tmp_path}/a/b") == b"two!" and files.get(f"{tmp_path}/a/b", -2, 1) == b"o"
