import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tessara.llm import spelling
from tessara.llm.queries import OP13_SQL, op13_spelling_groups

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def is_near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(words):
    """All pairs of words of about one length."""
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    form, near = {}, {}
    for w, n in words.items():
        own = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if is_near(w, v)]
        near[w] = len(own)
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, near[w], words.get(form[w])) for w, n in words.items())


def grouped(spark, words):
    rows = spelling.groups(spark.createDataFrame(list(words.items()), "word string, n long"))
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: r[0])


def test_query_equals_all_pairs_of_the_given_texts(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = op13_spelling_groups(spark, d)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute(brute_words(rows))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == expected and sum(r[1] is not None for r in expected) > 5


def test_edits_at_every_place_runs_ties_and_chains(spark):
    base = "abcdefgh"
    words = {base: 1000}
    for i, w in enumerate(sorted({base[:k] + c + base[k + 1 :] for k in range(8) for c in "xzé"} | {base[:k] + c + base[k:] for k in range(9) for c in "ax"} | {base[:k] + base[k + 1 :] for k in range(8)})):
        words.setdefault(w, 2 + i % 7)
    words |= {"aaaaaaa": 500, "aaaaaaaa": 5, "aaaaaaaaa": 50, "baaaaaaa": 5, "aabbaabb": 7, "aabaabb": 7, "aabbaab": 70, "aabbbaabb": 70}
    words |= {"chainone": 2, "chainonf": 20, "chainogf": 200, "chainhgf": 2000, "chaiihgf": 20000, "equaltie": 3, "equaltif": 30, "equaltia": 30}
    words |= {"lonelyword": 9, "àéïôüñç": 40, "àéïôüñn": 3}
    expected = brute(words)
    got = grouped(spark, words)
    assert got == expected
    by_word = {r[0]: r for r in got}
    assert by_word["chainone"][1:3] == ("chainonf", "chaiihgf") and by_word["equaltie"][1] == "equaltia" and by_word["aaaaaaaa"][4] == 3


def test_words_of_one_shape_with_batches_that_cut_groups(spark):
    words = {f"{a}{b}cdefgh": 2 + (ord(a) * ord(b)) % 97 for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert grouped(spark, words) == brute(words)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_nulls_long_texts_repeats_short_words_and_clashing_columns(spark):
    texts = [(1, None), (2, ""), (3, "Common commonly COMMONLY"), (3, "Common commonly COMMONLY"), (None, "commonly commenly"), (4, "commenly " * 40_000), (5, "x" * 20_000 + " ×÷ " + "x" * 20_000)]
    docs = spark.createDataFrame([(i, t, 1, "w", {"a": 1}) for i, t in texts], "doc_id long, text string, n int, word string, `a.b` map<string,int>")
    occurrences = docs.select("doc_id", F.explode(spelling.runs(F.col("text"))).alias("run")).select(spelling.dropped(F.col("run"), F.col("doc_id")).alias("word"))
    got = sorted((tuple(r) for r in spelling.groups(spelling.words(occurrences)).collect()), key=lambda r: r[0])
    assert got == brute(brute_words(texts)) and len(got) >= 2


def test_empty_table(spark):
    assert spelling.groups(spark.createDataFrame([], "word string, n long")).collect() == []


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    cursor = con.execute(OP13_SQL)
    names = [c[0] for c in cursor.description]
    got = op13_spelling_groups(spark, d)
    first = lambda r: r[0]
    assert got.columns == names and sorted(map(tuple, got.collect()), key=first) == sorted(cursor.fetchall(), key=first)
