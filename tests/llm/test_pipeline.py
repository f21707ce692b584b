import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")


def test_stages_in_turn(spark, tmp_path):
    import public_tokenizers

    draw = random.Random(8)
    english, german = ("the of and to in is that with for was on this her there then".split(), "der die und das nicht ein eine mit auf ist von sich auch werden".split())
    prose = lambda words, n=40: " ".join(draw.choices(words, k=n)) + " " + " ".join("".join(draw.choices(words, k=2)) for _ in range(n))
    rows = [(i, prose(english if i % 2 else german), "en" if i % 2 else "de", f"src{i % 3}", 0) for i in range(40)]
    item = prose(english, 10)
    rows += [(100, rows[3][1], "en", "a", 0), (101, rows[4][1] + " zusatz", "de", "a", 0)]  # copies
    rows += [(102, prose(english) + " " + item, "en", "a", 0)]  # a benchmark passage
    rows += [(103, "too short", "en", "a", 0), (104, None, None, "a", 0), (105, "1234 5678 " * 30, "en", "a", 0), (106, " ".join(f"{k}-{k * 7} ." for k in range(1000, 1030)), "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(40))
    assert left["quality_rules"] == clean | {100, 101, 102, 106}
    assert left["language_id"] == clean | {100, 101, 102}
    assert left["near_copies"] == clean | {102}
    assert left["benchmark_passages"] == left["token_ids"] == clean
    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == clean
    assert all(list(final[i].ids) == theirs.encode(t, add_special_tokens=False).ids for i, t, *_ in rows if i in clean)


def test_contaminated_rows_go_by_id_and_text(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "so says " + item), (None, "a clean text"), (None, None), (1, item), (1, "another clean text"), (2, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {(r.doc_id, r.text) for r in corpus_pipeline.benchmark_passages(spark, docs, str(tmp_path)).collect()}
    assert left == {(None, "a clean text"), (None, None), (1, "another clean text"), (2, "clean")}


SPACED, WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain_quality(rows):
    def good(text):
        own, lines = SPACED.findall(text or ""), [x for x in (text or "").split("\n") if SPACED.search(x)]
        n, seen = len(own), Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
        repeated = {p for i in range(n - 7) if seen[tuple(own[i : i + 8])] > 1 for p in range(i, i + 8)}
        chars, symbols = sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or "")
        return not (n < 20 or 100 * len(repeated) > 30 * n or chars < 2 * n or chars > 15 * n or 4 * symbols > n or 2 * (len(lines) - len(set(lines))) > len(lines))

    return [r for r in rows if good(r[1])]


def plain_copies(rows):
    sets = []
    for r in rows:
        own = words(r[1])
        size = min(5, len(own))
        sets.append({tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                root[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r)
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
    return [min(g, key=key) for g in groups.values()]


def plain_passages(rows, items):
    windows = {tuple(w[i : i + 10]) for w in map(words, items) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return [r for r in rows if not hit(words(r[1]))]


def odd_corpus(seed):
    draw = random.Random(seed)
    vocabulary = {k: ["".join(draw.choices(letters, k=draw.randrange(2, 9))) for _ in range(300)] for k, letters in (("aa", "abcdefgh"), ("zz", "pqrstuvw"))}
    items = [" ".join(draw.choices(vocabulary["aa"], k=n)) for n in (8, 12, 30)]
    rows = []
    for i in range(120):
        lang = draw.choice(["aa", "zz"])
        own = draw.choices(vocabulary[lang], k=draw.choice([5, 19, 20, 40, 90, 400]))
        kind = draw.randrange(8)
        if kind == 0:
            own += own[: draw.randrange(8, 30)]  # repeated windows
        elif kind == 1:
            own += draw.choices(["#", "|", "<b>", "$1"], k=draw.randrange(len(own)))
        elif kind == 2:
            own[3:3] = draw.choice(items).upper().split()[draw.randrange(3) :]
        rows.append((i, (draw.choice([" ", " ", "\n", "\t"])).join(own) if kind != 3 else "\n".join([" ".join(own)] * draw.randrange(1, 4)), lang, "s", 0))
    for _ in range(60):  # near and exact copies of texts, of copies too
        i, text, lang, *_ = draw.choice(rows)
        own = (text or "").split(" ")
        for _ in range(draw.randrange(4)):
            own[draw.randrange(len(own))] = draw.choice(vocabulary["aa"])
        rows.append((draw.choice([None, len(rows), i]), " ".join(own), lang, "s", 0))
    return rows + rows[:10] + [(None, None, None, None, None), (None, "", "aa", "s", 0), (7, "?! " * 40, "zz", "s", 0)], items


def test_stages_equal_a_brute_force_over_odd_rows(spark, tmp_path):
    rows, items = odd_corpus(5)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    stages = dict(corpus_pipeline.STAGES)

    def told(docs):
        model = corpus_pipeline.langid.fit(docs.where(corpus_pipeline.remainder(4) != 2))
        good = corpus_pipeline.langid.predict(docs.select("doc_id", "text"), model).where(f"lang_pred <> 'und' AND score >= {corpus_pipeline.LEAST_SCORE}")
        return Counter(r.doc_id for r in good.collect())

    def left(name, own):
        return Counter(map(tuple, stages[name](spark, spark.createDataFrame(own, schema).repartition(5), str(tmp_path)).collect()))

    good = plain_quality(rows)
    assert 0 < len(good) < len(rows) and left("quality_rules", rows) == Counter(good)
    kept = left("language_id", good)
    assert Counter(r[0] for r in kept.elements()) == told(spark.createDataFrame(good, schema)) and not kept - Counter(good)
    for own in (rows, list(kept.elements())):
        single = plain_copies(own)
        assert len(single) < len(own)
        assert Counter((r[0], r[1]) for r in left("near_copies", own).elements()) == Counter((r[0], r[1]) for r in single)
        clean = plain_passages(single, items)
        assert len(clean) < len(single) and left("benchmark_passages", single) == Counter(clean)
    assert all(not left(name, []) for name in stages)


def test_stages_let_any_columns_pass_and_take_odd_rows(spark, tmp_path):
    """Columns with dots, of names that stages use, maps and arrays of structs; repeated rows, null ids and texts, and a very long text."""
    rows, items = odd_corpus(8)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    longest = " ".join(f"w{i}x{i % 7}y" for i in range(60_000))
    own = [(i, t, lang, s, n, 1.5, [("q", 1)], {"k": "v"}, "kept", b"x", 7) for i, t, lang, s, n in [*rows[:90], *rows[:20], (None, rows[0][1], "aa", "s", 0), (500, longest, "aa", "s", 0), (501, longest + " end", "aa", "s", 0)]]
    schema = "doc_id long, text string, lang string, source string, n_chars int, `a.b` double, `c``d` array<struct<x:string,y:int>>, matches map<string,string>, row string, text_key binary, n_hit int"
    docs = spark.createDataFrame(own, schema).repartition(3)
    plain = spark.createDataFrame([r[:5] for r in own], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.schema == docs.schema, name
        want = Counter((r.doc_id, r.text) for r in stage(spark, plain, str(tmp_path)).collect())
        assert Counter((r.doc_id, r.text) for r in got.collect()) == want and want, name
    assert corpus_pipeline.token_ids(spark, docs, str(tmp_path)).count() == len(own)


def test_rows_are_removed_by_key_with_few_bits_and_many(spark, monkeypatch):
    from tessara.llm import common

    docs = spark.range(5000).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 900).alias("text"), F.lit(1).alias("a.b"))
    keys = docs.where("text < 't3'").select("doc_id", common.text_key())
    want = Counter((r.doc_id, r.text) for r in docs.where("text >= 't3'").collect())
    for most in (common.LEAST, 1 << 20):
        monkeypatch.setattr(common, "MOST", most)
        got = common.without(docs, keys)
        assert got.columns == docs.columns and Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert common.without(docs, keys.limit(0)).count() == 5000


def test_kept_columns_may_have_a_results_name(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6, "z")], "doc_id long, text string, matches int, n_words int, `x.y` string")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    got = corpus_pipeline.decontaminate.phrase_matches(docs, items, keep=("matches", "n_words", "x.y")).first()
    assert (got.kept_matches, got.kept_n_words, got["x.y"], got.n_words, got.n_hit) == (5, 6, "z", 3, 2)
    near = corpus_pipeline.decontaminate.proximity_matches(docs, items, keep=("matches",)).first()
    assert near.matches == 5 and near.near_ids == ["1"]
