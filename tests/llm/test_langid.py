import math

import numpy as np

from tessara.llm import langid
from tessara.llm.licences import words_of

TEXTS = {"xx": "the thing that they then thank the other mother there", "yy": "ein einer eine keiner meine deine der die das einander"}


def plain_bits(train: list[bytes], word: bytes, order: int) -> float:
    """The code length of a word by counting contexts afresh for every byte."""
    marked = [b" " + w + b" " for w in train]
    text, total = b" " + word + b" ", 0.0
    for i in range(1, len(text)):
        for depth in range(min(order, i), -2, -1):
            if depth < 0:
                total += 8
                break
            context = text[i - depth : i]
            seen = [w[j] for w in marked for j in range(max(1, depth), len(w)) if w[j - depth : j] == context]
            n, distinct = len(seen), len(set(seen))
            if text[i] in seen:
                total += math.log2((n + distinct) / seen.count(text[i]))
                break
            if n:
                total += math.log2((n + distinct) / distinct)
    return total


def test_code_lengths_equal_plain_counting():
    train = {k: words_of(v) for k, v in TEXTS.items()}
    for order in (0, 2, 4):
        model = langid.build(langid.pd.concat([langid.count(w, order).assign(lang=k) for k, w in train.items()]), order)
        words = [b"then", b"einem", b"zq", b"thing", b"a", "é".encode(), b"other"]
        got = model.lengths(words)
        want = [[plain_bits(train[k], w, order) for k in model.langs] for w in words]
        assert np.allclose(got, want, atol=1e-3)


def test_predictions_over_odd_rows(spark):
    rows = [(i, TEXTS[k], k, "x") for i, k in enumerate(["xx", "yy", "xx", "yy"])]
    model = langid.fit(spark.createDataFrame(rows + [(9, None, "xx", ""), (10, "nobody", None, "")], "doc_id long, text string, lang string, score string"))
    odd = spark.createDataFrame([(1, None, None, ""), (2, "", None, ""), (3, "12 34 !", None, ""), (4, "mother then", None, ""), (4, "mother then", None, ""), (5, "eine meine", "xx", ""), (6, "the " * 50_000, None, "")], "doc_id long, text string, lang string, score string")
    got = sorted((r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "xx"), (4, "xx"), (5, "yy"), (6, "xx")]
    assert all(0 <= r.score <= 1 for r in langid.predict(odd, model).collect())
    none = langid.fit(odd.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).collect() == []


def test_the_sample_is_bounded_and_even(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('w', id) AS text", "CASE WHEN id % 10 = 0 THEN 'a' ELSE 'b' END AS lang")
    n = {r.lang: r["count"] for r in langid.sample(docs, 100).groupBy("lang").count().collect()}
    assert n["b"] == 100 and n["a"] == 100


def test_scores_equal_plain_code_lengths(spark):
    train = spark.createDataFrame([(1, TEXTS["xx"], "xx"), (2, TEXTS["yy"], "yy")], "doc_id long, text string, lang string")
    texts = ["Then, the others", "eine zq!", "keiner thank", "a"]
    rows = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), langid.fit(train)).collect()
    for r in rows:
        own = words_of(texts[r.doc_id])
        bits = {k: sum(plain_bits(words_of(v), w, langid.ORDER) for w in own) for k, v in TEXTS.items()}
        best = min(bits, key=bits.get)
        share = 1 / sum(2 ** ((bits[best] - b) / math.sqrt(len(own))) for b in bits.values())
        assert r.lang_pred == best and math.isclose(r.bits, bits[best], abs_tol=1e-2) and math.isclose(r.score, share, abs_tol=1e-3)
