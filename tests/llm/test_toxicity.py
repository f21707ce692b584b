import math
import random
from collections import Counter

import numpy as np

from tessara.llm import toxicity


def corpus(spark, n=400):
    draw = random.Random(1)
    plain, bad = [f"word{i}" for i in range(300)], ["zorgly", "blarghs", "grumpfel", "snotrag"]
    rows, labels = [], []
    for i in range(n):
        words = draw.choices(plain, k=30)
        toxic = i % 5 == 0
        if toxic:
            for b in draw.sample(bad, 2):
                words.insert(draw.randrange(30), b)
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[2] for r in labels}


def test_neighbours_equal_brute_force():
    rng = np.random.default_rng(5)
    n, m = 300, 40
    w = np.where(rng.random((n, m)) < 0.15, rng.random((n, m)), 0).astype(np.float32)
    w[w.sum(1) == 0, 0] = 1
    w[250:260] = w[10]  # ties
    w /= np.sqrt((w * w).sum(1, keepdims=True))
    blocks = -(-n // toxicity.BLOCK)
    padded = np.zeros((blocks * toxicity.BLOCK, m), np.float32)
    padded[:n] = w
    postings = padded.reshape(blocks, toxicity.BLOCK, m).transpose(0, 2, 1).copy()
    index = toxicity.Index({}, np.ones(m), np.arange(n), np.zeros(n), np.ones(n), postings, postings.max(axis=2).T, 0.1)
    for i in range(0, n, 7):
        f = np.flatnonzero(w[i])
        best, cosine = index.nearest(f, w[i, f], k=9)
        every = w @ w[i]
        order = np.lexsort((np.arange(n), -every.round(6)))[:9]
        assert np.allclose(np.sort(cosine)[::-1], np.sort(every[every > 0])[::-1][:9], atol=1e-5)
        assert np.allclose(every[best], every[order], atol=1e-5)
        assert i not in index.nearest(f, w[i, f], skip=i)[0]


def test_held_out_texts_are_told_apart(spark):
    docs, labels, truth = corpus(spark)
    index = toxicity.fit(docs, labels.where("doc_id < 300"))
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    wrong = [i for i in range(300, 400) if (got[i].score >= 0.5) != truth[i]]
    assert len(wrong) <= 2
    assert all(e.toxic == truth[e.doc_id] for r in got.values() for e in r.evidence)


def test_odd_rows_and_labels(spark):
    docs, labels, _ = corpus(spark, 100)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "zorgly blarghs"), (3, "zorgly blarghs"), (4, "word1 " * 60_000)], "doc_id long, text string")
    index = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(5, 1, None), (None, 1, 1)], labels.schema)))
    got = sorted((r.doc_id, r.score >= 0.5) for r in toxicity.score(odd, index).collect())
    assert got == [(1, False), (2, False), (3, True), (3, True), (4, False)]
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score < 0.5 for r in toxicity.score(odd, none).collect()} == {True}
    assert toxicity.score(odd.limit(0), index).collect() == []
    one_kind = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r.score < 0.5 for r in toxicity.score(odd, one_kind).collect())


def test_a_near_copy_finds_its_example_by_words_of_any_frequency(spark):
    docs, labels, _ = corpus(spark)
    rare = " ".join(f"once{chr(97 + k)}{chr(122 - k)}" for k in range(20))
    more = spark.createDataFrame([(1000, rare, 0.5), (1001, rare + " word7", 0.5)], docs.schema)
    index = toxicity.fit(docs.unionByName(more), labels.unionByName(spark.createDataFrame([(1000, 1, 1)], labels.schema)))
    words = {w for r in docs.collect() for w in r.text.split()} | set(rare.split())
    assert all(b"=" + w.encode() in index.features for w in words) and (index.idf > 0).all()
    (got,) = toxicity.score(more.where("doc_id = 1001"), index).collect()
    assert (got.evidence[0].doc_id, got.evidence[0].toxic) == (1000, 1) and got.evidence[0].cosine > 0.8
    assert got.score > index.score(index.vote(np.zeros(0, np.int64), np.zeros(0, np.float32)))


def test_both_parts_of_the_index_give_all_cosines(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "COMMON", 0.1)
    docs, labels, _ = corpus(spark)
    index = toxicity.fit(docs, labels)
    blocks, common, _ = index.postings.shape
    assert 0 < common < len(index.features)
    every = np.zeros((len(index.features), blocks * toxicity.BLOCK), np.float32)
    every[:common] = index.postings.transpose(1, 0, 2).reshape(common, -1)
    starts, examples, weights = index.rare
    for f in range(common, len(index.features)):
        own = slice(starts[f - common], starts[f - common + 1])
        every[f, examples[own]] = weights[own]
    assert np.allclose((every**2).sum(0)[: len(index.ids)], 1, atol=1e-4)
    for i in range(0, 400, 13):
        f = np.flatnonzero(every[:, i])
        cosine = index.nearest(f, every[f, i], k=9)[1]
        assert np.allclose(cosine, np.sort(every[f, i] @ every[f])[::-1][:9], atol=1e-5)


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels, truth = corpus(spark)
    long = spark.createDataFrame([(2000, "zorgly " * 9_000, 0.5)], docs.schema)
    marked = labels.unionByName(spark.createDataFrame([(2000, 1, 1)], labels.schema))
    monkeypatch.setattr(toxicity, "LONGEST_EXAMPLE", 60_000)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 12_000)
    rows, counts = toxicity.examples(docs.unionByName(long), marked)
    got = rows.collect()
    assert counts == {0: 320, 1: 81} and 2000 not in {r.doc_id for r in got}
    for y in (0, 1):
        assert 11_000 < sum(len(r.text.encode()) for r in got if r.y == y) <= 12_000
    index = toxicity.fit(docs.unionByName(long), marked)
    assert toxicity.score(long, index).first().score >= 0.5


def test_plain_tf_idf_has_no_label_factor(spark):
    docs, labels, _ = corpus(spark, 100)
    index = toxicity.fit(docs, labels, chi=None)
    df = Counter(f for r in docs.collect() for f in set().union(*(toxicity.features_of(w) for w in r.text.encode().split())))
    assert all(math.isclose(index.idf[k], math.log(101 / (1 + df[f])) + 1) for f, k in index.features.items())


def test_long_words_give_pieces(spark):
    assert b"b" * 5 in toxicity.features_of(b"a" * 100 + b"b" * 5)
    docs, labels, _ = corpus(spark)
    joined = spark.createDataFrame([(1, "x".join(["zorgly", "blarghs", "grumpfel", "snotrag"] * 3), 0.5)], docs.schema)
    (got,) = toxicity.score(joined, toxicity.fit(docs, labels)).collect()
    assert got.score >= 0.5 and got.evidence[0].toxic == 1


def test_scores_equal_a_plain_count_of_votes(spark):
    docs, labels, truth = corpus(spark, 160)
    known = {i: y for i, y in truth.items() if i < 110}
    index = toxicity.fit(docs, labels.where("doc_id < 110"))
    bags = {r.doc_id: Counter(f for w in r.text.encode().split() for f in toxicity.features_of(w)) for r in docs.collect()}
    ones, total = sum(known.values()), len(known)
    df = {y: Counter(f for i, own in known.items() if own == y for f in bags[i]) for y in (0, 1)}

    def weight(f):
        a, b = df[1][f], df[0][f]
        chi = total * (a * (total - ones) - b * ones) ** 2 / (ones * (total - ones) * (a + b) * max(1, total - a - b))
        lift = (a + 0.5) / (ones + 1) / ((b + 0.5) / (total - ones + 1))
        return (math.log((1 + total) / (1 + a + b)) + 1) * (1 + math.log(lift) ** 2 * chi / (chi + toxicity.CHI))

    weights = {f: weight(f) for f in set(df[0]) | set(df[1])}

    def vector(i):
        own = {f: (1 + math.log(n)) * weights[f] for f, n in bags[i].items() if f in weights}
        size = math.sqrt(sum(x * x for x in own.values()))
        return {f: x / size for f, x in own.items()}

    vectors = {i: vector(i) for i in bags}

    def vote(i, skip=None):
        near = sorted(((sum(x * vectors[j].get(f, 0) for f, x in vectors[i].items()), j) for j in known if j != skip), reverse=True)[: toxicity.K]
        one, every = (sum(c * c for c, j in near if c > 0 and known[j] in kinds) for kinds in ((1,), (0, 1)))
        p = min(max((one + 0.05 * ones / total) / (every + 0.05), 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    slope, offset = index.calibration
    left_out = [(vote(i, skip=i), y) for i, y in known.items()]
    at = [(1 / (1 + math.exp(-slope * v - offset)) - y, v) for v, y in left_out]
    assert slope > 0.05 and abs(sum(e * v for e, v in at) + slope - 1) < 0.05 and abs(sum(e for e, _ in at) + offset) < 0.05  # the fit's gradient
    for r in toxicity.score(docs, index).collect():
        assert math.isclose(r.score, 1 / (1 + math.exp(-slope * vote(r.doc_id) - offset)), abs_tol=2e-3), r.doc_id
