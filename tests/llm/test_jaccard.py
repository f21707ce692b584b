import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessara.llm import jaccard


def plain(rows, n=5, threshold=0.8):
    """doc -> (class, copies' first, links, classes) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = [x.decode() for x in jaccard.words_of(t)]
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    near = {i: {j for j, s in sets.items() if j != i and s and sets[i] and len(s & sets[i]) >= threshold * len(s | sets[i])} for i in sets}
    first = {}
    for i in sorted(sets):
        if i not in first:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            first |= {j: i for j in seen}
    same = {i: min(j for j in sets if sets[j] == sets[i]) if sets[i] else i for i in sets}
    return {i: (first[i], same[i], len(near[i]), len({sets[j] for j in near[i]} - {sets[i]})) for i in sets}


def corpus(seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, base = [], [draw.choices(vocabulary, k=k) for k in (12, 30, 60, 150, 400, 4, 2)]
    passage = draw.choices(vocabulary, k=40)
    for k, words in enumerate(base):
        for c in range(14):
            own = list(words)
            for _ in range(c % 5):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            rows.append((1000 * k + c, " ".join(own)))
    rows += [(20_000 + i, " ".join(passage + draw.choices(vocabulary, k=60))) for i in range(15)]
    rows += [(30_000 + i, " ".join(draw.choices(vocabulary, k=50))) for i in range(30)]
    return rows + [(40_000, None), (40_001, ""), (40_002, " .,! "), (40_003, "One, two THREE four five six"), (40_004, "one two three four five six")]


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cls string").repartition(4)
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.class_id, r.copy_id, r.n_links, r.n_classes) for r in got}


def test_join_equals_all_pairs(spark):
    rows = corpus()
    assert found(spark, rows) == plain(rows)


def test_cells_of_many_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 4)
    rows = corpus(5)
    assert found(spark, rows) == plain(rows)


def test_pruning_keeps_pairs_at_the_threshold():
    assert jaccard.least_matches(16) < 16 * 0.8 < 16 and jaccard.least_matches(96) > jaccard.least_matches(16)
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 32, (4000, jaccard.PERMS), dtype=np.uint32)
    for share, most, least in ((0.8, 4000, 3999), (0.3, 10, 0)):
        right = np.where(rng.random(left.shape) < share, left, left + 1)
        kept = len(jaccard.likely_pairs(left, right, np.arange(4000), np.arange(4000)))
        assert least <= kept <= most


def test_components_of_chains_and_stars(spark):
    edges = [(b"%04d" % i, b"%04d" % (i + 1)) for i in range(60)] + [(b"x", b"y%03d" % i) for i in range(50)] + [(b"z", b"z")]
    got = jaccard.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")).collect()
    assert Counter(bytes(r.root) for r in got) == {b"0000": 61, b"x": 51}


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([*rows, (None, "a lonely text of some words here"), (None, None)], "doc_id long, text string")
    kept = [r.doc_id for r in jaccard.keep_one(docs, jaccard.join(docs)).collect()]
    want = plain(rows)
    assert sorted(k for k in kept if k is not None) == sorted({c[0] for c in want.values()}) and kept.count(None) == 2


def test_an_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    draw = random.Random(4)
    a, b, c, d, e = (" ".join(draw.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(5))
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (None, b + " more"), (2, c), (None, c + " more"), (None, d), (3, c + " less"), (3, e), (None, None), (4, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source long").repartition(3)
    kept = jaccard.keep_one(docs, jaccard.join(docs))
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    one = got.pop((None, b), 0) + got.pop((None, b + " more"), 0)
    assert one == 1 and got == Counter([(1, a), (2, c), (None, d), (3, e), (None, None), (4, "")])


def test_rows_of_large_keys_are_dealt_and_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB", 4)
    monkeypatch.setattr(jaccard, "HUBS", 2)
    rows = [(f"k{i % 3}" if i < 200 else f"s{i}", i) for i in range(230)]
    df = spark.createDataFrame(rows, "key string, id long")
    facts = df.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    first = {}
    for k, i in rows:
        first.setdefault(k, i)
    assert sorted(map(tuple, jaccard.by_group(df, facts, "key").select("key", "id", "least").collect())) == sorted((k, i, first[k]) for k, i in rows)
    star = [(f"{i:04}".encode(), b"0000") for i in range(1, 150)] + [(f"{i + 1:04}".encode(), f"{i:04}".encode()) for i in range(200, 230)]
    found = {bytes(r.node): bytes(r.root) for r in jaccard.components(spark.createDataFrame(star, "a binary, b binary")).collect()}
    assert found == {f"{i:04}".encode(): b"0000" if i < 200 else b"0200" for i in [*range(150), *range(200, 231)]}
