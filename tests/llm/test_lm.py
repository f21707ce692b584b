import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessara.llm import lm

TEXTS = ["the cat saw the dog", "der hund sah die katze", "the dog saw a cat and the cat ran", "die katze und der hund", None, "", "The  Cat\tsaw"]


def rows(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(parts)


def words_of(text):
    return lm.tokens_of((text or "").encode())


def brute_force(texts, learned, depth, least, keep=lm.KEEP, discount=lm.DISCOUNT):
    """Score of each text by dictionaries of n-grams, the tree's definition word by word."""
    cut = [words_of(t) for t in texts]
    grams = [Counter(tuple(c[i : i + n]) for k, c in enumerate(cut) if learned(k) for i in range(len(c) - n + 1)) for n in range(depth + 2)]
    words = grams[1]
    total = sum(words.values())
    unseen = (sum(n == 1 for n in words.values()) + 1) / (total + 1)
    states = {}

    def p(context, word):
        """By the longest state that the context ends with."""
        for at in range(len(context) + 1):
            own = context[at:]
            if not own:
                return (1 - unseen) * words[(word,)] / total if words[(word,)] else unseen
            if own in states:
                return within(own, word, *states[own])
        raise AssertionError

    def within(context, word, share, listed):
        n = listed.get(word)
        return (0 if n is None else (n - discount) / grams[len(context)][context]) + share * p(context[1:], word)

    for n in range(1, depth + 1):
        found = {}
        for gram, count in grams[n + 1].items():
            if count >= least:
                found.setdefault(gram[:-1], {})[gram[-1]] = count
        new = {}
        for context, listed in found.items():
            had, said = grams[n][context], sum(listed.values())
            share = 1 - (said - discount * len(listed)) / had
            gain = sum(c * math.log(within(context, w, share, listed) / p(context[1:], w)) for w, c in listed.items()) + (had - said) * math.log(share)
            if gain >= keep * len(listed) * math.log(had) / 2:
                new[context] = share, listed
        if not new:
            break
        states |= new
    return states, [sum(math.log10(p(tuple(c[max(0, i - depth) : i]), w)) for i, w in enumerate(c)) for c in cut], p


def corpus():
    draw = random.Random(7)
    en, de = [f"e{i}" for i in range(12)], [f"d{i}" for i in range(12)]
    made = [" ".join(draw.choices(en if i % 2 else de, k=draw.randrange(1, 40))) for i in range(160)]
    made += ["a b c d e a c b x", "b b c y q"] * 12 + ["a b c d"] * 9 + ["z b c w"] * 9 + ["a b c new"] + TEXTS
    draw.shuffle(made)
    return made


def test_scores_equal_brute_force_however_rows_are_dealt(spark):
    texts = corpus()
    states, want, _ = brute_force(texts, lambda i: i % 7 != 2, 3, 4)
    assert {len(s) for s in states} >= {1, 2}
    for parts, chunk in ((1, 10**6), (4, 300), (16, 50)):
        got = {r.doc_id: r for r in lm.scored(rows(spark, texts, parts), F.col("doc_id") % 7 != 2, least=4, chunk_bytes=chunk).collect()}
        assert len(got) == len(texts)
        assert all(math.isclose(got[i].score, s, rel_tol=1e-5, abs_tol=1e-5) for i, s in enumerate(want))


def test_every_state_is_a_distribution():
    texts = corpus()
    states, _, p = brute_force(texts, lambda i: True, 3, 4)
    words = {w for t in texts for w in words_of(t)}
    for context in [(), *states][:40]:
        assert math.isclose(sum(p(context, w) for w in words) + p(context, b"never seen"), 1, rel_tol=1e-9)


def test_base_scores_and_counts(spark):
    texts = TEXTS * 12
    got = {r.doc_id: r for r in lm.scored(rows(spark, texts), F.col("doc_id") % 5 != 2).collect()}
    counts = Counter(w for i, t in enumerate(texts) if i % 5 != 2 for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        own = words_of(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_keys_of_n_grams_differ():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 2000)
    pairs = lm.longer(np.repeat(keys, 50), np.tile(keys[:50], 2000))
    assert len(np.unique(pairs)) == len(pairs)
    assert (lm.longer(keys, keys[::-1].copy()) != lm.longer(keys[::-1].copy(), keys)).any()


def test_odd_tables(spark):
    assert lm.scored(rows(spark, TEXTS).limit(0), F.lit(True)).collect() == []
    none = lm.scored(rows(spark, TEXTS), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.score, r.base_score) for r in none} == {(0, 0, 0.0, 0.0)}
    big = 2**60
    ids = [big + 1, big + 2, None, 7, 7]
    odd = spark.createDataFrame([(i, "word " * 3000 if i == 7 else "a b", 1) for i in ids], "doc_id long, text string, chunk int").coalesce(1)
    got = lm.scored(odd, F.lit(True), chunk_bytes=1000).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)
    assert {r.score for r in got if r.doc_id == 7}.__len__() == 1


@pytest.mark.parametrize("keys", [[], [5], [3, -2, 3, 7, -2, 3], [1 << 62, -(1 << 63), 0, 0]])
def test_sorted_runs_are_numpys_unique(keys):
    keys = np.array(keys, np.int64)
    want, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    assert lm.distinct(keys).tolist() == want.tolist()
    order, new = lm.runs_of(keys)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    assert back.tolist() == inverse.tolist() and keys[order][new].tolist() == want.tolist()
    assert np.diff(np.flatnonzero(new), append=len(keys)).tolist() == counts.tolist()
