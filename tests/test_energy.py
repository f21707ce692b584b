"""The energy score over blocks of samples and parts of cells, against all pairs."""

import math
import random

import pytest

from tessara.operators import scoring

SAMPLE, TRUTH = "group_id string, t int, h int, node_id string, i int, y double", "group_id string, t int, h int, node_id string, truth double"


def brute(samples, truth, beta):
    out = {}
    for g, t in {r[:2] for r in truth}:
        cells = sorted(r[2:4] for r in truth if r[:2] == (g, t))
        goal = [next(r[4] for r in truth if r[:4] == (g, t, *c)) for c in cells]
        by = {}
        for r in samples:
            if r[:2] == (g, t):
                by.setdefault(r[4], {})[r[2:4]] = r[5]
        rows = [[v[c] for c in cells] for v in by.values()]
        n = len(rows)
        near = sum(math.dist(r, goal) ** beta for r in rows) / n
        apart = sum(math.dist(rows[i], rows[j]) ** beta for i in range(n) for j in range(i))
        out[g, t] = near - apart / (n * (n - 1))
    return out


@pytest.mark.parametrize("beta", [1.0, 1.5])
def test_blocks_and_parts_give_all_pairs(spark, monkeypatch, beta):
    draw = random.Random(2)
    cells = [("u", 3), ("u", 4), ("v", 3)]
    truth = [(g, t, h, f"n{k}", draw.gauss(1e6, 10)) for g, t in cells for h in range(3) for k in range(7)]
    samples = [(*r[:4], i, r[4] + draw.gauss(0, 5)) for r in truth for i in range(23)]
    samples = [(*r[:4], r[4], r[5] if r[4] else next(x[5] for x in samples if x[:4] == r[:4] and x[4] == 1)) for r in samples]  # two equal samples
    monkeypatch.setattr(scoring, "BLOCK", 5)
    monkeypatch.setattr(scoring, "CELLS", 6)
    draw.shuffle(samples)
    frames = spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(truth, TRUTH)
    got = {(r.group_id, r.t): r.score for r in scoring.energy_score(*frames, beta=beta).collect()}
    want = brute(samples, truth, beta)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)
    assert math.isclose(scoring.energy_score(*frames, beta=beta, reduction="mean").first().score, sum(want.values()) / 3, rel_tol=1e-6)


def test_samples_that_are_missing_raise(spark):
    truth = [("", 0, 0, "a", 1.0), ("", 0, 0, "b", 2.0)]
    samples = [(*r[:4], i, 0.5 * i) for r in truth for i in range(4)][:-1]
    with pytest.raises(Exception, match="differ in their number|reshape|same"):
        scoring.energy_score(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(truth, TRUTH)).collect()


def test_no_rows(spark):
    assert scoring.energy_score(spark.createDataFrame([], SAMPLE), spark.createDataFrame([], TRUTH)).collect() == []
