import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessara.llm import negatives
from tessara.llm.queries import OP12_SQL, op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, per_anchor=5, per_positive=5, low=80):
    """The contract row by row: rows are (vec_id, vector, label)."""
    usable = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = (label, [math.floor(256 * x) for x in vector])
        usable[vec_id] = min(usable.get(vec_id, own), own)
    out = []
    for a, (label, q) in usable.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r, strict=True)), i, other == label) for i, (other, r) in usable.items() if i != a and len(r) == len(q))
        for less, i, _ in [x for x in scored if x[2]][:per_anchor]:
            inside = [x for x in scored if not x[2] and low * -less <= 100 * -x[0] <= 100 * -less][:per_positive]
            out += [(a, i, rank, x[1], -less, -x[0]) for rank, x in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, every, schema=SCHEMA):
    return sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % every == 0).collect()))


def near(draw, centre, spread):
    return [float(c + draw.gauss(0, spread)) for c in centre]


def test_random_rows_ties_repeats_and_odd_values(spark):
    draw = random.Random(5)
    centres = [near(draw, [0] * 6, 0.4) for _ in range(3)]
    rows = [(i, near(draw, draw.choice(centres), 0.1), draw.randrange(4)) for i in range(300)]
    rows += [(300 + i, rows[0][1], draw.randrange(4)) for i in range(60)]  # copies of an anchor's vector
    rows += rows[20:40] + [(11, rows[3][1], 0), (11, rows[4][1], 3)]
    rows += [(400, None, 1), (410, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (420, [float("nan")] * 6, 1), (430, [float("inf")] + [0.0] * 5, 2), (440, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(450, [0.5, 0.5], 1), (451, [0.4, 0.5], 1), (452, [0.45, 0.5], 2), (460, [], 1), (461, [], 1), (462, [], 2), (470, [0.1, 0.2, 0.3], 1), (475, [0.2, 0.2, 0.3, 0.4], 2)]
    draw.shuffle(rows)
    expected = brute([(i, None if v is None else [None if x is None else float(F32(x)) for x in v], c) for i, v, c in rows], 10)
    assert len(expected) > 400 and mined(spark, rows, 10) == expected


def F32(x):
    import numpy as np

    return np.float32(x)


def test_small_blocks_give_the_same_rows(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, [F32(x).item() for x in near(draw, [0.3] * 4, 0.2)], draw.randrange(3)) for i in range(500)]
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "SCORES", 60)
    assert mined(spark, rows, 5) == brute(rows, 5)


def test_fewer_positives_and_negatives_than_asked_for(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.8, 0.0], 2), (3, [0.1, 0.0], 2), (4, [0.95, 0.0], 3), (100, [0.0, 1.0], 9)]
    got = mined(spark, rows, 100)
    assert got == brute(rows, 100) == [(0, 1, 1, 2, 256 * 230, 256 * 204)]


def test_negative_and_zero_scores(spark):
    rows = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2), (3, [0.0], 1), (4, [0.0], 2), (5, [-0.5], 2)]
    assert mined(spark, rows, 100) == brute(rows, 100) == [(0, 3, 1, 4, 0, 0)]


def test_large_products_are_exact_and_too_large_ones_raise(spark):
    rows = [(0, [3.0e6], 1), (1, [3.0e6], 1), (2, [2999999.75], 2), (3, [2999999.5], 2)]
    assert mined(spark, rows, 100) == brute(rows, 100)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, [1.0e12], 1), (1, [1.0e12], 1)], 100)


def test_empty_table_no_anchors_short_ids_and_clashing_columns(spark):
    assert mined(spark, [], 100) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)], 100) == []
    rows = [(0, [1.0], 1, 5, 1, [2], {"k": 1}), (1, [0.9], 1, 5, 1, [2], None), (2, [0.8], 2, 5, 1, [2], None)]
    got = mined(spark, rows, 100, "vec_id int, embedding array<double>, label long, score int, i int, q array<int>, `a.b` map<string,int>")
    assert [r[:4] for r in got] == [(0, 1, 1, 2)]


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    cursor = con.execute(OP12_SQL)
    names = [c[0] for c in cursor.description]
    got = op12_hard_negatives(spark, d)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())
