"""Operator 13 against plain products, brute force and SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from scarpline.llm import hard_negatives, queries


def products(c, a):
    return [[sum(x * y for x, y in zip(r, s, strict=False)) for s in a.tolist()] for r in c.tolist()]


@pytest.mark.parametrize("dims,high", [(8, 3), (64, 1.5), (13, 900), (3, 1e7), (20, 1e30), (1, 0.0)])
def test_lookups_equal_products(dims, high):
    rng = random.Random(dims)
    draw = lambda n: hard_negatives.whole([[rng.uniform(-high, high) for _ in range(dims)] for _ in range(n)], 256)
    c, a = draw(700), draw(9)
    bits, planes = hard_negatives.bit_planes(c)
    got = hard_negatives.scores(hard_negatives.subset_tables(a, hard_negatives.kind_for(a, bits)), planes)
    assert got.tolist() == products(c, a)


def test_whole_numbers_round_down():
    assert hard_negatives.whole([[0.999, -0.001, -1.0], [1 / 256]], 256).tolist() == [[255, -1, -256] + [0] * 5, [1] + [0] * 7]
    assert hard_negatives.whole([], 256).shape == (0, 0) and hard_negatives.whole([[]], 256).shape == (1, 0)


def brute(rows, low=80, k=5):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (label, [float(np.float32(x)) for x in v])
        best[i] = min(best.get(i, row), row)
    whole = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in best.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in whole.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == label][:k]:
            found = [i for i in order if whole[i][0] != label and low * score[p] <= 100 * score[i] <= 100 * score[p]][:k]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumn("rank", F.lit("mine")).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


def test_mining_equals_brute_force(spark):
    """Small cells; flaws, ties, copies, repeated ids, one hot vector and one hot label."""
    rng = random.Random(6)
    rows = [(i, rng.choice((0, 0, 0, 1, 2)), [rng.choice((-1.5, -0.25, 0.125, 0.5, 1.0)) for _ in range(5)]) for i in range(0, 900, 3)]
    rows += [(i, i % 4, [0.5, 1.0, 1.0, 0.5, 0.5]) for i in range(1000, 1200)]
    rows += [(1300, None, [1.0] * 5), (1400, 1, None), (1500, 1, [1.0, None, 1.0, 1.0, 1.0]), (1600, 1, [float("nan")] * 5), (1700, 1, [float("inf")] * 5)]
    rows += [(1800, 1, [1.0, 1.0]), (1900, 2, []), (None, 1, [1.0] * 5), (2000, 9, [1.0] * 5), (300, 0, [9.0] * 5), (300, 0, [9.0] * 5), (2100, 1, [-0.5] * 5)]
    want = brute(rows)
    assert len(want) > 50
    assert mined(spark, rows, block=64, anchors=4) == want
    assert mined(spark, rows) == want


def test_few_rows_and_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.875]), (3, 2, [0.75]), (4, 3, [1.5])]) == [(100, 1, 1, 2, 65536, 57344)]


def test_huge_numbers(spark):
    rows = [(100, 1, [3e4, 1.0]), (1, 1, [3e4, 2.0]), (2, 2, [2.9e4, -5e4]), (3, 0, [1e5, 0.0])]
    assert mined(spark, rows) == brute(rows)


def test_query_equals_sql(spark, small):
    ok, message = compare(spark, connect(small), small, "op13_hard_negatives", queries.QUERIES["op13_hard_negatives"], queries.ORACLES["op13_hard_negatives"])
    assert ok, message
