import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from frameprobe.llm import topk


def brute(rows, k=5):
    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v)

    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and fine(v)]
    out = []
    for n, (q, a) in enumerate(good):
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(good) if m != n and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_matches_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(700, 720)]  # ties
    rows += [(720, None), (721, []), (722, [0.1] * 7 + [None]), (723, [float("nan")] * 8), (724, [float("inf")] * 8), (None, [0.5] * 8),
             (750, [0.0] * 8), (800, [0.3, -0.2]), (801, [0.1, 0.1]), (850, [9.5, -1.0, 2.0]), (7, rows[7][1]), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    df = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    want = brute([(x.vec_id, x.embedding) for x in df.collect()])
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == want


def test_large_finite_vectors_take_part(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) * s for _ in range(6)]) for i, s in enumerate([1, 1e3, 1e5, 1e6] * 60)]
    rows += [(300, [1e5, -1e5, 0.0, 0.0, 0.0, 0.0]), (301, [-2e6] * 6), (302, [3e5, 3e5, 3e5, -1.0, 0.5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 50, 150, 300):
        found = sorted((-sum(x * y for x, y in zip(good[q], b)), i) for i, b in good.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found) if abs(s) < 1 << 63]
    assert len(want) == 20
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id").isin(0, 50, 150, 300)).collect())) == want


def test_scores_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [1e9]), (1, [1e9]), (2, [-1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(df, F.col("vec_id") == 0, k=1).collect()
    df = spark.createDataFrame([(0, [1e9]), (1, [1.0]), (2, [-1e9])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(df, F.col("vec_id") == 0, k=1).collect()] == [1]


def test_vectors_of_any_size_take_part(spark):
    """Huge components are ranked, not dropped; a score beyond 64 bits matters only in the result."""
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)] + [0.0, 0.0]) for i in range(40)]
    rows += [(50 + i, [-1.0 - i, 0.0, 0.0, s, 0.0]) for i, s in enumerate([1e17, -1e17, 1e30, 1e200, -1.7e308, 5e16])]
    rows += [(100, [0.5, 0.25, -0.125, 0.0, 0.0]), (150, [0.0, 0.0, 0.0, 0.0, 3.0]), (151, [2.5, -1e300, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows]
    want = []
    for q in (100, 150):
        own = dict(good)[q]
        found = sorted((-sum(x * y for x, y in zip(own, b)), i) for i, b in good if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:45])]
    assert any(50 <= i < 56 for q, _, i, _ in want if q == 150)
    for q in (100, 150):
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") == q, k=45).collect()))
        assert got == [w for w in want if w[0] == q]
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(df, F.col("vec_id") == 53, k=5).collect()


def test_rows_that_share_an_id_find_each_other(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 1.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0, k=1).collect()))
    assert got == [(0, 1, 0, 5 * 65536)] * 2


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.lit(True)).count() == 0
