from functools import reduce

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from frameprobe.operators import quantiles
from frameprobe.operators.quantiles import Span, Wide, exact_quantiles, select_ranks, spans_of

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def table(spark, groups):
    data = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(data, "position int, v double").repartition(7)


def check(spark, groups, residue):
    values = table(spark, groups)
    found = exact_quantiles(values, spans_of(values), PROBS, residue_rows=residue)
    for g, raw in groups.items():
        assert found[g] == pytest.approx(np.quantile(np.array(raw, float), PROBS), rel=1e-12), g


@pytest.mark.parametrize("residue", [3, 40, 1_000_000])
def test_equal_to_numpy_for_every_shape(spark, residue):
    rng = np.random.default_rng(1)
    check(spark, {
        0: rng.normal(size=1500),
        1: rng.integers(0, 6, 1500),
        2: np.exp(rng.normal(0, 12, 1500)),
        3: [7.0] * 900 + list(rng.uniform(size=600)),
        4: [0.1] * 50,
        5: [3.0],
        6: [1.0, 2.0],
        7: np.concatenate([rng.normal(size=700), [1e300, -1e300, 5e-324]]),
        8: -np.exp(rng.normal(0, 20, 800)),
    }, residue)


def test_infinite_values_and_full_double_range(spark):
    values = [float("-inf"), -1.7e308, -1.0, 0.0, 1.0, 2.0, 3.0, 1.7e308, float("inf")] * 3
    long = table(spark, {0: values})
    found = select_ranks(long, {(0, k): Span(0, float("-inf"), float("inf"), 0, 27) for k in range(27)}, 2)
    assert [found[(0, k)] for k in range(27)] == sorted(values)


def test_hot_value_needs_no_large_residue(spark):
    hot = spark.range(200_000).selectExpr(
        "0 AS position", "CASE WHEN id % 3 = 0 THEN 42D ELSE CAST(id AS DOUBLE) END AS v")
    expected = np.where(np.arange(200_000) % 3 == 0, 42.0, np.arange(200_000, dtype=float))
    found = exact_quantiles(hot, spans_of(hot), PROBS, residue_rows=10)
    assert found[0] == pytest.approx(np.quantile(expected, PROBS))


def test_empty_group(spark):
    long = table(spark, {0: [1.0, 2.0]})
    found = exact_quantiles(long, {0: Span(0, 1.0, 2.0, 0, 2), 9: Span(9, 0.0, 0.0, 0, 0)}, (0.5,))
    assert found == {0: [1.5], 9: [None]}


def test_tiny_magnitudes_take_few_passes(spark, monkeypatch):
    raw = np.exp(np.random.default_rng(2).uniform(np.log(1e-300), 0, 5000))
    passes, narrow = [], quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: passes.append(1) or narrow(*a))
    values = table(spark, {0: raw})
    found = exact_quantiles(values, spans_of(values), (0.5,), residue_rows=50)
    assert found[0] == pytest.approx([np.median(raw)], rel=1e-12) and len(passes) <= 6


def test_numbers_beside_each_other_are_counted_where_they_stand(spark):
    """Groups of wide rows give what the long form gives: hot values, long tails, the largest numbers, gaps."""
    rng = np.random.default_rng(11)
    n = 4_000
    table = pd.DataFrame({
        "tail": np.exp(rng.normal(0, 60, n)) * rng.choice([-1, 1], n), "hot": np.where(rng.uniform(size=n) < 0.7, 5.0, rng.normal(size=n)),
        "far": np.where(rng.uniform(size=n) < 0.3, rng.choice([np.inf, -np.inf, 1.7e308, -1.7e308, 0.0], n), rng.normal(size=n)),
        "gaps": np.where(rng.uniform(size=n) < 0.5, np.nan, rng.uniform(size=n))})
    table["code"] = rng.integers(0, 3, n)
    df = spark.createDataFrame(table).repartition(5)
    names = ["tail", "hot", "far", "gaps"]
    v = F.array(*[F.when(~F.isnan(c), F.col(c)) for c in names])
    groups = {k: (None, 0, k) for k in range(4)} | {4 + 4 * c + k: (0, c, k) for c in (1, 2) for k in range(4)}
    wide = Wide(df.select(F.array(F.col("code").cast("int")).alias("codes"), v.alias("v")), groups)
    parts = [df.filter("true" if by is None else f"code = {level}").select(F.lit(g).alias("position"), F.col(names[k]).alias("v"))
             for g, (by, level, k) in groups.items()]
    long = reduce(type(df).unionAll, parts).filter(~F.isnan("v"))
    spans = spans_of(long)
    want = exact_quantiles(long, spans, PROBS, residue_rows=50)
    assert len(want) == 12
    for residue in (50, 100_000):
        got = exact_quantiles(wide, spans, PROBS, residue_rows=residue)
        assert {g: list(map(str, x)) for g, x in got.items()} == {g: list(map(str, x)) for g, x in want.items()}
