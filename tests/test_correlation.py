import numpy as np
import pandas as pd
import pytest

from frameprobe.operators import correlation
from frameprobe.operators.sampling import sample_rows


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    n = 500
    a = rng.normal(1e6, 2, n)
    out = pd.DataFrame({"a": a, "b": a * -2 + rng.normal(0, 3, n), "c": rng.uniform(size=n),
                        "flat": np.full(n, 0.1), "d": rng.integers(0, 50, n).astype(float), "gone": np.full(n, np.nan)})
    out.loc[rng.choice(n, 90, replace=False), "b"] = np.nan
    out.loc[rng.choice(n, 50, replace=False), "c"] = np.nan
    return out


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(7)


def test_matrix_equals_pandas(df, frame, rows):
    want = frame.corr()
    found = rows(correlation.correlation(df))
    assert len(found) == 21
    for r in found:
        x = want.loc[r["col1"], r["col2"]]
        if np.isnan(x) or "flat" in (r["col1"], r["col2"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(x, abs=1e-10)
        assert r["n"] == len(frame[list({r["col1"], r["col2"]})].dropna())


def test_constant_only_on_the_shared_rows(spark, rows):
    df = spark.createDataFrame([(0.1, float(i) if i < 5 else None) for i in range(5)]
                               + [(float(i), None) for i in range(9)], "x double, y double").repartition(6)
    assert {(r["col1"], r["col2"]): r["r"] for r in rows(correlation.correlation(df))}[("y", "x")] is None


def test_top_variance_when_wide(spark, rows):
    df = spark.createDataFrame([tuple(float(i * k) for k in range(1, 31)) for i in range(6)],
                               ", ".join(f"c{k} double" for k in range(1, 31)))
    names = correlation.heatmap_columns(df)
    assert names == [f"c{k}" for k in range(30, 5, -1)]
    assert correlation.correlation(df).count() == 25 * 26 // 2


def test_ranking_and_trend(df, frame, rows):
    found = rows(correlation.pair_ranking(df))
    assert (found[0]["col1"], found[0]["col2"], found[0]["rank"]) == ("b", "a", 1)
    assert [abs(r["r"]) for r in found] == sorted((abs(r["r"]) for r in found), reverse=True)
    assert all("flat" not in (r["col1"], r["col2"]) for r in found)
    for r in found:
        sub = frame[[r["col1"], r["col2"]]].dropna()
        slope, intercept = np.polyfit(sub[r["col1"]] - 1e6, sub[r["col2"]], 1)
        assert r["slope"] == pytest.approx(slope, rel=1e-6)
        assert r["r2"] == pytest.approx(r["r"] ** 2)
    lines = {(r["col1"], r["col2"]): r for r in rows(correlation.trend(df))}
    assert lines[("flat", "a")]["slope"] is None
    assert lines[("d", "flat")]["slope"] == pytest.approx(0.0, abs=1e-9)


def test_pairs_with_under_three_rows_leave_after_the_cut(spark, rows):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, None), (3.0, 5.0, 9.0), (4.0, 9.0, None)],
                               "a double, b double, c double")
    assert [(r["col1"], r["col2"]) for r in rows(correlation.pair_ranking(df))] == [("b", "a")]
    assert correlation.pair_ranking(df, max_pairs=1).count() == 0  # a two-row pair has |r| = 1


def test_one_column_has_no_pairs(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    for operator in (correlation.correlation, correlation.pair_ranking, correlation.trend):
        assert operator(df).count() == 0


def test_scatter_points_are_complete_rows_of_the_sample(df, rows):
    points = rows(correlation.scatter_points(df, [("b", "a"), ("c", "a")], sample_size=100))
    assert all(p["x"] is not None and p["y"] is not None for p in points)
    assert len([p for p in points if p["col1"] == "b"]) <= 100


def test_band_holds_the_line_and_has_the_expected_width(spark, rows):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 800)
    y = 3 * x + 1 + rng.normal(0, 2, 800)
    points = spark.createDataFrame([("x", "y", float(a), float(b)) for a, b in zip(x, y)],
                                   "col1 string, col2 string, x double, y double").repartition(4)
    band = pd.DataFrame(rows(correlation.trend_band(points))).sort_values("grid")
    assert len(band) == 100
    assert (band["lower"] < band["y"]).all() and (band["y"] < band["upper"]).all()
    slope, intercept = np.polyfit(x, y, 1)
    assert band["y"].to_numpy() == pytest.approx(slope * band["x"].to_numpy() + intercept)
    residual = y - slope * x - intercept
    error = np.sqrt(residual.var(ddof=2) * (1 / 800 + (band["x"] - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()))
    ratio = (band["upper"] - band["lower"]) / (2 * 1.96 * error)
    assert ratio.between(0.85, 1.15).all()


def test_sample_is_exact_and_without_replacement(spark):
    df = spark.range(50_000).repartition(6)
    for size in (1, 60, 4_000):
        found = sample_rows(df, size)
        ids = [r.id for r in found.collect()]
        assert len(ids) == len(set(ids)) == size
    assert sample_rows(df.limit(10), 60).count() == 10


def test_sample_takes_copies_of_a_hot_row_in_proportion(spark):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS x")
    hot = sample_rows(df, 1500).filter("x = -1").count()
    assert 400 < hot < 600


def test_own_draw_and_rising_threshold(spark):
    from pyspark.sql import functions as F
    df = spark.range(20_000).withColumn("t", F.lit("same"))
    late = (F.col("id") / 20_000.0) * 0.01 + 0.99  # the first thresholds let nothing through
    assert sorted(r.id for r in sample_rows(df, 20, draw=late).collect()) == list(range(20))
