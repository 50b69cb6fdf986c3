import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from frameprobe.operators import numeric


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 700
    out = pd.DataFrame({
        "a": rng.normal(10, 3, n), "b": rng.integers(0, 9, n).astype(float),
        "c": np.exp(rng.normal(0, 2, n)), "flat": np.full(n, 0.1), "gone": np.full(n, np.nan)})
    out.loc[rng.choice(n, 60, replace=False), "a"] = np.nan
    return out


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(6)


def test_describe_matches_pandas(df, frame, rows):
    expected = frame.describe().T
    expected["skewness"], expected["kurtosis"] = frame.skew(), frame.kurtosis()
    found = {r["column"]: r for r in rows(numeric.describe(df))}
    for name in frame.columns:
        r = found[name]
        got = [r[k] for k in ("count", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis")]
        want = [None if pd.isna(v) else v for v in expected.loc[name]]
        if name == "flat":  # pandas leaves rounding noise where the value is constant
            want[2], want[8], want[9] = 0.0, 0.0, 0.0
        assert got == [pytest.approx(w, rel=1e-9) if w is not None else None for w in want], name


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [1.0, 2.0, 4.0], [5.0, 5.0, 5.0, 5.0]])
def test_moments_of_few_values(spark, rows, values):
    s = pd.Series(values)
    r = rows(numeric.describe(spark.createDataFrame([(v,) for v in values], "x double")))[0]
    for key, want in (("std", s.std()), ("skewness", s.skew()), ("kurtosis", s.kurtosis())):
        assert r[key] == (None if math.isnan(want) else pytest.approx(want)), key


def test_display_rounding_is_half_even(spark, rows):
    r = rows(numeric.describe(spark.createDataFrame([(0.125,), (0.125,)], "x double"), decimals=2))[0]
    assert (r["mean"], r["max"]) == (0.12, 0.12)


def test_integers_booleans_and_nan(spark, rows):
    df = spark.createDataFrame([(1, True, float("nan")), (3, False, 2.0)], "i int, f boolean, x double")
    found = {r["column"]: r for r in rows(numeric.describe(df))}
    assert set(found) == {"i", "x"}
    assert (found["x"]["count"], found["x"]["mean"], found["i"]["q50"]) == (1, 2.0, 2.0)


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("a",)], "s string")
    for operator in (numeric.describe, numeric.histogram, numeric.kde, numeric.markers,
                     numeric.box_summary, numeric.outliers, numeric.fliers):
        assert operator(df).count() == 0


def test_histogram_equals_numpy(df, frame, rows):
    found = pd.DataFrame(rows(numeric.histogram(df)))
    assert set(found["column"]) == {"a", "b", "c", "flat"}
    for name in ("a", "b", "c"):
        data = frame[name].dropna().to_numpy()
        counts, edges = np.histogram(data, bins=np.histogram_bin_edges(data, "auto"))
        part = found[found["column"] == name].sort_values("bin")
        assert part["count"].tolist() == counts.tolist()
        assert part["lo"].to_numpy() == pytest.approx(edges[:-1])
        assert part["hi"].to_numpy() == pytest.approx(edges[1:])
    flat = found[found["column"] == "flat"].iloc[0]
    assert (flat["lo"], flat["hi"], flat["count"]) == (pytest.approx(-0.4), pytest.approx(0.6), len(frame))


def test_histogram_counts_every_value(df, frame, rows):
    found = pd.DataFrame(rows(numeric.histogram(df))).groupby("column")["count"].sum()
    assert found.to_dict() == frame.drop(columns="gone").count().to_dict()


def test_kde_equals_direct_sum(df, frame, rows):
    found = pd.DataFrame(rows(numeric.kde(df)))
    assert set(found["column"]) == {"a", "b", "c"}  # a constant has no bandwidth
    for name in ("a", "b", "c"):
        data = frame[name].dropna().to_numpy()
        h = data.std(ddof=1) * len(data) ** -0.2
        grid = np.linspace(data.min(), data.max(), 200)
        z = (grid[:, None] - data[None, :]) / h
        want = np.exp(-0.5 * z * z).sum(axis=1) / (len(data) * h * math.sqrt(2 * math.pi))
        part = found[found["column"] == name].sort_values("grid")
        assert part["x"].to_numpy() == pytest.approx(grid)
        assert part["density"].to_numpy() == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_box_summary_outliers_and_fliers(df, frame, rows):
    boxes = {r["column"]: r for r in rows(numeric.box_summary(df))}
    counts = {r["column"]: r for r in rows(numeric.outliers(df))}
    points = pd.DataFrame(rows(numeric.fliers(df)))
    assert "gone" not in boxes
    for name in ("a", "b", "c", "flat"):
        data = frame[name].dropna()
        q25, q75 = data.quantile(0.25), data.quantile(0.75)
        low, high = q25 - 1.5 * (q75 - q25), q75 + 1.5 * (q75 - q25)
        inside = data[(data >= low) & (data <= high)]
        r = boxes[name]
        assert (r["whisker_lo"], r["whisker_hi"]) == (inside.min(), inside.max())
        assert r["outliers"] == len(data) - len(inside) == counts[name]["outliers"]
        assert sorted(points.loc[points["column"] == name, "value"]) == sorted(data[~data.index.isin(inside.index)])


def test_all_null_column_is_skipped_and_names_do_not_shift(spark, rows):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1.0, 10.0), (nan, 2.0, 20.0), (nan, 3.0, 30.0)],
                               "all_nan double, val_a double, val_b double")
    markers = {r["column"]: r["mean"] for r in rows(numeric.markers(df))}
    assert markers == {"val_a": 2.0, "val_b": 20.0}


def test_first_columns_only(spark):
    df = spark.createDataFrame([tuple(float(i) for i in range(60))] * 3, ", ".join(f"c{i} double" for i in range(60)))
    assert numeric.box_summary(df).count() == 60
    assert numeric.box_summary(df, max_cols=50).count() == 50
    assert numeric.histogram(df, max_cols=3).select("column").distinct().count() == 3


def test_density_far_from_all_values(spark, rows):
    """No cut: the kernel counts as far as doubles reach, to the last digits."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 3000), [40.0] * 3, [-25.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    found = pd.DataFrame(rows(numeric.kde(df))).sort_values("grid")
    h = values.std(ddof=1) * len(values) ** -0.2
    direct = np.exp(-0.5 * ((found["x"].to_numpy()[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert found["density"].to_numpy() == pytest.approx(direct, rel=1e-10, abs=0)
    assert direct.min() < 1e-30


def test_moments_and_quartiles_of_few_values_take_one_scan(spark):
    seen = spark.sparkContext.accumulator(0)

    def through(value):
        seen.add(1)
        return float(value % 7)

    df = spark.range(0, 1_000, 1, 4).select(F.udf(through, "double")("id").alias("x"), (F.col("id") % 3).alias("y"))
    found = {s.column: s for s in numeric.column_stats(df)}
    assert (found["x"].q50, found["y"].q75, found["x"].count) == (3.0, 2.0, 1_000)
    assert seen.value == 1_000


@pytest.mark.parametrize("few, residue", [(4_096, 50_000), (5, 50_000), (4_096, 3)])
def test_statistics_equal_those_of_spark_and_numpy(spark, monkeypatch, few, residue):
    """Few values or many, in all tasks or in some; far from zero, endless, constant, missing."""
    monkeypatch.setattr(numeric, "FEW_VALUES", few)
    monkeypatch.setattr(numeric, "RESIDUE_ROWS", residue)
    rng = np.random.default_rng(2)
    n = 1_500
    frame = pd.DataFrame({
        "few": rng.integers(0, 4, n).astype(float), "many": rng.normal(size=n), "far": 1e9 + rng.normal(size=n),
        "tail": np.exp(rng.normal(0, 5, n)), "sorted": np.repeat(np.arange(n // 5), 5).astype(float), "same": np.full(n, 0.1),
        "gaps": np.where(rng.uniform(size=n) < 0.9, np.nan, rng.integers(0, 9, n)), "gone": np.full(n, np.nan),
        "endless": np.where(np.arange(n) == 77, np.inf, rng.integers(0, 3, n))})
    df = spark.createDataFrame(frame)
    df = df.unionAll(df.limit(0)).coalesce(3)
    found = {s.column: s for s in numeric.column_stats(df)}
    for name in frame.columns:
        data, s = frame[name].dropna().to_numpy(), found[name]
        assert s.count == len(data)
        if not len(data):
            continue
        own = df.filter(~F.isnan(name)).agg(F.avg(name), F.stddev_samp(name), F.skewness(name), F.kurtosis(name)).first()
        n = len(data)
        want = [own[0], *([0.0, 0.0, 0.0] if name == "same" else
                          [own[1], own[2] * math.sqrt(n * (n - 1)) / (n - 2),
                           (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * own[3] + 6)])]
        assert [s.mean, s.std, s.skewness, s.kurtosis] == pytest.approx(want, rel=1e-6, abs=1e-6, nan_ok=True), name
        assert [s.min, s.q25, s.q50, s.q75, s.max] == pytest.approx(
            [data.min(), *np.quantile(data, [0.25, 0.5, 0.75]), data.max()], rel=1e-12), name
