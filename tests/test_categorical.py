from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from frameprobe.operators import categorical, columns, grouped
from frameprobe.session import METHOD_LIMIT


def v_of(frame, a, b):
    ct = pd.crosstab(frame[a], frame[b]).to_numpy(float)
    n = ct.sum()
    expected = ct.sum(1, keepdims=True) @ ct.sum(0, keepdims=True) / n
    return np.sqrt(((ct - expected) ** 2 / expected).sum() / (n * (min(ct.shape) - 1)))


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 400
    cat = rng.choice(list("pqrs"), n)
    return pd.DataFrame({
        "cat": np.where(rng.uniform(size=n) < 0.1, None, cat),
        "near": np.where(rng.uniform(size=n) < 0.2, "z", cat),
        "noise": rng.choice(["u", "v"], n),
        "num": rng.normal(size=n) + np.where(cat == "p", 5, 0),
        "gap": np.where(rng.uniform(size=n) < 0.3, np.nan, rng.uniform(size=n)),
        "flat": np.full(n, 0.1)})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None),
                                 "cat string, near string, noise string, num double, gap double, flat double").repartition(5)


def test_percent_of_non_null_sums_to_100(spark, rows):
    values = ["active"] * 3 + ["pending"] * 2 + [None] * 2
    found = rows(categorical.category_frequencies(spark.createDataFrame([(v,) for v in values], "status string")))
    assert [(r["value"], r["count"], r["pct"], r["rank"], r["missing"], r["shown"]) for r in found] == [
        ("active", 3, 60.0, 1, 2, 2), ("pending", 2, 40.0, 2, 2, 2)]


def test_percent_is_taken_before_the_cut_and_ties_go_by_value(spark, rows):
    values = [f"v{i:02d}" for i in range(20)] + ["v07"]
    found = rows(categorical.category_frequencies(spark.createDataFrame([(v,) for v in values], "x string")))
    assert len(found) == 15
    assert [r["value"] for r in found][:3] == ["v07", "v00", "v01"]
    assert found[0]["pct"] == pytest.approx(200 / 21)
    assert found[0]["shown"] == 15


def test_booleans_read_true_and_false(spark, rows):
    df = spark.createDataFrame([(True,), (True,), (False,), (None,)], "f boolean")
    assert [(r["value"], r["count"]) for r in rows(categorical.category_frequencies(df))] == [("True", 2), ("False", 1)]


def test_no_grouping_columns(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "n int, t string")
    assert categorical.category_frequencies(df).count() == 0
    assert categorical.cramers_ranking(df).count() == 0
    assert grouped.eta_ranking(df).count() == 0
    assert grouped.grouped_box(df, []).count() == 0


@pytest.mark.parametrize("cells", [200_000, 5])
def test_cramers_v_equals_the_full_table(df, frame, rows, cells, monkeypatch):
    monkeypatch.setattr(categorical, "CELLS", cells)  # what a task holds: everything, or next to nothing
    pairs = [("cat", "near"), ("cat", "noise"), ("near", "noise")]
    for r in rows(categorical.cramers_v(df, pairs)):
        complete = frame[[r["col1"], r["col2"]]].dropna()
        assert r["n"] == len(complete)
        assert r["v"] == pytest.approx(v_of(complete, r["col1"], r["col2"]))


@pytest.mark.parametrize("data", [
    [("a", "x")] * 3 + [("b", "y")],
    [("a", "x"), ("a", "y")] * 4,
    [("a", None)] * 9,
])
def test_cramers_v_marks_unusable_pairs(spark, data):
    df = spark.createDataFrame(data, "a string, b string")
    assert categorical.cramers_v(df, [("a", "b")]).first().v == -1.0


def test_planted_pair_ranks_first(spark, rows):
    rng = np.random.default_rng(42)
    data = [(str(rng.choice(["P", "Q"])), "Alpha" if i < 50 else "Beta", "One" if i < 50 else "Two") for i in range(100)]
    found = rows(categorical.cramers_ranking(spark.createDataFrame(data, "CatC string, CatA string, CatB string"), 1))
    assert [(r["col1"], r["col2"], r["v"], r["rank"]) for r in found] == [("CatA", "CatB", 1.0, 1)]


def test_crosstab_percent_fills_empty_cells(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), ("b", None)], "r string, c string")
    found = {(r["value1"], r["value2"]): (r["count"], r["pct"]) for r in rows(categorical.crosstab_percent(df, [("r", "c")]))}
    assert len(found) == 6
    assert found[("a", "z")] == (0, 0.0) and found[("b", "z")] == (1, 100.0)
    assert found[("a", "x")][1] == pytest.approx(200 / 3)
    assert categorical.crosstab(df, "r", "c").count() == 3


def eta_of(frame, cat, num):
    sub = frame[[cat, num]].dropna()
    total = ((sub[num] - sub[num].mean()) ** 2).sum()
    g = sub.groupby(cat)[num]
    return (g.count() * (g.mean() - sub[num].mean()) ** 2).sum() / total


@pytest.mark.parametrize("joint", [True, False])
def test_eta_equals_pandas_on_both_plans(df, frame, rows, joint):
    cats = {"cat": 4, "near": 5, "noise": 2} if joint else {"cat": 4000, "near": 5, "noise": 2}
    for r in rows(grouped.eta_squared(df, cats, ["num", "gap", "flat"])):
        assert r["n"] == len(frame[[r["cat_col"], r["num_col"]]].dropna())
        want = 0.0 if r["num_col"] == "flat" else eta_of(frame, r["cat_col"], r["num_col"])
        assert r["score"] == pytest.approx(want, abs=1e-12)


def test_eta_marks_unusable_pairs(spark, rows):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, None), ("a", 3.0, 1.0), ("b", 4.0, None)],
                               "c string, x double, y double")
    assert {r["num_col"]: r["score"] for r in rows(grouped.eta_squared(df, {"c": 2}, ["x", "y"]))} == {"x": -1.0, "y": -1.0}
    assert grouped.eta_ranking(df).count() == 0


def test_planted_number_ranks_first(spark, rows):
    rng = np.random.default_rng(123)
    planted = ["GroupA"] * 100 + ["GroupB"] * 100
    data = [(str(rng.choice(["N1", "N2", "N3"])), p, float(rng.normal(50, 10)),
             (10.0 if p == "GroupA" else 90.0) + float(rng.normal(0, 0.5))) for p in planted]
    df = spark.createDataFrame(data, "NoiseCat string, PlantedCat string, NoiseNum double, PlantedNum double")
    best = rows(grouped.eta_ranking(df))[0]
    assert (best["cat_col"], best["num_col"], best["rank"]) == ("PlantedCat", "PlantedNum", 1)


def test_ids_leave_both_sides(spark, rows):
    df = spark.createDataFrame([("a" if i % 2 else "b", i, i * 1.5) for i in range(20)], "c string, row_id int, x double")
    assert [r["num_col"] for r in rows(grouped.eta_squared(df, id_cols=["row_id"]))] == ["x"]


def test_grouped_box_matches_pandas(df, frame, rows):
    found = rows(grouped.grouped_box(df, [("cat", "num"), ("near", "gap")], top=3))
    for (cat, num), want_levels in ((("cat", "num"), 3), (("near", "gap"), 3)):
        sub = frame[[cat, num]].dropna()
        top = sub[cat].value_counts()
        part = [r for r in found if r["cat_col"] == cat]
        assert [r["count"] for r in part] == sorted(top, reverse=True)[:want_levels]
        for r in part:
            data = sub.loc[sub[cat] == r["value"], num]
            q25, q50, q75 = data.quantile([0.25, 0.5, 0.75])
            assert (r["q25"], r["q50"], r["q75"]) == pytest.approx((q25, q50, q75))
            inside = data[(data >= q25 - 1.5 * (q75 - q25)) & (data <= q75 + 1.5 * (q75 - q25))]
            assert (r["whisker_lo"], r["whisker_hi"], r["outliers"]) == (inside.min(), inside.max(), len(data) - len(inside))


def test_percentages_of_a_column_with_many_levels(spark):
    df = spark.range(1_200).select(F.concat(F.lit("k"), F.col("id")).alias("a"), (F.col("id") % 2).cast("string").alias("b"))
    got = categorical.crosstab_percent(df, [("a", "b")])
    assert got.count() == 2_400 and got.agg(F.sum("count")).first()[0] == 1_200


def test_products_of_many_levels_are_flushed_and_added(spark, monkeypatch):
    """Levels that appear again after a flush get new numbers; their cells are still added up."""
    monkeypatch.setattr(categorical, "CELLS", 50)
    data = [(f"a{i % 97}", f"b{i % 41}" if i % 7 else None, f"c{i % 3}") for i in range(2000)]
    df = spark.createDataFrame(data, "a string, b string, c string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = {(r.pair, r.value1, r.value2): r["count"]
               for r in categorical.contingency(df, [("a", "b"), ("c", "a"), ("b", "b")]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = Counter()
    for a, b, c in data:
        want[1, c, a] += 1
        if b is not None:
            want[0, a, b] += 1
            want[2, b, b] += 1
    assert got == dict(want)


def counting(spark, df, name):
    """The table with one column through a function that counts the rows it sees."""
    seen = spark.sparkContext.accumulator(0)

    def through(value):
        seen.add(1)
        return value

    return df.withColumn(name, F.udf(through, "string")(name)), seen


def test_association_works_every_row_through_once(spark):
    df = spark.range(0, 3_000, 1, 6).select(
        (F.col("id") % 4).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"),
        (F.col("id") % 10 + F.col("id") % 7).cast("string").alias("c"))
    for run in (lambda t: categorical.cramers_v(t, [("a", "b"), ("a", "c")]), categorical.cramers_ranking,
                lambda t: categorical.cramers_ranking(t, columns=["a", "b"]),
                lambda t: categorical.crosstab_percent(t, [("a", "b"), ("c", "a")])):
        counted, seen = counting(spark, df, "a")
        assert run(counted).collect()
        assert seen.value == 3_000


def test_grouping_columns_found_while_counting(spark):
    """Levels beyond the limit show in one task or only over all; long texts, gaps and booleans group too."""
    long = F.repeat(F.lit("x"), 100)
    i = F.col("id")
    df = spark.range(0, 2_400, 1, 8).select(
        (i % 10).cast("string").alias("ten"), (i % 11).cast("string").alias("eleven"),
        F.floor(i / 200).cast("string").alias("spread"), F.concat(long, (i % 3).cast("string")).alias("long"),
        (i % 5 == 0).alias("flag"), F.lit("one").alias("one"), F.expr("IF(id % 2 = 0, NULL, string(id % 6))").alias("gaps"),
        F.lit(None).cast("string").alias("gone"), i.cast("string").alias("unique"), (i % 2).cast("string").alias("out"))
    names = columns.grouping_names(df, columns.CAT_CAT_LEVELS, ["out"])
    assert list(names) == ["ten", "long", "flag", "gaps"]
    want = categorical.cramers_ranking(df, columns=names).collect()
    assert categorical.cramers_ranking(df, id_cols=["out"]).collect() == want and len(want) == 6


def test_counting_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(METHOD_LIMIT)
    categorical.cramers_ranking(spark.createDataFrame([("a", "x"), ("b", "y")] * 5, "a string, b string")).collect()
    assert spark.conf.get(METHOD_LIMIT) == before


def test_boxes_of_pairs_hand_each_row_on_once(spark, rows):
    """All pairs are counted from the rows as they stand; their levels, gaps and endless values stay apart."""
    rng = np.random.default_rng(8)
    n = 1_200
    frame = pd.DataFrame({"a": rng.choice(list("pqr"), n), "flag": rng.uniform(size=n) < 0.4, "x": rng.normal(size=n),
                          "y": np.where(rng.uniform(size=n) < 0.5, np.nan, rng.integers(0, 5, n)),
                          "z": np.where(np.arange(n) % 50 == 0, np.inf, rng.exponential(size=n))})
    frame.loc[frame["a"] == "r", "y"] = np.nan
    df = spark.createDataFrame(frame).repartition(4)
    pairs = [(c, v) for c in ("a", "flag") for v in ("x", "y", "z")]
    found = {(r["cat_col"], r["num_col"], r["value"]): r for r in rows(grouped.grouped_box(df, pairs, top=2))}
    assert len(found) == 12
    for (cat, num, value), r in found.items():
        data = np.sort(frame.loc[frame[cat].astype(str) == value, num].dropna().to_numpy())
        q25, q50, q75 = np.quantile(data, [0.25, 0.5, 0.75])
        inside = data[(data >= q25 - 1.5 * (q75 - q25)) & (data <= q75 + 1.5 * (q75 - q25))]
        assert (r["count"], r["outliers"]) == (len(data), len(data) - len(inside))
        assert (r["q25"], r["q50"], r["q75"]) == pytest.approx((q25, q50, q75))
        assert (r["whisker_lo"], r["whisker_hi"]) == (inside.min(), inside.max())
    chosen = [Row(pair=k, value=v) for k, (c, _) in enumerate(pairs) for v in (("p", "q") if c == "a" else ("True", "False"))]
    values = grouped._leveled(df, ["a", "flag"], ["x", "y", "z"], pairs, chosen)
    assert values.rows.count() == n and len(values.groups) == 12
