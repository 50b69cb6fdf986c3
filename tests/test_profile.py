import datetime as dt

import pytest

from frameprobe.functions.columns import unique_names, with_unique_names
from frameprobe.operators import columns, profile


def kinds(df):
    return {r.column: r.semantic_type for r in profile.column_profile(df).collect()}


def one(spark, values, name, sql_type):
    return kinds(spark.createDataFrame([(v,) for v in values], f"`{name}` {sql_type}"))[name]


@pytest.mark.parametrize("values, name, sql_type, expected", [
    ([5] * 5, "constant_num", "long", "numeric"),
    (["apple"] * 3, "constant_str", "string", "categorical"),
    ([None] * 3, "all_null", "double", "high_cardinality_text"),
    ([float("nan")] * 3, "all_nan", "double", "high_cardinality_text"),
    ([f"ID_{i:04d}" for i in range(100)], "customer_id", "string", "high_cardinality_text"),
    (["2024-01-01", "2024-01-02", "2024-01-03"], "dates", "string", "datetime"),
    (["2024-01-01", "2024-13-02", "2024-01-03"], "bad_dates", "string", "categorical"),
    ([True, False, True], "is_admin", "boolean", "boolean"),
    ([0, 1, 0, 1, 0, 1], "visit_count", "long", "numeric"),
    ([0, 1, 0, 1, 0, 1], "Is_Active", "long", "boolean"),
    ([0, 1, 2, 1], "is_active", "long", "numeric"),
    ([1, 1, 1], "has_it", "long", "numeric"),
    (["yes", "no", " YES ", "n"], "consented", "string", "boolean"),
    (["a", "b", None], "few", "string", "categorical"),
    ([f"v{i % 20}" for i in range(40)], "half", "string", "categorical"),
    ([f"v{i % 21}" for i in range(40)], "more", "string", "high_cardinality_text"),
    ([dt.date(2024, 1, 1)] * 2, "day", "date", "datetime"),
    ([[1, 2], [3]], "nested", "array<int>", "high_cardinality_text"),
])
def test_semantic_types(spark, values, name, sql_type, expected):
    assert one(spark, values, name, sql_type) == expected


def test_cardinality_follows_the_semantic_type(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "x", 1, True, None), ("2024-01-02", "x", 2, True, None), ("2024-01-02", None, 2, False, None)],
        "day string, s string, n int, f boolean, gone string")
    found = {r.column: r.n_unique for r in profile.column_profile(df).collect()}
    assert found == {"day": None, "s": 1, "n": 2, "f": 2, "gone": 0}


def test_long_texts_count_as_themselves(spark):
    base = "x" * 500
    df = spark.createDataFrame([(base + "a",), (base + "b",), (base + "a",), ("#" + "0" * 64,)], "t string")
    assert profile.column_profile(df).first().n_unique == 3


def test_id_flags(spark):
    table = spark.createDataFrame(
        [("user_id", "high_cardinality_text", 98), ("txn_id", "numeric", 99), ("category", "categorical", 3),
         ("identifier", "categorical", 95), ("note", "high_cardinality_text", 96), ("id", "numeric", 90),
         ("when_id", "datetime", None)],
        "column string, semantic_type string, n_unique long")
    found = [r.column for r in profile.flag_id_columns(table, 100).collect()]
    assert found == ["user_id", "txn_id", "identifier", "note"]
    df = spark.createDataFrame([(i, f"user {i}", i % 3) for i in range(50)], "order_id long, name string, code int")
    assert [r.column for r in profile.id_columns(df).collect()] == ["order_id", "name"]


def test_missing_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    assert [tuple(r) for r in profile.missing_values(df).collect()] == [("s", 1, 33.33), ("x", 2, 66.67)]
    assert profile.missing_values(spark.createDataFrame([(1, 2)], "a int, b int")).count() == 0


@pytest.mark.parametrize("exact", [False, True])
def test_duplicates_tell_nulls_apart(spark, exact):
    df = spark.createDataFrame(
        [(None, 1, "long enough to be wide"), (1, None, "long enough to be wide"), (None, 1, "long enough to be wide"),
         (None, None, None), (None, None, None)], "a int, b int, c string")
    assert tuple(profile.duplicate_rows(df, exact).first()) == (5, 2)


def test_duplicates_treat_zeros_and_nans_as_equal(spark):
    df = spark.createDataFrame([(0.0, "t" * 20), (-0.0, "t" * 20), (float("nan"), None), (None, None)], "x double, s string")
    assert profile.duplicate_rows(df).first().duplicate_rows == 2
    narrow = df.select("x")
    assert profile.duplicate_rows(narrow).first().duplicate_rows == 2


def test_duplicates_with_maps_and_arrays(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, array(1.5F, 2F) AS e UNION ALL "
                   "SELECT map('b', 2, 'a', 1), array(1.5F, 2F) UNION ALL SELECT map('a', 2), array(1.5F)")
    assert profile.duplicate_rows(df).first().duplicate_rows == 1
    assert profile.table_profile(df).first()["rows"] == 3


def test_hot_row_collapses_before_the_shuffle(spark):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS a", "'some longer text' AS t")
    assert profile.duplicate_rows(df).first().duplicate_rows == 9_999


def test_table_profile_and_overview(spark):
    df = spark.createDataFrame([(1, 2.0, "abc", True), (1, 2.0, "abc", True), (2, None, None, None)],
                               "i int, x double, s string, f boolean")
    assert profile.table_profile(df).first().asDict() == {
        "rows": 3, "columns": 4, "size_bytes": 12 + 16 + 6 + 2, "size_mb": 0.0, "duplicate_rows": 1}
    r = profile.overview(df).first()
    assert (r.rows, r.numeric_columns, r.categorical_columns) == (3, 2, 2)
    empty = df.limit(0)
    assert profile.table_profile(empty).first().asDict() == {
        "rows": 0, "columns": 4, "size_bytes": 0, "size_mb": 0.0, "duplicate_rows": 0}


def test_fingerprint_follows_content_not_layout(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "a long, b double")
    base = profile.fingerprint(df).first()[0]
    assert profile.fingerprint(df.repartition(5)).first()[0] == base
    more = df.union(spark.createDataFrame([(10, 10.0)], "a long, b double"))
    twice = df.union(df.limit(1))
    renamed = df.withColumnRenamed("a", "c")
    others = [profile.fingerprint(d).first()[0] for d in (more, twice, renamed, df.withColumn("a", df.a.cast("int")))]
    assert len({base, *others, profile.fingerprint(df, "other").first()[0]}) == 6


def test_unique_names():
    assert unique_names(["x", "x", "y"]) == ["x", "x_1", "y"]
    assert unique_names(["x", "x", "x_1", "x"]) == ["x", "x_2", "x_1", "x_3"]


def test_duplicate_columns_become_unique(spark):
    df = spark.sql("SELECT 1 AS x, 2 AS x, 3 AS y")
    assert with_unique_names(df).columns == ["x", "x_1", "y"]


def test_grouping_columns(spark):
    df = spark.createDataFrame(
        [(f"k{i}", f"g{i % 3}", "one", i % 2 == 0, True, i, None, f"c{i % 40}") for i in range(80)],
        "key_id string, grp string, single string, flag boolean, always boolean, n int, gone string, many string")
    found = {r.column: r.n_unique for r in columns.grouping_columns(df).collect()}
    assert found == {"grp": 3, "flag": 2, "always": 1}
    assert [r.column for r in columns.grouping_columns(df, 40, ["grp"]).collect()] == ["flag", "always", "many"]
    assert [r.column for r in columns.numeric_column_table(df).collect()] == ["n"]


def test_estimated_cardinality_is_close(spark):
    df = spark.range(20_000).selectExpr("id", "id % 7 AS few", "CAST(id % 5000 AS STRING) AS t", "id % 2 = 0 AS f")
    exact = {r.column: r.n_unique for r in columns_of(df, False)}
    found = {r.column: r.n_unique for r in columns_of(df, True)}
    assert exact == {"id": 20_000, "few": 7, "t": 5_000, "f": 2}
    assert all(found[c] == pytest.approx(n, rel=0.15) for c, n in exact.items())


def columns_of(df, approximate):
    return profile.column_profile(df, approximate).collect()


def test_complete_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, s string")
    assert columns.complete_rows(df, ["x"]).count() == 2
    assert columns.complete_rows(df, ["x", "s"]).count() == 1


@pytest.mark.parametrize("exact", [False, True])
def test_duplicates_of_nested_values(spark, exact):
    rows = [([None, 1], ["a"], ["b"], (None, 1)), ([1, None], ["a"], ["b"], (None, 1)), ([1, None], ["a", "b"], [], (None, 1)),
            ([1, None], ["a", "b"], [], (1, None)), ([1, None], ["a", "b"], [], (1, None))]
    df = spark.createDataFrame(rows, "a array<int>, b array<string>, c array<string>, d struct<x:int,y:int>")
    assert tuple(profile.duplicate_rows(df, exact).first()) == (5, 1)
    prints = {profile.fingerprint(df.limit(0).unionAll(spark.createDataFrame([r], df.schema))).first()[0] for r in rows}
    assert len(prints) == 4


def test_padding_of_any_kind_does_not_change_the_type(spark):
    df = spark.createDataFrame([("yes\t", "2024-01-05" + " " * 80, " 2024-01-05"), ("　no", "\n2024-02-06", "2024-02-07\x1f")] * 3,
                               "a string, b string, c string")
    got = {r["column"]: r.semantic_type for r in profile.column_profile(df).collect()}
    assert got == {"a": "boolean", "b": "datetime", "c": "datetime"}


def test_table_without_rows_keeps_its_columns(spark, rows):
    empty = spark.createDataFrame([], "a int, b string, c timestamp")
    found = rows(profile.column_profile(empty))
    assert [(r["column"], r["semantic_type"], r["n_unique"], r["missing"], r["missing_pct"], r["is_id"])
            for r in found] == [(c, "high_cardinality_text", 0, 0, None, False) for c in "abc"]
    assert [r["missing"] for r in rows(profile.missing_counts(empty))] == [0, 0, 0]
