import pytest
from pyspark.sql import functions as F

from frameprobe.operators import distinct


def estimates(states):
    return {r.column: r for r in distinct.distinct_estimates(states).collect()}


def test_old_and_new_rows_from_stored_states(spark, tmp_path):
    df = spark.range(60_000).select(
        "id", (F.col("id") % 7000).cast("double").alias("some"), F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("few"),
        F.concat(F.lit("t"), F.col("id") % 31_000).alias("text"), F.lit(None).cast("string").alias("none"))
    distinct.distinct_states(df.where("id < 40000")).write.parquet(str(tmp_path / "old"))
    distinct.distinct_states(df.where("id >= 40000")).write.parquet(str(tmp_path / "new"))
    both = distinct.merged_states(spark.read.parquet(str(tmp_path / "old")), spark.read.parquet(str(tmp_path / "new")))
    merged, whole = estimates(both), estimates(distinct.distinct_states(df))
    exact = {"id": 60_000, "some": 7000, "few": 11, "text": 31_000, "none": 0}
    for name, n in exact.items():
        assert merged[name].rows == 60_000 and merged[name].present == (40_000 if name == "few" else 0 if name == "none" else 60_000)
        assert merged[name].low <= n <= merged[name].high
        assert merged[name].n_unique == pytest.approx(n, rel=0.025)
        assert whole[name].n_unique == pytest.approx(merged[name].n_unique, rel=0.02)


def test_values_that_are_one(spark):
    df = spark.createDataFrame([(0.0, b"\x00"), (-0.0, b"\xff"), (float("nan"), b"\x00"), (None, None)], "x double, b binary")
    found = estimates(distinct.distinct_states(df))
    assert (found["x"].n_unique, found["x"].present, found["b"].n_unique) == (1, 2, 2)
    assert distinct.distinct_states(df.limit(0)).count() == 0
    assert distinct.distinct_states(df, []).count() == 0
