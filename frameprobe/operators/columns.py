"""Choosing columns: numeric columns, grouping columns, identifier exclusion."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from frameprobe.functions.columns import col, fold_nan, kind
from frameprobe.operators.profile import column_facts

# Grouping limits: bars show up to 15 of at most 30 levels.
BAR_LEVELS = 30
CAT_NUM_LEVELS = 15
CAT_CAT_LEVELS = 10
DEFAULT_LEVELS = 25
HASH_SLOTS = 32_768


def numeric_column_table(df: DataFrame) -> DataFrame:
    """(column, position) of the numeric columns; booleans are not numeric."""
    rows = [(f.name, i) for i, f in enumerate(df.schema) if kind(f.dataType) == "numeric"]
    return df.sparkSession.createDataFrame(rows, "column string, position int")


def _with_few_levels(df: DataFrame, names: Sequence[str], most: int) -> list[str]:
    """Text columns that may have at most ``most`` levels.

    Counts the hash slots hit, a lower bound of the distinct values: a column over the limit is
    certainly over it, and its values are never shuffled.
    """
    if not names:
        return []
    row = df.agg(*[
        F.bitmap_count(F.bitmap_construct_agg(F.pmod(F.xxhash64(col(n)), F.lit(HASH_SLOTS)))).alias(f"c{i}")
        for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if row[i] <= most]


def grouping_columns(df: DataFrame, max_cardinality: int = DEFAULT_LEVELS,
                     id_cols: Iterable[str] = ()) -> DataFrame:
    """(column, position, n_unique) of the columns fit for grouping.

    Text columns with 2 to ``max_cardinality`` values and every boolean column, identifiers left
    out; dates and numbers never group.
    """
    excluded = set(id_cols)
    usable = [f for f in df.schema if f.name not in excluded]
    booleans = [f.name for f in usable if kind(f.dataType) == "boolean"]
    texts = _with_few_levels(df, [f.name for f in usable if kind(f.dataType) == "string"],
                             max_cardinality)
    names = df.sparkSession.createDataFrame(
        [(i, f.name, f.name in booleans) for i, f in enumerate(df.schema)
         if f.name in booleans or f.name in texts],
        "position int, column string, always boolean")
    facts = column_facts(df, booleans + texts).select("position", "n_unique")
    levels = F.coalesce(F.col("n_unique"), F.lit(0))
    return (F.broadcast(names).join(facts, "position", "left")
            .filter(F.col("always") | levels.between(2, max_cardinality))
            .orderBy("position")
            .select("column", "position", levels.alias("n_unique")))


def grouping_names(df: DataFrame, max_cardinality: int,
                   id_cols: Iterable[str] = ()) -> dict[str, int]:
    """Grouping column -> number of levels, in table order; one small row per column is collected."""
    return {r.column: r.n_unique for r in grouping_columns(df, max_cardinality, id_cols).collect()}


def exclude_ids(columns: DataFrame, ids: DataFrame) -> DataFrame:
    """A table of columns without the identifiers."""
    return columns.join(ids.select("column"), "column", "left_anti")


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows where every one of the columns is there, neither NULL nor NaN."""
    return fold_nan(df).na.drop(subset=list(columns))
