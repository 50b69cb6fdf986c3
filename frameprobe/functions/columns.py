"""Column expressions and schema helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

# White space of every script, and the four separator controls that Python's strip takes too.
BLANKS = r"(?U:[\s\x1c-\x1f])"


def col(name: str) -> Column:
    """A column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind(data_type: T.DataType) -> str:
    """The physical family of a type: numeric, boolean, datetime, string or other."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return "string"
    return "other"


def fold_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL, so that one notion of "missing" holds everywhere."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, FLOATING)}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floats else col(n) for n in df.columns
    ])


def as_double(df: DataFrame, name: str) -> Column:
    """A numeric column as double, NaN folded to NULL."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, FLOATING):
        value = col(name).cast("double")
        return F.when(~F.isnan(value), value)
    return col(name).cast("double")


def as_text(df: DataFrame, name: str) -> Column:
    """A grouping column as text; booleans read True/False."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.initcap(col(name).cast("string"))
    return col(name).cast("string")


def melt(df: DataFrame, records: Sequence[Sequence[Column]], names: Sequence[str],
         keep: Sequence[Column] = ()) -> DataFrame:
    """One output row per input row and record: the long form of a wide table.

    The generator runs inside the scan stage, so no row is moved. Aggregating the long form by an
    integer record number keeps the plan the same size for 5 or 500 columns; hundreds of separate
    aggregate expressions would leave compiled code instead.
    """
    cells = [value for record in records for value in record]
    return df.select(*keep, F.stack(F.lit(len(records)), *cells).alias(*names))


def melt_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(position in ``names``, v) for every non-missing value of the numeric columns."""
    records = [(F.lit(i), as_double(df, n)) for i, n in enumerate(names)]
    return melt(df, records, ("position", "v")).filter(F.col("v").isNotNull())


def strip(text: Column) -> Column:
    """The text without white space of any kind at either end; ``trim`` takes blanks only."""
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def round_half_even(value: Column, places: int = 2) -> Column:
    """Decimal rounding with ties to even, as array libraries round."""
    scale = float(10 ** places)
    return F.rint(value * scale) / scale


def unique_names(names: Sequence[str]) -> list[str]:
    """Make header names unique: the second ``x`` becomes ``x_1``, skipping names already there."""
    taken = set(names)
    seen: dict[str, int] = {}
    out = []
    for name in names:
        if name not in seen:
            seen[name] = 0
            out.append(name)
            continue
        number = seen[name] + 1
        while f"{name}_{number}" in taken:
            number += 1
        seen[name] = number
        taken.add(f"{name}_{number}")
        out.append(f"{name}_{number}")
    return out


def with_unique_names(df: DataFrame) -> DataFrame:
    """The same table under unique column names."""
    fresh = unique_names(df.columns)
    return df if fresh == df.columns else df.toDF(*fresh)
