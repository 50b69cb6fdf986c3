"""Table and column profile: counts, size, missing values, duplicates, cardinality, types, ids."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from frameprobe.functions.columns import (
    FLOATING, as_double, col, kind, melt, round_half_even, strip)
from frameprobe.functions.dates import DATE_FORMATS, date_like, parses_as, shape_of

# Fixed values of the type rules.
BOOLEAN_WORDS = ["true", "false", "t", "f", "yes", "no", "y", "n"]
BOOLEAN_NAME_STARTS = ("is_", "has_", "flag_")
BOOLEAN_NAMES = ("active", "enabled", "selected")
ID_NAMES = ("id", "identifier")
ID_NAME_END = "_id"
TEXT_ID_RATIO = 0.95
NAMED_ID_RATIO = 0.90
FEW_LEVELS = 10
CATEGORY_RATIO = 0.5

# Texts longer than this are grouped by their SHA-256 digest instead of being shuffled whole.
TEXT_KEY_BYTES = 64
FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def present(df: DataFrame, name: str) -> Column:
    """True where a value is there: neither NULL nor NaN."""
    if isinstance(df.schema[name].dataType, FLOATING):
        return col(name).isNotNull() & ~F.isnan(col(name))
    return col(name).isNotNull()


def _byte_size(df: DataFrame, name: str) -> Column:
    """Logical bytes of one value: its fixed width, or the length of its text or binary form."""
    data_type = df.schema[name].dataType
    width = FIXED_WIDTH.get(type(data_type))
    if width is not None:
        return F.when(present(df, name), F.lit(width)).otherwise(F.lit(0))
    if isinstance(data_type, T.DecimalType):
        return F.when(col(name).isNotNull(), F.lit(8 if data_type.precision <= 18 else 16)).otherwise(F.lit(0))
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col(name)), F.lit(0))
    return F.coalesce(F.octet_length(F.to_json(F.struct(col(name)))), F.lit(0))


# --- counts per column -------------------------------------------------------------------------

def column_counts(df: DataFrame) -> DataFrame:
    """(position, rows, non_null, size_bytes) of every column, from one scan; zeros for a table without
    rows."""
    records = [(F.lit(i), present(df, n), _byte_size(df, n)) for i, n in enumerate(df.columns)]
    counted = melt(df, records, ("position", "there", "bytes")).groupBy("position").agg(
        F.count("*").alias("rows"), F.count_if("there").alias("non_null"),
        F.sum(F.col("bytes").cast("bigint")).alias("size_bytes"))
    every = df.sparkSession.createDataFrame([(i,) for i in range(len(df.columns))], "position int")
    # One row per column, so the counts can be broadcast.
    return every.join(F.broadcast(counted), "position", "left").fillna(0)


def _missing_pct() -> Column:
    """Percent of all rows at 2 decimals, NULL where there is no row."""
    return F.when(F.col("rows") > 0,
                  round_half_even((F.col("rows") - F.col("non_null")) / F.col("rows") * 100))


def _names(df: DataFrame) -> DataFrame:
    """(position, column, physical_type and what the name alone decides), one row per column."""
    rows = []
    for i, field in enumerate(df.schema):
        lower = field.name.lower()
        rows.append((i, field.name, field.dataType.simpleString(), kind(field.dataType),
                     lower.startswith(BOOLEAN_NAME_STARTS) or lower in BOOLEAN_NAMES,
                     lower.endswith(ID_NAME_END) or lower in ID_NAMES))
    return F.broadcast(df.sparkSession.createDataFrame(
        rows, "position int, column string, physical_type string, family string, "
              "boolean_name boolean, id_name boolean"))


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct) of every column; percent of all rows at 2 decimals."""
    missing = F.col("rows") - F.col("non_null")
    return column_counts(df).join(_names(df), "position").orderBy("position").select(
        "column", missing.alias("missing"),
        _missing_pct().alias("missing_pct"))


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with missing values only, fewest first; empty on complete data."""
    return missing_counts(df).filter(F.col("missing") > 0).orderBy("missing", "column")


# --- duplicate rows ----------------------------------------------------------------------------

def comparable(df: DataFrame) -> DataFrame:
    """The row with values that can be grouped and hashed: NaN as NULL, one zero, nested values as JSON."""
    out = []
    for field in df.schema:
        if isinstance(field.dataType, FLOATING):
            value = F.when(~F.isnan(col(field.name)), col(field.name) + F.lit(0.0))
        elif isinstance(field.dataType, T.MapType):
            value = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(field.name)))))
        elif isinstance(field.dataType, (T.ArrayType, T.StructType)):
            # a hash skips NULLs inside nested values and does not see where an array ends
            value = F.to_json(F.struct(col(field.name)), {"ignoreNullFields": "false"})
        else:
            value = col(field.name)
        out.append(value.alias(field.name))
    return df.select(*out)


def _row_digest(df: DataFrame, seed: int) -> Column:
    """A 64-bit row hash. The NULL flags are hashed too: the hash alone skips NULLs, so it would
    confuse (NULL, 1) with (1, NULL)."""
    flags = [col(n).isNull() for n in df.columns]
    return F.xxhash64(F.lit(seed), *[col(n) for n in df.columns], *flags)


def distinct_rows(df: DataFrame, exact: bool = False) -> DataFrame:
    """(rows, distinct_rows), NULLs equal to each other.

    Copies of one row collapse on the map side, so a hot row costs nothing. Rows are grouped by
    two independent 64-bit hashes, which moves 16 bytes per row; two rows out of 10^12 share both by
    chance with probability about 10^-15. ``exact=True`` groups the rows themselves.
    """
    rows = comparable(df)
    if exact:
        keys = [col(n) for n in rows.columns]
    else:
        keys = [_row_digest(rows, 1).alias("h1"), _row_digest(rows, 2).alias("h2")]
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"))


def duplicate_rows(df: DataFrame, exact: bool = False) -> DataFrame:
    """(rows, duplicate_rows): rows equal to an earlier one."""
    return distinct_rows(df, exact).select(
        "rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"))


# --- cardinality and semantic types ------------------------------------------------------------

def _text_key(name: str) -> Column:
    """A text as group key; long ones as '#' + SHA-256, which no short text can equal.

    Padded texts stay as they are, since without the padding they may be words or dates.
    """
    long_text = (F.octet_length(col(name)) > TEXT_KEY_BYTES) & (F.octet_length(strip(col(name))) > TEXT_KEY_BYTES)
    return F.when(long_text, F.concat(F.lit("#"), F.sha2(col(name), 256))).otherwise(col(name))


def _values(df: DataFrame, columns: dict[int, Column], approximate: bool) -> tuple[DataFrame, Column]:
    """Values to look at per column, each once unless only an estimate is wanted, and their number."""
    long = melt(df, [(F.lit(i), c) for i, c in columns.items()], ("position", "v"))
    there = long.filter(F.col("v").isNotNull())
    if approximate:
        return there, F.approx_count_distinct("v")
    return there.groupBy("position", "v").agg(F.lit(1).alias("_")), F.count("*")


def _number_facts(df: DataFrame, numbers: dict[int, Column], approximate: bool) -> DataFrame | None:
    if not numbers:
        return None
    values, unique = _values(df, numbers, approximate)
    return values.groupBy("position").agg(unique.alias("n_unique"),
                                          F.min("v").cast("double").alias("lo"),
                                          F.max("v").cast("double").alias("hi"))


def column_facts(df: DataFrame, columns: Sequence[str] | None = None,
                 approximate: bool = False) -> DataFrame:
    """(position, n_unique, lo, hi, all_boolean_words, all_dates) from the distinct values.

    Each type family is unpivoted and grouped by (column, value) apart, so keys stay in their own
    type, every column is read once and repeated values collapse before the shuffle. Text rules run
    on distinct values only. Dates and nested values have no cardinality. ``approximate=True``
    estimates the cardinality instead and shuffles no values at all.
    """
    wanted = set(df.columns if columns is None else columns)
    whole, floating, text = {}, {}, {}
    for i, field in enumerate(df.schema):
        if field.name not in wanted:
            continue
        family = kind(field.dataType)
        if family == "boolean":
            whole[i] = col(field.name).cast("int").cast("bigint")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            whole[i] = col(field.name).cast("bigint")
        elif family == "numeric":
            floating[i] = as_double(df, field.name)
        elif family == "string":
            text[i] = _text_key(field.name)
    parts = [p for p in (_number_facts(df, whole, approximate),
                          _number_facts(df, floating, approximate)) if p is not None]
    if text:
        v = F.col("v")
        values, unique = _values(df, text, approximate)
        # Every format has a separator, so a column that parses has one in each value.
        parsed = [F.bool_and(parses_as(F.col("date"), F.col("shape"), f)).alias(f"d{k}")
                  for k, f in enumerate(DATE_FORMATS)]
        # A SHA-256 key stands for a long text, which is neither a boolean word nor a date.
        parts.append(
            values.withColumn("date", date_like(v)).withColumn("shape", shape_of(F.col("date")))
            .groupBy("position").agg(
                unique.alias("n_unique"),
                F.bool_and(F.lower(strip(v)).isin(BOOLEAN_WORDS)).alias("all_boolean_words"), *parsed)
            .select("position", "n_unique", "all_boolean_words",
                    F.greatest(*[F.col(f"d{k}") for k in range(len(DATE_FORMATS))]).alias("all_dates")))
    schema = ("position int, n_unique long, lo double, hi double, all_boolean_words boolean, "
              "all_dates boolean")
    out = df.sparkSession.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def semantic_type(family: Column, non_null: Column) -> Column:
    """numeric, boolean, datetime, categorical or high_cardinality_text."""
    categorical = (F.col("n_unique") <= FEW_LEVELS) | (F.col("n_unique") / non_null <= CATEGORY_RATIO)
    zero_one = (F.col("lo") == 0) & (F.col("hi") == 1) & (F.col("n_unique") == 2)
    return (
        F.when(non_null == 0, "high_cardinality_text")
        .when(family == "boolean", "boolean")
        .when(family == "datetime", "datetime")
        .when((family == "string") & F.col("all_boolean_words"), "boolean")
        .when((family == "string") & F.col("all_dates"), "datetime")
        .when((family == "string") & categorical, "categorical")
        .when((family == "numeric") & F.col("boolean_name") & zero_one, "boolean")
        .when(family == "numeric", "numeric")
        .otherwise("high_cardinality_text")
    )


def is_id(kind_of: Column, id_name: Column, n_unique: Column, rows: Column) -> Column:
    """Likely surrogate key: nearly unique text, or a column named like an id and nearly unique."""
    ratio = F.when(rows > 0, F.coalesce(n_unique, F.lit(0)) / rows).otherwise(0.0)
    return (((kind_of == "high_cardinality_text") & (ratio > TEXT_ID_RATIO))
            | (id_name & (ratio > NAMED_ID_RATIO)))


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: column, position, physical_type, semantic_type, n_unique, missing,
    missing_pct, is_id. ``approximate=True`` estimates n_unique and what follows from it."""
    facts = column_facts(df, approximate=approximate)
    joined = (column_counts(df).join(_names(df), "position").join(facts, "position", "left"))
    typed = joined.withColumn("semantic_type", semantic_type(F.col("family"), F.col("non_null")))
    # Dates have no cardinality; a column without any value has none distinct.
    unique = F.when((F.col("semantic_type") != "datetime") & (F.col("family") != "other"),
                    F.coalesce(F.col("n_unique"), F.lit(0)))
    missing = F.col("rows") - F.col("non_null")
    return (
        typed.withColumn("n_unique", unique)
        .select("column", F.col("position"), "physical_type", "semantic_type", "n_unique",
                missing.alias("missing"),
                _missing_pct().alias("missing_pct"),
                is_id(F.col("semantic_type"), F.col("id_name"), F.col("n_unique"),
                      F.col("rows")).alias("is_id"))
        .orderBy("position")
    )


def id_columns(df: DataFrame) -> DataFrame:
    """(column, position) of the likely identifiers."""
    return column_profile(df).filter("is_id").select("column", "position")


def flag_id_columns(columns: DataFrame, rows: int) -> DataFrame:
    """Identifier flags over a table (column, semantic_type, n_unique) that is already there."""
    lower = F.lower("column")
    named = lower.endswith(ID_NAME_END) | lower.isin(*ID_NAMES)
    return columns.filter(is_id(F.col("semantic_type"), named, F.col("n_unique"), F.lit(rows)))


def table_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """(rows, columns, size_bytes, size_mb, duplicate_rows) in one row."""
    size = column_counts(df).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))
    both = distinct_rows(df, exact).unionByName(size, allowMissingColumns=True)
    return both.agg(
        F.max("rows").alias("rows"), F.max("size_bytes").alias("size_bytes"),
        F.max(F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"),
    ).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), "size_bytes",
        round_half_even(F.col("size_bytes") / 1048576).alias("size_mb"), "duplicate_rows")


def kind_counts(columns: DataFrame) -> DataFrame:
    """(numeric_columns, categorical_columns) of a column profile; ids are not categorical."""
    return columns.agg(
        F.count_if(F.col("semantic_type") == "numeric").alias("numeric_columns"),
        F.count_if(F.col("semantic_type").isin("categorical", "boolean") & ~F.col("is_id"))
        .alias("categorical_columns"))


def overview(df: DataFrame, columns: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """Rows, columns, numeric and categorical columns, size and duplicate rows in one row."""
    table = table_profile(df) if table is None else table
    kinds = kind_counts(column_profile(df) if columns is None else columns)
    both = table.unionByName(kinds, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in (
        "rows", "columns", "numeric_columns", "categorical_columns", "size_bytes", "size_mb",
        "duplicate_rows")])


def _cell_text(df: DataFrame, name: str) -> Column:
    """A comparable value as text from which it can be told: its length and its letters, '-' for NULL."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.BinaryType):
        text = F.hex(col(name))
    elif isinstance(data_type, T.TimestampType):  # whatever the time zone of the session
        text = F.unix_micros(col(name)).cast("string")
    else:
        text = col(name).cast("string")
    return F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-"))


def fingerprint(df: DataFrame, source: str = "") -> DataFrame:
    """(fingerprint): changes with the rows, their number of copies, names, types or source.

    A multiset hash: the SHA-256 of each row's text is cut into four numbers of 64 bits, and each is
    added up over the rows modulo 2^64. The order of the rows and the file layout do not matter.
    """
    rows = comparable(df)
    digest = F.sha2(F.concat(*[_cell_text(rows, n) for n in rows.columns], F.lit("")).cast("binary"), 256)
    lanes = [F.conv(F.substring("digest", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)") for k in range(4)]
    modulus = F.lit(str(2 ** 64)).cast("decimal(38,0)")
    sums = [(F.coalesce(F.sum(lane), F.lit(0)).cast("decimal(38,0)") % modulus).cast("string").alias(f"lane{k}")
            for k, lane in enumerate(lanes)]
    schema = json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema])
    return rows.select(digest.alias("digest")).agg(*sums, F.count("*").alias("n")).select(
        F.sha2(F.concat_ws("|", *[f"lane{k}" for k in range(4)], F.col("n").cast("string"),
                           F.lit(schema), F.lit(source)).cast("binary"), 256).alias("fingerprint"))
