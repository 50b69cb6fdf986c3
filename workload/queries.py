"""The registered queries: every operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from frameprobe.operators import (
    categorical, columns, correlation, distinct, grouped, numeric, paths, profile, sampling)
from frameprobe.plans import analysis
from frameprobe.session import scratch_path
from frameprobe.sources import csv

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a fixed number of decimals, so that summation order does not show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders, with three values read as "missing"."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"),
        F.expr("CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice END").alias("o_totalprice"),
        "o_orderdate",
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"))


# --- univariate numeric ------------------------------------------------------------------------

@query
def describe_lineitem(spark, sf_dir):
    return rounded(numeric.describe(table(spark, sf_dir, "lineitem")))


@query
def describe_orders_gaps(spark, sf_dir):
    return rounded(numeric.describe(orders_with_gaps(spark, sf_dir)))


@query
def hist_lineitem(spark, sf_dir):
    return rounded(numeric.histogram(table(spark, sf_dir, "lineitem")))


@query
def hist_orders_gaps(spark, sf_dir):
    return rounded(numeric.histogram(orders_with_gaps(spark, sf_dir)))


@query
def markers_orders(spark, sf_dir):
    return rounded(numeric.markers(table(spark, sf_dir, "orders")))


@query
def kde_lineitem_quantity(spark, sf_dir):
    return rounded(numeric.kde(table(spark, sf_dir, "lineitem"), ["l_quantity"]))


@query
def kde_customer(spark, sf_dir):
    return rounded(numeric.kde(table(spark, sf_dir, "customer"), ["c_acctbal"]))


@query
def box_lineitem(spark, sf_dir):
    return rounded(numeric.box_summary(table(spark, sf_dir, "lineitem")))


@query
def outliers_events(spark, sf_dir):
    return rounded(numeric.outliers(table(spark, sf_dir, "events")))


@query
def fliers_events(spark, sf_dir):
    return numeric.fliers(table(spark, sf_dir, "events"))


@query
def fliers_customer(spark, sf_dir):
    return numeric.fliers(table(spark, sf_dir, "customer"))


# --- profile -----------------------------------------------------------------------------------

@query
def table_profile_events(spark, sf_dir):
    return rounded(profile.table_profile(table(spark, sf_dir, "events")))


@query
def table_profile_documents(spark, sf_dir):
    return rounded(profile.table_profile(table(spark, sf_dir, "documents")))


@query
def missing_orders_nulls(spark, sf_dir):
    return rounded(profile.missing_values(orders_with_gaps(spark, sf_dir)))


@query
def missing_counts_orders(spark, sf_dir):
    return rounded(profile.missing_counts(orders_with_gaps(spark, sf_dir)))


@query
def duplicate_rows_labels(spark, sf_dir):
    return profile.duplicate_rows(table(spark, sf_dir, "labels").select("quality", "toxic"))


@query
def duplicate_rows_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", F.expr("nullif(l_returnflag, 'N')"),
        F.expr("nullif(l_linestatus, 'F')"))
    return profile.duplicate_rows(rows)


@query
def column_profile_customer(spark, sf_dir):
    return rounded(profile.column_profile(table(spark, sf_dir, "customer")))


@query
def column_profile_documents(spark, sf_dir):
    return rounded(profile.column_profile(table(spark, sf_dir, "documents")))


@query
def column_profile_events(spark, sf_dir):
    return rounded(profile.column_profile(table(spark, sf_dir, "events")))


def labelled_orders(spark, sf_dir):
    """orders, with columns that the type rules must tell apart."""
    return orders_with_gaps(spark, sf_dir).select(
        F.col("o_orderkey").alias("order_id"),
        F.expr("CAST(o_orderstatus = 'F' AS INT)").alias("is_final"),
        F.expr("CAST(o_orderstatus = 'F' AS INT)").alias("final_count"),
        F.expr("o_orderstatus = 'F'").alias("final"),
        F.expr("CASE WHEN o_totalprice > 200000 THEN ' Yes' ELSE 'no' END").alias("large"),
        F.expr("date_format(o_orderdate, 'yyyy-MM-dd')").alias("ordered_on"),
        "o_orderdate", "o_totalprice", "o_orderpriority",
        F.expr("concat('ref ', o_orderkey, '/', o_custkey)").alias("reference"))


@query
def column_profile_orders_typed(spark, sf_dir):
    return rounded(profile.column_profile(labelled_orders(spark, sf_dir)))


@query
def id_columns_part(spark, sf_dir):
    return profile.id_columns(table(spark, sf_dir, "part"))


@query
def id_columns_events(spark, sf_dir):
    return profile.id_columns(table(spark, sf_dir, "events"))


@query
def group_columns_lineitem(spark, sf_dir):
    return columns.grouping_columns(table(spark, sf_dir, "lineitem"))


@query
def group_columns_part(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("costly", F.col("p_retailprice") > 1000)
    return columns.grouping_columns(df, max_cardinality=columns.BAR_LEVELS)


@query
def numeric_columns_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = columns.numeric_column_table(df)
    counts = profile.column_counts(df).select("position", "non_null")
    return found.join(counts, "position")


@query
def complete_rows_orders(spark, sf_dir):
    return columns.complete_rows(orders_with_gaps(spark, sf_dir), ["o_totalprice", "o_orderstatus"])


@query
def exclude_ids_events(spark, sf_dir):
    found = profile.column_profile(table(spark, sf_dir, "events"))
    return columns.exclude_ids(found.select("column", "position", "semantic_type"),
                               found.filter("is_id"))


@query
def overview_orders(spark, sf_dir):
    return rounded(profile.overview(table(spark, sf_dir, "orders")))


@query
def kind_counts_orders_typed(spark, sf_dir):
    return profile.kind_counts(profile.column_profile(labelled_orders(spark, sf_dir)))


@query
def fingerprint_lineitem(spark, sf_dir):
    return profile.fingerprint(table(spark, sf_dir, "lineitem"), "lineitem")


# --- grouping columns --------------------------------------------------------------------------

@query
def category_freq_lineitem(spark, sf_dir):
    return rounded(categorical.category_frequencies(table(spark, sf_dir, "lineitem")))


@query
def category_freq_events(spark, sf_dir):
    return rounded(categorical.category_frequencies(table(spark, sf_dir, "events")))


@query
def category_freq_orders_gaps(spark, sf_dir):
    df = orders_with_gaps(spark, sf_dir).withColumn("costly", F.col("o_totalprice") > 300000)
    return rounded(categorical.category_frequencies(df, max_categories=3))


@query
def crosstab_lineitem(spark, sf_dir):
    return categorical.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query
def crosstab_part_names(spark, sf_dir):
    return categorical.crosstab(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query
def crosstab_pct_documents(spark, sf_dir):
    return rounded(categorical.crosstab_percent(table(spark, sf_dir, "documents"), [("lang", "source")]))


@query
def cramers_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return rounded(categorical.cramers_v(df, [("l_returnflag", "l_linestatus")]).drop("pair"))


@query
def cramers_rank_orders(spark, sf_dir):
    df = orders_with_gaps(spark, sf_dir).withColumn("costly", F.col("o_totalprice") > 300000)
    return rounded(categorical.cramers_ranking(df))


def graded_lineitem(df: DataFrame) -> DataFrame:
    """22 grouping columns: both flags, and remainders of the keys, some of them missing."""
    grades = [F.expr(f"CASE WHEN l_partkey % {11 + k} = 0 THEN NULL ELSE "
                     f"concat('g', (l_orderkey * {k + 3} + l_suppkey + l_linenumber * {k}) % {2 + k % 8}) END").alias(f"g{k}")
              for k in range(20)]
    return df.select("l_returnflag", "l_linestatus", *grades)


@query
def cramers_many_lineitem(spark, sf_dir):
    """All pairs of 22 grouping columns."""
    return rounded(categorical.cramers_ranking(graded_lineitem(table(spark, sf_dir, "lineitem")), 1000).drop("rank"))


ETA_CATS = {"l_returnflag": 3, "l_linestatus": 2, "line": 7, "month": 12, "day": 31}


@query
def eta_lineitem(spark, sf_dir):
    return rounded(grouped.eta_squared(table(spark, sf_dir, "lineitem")).drop("cat", "num"))


@query
def eta_many_lineitem(spark, sf_dir):
    """Five grouping columns with up to 2 * 3 * 7 * 12 * 31 combinations."""
    df = table(spark, sf_dir, "lineitem").select(
        "*", F.col("l_linenumber").cast("string").alias("line"),
        F.month("l_shipdate").cast("string").alias("month"), F.dayofmonth("l_shipdate").cast("string").alias("day"))
    return rounded(grouped.eta_squared(df, ETA_CATS, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
                   .drop("cat", "num"))


@query
def eta_rank_orders(spark, sf_dir):
    df = orders_with_gaps(spark, sf_dir).withColumn("costly", F.col("o_totalprice") > 300000)
    return rounded(grouped.eta_ranking(df))


@query
def eta_rank_part(spark, sf_dir):
    return rounded(grouped.eta_ranking(table(spark, sf_dir, "part")))


@query
def grouped_box_lineitem(spark, sf_dir):
    return rounded(grouped.grouped_box(
        table(spark, sf_dir, "lineitem"),
        [("l_returnflag", "l_extendedprice"), ("l_linestatus", "l_quantity")]))


@query
def grouped_box_part(spark, sf_dir):
    return rounded(grouped.grouped_box(table(spark, sf_dir, "part"), [("p_brand", "p_retailprice")]))


# --- numeric pairs -----------------------------------------------------------------------------

@query
def corr_lineitem(spark, sf_dir):
    return rounded(correlation.correlation(table(spark, sf_dir, "lineitem")))


@query
def corr_orders_gaps(spark, sf_dir):
    df = orders_with_gaps(spark, sf_dir).select(
        "o_orderkey", "o_custkey", "o_totalprice", F.expr("length(o_orderpriority)").alias("width"),
        F.expr("CASE WHEN o_totalprice IS NULL THEN 0.1D END").alias("mark"), F.lit(0.1).alias("flat"))
    return rounded(correlation.correlation(df))


@query
def corr_topvar_lineitem(spark, sf_dir):
    return rounded(correlation.correlation(table(spark, sf_dir, "lineitem"), max_correlated=4))


@query
def top_variance_lineitem(spark, sf_dir):
    return rounded(correlation.top_variance(table(spark, sf_dir, "lineitem"), 5), 4)


@query
def pair_rank_lineitem(spark, sf_dir):
    return rounded(correlation.pair_ranking(table(spark, sf_dir, "lineitem")))


@query
def trend_lineitem(spark, sf_dir):
    return rounded(correlation.trend(table(spark, sf_dir, "lineitem")))


def row_draw(*texts: str) -> "Column":
    """A number in [0, 1) from the row's MD5, the same in any engine."""
    row = F.md5(F.concat_ws("|", *[F.expr(t) for t in texts], F.lit("42")))
    return F.conv(F.substring(row, 1, 13), 16, 10).cast("bigint") / F.lit(2.0 ** 52)


ORDERS_TEXTS = ("CAST(o_orderkey AS STRING)", "CAST(o_custkey AS STRING)", "o_orderstatus",
                "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING)", "o_orderpriority")
PART_TEXTS = ("CAST(p_partkey AS STRING)", "CAST(p_size AS STRING)",
              "CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS STRING)")


@query
def sample_orders(spark, sf_dir):
    return sampling.sample_rows(table(spark, sf_dir, "orders"), 60, draw=row_draw(*ORDERS_TEXTS))


@query
def scatter_part(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    sample = sampling.sample_rows(df, correlation.SCATTER_ROWS, draw=row_draw(*PART_TEXTS))
    return rounded(correlation.scatter_points(
        df, [("p_retailprice", "p_partkey"), ("p_size", "p_partkey")], sample))


@query
def trend_band_part(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    points = correlation.scatter_points(df, [("p_retailprice", "p_partkey")])
    return rounded(correlation.trend_band(points))


@query
def trend_band_retail(spark, sf_dir):
    """The band over all rows, without a sample."""
    df = table(spark, sf_dir, "part")
    points = correlation.scatter_points(df, [("p_retailprice", "p_partkey")], sample=df)
    return rounded(correlation.trend_band(points), 4)


def widened_lineitem(df: DataFrame) -> DataFrame:
    """60 numeric columns, and a text between them."""
    return df.select(*[F.expr(f"l_partkey % {k + 7} + l_linenumber * {k}").alias(f"n{k}") for k in range(30)], "l_returnflag",
                     *[F.expr(f"l_quantity * {k} + l_suppkey % {k}").alias(f"n{k}") for k in range(30, 60)])


@query
def markers_wide_lineitem(spark, sf_dir):
    """The first 50 of 60 numeric columns."""
    return rounded(numeric.markers(widened_lineitem(table(spark, sf_dir, "lineitem")), max_cols=50))


@query
def distinct_states_orders(spark, sf_dir):
    """States of old and of new rows, stored and merged: do the bounds hold the exact number?"""
    df = table(spark, sf_dir, "orders").drop("o_orderdate")
    paths = [scratch_path(spark, "states") for _ in range(2)]
    for k, path in enumerate(paths):
        distinct.distinct_states(df.where(F.col("o_orderkey") % 3 == 0 if k else F.col("o_orderkey") % 3 != 0)).write.parquet(path)
    merged = distinct.merged_states(*map(spark.read.parquet, paths))
    exact = profile.column_profile(df).select("column", F.col("n_unique").alias("exact"))
    return distinct.distinct_estimates(merged).join(exact, "column").select(
        "column", "rows", "present", "exact", F.col("exact").between(F.col("low"), F.col("high")).alias("held"))


# --- sources -----------------------------------------------------------------------------------

def as_texts(df: DataFrame) -> DataFrame:
    """Every column as text, as it would stand in a CSV file."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp")
                       else F.col(c).cast("string").alias(c) for c, t in df.dtypes])


def written_csv(df: DataFrame, sep: str = ",") -> str:
    """The table written as CSV files in the shared folder."""
    path = scratch_path(df.sparkSession, "csv")
    as_texts(df).write.options(header=True, sep=sep, quote='"', escape='"', nullValue="NA").csv(path)
    return path


@query
def csv_roundtrip_orders(spark, sf_dir):
    return csv.load_csv(spark, written_csv(orders_with_gaps(spark, sf_dir), ";"))


@query
def csv_roundtrip_customer(spark, sf_dir):
    return csv.load_csv(spark, written_csv(table(spark, sf_dir, "customer")))


@query
def csv_roundtrip_documents(spark, sf_dir):
    """Texts with line breaks, quotes and blanks at their ends."""
    df = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "csv")
    df.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                     ignoreTrailingWhiteSpace=False).csv(path)
    return csv.load_csv(spark, path)


@query
def csv_latin1_customer(spark, sf_dir):
    df = as_texts(table(spark, sf_dir, "customer")).withColumn("c_name", F.concat("c_name", F.lit(" Renée")))
    path = scratch_path(spark, "csv")
    df.write.options(header=True, encoding="ISO-8859-1").csv(path)
    return csv.load_csv(spark, path)


@query
def csv_max_rows_orders(spark, sf_dir):
    """The first rows by place in the files, which are written in order of the key."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = scratch_path(spark, "csv")
    df.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.options(header=True).csv(path)
    return csv.load_csv(spark, path, max_rows=700)


@query
def csv_guards_orders(spark, sf_dir):
    """Which inputs made of orders are refused."""
    df = as_texts(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    paths = {name: scratch_path(spark, "csv") for name in ("sound", "headers", "surplus", "blank", "no_rows")}
    df.write.options(header=True).csv(paths["sound"])
    for part in (df, df.select("o_custkey", "o_orderkey", "o_orderstatus")):
        part.write.mode("append").options(header=True).csv(paths["headers"])
    cells = F.concat_ws(",", *df.columns)
    more = F.when(F.col("o_orderstatus") == "P", F.concat(cells, F.lit(",x"))).otherwise(cells)
    # one column without a tab, so that neither its name, the header, nor its cells are quoted
    df.select(more.alias(",".join(df.columns))).write.options(header=True, sep="\t").csv(paths["surplus"])
    df.select(F.lit(" ")).write.text(paths["blank"])
    df.limit(1).select(F.lit("a,b")).write.text(paths["no_rows"])

    def refused(name: str, **options) -> bool:
        try:
            csv.load_csv(spark, paths[name], **options)
            return False
        except ValueError:
            return True

    rows = [(name, refused(name)) for name in paths]
    return spark.createDataFrame([*rows, ("size", refused("sound", max_size_mb=0.001))],
                                 "input string, refused boolean")


@query
def csv_headers_orders(spark, sf_dir):
    """A header with repeated and empty names."""
    df = as_texts(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"))
    path = scratch_path(spark, "csv")
    df.select(F.concat_ws(",", *df.columns).alias("key,x,x,x_1,")).write.options(header=True, sep="\t").csv(path)
    return csv.load_csv(spark, path)


# Date texts of each further format, made of the order time ``at``.
DATE_TEXTS = {
    "iso_utc": "date_format(at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    "iso_offset": "date_format(at, \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\")",
    "half_day": "date_format(at, 'M/d/yyyy h:mm a')",
    "short_year": "date_format(at, 'M/d/yy')",
    "tenths": "date_format(at, \"yyyy-MM-dd HH:mm:ss'.5'\")",
    "named_month": "date_format(at, 'MMM d, yyyy')",
    "slashed_minutes": "date_format(at, 'yyyy/MM/dd HH:mm')",
    "clock": "date_format(at, 'HH:mm:ss')",
}


@query
def datetime_formats_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn(
        "at", F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, o_orderkey % 86400)"))
    texts = df.select(F.col("o_orderkey").cast("string").alias("o_orderkey"),
                      *[F.expr(e).alias(n) for n, e in DATE_TEXTS.items()])
    return csv.apply_types(texts, csv.column_types(texts).collect())


def text_orders(spark, sf_dir):
    """orders as texts, with columns whose type is decided by few odd values."""
    return as_texts(orders_with_gaps(spark, sf_dir)).select(
        "*", F.expr("CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'false' END").alias("closed"),
        F.expr("CASE WHEN try_cast(o_totalprice AS DOUBLE) < 20000 THEN 'unknown' ELSE o_orderdate END")
        .alias("mostly_date"),
        F.expr("CASE WHEN try_cast(o_totalprice AS DOUBLE) < 100000 THEN 'unknown' ELSE o_orderdate END")
        .alias("partly_date"),
        F.expr("concat(o_orderkey, 'd')").alias("with_unit"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 'N/A' ELSE CAST(o_custkey AS STRING) END").alias("half"))


@query
def csv_types_orders(spark, sf_dir):
    return csv.column_types(text_orders(spark, sf_dir)).select("column", "verdict")


@query
def datetime_probe_orders(spark, sf_dir):
    typed = csv.apply_types(text_orders(spark, sf_dir).select("o_orderkey", "mostly_date"),
                            csv.column_types(text_orders(spark, sf_dir)
                                             .select("o_orderkey", "mostly_date")).collect())
    return typed


@query
def delimiter_pick(spark, sf_dir):
    lines = as_texts(table(spark, sf_dir, "lineitem"))
    return rounded(csv.delimiter_scores(lines.select(F.concat_ws("|", *lines.columns).alias("value"))))


@query
def delimiter_pick_documents(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return rounded(csv.delimiter_scores(lines))


# --- names and paths ---------------------------------------------------------------------------

@query
def safe_names_pages(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("input"))
    return paths.safe_names(df, "input")


@query
def safe_names_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return paths.safe_names(df, "text").select("doc_id", "safe")


@query
def safe_folders_pages(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("folder"), F.lit("x").alias("name"))
    return paths.safe_paths(df).select("page_id", "safe_folder")


@query
def unique_paths_part(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("position"), F.col("p_type").alias("folder"), F.col("p_name").alias("name"))
    return paths.unique_paths(df)


@query
def path_audit_pages(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?:", "").alias("path"))
    return paths.path_audit(df, max_path_len=40)


@query
def path_audit_part(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        F.expr("concat(CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END, '/', p_brand, "
               "CASE WHEN p_size < 5 THEN '.' WHEN p_size = 7 THEN ' ' ELSE '.png' END)").alias("path"))
    return paths.path_audit(df)


# --- report ------------------------------------------------------------------------------------

@query
def report_manifest_lineitem(spark, sf_dir):
    return analysis.analyze(table(spark, sf_dir, "lineitem")).manifest


@query
def report_manifest_orders_capped(spark, sf_dir):
    return analysis.analyze(orders_with_gaps(spark, sf_dir), max_items=12).manifest


@query
def written_report_orders(spark, sf_dir):
    """The sink: write a report, read its frequency table back."""
    path = scratch_path(spark, "report")
    analysis.write_report(analysis.analyze(orders_with_gaps(spark, sf_dir), max_items=12), path)
    return rounded(spark.read.parquet(f"{path}/03_categorical_distributions/cats"))


@query
def written_report_lineitem(spark, sf_dir):
    """The sink without a cap: every table of the report, read back, with its rows."""
    path = scratch_path(spark, "report")
    analysis.write_report(analysis.analyze(table(spark, sf_dir, "lineitem")), path)
    counts = [df.select(F.lit(name).alias("name"), F.lit(1).alias("one")) for name, df in analysis.read_report(spark, path).items()]
    return reduce(DataFrame.unionAll, counts).groupBy("name").agg(F.count("*").alias("rows"))
