"""The whole first analysis of a table: chart data per section and one capped manifest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from frameprobe.functions.columns import kind, with_unique_names
from frameprobe.functions.names import TITLE_LENGTH, safe_stem
from frameprobe.operators import categorical, correlation, grouped, numeric, profile
from frameprobe.operators.columns import BAR_LEVELS, CAT_CAT_LEVELS, CAT_NUM_LEVELS
from frameprobe.operators.paths import path_audit, unique_paths
from frameprobe.operators.sampling import sample_rows

# The sections in order, with folder, file name, title and download name of an item.
SECTIONS = [
    ("summary", "00_summary"),
    ("missing", "00_summary"),
    ("dists", "01_univariate_numeric_distributions"),
    ("boxplots", "02_outlier_boxplots"),
    ("cats", "03_categorical_distributions"),
    ("corr", "04_correlation_heatmap"),
    ("scatters", "05_numeric_relationships"),
    ("cat_num", "06_cat_vs_numeric"),
    ("cat_cat", "07_cat_vs_cat"),
]
SUMMARY_ITEM = ("summary_statistics_table", "Summary Statistics Table", "summary_statistics")
MISSING_ITEM = ("missing_values_breakdown", "Missing Values Breakdown (%)", "missing_values")
CORR_ITEM = ("correlation_matrix", "Correlation Matrix", "correlation_heatmap")
MAX_ITEMS = 100

ITEM_SCHEMA = "section_no int, item_no int, name string, title string, download string"


@dataclass
class Analysis:
    """Lazy results over one table: a section is computed when it is first asked for.

    Profile facts decide the columns of every section, so they are collected once: one record per
    column. Rows never reach the driver.
    """

    df: DataFrame
    max_items: int = MAX_ITEMS
    sample_size: int | None = None
    approximate: bool = False

    def __post_init__(self):
        self.df = with_unique_names(self.df)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def release(self) -> None:
        """Free the moments kept for correlation and ranking; they are computed again when asked for."""
        kept = self.__dict__.pop("pair_moments", None)
        if kept is not None:
            kept.unpersist()

    # --- facts of the columns ------------------------------------------------------------------

    @cached_property
    def column_rows(self) -> list:
        return profile.column_profile(self.df, self.approximate).collect()

    @cached_property
    def columns(self) -> DataFrame:
        """The column profile."""
        return self.spark.createDataFrame(
            [tuple(r) for r in self.column_rows],
            "column string, position int, physical_type string, semantic_type string, n_unique long, "
            "missing long, missing_pct double, is_id boolean")

    @cached_property
    def table(self) -> DataFrame:
        """Rows, columns, size and duplicate rows."""
        return profile.table_profile(self.df)

    @property
    def overview(self) -> DataFrame:
        return profile.overview(self.df, self.columns, self.table)

    @cached_property
    def ids(self) -> list[str]:
        return [r.column for r in self.column_rows if r.is_id]

    def grouping(self, most: int) -> dict[str, int]:
        """Grouping columns with their number of levels; a text read as dates groups as well."""
        unique = {r.column: r.n_unique for r in self.column_rows}
        out, unknown = {}, []
        for f in self.df.schema:
            family = kind(f.dataType)
            if f.name in self.ids or family not in ("string", "boolean"):
                continue
            if unique[f.name] is None:
                unknown.append(f.name)
            elif family == "boolean" or 2 <= unique[f.name] <= most:
                out[f.name] = unique[f.name]
        if unknown:
            names = {i: n for i, n in enumerate(self.df.columns)}
            for r in profile.column_facts(self.df, unknown, self.approximate).collect():
                if 2 <= r.n_unique <= most:
                    out[names[r.position]] = r.n_unique
        order = self.df.columns
        return dict(sorted(out.items(), key=lambda kv: order.index(kv[0])))

    @cached_property
    def stats(self) -> list[numeric.ColumnStats]:
        return numeric.column_stats(self.df)

    # --- sections ------------------------------------------------------------------------------

    @property
    def summary(self) -> DataFrame:
        return numeric.describe(self.df, stats=self.stats)

    @property
    def missing(self) -> DataFrame:
        return self.columns.filter("missing > 0").orderBy("missing", "column").select(
            "column", "missing", "missing_pct")

    @property
    def dists(self) -> DataFrame:
        return numeric.histogram(self.df, max_cols=numeric.MAX_COLUMNS, stats=self.stats)

    @property
    def curves(self) -> DataFrame:
        return numeric.kde(self.df, max_cols=numeric.MAX_COLUMNS, stats=self.stats)

    @property
    def markers(self) -> DataFrame:
        return numeric.markers(self.df, max_cols=numeric.MAX_COLUMNS, stats=self.stats)

    @property
    def boxplots(self) -> DataFrame:
        return numeric.box_summary(self.df, max_cols=numeric.MAX_COLUMNS, stats=self.stats)

    @cached_property
    def cats(self) -> DataFrame:
        return categorical.category_frequencies(self.df, list(self.grouping(BAR_LEVELS)))

    @cached_property
    def pair_moments(self) -> DataFrame:
        """Moments of all numeric pairs, one row per pair, kept for correlation and ranking."""
        names = numeric.numeric_columns(self.df)
        known = {s.column: s.mean for s in self.stats} if "stats" in self.__dict__ else None
        centres = [known[n] for n in names] if known else None
        return correlation.pair_moments(self.df, names, centres).persist()

    @property
    def corr(self) -> DataFrame:
        shared = 2 <= len(numeric.numeric_columns(self.df)) <= correlation.MAX_CORRELATED
        return correlation.correlation(self.df, moments=self.pair_moments if shared else None)

    @cached_property
    def scatter_rows(self) -> list:
        shared = self.sample_size is None and len(numeric.numeric_columns(self.df)) >= 2
        return correlation.pair_ranking(self.df, sample_size=self.sample_size,
                                        moments=self.pair_moments if shared else None).collect()

    @property
    def scatters(self) -> DataFrame:
        return self.spark.createDataFrame(
            [tuple(r) for r in self.scatter_rows],
            "col1 string, col2 string, n long, r double, slope double, intercept double, r2 double, rank int")

    @property
    def scatter_points(self) -> DataFrame:
        return correlation.scatter_points(self.df, [(r.col1, r.col2) for r in self.scatter_rows])

    @property
    def scatter_bands(self) -> DataFrame:
        return correlation.trend_band(self.scatter_points)

    @cached_property
    def cat_num_rows(self) -> list:
        nums = [n for n in numeric.numeric_columns(self.df) if n not in self.ids]
        source = self.df if self.sample_size is None else sample_rows(self.df, self.sample_size)
        return grouped.eta_ranking(source, cats=self.grouping(CAT_NUM_LEVELS), nums=nums).collect()

    @property
    def cat_num(self) -> DataFrame:
        return self.spark.createDataFrame(
            [tuple(r) for r in self.cat_num_rows],
            "cat_col string, num_col string, n long, score double, rank int")

    @property
    def cat_num_boxes(self) -> DataFrame:
        return grouped.grouped_box(self.df, [(r.cat_col, r.num_col) for r in self.cat_num_rows])

    @cached_property
    def cat_cat_rows(self) -> list:
        return categorical.cramers_ranking(self.df, columns=self.grouping(CAT_CAT_LEVELS)).collect()

    @property
    def cat_cat(self) -> DataFrame:
        return self.spark.createDataFrame(
            [tuple(r) for r in self.cat_cat_rows],
            "col1 string, col2 string, n long, chi2 double, v double, rank int")

    @property
    def cat_cat_cells(self) -> DataFrame:
        pairs = [(r.col1, r.col2) for r in self.cat_cat_rows]
        if not pairs:
            return self.spark.createDataFrame(
                [], "col1 string, col2 string, value1 string, value2 string, count long, pct double")
        return categorical.crosstab_percent(self.df, pairs)

    # --- manifest ------------------------------------------------------------------------------

    def _items(self) -> list[tuple]:
        """Items in section order until the cap is reached; later sections are not computed."""
        out: list[tuple] = []

        def add(section: str, items: Sequence[tuple[str, str, str]]) -> None:
            number = [s for s, _ in SECTIONS].index(section)
            out.extend((number, i, *item) for i, item in enumerate(items))

        def full() -> bool:
            return len(out) >= self.max_items

        add("summary", [SUMMARY_ITEM])
        if any(r.missing for r in self.column_rows):
            add("missing", [MISSING_ITEM])
        numbers = set(numeric.numeric_columns(self.df, numeric.MAX_COLUMNS))
        charted = [r.column for r in self.column_rows if r.column in numbers and r.n_unique]
        add("dists", [(f"dist_{c}", f"Distribution: {c}", f"distribution_{c}") for c in charted])
        if not full():
            add("boxplots", [(f"boxplot_{c}", f"Boxplot: {c}", f"boxplot_{c}") for c in charted])
        if not full():
            bars = (self.cats.groupBy("column").agg(F.max("missing").alias("missing"),
                                                    F.max("shown").alias("shown")).collect())
            order = {c: i for i, c in enumerate(self.df.columns)}
            add("cats", [
                (f"cat_distribution_{i}",
                 f"Frequency: {r.column} (Top {r.shown}{f', {r.missing} missing' if r.missing else ''})",
                 f"cat_dist_{i}")
                for i, r in enumerate(sorted(bars, key=lambda r: order[r.column]), start=1)])
        if not full():
            add("corr", [CORR_ITEM])
        if not full():
            add("scatters", [(f"scatter_pair_{i}", f"{r.col1} vs {r.col2} (r = {r.r:+.2f})",
                              f"scatter_pair_{i}") for i, r in enumerate(self.scatter_rows, start=1)])
        if not full():
            add("cat_num", [
                (f"cat_num_{r.num_col}_by_{r.cat_col}", f"{r.num_col} by {r.cat_col} (η² = {r.score:.2f})",
                 f"cat_num_{r.num_col}_by_{r.cat_col}") for r in self.cat_num_rows])
        if not full():
            add("cat_cat", [
                (f"cat_cat_{r.col1}_vs_{r.col2}", f"{r.col1} vs {r.col2} (Cramér's V = {r.v:.2f})",
                 f"cat_cat_{r.col1}_vs_{r.col2}") for r in self.cat_cat_rows])
        return out

    @cached_property
    def manifest(self) -> DataFrame:
        """(ordinal, section, folder, name, title, download, path): at most ``max_items`` items."""
        return build_manifest(self.spark.createDataFrame(self._items(), ITEM_SCHEMA), self.max_items)

    def tables(self) -> dict[str, DataFrame]:
        """Every result by name."""
        return {"profile": self.overview, "columns": self.columns, "summary": self.summary,
                "missing": self.missing, "dists": self.dists, "curves": self.curves,
                "markers": self.markers, "boxplots": self.boxplots, "cats": self.cats,
                "corr": self.corr, "scatters": self.scatters, "scatter_points": self.scatter_points,
                "scatter_bands": self.scatter_bands, "cat_num": self.cat_num,
                "cat_num_boxes": self.cat_num_boxes, "cat_cat": self.cat_cat,
                "cat_cat_cells": self.cat_cat_cells, "manifest": self.manifest}


def build_manifest(items: DataFrame, max_items: int = MAX_ITEMS, extension: str = ".png") -> DataFrame:
    """Number the items over all sections, keep the first ``max_items``, give each a safe path."""
    sections = items.sparkSession.createDataFrame(
        [(i, s, f) for i, (s, f) in enumerate(SECTIONS)], "section_no int, section string, folder string")
    # At most ``max_items`` rows pass, so a single ordered partition is small.
    kept = items.orderBy("section_no", "item_no").limit(max_items).withColumn(
        "ordinal", F.row_number().over(Window.orderBy("section_no", "item_no")))
    named = kept.join(F.broadcast(sections), "section_no").select(
        "ordinal", "section", "folder", "name", "title",
        safe_stem(F.col("download"), TITLE_LENGTH, "plot").alias("download"))
    return unique_paths(named, position="ordinal", extension=extension).orderBy("ordinal").select(
        "ordinal", "section", "folder", "name", "title", "download", "path")


def analyze(df: DataFrame, max_items: int = MAX_ITEMS, sample_size: int | None = None,
            approximate: bool = False) -> Analysis:
    """The full analysis of a table. Scores use all rows unless ``sample_size`` is given.

    ``approximate=True`` estimates the numbers of distinct values, and with them which columns group
    and which are identifiers, instead of shuffling the values.
    """
    return Analysis(df, max_items, sample_size, approximate)


# Which section of the manifest each result table belongs to.
TABLE_SECTION = {
    "summary": "summary", "missing": "missing", "dists": "dists", "curves": "dists",
    "markers": "dists", "boxplots": "boxplots", "cats": "cats", "corr": "corr",
    "scatters": "scatters", "scatter_points": "scatters", "scatter_bands": "scatters",
    "cat_num": "cat_num", "cat_num_boxes": "cat_num", "cat_cat": "cat_cat", "cat_cat_cells": "cat_cat",
}


REPORT = "commit"
REPORT_SCHEMA = "table string, folder string, rows long"


def write_report(analysis: Analysis, path: str, file_format: str = "parquet",
                 mode: str = "errorifexists") -> None:
    """Write the tables of every section in the manifest under its folder, and the manifest itself.

    ``manifest`` is partitioned by section. Sections the cap left out are not computed. A report
    counts as written with its last file: the list of its tables, under ``commit``. A report that
    is replaced loses that list first, so that ``read_report`` never finds tables of two reports,
    nor part of one.
    """
    manifest = analysis.manifest
    if not path_audit(manifest).isEmpty():
        raise ValueError("the manifest holds unsafe paths")
    present = {r.section for r in manifest.select("section").distinct().collect()}
    folder = dict(SECTIONS)
    root = path.rstrip("/")
    spark = manifest.sparkSession
    places = {name: f"{folder[section]}/{name}" for name, section in TABLE_SECTION.items() if section in present}
    places |= {"columns": "columns", "overview": "profile", "manifest": "manifest"}

    def listed(rows: list[tuple[str, str, int]]) -> None:
        one = spark.createDataFrame(rows, REPORT_SCHEMA).coalesce(1)
        one.write.mode(mode).format(file_format).save(f"{root}/{REPORT}")

    if mode == "overwrite":
        listed([])
    rows = []
    for name, place in places.items():
        seen = Observation()
        writer = getattr(analysis, name).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
        (writer.partitionBy("section") if name == "manifest" else writer).format(file_format).save(f"{root}/{place}")
        rows.append((name, place, seen.get["rows"]))
    listed(rows)
    analysis.release()


def read_report(spark: SparkSession, path: str, file_format: str = "parquet") -> dict[str, DataFrame]:
    """The tables of a written report by name. ValueError where a report is not there as a whole."""
    root = path.rstrip("/")
    try:
        listed = spark.read.format(file_format).schema(REPORT_SCHEMA).load(f"{root}/{REPORT}").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        listed = []
    if not listed:
        raise ValueError(f"There is no finished report at {path}.")
    return {r.table: spark.read.format(file_format).load(f"{root}/{r.folder}") for r in listed if r.rows}
