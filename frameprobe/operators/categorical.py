"""Frequencies of grouping columns and association between two of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from frameprobe.functions.columns import as_text, col, kind, melt
from frameprobe.functions.moments import clip01, ranked
from frameprobe.operators.columns import CAT_CAT_LEVELS, grouping_names
from frameprobe.operators.profile import TEXT_KEY_BYTES
from frameprobe.session import ensure_checkpoint_dir, short_methods

MAX_CATEGORIES = 15
MAX_CAT_CAT_PAIRS = 30
MIN_ROWS = 5
# Cells and levels that a task holds before it hands them on.
CELLS = 200_000
# No column is nullable: Spark then puts no filters of its own before the sums, and a plan that uses the
# cells several times finds them alike and makes them once.
CELL_SCHEMA = "pair int NOT NULL, value1 string NOT NULL, value2 string NOT NULL, count bigint NOT NULL"


def category_frequencies(df: DataFrame, columns: Sequence[str] | None = None,
                         max_categories: int = MAX_CATEGORIES,
                         id_cols: Iterable[str] = ()) -> DataFrame:
    """(column, value, count, pct, rank, missing, shown): the most frequent values of each column.

    ``pct`` is of all non-missing values, taken before the cut. Without ``columns`` the grouping
    columns with up to twice ``max_categories`` values are used.
    """
    if columns is None:
        columns = list(grouping_names(df, max_categories * 2, id_cols))
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, value string, count long, pct double, rank int, missing long, shown long")
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "position int, column string")
    counted = (
        melt(df, [(F.lit(i), as_text(df, n)) for i, n in enumerate(columns)], ("position", "value"))
        .groupBy("position", "value").agg(F.count("*").alias("count")))
    totals = counted.groupBy("position").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("count"))).alias("total"),
        F.least(F.count("value"), F.lit(max_categories)).alias("shown"))
    order = Window.partitionBy("position").orderBy(F.desc("count"), "value")
    top = (counted.filter(F.col("value").isNotNull())
           .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_categories))
    return (
        top.join(F.broadcast(names), "position").join(totals, "position")
        .orderBy("position", "rank")
        .select("column", "value", "count", (F.col("count") / F.col("total") * 100).alias("pct"),
                "rank", "missing", "shown"))


class _Products:
    """Products of the one-hot columns of a task's rows: counts of the cells of every column pair.

    Levels are numbered as they appear, 0 for a missing one. For each batch the product of two
    columns is taken over the occupied cells only; products are added up until CELLS are held.
    A column of ``texts`` with over ``most`` levels takes no further part; the first ``most`` + 1 tell.
    """

    def __init__(self, pairs: Sequence[tuple[int, int]], columns: int,
                 texts: Iterable[int] = (), most: int = 0):
        self.pairs = pairs
        self.columns = columns
        self.texts = list(texts)
        self.most = most
        self.levels: dict[int, set[str]] = {i: set() for i in self.texts}
        self.over: set[int] = set()
        self._clear()

    def _clear(self) -> None:
        self.codes: list[dict[str, int]] = [{} for _ in range(self.columns)]
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.pairs]
        self.held = 0

    def add(self, batch: pa.RecordBatch) -> None:
        numbered = [None if i in self.over else self._numbered(batch.column(i), known)
                    for i, known in enumerate(self.codes)]
        for i in self.texts:
            if i not in self.over and len(self.codes[i]) > self.most:
                self.over.add(i)
                self.levels[i].update(list(self.codes[i])[:self.most + 1])
                self.codes[i] = {}
                for k, pair in enumerate(self.pairs):
                    if i in pair:
                        self.parts[k] = []
        for parts, (a, b) in zip(self.parts, self.pairs):
            if a in self.over or b in self.over:
                continue
            width = len(self.codes[b]) + 1
            cells = numbered[a] * width + numbered[b]
            if (len(self.codes[a]) + 1) * width <= 4 * len(cells):
                counts = np.bincount(cells, minlength=1)
                cells = np.flatnonzero(counts)
                counts = counts[cells]
            else:
                cells, counts = np.unique(cells, return_counts=True)
            left, right = cells // width, cells % width
            both = (left > 0) & (right > 0)
            parts.append((left[both] << 32 | right[both], counts[both]))
            self.held += int(both.sum())
        if self.held > CELLS:
            self.held = 0
            for parts in filter(None, self.parts):
                cells, counts = (np.concatenate(x) for x in zip(*parts))
                cells, at = np.unique(cells, return_inverse=True)
                parts[:] = [(cells, np.bincount(at, counts, len(cells)).astype(np.int64))]
                self.held += len(cells)

    @staticmethod
    def _numbered(column: pa.Array, known: dict[str, int]) -> np.ndarray:
        """The number of each value; null is 0."""
        coded = column.dictionary_encode()
        number = np.array([known.setdefault(v, len(known) + 1) for v in coded.dictionary.to_pylist()] + [0], np.int64)
        return number[coded.indices.fill_null(len(number) - 1).to_numpy()]

    def full(self) -> bool:
        return self.held > CELLS or sum(map(len, self.codes)) > CELLS

    def handed(self) -> Iterator[pa.RecordBatch]:
        """(pair, value1, value2, count) of what is held, which is then forgotten."""
        names = [pa.array(list(known), pa.string()) for known in self.codes]
        for k, (parts, (a, b)) in enumerate(zip(self.parts, self.pairs)):
            if parts:
                cells, counts = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells), k, np.int32)), names[a].take(pa.array((cells >> 32) - 1)),
                     names[b].take(pa.array((cells & 0xFFFFFFFF) - 1)), pa.array(counts.astype(np.int64))],
                    names=["pair", "value1", "value2", "count"])
        for i in self.texts:
            self.levels[i].update(self.codes[i])
        self._clear()

    def named(self) -> Iterator[pa.RecordBatch]:
        """(-1 - column, level, "", 0) of the levels of ``texts``."""
        rows = [(-1 - i, level) for i, found in self.levels.items() for level in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string()),
             pa.array([""] * len(rows), pa.string()), pa.array([0] * len(rows), pa.int64())],
            names=["pair", "value1", "value2", "count"])


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, value1, value2, count) over the complete rows of every column pair.

    One scan for all pairs, in which no row is copied: each task multiplies the one-hot columns of
    its rows, and Spark adds up the cells.
    """
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    at = {n: i for i, n in enumerate(names)}
    return _cells([as_text(df, n).cast("string") for n in names], df, [(at[a], at[b]) for a, b in pairs])


def _cells(values: Sequence[Column], df: DataFrame, pairs: Sequence[tuple[int, int]],
           texts: Sequence[int] = (), most: int = 0) -> DataFrame:
    """CELL_SCHEMA: the cells of all pairs of ``values``, and the levels of ``texts`` under negative numbers."""
    columns = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = _Products(pairs, columns, texts, most)
        for batch in batches:
            if batch.num_rows:
                products.add(batch)
            if products.full():
                yield from products.handed()
        yield from products.handed()
        yield from products.named()

    wide = df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)])
    return (wide.mapInArrow(run, CELL_SCHEMA)
            .groupBy("pair", "value1", "value2").agg(F.sum("count").alias("count")))


def _grouping_cells(df: DataFrame, id_cols: Iterable[str], most: int) -> tuple[list[str], list[int], DataFrame]:
    """The grouping columns, the numbers of their pairs and the cells, from one scan of the table.

    Which columns group is not known before: a task counts the pairs of all text and boolean columns,
    and leaves out a text as soon as it has seen more than ``most`` levels of it.
    """
    excluded = set(id_cols)
    usable = [(f.name, kind(f.dataType)) for f in df.schema
              if f.name not in excluded and kind(f.dataType) in ("string", "boolean")]
    names = [n for n, _ in usable]
    texts = [i for i, (_, family) in enumerate(usable) if family == "string"]
    pairs = list(combinations(range(len(names)), 2))
    # Levels need only be told apart: a long one counts by its digest, which no short one can equal.
    values = [F.when(F.octet_length(col(n)) > TEXT_KEY_BYTES, F.concat(F.lit("#"), F.sha2(col(n), 256))).otherwise(col(n))
              if family == "string" else as_text(df, n) for n, family in usable]
    found = _kept(_cells(values, df, pairs, texts, most))
    levels = {-1 - r.pair: r["count"] for r in found.filter("pair < 0").groupBy("pair").count().collect()}
    groups = [i for i in range(len(names)) if i not in texts or 2 <= levels.get(i, 0) <= most]
    numbers = [k for k, (a, b) in enumerate(pairs) if a in groups and b in groups]
    return [names[i] for i in groups], numbers, found


def _kept(cells: DataFrame) -> DataFrame:
    """The cells, made now and stored: they are read several times."""
    spark = cells.sparkSession
    ensure_checkpoint_dir(spark)
    with short_methods(spark):
        return cells.checkpoint()


def _pair_names(df: DataFrame, pairs: Sequence[tuple[str, str]], numbers: Sequence[int] | None = None) -> DataFrame:
    rows = [(k, a, b) for k, (a, b) in zip(range(len(pairs)) if numbers is None else numbers, pairs)]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "pair int, col1 string, col2 string"))


def crosstab(df: DataFrame, col1: str, col2: str) -> DataFrame:
    """(col1, col2, value1, value2, count) of the complete rows; only cells that occur."""
    pairs = [(col1, col2)]
    return contingency(df, pairs).join(_pair_names(df, pairs), "pair").select(
        "col1", "col2", "value1", "value2", "count")


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col1, col2, n, chi2, v) per pair: chi-square and Cramer's V without corrections.

    -1 marks a pair with under 5 complete rows or a side with one level. Needs the occupied cells
    only: chi2 = n * (sum of count^2 / (row total * column total) - 1).
    """
    return _association(contingency(df, pairs), _pair_names(df, pairs))


def _association(cells: DataFrame, names: DataFrame) -> DataFrame:
    """``cramers_v`` from the cells of the pairs in ``names``."""
    # Joins rather than windows: a value with unboundedly many partners must not fill one task, and
    # adaptive execution splits it here. Totals of grouping columns are small and get broadcast.
    rows = cells.groupBy("pair", "value1").agg(F.sum("count").alias("r"))
    columns = cells.groupBy("pair", "value2").agg(F.sum("count").alias("c"))
    count = F.col("count").cast("double")
    ratio = (cells.join(rows, ["pair", "value1"]).join(columns, ["pair", "value2"]).groupBy("pair")
             .agg(F.sum(count * count / (F.col("r").cast("double") * F.col("c"))).alias("ratio")))
    # Either sum of totals is n; asked for on both sides, so that neither side makes cells of its own.
    summed = (rows.groupBy("pair").agg(F.sum("r").alias("n"), F.count("*").alias("levels1"))
              .join(columns.groupBy("pair").agg(F.sum("c").alias("n"), F.count("*").alias("levels2")), ["pair", "n"])
              .join(ratio, "pair"))
    n = F.col("n")
    narrow = F.least("levels1", "levels2")
    chi2 = F.greatest(F.lit(0.0), n * (F.col("ratio") - 1))
    usable = (n >= MIN_ROWS) & (narrow >= 2)
    return names.join(summed, "pair", "left").select(
        "pair", "col1", "col2", F.coalesce(n, F.lit(0)).alias("n"),
        F.when(usable, chi2).alias("chi2"),
        F.when(usable, clip01(F.sqrt(chi2 / (n * (narrow - 1))))).otherwise(-1.0).alias("v"))


def cramers_ranking(df: DataFrame, max_pairs: int = MAX_CAT_CAT_PAIRS,
                    id_cols: Iterable[str] = (), columns: Iterable[str] | None = None) -> DataFrame:
    """(col1, col2, n, chi2, v, rank): pairs of grouping columns, strongest association first."""
    if columns is None:
        columns, numbers, cells = _grouping_cells(df, id_cols, CAT_CAT_LEVELS)
    else:
        columns, numbers, cells = list(columns), None, None
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "col1 string, col2 string, n long, chi2 double, v double, rank int")
    if cells is None:
        numbers, cells = list(range(len(pairs))), _kept(contingency(df, pairs))
    names = _pair_names(df, pairs, numbers)
    order = (F.desc(ranked("v")), "pair")
    # One row per column pair, so a single ordered partition is small.
    return (_association(cells.join(names.select("pair"), "pair", "left_semi"), names).filter(F.col("v") >= 0)
            .orderBy(*order).limit(max_pairs)
            .withColumn("rank", F.row_number().over(Window.orderBy(*order)))
            .select("col1", "col2", "n", "chi2", "v", "rank"))


def crosstab_percent(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col1, col2, value1, value2, count, pct): row percentages, empty cells included."""
    cells = contingency(df, pairs)
    # One row per level on either side, joined on the pair: the grid is what is asked for. The totals go
    # with the levels, so that all three uses of the cells are alike and the table is read once.
    rows = cells.groupBy("pair", "value1").agg(F.sum("count").alias("total"))
    columns = cells.groupBy("pair", "value2").agg(F.sum("count").alias("c")).filter(F.col("c") > 0).drop("c")
    filled = rows.join(columns, "pair").join(cells, ["pair", "value1", "value2"], "left").fillna(0, ["count"])
    return (filled.withColumn("pct", F.col("count") / F.col("total") * 100)
            .join(_pair_names(df, pairs), "pair")
            .select("col1", "col2", "value1", "value2", "count", "pct"))
