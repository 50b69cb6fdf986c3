"""Univariate numeric operators: summary, histogram, density curve, box summary, outliers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from frameprobe.functions import moments
from frameprobe.functions.columns import as_double, kind, melt, melt_numeric, round_half_even
from frameprobe.operators.quantiles import RESIDUE_ROWS, Span, Wide, counted_quantiles, exact_quantiles
from frameprobe.session import ensure_checkpoint_dir, short_methods

# Columns that the analysis charts; the operators themselves take all unless told otherwise.
MAX_COLUMNS = 50
QUARTILES = (0.25, 0.5, 0.75)
WHISKER_REACH = 1.5
GRID_POINTS = 200
# Boxes of a bandwidth, and terms of the kernel's series about a box: see ``kde`` for the error.
KERNEL_BOXES = 4
KERNEL_TERMS = 36
# Boxes that a task holds before it hands their sums on.
HELD_BOXES = 50_000
# A column with up to so many distinct values in each task is counted by value while its moments are taken.
FEW_VALUES = 4_096


@dataclass(frozen=True)
class ColumnStats:
    """What one statistics pass learns of one numeric column."""

    column: str
    count: int
    mean: float | None
    std: float | None
    min: float | None
    max: float | None
    skewness: float | None
    kurtosis: float | None
    q25: float | None = None
    q50: float | None = None
    q75: float | None = None

    @property
    def fences(self) -> tuple[float, float]:
        reach = WHISKER_REACH * (self.q75 - self.q25)
        return self.q25 - reach, self.q75 + reach


def numeric_columns(df: DataFrame, max_cols: int | None = None) -> list[str]:
    """Numeric columns in table order, the first ``max_cols`` of them."""
    names = [f.name for f in df.schema if kind(f.dataType) == "numeric"]
    return names if max_cols is None else names[:max_cols]


class _Surveyed:
    """Moments of one column over a task's rows, and its values with their counts while they are few."""

    def __init__(self):
        self.n, self.total, self.mean, self.sums = 0, 0.0, 0.0, np.zeros(3)
        self.lo, self.hi = math.inf, -math.inf
        self.counts: list[tuple[np.ndarray, np.ndarray]] | None = []
        self.held = 0

    def add(self, v: np.ndarray) -> None:
        """Values, at least one: their sum in the order of the rows, their moments by those about their own mean."""
        with np.errstate(all="ignore"):
            self.total = float(np.cumsum(np.concatenate([[self.total], v]))[-1])
        v = np.sort(v)
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        values, counts = v[first], np.diff(np.append(first, len(v)))
        with np.errstate(all="ignore"):
            n, mean = len(v), float((values * counts).sum() / len(v))
            off = values - mean
            square = counts * off * off
            added = np.array([square.sum(), (square * off).sum(), (square * off * off).sum()])
            total = self.n + n
            apart = mean - self.mean if self.n else 0.0
            old, new = -apart * n / total, apart * self.n / total
            self.sums = _moved(self.n, self.sums, old) + _moved(n, added, new)
            self.mean = self.mean + apart * n / total if self.n else mean
        self.n = total
        self.lo, self.hi = min(self.lo, float(v[0])), max(self.hi, float(v[-1]))
        if self.counts is not None:
            self.counts.append((values, counts))
            self.held += len(values)
            if self.held > 4 * FEW_VALUES or len(values) > FEW_VALUES:
                self.counts = [self.counted()]
                self.held = len(self.counts[0][0])
                if self.held > FEW_VALUES:
                    self.counts = None

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate([v for v, _ in self.counts]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([n for _, n in self.counts]), len(values)).astype(np.int64)


def _moved(n: int, sums: np.ndarray, d: float) -> np.ndarray:
    """Sums of the second to fourth powers of the distances to a mean, ``d`` away from that mean."""
    m2, m3, m4 = sums
    return np.array([m2 + n * d * d, m3 + 3 * d * m2 + n * d ** 3, m4 + 4 * d * m3 + 6 * d * d * m2 + n * d ** 4])


SURVEY_SCHEMA = ("position int, part int, v double, n long, total double, mean double, m2 double, m3 double, m4 double, "
                 "lo double, hi double, few boolean")


def _survey(rows: DataFrame, columns: int) -> DataFrame:
    """SURVEY_SCHEMA from one scan: a row with the moments for each task and column (``part`` from 0), and
    the counts of the values (``part`` -1) of tasks that found few of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Surveyed] = {}
        for batch in batches:
            if batch.num_rows:
                wide = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, columns)
                for i in range(columns):
                    v = wide[:, i]
                    v = v[~np.isnan(v)]
                    if len(v):
                        held.setdefault(i, _Surveyed()).add(v)
        part = TaskContext.get().partitionId()
        rows = [(i, part, None, s.n, s.total, s.mean, *s.sums.tolist(), s.lo, s.hi, s.counts is not None) for i, s in held.items()]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), *[pa.float64()] * 7, pa.bool_()]
        names = [field.split()[0] for field in SURVEY_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
        for i, s in held.items():
            if s.counts is not None:
                values, counts = s.counted()
                size = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, i), pa.int32()), pa.array(np.full(size, -1), pa.int32()), pa.array(values),
                     pa.array(counts), *(pa.nulls(size, kind) for kind in kinds[4:])], names=names)

    rest = ("total", "mean", "m2", "m3", "m4", "lo", "hi", "few")
    return rows.mapInArrow(run, SURVEY_SCHEMA).groupBy("position", "part", "v").agg(
        F.sum("n").alias("n"), *[F.max(c).alias(c) for c in rest])


def _merged_moments(survey: DataFrame) -> DataFrame:
    """(position, n, mean, std, lo, hi, skewness, kurtosis, few): one row per column."""
    parts = survey.filter("part >= 0")
    n, d = F.col("n"), F.col("mean") - F.col("centre")
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    centres = parts.groupBy("position").agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("centre"))
    merged = parts.join(F.broadcast(centres), "position").groupBy("position").agg(
        (F.sum("total") / F.sum(n)).alias("mean"), F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.sum(n).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and("few").alias("few"))
    return merged.select(
        "position", "n", "mean", moments.std_of(n, m2).alias("std"), "lo", "hi",
        moments.skewness_of(n, m2, m3).alias("skewness"), moments.kurtosis_of(n, m2, m4).alias("kurtosis"), "few")


def column_stats(df: DataFrame, columns: Sequence[str] | None = None,
                 quartiles: bool = True) -> list[ColumnStats]:
    """Statistics of the numeric columns, collected: one record per column.

    They decide the bins, fences and bandwidths of the passes that follow.
    """
    names = numeric_columns(df) if columns is None else list(columns)
    if not names:
        return []
    rows = df.select(F.array().cast("array<int>").alias("codes"), F.array(*[as_double(df, n) for n in names]).alias("v"))
    ensure_checkpoint_dir(df.sparkSession)
    with short_methods(df.sparkSession):
        survey = _survey(rows, len(names)).checkpoint()
    found = {r.position: r for r in _merged_moments(survey).collect()}
    points: dict[int, list] = {}
    if quartiles:
        counts = survey.filter("part < 0").select("position", "v", "n")
        sizes = {r.position: r["count"] for r in counts.groupBy("position").count().collect()}
        few = {i for i, r in found.items() if r.few and sizes[i] <= RESIDUE_ROWS}
        spans = {i: Span(i, r.lo, r.hi, 0, r.n) for i, r in found.items()}
        points = counted_quantiles(counts, {i: spans[i] for i in few}, QUARTILES)
        many = sorted(set(spans) - few)
        if many:
            wide = Wide(rows.select("codes", F.array(*[F.get("v", F.lit(i)) for i in many]).alias("v")),
                        {i: (None, 0, k) for k, i in enumerate(many)})
            points |= exact_quantiles(wide, {i: spans[i] for i in many}, QUARTILES)
    out = []
    for i, name in enumerate(names):
        r = found.get(i)
        if r is None:
            out.append(ColumnStats(name, 0, *[None] * 6))
            continue
        out.append(ColumnStats(name, r.n, r["mean"], r["std"], r.lo, r.hi, r.skewness, r.kurtosis,
                               *points.get(i, ())))
    return out


def _stats(df: DataFrame, columns, max_cols, stats) -> list[ColumnStats]:
    names = numeric_columns(df, max_cols) if columns is None else list(columns)
    if stats is None:
        return [s for s in column_stats(df, names) if s.count]
    chosen = set(names)
    return [s for s in stats if s.count and s.column in chosen]


def describe(df: DataFrame, columns: Sequence[str] | None = None, decimals: int | None = None,
             stats: list[ColumnStats] | None = None) -> DataFrame:
    """Summary statistics of every numeric column; ``decimals=2`` gives the display rounding."""
    names = numeric_columns(df) if columns is None else list(columns)
    found = column_stats(df, names) if stats is None else [s for s in stats if s.column in names]
    table = df.sparkSession.createDataFrame(
        [(i, s.column, s.count, s.mean, s.std, s.min, s.q25, s.q50, s.q75, s.max, s.skewness,
          s.kurtosis) for i, s in enumerate(found)],
        "position int, column string, count long, mean double, std double, min double, q25 double, "
        "q50 double, q75 double, max double, skewness double, kurtosis double")
    if decimals is not None:
        for name in ("mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"):
            table = table.withColumn(name, round_half_even(F.col(name), decimals))
    return table.orderBy("position").drop("position")


def markers(df: DataFrame, columns: Sequence[str] | None = None, max_cols: int | None = None,
            stats: list[ColumnStats] | None = None) -> DataFrame:
    """(column, mean, median): the vertical markers of a distribution chart."""
    found = _stats(df, columns, max_cols, stats)
    return df.sparkSession.createDataFrame([(s.column, s.mean, s.q50) for s in found],
                                           "column string, mean double, median double")


# --- histogram ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Bins:
    """Equal-width bins over [lo, hi], the last one closed on the right."""

    lo: float
    hi: float
    count: int

    @property
    def step(self) -> float:
        return (self.hi - self.lo) / self.count


def auto_bins(s: ColumnStats) -> Bins:
    """The automatic rule: Freedman-Diaconis, bounded by half the square-root and by Sturges."""
    spread = s.max - s.min
    if spread == 0:
        return Bins(s.min - 0.5, s.max + 0.5, 1)
    freedman = 2.0 * (s.q75 - s.q25) * s.count ** (-1.0 / 3.0)
    root = spread / math.sqrt(s.count)
    sturges = spread / (math.log2(s.count) + 1.0)
    width = min(max(freedman, root / 2), sturges)
    return Bins(s.min, s.max, max(1, math.ceil(spread / width)))


def histogram(df: DataFrame, columns: Sequence[str] | None = None, max_cols: int | None = None,
              stats: list[ColumnStats] | None = None) -> DataFrame:
    """(column, bin, lo, hi, count) per automatic bin, empty bins included.

    The edges come from a table of one row per column, so binning is one scan with a map-side
    combine. A guessed bin is settled against the printed edges: counts agree with them exactly.
    """
    found = _stats(df, columns, max_cols, stats)
    if not found:
        return df.sparkSession.createDataFrame(
            [], "column string, bin int, lo double, hi double, count long")
    bins = [auto_bins(s) for s in found]
    table = df.sparkSession.createDataFrame(
        [(i, s.column, b.lo, b.hi, b.step, b.count) for i, (s, b) in enumerate(zip(found, bins))],
        "position int, column string, first double, last double, step double, bins int")
    first, step, last_bin = F.col("first"), F.col("step"), F.col("bins") - 1
    v, guess = F.col("v"), F.col("guess")
    share = (v - first) / (F.col("last") - first)
    settled = (F.when(v < guess * step + first, guess - 1)
               .when((guess < last_bin) & (v >= (guess + 1) * step + first), guess + 1)
               .otherwise(guess))
    rows = (
        melt_numeric(df, [s.column for s in found]).join(F.broadcast(table.drop("column")), "position")
        .select("position", "v", "first", "step", "bins",
                F.least(F.floor(share * F.col("bins")).cast("int"), last_bin).alias("guess"))
        .groupBy("position", settled.alias("bin")).agg(F.count("*").alias("count")))
    empty = table.select("position", F.explode(F.sequence(F.lit(0), last_bin)).alias("bin"),
                         F.lit(0).cast("bigint").alias("count"))
    counted = rows.unionByName(empty).groupBy("position", "bin").agg(F.sum("count").alias("count"))
    return counted.join(F.broadcast(table), "position").select(
        "column", "bin", (F.col("bin") * step + first).alias("lo"),
        F.when(F.col("bin") == last_bin, F.col("last")).otherwise((F.col("bin") + 1) * step + first).alias("hi"),
        "count")


# --- density curve -----------------------------------------------------------------------------

def kde(df: DataFrame, columns: Sequence[str] | None = None, max_cols: int | None = None,
        stats: list[ColumnStats] | None = None) -> DataFrame:
    """(column, grid, x, density): Gaussian kernel with Scott's bandwidth on 200 points.

    A fast Gauss transform. Values fall into boxes of a quarter bandwidth; with t the distance of a
    value from the middle of its box and u that of a grid point, in bandwidths, the kernel is
    exp(-u^2/2) * exp(u t - t^2/2), and the sums of exp(-t^2/2) t^k / k! over a box say all about it.
    Each task adds up these sums, Spark adds them by box, and then a box is laid on the grid once,
    whatever it holds. |t| is at most 1/8 and |u| 38.7 where exp(-u^2/2) is not 0 in double
    precision; by the remainder of the exponential series the relative error of a box is below
    |u t|^36 / 36! * exp(2 |u t|), at most 2e-13, also far from all values.
    """
    found = [s for s in _stats(df, columns, max_cols, stats) if s.count > 1 and s.std]
    if not found:
        return df.sparkSession.createDataFrame([], "column string, grid int, x double, density double")
    curves = [(s.min, s.max, s.std * s.count ** (-0.2)) for s in found]
    points, terms = GRID_POINTS, KERNEL_TERMS
    names = ["position", "box", *(f"m{k}" for k in range(terms))]

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[int, np.ndarray]] = [{} for _ in curves]

        def handed():
            at = np.repeat(np.arange(len(held)), [len(x) for x in held])
            sums = np.array([m for x in held for m in x.values()]).reshape(-1, terms)
            box = np.array([b for x in held for b in x], np.int64)
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(box), *(pa.array(sums[:, k].copy()) for k in range(terms))], names=names)

        for batch in batches:
            for i, (lo, _, bandwidth) in enumerate(curves):
                values = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                values, weight = np.unique(values[~np.isnan(values)], return_counts=True)
                place = (values - lo) / bandwidth
                box = np.floor(place * KERNEL_BOXES).astype(np.int64)
                t = place - (box + 0.5) / KERNEL_BOXES
                boxes, at = np.unique(box, return_inverse=True)
                term = weight * np.exp(-0.5 * t * t)
                sums = np.empty((len(boxes), terms))
                for k in range(terms):
                    sums[:, k] = np.bincount(at, term, len(boxes))
                    term = term * t / (k + 1)
                for b, m in zip(boxes.tolist(), sums):
                    held[i][b] = held[i][b] + m if b in held[i] else m
            if sum(map(len, held)) > HELD_BOXES:
                yield handed()
        if any(held):
            yield handed()

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros((len(curves), points))
        for batch in batches:
            position = batch.column(0).to_numpy()
            for i in np.unique(position).tolist():
                lo, hi, bandwidth = curves[i]
                here = np.flatnonzero(position == i)
                for first in range(0, len(here), 1024):
                    some = here[first:first + 1024]
                    middle = (batch.column(1).to_numpy()[some] + 0.5) / KERNEL_BOXES
                    u = (np.linspace(lo, hi, points) - lo)[:, None] / bandwidth - middle
                    kernel = np.exp(-0.5 * u * u)
                    u[kernel == 0] = 0
                    total = np.zeros_like(u)
                    for k in reversed(range(terms)):
                        total = total * u + batch.column(2 + k).to_numpy()[some]
                    mass[i] += (kernel * total).sum(axis=1)
        at, g = np.nonzero(mass)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(g, pa.int32()), pa.array(mass[at, g])],
            names=["position", "grid", "mass"])

    boxes = (df.select(*[as_double(df, s.column).alias(f"c{i}") for i, s in enumerate(found)])
             .mapInArrow(boxed, "position int, box long, " + ", ".join(f"{n} double" for n in names[2:]))
             .groupBy("position", "box").agg(*[F.sum(n).alias(n) for n in names[2:]]))
    sums = boxes.mapInArrow(laid, "position int, grid int, mass double").groupBy("position", "grid").agg(F.sum("mass").alias("mass"))
    table = df.sparkSession.createDataFrame(
        [(i, s.column, s.min, s.max, s.count * h * math.sqrt(2 * math.pi))
         for i, (s, (_, _, h)) in enumerate(zip(found, curves))],
        "position int, column string, lo double, hi double, scale double")
    every = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))).alias("grid"))
    at = F.col("grid") * ((F.col("hi") - F.col("lo")) / (GRID_POINTS - 1)) + F.col("lo")
    return every.join(sums, ["position", "grid"], "left").select(
        "column", "grid", F.when(F.col("grid") == GRID_POINTS - 1, F.col("hi")).otherwise(at).alias("x"),
        (F.coalesce("mass", F.lit(0.0)) / F.col("scale")).alias("density"))


# --- box summary -------------------------------------------------------------------------------

BOX_SCHEMA = ("position int, column string, count long, q25 double, q50 double, q75 double, "
              "lower_fence double, upper_fence double")


def _box_table(df: DataFrame, found: list[ColumnStats]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, s.column, s.count, s.q25, s.q50, s.q75, *s.fences) for i, s in enumerate(found)],
        BOX_SCHEMA)


def _fenced(df: DataFrame, found: list[ColumnStats]) -> DataFrame:
    """(position, v, lower, upper) with each column's fences as constants in the plan."""
    records = [(F.lit(i), as_double(df, s.column), F.lit(s.fences[0]), F.lit(s.fences[1]))
               for i, s in enumerate(found)]
    return melt(df, records, ("position", "v", "lower", "upper")).filter(F.col("v").isNotNull())


def box_summary(df: DataFrame, columns: Sequence[str] | None = None, max_cols: int | None = None,
                stats: list[ColumnStats] | None = None) -> DataFrame:
    """Quartiles, fences, whiskers (extreme data inside the fences) and outlier count per column."""
    found = _stats(df, columns, max_cols, stats)
    table = _box_table(df, found)
    if not found:
        return table.select("column", "count", "q25", "q50", "q75", "lower_fence", "upper_fence",
                            F.lit(None).cast("double").alias("whisker_lo"),
                            F.lit(None).cast("double").alias("whisker_hi"),
                            F.lit(None).cast("bigint").alias("outliers"))
    v, lower, upper = F.col("v"), F.col("lower"), F.col("upper")
    reached = _fenced(df, found).groupBy("position").agg(
        F.min(F.when(v >= lower, v)).alias("whisker_lo"),
        F.max(F.when(v <= upper, v)).alias("whisker_hi"),
        F.count_if((v < lower) | (v > upper)).alias("outliers"))
    return reached.join(F.broadcast(table), "position").orderBy("position").select(
        "column", "count", "q25", "q50", "q75", "lower_fence", "upper_fence",
        "whisker_lo", "whisker_hi", "outliers")


def outliers(df: DataFrame, columns: Sequence[str] | None = None, max_cols: int | None = None,
             stats: list[ColumnStats] | None = None) -> DataFrame:
    """(column, lower_fence, upper_fence, below, above, outliers): values strictly outside."""
    found = _stats(df, columns, max_cols, stats)
    table = _box_table(df, found)
    v = F.col("v")
    rows = (_fenced(df, found) if found
            else table.select("position", F.lit(0.0).alias("v"), F.lit(0.0).alias("lower"),
                              F.lit(0.0).alias("upper")))
    counted = rows.groupBy("position").agg(
        F.count_if(v < F.col("lower")).alias("below"), F.count_if(v > F.col("upper")).alias("above"))
    return counted.join(F.broadcast(table), "position").select(
        "column", "lower_fence", "upper_fence", "below", "above",
        (F.col("below") + F.col("above")).alias("outliers"))


def fliers(df: DataFrame, columns: Sequence[str] | None = None, max_cols: int | None = None,
           stats: list[ColumnStats] | None = None) -> DataFrame:
    """(column, value): every point outside the fences, as a distributed table."""
    found = _stats(df, columns, max_cols, stats)
    if not found:
        return df.sparkSession.createDataFrame([], "column string, value double")
    records = [(F.lit(s.column), as_double(df, s.column), F.lit(s.fences[0]), F.lit(s.fences[1]))
               for s in found]
    rows = melt(df, records, ("column", "value", "lower", "upper"))
    return rows.filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
                       ).select("column", "value")
