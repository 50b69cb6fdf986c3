"""Exact quantiles of many groups at once, without ordering or moving the data.

The built-in exact ``percentile`` keeps one map entry per distinct value in a single buffer, which
does not survive a large continuous column. Here every pass only *counts*: the open interval of a
wanted rank is cut into cells, one scan counts the cells with map-side partial aggregation, and the
cell that holds the rank becomes the next interval. When few rows are left in an interval their
distinct values are counted and the rank is read off. Results are exact for any skew: a value that
repeats a billion times is one cell.

The driver holds one interval per group and wanted rank, never rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from frameprobe.session import short_methods

CELLS_PER_PASS = 200_000
MAX_CELLS = 4_096
MIN_CELLS = 64
RESIDUE_ROWS = 50_000
# Distinct values that a task holds before it hands them on.
HELD_VALUES = 200_000
LARGEST = sys.float_info.max
LOG_SHIFT = 746.0  # the smallest double has the logarithm -744.4


@dataclass(frozen=True)
class Span:
    """Values of one group in [lo, hi]: ``count`` of them, ``start`` smaller ones before."""

    group: int
    lo: float
    hi: float
    start: int
    count: int
    log: bool = False


@dataclass(frozen=True)
class Wide:
    """Groups of numbers that stand beside each other in ``rows``: ``codes``, an array with a level for
    each grouping column, and ``v``, an array of doubles. ``groups`` has (place of the grouping column
    or None for all rows, level, place of the number) by group. No row is copied to be counted.
    """

    rows: DataFrame
    groups: dict[int, tuple[int | None, int, int]]


def sorted_groups(batch: pa.RecordBatch, groups: dict[int, tuple[int | None, int, int]]
                  ) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each group of a batch of ``Wide`` rows, ascending, without missing ones."""
    rows = batch.num_rows
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    members: dict[tuple[int, int], np.ndarray] = {}
    for group, (by, level, number) in groups.items():
        v = values[:, number]
        if by is not None:
            if (by, level) not in members:
                members[by, level] = np.flatnonzero(codes[:, by] == level)
            v = v[members[by, level]]
        v = np.sort(v[~np.isnan(v)])
        if len(v):
            yield group, v


def spans_of(values: DataFrame) -> dict[int, Span]:
    """The whole range of each group of a (position, v) table: one row per group is collected."""
    rows = values.groupBy("position").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).collect()
    return {r.position: Span(r.position, r.lo, r.hi, 0, r.n) for r in rows}


def exact_quantiles(values: DataFrame | Wide, spans: dict[int, Span], probs: Sequence[float],
                    residue_rows: int = RESIDUE_ROWS) -> dict[int, list[float | None]]:
    """Quantiles with linear interpolation for every group of ``values``: (position, v) or ``Wide``.

    ``spans`` gives each group's range and count, as ``spans_of`` returns it.
    """
    return _interpolated(spans, probs, lambda wanted: select_ranks(values, wanted, residue_rows))


def _interpolated(spans: dict[int, Span], probs: Sequence[float],
                  read: Callable[[dict[tuple[int, int], Span]], dict[tuple[int, int], float]]
                  ) -> dict[int, list[float | None]]:
    """The quantiles of each span, from the ranks that ``read`` finds."""
    wanted: dict[tuple[int, int], Span] = {}
    for span in spans.values():
        for prob in probs:
            below = math.floor(prob * (span.count - 1)) if span.count else 0
            for rank in (below, min(below + 1, span.count - 1)):
                if span.count:
                    wanted[(span.group, rank)] = span
    found = read(wanted) if wanted else {}

    result: dict[int, list[float | None]] = {}
    for span in spans.values():
        points: list[float | None] = []
        for prob in probs:
            if not span.count:
                points.append(None)
                continue
            place = prob * (span.count - 1)
            below = math.floor(place)
            low = found[(span.group, below)]
            high = found[(span.group, min(below + 1, span.count - 1))]
            points.append(low if low == high else low + (high - low) * (place - below))
        result[span.group] = points
    return result


def select_ranks(values: DataFrame | Wide, wanted: dict[tuple[int, int], Span],
                 residue_rows: int = RESIDUE_ROWS) -> dict[tuple[int, int], float]:
    """The value at each wanted (group, zero-based rank)."""
    found: dict[tuple[int, int], float] = {}
    open_ranks = dict(wanted)
    while True:
        for (group, rank), span in list(open_ranks.items()):
            if span.lo == span.hi or rank == span.start:
                found[(group, rank)] = span.lo
            elif rank == span.start + span.count - 1:
                found[(group, rank)] = span.hi
            else:
                continue
            del open_ranks[(group, rank)]
        wide = {k: s for k, s in open_ranks.items() if s.count > residue_rows}
        if not wide:
            break
        open_ranks.update(_narrow(values, wide))
    if open_ranks:
        found.update(_read_off(values, open_ranks))
    return found


def _tail(value: float) -> float:
    """Signed logarithm, moved so that every double but zero keeps its sign: spreads both the largest
    and the smallest magnitudes over the cells, and is finite for every double."""
    finite = max(-LARGEST, min(LARGEST, value))
    return math.copysign(math.log(abs(finite)) + LOG_SHIFT, finite) if finite else 0.0


@dataclass(frozen=True)
class _Interval:
    """A span with how its values are laid over cells."""

    span: int
    position: int
    lo: float
    hi: float
    start: int
    mode: str
    bottom: float
    width: float


def _intervals(ranks: dict[tuple[int, int], Span]) -> tuple[list[Span], list[_Interval]]:
    """The distinct spans; at most two per group and wanted quantile."""
    spans = sorted(set(ranks.values()), key=lambda s: (s.group, s.start))
    rows = []
    for i, s in enumerate(spans):
        endless = math.isinf(s.hi - s.lo)
        mode, bottom, top = "linear", s.lo, s.hi
        if (s.log or endless) and _tail(s.hi) > _tail(s.lo):
            mode, bottom, top = "log", _tail(s.lo), _tail(s.hi)
        elif endless:  # infinity beside the largest numbers: only tell it from the rest
            mode, bottom, top = "apart", 0.0, 1.0
        rows.append(_Interval(i, s.group, s.lo, s.hi, s.start, mode, bottom, top - bottom))
    return spans, rows


def _inside(values: DataFrame, intervals: list[_Interval]) -> DataFrame:
    """The values of (position, v) with each interval that holds them."""
    table = values.sparkSession.createDataFrame(
        [tuple(vars(i).values()) for i in intervals],
        "span int, position int, lo double, hi double, start long, mode string, bottom double, "
        "width double")
    return values.join(F.broadcast(table), "position").filter(F.col("v").between(F.col("lo"), F.col("hi")))


def _rank_table(spark, spans: list[Span], ranks: dict[tuple[int, int], Span]) -> DataFrame:
    number = {s: i for i, s in enumerate(spans)}
    rows = [(number[s], rank) for (_, rank), s in ranks.items()]
    return F.broadcast(spark.createDataFrame(rows, "span int, rank long"))


def _place(value: Column, plain: bool) -> Column:
    """Order-preserving place of a value within its span, 0 to 1."""
    if plain:
        return (value - F.col("bottom")) / F.col("width")
    finite = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), value))
    scaled = (F.when(F.col("mode") == "log", F.when(finite == 0, 0.0)
                     .otherwise(F.signum(finite) * (F.log(F.abs(finite)) + LOG_SHIFT)))
              .when(F.col("mode") == "apart", (value > F.col("lo")).cast("double"))
              .otherwise(value))
    return F.greatest(F.lit(0.0), (scaled - F.col("bottom")) / F.col("width"))


def _placed(v: np.ndarray, i: _Interval) -> np.ndarray:
    """``_place`` of the values of a batch."""
    if i.mode == "log":
        finite = np.clip(v, -LARGEST, LARGEST)
        with np.errstate(divide="ignore"):
            scaled = np.where(finite == 0, 0.0, np.copysign(np.log(np.abs(finite)) + LOG_SHIFT, finite))
    else:
        scaled = (v > i.lo).astype(float) if i.mode == "apart" else v
    return np.maximum(0.0, (scaled - i.bottom) / i.width)


def _by_group(source: Wide, intervals: list[_Interval]) -> tuple[dict, dict[int, list[_Interval]]]:
    by: dict[int, list[_Interval]] = {}
    for i in intervals:
        by.setdefault(i.position, []).append(i)
    return {g: source.groups[g] for g in by}, by


def _wide_cells(source: Wide, intervals: list[_Interval], cells: int) -> DataFrame:
    """(span, base, cell, n, lo, hi) of wide rows: each task holds the cells of all intervals."""
    groups, by = _by_group(source, intervals)
    starts = np.array([i.start for i in intervals])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(intervals), cells), np.int64)
        lo = np.full(n.shape, np.inf)
        hi = np.full(n.shape, -np.inf)
        for batch in batches:
            for group, v in sorted_groups(batch, groups) if batch.num_rows else ():
                for i in by[group]:
                    part = v[np.searchsorted(v, i.lo, "left"):np.searchsorted(v, i.hi, "right")]
                    if not len(part):
                        continue
                    cell = np.minimum((_placed(part, i) * cells).astype(np.int64), cells - 1)
                    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                    end = np.append(first[1:], len(part))
                    np.add.at(n[i.span], cell[first], end - first)
                    np.minimum.at(lo[i.span], cell[first], part[first])
                    np.maximum.at(hi[i.span], cell[first], part[end - 1])
        span, cell = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(span, pa.int32()), pa.array(starts[span], pa.int64()), pa.array(cell, pa.int32()),
             pa.array(n[span, cell]), pa.array(lo[span, cell]), pa.array(hi[span, cell])],
            names=["span", "base", "cell", "n", "lo", "hi"])

    return source.rows.mapInArrow(run, "span int, base long, cell int, n long, lo double, hi double").groupBy(
        "span", "base", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _wide_values(source: Wide, intervals: list[_Interval]) -> DataFrame:
    """(span, start, v, n) of wide rows."""
    groups, by = _by_group(source, intervals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []

        def handed():
            for span, start, v in held:
                v, n = np.unique(v, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), span), pa.int32()), pa.array(np.full(len(v), start), pa.int64()),
                     pa.array(v), pa.array(n.astype(np.int64))], names=["span", "start", "v", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for group, v in sorted_groups(batch, groups) if batch.num_rows else ():
                for i in by[group]:
                    part = v[np.searchsorted(v, i.lo, "left"):np.searchsorted(v, i.hi, "right")]
                    if len(part):
                        held.append((i.span, i.start, part))
                        size += len(part)
            if size > HELD_VALUES:
                yield from handed()
                size = 0
        yield from handed()

    return source.rows.mapInArrow(run, "span int, start long, v double, n long").groupBy(
        "span", "start", "v").agg(F.sum("n").alias("n"))


def _narrow(values: DataFrame | Wide, ranks: dict[tuple[int, int], Span]) -> dict[tuple[int, int], Span]:
    """One counting pass: replace each rank's span by the cell of it that holds the rank."""
    spans, intervals = _intervals(ranks)
    cells = max(MIN_CELLS, min(MAX_CELLS, CELLS_PER_PASS // len(spans)))
    if isinstance(values, Wide):
        counted = _wide_cells(values, intervals, cells)
    else:
        inside = _inside(values, intervals)
        place = _place(F.col("v"), not any(s.log or math.isinf(s.hi - s.lo) for s in spans))
        cell = F.least((place * cells).cast("int"), F.lit(cells - 1))
        counted = (
            inside.groupBy("span", F.col("start").alias("base"), cell.alias("cell"))
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
    through = F.sum("n").over(Window.partitionBy("span").orderBy("cell"))
    located = (
        counted.withColumn("start", F.col("base") + through - F.col("n"))
        .join(_rank_table(counted.sparkSession, spans, ranks), "span")
        .filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n")))
    )
    out = {}
    for row in _collected(located, values):
        old = spans[row.span]
        slow = row.n * 4 > old.count
        out[(old.group, row["rank"])] = Span(old.group, row.lo, row.hi, row.start, row.n,
                                             not old.log if slow else old.log)
    return out


def _collected(located: DataFrame, values: DataFrame | Wide) -> list:
    if not isinstance(values, Wide):
        return located.collect()
    with short_methods(located.sparkSession):
        return located.collect()


def _read_off(values: DataFrame | Wide, ranks: dict[tuple[int, int], Span]) -> dict[tuple[int, int], float]:
    """Last pass: count the few distinct values left in each span and read the ranks."""
    spans, intervals = _intervals(ranks)
    if isinstance(values, Wide):
        counted = _wide_values(values, intervals)
    else:
        counted = _inside(values, intervals).groupBy("span", "start", "v").agg(F.count("*").alias("n"))
    located = _ranked(counted, spans, ranks)
    return {(spans[r.span].group, r["rank"]): r.v for r in _collected(located, values)}


def _ranked(counted: DataFrame, spans: list[Span], ranks: dict[tuple[int, int], Span]) -> DataFrame:
    """(span, rank, v, ...) from the counts (span, start, v, n) of distinct values."""
    through = F.sum("n").over(Window.partitionBy("span").orderBy("v")) + F.col("start")
    return (
        counted.withColumn("through", through)
        .join(_rank_table(counted.sparkSession, spans, ranks), "span")
        .filter((F.col("rank") < F.col("through")) & (F.col("rank") >= F.col("through") - F.col("n")))
    )


def counted_quantiles(counts: DataFrame, spans: dict[int, Span], probs: Sequence[float]) -> dict[int, list[float | None]]:
    """``exact_quantiles`` from the counts (position, v, n) of the distinct values of every group.

    A group's distinct values pass through one task: for groups with few of them.
    """
    def read(wanted: dict[tuple[int, int], Span]) -> dict[tuple[int, int], float]:
        parts, _ = _intervals(wanted)
        numbers = counts.sparkSession.createDataFrame([(i, s.group) for i, s in enumerate(parts)], "span int, position int")
        counted = counts.join(F.broadcast(numbers), "position").select("span", F.lit(0).cast("bigint").alias("start"), "v", "n")
        return {(parts[r.span].group, r["rank"]): r.v for r in _ranked(counted, parts, wanted).collect()}

    return _interpolated(spans, probs, read)
