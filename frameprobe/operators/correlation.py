"""Numeric pairs: Pearson correlation, ranking, scatter points, trend lines and their bands."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from frameprobe.functions.columns import as_double, col, melt
from frameprobe.functions.moments import ranked, std
from frameprobe.operators.numeric import numeric_columns
from frameprobe.operators.sampling import sample_rows

MAX_CORRELATED = 25
MAX_SCATTER_PAIRS = 50
SCATTER_ROWS = 1_500
MIN_PAIR_ROWS = 3
BOOTSTRAPS = 1_000
BAND_POINTS = 100
BAND_TAILS = (0.025, 0.975)

PAIR_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "min_x", "max_x", "min_y", "max_y")


def pair_moments(df: DataFrame, columns: Sequence[str],
                 centres: Sequence[float | None] | None = None) -> DataFrame:
    """(pos1, pos2, n, mean_x, mean_y, sxx, syy, sxy, constant) for every pair pos1 >= pos2.

    x is column ``pos1``, y is column ``pos2``; only rows where both are there count, so with
    missing values every pair has its own means. Each Arrow batch is reduced to p x p matrix
    products, and the partial matrices are added up: one scan, p^2 numbers per task, against one
    aggregate expression or one row copy per pair. Values are centred on the column means first,
    which keeps the sums well conditioned; ``centres`` saves the scan that finds the means.
    """
    names = list(columns)
    values = [as_double(df, n).alias(f"c{i}") for i, n in enumerate(names)]
    wide = df.select(*values)
    if centres is None:
        centres = wide.agg(*[F.avg(c).alias(c) for c in wide.columns]).first()
    centres = [c or 0.0 for c in centres]
    lower = [(i, j) for i in range(len(names)) for j in range(i + 1)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(centres)
        at = np.array(lower)
        x, y = at[:, 0], at[:, 1]
        total = np.zeros((6, p, p))
        bounds = np.full((4, p, p), np.inf)
        for batch in batches:
            data = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if not len(data):
                continue
            data = data.astype(float) - np.array(centres)
            there = ~np.isnan(data)
            mask = there.astype(float)
            data = np.where(there, data, 0.0)
            squares = data * data
            total += np.stack([mask.T @ mask, data.T @ mask, mask.T @ data,
                               squares.T @ mask, mask.T @ squares, data.T @ data])
            full = np.where(there, data, np.inf).min(axis=0)
            top = np.where(there, -data, np.inf).min(axis=0)
            for j in range(p):
                low, high = full, top
                if not there[:, j].all():
                    shared = there & there[:, j:j + 1]
                    low = np.where(shared, data, np.inf).min(axis=0)
                    high = np.where(shared, -data, np.inf).min(axis=0)
                bounds[0, :, j] = np.minimum(bounds[0, :, j], low)
                bounds[1, :, j] = np.minimum(bounds[1, :, j], high)
                bounds[2, j, :] = np.minimum(bounds[2, j, :], low)
                bounds[3, j, :] = np.minimum(bounds[3, j, :], high)
        found = total[0, x, y] > 0
        x, y = x[found], y[found]
        cells = [total[k, x, y] for k in range(6)]
        cells += [bounds[0, x, y], -bounds[1, x, y], bounds[2, x, y], -bounds[3, x, y]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int32()), pa.array(y, pa.int32())] + [pa.array(c, pa.float64()) for c in cells],
            names=["pos1", "pos2", *("n", "sx", "sy", "sxx", "syy", "sxy", "min_x", "max_x", "min_y", "max_y")])

    schema = "pos1 int, pos2 int, " + ", ".join(f"{c} double" for c in PAIR_SUMS)
    sums = wide.mapInArrow(partial, schema).groupBy("pos1", "pos2").agg(
        *[F.sum(c).alias(c) for c in PAIR_SUMS[:6]],
        F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
        F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))
    table = df.sparkSession.createDataFrame(
        [(i, j, centres[i], centres[j]) for i, j in lower], "pos1 int, pos2 int, cx double, cy double")
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    return table.join(sums, ["pos1", "pos2"], "left").select(
        "pos1", "pos2", F.coalesce(n, F.lit(0)).cast("bigint").alias("n"),
        (sx / n + F.col("cx")).alias("mean_x"), (sy / n + F.col("cy")).alias("mean_y"),
        (F.col("sxx") - sx * sx / n).alias("sxx"), (F.col("syy") - sy * sy / n).alias("syy"),
        (F.col("sxy") - sx * sy / n).alias("sxy"),
        # Compared on the pair's rows; a variance test would take rounding noise for spread.
        (F.col("min_x") == F.col("max_x")).alias("constant_x"),
        (F.col("min_y") == F.col("max_y")).alias("constant_y"))


def _r(moments: DataFrame) -> DataFrame:
    flat = F.col("constant_x") | F.col("constant_y")
    raw = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    r = (F.when(flat | (F.col("n") < 2), None)
         .when(F.col("pos1") == F.col("pos2"), 1.0)
         .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))))
    return moments.withColumn("r", r)


def _named(df: DataFrame, pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    table = df.sparkSession.createDataFrame(list(enumerate(names)), "pos int, name string")
    one = table.select(F.col("pos").alias("pos1"), F.col("name").alias("col1"))
    two = table.select(F.col("pos").alias("pos2"), F.col("name").alias("col2"))
    return pairs.join(F.broadcast(one), "pos1").join(F.broadcast(two), "pos2")


def top_variance(df: DataFrame, most: int = MAX_CORRELATED) -> DataFrame:
    """(column, position, variance) of the ``most`` numeric columns of highest variance."""
    names = numeric_columns(df)
    records = [(F.lit(i), as_double(df, n)) for i, n in enumerate(names)]
    table = df.sparkSession.createDataFrame(list(enumerate(names)), "position int, column string")
    v = F.col("v")
    spread = (melt(df, records, ("position", "v")).groupBy("position")
              .agg((std(v) * std(v)).alias("variance")))
    return (spread.join(F.broadcast(table), "position")
            .orderBy(F.desc_nulls_last("variance"), "position").limit(most)
            .select("column", "position", "variance"))


def heatmap_columns(df: DataFrame, max_correlated: int = MAX_CORRELATED) -> list[str]:
    """All numeric columns, or the ones of highest variance, in that order, when there are more."""
    names = numeric_columns(df)
    if len(names) <= max_correlated:
        return names
    return [r.column for r in top_variance(df, max_correlated)
            .orderBy(F.desc_nulls_last("variance"), "position").collect()]


def correlation(df: DataFrame, columns: Sequence[str] | None = None,
                max_correlated: int = MAX_CORRELATED, moments: DataFrame | None = None) -> DataFrame:
    """(col1, col2, n, r): lower triangle with diagonal of the Pearson matrix, all rows.

    ``r`` is NULL where a column is constant on the pair's rows. ``moments`` are the pair moments of
    the same columns, when they are there already.
    """
    names = heatmap_columns(df, max_correlated) if columns is None else list(columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, n long, r double")
    moments = pair_moments(df, names) if moments is None else moments
    return _named(df, _r(moments), names).orderBy("pos1", "pos2").select("col1", "col2", "n", "r")


def pair_ranking(df: DataFrame, max_pairs: int = MAX_SCATTER_PAIRS,
                 sample_size: int | None = None, moments: DataFrame | None = None) -> DataFrame:
    """(col1, col2, n, r, slope, intercept, r2, rank): numeric pairs by |r|, strongest first.

    col1 is the later column (x), col2 the earlier one (y). Pairs with under 3 complete rows leave
    after the cut. All rows count unless ``sample_size`` is given.
    """
    names = numeric_columns(df)
    schema = ("col1 string, col2 string, n long, r double, slope double, intercept double, "
              "r2 double, rank int")
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    if moments is None:
        source = df if sample_size is None else sample_rows(df.select(*[col(n) for n in names]), sample_size)
        moments = pair_moments(source, names)
    order = (F.desc(F.abs(ranked("r"))), "pos1", "pos2")
    top = (_r(moments).filter((F.col("pos1") > F.col("pos2")) & F.col("r").isNotNull())
           .orderBy(*order).limit(max_pairs).filter(F.col("n") >= MIN_PAIR_ROWS))
    # One row per column pair, so a single ordered partition is small.
    placed = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return _named(df, _trend(placed), names).orderBy("rank").select(
        "col1", "col2", "n", "r", "slope", "intercept", "r2", "rank")


def _trend(pairs: DataFrame) -> DataFrame:
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    fit = F.when(~F.col("constant_x"), slope)
    return (pairs.withColumn("slope", fit)
            .withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x"))
            .withColumn("r2", F.col("r") * F.col("r")))


def trend(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col1, col2, n, r, slope, intercept, r2): least-squares line of every pair, y = col2."""
    names = numeric_columns(df) if columns is None else list(columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame(
            [], "col1 string, col2 string, n long, r double, slope double, intercept double, r2 double")
    pairs = _trend(_r(pair_moments(df, names)).filter(F.col("pos1") > F.col("pos2")))
    return _named(df, pairs, names).select("col1", "col2", "n", "r", "slope", "intercept", "r2")


def scatter_points(df: DataFrame, pairs: Sequence[tuple[str, str]],
                   sample: DataFrame | None = None, sample_size: int = SCATTER_ROWS) -> DataFrame:
    """(col1, col2, x, y): complete rows of a row sample for each pair, as one long table."""
    if not pairs:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, x double, y double")
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    if sample is None:
        sample = sample_rows(df.select(*[col(n) for n in names]), sample_size)
    records = [(F.lit(a), F.lit(b), as_double(df, a), as_double(df, b)) for a, b in pairs]
    return melt(sample, records, ("col1", "col2", "x", "y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())


def poisson_chances(mean: int) -> np.ndarray:
    """Chances that a Poisson number is at most 0, 1, 2, ..., as far as they can be told from 1."""
    k = np.arange(1, int(mean + 12 * np.sqrt(mean) + 30))
    return np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(mean / k))]) - mean))


def trend_band(points: DataFrame, bootstraps: int = BOOTSTRAPS) -> DataFrame:
    """(col1, col2, grid, x, y, lower, upper): 95 % band of the trend line on 100 points.

    In each refit every point is drawn a Poisson(1) number of times, equal points together a Poisson
    number of their copies. The number is set by a hash of pair, values and refit: the band
    depends on the points alone, not on their order. The refits need no pass of their own: a
    batch of points adds to the sums of all refits at once, and only (pair, refit) sums are shuffled.
    """
    pair = ["col1", "col2"]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refits = np.arange(bootstraps + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        chances: dict[int, np.ndarray] = {}
        for frame in frames:
            for (col1, col2), rows in frame.groupby(pair):
                for start in range(0, len(rows), 4096):
                    part = rows.iloc[start:start + 4096]
                    x, y, copies = (part[c].to_numpy() for c in ("x", "y", "copies"))
                    mixed = part["point"].to_numpy().view(np.uint64)[None, :] + refits
                    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    mixed ^= mixed >> np.uint64(31)
                    weight = np.empty(mixed.shape)
                    for m in np.unique(copies).tolist():
                        if m not in chances:
                            chances[m] = poisson_chances(m)
                        same = copies == m
                        weight[:, same] = np.searchsorted(chances[m], mixed[:, same] / 2.0 ** 64, side="right")
                    weight[0] = copies  # refit 0 is the line through the points themselves
                    sums = weight @ np.column_stack([np.ones_like(x), x, y, x * x, x * y])
                    out = pd.DataFrame(sums, columns=["n", "sx", "sy", "sxx", "sxy"])
                    out.insert(0, "draw", np.arange(bootstraps + 1))
                    out.insert(0, "col2", col2)
                    out.insert(0, "col1", col1)
                    yield out

    text = F.concat_ws("|", *pair, F.col("x").cast("string"), F.col("y").cast("string"))
    distinct = points.groupBy(*pair, "x", "y").agg(F.count("*").alias("copies"))
    marked = distinct.withColumn("point", F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("bigint"))
    sums = marked.mapInPandas(partial, "col1 string, col2 string, draw int, n double, sx double, "
                                       "sy double, sxx double, sxy double")
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    lines = (sums.groupBy(*pair, "draw").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
             .withColumn("slope", F.try_divide(F.col("sxy") - sx * sy / n, F.col("sxx") - sx * sx / n))
             .withColumn("intercept", (sy - F.col("slope") * sx) / n)
             .filter(F.col("slope").isNotNull()))
    ends = points.groupBy(*pair).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    x = F.col("lo") + F.col("grid") * (F.col("hi") - F.col("lo")) / (BAND_POINTS - 1)
    at = (lines.join(ends, pair)
          .select(*pair, "draw", "slope", "intercept", "lo", "hi",
                  F.explode(F.sequence(F.lit(0), F.lit(BAND_POINTS - 1))).alias("grid"))
          .select(*pair, "draw", "grid", x.alias("x"),
                  (F.col("intercept") + F.col("slope") * x).alias("fit")))
    tails = F.percentile(F.when(F.col("draw") > 0, F.col("fit")), F.array(*[F.lit(t) for t in BAND_TAILS]))
    return at.groupBy(*pair, "grid").agg(
        F.max("x").alias("x"), F.max(F.when(F.col("draw") == 0, F.col("fit"))).alias("y"),
        tails.alias("tails")).select(
            *pair, "grid", "x", "y", F.col("tails")[0].alias("lower"), F.col("tails")[1].alias("upper"))
