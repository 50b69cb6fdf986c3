"""Numeric columns within categories: eta-squared, pair ranking, box summary per category."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from frameprobe.functions.columns import as_double, as_text, melt
from frameprobe.functions.moments import clip01, ranked
from frameprobe.operators.columns import CAT_NUM_LEVELS, grouping_names
from frameprobe.operators.numeric import QUARTILES, WHISKER_REACH, numeric_columns
from frameprobe.operators.quantiles import Span, Wide, exact_quantiles, sorted_groups

MAX_CAT_NUM_PAIRS = 60
TOP_CATEGORIES = 8
MIN_ROWS = 5
# Numbers aggregated side by side; more of them would outgrow compiled code.
NUMBERS_PER_SCAN = 16


def group_moments(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """(cat, num, value, n, mean, ss, lo, hi): moments of each number within each category.

    One copy of a row per grouping column, whatever the number of levels and numbers; the numbers stay
    columns until they are aggregated, ``NUMBERS_PER_SCAN`` at a time.
    """
    levels = [(F.lit(i), as_text(df, n)) for i, n in enumerate(cats)]
    parts = []
    for start in range(0, len(nums), NUMBERS_PER_SCAN):
        chunk = dict(list(enumerate(nums))[start:start + NUMBERS_PER_SCAN])
        rows = melt(df, levels, ("cat", "value"),
                    keep=[as_double(df, n).alias(f"n{j}") for j, n in chunk.items()])
        sums = []
        for j in chunk:
            v = F.col(f"n{j}")
            sums.append(F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"),
                                 (F.var_pop(v) * F.count(v)).alias("ss"),
                                 F.min(v).alias("lo"), F.max(v).alias("hi")).alias(f"n{j}"))
        grouped = rows.filter(F.col("value").isNotNull()).groupBy("cat", "value").agg(*sums)
        parts.append(melt(grouped, [(F.lit(j), F.col(f"n{j}")) for j in chunk], ("num", "moments"),
                          keep=[F.col("cat"), F.col("value")])
                     .select("cat", "num", "value", "moments.*").filter(F.col("n") > 0))
    return reduce(DataFrame.unionByName, parts)


def eta_from_moments(moments: DataFrame) -> DataFrame:
    """(cat, num, n, groups, score) from the group moments."""
    n, mean = F.col("n"), F.col("mean")
    # One row per column pair, so the centres can be broadcast.
    centres = moments.groupBy("cat", "num").agg((F.sum(n * mean) / F.sum(n)).alias("centre"))
    summed = moments.join(F.broadcast(centres), ["cat", "num"]).groupBy("cat", "num").agg(
        F.sum(n).alias("n"), F.count("*").alias("groups"),
        F.sum(n * (mean - F.col("centre")) * (mean - F.col("centre"))).alias("between"),
        F.sum("ss").alias("within"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    total = F.col("between") + F.col("within")
    score = (F.when((F.col("n") < MIN_ROWS) | (F.col("groups") < 2), -1.0)
             .when((F.col("lo") == F.col("hi")) | (total <= 0), 0.0)
             .otherwise(clip01(F.col("between") / total)))
    return summed.select("cat", "num", "n", "groups", score.alias("score"))


def _names(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    rows = [(i, j, c, n) for i, c in enumerate(cats) for j, n in enumerate(nums)]
    return F.broadcast(df.sparkSession.createDataFrame(
        rows, "cat int, num int, cat_col string, num_col string"))


def _candidates(df, cats, nums, id_cols) -> tuple[dict[str, int], list[str]]:
    excluded = set(id_cols)
    if cats is None:
        cats = grouping_names(df, CAT_NUM_LEVELS, excluded)
    if nums is None:
        nums = [n for n in numeric_columns(df) if n not in excluded]
    return dict(cats), list(nums)


def eta_squared(df: DataFrame, cats: dict[str, int] | None = None, nums: Sequence[str] | None = None,
                id_cols: Iterable[str] = ()) -> DataFrame:
    """(cat_col, num_col, n, score): share of a number's variance between the categories.

    Over complete rows; -1 below 5 rows or 2 categories, 0 for a constant number.
    """
    cats, nums = _candidates(df, cats, nums, id_cols)
    if not cats or not nums:
        return df.sparkSession.createDataFrame(
            [], "cat int, num int, cat_col string, num_col string, n long, score double")
    scored = eta_from_moments(group_moments(df, list(cats), nums))
    return (_names(df, list(cats), nums).join(scored, ["cat", "num"], "left")
            .select("cat", "num", "cat_col", "num_col", F.coalesce("n", F.lit(0)).alias("n"),
                    F.coalesce("score", F.lit(-1.0)).alias("score")))


def eta_ranking(df: DataFrame, max_pairs: int = MAX_CAT_NUM_PAIRS, id_cols: Iterable[str] = (),
                cats: dict[str, int] | None = None, nums: Sequence[str] | None = None) -> DataFrame:
    """(cat_col, num_col, n, score, rank): pairs with a score, strongest first."""
    scored = eta_squared(df, cats, nums, id_cols).filter(F.col("score") >= 0)
    order = (F.desc(ranked("score")), "cat", "num")
    # One row per column pair, so a single ordered partition is small.
    return (scored.orderBy(*order).limit(max_pairs)
            .withColumn("rank", F.row_number().over(Window.orderBy(*order)))
            .select("cat_col", "num_col", "n", "score", "rank"))


def grouped_box(df: DataFrame, pairs: Sequence[tuple[str, str]], top: int = TOP_CATEGORIES) -> DataFrame:
    """Box summary of the number for the most frequent categories of each (cat_col, num_col) pair.

    Returns cat_col, num_col, value, rank, count, q25, q50, q75, lower_fence, upper_fence,
    whisker_lo, whisker_hi, outliers.
    """
    schema = ("cat_col string, num_col string, value string, rank int, count long, q25 double, "
              "q50 double, q75 double, lower_fence double, upper_fence double, whisker_lo double, "
              "whisker_hi double, outliers long")
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], schema)
    cat_names = list(dict.fromkeys(c for c, _ in pairs))
    num_names = list(dict.fromkeys(n for _, n in pairs))
    wanted = spark.createDataFrame(
        [(k, cat_names.index(c), num_names.index(n)) for k, (c, n) in enumerate(pairs)],
        "pair int, cat int, num int")
    order = Window.partitionBy("pair").orderBy(F.desc("n"), "value")
    # At most ``top`` rows per pair reach the driver.
    chosen = (group_moments(df, cat_names, num_names).join(F.broadcast(wanted), ["cat", "num"])
              .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
              .select("pair", "value", "rank", "n", "lo", "hi").orderBy("pair", "rank").collect())
    values = _leveled(df, cat_names, num_names, pairs, chosen)
    points = exact_quantiles(
        values, {i: Span(i, r.lo, r.hi, 0, r.n) for i, r in enumerate(chosen)}, QUARTILES)
    rows = []
    for i, r in enumerate(chosen):
        q25, q50, q75 = points[i]
        reach = WHISKER_REACH * (q75 - q25)
        rows.append((i, *pairs[r.pair], r.value, r["rank"], r.n, q25, q50, q75, q25 - reach, q75 + reach))
    boxes = spark.createDataFrame(
        rows, "position int, cat_col string, num_col string, value string, rank int, count long, "
              "q25 double, q50 double, q75 double, lower_fence double, upper_fence double")
    fences = {r[0]: r[-2:] for r in rows}
    return _reached(values, fences).join(F.broadcast(boxes), "position").orderBy("position").select(
        *[part.split()[0] for part in schema.split(", ")])


def _leveled(df: DataFrame, cats: Sequence[str], nums: Sequence[str], pairs: Sequence[tuple[str, str]],
             chosen: Sequence) -> Wide:
    """The numbers of each row and the place of its categories among those ``chosen`` of any pair."""
    levels: list[dict[str, int]] = [{} for _ in cats]
    groups = {}
    for i, r in enumerate(chosen):
        cat, num = pairs[r.pair]
        known = levels[cats.index(cat)]
        groups[i] = (cats.index(cat), known.setdefault(r.value, len(known) + 1), nums.index(num))
    codes = [F.coalesce(F.array_position(F.array(*map(F.lit, known)), as_text(df, cat)), F.lit(0)).cast("int") if known
             else F.lit(0) for cat, known in zip(cats, levels)]
    return Wide(df.select(F.array(*codes).alias("codes"), F.array(*[as_double(df, n) for n in nums]).alias("v")), groups)


def _reached(values: Wide, fences: dict[int, tuple[float, float]]) -> DataFrame:
    """(position, whisker_lo, whisker_hi, outliers) of each group: extreme values inside its fences."""
    groups = values.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for group, v in sorted_groups(batch, groups) if batch.num_rows else ():
                lower, upper = fences[group]
                first, end = np.searchsorted(v, lower, "left"), np.searchsorted(v, upper, "right")
                # a NaN fence lies above all values, as Spark compares
                lo = v[first] if first < len(v) else None
                hi = v[end - 1] if end else None
                old = found.setdefault(group, [None, None, 0])
                old[0] = lo if old[0] is None or (lo is not None and lo < old[0]) else old[0]
                old[1] = hi if old[1] is None or (hi is not None and hi > old[1]) else old[1]
                old[2] += int(first + len(v) - end)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), *(pa.array([x[k] for x in found.values()], kind)
                                                  for k, kind in enumerate((pa.float64(), pa.float64(), pa.int64())))],
            names=["position", "whisker_lo", "whisker_hi", "outliers"])

    return values.rows.mapInArrow(run, "position int, whisker_lo double, whisker_hi double, outliers long").groupBy("position").agg(
        F.min("whisker_lo").alias("whisker_lo"), F.max("whisker_hi").alias("whisker_hi"), F.sum("outliers").alias("outliers"))
