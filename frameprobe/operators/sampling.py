"""An exact number of rows at random."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from frameprobe.functions.columns import col, kind
from frameprobe.session import ensure_checkpoint_dir

# Tables with at most this many rows per wanted row are ordered without a prior cut.
DIRECT_RATIO = 200


def sample_rows(df: DataFrame, size: int, seed: int = 42, rows: int | None = None,
                draw: Column | None = None) -> DataFrame:
    """Exactly ``size`` rows without replacement, all rows when there are no more.

    Every row draws a number in [0, 1) and the smallest ``size`` win. On large tables rows above a
    threshold that keeps slightly more than ``size`` rows drop out before the ordering, so the last
    step never sees more than that; a count confirms that enough are left. ``draw`` replaces the
    seeded random number, for example by a hash of the row.
    """
    total = df.count() if rows is None else rows
    if total <= size:
        return df
    number = F.rand(seed) if draw is None else draw

    def fixed(rows: DataFrame) -> DataFrame:
        """A seeded draw goes by row order, which a retry may change, so its rows are written once."""
        if draw is not None:
            return rows
        ensure_checkpoint_dir(df.sparkSession)
        return rows.checkpoint(eager=True)

    drawn = df.withColumn("__draw", number)
    if total > size * DIRECT_RATIO:
        share = (size + 8 * math.sqrt(size) + 64) / total
        while share < 1:
            kept = fixed(drawn.filter(F.col("__draw") < share))
            if kept.count() >= size:
                drawn = kept
                break
            share *= 2
    else:
        drawn = fixed(drawn)
    ties = [col(f.name) for f in df.schema
            if kind(f.dataType) != "other" or f.dataType.simpleString() == "binary"]
    return drawn.orderBy("__draw", *ties).limit(size).drop("__draw")
