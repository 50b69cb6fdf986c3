"""Sample statistics expressed over Spark's population moments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def skewness_of(n: Column, m2: Column, m3: Column, lo: str = "lo", hi: str = "hi") -> Column:
    """Bias-corrected skewness from the sums of powers about the mean; NULL below 3 values and 0 for a
    constant."""
    n = n.cast("double")
    plain = F.try_divide(F.sqrt(n) * m3, F.sqrt(m2 * m2 * m2))
    corrected = plain * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.col(lo) == F.col(hi), 0.0).otherwise(corrected)


def kurtosis_of(n: Column, m2: Column, m4: Column, lo: str = "lo", hi: str = "hi") -> Column:
    """Bias-corrected excess kurtosis from the sums of powers about the mean; NULL below 4 values and 0
    for a constant."""
    n = n.cast("double")
    plain = F.try_divide(n * m4, m2 * m2) - 3
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * plain + 6)
    return F.when(n < 4, None).when(F.col(lo) == F.col(hi), 0.0).otherwise(corrected)


def std_of(n: Column, m2: Column, lo: str = "lo", hi: str = "hi") -> Column:
    """Sample standard deviation from the sum of squares about the mean, 0 for a constant."""
    return F.when(n < 2, None).when(F.col(lo) == F.col(hi), 0.0).otherwise(F.sqrt(m2 / (n - 1)))


def std(value: Column) -> Column:
    """Sample standard deviation, exactly 0 for a constant whatever the merge order."""
    return (
        F.when(F.count(value) < 2, None)
        .when(F.min(value) == F.max(value), 0.0)
        .otherwise(F.stddev_samp(value))
    )


def clip01(value: Column) -> Column:
    """Clip a score to [0, 1]; NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def ranked(score: str) -> Column:
    """A score as rankings compare it: what differs by summation order only is a tie."""
    return F.round(F.col(score), 12)
