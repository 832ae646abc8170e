"""Numeric columns to bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import before


def intervals(value: Column, splits: Sequence[float]) -> Column:
    """The number of splits that are not above the value: bin 0 below the first. Null stays null."""
    return F.when(value.isNotNull(), sum((F.when(value >= s, 1.0).otherwise(0.0) for s in splits), F.lit(0.0)))


def equidistant_splits(df: DataFrame, column: str, n: int) -> list[float]:
    """Borders of n bins of equal width from the smallest to the largest value; none if there are no values."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        return []
    width = (high - low) / n
    return [low + i * width for i in range(n)] + [high] if width else [low]


def equidistant(df: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """n bins of equal width, and one below and one above (which holds the largest value)."""
    splits = equidistant_splits(df, column, n)
    return df.withColumn(out, intervals(F.col(column), splits) if splits else F.lit(None).cast("double"))


def exact_splits(df: DataFrame, column: str, n: int) -> list[float]:
    """Inner borders of n bins with about equal counts: exact interpolated quantiles, without repeats.

    Distinct values are counted and ranked by ranges; what reaches the driver are the values at the 2 (n - 1) places between which quantiles lie."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    at = [i / n * (total - 1) for i in range(1, n)]
    places = sorted({p for x in at for p in (math.floor(x), math.ceil(x))})
    ranked = before(counts, F.col("v"), {"b": F.col("n")})
    hit = F.filter(F.lit(places), lambda p: (p >= F.col("b")) & (p < F.col("b") + F.col("n")))
    value = {r.p: r.v for r in ranked.select("v", F.explode(hit).alias("p")).collect()}
    return sorted({value[math.floor(x)] + (x - math.floor(x)) * (value[math.ceil(x)] - value[math.floor(x)]) for x in at})


def sketched_splits(df: DataFrame, column: str, n: int, error: float = 0.001) -> list[float]:
    """Inner borders of n bins with about equal counts, without repeats, by a sketch of bounded size."""
    return sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], error)))


def equiarea(df: DataFrame, column: str, n: int, out: str, exact: bool = False, error: float = 0.001) -> DataFrame:
    """Bins of about equal counts. The exact way counts every distinct value; the other holds a bounded sketch."""
    return df.withColumn(out, intervals(F.col(column), exact_splits(df, column, n) if exact else sketched_splits(df, column, n, error)))
