"""Visits page by page: time on page, page buckets, hot leads and what they capture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import threshold_curve


def time_on_page(df: DataFrame, keys: Sequence[str], page: str, cumulative: str, out: str) -> DataFrame:
    """The next page's cumulative time less this one's; null on the last page."""
    w = Window.partitionBy(*keys).orderBy(page)
    return df.withColumn(out, F.lead(cumulative, 1).over(w) - F.col(cumulative))


def page_bucket(page: Column, n: int) -> Column:
    """Pages from the nth on share a bucket."""
    return F.least(page, F.lit(n))


def page_part(df: DataFrame, page: str, number: int, last: int) -> DataFrame:
    return df.where(F.col(page) >= last if number == last else F.col(page) == number)


def first_pages(df: DataFrame, page: str, n: int) -> DataFrame:
    return df.select(page).distinct().orderBy(page).limit(n)


def is_hot(probability: Column, page: Column, thresholds: Sequence[float], top: Column | None = None, top_thresholds: Sequence[float] | None = None) -> Column:
    """Whether a score reaches its page's threshold (and the time on page its own); later pages use the last threshold."""

    def of(values: Sequence[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.greatest(F.least(page.cast("int"), F.lit(len(values))), F.lit(1)))

    hot = probability >= of(thresholds)
    if top is not None:
        hot = hot & (top >= of(top_thresholds or [0.0]))
    return F.coalesce(hot, F.lit(False))


def hot_leads(df: DataFrame, keys: Sequence[str], page: str, label: str, hot: Column, pages: int) -> DataFrame:
    """For each page bucket the visitors whose first hot page it is, and what share of visitors and buyers they are.

    One pass: a visitor's first hot page and label come from one aggregation, the totals from that result."""
    flag = df.withColumn("_hot", hot)
    visitors = flag.groupBy(*keys).agg(F.min(F.when(F.col("_hot"), F.col(page))).alias("_page"), F.max(F.when(F.col("_hot"), F.col(label))).alias("_caught"), F.max(label).alias("_label"))
    bucket = F.when(F.col("_page").isNotNull(), F.least("_page", F.lit(pages))).cast("int")  # least() passes over nulls
    by_page = visitors.groupBy(bucket.alias("page")).agg(F.count("*").alias("n"), F.sum(F.col("_caught").cast("long")).alias("c"), F.sum(F.when(F.col("_label") > 0, 1).otherwise(0)).alias("positives"))
    every = Window.partitionBy()
    total = by_page.select("page", "n", "c", F.sum("n").over(every).alias("visitors"), F.sum("positives").over(every).alias("total_positives"))
    return total.where("page is not null").select(
        "page",
        F.col("n").alias("hot_leads"),
        "visitors",
        (F.col("n") / F.col("visitors")).alias("hot_lead_rate"),
        F.col("c").alias("captured"),
        "total_positives",
        F.try_divide(F.col("c"), F.col("total_positives")).alias("capture_rate"),
    )


def page_thresholds(train: DataFrame, page: str, score: str, label: str, pages: int) -> DataFrame:
    """For each page bucket the threshold with the best F2 on the training rows, and the accuracy that follows from it."""
    curve = threshold_curve(train.withColumn("_bucket", page_bucket(F.col(page), pages)), score, label, ["_bucket"])
    best = curve.groupBy(F.col("_bucket").alias("page")).agg(F.max(F.struct("f2", "threshold", "precision", "recall", "positives", "total")).alias("b"))
    r = F.col("b.positives") / F.col("b.total")
    return best.select("page", "b.threshold", "b.f2", (r * (2 * F.col("b.recall") - F.try_divide(F.col("b.recall"), F.col("b.precision"))) + (1 - r)).alias("accuracy"))
