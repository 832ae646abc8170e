"""Classification metrics as DataFrames: everything derives from counts, so one aggregation over the rows is enough."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import before


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def by_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Each class with its support, true and false positives, precision, recall and false positive rate."""
    counts = confusion(df, label, prediction)
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    sides = counts.select(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("tp")).unionAll(counts.select(F.col(prediction).alias("class"), F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long")))
    sums = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    total = F.sum("support").over(Window.partitionBy())
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select("class", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(F.col("predicted") - F.col("tp"), total - F.col("support")).alias("fpr"))


def weighted(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy, and precision, recall, F1, F2, true and false positive rate weighted by support."""
    rows = by_class(df, label, prediction)
    p, r, s = F.col("precision"), F.col("recall"), F.col("support")

    def f(beta2: float) -> Column:
        return F.coalesce(F.try_divide((1 + beta2) * p * r, beta2 * p + r), F.lit(0.0))

    mean = lambda x: F.sum(x * s) / F.sum(s)
    return rows.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), mean(p).alias("weighted_precision"), mean(r).alias("weighted_recall"), mean(f(1.0)).alias("weighted_f1"), mean(f(4.0)).alias("weighted_f2"), mean(r).alias("weighted_tpr"), mean(F.col("fpr")).alias("weighted_fpr"))


def threshold_curve(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F2 at every distinct score, by cumulative counts from the highest score down.

    Scores are counted before they are ordered, and ranked by ranges, so no window holds a whole table or group."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("pos"))
    rows = before(counts, F.col("threshold"), {"_n": F.col("n"), "_pos": F.col("pos")}, keys, descending=True)
    names = {f"_g{i}": k for i, k in enumerate(keys)}
    every = counts.groupBy(*[F.col(k).alias(g) for g, k in names.items()]).agg(F.sum("pos").alias("positives"), F.sum("n").alias("total"))
    every = F.broadcast(every) if not keys else every  # one row
    rows = rows.join(every, [F.col(k).eqNullSafe(F.col(g)) for g, k in names.items()] if keys else F.lit(True)).select(*keys, "threshold", (F.col("_n") + F.col("n")).alias("predicted"), (F.col("_pos") + F.col("pos")).alias("tp"), "positives", "total")
    p, r = F.col("tp") / F.col("predicted"), F.try_divide(F.col("tp"), F.col("positives"))
    rows = rows.select("*", p.alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"))
    return rows.withColumn("f2", F.coalesce(F.try_divide(5 * F.col("precision") * F.col("recall"), 4 * F.col("precision") + F.col("recall")), F.lit(0.0)))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row with the best F2; of several, that with the highest threshold."""
    return curve.agg(F.max(F.struct("f2", "threshold", "precision", "recall")).alias("b")).select("b.*")


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve with ties counted half, from counts by distinct score."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) > 0, 0).otherwise(1)).alias("n"))
    ranked = before(counts, F.col("s"), {"below": F.col("n")})
    return ranked.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auroc"))


def binary_by_page(df: DataFrame, page: str, score: str, label: str, last: int) -> DataFrame:
    """For each page bucket the area under the ROC curve, and the threshold of the best F2 with its precision, recall and accuracy."""
    rows = df.withColumn("_bucket", F.least(F.col(page), F.lit(last)))
    counts = rows.where(F.col(score).isNotNull()).groupBy("_bucket", F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) > 0, 0).otherwise(1)).alias("n"))
    ranked = before(counts, F.col("s"), {"below": F.col("n")}, ["_bucket"])
    area = ranked.groupBy(F.col("_bucket").alias("b")).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auroc"))
    curve = threshold_curve(rows, score, label, ["_bucket"])
    best = curve.groupBy(F.col("_bucket").alias("page")).agg(F.max(F.struct("f2", "threshold", "precision", "recall", "positives", "total", "tp", "predicted")).alias("x"))
    right = F.col("x.total") - F.col("x.positives") - F.col("x.predicted") + 2 * F.col("x.tp")
    return best.join(area, F.col("page").eqNullSafe(F.col("b"))).select("page", "auroc", "x.threshold", "x.f2", "x.precision", "x.recall", (right / F.col("x.total")).alias("accuracy"))


def per_intent_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One tab-separated line for each class, for a text file."""
    rows = by_class(df, label, prediction)
    return rows.select(F.concat_ws("\t", F.col("class").cast("string"), "tp", "fp", F.round("precision", 4), F.round("recall", 4)).alias("value"))
