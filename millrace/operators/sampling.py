"""Splits, class balancing and the deterministic random variable on which they can rest."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import before

SEED = 20
RANDOM_VARIABLE = "sparkRandomVariable"
LEAST_SHARE = 0.002
_log = logging.getLogger(__name__)


def random_variable(hex_text: Column) -> Column:
    """A number from 0 to 100 from the first eight hexadecimal digits."""
    return F.conv(F.substring(hex_text, 1, 8), 16, 10).cast("double") * 100 / 4294967295


def with_random_variable(df: DataFrame, source: str, name: str | None = None) -> DataFrame:
    """df with a random variable: the named column if it is there without nulls, else one made from `source`.

    A source that isn't hexadecimal is hashed first."""
    if name and name.lower() in (c.lower() for c in df.columns):
        if not df.where(F.col(name).isNull()).limit(1).count():
            return df.withColumn(name, F.col(name).cast("double"))
    text = F.col(source).cast("string")
    return df.withColumn(name or RANDOM_VARIABLE, random_variable(F.when(text.rlike("^[0-9a-fA-F]{8}"), text).otherwise(F.md5(text))))


def random_split(df: DataFrame, weights: Sequence[float], seed: int = SEED) -> list[DataFrame]:
    return df.randomSplit([float(w) for w in weights], seed)


def conditional_split(df: DataFrame, conditions: Sequence[str]) -> list[DataFrame]:
    """A part for each condition; parts may overlap or leave rows out."""
    return [df.where(c) for c in conditions]


def stratified_split(df: DataFrame, label: str, fraction: float, by: Column, tenths: bool = False, coarse: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ceil(fraction x size) rows of each class in the order of `by`, and the rest. tenths: round the fraction to one decimal first.

    Ranks are found by ranges, so a class may have any size. coarse: a number that never falls as `by` rises, needed where `by` is none."""
    if tenths:
        fraction = math.floor(fraction * 10 + 0.5) / 10
    sizes = df.groupBy(F.col(label).alias("_class")).agg(F.ceil(F.count("*") * F.lit(fraction)).alias("_first"))
    ranked = before(df, by, {"_rank": F.lit(1)}, [label], coarse)
    ranked = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_class")))
    inside = F.col("_rank") < F.col("_first")
    return ranked.where(inside).select(*df.columns), ranked.where(~inside).select(*df.columns)


def remaining(df: DataFrame, train: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """What isn't in train: as sets of whole rows (repeats collapse), or by a key, which keeps repeats."""
    return df.subtract(train) if key is None else df.join(train.select(*key).distinct(), list(key), "left_anti")


def stabilize_classes(df: DataFrame, label: str, support: int, other: str) -> DataFrame:
    """Classes of fewer than `support` rows become `other`."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    joined = df.join(counts, df[label].eqNullSafe(counts[label])).drop(counts[label])
    return joined.withColumn(label, F.when(F.col("_n") < support, F.lit(other)).otherwise(F.col(label).cast("string"))).drop("_n").select(*df.columns)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Classes from rare to frequent; ties by label."""
    return df.groupBy(label).agg(F.count("*").alias("count")).orderBy("count", label)


def minority_majority(df: DataFrame, label: str) -> tuple[object, object, int, int]:
    """(rarest class, most frequent class, rows of the rarest, rows of all)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    first, last = F.struct("n", label), F.col(label)
    r = counts.agg(F.min_by(last, first), F.max_by(last, first), F.min("n"), F.sum("n")).first()
    return r[0], r[1], r[2], r[3]


def guard_minority(share: float, percent: float) -> bool:
    """Warns when the rare class is too rare to balance."""
    low = share < LEAST_SHARE or percent < 100 * LEAST_SHARE
    if low:
        _log.warning("the minority class has a share of %s, %s %% was asked for", share, percent)
    return low


def balance_plan(minority: int, total: int, percent: float) -> tuple[int, float]:
    """How the majority changes so that the minority is `percent` of all: whole copies and a further fraction."""
    if not 0 < percent < 50:
        raise ValueError("the share of the minority is above 0 and below 50 percent")
    share, most = 100 * minority / total, total - minority
    guard_minority(share / 100, percent)
    if share < percent:
        return 0, minority / most * (100 - percent) / percent
    if share > percent:
        k = share * total / percent / most  # above 1, as the share is above what is asked for
        copies = max(1, math.floor(k))
        return copies, max(0.0, k - copies)
    return 1, 0.0


def _rare_and_frequent(df: DataFrame, label: str, percent: float) -> tuple[Column, Column, int, float]:
    rare, frequent, m, n = minority_majority(df, label)
    return (F.col(label) == F.lit(rare), F.col(label) == F.lit(frequent), *balance_plan(m, n, percent))


def _copied(df: DataFrame, rare: Column, frequent: Column, copies: int, more: Column | None) -> DataFrame:
    """Rows of the rare class once, those of the frequent one `copies` times and, where `more` holds, once more: one pass."""
    times = F.when(rare, 1).when(frequent, F.lit(copies) + (more.cast("int") if more is not None else 0)).otherwise(0)
    return df.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*df.columns)


def hash_share(key: Sequence[str], fraction: float, seed: int = SEED) -> Column:
    """Whether a row is in a share of all, by a hash of its key: the same rows at every run and on every cluster."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return random_variable(F.md5(text)) < fraction * 100


def hash_split(df: DataFrame, weights: Sequence[float], key: Sequence[str], seed: int = SEED) -> list[DataFrame]:
    """Like random_split, but by a hash of a key."""
    ends = [sum(weights[: i + 1]) / sum(weights) for i in range(len(weights))]
    return [df.where(hash_share(key, b if i + 1 < len(ends) else 2.0, seed) & ~hash_share(key, a, seed)) for i, (a, b) in enumerate(zip([0.0, *ends], ends))]


def balance_random(df: DataFrame, label: str, percent: float, key: Sequence[str] | None = None, seed: int = SEED) -> DataFrame:
    """Rows of other classes than the rarest and the most frequent are left out. The fraction of a copy is drawn by a hash of the key, or at random without one."""
    rare, frequent, copies, fraction = _rare_and_frequent(df, label, percent)
    more = None if not fraction else hash_share(key, fraction, seed) if key else F.rand(seed) < fraction
    return _copied(df, rare, frequent, copies, more)


def balance_conditional(df: DataFrame, label: str, percent: float, variable: str) -> DataFrame:
    """Like balance_random, but the fraction are the rows whose random variable is low."""
    rare, frequent, copies, fraction = _rare_and_frequent(df, label, percent)
    more = None
    if fraction:
        low, high = df.where(frequent).agg(F.min(variable), F.max(variable)).first()
        more = F.coalesce(F.col(variable) < low + fraction * (high - low), F.lit(False))
    return _copied(df, rare, frequent, copies, more)
