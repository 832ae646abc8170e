"""Stability indices between a base and a new population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import before

TILES = 10


def index_term(base: Column, new: Column) -> Column:
    return (new - base) * F.log(new / base) * 100


def deciles(base: DataFrame, keys: Sequence[str], score: str, tiles: int = TILES) -> DataFrame:
    """Inner borders: for i = 1 .. tiles - 1 the value at place ceil(i * (1 / tiles) * n) - 1 of each group's ordered scores, without repeats."""
    counts = base.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.count("*").alias("_c"))
    size = counts.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(F.sum("_c").alias("_n"))
    ranked = before(counts, F.col("_s"), {"_b": F.col("_c")}, keys).join(size, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)])
    places = F.array(*[F.greatest(F.ceil(F.lit(i * (1 / tiles)) * F.col("_n")), F.lit(1)) for i in range(1, tiles)])
    hit = F.exists(places, lambda p: (p > F.col("_b")) & (p <= F.col("_b") + F.col("_c")))
    return ranked.where(hit).groupBy(*keys).agg(F.array_sort(F.collect_set("_s")).alias("_splits"))  # tiles - 1 values at most


def psi(base: DataFrame, new: DataFrame, score: str, keys: Sequence[str] = (), tiles: int = TILES) -> DataFrame:
    """Population stability of a score for each group: index, number of common buckets, and the ranges [from, to) left out because one side has nothing in them.

    Buckets come from the base's deciles, between 0 and 1 at the ends; shares are over the buckets that both have."""
    one = list(keys) or ["_all"]
    both = base.select(*keys, F.col(score).alias("_s"), F.lit(1).alias("_base")).unionAll(new.select(*keys, F.col(score), F.lit(0))).where("_s is not null")
    if not keys:
        both, base = both.withColumn("_all", F.lit(1)), base.withColumn("_all", F.lit(1))
    joined = both.join(deciles(base, one, score, tiles), one)
    bucket = F.size(F.filter("_splits", lambda x: x <= F.col("_s")))
    # a row for each bucket of a group: `tiles` at most
    counts = joined.groupBy(*one, bucket.alias("bucket")).agg(F.sum("_base").alias("b"), F.sum(1 - F.col("_base")).alias("n"), F.first("_splits").alias("_splits"))
    w = Window.partitionBy(*one)
    common = (F.col("b") > 0) & (F.col("n") > 0)
    total = lambda c: F.sum(F.when(common, F.col(c))).over(w)
    rows = counts.select(*one, "bucket", common.alias("common"), "_splits", (F.col("b") / total("b")).alias("b"), (F.col("n") / total("n")).alias("n"))
    found = rows.groupBy(*one).agg(F.sum(F.when(F.col("common"), index_term(F.col("b"), F.col("n")))).alias("psi"), F.count(F.when(F.col("common"), 1)).alias("buckets"), F.collect_set(F.when(F.col("common"), F.col("bucket"))).alias("_has"), F.first("_splits").alias("_splits"))
    ends = F.concat(F.array(F.lit(0.0)), "_splits", F.array(F.lit(1.0)))
    without = F.filter(F.sequence(F.lit(0), F.size("_splits")), lambda i: ~F.array_contains("_has", i))
    excluded = F.transform(without, lambda i: F.struct(F.get(F.col("_ends"), i).alias("from"), F.get(F.col("_ends"), i + 1).alias("to")))
    return found.where("buckets > 0").withColumn("_ends", ends).select(*keys, "psi", "buckets", excluded.alias("excluded"))


def values_by_kind(base: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value, kind, base_rows, new_rows): every value of every variable, as common, missing (in the base only) or new. One row a value, never a list of them."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")
    both = base.select(pair, F.lit(1).alias("_b")).unionAll(new.select(pair, F.lit(0).alias("_b"))).select("v.*", "_b").where("value is not null")
    counts = both.groupBy("variable", "value").agg(F.sum("_b").alias("base_rows"), F.sum(1 - F.col("_b")).alias("new_rows"))
    return counts.select("variable", "value", F.when(F.col("new_rows") == 0, "missing").when(F.col("base_rows") == 0, "new").otherwise("common").alias("kind"), "base_rows", "new_rows")


def vsi(base: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variable stability for each column, all in one pass: index over the common values, and how many values are common, missing and new."""
    counts = values_by_kind(base, new, columns).select("variable", F.col("base_rows").alias("b"), F.col("new_rows").alias("n"))
    common = (F.col("b") > 0) & (F.col("n") > 0)
    totals = counts.groupBy(F.col("variable").alias("v")).agg(F.sum(F.when(common, F.col("b"))).alias("tb"), F.sum(F.when(common, F.col("n"))).alias("tn"))  # a row for each variable
    rows = counts.join(totals, F.col("variable") == F.col("v")).select("variable", "b", "n", (F.col("b") / F.col("tb")).alias("sb"), (F.col("n") / F.col("tn")).alias("sn"))
    return rows.groupBy("variable").agg(
        F.sum(F.when(common, index_term(F.col("sb"), F.col("sn")))).alias("vsi"), F.count(F.when(common, 1)).alias("n_common"), F.count(F.when(F.col("n") == 0, 1)).alias("n_missing"), F.count(F.when(F.col("b") == 0, 1)).alias("n_new")
    )
