"""Running sums in a global order without a window that holds a whole table or a whole group.

Rows are cut into ranges of the order by borders from a bounded quantile sketch. A range's rows are summed in a window of their own,
and what lies before the range comes from the sums of all ranges, of which there are `parts` in each group. So a task holds one range, whatever the size of its group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_PARTS = 10_000


def before(df: DataFrame, order: Column, values: dict[str, Column], keys: Sequence[str] = (), coarse: Column | None = None, descending: bool = False, parts: int | None = None) -> DataFrame:
    """df with, for every name in `values`, the sum of that value over the rows before this one in its group (keys), in this order.

    coarse: a number that never falls as `order` rises; the order itself if it is a number. Rows equal in the order should be
    aggregated first. Nulls in keys form a group. Null in the order comes first, or last if descending. Column names that begin with `_r_` are taken."""
    n = min(MOST_PARTS, parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = df.withColumns({"_r_order": order, "_r_coarse": (coarse if coarse is not None else order).cast("double")})
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    groups = {f"_r_k{i}": F.col(k) for i, k in enumerate(keys)}
    borders = rows.groupBy(*[c.alias(name) for name, c in groups.items()]).agg(F.percentile_approx("_r_coarse", shares, 10 * n).alias("_r_borders"))
    same = [F.col(k).eqNullSafe(F.col(name)) for k, name in zip(keys, groups)]
    if keys:
        rows = rows.join(borders, same).drop(*groups)
    else:  # one row of `parts` numbers
        rows = rows.withColumn("_r_borders", F.lit([float(x) for x in borders.first()[0] or []]).cast("array<double>"))
    part = F.coalesce(F.size(F.filter("_r_borders", lambda x: x < F.col("_r_coarse"))), F.lit(-1))
    rows = rows.withColumn("_r_part", (-part if descending else part)).drop("_r_borders", "_r_coarse")
    by_group = Window.partitionBy(*groups).orderBy("_r_p")
    totals = rows.groupBy(*[F.col(k).alias(name) for k, name in zip(keys, groups)], F.col("_r_part").alias("_r_p")).agg(*[F.sum(v).alias(f"_r_t{i}") for i, v in enumerate(values.values())])
    # a group has `parts` rows here
    totals = totals.select(*groups, "_r_p", *[(F.sum(f"_r_t{i}").over(by_group.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"_r_t{i}")).alias(f"_r_s{i}") for i in range(len(values))])
    inside = Window.partitionBy(*keys, "_r_part").orderBy(F.col("_r_order").desc_nulls_last() if descending else F.col("_r_order").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_r_i{i}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for i, v in enumerate(values.values())})
    rows = rows.join(totals, [*same, F.col("_r_part") == F.col("_r_p")])
    return rows.select(*df.columns, *[(F.col(f"_r_i{i}") + F.col(f"_r_s{i}")).alias(name) for i, name in enumerate(values)])
