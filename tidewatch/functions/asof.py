"""As-of join: what was known last at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], order: list[str], width: int) -> DataFrame:
    """left's rows with `values` of right's last row of equal keys at or before `at`; null where there is none.

    Of right's rows at one time the one with the largest `order` counts. Keys that are null meet nothing. Both sides are one table, sorted
    once within slices of `width` of the line of times, so a key with most of the rows is as many tasks as it has slices; what
    the slices before know last goes to each slice as one row, and the running value over slices has a row a slice and key.
    """
    names = [c for c in left.columns if c not in (*keys, at)]
    told = F.struct(*order, *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    kept = F.struct(*(F.col(c) for c in names)) if names else F.struct(F.lit(1).alias("one"))
    asks = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__asks"), kept.alias("__row"))
    tells = right.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__asks"), told.alias("__told")).where(F.col("__at").isNotNull())
    both = asks.unionByName(tells, allowMissingColumns=True).withColumn("__slice", F.floor(F.col("__at") / width))
    # at one time what is told comes before what is asked, in its order
    nearest = W.partitionBy(*keys, "__slice").orderBy("__at", "__asks", "__told").rowsBetween(W.unboundedPreceding, 0)
    rows = both.withColumn("__within", F.last("__told", ignorenulls=True).over(nearest)).where("__asks = 1")
    slices = both.groupBy(*keys, "__slice").agg(F.max_by("__told", F.when(F.col("__told").isNotNull(), F.struct("__at", "__told"))).alias("__last"))
    earlier = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(*keys, "__slice", F.last("__last", ignorenulls=True).over(earlier).alias("__before"))
    met = rows.join(slices, [*keys, "__slice"], "left") if keys else rows.join(slices, ["__slice"], "left")
    known = F.when(F.expr(" and ".join(f"`{k}` is not null" for k in keys) or "true"), F.coalesce("__within", "__before"))
    met = met.withColumn("__known", known)
    return met.select(*keys, F.col("__at").alias(at), *(F.col(f"__row.{c}").alias(c) for c in names), *(F.col(f"__known.v{i}").alias(v) for i, v in enumerate(values)))
