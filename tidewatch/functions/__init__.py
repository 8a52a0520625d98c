"""Column expressions and small relational helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MICRO, NANO = 1_000_000, 1_000_000_000
#: Rows that a task sorts or adds up in memory.
ROWS_A_TASK = 1_000_000
#: Bits that keys are hashed to, 64 a row: 2^20 rows at most.
SLOTS = 1 << 26


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clipped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null, which least() and greatest() alone wouldn't keep."""
    bounded = x
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(x.isNotNull(), bounded)


def exact_sum(x: Column, scale: int = MICRO) -> Column:
    """Sum of amounts as whole multiples of 1 / scale, so that it doesn't depend on the order of the rows."""
    return F.sum(F.floor(x * scale + 0.5)) / float(scale)


def exact_mean(x: Column, scale: int = NANO) -> Column:
    return divide(exact_sum(x, scale), F.count(x))


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks that so many rows are dealt to where the session's number would give a task too many; None where it does."""
    wanted = -(-rows // ROWS_A_TASK)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df by its keys, to `tasks` tasks if given."""
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def thinned(df: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """df without most of the rows whose key isn't among another table's; all others stay, so an exact join is to follow.

    Each key has one of SLOTS bits by its hash. The words of 64 bits that have any set are broadcast, and df is read past them before it is dealt anywhere.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    words = wanted.select(slot(name).alias("__slot")).groupBy(F.shiftright("__slot", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__slot % 64 as int)))").alias("__bits"))
    # a semi join, as Spark would move the exact one that follows below an inner join
    return df.join(F.broadcast(words), (F.shiftright(slot(key), 6) == F.col("__word")) & (F.getbit("__bits", (slot(key) % 64).cast("int")) == 1), "left_semi")


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group of equal keys, in an order that has to be total."""
    return df.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def _cuts(df: DataFrame, group: str, value: str, parts: int) -> Column:
    """Map of group -> ascending bounds that cut its values into about equal parts: parts numbers a group."""
    rows = df.groupBy(group).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("cuts")).collect()
    pairs = [x for r in rows if r["cuts"] for x in (F.lit(r[group]), F.array(*map(F.lit, sorted(set(r["cuts"])))))]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,array<double>>")


def counted_below(df: DataFrame, group: str, value: str, parts: int = 64) -> DataFrame:
    """group, value, n, below, total: for each distinct value its rows, the rows of smaller values, and all rows of its group.

    A running sum over all values would be one task a group. Values are cut into ranges instead; the
    running sums are within a range, and the ranges' totals, `parts` a group, are added.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    bounds = F.coalesce(_cuts(df, group, value, parts)[F.col(group)], F.array().cast("array<double>"))
    values = values.withColumn("range", F.size(F.filter(bounds, lambda c: c < F.col(value))))
    totals = values.groupBy(group, "range").agg(F.sum("n").alias("in_range"))
    totals = totals.withColumn("before", F.coalesce(F.sum("in_range").over(W.partitionBy(group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    totals = totals.withColumn("total", F.sum("in_range").over(W.partitionBy(group))).drop("in_range")
    within = F.coalesce(F.sum("n").over(W.partitionBy(group, "range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return values.withColumn("within", within).join(totals, [group, "range"]).select(group, value, "n", (F.col("before") + F.col("within")).alias("below"), "total")


def nearest_quantile(df: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """One row: the value at 0-based place round((n - 1) q) of the ascending values; null without values."""
    placed = counted_below(df.select(F.lit("all").alias("g"), F.col(value).cast("double").alias("v")), "g", "v")
    place = F.floor((F.col("total") - 1) * q + 0.5)
    return placed.where((F.col("below") <= place) & (place < F.col("below") + F.col("n"))).agg(F.max("v").alias(name))


def ranged_median(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row: the median, the mean of the two middle values where there are two; null without values. No task holds all values."""
    placed = counted_below(df.select(F.lit("all").alias("g"), F.col(value).cast("double").alias("v")), "g", "v")
    holds = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
    middle = [F.max(F.when(holds(F.floor((F.col("total") - 1 + more) / 2)), F.col("v"))) for more in (0, 1)]
    return placed.agg(((middle[0] + middle[1]) / 2).alias(name))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a table of one row."""
    return df.crossJoin(F.broadcast(one))


def binned_interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, bin_size: int) -> DataFrame:
    """Points within intervals (ends included) of equal keys, through bins of the number line.

    Every interval is repeated for the bins that it touches, so it has to be a few bins long.
    """
    binned = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    return points.withColumn("__bin", F.floor(F.col(at) / bin_size)).join(binned, [*keys, "__bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__bin")


def _ranged(df: DataFrame, value: str, parts: int) -> DataFrame:
    """df with __range: the number of the stretch of values that a row is in, of about equal rows; equal values are in one."""
    cuts = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("cuts")).first()["cuts"]  # parts numbers
    return df.withColumn("__range", F.size(F.filter(F.lit(sorted(set(cuts or []))).cast("array<double>"), lambda c: c < F.col(value).cast("double"))))


def _carried(rows: DataFrame, value: Column, fold, name: str) -> DataFrame:
    """rows with what `fold` makes of value in all ranges before: a row a range is all that is in one task."""
    per = rows.groupBy("__range").agg(fold(value).alias("__one"))
    before = fold("__one").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    return rows.join(F.broadcast(per.select("__range", before.alias(name))), "__range")


def reached(df: DataFrame, keys: list[str], start: str, end: str, name: str = "reach", parts: int = 64) -> DataFrame:
    """df with the latest end of all intervals that begin before, in the order of start and end; null for the first.

    Without keys the line is cut into ranges: the running maximum is within a range, and what the ranges before reach comes from one row of each.
    """
    if keys:
        return df.withColumn(name, F.max(end).over(W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)))
    rows = _ranged(df, start, parts)
    within = F.max(end).over(W.partitionBy("__range").orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    rows = _carried(rows.withColumn("__within", within), F.col(end), F.max, "__carried")
    return rows.withColumn(name, F.greatest("__within", "__carried")).drop("__range", "__within", "__carried")


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int, name: str = "island", strict: bool = False) -> DataFrame:
    """df with the number of the run that an interval belongs to: it begins a new one where it starts more than `gap` after all earlier ends."""
    rows = reached(df, keys, start, end, "__reach")
    apart = F.col(start) - F.col("__reach") >= gap if strict else F.col(start) - F.col("__reach") > gap
    rows = rows.withColumn("__new", F.when(F.col("__reach").isNull() | apart, 1).otherwise(0)).drop("__reach")
    if keys:
        return rows.withColumn(name, F.sum("__new").over(W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, 0))).drop("__new")
    rows = _ranged(rows, start, 64)
    within = F.sum("__new").over(W.partitionBy("__range").orderBy(start, end).rowsBetween(W.unboundedPreceding, 0))
    rows = _carried(rows.withColumn("__within", within), F.col("__new"), F.sum, "__carried")
    return rows.withColumn(name, F.col("__within") + F.coalesce("__carried", F.lit(0))).drop("__new", "__range", "__within", "__carried")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")
