"""Coverage, gaps, manifests and partition plans of landed data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import divide, islands, reached

TOLERANCE = 60


def coverage_stats(rows: DataFrame, worker: str, part: str, size: str, at: str) -> DataFrame:
    """A row a worker, and one of all (worker null): rows, bytes, parts, first and last second. Two aggregations, the second over parts."""
    parts = rows.groupBy(worker, part).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("bytes"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    return parts.rollup(F.col(worker).alias("worker")).agg(F.sum("n").alias("num_rows"), F.sum("bytes").alias("num_bytes"), F.count(F.lit(1)).alias("num_parts"), F.min("lo").alias("min_ts"), F.max("hi").alias("max_ts"))


def merged_intervals(intervals: DataFrame, tolerance: int = TOLERANCE, keys: tuple[str, ...] = ()) -> DataFrame:
    """start, end of the runs of intervals (start, end) that are within `tolerance` of each other, for each of the keys."""
    rows = islands(intervals, list(keys), "start", "end", tolerance)
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps(intervals: DataFrame, expected: DataFrame, tolerance: int = TOLERANCE, keys: tuple[str, ...] = ()) -> DataFrame:
    """gap_start, gap_end of the stretches longer than `tolerance` that no interval covers.

    expected: one row (for each of the keys) of expected_start and expected_end. The expected ends are intervals of
    length 0 here, so head, inner and tail gaps are all gaps between neighbours.
    """
    ends = expected.select(*keys, F.explode(F.array("expected_start", "expected_end")).alias("start")).withColumn("end", F.col("start"))
    merged = merged_intervals(intervals, tolerance, keys).unionByName(ends)
    rows = reached(merged, list(keys), "start", "end").select(*keys, F.col("reach").alias("gap_start"), F.col("start").alias("gap_end"))
    rows = (rows.join(expected, list(keys)) if keys else rows.crossJoin(F.broadcast(expected))).where((F.col("gap_start") >= F.col("expected_start")) & (F.col("gap_end") <= F.col("expected_end")))
    return rows.where(F.col("gap_end") - F.col("gap_start") > tolerance).select(*keys, "gap_start", "gap_end")


def covered_share(gap_rows: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: covered_pct of the expected stretch."""
    span = F.col("expected_end") - F.col("expected_start")
    lost = gap_rows.agg(F.coalesce(F.sum(F.col("gap_end") - F.col("gap_start")), F.lit(0)).alias("lost"))
    return expected.crossJoin(lost).select(F.coalesce(divide((span - F.col("lost")) * 100, span), F.lit(0.0)).alias("covered_pct"))


def manifest(spark: SparkSession, folder: str, row_counts: DataFrame) -> DataFrame:
    """path, length, md5, num_rows of the chunk files of a folder. row_counts: path, num_rows. A file is read whole, so chunks are to be a few hundred MB at most."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "chunk_*").load(folder).select("path", "length", F.md5("content").alias("md5"))
    return files.join(row_counts, "path", "left").withColumn("num_rows", F.coalesce("num_rows", F.lit(0)))


def plan_violations(plan: DataFrame, start: int, end: int) -> DataFrame:
    """worker_id, problem: nothing for a plan (worker_id, start_ts, end_ts) that covers start to end without gaps, overlaps and empty parts."""
    order = W.orderBy("start_ts", "end_ts", "worker_id")
    rows = plan.withColumn("before", F.lag("end_ts").over(order)).withColumn("after", F.lead("start_ts").over(order)).withColumn("same", F.count(F.lit(1)).over(W.partitionBy("worker_id")))
    found = F.filter(F.array(
        F.when(F.col("before").isNull() & (F.col("start_ts") != start), "starts elsewhere"), F.when(F.col("after").isNull() & (F.col("end_ts") != end), "ends elsewhere"),
        F.when(F.col("before") != F.col("start_ts"), "gap or overlap"), F.when(F.col("end_ts") <= F.col("start_ts"), "no length"), F.when(F.col("same") > 1, "repeated worker"),
    ), lambda x: x.isNotNull())
    out = rows.select("worker_id", F.explode(found).alias("problem"))
    none = plan.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("long").alias("worker_id"), F.lit("empty plan").alias("problem"))
    return out.withColumn("worker_id", F.col("worker_id").cast("long")).unionByName(none)


def density(events: DataFrame, at: str, start: int, end: int, probes: int = 600) -> DataFrame:
    """probe, ts, rate (events an hour), cumulative (by the trapezoid rule) at `probes` times of the stretch; the events between two of them count for the first."""
    step = (end - start) / probes
    place = F.least(F.floor((F.col(at) - start) / step), F.lit(probes - 1)).cast("int")
    counts = events.where(F.col(at).between(start, end - 1)).groupBy(place.alias("probe")).agg(F.count(F.lit(1)).alias("n"))
    grid = events.sparkSession.range(probes).select(F.col("id").cast("int").alias("probe"))
    rows = grid.join(counts, "probe", "left").select("probe", F.floor(F.col("probe") * step + start).cast("long").alias("ts"), (F.coalesce("n", F.lit(0)) * (3600.0 / step)).alias("rate"))
    order = W.orderBy("probe")
    area = (F.lag("rate").over(order) + F.col("rate")) / 2 * ((F.col("ts") - F.lag("ts").over(order)) / 3600.0)
    rows = rows.withColumn("area", F.coalesce(area, F.lit(0.0)))
    return rows.withColumn("cumulative", F.sum("area").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("area")


def partition_plan(profile: DataFrame, start: int, end: int, workers: int, least: int = 60) -> DataFrame:
    """worker_id, start_ts, end_ts: stretches of about equal events by a density profile (a row a probe), none shorter than `least` seconds.

    A boundary lies where the cumulative curve, linear between probes, reaches its share of all events.
    Boundaries that are too near to the one before, or to the end, are left out, which joins their stretches.
    """
    order = W.orderBy("probe")
    total = profile.agg(F.max_by(F.col("cumulative") + F.col("rate") * ((F.lit(end) - F.col("ts")) / 3600.0), "probe").alias("total"))
    steps = profile.select("probe", F.lag("ts").over(order).alias("ts0"), F.lag("cumulative").over(order).alias("c0"), F.col("ts").alias("ts1"), F.col("cumulative").alias("c1")).where("c0 is not null")
    wanted = profile.sparkSession.range(1, workers).crossJoin(F.broadcast(total)).select(F.col("id").alias("k"), (F.col("total") / workers * F.col("id")).alias("goal"))
    # the first probe at which the curve is at the goal
    met = steps.join(F.broadcast(wanted), (F.col("c1") >= F.col("goal")) & (F.col("c0") < F.col("goal")))
    inner = met.groupBy("k").agg(F.min(F.floor(F.col("ts0") + (F.col("goal") - F.col("c0")) / (F.col("c1") - F.col("c0")) * (F.col("ts1") - F.col("ts0")))).alias("at"))
    bounds = inner.agg(F.array_sort(F.collect_set("at")).alias("x"))  # workers - 1 numbers at most
    kept = F.aggregate("x", F.array(F.lit(start).cast("long")), lambda kept, b: F.when((b - F.element_at(kept, -1) >= least) & (F.lit(end) - b >= least), F.concat(kept, F.array(b))).otherwise(kept))
    rows = bounds.select(F.posexplode(kept).alias("worker_id", "start_ts"))
    return rows.select(F.col("worker_id").cast("long").alias("worker_id"), "start_ts", F.coalesce(F.lead("start_ts").over(W.orderBy("worker_id")), F.lit(end).cast("long")).alias("end_ts"))
