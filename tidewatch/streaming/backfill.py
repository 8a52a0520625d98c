"""Days of a stored price history computed again when trades come after the stream has closed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import timing
from tidewatch.sources import exists, schemas
from tidewatch.sources.scratch import stored

NAMES = [c.split()[0] for c in schemas.PRICE_HISTORY.split(", ")]


def write_history(history: DataFrame, path: str) -> None:
    """Price history as Parquet by day; only the days that history has are replaced."""
    days = history.select(*NAMES, F.to_date("bucket_start").alias("day"))
    days.repartition("day").sortWithinPartitions("market_id", "bucket_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{schemas.PRICE_HISTORY}, day date"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else schemas.empty(spark, schema)


def backfill(spark: SparkSession, path: str, days: DataFrame, trades: DataFrame) -> None:
    """Compute (market_id, day) of `days` anew from all trades, late ones included, and leave all others as they are.

    Of the stored table only the partitions of these days are read, and written again in one step. Repeating it changes nothing. A null market is
    a market. A day on which a market has no trade any more loses its rows.
    """
    days = stored(days.select("market_id", "day").distinct(), "late_days")
    late = days.withColumnsRenamed({"market_id": "late_market", "day": "late_day"})

    def named(rows: DataFrame, day: str, how: str) -> DataFrame:
        return rows.join(late, F.col("market_id").eqNullSafe(F.col("late_market")) & (F.to_date(day) == F.col("late_day")), how)

    again = timing.price_history(named(trades, "timestamp", "left_semi"))
    old = read_history(spark, path).join(days.select("day").distinct(), "day", "left_semi")
    rest = named(old, "bucket_start", "left_anti")
    rows = stored(rest.select(*NAMES).unionByName(again.select(*NAMES)), "backfill")
    # a day that has lost its last row isn't replaced by a write of no rows
    write_history(rows, path)
    gone = days.select("day").distinct().join(rows.select(F.to_date("bucket_start").alias("day")).distinct(), "day", "left_anti")
    for row in gone.collect():  # days whose every market is gone
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={row['day']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
