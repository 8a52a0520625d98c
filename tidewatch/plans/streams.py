"""Queries that read their tables as streams, land files, and end when all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import streaming
from tidewatch.operators import calibration, timing
from tidewatch.plans.queries import Query, candidates, shown
from tidewatch.plans.studies import page_stories
from tidewatch.sources import tapes
from tidewatch.sources.scratch import scratch
from tidewatch.sources.tapes import table
from tidewatch.streaming import alerts, backfill, stories

FOUND: dict[str, Query] = {}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def _landing(rows: DataFrame, path: str) -> DataFrame:
    """rows written to a folder and read from there as a stream."""
    rows.write.mode("append").parquet(path)
    # operators that keep state of their own need this store
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return streaming.landing(rows.sparkSession, path, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes))


@query
def stream_unique(spark: SparkSession, d: str) -> DataFrame:
    """Splits that paging has read twice, each once."""
    path = scratch(spark, "splits")
    rows = tapes.orders_activity(spark, d)["splits"].withColumn("timestamp", F.timestamp_seconds("timestamp"))
    once = streaming.unique(_landing(rows, f"{path}/in"))
    streaming.run_available(once, f"{path}/out", f"{path}/checkpoint")
    return shown(spark.read.schema(once.schema).parquet(f"{path}/out"))


@query
def stream_positions(spark: SparkSession, d: str) -> DataFrame:
    """Running positions of the events tape, which lands in three parts; the last update of each counts."""
    path, tape = scratch(spark, "positions"), tapes.events_tape(spark, d)
    for part in range(3):
        rows = streaming.running_positions(_landing(tape.where(F.col("ord") % 3 == part), f"{path}/in"))
        streaming.run_upserts(rows, f"{path}/out", f"{path}/checkpoint")
    return shown(streaming.latest(spark, f"{path}/out", ["wallet", "market_id", "side"]))


@query
def stream_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Moves of five-minute history by arrival."""
    path = scratch(spark, "spikes")
    history = timing.price_history(tapes.events_tape(spark, d))
    rows = streaming.price_spikes(_landing(history, f"{path}/in"))
    streaming.run_available(rows, f"{path}/out", f"{path}/checkpoint")
    return shown(spark.read.schema(rows.schema).parquet(f"{path}/out"))


@query
def stream_pre_spike(spark: SparkSession, d: str) -> DataFrame:
    """Trades ahead of the candidates' moves, both as streams: first each transaction's rows once, then the look-back join."""
    path, tape = scratch(spark, "pre-spike"), tapes.events_tape(spark, d)
    # all lands at once, so the watermark may stand at the last trade
    once = streaming.once_per_transaction(_landing(tape.where("usd_amount >= 1"), f"{path}/trades"), "0 seconds")
    streaming.run_available(once, f"{path}/once", f"{path}/checkpoint-once")
    rows = spark.read.schema(once.schema).parquet(f"{path}/once")
    met = streaming.pre_spike_trades(_landing(rows, f"{path}/once-in").withWatermark("timestamp", "40 days"), _landing(candidates(spark, d), f"{path}/spikes"), "40 days")
    streaming.run_available(met, f"{path}/out", f"{path}/checkpoint")
    return shown(streaming.summed_pre_spike(spark.read.schema(met.schema).parquet(f"{path}/out")))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return calibration.prices(tapes.events_tape(spark, d)).select("market_id", F.timestamp_micros("at").alias("at"), "price", "ord")


@query
def movement_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Prices a quarter or more away from the oldest of the last 20 of their market in six hours."""
    return shown(alerts.alerts(_points(spark, d), 0.25, 20, 6 * 3600, 86_400))


@query
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "alerts")
    rows = alerts.stream_alerts(_landing(_points(spark, d), f"{path}/in"), "1 hour", 0.25, 20, 6 * 3600)
    streaming.run_available(rows, f"{path}/out", f"{path}/checkpoint")
    return shown(spark.read.schema(rows.schema).parquet(f"{path}/out"))


@query
def stream_stories(spark: SparkSession, d: str) -> DataFrame:
    """Pages as stories that land in two parts; the last version of each."""
    path, pages = scratch(spark, "stories"), page_stories(spark, d)
    for part in range(2):
        rows = stories.stream_stories(_landing(pages.where(F.col("story_id") % 2 == part), f"{path}/in"), "1 day", 7 * 86_400)
        streaming.run_upserts(rows, f"{path}/out", f"{path}/checkpoint")
    last = streaming.latest(spark, f"{path}/out", stories.KEY).drop("version")
    return shown(last.withColumn("sources", F.array_join("sources", ",")))


@query
def feed_with_withdrawals(spark: SparkSession, d: str) -> DataFrame:
    """Users as stories, markets as moves, values as points, a fifth of them withdrawn, in three batches of which one comes twice."""
    events = table(spark, d, "events").select(F.col("user_id").alias("story_id"), F.regexp_extract("props", "([0-9]+)", 1).try_cast("long").alias("spike_id"), F.when(F.col("event_id") % 5 != 0, F.round("value", 6)).alias("points"), F.col("event_id").alias("revision"))
    feed = stories.ImpactFeed(spark, scratch(spark, "feed"), 50)
    last = events.agg(F.max("revision")).first()[0] or 0
    for number in (0, 1, 1, 2):
        own = events.where(F.floor(F.col("revision") * 3 / (last + 1)) == number)
        feed.apply(own.groupBy("story_id", "spike_id").agg(F.max_by("points", "revision").alias("points"), F.max("revision").alias("revision")), number)
    return shown(feed.feed())


@query
def late_backfill(spark: SparkSession, d: str) -> DataFrame:
    """A price history whose tenth of trades came late, after the days that they name have been computed again."""
    path, tape = f"{scratch(spark, 'history')}/table", tapes.events_tape(spark, d)
    late = F.col("ord") % 10 == 3
    backfill.write_history(timing.price_history(tape.where(~late)), path)
    closed = tape.agg(F.max("timestamp").alias("closed_until"))
    _, days = streaming.split_late(tape.where(late), closed)
    # the last trade isn't late by this time, so its day is named by hand
    newest = tape.where(late & F.col("timestamp").isNotNull()).select("market_id", F.to_date("timestamp").alias("day"))
    backfill.backfill(spark, path, days.unionByName(newest), tape)
    return shown(backfill.read_history(spark, path).select(*backfill.NAMES))


def queries() -> dict[str, Query]:
    return dict(FOUND)

