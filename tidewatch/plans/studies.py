"""Queries of the studies: coordination, calibration, indices, momentum, news."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import micros, with_row
from tidewatch.operators import calibration, coordination, indices, metrics, news, timing
from tidewatch.operators.positions import last_prices, resolutions
from tidewatch.plans.queries import Query, day_outcomes, day_positions, shown
from tidewatch.sources import tapes
from tidewatch.sources.scratch import stored
from tidewatch.sources.tapes import table

FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def _pairs(spark: SparkSession, d: str, shared: int, share: float) -> DataFrame:
    """Wallets of the events tape with places in common; a place is a market, side, direction and day there."""
    return coordination.coordinated_pairs(coordination.trade_places(tapes.events_tape(spark, d), 86_400), shared, share)


@query
def coordinated_pairs(spark: SparkSession, d: str) -> DataFrame:
    return shown(_pairs(spark, d, 3, 0.01))


@query
def coordinated_groups(spark: SparkSession, d: str) -> DataFrame:
    return coordination.coordinated_groups(_pairs(spark, d, 4, 0.02))


@query
def wallet_ages(spark: SparkSession, d: str) -> DataFrame:
    return shown(coordination.wallet_ages(tapes.events_tape(spark, d), 48, 60))


@query
def entry_ages(spark: SparkSession, d: str) -> DataFrame:
    return shown(coordination.entry_ages(tapes.events_tape(spark, d)))


@query
def entity_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Brands of parts by the wallets on them that a ROI of 2 or more makes suspicious."""
    needed = ["wallet", "market_id", "total_usd_in", "total_usd_out", "net_tokens", "first_trade_timestamp", "last_trade_timestamp", "resolution", "position_won"]
    positions = stored(day_positions(spark, d).select(*needed), "positions")
    suspects = stored(metrics.roi(positions).where("flagged").select("wallet", F.round("roi", 6).alias("score")), "suspects")
    entities = table(spark, d, "part").select(F.col("p_partkey").alias("market_id"), F.col("p_brand").alias("entity"))
    return shown(coordination.entity_leaderboard(positions, entities, suspects))


def _event_points(spark: SparkSession, d: str) -> DataFrame:
    trades = tapes.events_tape(spark, d)
    return calibration.horizon_prices(trades, resolutions(tapes.events_markets(spark, d), last_prices(trades)))


def _day_points(spark: SparkSession, d: str) -> DataFrame:
    """Slices of a year, as a market of this tape has a trade in weeks."""
    return calibration.horizon_prices(tapes.lineitem_tape(spark, d), day_outcomes(spark, d), (24, 168, 720), 365 * 86_400)


@query
def horizon_prices(spark: SparkSession, d: str) -> DataFrame:
    return shown(_event_points(spark, d))


@query
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    return shown(calibration.calibration(_day_points(spark, d)))


@query
def brier_by_horizon(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("market_id"), F.col("p_brand").alias("category"))
    return shown(calibration.brier_by_horizon(_day_points(spark, d), brands))


@query
def biggest_upsets(spark: SparkSession, d: str) -> DataFrame:
    return shown(calibration.biggest_upsets(_day_points(spark, d), 168))


@query
def time_to_accuracy(spark: SparkSession, d: str) -> DataFrame:
    trades = tapes.events_tape(spark, d)
    return shown(calibration.time_to_accuracy(trades, resolutions(tapes.events_markets(spark, d), last_prices(trades))))


@query
def day_grid(spark: SparkSession, d: str) -> DataFrame:
    return shown(indices.day_grid(tapes.events_tape(spark, d)))


@query
def composite_index(spark: SparkSession, d: str) -> DataFrame:
    """Five indices over the markets of the events tape, and one over all."""
    markets = tapes.events_markets(spark, d).select(F.col("id").cast("long").alias("market_id"))
    names = F.array(F.lit("all"), F.concat(F.lit("fifth "), F.col("market_id") % 5))
    return shown(indices.composite_index(tapes.events_tape(spark, d), markets.select("market_id", F.explode(names).alias("index_name"))))


@query
def volume_scores(spark: SparkSession, d: str) -> DataFrame:
    return shown(indices.volume_scores(tapes.events_tape(spark, d)))


@query
def momentum(spark: SparkSession, d: str) -> DataFrame:
    return shown(indices.momentum(tapes.events_tape(spark, d)))


@query
def momentum_board(spark: SparkSession, d: str) -> DataFrame:
    return shown(indices.momentum_board(indices.momentum(tapes.events_tape(spark, d), 30), 10, 1.0))


def _stories(spark: SparkSession, d: str) -> DataFrame:
    """Documents as stories that are published at seconds between the first and the last event, by their ids."""
    at = F.floor(micros("ts") / 1_000_000)
    span = table(spark, d, "events").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    rows = with_row(table(spark, d, "documents"), span)
    return rows.select(F.col("doc_id").alias("story_id"), F.timestamp_seconds(F.col("first") + (F.col("doc_id") * 7919) % (F.col("last") - F.col("first") + 1)).alias("published_at"), "text")


def _moves(spark: SparkSession, d: str) -> DataFrame:
    rows = timing.price_spikes(timing.price_history(tapes.events_tape(spark, d)))
    return rows.select("spike_id", "market_id", F.col("spike_end_ts").alias("at"), "magnitude_pp")


def _attributions(spark: SparkSession, d: str, moves: DataFrame) -> DataFrame:
    """Six hours back, as documents are few; a market's text is the benchmark item of its number."""
    markets = table(spark, d, "benchmark").select(F.col("item_id").alias("market_id"), "text")
    return news.attributions(moves, _stories(spark, d), markets, 6 * 3600)


@query
def news_attributions(spark: SparkSession, d: str) -> DataFrame:
    return shown(_attributions(spark, d, _moves(spark, d)))


@query
def impact_feed(spark: SparkSession, d: str) -> DataFrame:
    moves = stored(_moves(spark, d), "moves")
    points = news.contributions(_attributions(spark, d, moves), moves, news.move_volumes(moves, tapes.events_tape(spark, d)))
    return shown(news.impact_feed(points.withColumn("points", F.round("points", 6)), 50))


def page_stories(spark: SparkSession, d: str) -> DataFrame:
    """Pages as stories: the title is the headline, and the id decides the minute."""
    at = F.timestamp_seconds(1_704_067_200 + (F.col("page_id") * 7919) % 1009 * 60)
    return table(spark, d, "pages").select(F.col("page_id").alias("story_id"), at.alias("published_at"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("headline"), "url")


@query
def merged_stories(spark: SparkSession, d: str) -> DataFrame:
    rows = news.merged_stories(page_stories(spark, d))
    return shown(rows.withColumn("sources", F.array_join("sources", ",")))


def queries() -> dict[str, Query]:
    return dict(FOUND)
