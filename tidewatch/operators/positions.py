"""Positions of wallets and the outcomes of markets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import dealt, divide, exact_sum
from tidewatch.operators.tape import MERGE, REDEEM, SPLIT, once_per_transaction, wallet_trades

#: Last price of token1 from which it has won, and up to which it has lost.
WON, LOST = 0.85, 0.15
#: Parts that a market's positions are dealt to, by wallet.
SLICES = 8


def position_sums(rows: DataFrame, *more: str) -> DataFrame:
    """One row a (wallet, market, side) of wallet_trades(), with columns that a wallet or market fixes."""
    of = lambda direction, col: F.coalesce(exact_sum(F.when(F.col("direction") == direction, F.col(col))), F.lit(0.0))
    sums = rows.groupBy("wallet", "market_id", F.col("nonusdc_side").alias("side"), *more).agg(
        of("BUY", "usd_amount").alias("total_usd_in"), of("BUY", "token_amount").alias("tokens_bought"), of("SELL", "usd_amount").alias("total_usd_out"), of("SELL", "token_amount").alias("tokens_sold"),
        F.count("timestamp").alias("num_trades"), F.min("timestamp").alias("first_trade_timestamp"), F.max("timestamp").alias("last_trade_timestamp"),
    )
    net = F.greatest(F.col("tokens_bought") - F.col("tokens_sold"), F.lit(0.0))
    return sums.withColumn("net_tokens", net).withColumn("avg_entry_price", divide(F.col("total_usd_in"), F.when(F.col("tokens_bought") > 0, F.col("tokens_bought"))))


def last_prices(trades: DataFrame, exclude_synthetic: bool = False) -> DataFrame:
    """market_id, last_price: the latest price of token1, ties by source order."""
    rows = trades.where((F.col("nonusdc_side") == "token1") & F.col("price").isNotNull() & F.col("market_id").isNotNull())
    if exclude_synthetic:
        rows = rows.where(~F.col("maker").isin(SPLIT, MERGE, REDEEM))
    return rows.groupBy("market_id").agg(F.max_by("price", F.struct("timestamp", "ord", "usd_amount", "price")).alias("last_price"))


def resolutions(markets: DataFrame, last: DataFrame) -> DataFrame:
    """market_id, market_volume, closed_time, market_question, resolution."""
    rows = markets.select(F.col("id").cast("long").alias("market_id"), F.col("volume").alias("market_volume"), F.col("closedTime").alias("closed_time"), F.col("question").alias("market_question")).join(last, "market_id", "left")
    known = F.col("closed_time").isNotNull() & F.col("last_price").isNotNull()
    outcome = F.when(known & (F.col("last_price") >= WON), "token1").when(known & (F.col("last_price") <= LOST), "token2").when(known, "ambiguous").otherwise("unresolved")
    return rows.withColumn("resolution", outcome).drop("last_price")


def wallet_positions(trades: DataFrame, markets: DataFrame, exclude_sentinels: bool = False, exclude_synthetic_prices: bool = False, outcomes: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Positions with their market's outcome; position_won is never null.

    Trades are dealt by market and slice of wallets once, for the sums and for the outcomes, which come once a slice and are looked up by hash, as
    sorting positions for it is more than all else. outcomes: the resolutions() of the markets, if known already. tasks: how many trades are dealt to.
    """
    rows = once_per_transaction(wallet_trades(trades, exclude_sentinels), "nonusdc_side", "direction")
    rows = dealt(rows.withColumn("slice", F.pmod(F.hash("wallet"), F.lit(SLICES))), tasks, "market_id", "slice")
    outcome = resolutions(markets, last_prices(trades, exclude_synthetic_prices)) if outcomes is None else outcomes
    outcome = outcome.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    joined = position_sums(rows, "slice").join(outcome.hint("shuffle_hash"), ["market_id", "slice"], "left").drop("slice").withColumn("resolution", F.coalesce("resolution", F.lit("unresolved")))
    return joined.withColumn("position_won", F.coalesce(F.col("resolution").isin("token1", "token2") & (F.col("resolution") == F.col("side")), F.lit(False)))
