"""Raw fills and activity to the trade tape, and the tape to wallets.

A tape has timestamp, market_id, maker, taker, nonusdc_side (token1, token2), maker_direction and taker_direction
(BUY, SELL), price, usd_amount, token_amount, transactionHash and ord, the source's order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import MICRO, divide, keep_first

#: Makers of the rows that stand for activity: fixed values.
SPLIT, MERGE, REDEEM = "CONTRACT_SPLIT", "CONTRACT_MERGE", "CONTRACT_REDEEM"
CASH = "0"
COLUMNS = ["timestamp", "market_id", "maker", "taker", "nonusdc_side", "maker_direction", "taker_direction", "price", "usd_amount", "token_amount", "transactionHash"]


def token_lookup(markets: DataFrame) -> DataFrame:
    """market_id, side, asset_id: two rows a market."""
    return markets.select(F.col("id").cast("long").alias("market_id"), "token1", "token2").unpivot(["market_id"], ["token1", "token2"], "side", "asset_id")


def condition_lookup(markets: DataFrame) -> DataFrame:
    """condition_id, market_id: one market a condition, the smallest id."""
    known = markets.where("condition_id is not null and condition_id <> ''")
    return known.groupBy("condition_id").agg(F.min(F.col("id").cast("long")).alias("market_id"))


def _opposite(direction: Column) -> Column:
    return F.when(direction == "BUY", "SELL").otherwise("BUY")


def fills_to_trades(fills: DataFrame, lookup: DataFrame) -> DataFrame:
    """Trades of order fills; a fill of an unknown token stays, without a market.

    The token that isn't cash is the maker's unless the maker gave cash. A side is labelled by its
    asset: cash, or the side that the lookup gives the token; that is why an unknown token of the
    maker counts as the cash side, and one of the taker has the maker's amount.
    """
    ids = lookup.select(F.col("asset_id").alias("token"), F.col("market_id"), F.col("side"))
    rows = fills.withColumn("token", F.when(F.col("makerAssetId") != CASH, F.col("makerAssetId")).otherwise(F.col("takerAssetId"))).join(ids, "token", "left")
    label = lambda asset: F.when(F.col(asset) == CASH, "USDC").otherwise(F.col("side"))
    rows = rows.withColumn("maker_label", label("makerAssetId")).withColumn("taker_label", label("takerAssetId"))
    gives, gets = F.col("makerAmountFilled") / MICRO, F.col("takerAmountFilled") / MICRO
    taker_pays = F.col("taker_label") == "USDC"
    maker_token = F.col("maker_label") != "USDC"
    usd = F.when(taker_pays, gets).otherwise(gives)
    tokens = F.when(F.col("taker_label") != "USDC", gets).otherwise(gives)
    price = F.when(taker_pays, divide(gets, gives)).otherwise(divide(gives, gets))
    direction = F.when(taker_pays, "BUY").otherwise("SELL")
    return rows.select(
        F.timestamp_seconds("timestamp").alias("timestamp"), "market_id", "maker", "taker",
        F.when(maker_token, F.col("maker_label")).otherwise(F.col("taker_label")).alias("nonusdc_side"),
        _opposite(direction).alias("maker_direction"), direction.alias("taker_direction"),
        price.alias("price"), usd.alias("usd_amount"), tokens.alias("token_amount"), "transactionHash",
    )


def without_aggregate_fills(fills: DataFrame, tolerance: int = 0) -> DataFrame:
    """fills without those that only sum up the others of their transaction, as exchanges emit them; off by default.

    Of three or more fills of one token in one transaction, the one goes whose tokens and whose cash are each the sum of the others'
    within `tolerance` raw units. Where several are (the others have no amounts then), the one with the largest id by code point goes. Fills without a transaction stay.
    """
    names = fills.columns
    from_maker = F.col("makerAssetId") != CASH
    token = F.when(from_maker, F.col("makerAssetId")).otherwise(F.col("takerAssetId"))
    rows = fills.withColumns({"__token": token, "__tokens": F.when(from_maker, F.col("makerAmountFilled")).otherwise(F.col("takerAmountFilled")), "__cash": F.when(from_maker, F.col("takerAmountFilled")).otherwise(F.col("makerAmountFilled"))})
    of = W.partitionBy("transactionHash", "__token")
    equal = lambda c: F.abs(2 * F.col(c) - F.sum(c).over(of)) <= tolerance
    sums = rows.withColumn("__sums", F.coalesce((F.count(F.lit(1)).over(of) >= 3) & equal("__tokens") & equal("__cash") & F.col("transactionHash").isNotNull(), F.lit(False)))
    last = F.max(F.when(F.col("__sums"), F.col("id"))).over(of)
    return sums.withColumn("__last", last).where(~F.col("__sums") | (F.col("id") < F.col("__last"))).select(*names)


def unique_source_rows(rows: DataFrame) -> DataFrame:
    """One row an id: paging reads the second that it stopped in twice."""
    others = [F.col(c).asc_nulls_last() for c in rows.columns if c not in ("id", "timestamp")]
    return keep_first(rows, ["id"], F.col("timestamp"), *others)


def _activity(rows: DataFrame, lookup: DataFrame, wallet: str, maker: str, direction: Column, sides: Column, price: float, usd: Column, tokens: Column) -> DataFrame:
    known = rows.join(lookup, rows["condition"] == lookup["condition_id"])
    known = known.select(F.timestamp_seconds("timestamp").alias("timestamp"), "market_id", F.lit(maker).alias("maker"), F.col(wallet).alias("taker"), F.explode(sides).alias("nonusdc_side"), _opposite(direction).alias("maker_direction"), direction.alias("taker_direction"), F.lit(price).alias("price"), usd.alias("usd_amount"), tokens.alias("token_amount"), F.col("id").alias("transactionHash"))
    return known.select(*COLUMNS)


def splits_to_trades(splits: DataFrame, lookup: DataFrame) -> DataFrame:
    """A split buys both sides at .50."""
    tokens = F.col("amount").try_cast("double") / MICRO
    return _activity(splits, lookup, "stakeholder", SPLIT, F.lit("BUY"), F.array(F.lit("token1"), F.lit("token2")), 0.5, tokens / 2, tokens)


def merges_to_trades(merges: DataFrame, lookup: DataFrame) -> DataFrame:
    """A merge sells both sides at .50."""
    tokens = F.col("amount").try_cast("double") / MICRO
    return _activity(merges, lookup, "stakeholder", MERGE, F.lit("SELL"), F.array(F.lit("token1"), F.lit("token2")), 0.5, tokens / 2, tokens)


def redemptions_to_trades(redemptions: DataFrame, lookup: DataFrame) -> DataFrame:
    """A redemption sells one side at 1: token1 where its index sets hold a 1 anywhere, else token2 where they hold a 2."""
    paid = F.col("payout").try_cast("double") / MICRO
    side = F.when(F.col("indexSets").contains("1"), "token1").when(F.col("indexSets").contains("2"), "token2").otherwise("token1")
    return _activity(redemptions, lookup, "redeemer", REDEEM, F.lit("SELL"), F.array(side), 1.0, paid, paid)


def activity_to_trades(splits: DataFrame, merges: DataFrame, redemptions: DataFrame, markets: DataFrame) -> DataFrame:
    """The tape of all activity, each source row once."""
    lookup = condition_lookup(markets)
    unique = unique_source_rows
    return splits_to_trades(unique(splits), lookup).unionByName(merges_to_trades(unique(merges), lookup)).unionByName(redemptions_to_trades(unique(redemptions), lookup))


def wallet_trades(trades: DataFrame, exclude_sentinels: bool = False) -> DataFrame:
    """Each trade seen by its maker and by its taker: wallet, direction, role (0 maker, 1 taker), and the trade's columns."""
    views = F.array(*(F.struct(F.lit(i).alias("role"), F.col(who).alias("wallet"), F.col(f"{who}_direction").alias("direction")) for i, who in enumerate(("maker", "taker"))))
    rest = [c for c in trades.columns if c not in ("maker", "taker", "maker_direction", "taker_direction")]
    rows = trades.select(*rest, F.inline(views))
    return rows.where(~F.col("wallet").isin(SPLIT, MERGE, REDEEM)) if exclude_sentinels else rows


def once_per_transaction(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows of one transaction with equal keys the maker's, then the first in source order."""
    return keep_first(rows, ["transactionHash", "wallet", "market_id", *keys], F.col("role"), F.col("ord"), F.col("usd_amount"), F.col("price"), F.col("token_amount"))
