"""Trade tapes, fills and activity derived from the events, lineitem and orders tables.

Two tapes stand in for prediction-market data: `events` (fine time grain, both signals) and `lineitem` with
`orders` (day grain, many rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import dealt, divide, micros, tasks_for, thinned, with_row


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _market() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).try_cast("long")


def _hundredths(x: str) -> Column:
    return F.floor(F.col(x) * 100 + 0.5).cast("long")


def events_tape(spark: SparkSession, folder: str) -> DataFrame:
    """A trade an event: the market is the number in props, the price the fraction of value / 100, two events are a transaction."""
    events = table(spark, folder, "events")
    users = events.agg((F.max("user_id") + 1).alias("users"))
    buy = F.when(F.col("event_type").isin("purchase", "click"), "BUY").otherwise("SELL")
    price = (_hundredths("value") % 10000) / 10000.0
    rows = with_row(events, users)
    return rows.select(
        F.timestamp_micros(micros("ts")).alias("timestamp"), _market().alias("market_id"), F.concat(F.lit("u"), (F.col("user_id") * 7 + F.col("event_id")) % F.col("users")).alias("maker"), F.concat(F.lit("u"), "user_id").alias("taker"),
        F.when(F.col("event_id") % 2 == 0, "token1").otherwise("token2").alias("nonusdc_side"), F.when(buy == "BUY", "SELL").otherwise("BUY").alias("maker_direction"), buy.alias("taker_direction"),
        price.alias("price"), F.col("value").alias("usd_amount"), divide(F.col("value"), price).alias("token_amount"), F.floor(F.col("event_id") / 2).cast("string").alias("transactionHash"), F.col("event_id").alias("ord"),
    )


def events_markets(spark: SparkSession, folder: str) -> DataFrame:
    """A market a number in props; one in ten isn't closed."""
    rows = table(spark, folder, "events").select(_market().alias("m"), _hundredths("value").alias("cents")).where("m is not null").groupBy("m").agg((F.sum("cents") / 100.0).alias("volume"))
    return rows.select(F.col("m").cast("string").alias("id"), F.concat(F.lit("market "), "m").alias("question"), "volume", F.when(F.col("m") % 10 != 0, "closed").alias("closedTime"), F.concat(F.lit("A"), "m").alias("token1"), F.concat(F.lit("B"), "m").alias("token2"), F.concat(F.lit("c"), "m").alias("condition_id"))


def lineitem_tasks(spark: SparkSession, folder: str) -> int | None:
    """Tasks that the trades of lineitem are dealt to; the count comes from the files' footers."""
    return tasks_for(spark, table(spark, folder, "lineitem").count())


def lineitem_tape(spark: SparkSession, folder: str, markets: DataFrame | None = None) -> DataFrame:
    """A trade a line: the part is the market, the customer the taker, the supplier the maker, the order the transaction.

    Both tables are dealt by the transaction, whatever their size, so that what goes by transaction next needs no other exchange.
    markets: market_id of the markets whose trades are wanted; other lines are left out before they are dealt, most of them where they are read.
    """
    tasks = lineitem_tasks(spark, folder)
    order = F.col("o_orderkey").cast("string").alias("order")
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders").select(order, "o_custkey").hint("merge")
    if markets is not None:
        lines = thinned(lines, "l_partkey", markets, "market_id")
        lines = lines.join(markets.select("market_id").hint("shuffle_hash"), lines["l_partkey"] == markets["market_id"], "left_semi")
    lines = lines.withColumn("transactionHash", F.col("l_orderkey").cast("string"))
    if tasks:
        lines, orders = dealt(lines, tasks, "transactionHash"), dealt(orders, tasks, "order").hint("merge")
    sell = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    price = (2 * F.col("l_quantity") - 1) / 100.0
    return lines.join(orders, lines["transactionHash"] == orders["order"]).select(
        F.timestamp_micros(micros("l_shipdate")).alias("timestamp"), F.col("l_partkey").alias("market_id"), F.concat(F.lit("s"), "l_suppkey").alias("maker"), F.concat(F.lit("c"), "o_custkey").alias("taker"),
        F.when(F.col("l_linenumber") % 2 == 0, "token1").otherwise("token2").alias("nonusdc_side"), F.when(sell == "BUY", "SELL").otherwise("BUY").alias("maker_direction"), sell.alias("taker_direction"),
        price.alias("price"), F.col("l_extendedprice").alias("usd_amount"), divide(F.col("l_extendedprice"), price).alias("token_amount"), "transactionHash", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
    )


def lineitem_markets(spark: SparkSession, folder: str) -> DataFrame:
    """A market a part; one in ten isn't closed."""
    volume = table(spark, folder, "lineitem").groupBy("l_partkey").agg((F.sum(_hundredths("l_extendedprice")) / 100.0).alias("volume"))
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    return part.join(volume, part["p_partkey"] == volume["l_partkey"], "left").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("question"), "volume", F.when(F.col("p_partkey") % 10 != 0, "closed").alias("closedTime"))


def events_fills(spark: SparkSession, folder: str) -> DataFrame:
    """Order fills whose trades are the events tape; tokens of markets from 95 on are left to be unknown by events_token_markets()."""
    tape = events_tape(spark, folder)
    token = F.concat(F.when(F.col("nonusdc_side") == "token1", "A").otherwise("B"), "market_id")
    cash, tokens = F.floor(F.col("usd_amount") * 1_000_000 + 0.5).cast("long"), F.coalesce(F.floor(F.col("token_amount") * 1_000_000 + 0.5).cast("long"), F.lit(0).cast("long"))
    pays = F.col("taker_direction") == "BUY"
    return tape.select(
        F.col("ord").cast("string").alias("id"), F.unix_seconds("timestamp").alias("timestamp"), "maker", F.when(pays, token).otherwise("0").alias("makerAssetId"), F.when(pays, tokens).otherwise(cash).alias("makerAmountFilled"),
        "taker", F.when(pays, "0").otherwise(token).alias("takerAssetId"), F.when(pays, cash).otherwise(tokens).alias("takerAmountFilled"), "transactionHash",
    )


def events_token_markets(spark: SparkSession, folder: str) -> DataFrame:
    return events_markets(spark, folder).where(F.col("id").cast("long") < 95)


def orders_activity(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Splits, merges and redemptions, one an order by its status; every tenth is there twice, as paged sources have it."""
    orders = table(spark, folder, "orders")
    rows = orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("timestamp"), F.concat(F.lit("c"), "o_custkey").alias("who"), F.concat(F.lit("c"), F.col("o_orderkey") % 100).alias("condition"),
        F.floor(F.col("o_totalprice") * 1_000_000 + 0.5).cast("long").cast("string").alias("amount"), F.when(F.col("o_orderkey") % 3 == 0, '["1"]').when(F.col("o_orderkey") % 3 == 1, '["2"]').otherwise('["1","2"]').alias("indexSets"), "o_orderstatus",
        F.explode(F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("again"),
    )
    of = lambda status: rows.where(F.col("o_orderstatus") == status)
    moved = lambda status: of(status).select("id", "timestamp", F.col("who").alias("stakeholder"), "condition", "amount")
    return {"splits": moved("O"), "merges": moved("F"), "redemptions": of("P").select("id", "timestamp", F.col("who").alias("redeemer"), "condition", "indexSets", F.col("amount").alias("payout"))}


def condition_markets(spark: SparkSession, folder: str) -> DataFrame:
    """Markets 0 to 99 of the conditions c0 to c99, for the activity of orders."""
    return table(spark, folder, "orders").select((F.col("o_orderkey") % 100).alias("m")).distinct().select(F.col("m").cast("string").alias("id"), F.concat(F.lit("c"), "m").alias("condition_id"))
