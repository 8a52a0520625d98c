"""How right prices were before markets closed: by distance in time, by price, by category, and where they were most wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import divide, exact_mean
from tidewatch.functions.asof import as_of

#: Hours before the close at which prices are looked at.
HORIZONS = (1, 24, 168)
DAY = 86_400_000_000


def prices(trades: DataFrame) -> DataFrame:
    """market_id, at (microseconds), price, ord of the trades of token1 that tell a price."""
    rows = trades.where((F.col("nonusdc_side") == "token1") & F.col("price").isNotNull() & F.col("market_id").isNotNull() & F.col("timestamp").isNotNull())
    return rows.select("market_id", F.unix_micros("timestamp").alias("at"), "price", "ord")


def closes(trades: DataFrame, outcomes: DataFrame) -> DataFrame:
    """market_id, closed_at (microseconds of the last trade of any side), won (1 where token1 has won, else 0) of resolved markets."""
    resolved = outcomes.where(F.col("resolution").isin("token1", "token2")).select("market_id", (F.col("resolution") == "token1").cast("int").alias("won"))
    last = trades.where(F.col("market_id").isNotNull()).groupBy("market_id").agg(F.max(F.unix_micros("timestamp")).alias("closed_at"))
    return last.join(resolved, "market_id")


def horizon_prices(trades: DataFrame, outcomes: DataFrame, hours: tuple[int, ...] = HORIZONS, slice_seconds: int = 86_400) -> DataFrame:
    """market_id, hours, won, price: the last price of token1 that many hours before the close, or earlier; markets without one then are left out.

    Of prices at one time the last in source order counts.
    """
    ends = closes(trades, outcomes)
    wanted = ends.select("market_id", "won", F.explode(F.lit(list(hours))).alias("hours")).join(ends.select("market_id", "closed_at"), "market_id")
    wanted = wanted.select("market_id", "hours", "won", (F.col("closed_at") - F.col("hours") * F.lit(3_600_000_000)).alias("at"))
    met = as_of(wanted, prices(trades), ["market_id"], "at", ["price"], ["ord", "price"], slice_seconds * 1_000_000)
    return met.where("price is not null").select("market_id", "hours", "won", "price")


def calibration(points: DataFrame, bins: int = 10) -> DataFrame:
    """hours, bin (a tenth of prices, the last one with both ends), markets, mean_price, won_share, gap."""
    place = F.least(F.floor(F.round(F.col("price") * bins, 9)), F.lit(bins - 1)).cast("int")
    rows = points.groupBy("hours", place.alias("bin")).agg(F.count(F.lit(1)).alias("markets"), exact_mean(F.col("price")).alias("mean_price"), divide(F.sum("won"), F.count(F.lit(1))).alias("won_share"))
    return rows.withColumn("gap", F.col("won_share") - F.col("mean_price"))


def brier_by_horizon(points: DataFrame, categories: DataFrame) -> DataFrame:
    """category, hours, markets, brier, base_brier (that of always saying the category's share of wins), skill. categories: market_id, category; a market without one is of category null."""
    rows = points.join(categories.select("market_id", "category").distinct(), "market_id", "left")
    off = F.col("price") - F.col("won")
    out = rows.groupBy("category", "hours").agg(F.count(F.lit(1)).alias("markets"), exact_mean(off * off).alias("brier"), divide(F.sum("won"), F.count(F.lit(1))).alias("won_share"))
    out = out.withColumn("base_brier", F.col("won_share") * (1 - F.col("won_share")))
    return out.withColumn("skill", 1 - divide(F.col("brier"), F.when(F.col("base_brier") > 0, F.col("base_brier")))).select("category", "hours", "markets", "brier", "base_brier", "skill")


def biggest_upsets(points: DataFrame, hours: int, limit: int = 20) -> DataFrame:
    """market_id, price, won, surprise: the markets whose price was farthest from the outcome that many hours before the close."""
    rows = points.where(F.col("hours") == hours).withColumn("surprise", F.abs(F.col("price") - F.col("won")))
    return rows.select("market_id", "price", "won", "surprise").orderBy(F.desc(F.round("surprise", 9)), "market_id").limit(limit)


def time_to_accuracy(trades: DataFrame, outcomes: DataFrame) -> DataFrame:
    """market_id, won, hours_right: how long before its close a market's price was on the right side of one half for good; null where it never was.

    The stretch begins at the first price after the last wrong one (one half is wrong).
    """
    rows = prices(trades).join(closes(trades, outcomes), "market_id")
    right = ((F.col("won") == 1) & (F.col("price") > 0.5)) | ((F.col("won") == 0) & (F.col("price") < 0.5))
    place = F.struct("at", "ord")
    wrong = rows.groupBy("market_id").agg(F.max(F.when(~right, place)).alias("wrong"))
    after = rows.join(wrong, "market_id").where(right & (F.col("wrong").isNull() | (place > F.col("wrong"))))
    begun = after.groupBy("market_id").agg(F.min("at").alias("since"))
    out = closes(trades, outcomes).join(begun, "market_id", "left")
    return out.select("market_id", "won", ((F.col("closed_at") - F.col("since")) / 3_600_000_000).alias("hours_right"))
