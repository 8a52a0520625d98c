"""Day grids of markets, indices chained over groups of markets, and the board of what moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import divide, with_row
from tidewatch.functions.asof import as_of
from tidewatch.operators.calibration import prices

DAY, HOUR = 86_400, 3600
BASE = 100.0
#: Days before a day whose volume weighs its markets.
TRAILING = 7
#: Hours whose volumes an hour is held against.
USUAL = 168


def _seconds(ts: str = "timestamp") -> Column:
    return F.unix_seconds(F.col(ts))


def _cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("long")


def day_prices(trades: DataFrame) -> DataFrame:
    """market_id, day (number since 1970), price (the last of token1 that day, null without one), cents (volume of all trades)."""
    rows = trades.where(F.col("market_id").isNotNull() & F.col("timestamp").isNotNull()).withColumn("day", F.floor(_seconds() / DAY))
    told = (F.col("nonusdc_side") == "token1") & F.col("price").isNotNull()
    last = F.max_by("price", F.when(told, F.struct("timestamp", "ord", "price")))
    return rows.groupBy("market_id", "day").agg(last.alias("price"), F.sum(_cents(F.col("usd_amount"))).alias("cents"))


def day_grid(trades: DataFrame) -> DataFrame:
    """market_id, day, price, cents, traded: each market on every day from its first price to the last day of all trades.

    A day without a price has the last known one. A market has a row a day, so its window is as long as the data are in days.
    """
    days = day_prices(trades)
    span = days.groupBy("market_id").agg(F.min(F.when(F.col("price").isNotNull(), F.col("day"))).alias("first")).where("first is not null")
    span = with_row(span, days.agg(F.max("day").alias("last")))
    grid = span.select("market_id", F.explode(F.sequence("first", "last")).alias("day")).join(days, ["market_id", "day"], "left")
    upto = W.partitionBy("market_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return grid.select("market_id", "day", F.last("price", ignorenulls=True).over(upto).alias("price"), F.coalesce("cents", F.lit(0)).alias("cents"), F.col("cents").isNotNull().alias("traded"))


def composite_index(trades: DataFrame, members: DataFrame, trailing: int = TRAILING, base: float = BASE) -> DataFrame:
    """index_name, day, level, change, markets, mean_price: indices over groups of markets, chained from day to day.

    members: index_name, market_id. A market weighs its volume of the `trailing` days before the day, so weights are known when the day
    begins and change daily; one that enters counts from its second day on. The index moves by the ratio of the weighted prices of
    the same markets today and yesterday; a day on which none has a weight or a price above 0 leaves it where it was. mean_price is today's weighted mean.
    """
    per = W.partitionBy("market_id").orderBy("day")
    grid = day_grid(trades).withColumns({"before": F.lag("price").over(per), "weight": F.sum("cents").over(per.rangeBetween(-trailing, -1))})
    rows = grid.join(members.select("index_name", "market_id").distinct(), "market_id")
    live = F.col("before").isNotNull() & (F.col("weight") > 0)
    # whole millionths times whole cents add up exactly
    value = lambda p: F.sum(F.when(live, F.floor(F.col(p) * 1_000_000 + 0.5).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")))
    days = rows.groupBy("index_name", "day").agg(value("price").alias("now"), value("before").alias("then"), F.sum(F.when(live, F.col("weight"))).alias("weights"), F.count_if(live).alias("markets"))
    ratio = F.coalesce(F.when((F.col("then") > 0) & (F.col("now") > 0), divide(F.col("now"), F.col("then"))), F.lit(1.0))
    days = days.withColumn("ratio", ratio)
    chain = W.partitionBy("index_name").orderBy("day").rowsBetween(W.unboundedPreceding, 0)  # a row a day
    level = F.exp(F.sum(F.ln("ratio")).over(chain)) * base
    return days.select("index_name", "day", level.alias("level"), (F.col("ratio") - 1).alias("change"), "markets", divide(F.col("now"), F.col("weights").cast("double") * 1_000_000).alias("mean_price"))


def hour_volumes(trades: DataFrame) -> DataFrame:
    """market_id, hour (number since 1970), cents, trades."""
    rows = trades.where(F.col("market_id").isNotNull() & F.col("timestamp").isNotNull())
    return rows.groupBy("market_id", F.floor(_seconds() / HOUR).alias("hour")).agg(F.sum(_cents(F.col("usd_amount"))).alias("cents"), F.count(F.lit(1)).alias("trades"))


def volume_scores(trades: DataFrame, usual: int = USUAL) -> DataFrame:
    """market_id, hour, cents, hours, z: each traded hour's volume against the `usual` hours before it, those without trades included.

    The moments come from whole cents: n * sum of squares - square of the sum, exact in decimals, whatever the order of the rows. z is null in a
    market's first two hours and where all hours before were alike.
    """
    order = W.partitionBy("market_id").orderBy("hour")
    before = order.rangeBetween(-usual, -1)
    rows = hour_volumes(trades).withColumns({
        "born": F.min("hour").over(W.partitionBy("market_id")), "s": F.coalesce(F.sum("cents").over(before), F.lit(0)).cast("decimal(38,0)"),
        "q": F.coalesce(F.sum(F.col("cents").cast("decimal(19,0)") * F.col("cents").cast("decimal(19,0)")).over(before), F.lit(0)).cast("decimal(38,0)"),
    })
    n = F.least(F.lit(usual), F.col("hour") - F.col("born"))
    spread = n.cast("decimal(10,0)") * F.col("q") - F.col("s") * F.col("s")
    z = (n * F.col("cents") - F.col("s").cast("double")) / F.sqrt(F.when(spread > 0, spread.cast("double")))
    return rows.select("market_id", "hour", "cents", n.alias("hours"), F.when(n >= 2, z).alias("z"))


def momentum(trades: DataFrame, new_days: int = 7, usual: int = USUAL) -> DataFrame:
    """A row a market, as of the last trade of all: price, change_24h, volume_24h, volume_before (the 24 hours before), hours_open, is_new, top_z (highest score of an hour of the last 24)."""
    second = F.unix_micros("timestamp")
    now = trades.agg(F.max(second).alias("now"))
    day = DAY * 1_000_000
    rows = with_row(trades.where(F.col("market_id").isNotNull() & F.col("timestamp").isNotNull()).withColumn("at", second), now)
    recent = lambda x, a, b: F.coalesce(F.sum(F.when((F.col("at") > F.col("now") - b * day) & (F.col("at") <= F.col("now") - a * day), x)), F.lit(0))
    cents = _cents(F.col("usd_amount"))
    sums = rows.groupBy("market_id", "now").agg(recent(cents, 0, 1).alias("volume_24h"), recent(cents, 1, 2).alias("volume_before"), F.min("at").alias("born"))
    asked = sums.select("market_id", F.explode(F.array(F.struct(F.lit("price").alias("what"), F.col("now").alias("at")), F.struct(F.lit("before").alias("what"), (F.col("now") - day).alias("at")))).alias("x")).select("market_id", "x.*")
    told = as_of(asked, prices(trades), ["market_id"], "at", ["price"], ["ord", "price"], day).groupBy("market_id").agg(*(F.max(F.when(F.col("what") == w, F.col("price"))).alias(w) for w in ("price", "before")))
    scores = with_row(volume_scores(trades, usual), now).where(F.col("hour") > F.floor(F.col("now") / (HOUR * 1_000_000)) - 24).groupBy("market_id").agg(F.max("z").alias("top_z"))
    out = sums.join(told, "market_id").join(scores, "market_id", "left")
    hours = (F.col("now") - F.col("born")) / (HOUR * 1_000_000)
    return out.select(
        "market_id", "price", (F.col("price") - F.col("before")).alias("change_24h"), (F.col("volume_24h") / 100.0).alias("volume_24h"), (F.col("volume_before") / 100.0).alias("volume_before"),
        hours.alias("hours_open"), (F.col("now") - F.col("born") <= new_days * day).alias("is_new"), "top_z",
    )


def momentum_board(markets: DataFrame, limit: int = 10, least_z: float = 3.0) -> DataFrame:
    """board, place, market_id, value: the markets of momentum() that moved most in 24 hours, had most volume, are newest, or had an hour of unusual volume."""
    boards = {
        "movers": (F.col("change_24h").isNotNull(), F.abs("change_24h"), F.col("change_24h")), "volume": (F.col("volume_24h") > 0, F.col("volume_24h"), F.col("volume_24h")),
        "new": (F.col("is_new"), -F.col("hours_open"), F.col("hours_open")), "spikes": (F.col("top_z") >= least_z, F.col("top_z"), F.col("top_z")),
    }
    out = None
    for name, (wanted, by, value) in boards.items():
        top = markets.where(wanted).select("market_id", F.round(by, 9).alias("by"), value.cast("double").alias("value")).orderBy(F.desc("by"), "market_id").limit(limit)
        # `limit` rows a board
        placed = top.select(F.lit(name).alias("board"), F.row_number().over(W.orderBy(F.desc("by"), "market_id")).alias("place"), "market_id", "value")
        out = placed if out is None else out.unionByName(placed)
    return out
