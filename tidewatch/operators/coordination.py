"""Wallets that trade in step, wallets that are new, and whom the suspicious ones trade on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import divide, exact_sum
from tidewatch.functions.graph import groups
from tidewatch.functions.overlap import blocks_of, pairs_by_blocks
from tidewatch.operators.tape import wallet_trades
from tidewatch.sources.scratch import stored

#: Wallets of a bucket that one task compares with as many others.
CROWD = 256
#: Places in a block's row that cost as much as one meeting of two wallets.
MEETING = 8
HOUR = 3600
PLACE = ["market_id", "nonusdc_side", "direction", "at"]


def trade_places(trades: DataFrame, seconds: int = HOUR, exclude_sentinels: bool = True) -> DataFrame:
    """wallet, place: the (market, side, direction, stretch of time) that a wallet has traded in, each once; rows without a market, wallet or time have none."""
    rows = wallet_trades(trades, exclude_sentinels).withColumn("at", F.floor(F.unix_micros("timestamp") / (seconds * 1_000_000)))
    known = rows.where(F.col("market_id").isNotNull() & F.col("wallet").isNotNull() & F.col("at").isNotNull() & F.col("nonusdc_side").isNotNull())
    return known.select("wallet", F.struct(*PLACE).alias("place")).distinct()


def _numbered(places: DataFrame, least_shared: int) -> DataFrame:
    """wallet, n, pid, crowd: places that several wallets trade in by a number, and how many do, of the wallets that have enough places (n). A stored table."""
    # ids are those of a stored table, so they stay the same when it is read again
    busy = stored(places.groupBy("place").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1").withColumn("pid", F.monotonically_increasing_id()), "busy")
    sizes = places.groupBy("wallet").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_shared)
    return stored(places.join(sizes, "wallet").join(busy, "place").select("wallet", "n", "pid", "crowd"), "numbered")


def _leads(rows: DataFrame, least_shared: int, least_share: float) -> DataFrame:
    """wallet, n, place, crowd of the places that one of two linked wallets meets the other in.

    Wallets that share `need` of their places have one in common even when each leaves out its need - 1 busiest. So only
    the rarest n - need + 1 are left to pair on, and what everybody trades in hardly ever is among them.
    """
    need = F.greatest(F.lit(least_shared), F.ceil(F.col("n") * least_share - 1e-9))
    # places that nobody else trades in come first in the order of rarity, and pair with none
    alone = F.col("n") - F.count(F.lit(1)).over(W.partitionBy("wallet"))
    nth = F.row_number().over(W.partitionBy("wallet").orderBy("crowd", "pid")) + alone
    return rows.withColumn("nth", nth).where(F.col("nth") <= F.col("n") - need + 1).select("wallet", "n", F.col("pid").alias("place"), "crowd")


def _met(leads: DataFrame, least_share: float, crowd: int) -> DataFrame:
    """a, b, na, nb: wallets (a < b) that meet in a place. A place of many wallets is cut into squares of `crowd` times `crowd`, a key each."""
    cuts = leads.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("cuts"))
    rows = leads.join(cuts, "place").withColumn("cut", F.pmod(F.xxhash64("wallet"), F.col("cuts")).cast("int"))
    left = rows.select("place", F.col("cut").alias("i"), F.explode(F.sequence("cut", F.col("cuts") - 1)).alias("j"), F.col("wallet").alias("a"), F.col("n").alias("na"))
    right = rows.select("place", F.explode(F.sequence(F.lit(0), F.col("cut"))).alias("i"), F.col("cut").alias("j"), F.col("wallet").alias("b"), F.col("n").alias("nb"))
    similar = F.least("na", "nb") >= F.greatest("na", "nb") * least_share
    met = left.join(right, ["place", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & similar)
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return met.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb")).distinct()


def _along(leads: DataFrame, rows: DataFrame, least_shared: int, least_share: float, crowd: int) -> DataFrame:
    """The pairs of coordinated_pairs() from those that meet, what they share being counted along the smaller wallet's places."""
    met = _met(leads, least_share, crowd)
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = met.withColumns({"small": F.when(first, F.col("a")).otherwise(F.col("b")), "large": F.when(first, F.col("b")).otherwise(F.col("a"))})
    own = rows.select("wallet", F.col("pid").alias("place"))
    along = met.join(own.withColumnRenamed("wallet", "small"), "small").join(own.withColumnRenamed("wallet", "large"), ["large", "place"])
    pairs = along.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    share = divide(F.col("shared"), F.col("na") + F.col("nb") - F.col("shared"))
    return pairs.withColumn("share", share).where((F.col("shared") >= least_shared) & (F.col("share") >= least_share)).select("a", "b", "shared", "share")


def coordinated_pairs(places: DataFrame, least_shared: int = 3, least_share: float = 0.3, crowd: int = CROWD) -> DataFrame:
    """a, b, shared, share: wallets that have `least_shared` places in common, and `least_share` of all places that either has.

    Exactly the pairs that counting all pairs would find. Where few wallets meet in their rarest places, only those that do are compared. Where most do,
    blocks of wallets are compared with blocks, which shuffles places times blocks instead of a row a meeting. Four counts tell which is less.
    """
    rows = _numbered(stored(places, "places"), least_shared)
    leads = stored(_leads(rows, least_shared, least_share), "leads")
    meetings = leads.groupBy("place").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    members, wallets = rows.agg(F.count(F.lit(1)), F.count_distinct("wallet")).first()
    blocks = blocks_of(wallets, members)
    if meetings * MEETING < float(members) * blocks:
        return _along(leads, rows, least_shared, least_share, crowd)
    return pairs_by_blocks(rows, blocks, least_shared, least_share)


def coordinated_groups(pairs: DataFrame) -> DataFrame:
    """wallet, group_id (the group's first wallet by name), group_size, partners, shared: the wallets of coordinated_pairs()."""
    pairs = stored(pairs, "pairs")
    labels = groups(pairs).withColumnsRenamed({"node": "wallet", "label": "group_id"})
    sizes = labels.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("wallet"), "shared").groupBy("wallet").agg(F.count(F.lit(1)).alias("partners"), F.sum("shared").alias("shared"))
    return labels.join(ends, "wallet").join(sizes, "group_id").select("wallet", "group_id", "group_size", "partners", "shared")


def wallet_ages(trades: DataFrame, fresh_hours: int = 24, few_markets: int = 2, exclude_sentinels: bool = True) -> DataFrame:
    """A row a wallet: first and last trade, days with trades, markets, and what it put into markets that it entered within `fresh_hours` of its first trade ever.

    is_fresh: a wallet of at most `few_markets` markets, all entered while it was new.
    """
    rows = wallet_trades(trades, exclude_sentinels).where(F.col("wallet").isNotNull() & F.col("timestamp").isNotNull() & F.col("market_id").isNotNull())
    per = rows.groupBy("wallet", "market_id").agg(F.min("timestamp").alias("entered"), F.max("timestamp").alias("left"), exact_sum(F.when(F.col("direction") == "BUY", F.col("usd_amount"))).alias("usd"))
    born = per.groupBy("wallet").agg(F.min("entered").alias("first_trade"))
    days = rows.select("wallet", F.to_date("timestamp").alias("day")).distinct().groupBy("wallet").agg(F.count(F.lit(1)).alias("active_days"))
    age = F.unix_micros("entered") - F.unix_micros("first_trade")
    entries = per.join(born, "wallet").withColumn("fresh", age < fresh_hours * 3_600_000_000)
    out = entries.groupBy("wallet", "first_trade").agg(
        F.max("left").alias("last_trade"), F.count(F.lit(1)).alias("num_markets"), F.count_if("fresh").alias("fresh_markets"),
        F.coalesce(exact_sum(F.when(F.col("fresh"), F.col("usd"))), F.lit(0.0)).alias("fresh_usd"), F.coalesce(exact_sum(F.col("usd")), F.lit(0.0)).alias("bought_usd"),
    )
    is_fresh = (F.col("num_markets") <= few_markets) & (F.col("fresh_markets") == F.col("num_markets"))
    return out.join(days, "wallet").select("wallet", "first_trade", "last_trade", "active_days", "num_markets", "fresh_markets", "fresh_usd", "bought_usd", is_fresh.alias("is_fresh"))


#: Upper ends, in hours, of the classes of wallets' ages, and their names.
AGES = [(24, "under a day"), (168, "under a week"), (720, "under a month")]


def entry_ages(trades: DataFrame, exclude_sentinels: bool = True) -> DataFrame:
    """market_id, age_class, wallets, usd_amount: how old wallets were at their first trade in a market."""
    rows = wallet_trades(trades, exclude_sentinels).where(F.col("wallet").isNotNull() & F.col("timestamp").isNotNull() & F.col("market_id").isNotNull())
    per = rows.groupBy("wallet", "market_id").agg(F.min("timestamp").alias("entered"), exact_sum(F.col("usd_amount")).alias("usd"))
    born = per.groupBy("wallet").agg(F.min("entered").alias("born"))
    hours = (F.unix_micros("entered") - F.unix_micros("born")) / 3_600_000_000
    age = F.coalesce(*(F.when(hours < end, name) for end, name in AGES), F.lit("a month or more"))
    return per.join(born, "wallet").groupBy("market_id", age.alias("age_class")).agg(F.count(F.lit(1)).alias("wallets"), exact_sum(F.col("usd")).alias("usd_amount"))


def entity_leaderboard(positions: DataFrame, entities: DataFrame, suspects: DataFrame, limit: int = 100) -> DataFrame:
    """A row an entity that markets are about, most suspicious wallets first.

    entities: market_id, entity; a market may be about several. suspects: wallet, score. A wallet counts once an entity.
    """
    about = entities.select("market_id", "entity").distinct()
    own = positions.select("wallet", "market_id", "total_usd_in").join(about, "market_id").join(suspects.select("wallet", "score"), "wallet", "left")
    wallets = own.groupBy("entity", "wallet").agg(F.max("score").alias("score"), exact_sum(F.col("total_usd_in")).alias("usd"))
    suspect = F.col("score").isNotNull()
    people = wallets.groupBy("entity").agg(
        F.count(F.lit(1)).alias("num_wallets"), F.count_if(suspect).alias("suspicious_wallets"), F.avg("score").alias("mean_score"), F.max_by("wallet", F.struct("score", "usd", "wallet")).alias("top_wallet"),
        F.coalesce(exact_sum(F.when(suspect, F.col("usd"))), F.lit(0.0)).alias("suspicious_usd"), F.coalesce(exact_sum(F.col("usd")), F.lit(0.0)).alias("total_usd"),
    )
    # each market once, without its positions' wallets; those of suspects are few
    hit = positions.select("wallet", "market_id").join(suspects.where("score is not null").select("wallet"), "wallet", "left_semi").select("market_id", F.lit(1).alias("hit")).distinct()
    markets = positions.select("market_id").distinct().join(hit, "market_id", "left").join(about, "market_id").groupBy("entity").agg(F.count(F.lit(1)).alias("num_markets"), F.coalesce(F.sum("hit"), F.lit(0)).alias("suspicious_markets"))
    rows = people.join(markets, "entity").where("suspicious_wallets > 0").withColumn("suspicious_share", divide(F.col("suspicious_usd"), F.col("total_usd")))
    columns = ["entity", "suspicious_wallets", "suspicious_markets", "num_wallets", "num_markets", "suspicious_usd", "total_usd", "suspicious_share", "mean_score", "top_wallet"]
    return rows.select(*columns).orderBy(F.desc("suspicious_wallets"), F.desc("suspicious_usd"), "entity").limit(limit)
