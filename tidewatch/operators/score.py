"""The aggregate score: percentile ranks of eight metrics, weighted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import MICRO, counted_below, dealt, divide, exact_sum, tasks_for, with_row
from tidewatch.operators import metrics
from tidewatch.sources.scratch import stored

#: metric: (value, number of bets it rests on, weight): fixed values.
SCORED = {
    "contrarian_win_rate": ("contrarian_win_rate", "contrarian_bet_count", 0.15),
    "niche_market_accuracy": ("niche_win_rate", "niche_bet_count", 0.10),
    "profit_factor": ("profit_factor", "resolved_bet_count", 0.15),
    "brier_score": ("brier_skill_vs_consensus", "resolved_bet_count", 0.15),
    "position_concentration": ("max_concentration", "total_positions", 0.10),
    "win_streak": ("longest_win_streak", "resolved_bet_count", 0.10),
    "roi": ("roi", "resolved_bet_count", 0.15),
    "bet_size_vs_odds": ("longshot_win_rate", "longshot_bet_count", 0.10),
}
CAPPED = ("profit_factor", "roi")


def _long(tables: dict[str, DataFrame]) -> DataFrame:
    """wallet, metric, value, bets of the eight metrics' tables."""
    return reduce(DataFrame.unionByName, (t.select("wallet", F.lit(n).alias("metric"), F.col(SCORED[n][0]).cast("double").alias("value"), F.col(SCORED[n][1]).alias("bets")) for n, t in tables.items()))


def fused_values(positions: DataFrame, outcomes: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """wallet, metric, value, bets of all eight metrics, the same as from their tables, in one walk over the positions.

    Positions are dealt by market side once, for the consensus of prices, and by wallet once: in the order of a wallet's first trades each run of
    wins is a row of whole sums, and a wallet's runs add up to all that the eight values need. tasks: how many they are dealt to by wallet.
    """
    rows = with_row(metrics.resolved(positions).withColumn("pnl", metrics._pnl()), metrics.niche_volume(positions, outcomes=outcomes))
    rows = rows.withColumn("niche", F.col("market_volume") <= F.col("niche_volume")).select("wallet", "market_id", "side", "first_trade_timestamp", "total_usd_in", "avg_entry_price", "won", "pnl", "niche")
    usd, entry, won = F.col("total_usd_in"), F.col("avg_entry_price"), F.col("won")
    sides = rows.groupBy("market_id", "side").agg(divide(exact_sum(entry * usd), exact_sum(usd)).alias("consensus"))
    rows = rows.join(sides.hint("shuffle_hash"), ["market_id", "side"], "left")
    rows = dealt(rows, tasks, "wallet") if tasks else rows
    order = W.partitionBy("wallet").orderBy("first_trade_timestamp", "market_id", "side").rowsBetween(W.unboundedPreceding, 0)
    whole = lambda x: F.floor(x * MICRO + 0.5)
    only = {"contrarian": entry < 0.20, "niche": F.col("niche"), "longshot": entry < 0.10}
    added = {
        "bets": F.count("market_id"), "length": F.sum("won"), "usd": F.sum(whole(usd)), "profit": F.sum(whole(F.greatest(F.col("pnl"), F.lit(0.0)))), "loss": F.sum(whole(F.greatest(-F.col("pnl"), F.lit(0.0)))), "net": F.sum(whole(F.col("pnl"))),
        "own": F.sum(whole(F.pow(entry - won, F.lit(2.0)) * usd)), "theirs": F.sum(whole(F.pow(F.col("consensus") - won, F.lit(2.0)) * usd)),
        **{f"{n}_bets": F.count(F.when(c, F.col("market_id"))) for n, c in only.items()}, **{f"{n}_wins": F.sum(F.when(c, won)) for n, c in only.items()},
    }
    runs = rows.withColumn("run", F.sum(1 - won).over(order)).groupBy("wallet", "run").agg(F.max(usd).alias("largest"), *(x.alias(n) for n, x in added.items()))
    sums = runs.groupBy("wallet").agg(F.max("largest").alias("largest"), F.max("length").alias("longest"), *(F.sum(n).alias(n) for n in added))
    amount = lambda n: F.col(n) / float(MICRO)
    total, theirs = amount("usd"), divide(F.coalesce(amount("theirs"), F.lit(0.0)), amount("usd"))
    rate = lambda n: F.coalesce(divide(F.col(f"{n}_wins"), F.col(f"{n}_bets")), F.lit(0.0))
    skill = F.when(theirs > 0, 1.0 - divide(divide(F.coalesce(amount("own"), F.lit(0.0)), total), theirs)).otherwise(0.0)
    values = {
        "contrarian_win_rate": (rate("contrarian"), "contrarian_bets"), "niche_market_accuracy": (rate("niche"), "niche_bets"), "brier_score": (skill, "bets"), "bet_size_vs_odds": (rate("longshot"), "longshot_bets"),
        "profit_factor": (F.when(F.col("loss") > 0, divide(amount("profit"), amount("loss"))).when(F.col("profit") > 0, 999.0).otherwise(0.0), "bets"), "win_streak": (F.col("longest").cast("double"), "bets"),
        "position_concentration": (F.coalesce(divide(F.col("largest"), F.when(total > 0, total)), F.lit(0.0)), "bets"), "roi": (F.coalesce(divide(amount("net"), F.when(total > 0, total)), F.lit(0.0)), "bets"),
    }
    return sums.select("wallet", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("value"), F.col(b).alias("bets")) for n, (v, b) in values.items()))))


def needed(positions: DataFrame) -> DataFrame:
    """What fused_values() reads of positions, as a stored table: the resolved ones, without the texts of their markets."""
    columns = ["wallet", "market_id", "side", "total_usd_in", "total_usd_out", "net_tokens", "avg_entry_price", "first_trade_timestamp", "market_volume", "resolution", "position_won"]
    return stored(metrics.resolved(positions).select(*columns), "positions")


def stored_values(positions: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """fused_values() of what is needed() of positions, dealt to as many tasks as there are rows for."""
    rows = needed(positions)
    return fused_values(rows, outcomes, tasks_for(rows.sparkSession, rows.count()))


def metric_values(values: dict[str, DataFrame] | DataFrame, least_bets: int = 5, cap_at: float = 0.99) -> DataFrame:
    """wallet, metric, value, bets: one row a wallet and metric that rests on enough bets, of fused_values() or of the metrics' tables.

    Values are rounded to nine decimals, so that equal ones are ties whatever the order of summation.
    Two metrics are capped at their nearest-rank quantile where that is above 0; those two numbers are
    computed here, and the values are stored, as ranks read them several times.
    """
    long = _long(values) if isinstance(values, dict) else values
    long = stored(long.withColumn("value", F.round("value", 9)).where((F.col("bets") >= least_bets) & F.col("value").isNotNull()), "values")
    placed = counted_below(long.where(F.col("metric").isin(*CAPPED)), "metric", "value")
    place = F.floor((F.col("total") - 1) * cap_at + 0.5)
    caps = placed.where((F.col("below") <= place) & (place < F.col("below") + F.col("n"))).groupBy("metric").agg(F.max("value").alias("cap")).where("cap > 0").collect()
    capped = F.col("value")
    for r in caps:  # two rows at most
        capped = F.when(F.col("metric") == r["metric"], F.least(F.col("value"), F.lit(r["cap"]))).otherwise(capped)
    return long.withColumn("value", capped)


def percentiles(values: DataFrame, least_wallets: int = 50, low_is_suspicious: tuple[str, ...] = ()) -> DataFrame:
    """values with score: the mean rank of equal values over the number of values, taken from 1 for metrics whose low values are suspicious; null for metrics of few wallets."""
    placed = counted_below(values, "metric", "value").select("metric", "value", F.when(F.col("total") >= least_wallets, (F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias("score"))
    if low_is_suspicious:
        placed = placed.withColumn("score", F.when(F.col("metric").isin(*low_is_suspicious), 1.0 - F.col("score")).otherwise(F.col("score")))
    return values.join(placed, ["metric", "value"])


def quantiles(scores: DataFrame, value: str = "aggregate_score", at: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """q and the value at 0-based place round((n - 1) q) of the ascending values, one row for each of `at`."""
    placed = counted_below(scores.select(F.lit("all").alias("g"), F.col(value).cast("double").alias("v")), "g", "v").withColumn("q", F.explode(F.array(*map(F.lit, at))))
    place = F.floor((F.col("total") - 1) * F.col("q") + 0.5)
    return placed.where((F.col("below") <= place) & (place < F.col("below") + F.col("n"))).select("q", F.col("v").alias("value"))


def aggregate(scored: DataFrame, least_metrics: int = 3) -> DataFrame:
    """One row a wallet: raw_, num_bets_ and score_ of each metric, and the weighted mean of the scores that there are."""
    of = lambda name, col: F.max(F.when(F.col("metric") == name, F.col(col)))
    columns = [x for name in SCORED for x in (of(name, "value").alias(f"raw_{name}"), of(name, "bets").alias(f"num_bets_{name}"), of(name, "score").alias(f"score_{name}"))]
    out = scored.groupBy("wallet").agg(*columns)
    there = lambda name: F.col(f"score_{name}").isNotNull()
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    out = out.withColumn("num_metrics_available", add(there(n).cast("int") for n in SCORED).cast("long"))
    out = out.withColumn("total_weight_coverage", add(F.when(there(n), w).otherwise(0.0) for n, (_, _, w) in SCORED.items()))
    weighted = add(F.coalesce(F.col(f"score_{n}") * w, F.lit(0.0)) for n, (_, _, w) in SCORED.items())
    return out.withColumn("aggregate_score", F.round(F.when(F.col("num_metrics_available") >= least_metrics, divide(weighted, F.col("total_weight_coverage"))), 9))


def ranked(scores: DataFrame) -> DataFrame:
    """scores with suspicion_rank: 1 is the highest score, ties by wallet; null without a score."""
    placed = counted_below(scores.select(F.lit("all").alias("g"), F.col("aggregate_score").alias("s")), "g", "s")
    placed = placed.select(F.col("s").alias("aggregate_score"), (F.col("total") - F.col("below") - F.col("n")).alias("above"))
    tied = F.row_number().over(W.partitionBy("aggregate_score").orderBy("wallet"))
    have = scores.where("aggregate_score is not null").join(placed, "aggregate_score").withColumn("suspicion_rank", (F.col("above") + tied).cast("long")).drop("above")
    return have.unionByName(scores.where("aggregate_score is null").withColumn("suspicion_rank", F.lit(None).cast("long")))


def all_metrics(positions: DataFrame, outcomes: DataFrame | None = None) -> dict[str, DataFrame]:
    of_markets = {"niche_market_accuracy", "position_concentration"} if outcomes is not None else ()
    return {name: function(positions, outcomes=outcomes) if name in of_markets else function(positions) for name, (function, _) in metrics.ALL.items()}


def aggregate_score(positions: DataFrame, least_bets: int = 5, least_metrics: int = 3, least_wallets: int = 50, outcomes: DataFrame | None = None) -> DataFrame:
    """The aggregate of the eight metrics of positions. Positions, values and scores are stored on the way, and ranks counted in a few small jobs, while this is built."""
    values = metric_values(stored_values(positions, outcomes), least_bets)
    return ranked(stored(aggregate(percentiles(values, least_wallets), least_metrics), "scores"))
