"""Eight measures of how implausible a wallet's results are, one row a wallet each.

All read positions and look at resolved ones only. Thresholds are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import MICRO, clipped, divide, exact_mean, exact_sum, nearest_quantile, with_row

NAIVE_BRIER = 0.25


def resolved(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("resolution").isin("token1", "token2")).withColumn("won", F.coalesce(F.col("position_won"), F.lit(False)).cast("long"))


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _pnl() -> Column:
    return F.when(F.col("won") == 1, F.col("net_tokens")).otherwise(0.0) + F.col("total_usd_out") - F.col("total_usd_in")


def contrarian_win_rate(positions: DataFrame, below: float = 0.20, flag_rate: float = 0.60, least_bets: int = 5) -> DataFrame:
    rows = resolved(positions).where(F.col("avg_entry_price") < below)
    out = rows.groupBy("wallet").agg(F.count("market_id").alias("contrarian_bet_count"), F.sum("won").alias("contrarian_wins"), exact_sum(F.col("total_usd_in")).alias("contrarian_usd_deployed"), F.avg("avg_entry_price").alias("mean_contrarian_entry_price"))
    out = out.withColumn("contrarian_win_rate", F.coalesce(divide(F.col("contrarian_wins"), F.col("contrarian_bet_count")), F.lit(0.0)))
    return out.withColumn("flagged", (F.col("contrarian_win_rate") > flag_rate) & (F.col("contrarian_bet_count") >= least_bets))


def niche_volume(positions: DataFrame, q: float = 0.25, outcomes: DataFrame | None = None) -> DataFrame:
    """One row: the volume up to which a market is niche, over the distinct resolved markets.

    outcomes: the resolutions() that the positions were made with. A market resolves by a trade of it, so each resolved one has
    positions, and the quantile needs a row a market instead of the positions, which would be computed anew for it.
    """
    per_market = resolved(positions).groupBy("market_id").agg(F.max("market_volume").alias("market_volume")) if outcomes is None else outcomes.where(F.col("resolution").isin("token1", "token2")).select("market_id", "market_volume")
    return nearest_quantile(per_market, "market_volume", q, "niche_volume")


def niche_accuracy(positions: DataFrame, q: float = 0.25, flag_rate: float = 0.70, least_bets: int = 5, outcomes: DataFrame | None = None) -> DataFrame:
    rows = with_row(resolved(positions), niche_volume(positions, q, outcomes))
    niche = F.col("market_volume") <= F.col("niche_volume")
    only = lambda x: F.when(niche, x)
    out = rows.groupBy("wallet").agg(
        F.count(only(F.col("market_id"))).alias("niche_bet_count"), F.sum(only(F.col("won"))).alias("niche_wins"), exact_sum(only(F.col("total_usd_in"))).alias("niche_usd_deployed"),
        F.avg(only(F.col("avg_entry_price"))).alias("mean_niche_entry_price"), exact_mean(only(F.col("market_volume")), MICRO).alias("mean_market_volume"),
        F.count("market_id").alias("total_bet_count"), divide(F.sum("won"), F.count("market_id")).alias("overall_win_rate"),
    ).where("niche_bet_count > 0")
    out = out.withColumn("niche_win_rate", divide(F.col("niche_wins"), F.col("niche_bet_count")))
    out = out.withColumn("niche_vs_overall_delta", F.col("niche_win_rate") - F.col("overall_win_rate"))
    return out.withColumn("flagged", (F.col("niche_win_rate") > flag_rate) & (F.col("niche_bet_count") >= least_bets))


def profit_factor(positions: DataFrame, flag_factor: float = 5.0, least_volume: float = 1000.0, least_bets: int = 5) -> DataFrame:
    rows = resolved(positions).withColumn("pnl", _pnl())
    out = rows.groupBy("wallet").agg(
        F.count("market_id").alias("resolved_bet_count"), F.sum("won").alias("wins"), exact_sum(F.col("total_usd_in")).alias("total_volume"),
        exact_sum(F.greatest(F.col("pnl"), F.lit(0.0))).alias("gross_profit"), exact_sum(F.greatest(-F.col("pnl"), F.lit(0.0))).alias("gross_loss"), exact_sum(F.col("pnl")).alias("net_pnl"),
    )
    factor = F.when(F.col("gross_loss") > 0, divide(F.col("gross_profit"), F.col("gross_loss"))).when(F.col("gross_profit") > 0, 999.0).otherwise(0.0)
    out = out.withColumn("profit_factor", factor).withColumn("win_rate", divide(F.col("wins"), F.col("resolved_bet_count")))
    return out.withColumn("flagged", (F.col("profit_factor") > flag_factor) & (F.col("total_volume") >= least_volume) & (F.col("resolved_bet_count") >= least_bets))


def brier_skill(positions: DataFrame, flag_skill: float = 0.20, least_bets: int = 10) -> DataFrame:
    """Squared error of entry prices, weighted by USD, against a naive .25 and against each market side's mean entry price.

    A side that nobody bought has no mean entry price and counts for nobody: its null is skipped.
    """
    rows = resolved(positions).withColumn("error", F.pow(F.col("avg_entry_price") - F.col("won"), F.lit(2.0)))
    sides = rows.groupBy("market_id", "side").agg(divide(exact_sum(F.col("avg_entry_price") * F.col("total_usd_in")), exact_sum(F.col("total_usd_in"))).alias("consensus"))
    rows = rows.join(sides, ["market_id", "side"], "left").withColumn("consensus_error", F.pow(F.col("consensus") - F.col("won"), F.lit(2.0)))
    out = rows.groupBy("wallet").agg(
        F.count("market_id").alias("resolved_bet_count"), exact_sum(F.col("total_usd_in")).alias("total_volume"), F.sum("won").alias("wins"), F.avg("avg_entry_price").alias("mean_entry_price"),
        exact_sum(F.col("error") * F.col("total_usd_in")).alias("own"), exact_sum(F.col("consensus_error") * F.col("total_usd_in")).alias("theirs"),
    )
    out = out.withColumn("brier_score", divide(F.coalesce("own", F.lit(0.0)), F.col("total_volume"))).withColumn("market_consensus_brier", divide(F.coalesce("theirs", F.lit(0.0)), F.col("total_volume"))).drop("own", "theirs")
    out = out.withColumn("brier_skill_vs_naive", 1.0 - F.col("brier_score") / NAIVE_BRIER)
    out = out.withColumn("brier_skill_vs_consensus", F.when(F.col("market_consensus_brier") > 0, 1.0 - divide(F.col("brier_score"), F.col("market_consensus_brier"))).otherwise(0.0))
    out = out.withColumn("win_rate", divide(F.col("wins"), F.col("resolved_bet_count")))
    return out.withColumn("flagged", (F.col("brier_skill_vs_consensus") > flag_skill) & (F.col("resolved_bet_count") >= least_bets))


def position_concentration(positions: DataFrame, flag_share: float = 0.50, least_bets: int = 3, q: float = 0.25, outcomes: DataFrame | None = None) -> DataFrame:
    """The share of a wallet's capital in its largest position, from one aggregation: shares' squares are the amounts' squares over the total's."""
    rows = resolved(positions)
    largest = F.max_by(F.struct("market_id", "total_usd_in", "won", "market_volume", "side", "resolution"), F.struct(F.col("total_usd_in"), -F.col("market_id"), F.when(F.col("side") == "token1", 1).otherwise(0)))
    out = rows.groupBy("wallet").agg(F.count("market_id").alias("total_positions"), exact_sum(F.col("total_usd_in")).alias("wallet_total_capital"), F.sum(F.col("total_usd_in") * F.col("total_usd_in")).alias("squares"), largest.alias("top"))
    total = F.col("wallet_total_capital")
    out = with_row(out, niche_volume(positions, q, outcomes)).select(
        "wallet", "total_positions", "wallet_total_capital", F.coalesce(divide(F.col("top.total_usd_in"), F.when(total > 0, total)), F.lit(0.0)).alias("max_concentration"), F.coalesce(divide(F.col("squares"), F.when(total > 0, total * total)), F.lit(0.0)).alias("hhi"),
        F.col("top.market_id").alias("largest_bet_market"), F.col("top.total_usd_in").alias("largest_bet_usd"), (F.col("top.won") == 1).alias("largest_bet_won"), F.col("top.market_volume").alias("largest_bet_market_volume"),
        F.col("top.side").alias("largest_bet_side"), F.col("top.resolution").alias("largest_bet_resolution"), F.coalesce(F.col("top.market_volume") <= F.col("niche_volume"), F.lit(False)).alias("largest_bet_is_niche"),
    )
    out = out.withColumn("flagged", (F.col("max_concentration") > flag_share) & (F.col("total_positions") >= least_bets) & F.col("largest_bet_won"))
    return out.withColumn("flagged_niche", F.col("flagged") & F.col("largest_bet_is_niche"))


def win_streak(positions: DataFrame, flag_length: int = 8, least_bets: int = 5) -> DataFrame:
    """Longest and current run of wins in the order of first trades (ties by market and side).

    Rows between two losses are a run; its number is the count of losses so far, its length the wins in it.
    """
    order = W.partitionBy("wallet").orderBy("first_trade_timestamp", "market_id", "side").rowsBetween(W.unboundedPreceding, 0)
    runs = resolved(positions).withColumn("run", F.sum(1 - F.col("won")).over(order))
    runs = runs.groupBy("wallet", "run").agg(F.sum("won").alias("length"), F.count("market_id").alias("bets"), exact_sum(F.col("total_usd_in")).alias("usd"))
    out = runs.groupBy("wallet").agg(exact_sum(F.col("usd")).alias("total_volume"), F.sum("length").alias("total_wins"), F.sum("bets").alias("resolved_bet_count"), F.max("length").alias("longest_win_streak"), F.max_by("length", "run").alias("current_streak"))
    out = out.withColumn("win_rate", divide(F.col("total_wins"), F.col("resolved_bet_count")))
    expected = divide(F.ln(F.col("resolved_bet_count").cast("double")), F.ln(divide(F.lit(1.0), F.col("win_rate"))))
    ratio = F.when((F.col("win_rate") > 0) & (F.col("win_rate") < 1), divide(F.col("longest_win_streak"), expected)).when(F.col("win_rate") == 1, 1.0).otherwise(0.0)
    out = out.withColumn("streak_vs_expected_ratio", ratio)
    return out.withColumn("flagged", (F.col("longest_win_streak") >= flag_length) & (F.col("resolved_bet_count") >= least_bets))


def roi(positions: DataFrame, flag_roi: float = 2.0, least_volume: float = 500.0, least_bets: int = 5, most_annual: float = 100.0) -> DataFrame:
    rows = resolved(positions).withColumn("pnl", _pnl())
    out = rows.groupBy("wallet").agg(
        F.count("market_id").alias("resolved_bet_count"), F.sum("won").alias("wins"), exact_sum(F.col("total_usd_in")).alias("total_capital_deployed"), exact_sum(F.col("pnl") + F.col("total_usd_in")).alias("total_payout"), exact_sum(F.col("pnl")).alias("net_profit"),
        F.min("first_trade_timestamp").alias("first_trade"), F.max("last_trade_timestamp").alias("last_trade"),
    )
    capital = F.col("total_capital_deployed")
    out = out.withColumn("roi", F.coalesce(divide(F.col("net_profit"), F.when(capital > 0, capital)), F.lit(0.0))).withColumn("win_rate", divide(F.col("wins"), F.col("resolved_bet_count")))
    out = out.withColumn("trading_span_days", (F.unix_micros("last_trade") - F.unix_micros("first_trade")) / F.lit(86_400_000_000.0))
    long = F.col("trading_span_days") > 30
    annual = F.when(long & (F.col("roi") >= -1), F.pow(1.0 + F.col("roi"), divide(F.lit(365.0), F.col("trading_span_days"))) - 1.0).when(long, -1.0)
    out = out.withColumn("annualized_roi", clipped(annual, -1.0, most_annual)).withColumn("profit_per_bet", divide(F.col("net_profit"), F.col("resolved_bet_count")))
    return out.withColumn("flagged", (F.col("roi") > flag_roi) & (capital >= least_volume) & (F.col("resolved_bet_count") >= least_bets))


def with_odds(positions: DataFrame, low: float = 0.10, high: float = 0.90, large: float = 10_000.0) -> DataFrame:
    """Resolved positions with what their odds say: category, extremes, size, and what a win would pay."""
    price = F.col("avg_entry_price")
    category = F.when(price < low, "extreme_longshot").when(price > high, "extreme_favorite").when(price < 0.30, "longshot").when(price > 0.70, "favorite").otherwise("mid_range")
    rows = resolved(positions).withColumn("odds_category", category).withColumn("is_extreme_odds", (price < low) | (price > high)).withColumn("is_large_bet", F.col("total_usd_in") >= large)
    rows = rows.withColumn("potential_payout_usd", F.when(price > 0, F.col("net_tokens") * (1.0 - price)).otherwise(0.0))
    return rows.withColumn("payout_ratio", F.when(price > 0, divide(F.lit(1.0), price) - 1.0).otherwise(0.0))


def bet_size_vs_odds(positions: DataFrame, low: float = 0.10, high: float = 0.90, large: float = 10_000.0, least_bets: int = 3, flag_rate: float = 0.60, flag_ratio: float = 2.0) -> DataFrame:
    rows = with_odds(positions, low, high, large)
    price, usd = F.col("avg_entry_price"), F.col("total_usd_in")

    def block(name: str, condition: Column, deployed: str, largest: str, payout: bool) -> list[Column]:
        only = lambda x: F.when(condition, x)
        found = [F.count(only(F.col("market_id"))).alias(f"{name}_count"), F.coalesce(F.sum(only(F.col("won"))), F.lit(0)).alias(f"{name.removesuffix('_bet')}_wins"), exact_sum(only(usd)).alias(deployed), F.max(only(usd)).alias(largest), F.avg(only(price)).alias(f"{name.removesuffix('_bet')}_mean_entry")]
        return [*found, exact_mean(only(F.col("potential_payout_usd")), MICRO).alias(f"{name.removesuffix('_bet')}_mean_potential_payout")] if payout else found

    out = rows.groupBy("wallet").agg(
        F.count("market_id").alias("total_bet_count"), exact_sum(usd).alias("total_volume"), exact_mean(usd, MICRO).alias("avg_bet_size"), F.sum("won").alias("total_wins"),
        exact_mean(F.when(F.col("odds_category") == "mid_range", usd), MICRO).alias("avg_bet_size_mid_range"), exact_mean(F.when(F.col("is_extreme_odds"), usd), MICRO).alias("avg_bet_size_extreme"),
        *block("longshot_bet", price < low, "longshot_usd_deployed", "longshot_max_bet_usd", True), *block("favorite_bet", price > high, "favorite_usd_deployed", "favorite_max_bet_usd", True),
        *block("large_extreme", F.col("is_extreme_odds") & F.col("is_large_bet"), "large_extreme_usd", "largest_extreme_bet_usd", False),
    )
    rate = lambda wins, n: F.coalesce(divide(F.col(wins), F.col(n)), F.lit(0.0))
    out = out.withColumns({"overall_win_rate": divide(F.col("total_wins"), F.col("total_bet_count")), "longshot_win_rate": rate("longshot_wins", "longshot_bet_count"), "favorite_win_rate": rate("favorite_wins", "favorite_bet_count"), "large_extreme_win_rate": rate("large_extreme_wins", "large_extreme_count")})
    out = out.withColumn("favorite_loss_rate", F.when(F.col("favorite_bet_count") > 0, 1.0 - F.col("favorite_win_rate")).otherwise(0.0))
    out = out.withColumn("extreme_to_midrange_size_ratio", divide(F.col("avg_bet_size_extreme"), F.when(F.col("avg_bet_size_mid_range") > 0, F.col("avg_bet_size_mid_range"))))
    out = out.withColumn("flagged_large_extreme", (F.col("large_extreme_count") >= least_bets) & (F.col("large_extreme_win_rate") > flag_rate))
    out = out.withColumn("flagged_longshot_winner", (F.col("longshot_bet_count") >= least_bets) & (F.col("longshot_win_rate") > flag_rate))
    out = out.withColumn("flagged_inverse_kelly", F.coalesce(F.col("extreme_to_midrange_size_ratio") > flag_ratio, F.lit(False)))
    return out.withColumn("flagged", F.col("flagged_large_extreme") | F.col("flagged_longshot_winner") | F.col("flagged_inverse_kelly"))


#: Each metric's function, the orders its table is shown in.
ALL = {
    "contrarian_win_rate": (contrarian_win_rate, ("flagged", "contrarian_win_rate", "contrarian_bet_count")),
    "niche_market_accuracy": (niche_accuracy, ("flagged", "niche_win_rate", "niche_bet_count")),
    "profit_factor": (profit_factor, ("flagged", "profit_factor", "total_volume")),
    "brier_score": (brier_skill, ("flagged", "brier_skill_vs_consensus")),
    "position_concentration": (position_concentration, ("flagged_niche", "flagged", "max_concentration")),
    "win_streak": (win_streak, ("flagged", "longest_win_streak", "resolved_bet_count")),
    "roi": (roi, ("flagged", "roi", "total_capital_deployed")),
    "bet_size_vs_odds": (bet_size_vs_odds, ("flagged_large_extreme", "flagged", "large_extreme_usd")),
}


def ranked_view(table: DataFrame, metric: str, limit: int) -> DataFrame:
    """The first rows of a metric's table in its order, nulls last, ties by wallet."""
    return table.orderBy(*(F.col(c).desc_nulls_last() for c in ALL[metric][1]), "wallet").limit(limit)
