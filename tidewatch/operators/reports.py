"""What an analyst asks of the results: slices, leaderboards, figures, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import exact_sum, ranged_median, with_row
from tidewatch.operators import metrics, score, timing
from tidewatch.operators.positions import wallet_positions

SORTS = ("aggregate_score", "timing_excess_ratio", "total_pre_spike_usd")
TIMING = {"num_spikes_preceded": "num_spikes_preceded", "hit_rate": "timing_hit_rate", "total_pre_spike_usd": "total_pre_spike_usd", "excess_ratio": "timing_excess_ratio"}


def overview(scores: DataFrame) -> DataFrame:
    s = F.col("aggregate_score")
    counts = scores.agg(F.count(F.lit(1)).alias("total_wallets"), F.count_if(s >= 0.8).alias("high_risk"), F.count_if((s >= 0.5) & (s < 0.8)).alias("medium_risk"), F.avg(s).alias("mean_score"), F.max(s).alias("max_score"))
    return with_row(counts, ranged_median(scores, "aggregate_score", "median_score"))


def histogram(rows: DataFrame, value: str, bins: int, *groups: str) -> DataFrame:
    """bin (its lower end) and n, for each of the groups; nulls are a bin of their own."""
    return rows.groupBy((F.floor(F.col(value) * bins) / bins).alias("bin"), *groups).agg(F.count(F.lit(1)).alias("n"))


def top_wallets(scores: DataFrame, limit: int = 100, least_metrics: int = 1) -> DataFrame:
    """The highest scores; wallets without one come last."""
    columns = ["wallet", "aggregate_score", "suspicion_rank", "num_metrics_available", "total_weight_coverage", *(f"score_{n}" for n in score.SCORED)]
    return scores.where(F.col("num_metrics_available") >= least_metrics).select(*columns).orderBy(F.col("aggregate_score").desc_nulls_last(), "wallet").limit(limit)


def leaderboard(scores: DataFrame, timings: DataFrame | None = None, limit: int = 500, least_metrics: int = 1, least_score: float = 0.0, sort_by: str = "aggregate_score") -> DataFrame:
    """Scores with what the timing signal knows of the wallets, highest `sort_by` first; wallets without a score aren't in it."""
    if sort_by not in SORTS:
        raise ValueError(f"sort_by is one of {', '.join(SORTS)}")
    rows = scores.where((F.col("num_metrics_available") >= least_metrics) & (F.col("aggregate_score") >= least_score)).select("wallet", "aggregate_score", "suspicion_rank", "num_metrics_available", *(f"score_{n}" for n in score.SCORED))
    if timings is None:
        kinds = {"num_spikes_preceded": "long"}
        rows = rows.withColumns({to: F.lit(None).cast(kinds.get(to, "double")) for to in TIMING.values()} | {"timing_flagged": F.lit(False)})
    else:
        rows = rows.join(timings.select("wallet", *(F.col(a).alias(b) for a, b in TIMING.items()), F.col("is_flagged").alias("timing_flagged")), "wallet", "left").withColumn("timing_flagged", F.coalesce("timing_flagged", F.lit(False)))
    return rows.orderBy(F.col(sort_by).desc_nulls_last(), "wallet").limit(limit)


def positions_by_usd(positions: DataFrame, wallet: str, limit: int = 200) -> DataFrame:
    columns = ["market_id", "market_question", "side", "total_usd_in", "total_usd_out", "num_trades", "avg_entry_price", "position_won", "resolution", "net_tokens", "first_trade_timestamp", "last_trade_timestamp"]
    return positions.where(F.col("wallet") == wallet).select(*columns).orderBy(F.desc("total_usd_in"), "market_id", "side").limit(limit)


def recent_pre_spike(pre_spike: DataFrame, spikes: DataFrame, wallet: str, limit: int = 200) -> DataFrame:
    own = pre_spike.where(F.col("wallet") == wallet).drop("direction")
    both = own.join(spikes.select("spike_id", "direction", "price_before", "price_after", "magnitude_pp"), "spike_id")
    columns = ["spike_id", "entry_timestamp", "market_id", "direction", "side", "correct_direction", "usd_amount", "entry_price", "lead_time_minutes", "price_before", "price_after", "magnitude_pp"]
    return both.select(*columns).orderBy(F.desc("entry_timestamp"), "spike_id", "side").limit(limit)


def win_loss(positions: DataFrame) -> DataFrame:
    return positions.groupBy("position_won").agg(F.count(F.lit(1)).alias("n"))


def of_wallet(table: DataFrame, wallet: str) -> DataFrame:
    """A wallet's rows of any result; the predicate reaches the scan of a stored table."""
    return table.where(F.col("wallet") == wallet)


def market_slice(trades: DataFrame, markets: DataFrame, market_id: int, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every result for one market alone; quantiles and means are then the slice's."""
    own, market = trades.where(F.col("market_id") == market_id), markets.where(F.col("id").cast("long") == market_id)
    positions = wallet_positions(own, market)
    prices = timing.price_history(own) if history is None else history.where(F.col("market_id") == market_id)
    spikes = timing.price_spikes(prices)
    return {"positions": positions, "price_history": prices, "price_spikes": spikes, "pre_spike_trades": timing.pre_spike_trades(spikes, own), **score.all_metrics(positions)}


def wallet_slice(positions: DataFrame, wallet: str, scores: DataFrame | None = None, timings: DataFrame | None = None, pre_spike: DataFrame | None = None) -> dict[str, DataFrame]:
    """A wallet's positions, the eight metrics of them, and its rows of what is known already."""
    own = of_wallet(positions, wallet)
    known = {"aggregate_scores": scores, "timing_scores": timings, "pre_spike_trades": pre_spike}
    return {"positions": own, **score.all_metrics(own), **{k: of_wallet(v, wallet) for k, v in known.items() if v is not None}}


def wallet_figures(wallet: str, positions: DataFrame, scores: DataFrame, timings: DataFrame, pre_spike: DataFrame) -> DataFrame:
    """One row of what a wallet's page shows beside its lists: score, ROI, profit, bet sizes, Brier skill, concentration, timing, and how many positions and trades ahead of spikes it has."""
    own = of_wallet(positions, wallet)
    tables = score.all_metrics(own)
    shown = {
        "roi": ["roi", "net_profit"], "profit_factor": ["profit_factor", "gross_profit", "gross_loss"], "bet_size_vs_odds": ["avg_bet_size", "longshot_bet_count"], "brier_score": ["brier_score", "brier_skill_vs_consensus"],
        "position_concentration": ["max_concentration", "hhi", "largest_bet_market"], "win_streak": ["longest_win_streak", "current_streak"],
    }
    row = own.agg(F.lit(wallet).alias("wallet"), F.count(F.lit(1)).alias("num_positions"), F.count_if("position_won").alias("num_won"))
    parts = [of_wallet(scores, wallet).select("wallet", "aggregate_score", "suspicion_rank"), of_wallet(timings, wallet).select("wallet", "num_spikes_preceded", "hit_rate", "excess_ratio", "is_flagged"), *(tables[n].select("wallet", *columns) for n, columns in shown.items())]
    parts.append(of_wallet(pre_spike, wallet).groupBy("wallet").agg(F.count(F.lit(1)).alias("num_pre_spike"), F.count_if("correct_direction").alias("num_correct")))
    for part in parts:  # a row at most each
        row = row.join(part, "wallet", "left")
    return row


def slice_summary(slices: dict[str, DataFrame]) -> DataFrame:
    """One row of a slice's figures."""
    counts = slices["positions"].agg(F.count(F.lit(1)).alias("positions"), F.count_distinct("wallet").alias("wallets"))
    roi = slices["roi"].agg(F.count(F.lit(1)).alias("roi_wallets"), F.avg("roi").alias("avg_roi"), F.count_if("flagged").alias("roi_flagged"))
    factor = slices["profit_factor"].agg(F.count_if("flagged").alias("profit_factor_flagged"))
    pre = slices["pre_spike_trades"].agg(F.count(F.lit(1)).alias("pre_spike_trades"), F.count_distinct("wallet").alias("pre_spike_wallets"), F.count_if("correct_direction").alias("correct"), F.coalesce(exact_sum(F.col("usd_amount")), F.lit(0.0)).alias("pre_spike_usd"))
    return counts.crossJoin(roi).crossJoin(factor).crossJoin(pre)  # four tables of one row


def timing_overview(timings: DataFrame, spikes: DataFrame) -> DataFrame:
    flagged = F.col("is_flagged")
    wallets = timings.agg(F.count(F.lit(1)).alias("total_wallets"), F.count_if(flagged).alias("flagged_wallets"), F.sum("total_pre_spike_usd").alias("total_pre_spike_usd"), F.avg(F.when(flagged, F.col("hit_rate"))).alias("avg_hit_rate_flagged"))
    return wallets.crossJoin(spikes.agg(F.count(F.lit(1)).alias("total_spikes"), F.count_distinct("market_id").alias("markets_with_spikes")))  # two tables of one row


def top_flagged(timings: DataFrame, limit: int = 100) -> DataFrame:
    columns = ["wallet", "num_spikes_preceded", "num_markets", "avg_lead_time_minutes", "total_pre_spike_usd", "hit_rate", "spike_rate", "excess_ratio", "is_flagged"]
    return timings.where("is_flagged").select(*columns).orderBy(F.desc("excess_ratio"), "wallet").limit(limit)


def _contains(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def search_wallets(scores: DataFrame, part: str, limit: int = 20) -> DataFrame:
    """Wallets whose name holds a text, in either case; % and _ are themselves."""
    return scores.where(_contains(F.col("wallet"), part)).select("wallet", "aggregate_score", "suspicion_rank", "num_metrics_available").orderBy(F.col("aggregate_score").desc_nulls_last(), "wallet").limit(limit)


def search_markets(markets: DataFrame, part: str, limit: int = 50) -> DataFrame:
    """Markets whose question holds a text, largest volume first."""
    return markets.where(_contains(F.col("question"), part)).select("id", "question", "volume").orderBy(F.col("volume").desc_nulls_last(), "id").limit(limit)


def market_list(markets: DataFrame) -> DataFrame:
    return markets.select("id", "question", "volume", "closedTime")


def metric_preview(positions: DataFrame, metric: str, limit: int = 20) -> DataFrame:
    return metrics.ranked_view(metrics.ALL[metric][0](positions), metric, limit)
