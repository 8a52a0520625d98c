"""SQL of the queries of landed files, leaderboards and slices, on the parts of tidewatch.plans.sql."""

from __future__ import annotations

import re

from tidewatch.plans.sql import BASE, BRIER, CANDIDATES, CONCENTRATION, CONTRARIAN, DAY, EVENT, FACTOR, HISTORY, METRICS, NICHE, NICHES, POSITIONS, PRE, REAL, RESOLVED, ROI, ROLLING, SCORES, SIZES, STREAK, TIMING, VALUES, _plain, _sql

LONG = VALUES.partition(",\nadmitted as")[0]
#: Positions of one wallet in place of all, for metrics of a slice.
SLICE = POSITIONS.replace("\npositions as (", "\nall_positions as (").replace("\nresolved as (", "\npositions as (select * from all_positions where wallet = (select wallet from all_positions group by 1 order by count(*) desc, wallet limit 1)),\nresolved as (")
BOARD = [EVENT, *BASE, *METRICS, VALUES.replace("{least}", "10"), SCORES, HISTORY, ROLLING, CANDIDATES, PRE, TIMING]
CHUNKS = "chunks as (select event_id % 4 as worker, day(ts) // 10 + 1 as part, ts from events)"

_BOARD = "select wallet, round(aggregate_score, 6) as aggregate_score, num_metrics_available, num_spikes_preceded, round(hit_rate, 6) as timing_hit_rate, round(total_pre_spike_usd, 4) as total_pre_spike_usd, round(excess_ratio, 6) as timing_excess_ratio, coalesce(is_flagged, false) as timing_flagged from scores left join timings using (wallet) where aggregate_score >= 0 and num_metrics_available >= 1"


def _first(metric: str, table: str, order: list[str], measure: str) -> str:
    by = ", ".join(f"{c} desc nulls last" for c in order)
    return f"select '{metric}' as metric, wallet, cast({measure} as double) as measure from {table} qualify row_number() over (order by {by}, wallet) <= 10"


def _previews() -> str:
    flag = {
        "contrarian": "contrarian_win_rate > 0.6 and contrarian_bet_count >= 5", "niches": "niche_win_rate > 0.7 and niche_bet_count >= 5", "factors": "profit_factor > 5 and total_volume >= 1000 and resolved_bet_count >= 5",
        "briers": "brier_skill_vs_consensus > 0.2 and resolved_bet_count >= 10", "concentrations": "max_concentration > 0.5 and total_positions >= 3 and largest_bet_won", "streaks": "longest_win_streak >= 8 and resolved_bet_count >= 5", "rois": "roi > 2 and total_capital_deployed >= 500 and resolved_bet_count >= 5",
    }
    extreme = "large_extreme_count >= 3 and large_extreme_win_rate > 0.6"
    return " union all ".join([
        _first("contrarian_win_rate", "contrarian", [flag["contrarian"], "round(contrarian_win_rate, 4)", "contrarian_bet_count"], "contrarian_bet_count"),
        _first("niche_market_accuracy", "niches", [flag["niches"], "round(niche_win_rate, 4)", "niche_bet_count"], "niche_bet_count"),
        _first("profit_factor", "factors", [flag["factors"], "round(profit_factor, 4)", "round(total_volume, 4)"], "round(total_volume, 4)"),
        _first("brier_score", "briers", [flag["briers"], "round(brier_skill_vs_consensus, 4)"], "round(brier_skill_vs_consensus, 4)"),
        _first("position_concentration", "concentrations", [f"{flag['concentrations']} and largest_bet_is_niche", flag["concentrations"], "round(max_concentration, 4)"], "round(max_concentration, 4)"),
        _first("win_streak", "streaks", [flag["streaks"], "longest_win_streak", "resolved_bet_count"], "resolved_bet_count"),
        _first("roi", "rois", [flag["rois"], "round(roi, 4)", "round(total_capital_deployed, 4)"], "round(total_capital_deployed, 4)"),
        _first("bet_size_vs_odds", "betsizes", [extreme, f"({extreme}) or (longshot_bet_count >= 3 and longshot_win_rate > 0.6) or coalesce(ratio > 2, false)", "round(large_extreme_usd, 4)"], "round(large_extreme_usd, 4)"),
    ])


def _total(part: str, table: str, value: str, places: int = 4) -> str:
    return f"select '{part}' as part, count(*) as n, cast(sum(cast(floor(floor({value} * 1e{places} + 0.5) / 1e{places} * 1000000 + 0.5) as bigint)) as double) / 1000000 as total from {table}"


def oracle_sql() -> dict[str, str]:
    own_slice = [EVENT, *BASE[:-1], SLICE, NICHE, FACTOR, BRIER, CONCENTRATION, STREAK, ROI, SIZES]
    scored = [re.sub(r"\b(sums|positions|resolved|niche|contrarian|niches|factors|sides|briers|tops|concentrations|runs|streaks|rois|odds|betsizes)\b", r"every_\1", p) for p in (POSITIONS, *METRICS)]
    measured = {"contrarian_win_rate": ("contrarian", "contrarian_win_rate"), "niche_market_accuracy": ("niches", "niche_win_rate"), "profit_factor": ("factors", "profit_factor"), "brier_score": ("briers", "brier_skill_vs_consensus"), "position_concentration": ("concentrations", "max_concentration"), "win_streak": ("streaks", "longest_win_streak"), "roi": ("rois", "roi"), "bet_size_vs_odds": ("betsizes", "longshot_win_rate")}
    tables = {"positions": ("positions", "total_usd_in"), "price_history": ("history", "avg_price"), "price_spikes": ("spikes", "magnitude_pp"), "pre_spike_trades": ("pre", "usd_amount")}
    spans = "spans as (select epoch_us(ts) // 1000000 as start, epoch_us(ts) // 1000000 + 240 as finish from events), reached as (select *, max(finish) over (order by start, finish rows between unbounded preceding and 1 preceding) as reach from spans)"
    return {
        "chunk_scan": _plain([EVENT, r"""
taken as (select ord, case when taker_direction = 'BUY' then cast(floor(usd_amount * 1000000 + 0.5) as bigint) else coalesce(cast(floor(token_amount * 1000000 + 0.5) as bigint), 0) end as amount from tape),
chunks as (select event_id % 4 as worker, day(ts) // 10 + 1 as part, strftime(date_trunc('month', ts), '%Y%m%d') as first_day, strftime(last_day(ts), '%Y%m%d') as last_day, epoch_us(ts) // 1000000 as second, amount from raw join taken on ord = event_id)"""],
            "select worker, part, first_day, last_day, count(*) as num_rows, min(second) as min_ts, max(second) as max_ts, cast(sum(amount) as bigint) as taken from chunks group by all"),
        "chunk_manifest": _plain([CHUNKS], "select worker, part, count(*) as num_rows, true as has_bytes, true as has_digest from chunks group by worker, part, date_trunc('month', ts)"),
        "markets_from_csv": _sql([EVENT], "select market_id, side, asset_id, round(volume, 4) as volume, closed_time as \"closedTime\" from markets, lateral (values ('token1', 'A' || market_id), ('token2', 'B' || market_id)) t(side, asset_id)"),
        "leaderboard_by_score": _sql(BOARD, f"{_BOARD} order by round(aggregate_score, 6) desc nulls last, wallet limit 500"),
        "leaderboard_by_usd": _sql(BOARD, f"{_BOARD} order by timings.total_pre_spike_usd desc nulls last, wallet limit 500"),
        "leaderboard_without_timing": _sql(BOARD[:-5], "select wallet, round(aggregate_score, 6) as aggregate_score, num_metrics_available, cast(null as bigint) as num_spikes_preceded, cast(null as double) as timing_hit_rate, cast(null as double) as total_pre_spike_usd, cast(null as double) as timing_excess_ratio, false as timing_flagged from scores where aggregate_score >= 0 and num_metrics_available >= 1 order by round(aggregate_score, 6) desc nulls last, wallet limit 500"),
        "top_flagged": _sql([EVENT, BASE[0], HISTORY, ROLLING, CANDIDATES, PRE, TIMING], "select wallet, num_spikes_preceded, num_markets, round(avg_lead_time_minutes, 6) as avg_lead_time_minutes, round(total_pre_spike_usd, 4) as total_pre_spike_usd, round(hit_rate, 6) as hit_rate, round(spike_rate, 6) as spike_rate, round(excess_ratio, 6) as excess_ratio, is_flagged from timings where is_flagged order by round(timings.excess_ratio, 6) desc, wallet limit 50"),
        "metric_previews": _plain([DAY, *BASE, *METRICS], _previews()),
        "wallet_slice_metrics": _sql([DAY, *BASE[:-1], SLICE, NICHE, CONTRARIAN, NICHES, FACTOR, BRIER, CONCENTRATION, STREAK, ROI, SIZES, LONG], "select wallet, metric, round(cast(value as double), 6) as value, bets from long"),
        "wallet_slice_known": _plain([*BOARD, "busiest as (select wallet from pre group by 1 order by count(*) desc, wallet limit 1)"], " union all ".join(_total(part, table, value, 6).replace(" as n,", " as n, max(wallet) as wallet,") + " where wallet = (select wallet from busiest)" for part, table, value in (("positions", "positions", "total_usd_in"), ("aggregate_scores", "scores", "aggregate_score"), ("timing_scores", "timings", "excess_ratio"), ("pre_spike_trades", "pre", "usd_amount")))),
        "wallet_figures": _figures(own_slice, scored),
        "market_slice_parts": _plain([*RESOLVED, *BASE, *METRICS, *REAL[2:], PRE], " union all ".join(_total(part, table, f"cast({value} as double)") for part, (table, value) in (tables | measured).items())),
        "fills_without_sums": _plain([EVENT, r"""
own as (select cast(ord as varchar) as id, 'x' || (ord // 6) as tx, 'T' || (ord % 2) as token, ord // 6 as six, cast(floor(usd_amount * 1000000 + 0.5) as bigint) as cash, coalesce(cast(floor(token_amount * 1000000 + 0.5) as bigint), 0) as tokens from tape),
every as (select id, tx, token, cash, tokens from own union all select 'sum ' || tx || ' ' || token, tx, token, sum(cash), sum(tokens) from own where six % 3 = 0 group by tx, token),
judged as (select *, count(*) over (partition by tx, token) >= 3 and 2 * cash = sum(cash) over (partition by tx, token) and 2 * tokens = sum(tokens) over (partition by tx, token) as sums from every),
kept as (select * from (select *, max(case when sums then id end) over (partition by tx, token) as last from judged) where not sums or id < last)"""],
            "select tx as \"transactionHash\", count(*) as n, count(*) filter (id like 'sum%') as sums_left, cast(sum(cash) as bigint) as cash from kept group by 1"),
        "whole_gaps": _plain([spans], "select gap_start, gap_end from (select reach as gap_start, start as gap_end from reached union all select min(start) - 600, min(start) from spans union all select max(finish), max(finish) + 600 from spans) where gap_end - gap_start > 60"),
        "whole_runs": _plain([spans], 'select min(start) as start, max(finish) as "end" from (select *, sum(case when reach is null or start - reach > 60 then 1 else 0 end) over (order by start, finish rows unbounded preceding) as island from reached) group by island'),
    }


def _figures(own: list[str], scored: list[str]) -> str:
    """The busiest wallet's metrics from its slice; its score from all wallets' metrics, under other names."""
    every = [*scored, re.sub(r"\b(contrarian|niches|factors|briers|concentrations|streaks|rois|betsizes)\b(?! as)", r"every_\1", VALUES.replace("{least}", "10")), SCORES]
    parts = [*own, *every, *[HISTORY, ROLLING, CANDIDATES, PRE, TIMING]]
    select = """select p.wallet, num_positions, num_won, round(aggregate_score, 6) as aggregate_score, suspicion_rank, num_spikes_preceded, round(hit_rate, 6) as hit_rate, round(excess_ratio, 6) as excess_ratio, is_flagged, round(roi, 6) as roi, round(r.net_profit, 4) as net_profit, round(profit_factor, 4) as profit_factor, round(gross_profit, 4) as gross_profit, round(gross_loss, 4) as gross_loss,
        round(avg_bet_size, 4) as avg_bet_size, longshot_bet_count, round(brier_score, 6) as brier_score, round(brier_skill_vs_consensus, 6) as brier_skill_vs_consensus, round(max_concentration, 6) as max_concentration, round(hhi, 6) as hhi, largest_bet_market, longest_win_streak, current_streak, num_pre_spike, num_correct
        from (select wallet, count(*) as num_positions, count(*) filter (position_won) as num_won from positions group by 1) p
        left join (select *, case when aggregate_score is not null then row_number() over (order by aggregate_score desc nulls last, wallet) end as suspicion_rank from scores) s on s.wallet = p.wallet left join timings t on t.wallet = p.wallet left join rois r on r.wallet = p.wallet left join factors f on f.wallet = p.wallet
        left join betsizes b on b.wallet = p.wallet left join briers i on i.wallet = p.wallet left join concentrations c on c.wallet = p.wallet left join streaks k on k.wallet = p.wallet left join (select wallet, count(*) as num_pre_spike, count(*) filter (correct_direction) as num_correct from pre group by 1) q on q.wallet = p.wallet"""
    return _sql(parts, select)
