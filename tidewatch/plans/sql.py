"""SQL of the registered queries, for DuckDB over the same tables.

Each statement is put together from named parts, one for each step of the analysis; a part may use
those that stand before it.
"""

from __future__ import annotations

import re

DAY = r"""
tape as (select epoch_us(l_shipdate) as us, l_partkey as market_id, 's' || l_suppkey as maker, 'c' || o_custkey as taker,
    case when l_linenumber % 2 = 0 then 'token1' else 'token2' end as nonusdc_side,
    case when l_returnflag = 'R' then 'BUY' else 'SELL' end as maker_direction, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as taker_direction,
    (2 * l_quantity - 1) / 100.0::double as price, l_extendedprice as usd_amount, l_extendedprice / ((2 * l_quantity - 1) / 100.0::double) as token_amount,
    cast(l_orderkey as varchar) as tx, l_orderkey * 8 + l_linenumber as ord
  from lineitem join orders on l_orderkey = o_orderkey),
markets as (select p_partkey as market_id, p_name as question, v.volume, case when p_partkey % 10 <> 0 then 'closed' end as closed_time
  from part left join (select l_partkey, sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint)) / 100.0::double as volume from lineitem group by 1) v on p_partkey = v.l_partkey)"""

EVENT = r"""
raw as (select *, cast(floor(value * 100 + 0.5) as bigint) as cents, try_cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as m, case when event_type in ('purchase', 'click') then 'BUY' else 'SELL' end as own from events),
tape as (select epoch_us(ts) as us, m as market_id, 'u' || ((user_id * 7 + event_id) % (select max(user_id) + 1 from events)) as maker, 'u' || user_id as taker,
    case when event_id % 2 = 0 then 'token1' else 'token2' end as nonusdc_side, case when own = 'BUY' then 'SELL' else 'BUY' end as maker_direction, own as taker_direction,
    (cents % 10000) / 10000.0::double as price, value as usd_amount, value / nullif((cents % 10000) / 10000.0::double, 0) as token_amount,
    cast(event_id // 2 as varchar) as tx, event_id as ord from raw),
markets as (select m as market_id, 'market ' || m as question, sum(cents) / 100.0::double as volume, case when m % 10 <> 0 then 'closed' end as closed_time from raw where m is not null group by m)"""

VIEWS = r"""
views as (select us, market_id, nonusdc_side, price, usd_amount, token_amount, tx, ord, 0 as role, maker as wallet, maker_direction as direction from tape
  union all select us, market_id, nonusdc_side, price, usd_amount, token_amount, tx, ord, 1, taker, taker_direction from tape)"""

ONCE = r"""
once as (select * from (select *, row_number() over (partition by tx, wallet, market_id, nonusdc_side, direction order by role, ord, usd_amount, price, token_amount) as nth from views) where nth = 1)"""

LAST = r"""
lasts as (select market_id, price as last_price from (select *, row_number() over (partition by market_id order by us desc, ord desc, usd_amount desc, price desc) as nth from tape where nonusdc_side = 'token1' and price is not null and market_id is not null) where nth = 1),
outcomes as (select m.market_id, volume as market_volume, closed_time, question as market_question,
    case when closed_time is null or last_price is null then 'unresolved' when last_price >= 0.85 then 'token1' when last_price <= 0.15 then 'token2' else 'ambiguous' end as resolution
  from markets m left join lasts using (market_id))"""

POSITIONS = r"""
sums as (select wallet, market_id, nonusdc_side as side,
    coalesce(cast(sum(cast(floor(case when direction = 'BUY' then usd_amount end * 1000000 + 0.5) as bigint)) as double) / 1000000, 0) as total_usd_in, coalesce(cast(sum(cast(floor(case when direction = 'BUY' then token_amount end * 1000000 + 0.5) as bigint)) as double) / 1000000, 0) as tokens_bought,
    coalesce(cast(sum(cast(floor(case when direction = 'SELL' then usd_amount end * 1000000 + 0.5) as bigint)) as double) / 1000000, 0) as total_usd_out, coalesce(cast(sum(cast(floor(case when direction = 'SELL' then token_amount end * 1000000 + 0.5) as bigint)) as double) / 1000000, 0) as tokens_sold,
    count(us) as num_trades, min(us) as first_us, max(us) as last_us from once group by all),
positions as (select s.*, greatest(tokens_bought - tokens_sold, 0) as net_tokens, case when tokens_bought > 0 then total_usd_in / tokens_bought end as avg_entry_price, market_volume, closed_time, market_question,
    coalesce(resolution, 'unresolved') as resolution, coalesce(resolution in ('token1', 'token2') and resolution = side, false) as position_won from sums s left join outcomes using (market_id)),
resolved as (select *, cast(position_won as bigint) as won, case when position_won then net_tokens else 0 end + total_usd_out - total_usd_in as pnl from positions where resolution in ('token1', 'token2'))"""

NICHE = r"""
niche as (select max(market_volume) as niche_volume from (select market_volume, row_number() over (order by market_volume) - 1 as place, count(*) over () as n from (select market_id, max(market_volume) as market_volume from resolved group by 1) where market_volume is not null) where place = cast(floor((n - 1) * 0.25 + 0.5) as bigint))"""

CONTRARIAN = r"""
contrarian as (select wallet, count(*) as contrarian_bet_count, sum(won) as contrarian_wins, sum(total_usd_in) as contrarian_usd_deployed, avg(avg_entry_price) as mean_contrarian_entry_price, sum(won) / count(*) as contrarian_win_rate from resolved where avg_entry_price < 0.2 group by 1)"""

NICHES = r"""
niches as (select wallet, count(*) filter (market_volume <= niche_volume) as niche_bet_count, sum(won) filter (market_volume <= niche_volume) as niche_wins, sum(total_usd_in) filter (market_volume <= niche_volume) as niche_usd_deployed, avg(avg_entry_price) filter (market_volume <= niche_volume) as mean_niche_entry_price, avg(market_volume) filter (market_volume <= niche_volume) as mean_market_volume, count(*) as total_bet_count, sum(won) / count(*) as overall_win_rate,
    sum(won) filter (market_volume <= niche_volume) / nullif(count(*) filter (market_volume <= niche_volume), 0) as niche_win_rate from resolved cross join niche group by 1 having count(*) filter (market_volume <= niche_volume) > 0)"""

FACTOR = r"""
factors as (select *, case when gross_loss > 0 then gross_profit / gross_loss when gross_profit > 0 then 999.0::double else 0.0::double end as profit_factor from (select wallet, count(*) as resolved_bet_count, sum(won) as wins, sum(total_usd_in) as total_volume, cast(sum(cast(floor(greatest(pnl, 0) * 1000000 + 0.5) as bigint)) as double) / 1000000 as gross_profit, cast(sum(cast(floor(greatest(-pnl, 0) * 1000000 + 0.5) as bigint)) as double) / 1000000 as gross_loss, sum(pnl) as net_pnl from resolved group by 1))"""

BRIER = r"""
sides as (select market_id, side, sum(avg_entry_price * total_usd_in) / nullif(sum(total_usd_in), 0) as consensus from resolved group by all),
briers as (select *, case when market_consensus_brier > 0 then 1 - brier_score / market_consensus_brier when brier_score is null then 0.0::double else 0.0::double end as brier_skill_vs_consensus from (
  select wallet, count(*) as resolved_bet_count, sum(total_usd_in) as total_volume, sum(won) as wins, avg(avg_entry_price) as mean_entry_price,
    coalesce(sum((avg_entry_price - won) ** 2 * total_usd_in), 0) / nullif(sum(total_usd_in), 0) as brier_score, coalesce(sum((consensus - won) ** 2 * total_usd_in), 0) / nullif(sum(total_usd_in), 0) as market_consensus_brier
  from resolved left join sides using (market_id, side) group by 1))"""

CONCENTRATION = r"""
tops as (select * from (select *, row_number() over (partition by wallet order by total_usd_in desc, market_id, side) as nth, count(*) over (partition by wallet) as n, sum(total_usd_in) over (partition by wallet) as total, sum(total_usd_in * total_usd_in) over (partition by wallet) as squares from resolved) where nth = 1),
concentrations as (select wallet, n as total_positions, total as wallet_total_capital, coalesce(total_usd_in / nullif(total, 0), 0) as max_concentration, coalesce(squares / nullif(total * total, 0), 0) as hhi, market_id as largest_bet_market, total_usd_in as largest_bet_usd, position_won as largest_bet_won, market_volume as largest_bet_market_volume, side as largest_bet_side, resolution as largest_bet_resolution, coalesce(market_volume <= niche_volume, false) as largest_bet_is_niche from tops cross join niche)"""

STREAK = r"""
runs as (select wallet, run, sum(won) as length, count(*) as bets, sum(total_usd_in) as usd from (select *, sum(1 - won) over (partition by wallet order by first_us, market_id, side rows unbounded preceding) as run from resolved) group by all),
streaks as (select *, total_wins / resolved_bet_count as win_rate from (select wallet, sum(usd) as total_volume, cast(sum(length) as bigint) as total_wins, cast(sum(bets) as bigint) as resolved_bet_count, cast(max(length) as bigint) as longest_win_streak, cast(arg_max(length, run) as bigint) as current_streak from runs group by 1))"""

ROI = r"""
rois as (select *, coalesce(net_profit / nullif(total_capital_deployed, 0), 0) as roi, (last_trade - first_trade) / 86400000000.0::double as trading_span_days from (select wallet, count(*) as resolved_bet_count, sum(won) as wins, sum(total_usd_in) as total_capital_deployed, sum(pnl + total_usd_in) as total_payout, cast(sum(cast(floor(pnl * 1000000 + 0.5) as bigint)) as double) / 1000000 as net_profit, min(first_us) as first_trade, max(last_us) as last_trade from resolved group by 1))"""

SIZES = r"""
odds as (select *, case when avg_entry_price < 0.1 then 'extreme_longshot' when avg_entry_price > 0.9 then 'extreme_favorite' when avg_entry_price < 0.3 then 'longshot' when avg_entry_price > 0.7 then 'favorite' else 'mid_range' end as category, avg_entry_price < 0.1 or avg_entry_price > 0.9 as extreme, total_usd_in >= 10000 as large, case when avg_entry_price > 0 then net_tokens * (1 - avg_entry_price) else 0 end as potential from resolved),
betsizes as (select *, case when mid > 0 then ext / mid end as ratio, coalesce(longshot_wins / nullif(longshot_bet_count, 0), 0) as longshot_win_rate, coalesce(favorite_wins / nullif(favorite_bet_count, 0), 0) as favorite_win_rate, coalesce(large_extreme_wins / nullif(large_extreme_count, 0), 0) as large_extreme_win_rate from (
  select wallet, count(*) as total_bet_count, sum(total_usd_in) as total_volume, avg(total_usd_in) as avg_bet_size, sum(won) as total_wins, avg(total_usd_in) filter (category = 'mid_range') as mid, avg(total_usd_in) filter (extreme) as ext,
    count(*) filter (avg_entry_price < 0.1) as longshot_bet_count, coalesce(sum(won) filter (avg_entry_price < 0.1), 0) as longshot_wins, sum(total_usd_in) filter (avg_entry_price < 0.1) as longshot_usd_deployed, max(total_usd_in) filter (avg_entry_price < 0.1) as longshot_max_bet_usd, avg(avg_entry_price) filter (avg_entry_price < 0.1) as longshot_mean_entry, avg(potential) filter (avg_entry_price < 0.1) as longshot_mean_potential_payout,
    count(*) filter (avg_entry_price > 0.9) as favorite_bet_count, coalesce(sum(won) filter (avg_entry_price > 0.9), 0) as favorite_wins, sum(total_usd_in) filter (avg_entry_price > 0.9) as favorite_usd_deployed, max(total_usd_in) filter (avg_entry_price > 0.9) as favorite_max_bet_usd, avg(avg_entry_price) filter (avg_entry_price > 0.9) as favorite_mean_entry, avg(potential) filter (avg_entry_price > 0.9) as favorite_mean_potential_payout,
    count(*) filter (extreme and large) as large_extreme_count, coalesce(sum(won) filter (extreme and large), 0) as large_extreme_wins, sum(total_usd_in) filter (extreme and large) as large_extreme_usd, max(total_usd_in) filter (extreme and large) as largest_extreme_bet_usd, avg(avg_entry_price) filter (extreme and large) as large_extreme_mean_entry
  from odds group by 1))"""

VALUES = r"""
long as (select wallet, 'contrarian_win_rate' as metric, contrarian_win_rate as value, contrarian_bet_count as bets from contrarian
  union all select wallet, 'niche_market_accuracy', niche_win_rate, niche_bet_count from niches union all select wallet, 'profit_factor', profit_factor, resolved_bet_count from factors
  union all select wallet, 'brier_score', brier_skill_vs_consensus, resolved_bet_count from briers union all select wallet, 'position_concentration', max_concentration, total_positions from concentrations
  union all select wallet, 'win_streak', longest_win_streak, resolved_bet_count from streaks union all select wallet, 'roi', roi, resolved_bet_count from rois union all select wallet, 'bet_size_vs_odds', longshot_win_rate, longshot_bet_count from betsizes),
admitted as (select wallet, metric, round(cast(value as double), 9) as value, bets from long where bets >= 5 and value is not null),
caps as (select metric, value as cap from (select *, row_number() over (partition by metric order by value) - 1 as place, count(*) over (partition by metric) as n from admitted where metric in ('profit_factor', 'roi')) where place = cast(floor((n - 1) * 0.99 + 0.5) as bigint) and value > 0),
vals as (select wallet, metric, least(value, coalesce(cap, value)) as value, bets from admitted left join caps using (metric)),
scored as (select *, case when n >= {least} then (low + (ties - 1) / 2.0::double) / n end as score from (select *, rank() over (partition by metric order by value) as low, count(*) over (partition by metric, value) as ties, count(*) over (partition by metric) as n from vals))"""

WEIGHTS = {"contrarian_win_rate": 0.15, "niche_market_accuracy": 0.10, "profit_factor": 0.15, "brier_score": 0.15, "position_concentration": 0.10, "win_streak": 0.10, "roi": 0.15, "bet_size_vs_odds": 0.10}
SCORES = (
    "\nscores as (select *, round(case when num_metrics_available >= 3 then weighted / total_weight_coverage end, 9) as aggregate_score from (select wallet, count(score) as num_metrics_available, "
    + ", ".join(f"max(score) filter (metric = '{m}') as score_{m}" for m in WEIGHTS)
    + ", coalesce(sum(w) filter (score is not null), 0) as total_weight_coverage, sum(score * w) as weighted from scored join (values "
    + ", ".join(f"('{m}', {w}::double)" for m, w in WEIGHTS.items())
    + ") x(metric, w) using (metric) group by wallet))"
)

HISTORY = r"""
history as (select market_id, us // 300000000 * 300000000 as bucket_start, us // 300000000 * 300000000 + 300000000 as bucket_end, cast(sum(cast(floor(price * 1000000000 + 0.5) as bigint)) as double) / 1000000000 / count(*) as avg_price, count(*) as num_trades, cast(sum(cast(floor(usd_amount * 1000000 + 0.5) as bigint)) as double) / 1000000 as total_volume from tape where price is not null and usd_amount > 0 and us is not null group by all)"""

ROLLING = r"""
rolling as (select h.market_id, h.bucket_start, max(o.avg_price) as roll_max, min(o.avg_price) as roll_min, sum(o.num_trades) as roll_trades, arg_min(o.bucket_start, struct_pack(p := -o.avg_price, b := o.bucket_start)) as ts_of_max, arg_min(o.bucket_start, struct_pack(p := o.avg_price, b := o.bucket_start)) as ts_of_min
  from history h join history o on h.market_id is not distinct from o.market_id and o.bucket_start > h.bucket_start - 1860000000 and o.bucket_start <= h.bucket_start group by all)"""

CANDIDATES = r"""
moves as (select market_id, least(ts_of_min, ts_of_max) as spike_start_ts, greatest(ts_of_min, ts_of_max) as spike_end_ts, case when ts_of_min < ts_of_max then roll_min else roll_max end as price_before, case when ts_of_min < ts_of_max then roll_max else roll_min end as price_after, roll_max - roll_min as magnitude_pp, case when ts_of_min < ts_of_max then 'up' else 'down' end as direction from rolling where round(roll_max - roll_min, 12) >= 0.3 and roll_trades >= 2),
candidates as (select * exclude (nth) from (select *, row_number() over (partition by market_id, spike_start_ts, spike_end_ts order by magnitude_pp desc, price_before, direction) as nth from moves) where nth = 1),
spikes as (select *, market_id * 10000000000 + spike_start_ts // 1000000 % 10000000 * 1000 + (spike_end_ts - spike_start_ts) // 60000000 as spike_id from candidates)"""

COOLED = r"""
ranked as (select *, row_number() over (partition by market_id order by magnitude_pp desc, spike_start_ts, spike_end_ts) as k from candidates),
walk as (select market_id, cast(0 as bigint) as k, cast([] as struct(s bigint, e bigint)[]) as kept from (select distinct market_id from ranked)
  union all select w.market_id, r.k, case when len(list_filter(w.kept, lambda x: r.spike_start_ts >= x.s and r.spike_start_ts < x.e + 3600000000)) = 0 then list_append(w.kept, struct_pack(s := r.spike_start_ts, e := r.spike_end_ts)) else w.kept end
  from walk w join ranked r on r.market_id is not distinct from w.market_id and r.k = w.k + 1),
cooled as (select market_id, unnest(kept, recursive := true) from (select market_id, arg_max(kept, k) as kept from walk group by 1)),
spikes as (select row_number() over (order by spike_start_ts, c.market_id, spike_end_ts) - 1 as spike_id, c.* from candidates c join cooled o on c.market_id is not distinct from o.market_id and spike_start_ts = s and spike_end_ts = e)"""

PRE = r"""
turns as (select * from (select *, row_number() over (partition by tx, wallet, market_id, direction order by role, ord, usd_amount, price, token_amount) as nth from views where usd_amount >= 1 and market_id in (select market_id from spikes)) where nth = 1),
pre as (select wallet, t.market_id, spike_id, us as entry_timestamp, cast((spike_start_ts - us) // 60000000 as double) as lead_time_minutes, cast(sum(cast(floor(usd_amount * 1000000 + 0.5) as bigint)) as double) / 1000000 as usd_amount, cast(sum(cast(floor(price * 1000000000 + 0.5) as bigint)) as double) / 1000000000 / count(price) as entry_price, s.direction, upper(t.direction) as side, (t.direction = 'BUY' and s.direction = 'up') or (t.direction = 'SELL' and s.direction = 'down') as correct_direction
  from turns t join spikes s on t.market_id = s.market_id and us between spike_start_ts - 14400000000 and spike_start_ts - 1800000000 group by all)"""

TIMING = r"""
hits as (select wallet, avg(cast(right_usd > wrong_usd as int)) as hit_rate from (select wallet, spike_id, coalesce(sum(usd_amount) filter (correct_direction), 0) as right_usd, coalesce(sum(usd_amount) filter (not correct_direction), 0) as wrong_usd from pre group by all) group by 1),
baseline as (select wallet, count(*) as total_trades_all, count(distinct coalesce(market_id, -1)) as total_markets_all from (select distinct wallet, market_id, tx from views) group by 1),
lives as (select coalesce(median(hours) filter (hours > 0), 720) as median_hours, count(*) as total_markets from (select (max(bucket_start) - min(bucket_start)) // 3600000000 as hours from history group by market_id)),
timings as (select *, num_markets >= 3 and num_spikes_preceded >= 3 and excess_ratio > 2 and hit_rate > 0.5 as is_flagged from (select *, case when expected_spikes > 0 then least(num_spikes_preceded / expected_spikes, 100) when num_spikes_preceded > 0 then 100 else 0 end as excess_ratio from (
  select p.wallet, num_spikes_preceded, num_markets, avg_lead_time_minutes, median_lead_time_minutes, total_pre_spike_usd, coalesce(hit_rate, 0) as hit_rate, coalesce(total_trades_all, 0) as total_trades_all, coalesce(total_markets_all, 0) as total_markets_all, coalesce(num_spikes_preceded / nullif(total_markets_all, 0), 0) as spike_rate,
    total_markets_all * ((select count(*) from spikes) / greatest(total_markets, 1)) * least(3.5 / median_hours, 1) as expected_spikes
  from (select wallet, count(distinct spike_id) as num_spikes_preceded, count(distinct market_id) as num_markets, avg(lead_time_minutes) as avg_lead_time_minutes, median(lead_time_minutes) as median_lead_time_minutes, sum(usd_amount) as total_pre_spike_usd from pre group by 1) p left join hits using (wallet) left join baseline using (wallet) cross join lives)))"""



def _exact(part: str) -> str:
    """Means and sums of amounts through whole millionths, as the operators have them."""
    whole = lambda x, only: f"cast(sum(cast(floor(({x}) * 1000000 + 0.5) as bigint)){only} as double) / 1000000"
    part = re.sub(r"avg\((total_usd_in|potential|market_volume)\)( filter \([^)]*\))?", lambda m: f"{whole(m[1], m[2] or '')} / nullif(count({m[1]}){m[2] or ''}, 0)", part)
    return re.sub(r"(?<![\w(])sum\((total_usd_in|pnl \+ total_usd_in|pnl)\)( filter \([^)]*\))?", lambda m: whole(m[1], m[2] or ""), part)


NICHES, FACTOR, ROI, SIZES, CONTRARIAN = map(_exact, (NICHES, FACTOR, ROI, SIZES, CONTRARIAN))
METRICS = [NICHE, CONTRARIAN, NICHES, FACTOR, BRIER, CONCENTRATION, STREAK, ROI, SIZES]
BASE = [VIEWS, ONCE, LAST, POSITIONS]
SCORE = [DAY, *BASE, *METRICS, VALUES.replace("{least}", "50"), SCORES]
SPIKES = [EVENT, VIEWS, HISTORY, ROLLING, CANDIDATES]
REAL = [EVENT, VIEWS, HISTORY, ROLLING, CANDIDATES.partition(",\nspikes as")[0], COOLED]
#: The tape and the market of the first market that has resolved.
WHOLE = re.sub(r"\b(tape|markets|lasts|outcomes)\b", r"whole_\1", EVENT + "," + LAST)
RESOLVED = [WHOLE, "chosen as (select min(market_id) as m from whole_outcomes where resolution in ('token1', 'token2')), tape as (select * from whole_tape where market_id = (select m from chosen)), markets as (select * from whole_markets where market_id = (select m from chosen))"]

SECONDS = "spans as (select user_id, epoch_us(ts) // 1000000 as start, epoch_us(ts) // 1000000 + 1800 as finish from events)"
RUNS = r"""
runs as (select user_id, min(start) as start, max(finish) as "end" from (select *, sum(case when reach is null or start - reach > 60 then 1 else 0 end) over (partition by user_id order by start, finish rows unbounded preceding) as island from (select *, max(finish) over (partition by user_id order by start, finish rows between unbounded preceding and 1 preceding) as reach from spans)) group by user_id, island)"""
STRETCH = "stretch as (select lo, hi, (hi - lo) / 600.0::double as step from (select min(epoch_us(ts)) // 86400000000 * 86400 as lo, (max(epoch_us(ts)) // 86400000000 + 1) * 86400 as hi from events))"
DENSITY = STRETCH + r""",
probes as (select cast(range as int) as probe, cast(floor(range * step + lo) as bigint) as ts from range(600) cross join stretch),
counts as (select cast(least(floor((epoch_us(ts) // 1000000 - lo) / step), 599) as int) as probe, count(*) as n from events cross join stretch group by 1),
rates as (select probe, ts, coalesce(n, 0) * (3600.0::double / step) as rate from probes left join counts using (probe) cross join stretch),
profile as (select probe, ts, rate, sum(coalesce((before + rate) / 2 * ((ts - ts0) / 3600.0::double), 0)) over (order by probe rows unbounded preceding) as cumulative from (select *, lag(rate) over (order by probe) as before, lag(ts) over (order by probe) as ts0 from rates))"""


def _sql(parts: list[str], select: str) -> str:
    return "with recursive " + ",".join(parts) + "\n" + _cut(select)


def _plain(parts: list[str], select: str) -> str:
    return "with recursive " + ",".join(parts) + "\n" + select


def _r(names: str, places: int) -> str:
    return ", ".join(f"round({n}, {places}) as {n}" for n in names.split())


def _cut(statement: str) -> str:
    """round(x, places) as floor(x * scale + 0.5) / scale: binary arithmetic that engines share, where their round() differs at ties."""
    return re.sub(r"round\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*), (4|6)\)", lambda m: f"(floor(({m[1]}) * 1e{m[2]} + 0.5) / 1e{m[2]})", statement)


def oracle_sql() -> dict[str, str]:
    day = [DAY, *BASE]
    return {
        "wallet_unpivot": _sql([EVENT, VIEWS], "select wallet, market_id, nonusdc_side, direction, cast(role as bigint) as role, round(usd_amount, 4) as usd_amount, ord, us as timestamp from views"),
        "negrisk_dedup": _sql([DAY, VIEWS, ONCE], 'select tx as "transactionHash", wallet, market_id, nonusdc_side, direction, cast(role as bigint) as role, ord, round(usd_amount, 4) as usd_amount from once'),
        "wallet_positions_table": _sql(day, f"select wallet, market_id, side, {_r('total_usd_in tokens_bought total_usd_out tokens_sold net_tokens market_volume', 4)}, num_trades, first_us as first_trade_timestamp, last_us as last_trade_timestamp, round(avg_entry_price, 6) as avg_entry_price, closed_time, market_question, resolution, position_won from positions"),
        "last_price": _sql([DAY, LAST], "select market_id, round(last_price, 6) as last_price from lasts"),
        "market_resolution": _sql([DAY, LAST], "select market_id, round(market_volume, 4) as market_volume, closed_time, market_question, resolution from outcomes"),
        "contrarian_win_rate": _sql([*day, CONTRARIAN], f"select wallet, contrarian_bet_count, cast(contrarian_wins as bigint) as contrarian_wins, round(contrarian_usd_deployed, 4) as contrarian_usd_deployed, {_r('mean_contrarian_entry_price contrarian_win_rate', 6)}, contrarian_win_rate > 0.6 and contrarian_bet_count >= 5 as flagged from contrarian"),
        "niche_accuracy": _sql([*day, NICHE, NICHES], f"select wallet, niche_bet_count, cast(niche_wins as bigint) as niche_wins, {_r('niche_usd_deployed mean_market_volume', 4)}, total_bet_count, {_r('mean_niche_entry_price overall_win_rate niche_win_rate', 6)}, round(niche_win_rate - overall_win_rate, 6) as niche_vs_overall_delta, niche_win_rate > 0.7 and niche_bet_count >= 5 as flagged from niches"),
        "profit_factor": _sql([*day, FACTOR], f"select wallet, resolved_bet_count, cast(wins as bigint) as wins, {_r('total_volume gross_profit gross_loss net_pnl profit_factor', 4)}, round(wins / resolved_bet_count, 6) as win_rate, profit_factor > 5 and total_volume >= 1000 and resolved_bet_count >= 5 as flagged from factors"),
        "brier_skill": _sql([*day, BRIER], f"select wallet, resolved_bet_count, round(total_volume, 4) as total_volume, cast(wins as bigint) as wins, {_r('mean_entry_price brier_score market_consensus_brier brier_skill_vs_consensus', 6)}, round(1 - brier_score / 0.25, 6) as brier_skill_vs_naive, round(wins / resolved_bet_count, 6) as win_rate, brier_skill_vs_consensus > 0.2 and resolved_bet_count >= 10 as flagged from briers"),
        "position_concentration": _sql([*day, NICHE, CONCENTRATION], f"select wallet, total_positions, {_r('wallet_total_capital largest_bet_usd largest_bet_market_volume', 4)}, {_r('max_concentration hhi', 6)}, largest_bet_market, largest_bet_won, largest_bet_side, largest_bet_resolution, largest_bet_is_niche, max_concentration > 0.5 and total_positions >= 3 and largest_bet_won as flagged, max_concentration > 0.5 and total_positions >= 3 and largest_bet_won and largest_bet_is_niche as flagged_niche from concentrations"),
        "win_streak": _sql([*day, STREAK], "select wallet, round(total_volume, 4) as total_volume, total_wins, resolved_bet_count, longest_win_streak, current_streak, round(win_rate, 6) as win_rate, round(case when win_rate > 0 and win_rate < 1 then longest_win_streak / nullif(ln(resolved_bet_count) / ln(1 / win_rate), 0) when win_rate = 1 then 1 else 0 end, 6) as streak_vs_expected_ratio, longest_win_streak >= 8 and resolved_bet_count >= 5 as flagged from streaks"),
        "roi": _sql([*day, ROI], _ROI_COLUMNS),
        "bet_size_vs_odds": _sql([*day, SIZES], f"select wallet, total_bet_count, cast(total_wins as bigint) as total_wins, {_r('total_volume avg_bet_size longshot_usd_deployed longshot_max_bet_usd longshot_mean_potential_payout favorite_usd_deployed favorite_max_bet_usd favorite_mean_potential_payout large_extreme_usd largest_extreme_bet_usd', 4)}, round(mid, 4) as avg_bet_size_mid_range, round(ext, 4) as avg_bet_size_extreme, longshot_bet_count, cast(longshot_wins as bigint) as longshot_wins, favorite_bet_count, cast(favorite_wins as bigint) as favorite_wins, large_extreme_count, cast(large_extreme_wins as bigint) as large_extreme_wins, {_r('longshot_mean_entry favorite_mean_entry large_extreme_mean_entry longshot_win_rate favorite_win_rate large_extreme_win_rate', 6)}, round(total_wins / total_bet_count, 6) as overall_win_rate, round(case when favorite_bet_count > 0 then 1 - favorite_win_rate else 0 end, 6) as favorite_loss_rate, round(ratio, 4) as extreme_to_midrange_size_ratio, large_extreme_count >= 3 and large_extreme_win_rate > 0.6 as flagged_large_extreme, longshot_bet_count >= 3 and longshot_win_rate > 0.6 as flagged_longshot_winner, coalesce(ratio > 2, false) as flagged_inverse_kelly, (large_extreme_count >= 3 and large_extreme_win_rate > 0.6) or (longshot_bet_count >= 3 and longshot_win_rate > 0.6) or coalesce(ratio > 2, false) as flagged from betsizes"),
        "roi_leaderboard": _sql([*day, ROI], f"select wallet, resolved_bet_count, wins, total_capital_deployed, net_profit, roi, annualized_roi, flagged from (select *, row_number() over (order by flagged desc, exact desc, total_capital_deployed desc, wallet) as nth from ({_ROI_COLUMNS.replace(' from rois', ', roi as exact from rois').replace('round(roi, 6) as roi', 'round(rois.roi, 6) as roi').replace('roi as exact', 'rois.roi as exact')})) where nth <= 20"),
        "metric_percentiles": _sql(SCORE[:-1], "select wallet, metric, round(value, 6) as value, bets, round(score, 6) as score from scored"),
        "inverted_percentiles": _sql(SCORE[:-1], "select wallet, metric, round(value, 6) as value, bets, round(case when metric in ('position_concentration', 'roi') then 1 - score else score end, 6) as score from scored"),
        "score_quantiles": _sql(SCORE, "select q, round(aggregate_score, 6) as value from (select aggregate_score, row_number() over (order by aggregate_score) - 1 as place, count(*) over () as n from scores where aggregate_score is not null) cross join (select unnest([0.5::double, 0.75, 0.9, 0.95, 0.99]) as q) where place = cast(floor((n - 1) * q + 0.5) as bigint)"),
        "stored_slice": _sql(day, "select wallet, market_id, side, round(total_usd_in, 4) as total_usd_in, round(total_usd_out, 4) as total_usd_out, num_trades, resolution, position_won from positions where wallet = (select wallet from positions group by 1 order by count(*) desc, wallet limit 1)"),
        "aggregate_score": _sql(SCORE, f"select wallet, num_metrics_available, {_r('total_weight_coverage aggregate_score ' + ' '.join(f'score_{m}' for m in WEIGHTS), 6)} from scores"),
        "suspicion_rank": _plain(SCORE, "select wallet, s as aggregate_score, case when s is not null then row_number() over (order by s desc nulls last, wallet) end as suspicion_rank from (select wallet, round(aggregate_score, 4) as s from scores)"),
        "overview_kpis": _sql(SCORE, "select count(*) as total_wallets, count(*) filter (aggregate_score >= 0.8) as high_risk, count(*) filter (aggregate_score >= 0.5 and aggregate_score < 0.8) as medium_risk, round(avg(aggregate_score), 6) as mean_score, round(median(aggregate_score), 6) as median_score, round(max(aggregate_score), 6) as max_score from scores"),
        "score_histogram": _plain(SCORE, "select floor(round(aggregate_score, 6) * 50) / 50 as bin, count(*) as n from scores group by 1"),
        "top_wallets": _plain(SCORE, "select wallet, round(aggregate_score, 6) as aggregate_score, num_metrics_available from scores where num_metrics_available >= 1 order by round(aggregate_score, 6) desc nulls last, wallet limit 100"),
        "wallet_search": _plain(SCORE, "select wallet, round(aggregate_score, 6) as aggregate_score, num_metrics_available from scores where wallet ilike '%c1%' order by round(aggregate_score, 6) desc nulls last, wallet limit 20"),
        "leaderboard": _sql([EVENT, *BASE, *METRICS, VALUES.replace("{least}", "10"), SCORES, HISTORY, ROLLING, CANDIDATES, PRE, TIMING], "select wallet, round(aggregate_score, 6) as aggregate_score, num_metrics_available, num_spikes_preceded, round(hit_rate, 6) as timing_hit_rate, round(total_pre_spike_usd, 4) as total_pre_spike_usd, round(excess_ratio, 6) as timing_excess_ratio, coalesce(is_flagged, false) as timing_flagged from scores left join timings using (wallet) where aggregate_score >= 0 and num_metrics_available >= 1 order by round(excess_ratio, 6) desc nulls last, wallet limit 500"),
        "wallet_report": _sql(day, f"select market_id, side, {_r('total_usd_in total_usd_out net_tokens', 4)}, num_trades, round(avg_entry_price, 6) as avg_entry_price, position_won, resolution from positions where wallet = (select wallet from positions group by 1 order by count(*) desc, wallet limit 1) order by positions.total_usd_in desc, market_id, side limit 200"),
        "market_slice_roi": _sql([*RESOLVED, *BASE, ROI], _ROI_COLUMNS),
        "market_slice_summary": _sql([*RESOLVED, *BASE, FACTOR, ROI, *REAL[2:], PRE], "select (select count(*) from pre) as pre_spike_trades, (select count(distinct wallet) from pre) as pre_spike_wallets, (select count(*) from pre where correct_direction) as correct, (select round(coalesce(sum(usd_amount), 0), 4) from pre) as pre_spike_usd, (select count(*) from positions) as positions, (select count(distinct wallet) from positions) as wallets, count(*) as roi_wallets, round(avg(roi), 6) as avg_roi, count(*) filter (roi > 2 and total_capital_deployed >= 500 and resolved_bet_count >= 5) as roi_flagged, (select count(*) from factors where profit_factor > 5 and total_volume >= 1000 and resolved_bet_count >= 5) as profit_factor_flagged from rois"),
        "wallet_slice_profit_factor": _sql([*day, FACTOR], f"select wallet, resolved_bet_count, cast(wins as bigint) as wins, {_r('total_volume gross_profit gross_loss net_pnl profit_factor', 4)}, round(wins / resolved_bet_count, 6) as win_rate, profit_factor > 5 and total_volume >= 1000 and resolved_bet_count >= 5 as flagged from factors where wallet = (select wallet from positions group by 1 order by count(*) desc, wallet limit 1)"),
        "price_spikes": _sql(REAL, f"select spike_id, market_id, spike_start_ts, spike_end_ts, {_r('price_before price_after magnitude_pp', 6)}, direction from spikes"),
        "pre_spike_trades": _sql([*REAL, PRE], "select wallet, market_id, spike_id, entry_timestamp, lead_time_minutes, round(usd_amount, 4) as usd_amount, round(entry_price, 6) as entry_price, direction, side, correct_direction from pre"),
        "timing_score": _sql([*REAL, PRE, TIMING], f"select wallet, num_spikes_preceded, num_markets, {_r('avg_lead_time_minutes median_lead_time_minutes hit_rate spike_rate expected_spikes excess_ratio', 6)}, round(total_pre_spike_usd, 4) as total_pre_spike_usd, total_trades_all, total_markets_all, is_flagged from timings"),
        "recent_pre_spike": _sql([*REAL, PRE], "select spike_id, entry_timestamp, pre.market_id, side, correct_direction, round(usd_amount, 4) as usd_amount, lead_time_minutes, round(magnitude_pp, 6) as magnitude_pp from pre join spikes using (spike_id) where wallet = (select wallet from pre group by 1 order by count(*) desc, wallet limit 1) order by entry_timestamp desc, spike_id, side limit 200"),
        "win_loss": _sql(day, "select position_won, count(*) as n from positions group by 1"),
        "market_search": _sql([EVENT], "select cast(market_id as varchar) as id, question, round(volume, 4) as volume from markets where question ilike '%market 1%' order by markets.volume desc nulls last, cast(market_id as varchar) limit 50"),
        "market_list": _sql([DAY], 'select cast(market_id as varchar) as id, question, round(volume, 4) as volume, closed_time as "closedTime" from markets'),
        "price_history": _sql([EVENT, HISTORY], "select market_id, bucket_start, bucket_end, round(avg_price, 6) as avg_price, num_trades, round(total_volume, 4) as total_volume from history"),
        "rolling_price_range": _sql([EVENT, HISTORY, ROLLING], "select market_id, bucket_start, round(roll_max, 6) as roll_max, round(roll_min, 6) as roll_min, cast(roll_trades as bigint) as roll_trades, ts_of_max, ts_of_min from rolling"),
        "spike_candidates": _sql(SPIKES, f"select market_id, spike_start_ts, spike_end_ts, {_r('price_before price_after magnitude_pp', 6)}, direction from candidates"),
        "pre_spike_from_candidates": _sql([*SPIKES, PRE], "select wallet, market_id, spike_id, entry_timestamp, lead_time_minutes, round(usd_amount, 4) as usd_amount, round(entry_price, 6) as entry_price, direction, side, correct_direction from pre"),
        "spike_hit_rate": _sql([*SPIKES, PRE, TIMING], "select wallet, round(hit_rate, 6) as hit_rate from hits"),
        "activity_baseline": _sql([DAY, VIEWS], "select wallet, count(*) as total_trades_all, count(distinct coalesce(market_id, -1)) as total_markets_all from (select distinct wallet, market_id, tx from views) group by 1"),
        "market_lifetime_median": _sql([EVENT, HISTORY], "select cast(coalesce(median(hours) filter (hours > 0), 720) as double) as median_hours, count(*) as total_markets from (select (max(bucket_start) - min(bucket_start)) // 3600000000 as hours from history group by market_id)"),
        "timing_score_from_candidates": _sql([*SPIKES, PRE, TIMING], f"select wallet, num_spikes_preceded, num_markets, {_r('avg_lead_time_minutes median_lead_time_minutes hit_rate spike_rate expected_spikes excess_ratio', 6)}, round(total_pre_spike_usd, 4) as total_pre_spike_usd, total_trades_all, total_markets_all, is_flagged from timings"),
        "timing_kpis": _sql([*SPIKES, PRE, TIMING], "select count(*) as total_wallets, count(*) filter (is_flagged) as flagged_wallets, round(sum(total_pre_spike_usd), 4) as total_pre_spike_usd, round(avg(hit_rate) filter (is_flagged), 6) as avg_hit_rate_flagged, (select count(*) from spikes) as total_spikes, (select count(distinct market_id) from spikes) as markets_with_spikes from timings"),
        "spike_magnitude_histogram": _sql(SPIKES, "select floor(round(magnitude_pp, 6) * 20) / 20 as bin, direction, count(*) as n from candidates group by 1, 2"),
        "fills_to_trades": _sql([EVENT], _FILLS),
        "activity_to_trades": _cut(_ACTIVITY),
        "fills_from_csv": _sql([EVENT], _FILLS),
        "activity_from_csv": _cut(_ACTIVITY),
        "source_dedup_by_id": "select cast(o_orderkey as varchar) as id, epoch_us(o_orderdate) // 1000000 as timestamp, 'c' || o_custkey as stakeholder, 'c' || (o_orderkey % 100) as condition, cast(cast(floor(o_totalprice * 1000000 + 0.5) as bigint) as varchar) as amount from orders where o_orderstatus = 'O'",
        "token_lookup_unpivot": _sql([EVENT], "select market_id, 'token1' as side, 'A' || market_id as asset_id from markets union all select market_id, 'token2', 'B' || market_id from markets"),
        "markets_dedup": "select cast(p_partkey as varchar) as id, case when p_partkey % 3 <> 0 then 'main ' else 'missing ' end || p_name as question, '2024-' || p_brand as \"createdAt\" from part where p_partkey % 3 <> 0 or p_partkey % 2 = 0",
        "json_props_flatten": "select cast(event_id as varchar) as id, case when event_id % 7 <> 0 then 'u' || user_id else '' end as maker, coalesce(json_extract_string(props, '$.k'), '') as \"makerAssetId\", cast(epoch_us(ts) // 1000000 as varchar) as timestamp, '' as taker from events",
        "market_json_flatten": "select cast(p_partkey as varchar) as id, case when p_partkey % 2 = 0 then p_name else p_brand end as question, case when p_partkey % 2 = 0 then 'Yes' else '' end as answer1, case when p_partkey % 2 = 0 then 'No' else '' end as answer2, 'A' || p_partkey as token1, 'B' || p_partkey as token2, case when p_partkey % 2 = 0 then 'true' else 'false' end as neg_risk, case when p_partkey % 2 = 0 then floor(p_retailprice * 1e4 + 0.5) / 1e4 end as volume, case when p_partkey % 2 <> 0 then p_type end as ticker from part",
        "coverage_stats": "select worker, cast(sum(n) as bigint) as num_rows, cast(sum(size) as bigint) as num_bytes, count(*) as num_parts, min(lo) as min_ts, max(hi) as max_ts from (select user_id % 10 as worker, epoch_us(ts) // 86400000000 as part, count(*) as n, max(strlen(props)) as size, min(epoch_us(ts) // 1000000) as lo, max(epoch_us(ts) // 1000000) as hi from events group by all) group by rollup (worker)",
        "coverage_gaps": _sql([SECONDS, RUNS], 'select user_id, gap_start, gap_end from (select user_id, max("end") over (partition by user_id order by start, "end" rows between unbounded preceding and 1 preceding) as gap_start, start as gap_end from (select * from runs union all select distinct user_id, x, x from spans cross join (select unnest([min(start), max(finish)]) as x from spans))) where gap_end - gap_start > 60'),
        "merged_intervals": _sql([SECONDS, RUNS], "select * from runs"),
        "density_profile": _sql([DENSITY], "select cast(probe as bigint) as probe, ts, round(rate, 6) as rate, round(cumulative, 6) as cumulative from profile"),
        "partition_plan": _sql([DENSITY, _CUTS], "select row_number() over (order by start_ts) - 1 as worker_id, start_ts, coalesce(lead(start_ts) over (order by start_ts), (select hi from stretch)) as end_ts from starts"),
        "partition_plan_check": _CHECK,
        "stream_price_history": _sql([EVENT, HISTORY], "select market_id, bucket_start, bucket_end, round(avg_price, 6) as avg_price, num_trades, round(total_volume, 4) as total_volume from history where bucket_end <= (select max(epoch_us(ts)) // 1000 * 1000 - 3600000000 from events)"),
        "first_trade_per_wallet": _sql([EVENT, VIEWS], "select wallet, market_id, us as timestamp, round(usd_amount, 4) as usd_amount from (select *, row_number() over (partition by wallet order by us, ord, role) as nth from views) where nth = 1"),
    }


_ROI_COLUMNS = "select wallet, resolved_bet_count, cast(wins as bigint) as wins, round(total_capital_deployed, 4) as total_capital_deployed, round(total_payout, 4) as total_payout, round(net_profit, 4) as net_profit, first_trade, last_trade, round(roi, 6) as roi, round(wins / resolved_bet_count, 6) as win_rate, round(trading_span_days, 6) as trading_span_days, round(case when trading_span_days > 30 and roi >= -1 then greatest(-1, least(100, (1 + roi) ** (365 / trading_span_days) - 1)) when trading_span_days > 30 then -1 end, 6) as annualized_roi, round(net_profit / resolved_bet_count, 4) as profit_per_bet, roi > 2 and total_capital_deployed >= 500 and resolved_bet_count >= 5 as flagged from rois"

_FILLS = """select us // 1000000 * 1000000 as timestamp, case when market_id < 95 then market_id end as market_id, maker, taker,
    case when market_id < 95 then nonusdc_side when taker_direction = 'BUY' then 'USDC' end as nonusdc_side,
    case when taker_direction = 'BUY' then 'SELL' else 'BUY' end as maker_direction, taker_direction,
    round(usd / nullif(tok, 0), 6) as price, round(usd / 1000000, 4) as usd_amount, round(case when taker_direction = 'SELL' and (market_id >= 95 or market_id is null) then usd else tok end / 1000000, 4) as token_amount, tx as "transactionHash"
from (select *, cast(floor(usd_amount * 1000000 + 0.5) as bigint) as usd, coalesce(cast(floor(token_amount * 1000000 + 0.5) as bigint), 0) as tok from tape)"""

_ACTIVITY = """with a as (select *, epoch_us(o_orderdate) as us, floor(o_totalprice * 1000000 + 0.5) / 1000000 as amount from orders),
s as (select unnest(['token1', 'token2']) as side)
select us as timestamp, o_orderkey % 100 as market_id, 'CONTRACT_SPLIT' as maker, 'c' || o_custkey as taker, side as nonusdc_side, 'SELL' as maker_direction, 'BUY' as taker_direction, 0.5::double as price, round(amount / 2, 4) as usd_amount, round(amount, 4) as token_amount, cast(o_orderkey as varchar) as "transactionHash" from a cross join s where o_orderstatus = 'O'
union all select us, o_orderkey % 100, 'CONTRACT_MERGE', 'c' || o_custkey, side, 'BUY', 'SELL', 0.5::double, round(amount / 2, 4), round(amount, 4), cast(o_orderkey as varchar) from a cross join s where o_orderstatus = 'F'
union all select us, o_orderkey % 100, 'CONTRACT_REDEEM', 'c' || o_custkey, case when o_orderkey % 3 = 1 then 'token2' else 'token1' end, 'BUY', 'SELL', 1::double, round(amount, 4), round(amount, 4), cast(o_orderkey as varchar) from a where o_orderstatus = 'P'"""

_CUTS = """
whole as (select cumulative + rate * (((select hi from stretch) - ts) / 3600.0::double) as total from profile order by probe desc limit 1),
steps as (select lag(ts) over (order by probe) as ts0, lag(cumulative) over (order by probe) as c0, ts as ts1, cumulative as c1 from profile),
cuts as (select distinct cast(floor(ts0 + (goal - c0) / (c1 - c0) * (ts1 - ts0)) as bigint) as cut from (select range as k, total / 16 * range as goal from whole cross join range(1, 16)) join steps on c1 >= goal and c0 < goal),
starts as (select lo as start_ts from stretch union all select cut from cuts)"""

_CHECK = f"""with {STRETCH}, plan as (select user_id % 20 as worker_id, min(epoch_us(ts) // 1000000) as start_ts, max(epoch_us(ts) // 1000000) as end_ts from events group by user_id % 20, epoch_us(ts) // 1000000 // 432000),
p as (select *, lag(end_ts) over o as before, lead(start_ts) over o as after, count(*) over (partition by worker_id) as same from plan window o as (order by start_ts, end_ts, worker_id))
select worker_id, 'starts elsewhere' as problem from p where before is null and start_ts <> (select lo from stretch)
union all select worker_id, 'ends elsewhere' from p where after is null and end_ts <> (select hi from stretch)
union all select worker_id, 'gap or overlap' from p where before <> start_ts
union all select worker_id, 'no length' from p where end_ts <= start_ts
union all select worker_id, 'repeated worker' from p where same > 1"""
