"""SQL of the streams' queries: what their batch twins give."""

from __future__ import annotations

from tidewatch.plans import sql, study_sql
from tidewatch.plans.sql import EVENT, HISTORY, ROLLING, VIEWS, _cut, _sql

ARRIVAL = r"""
wide as (select *, row_number() over (partition by market_id order by bucket_start) as k, least(ts_of_min, ts_of_max) as s, greatest(ts_of_min, ts_of_max) as e from rolling where round(roll_max - roll_min, 12) >= 0.3 and roll_trades >= 2),
walk as (select market_id, cast(0 as bigint) as k, cast(null as bigint) as last, false as kept from (select distinct market_id from wide)
  union all select w.market_id, r.k, case when w.last is null or r.s >= w.last + 3600000000 then r.e else w.last end, w.last is null or r.s >= w.last + 3600000000 from walk w join wide r on r.market_id is not distinct from w.market_id and r.k = w.k + 1)"""

ALERTS = r"""
told as (select market_id, us, price, ord from tape where nonusdc_side = 'token1' and price is not null and market_id is not null and us is not null),
held as (select *, first_value(struct_pack(us := us, ord := ord, price := price)) over (partition by market_id order by us, ord rows between 19 preceding and current row) as by_number from told),
aged as (select h.*, (select min(struct_pack(us := t.us, ord := t.ord, price := t.price)) from told t where t.market_id = h.market_id and t.us between h.us - 21600000000 and h.us) as by_age from held h),
olds as (select *, case when by_number > by_age then by_number else by_age end as old from aged)"""


def oracle_sql() -> dict[str, str]:
    alerts = _sql([EVENT, ALERTS], "select market_id, us as at, round(price, 6) as price, old.us as since, round(old.price, 6) as price_before, round(price - old.price, 6) as delta from olds where round(abs(price - old.price), 9) >= 0.25")
    money = lambda side, col: f"coalesce(cast(sum(cast(floor(case when direction = '{side}' then {col} end * 1000000 + 0.5) as bigint)) as double) / 1000000, 0)"
    return {
        "stream_unique": "select cast(o_orderkey as varchar) as id, epoch_us(o_orderdate) // 1000000 * 1000000 as timestamp, 'c' || o_custkey as stakeholder, 'c' || (o_orderkey % 100) as condition, cast(cast(floor(o_totalprice * 1000000 + 0.5) as bigint) as varchar) as amount from orders where o_orderstatus = 'O'",
        "stream_positions": _sql([EVENT, VIEWS], f"select wallet, market_id, nonusdc_side as side, round({money('BUY', 'usd_amount')}, 4) as total_usd_in, round({money('BUY', 'token_amount')}, 4) as tokens_bought, round({money('SELL', 'usd_amount')}, 4) as total_usd_out, round({money('SELL', 'token_amount')}, 4) as tokens_sold, count(*) as num_trades from views group by all"),
        "stream_spikes": _sql([EVENT, HISTORY, ROLLING, ARRIVAL], "select r.market_id, s as spike_start_ts, e as spike_end_ts, round(case when ts_of_min < ts_of_max then roll_min else roll_max end, 6) as price_before, round(case when ts_of_min < ts_of_max then roll_max else roll_min end, 6) as price_after, round(roll_max - roll_min, 6) as magnitude_pp, case when ts_of_min < ts_of_max then 'up' else 'down' end as direction from wide r join walk w on w.market_id is not distinct from r.market_id and w.k = r.k where w.kept"),
        "stream_pre_spike": sql.oracle_sql()["pre_spike_from_candidates"].replace("partition by tx, wallet, market_id, direction order", "partition by tx, wallet, market_id, direction, us order"),
        "movement_alerts": alerts,
        "stream_alerts": alerts,
        "stream_stories": study_sql.oracle_sql()["merged_stories"],
        "feed_with_withdrawals": _cut("select story_id, round(cast(sum(points) as double) / 1000000, 6) as impact_score from (select user_id as story_id, try_cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as spike_id, case when max(event_id) % 5 <> 0 then cast(floor(floor(arg_max(value, event_id) * 1e6 + 0.5) / 1e6 * 1000000 + 0.5) as bigint) end as points from events group by 1, 2) group by 1 having sum(points) > 0 order by sum(points) desc, story_id limit 50"),
        "late_backfill": _sql([EVENT, HISTORY], "select market_id, bucket_start, bucket_end, round(avg_price, 6) as avg_price, num_trades, round(total_volume, 4) as total_volume from history"),
    }
