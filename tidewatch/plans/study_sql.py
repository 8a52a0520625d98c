"""SQL of the studies' queries, on the parts of tidewatch.plans.sql."""

from __future__ import annotations

from tidewatch.plans.sql import BASE, DAY, EVENT, LAST, REAL, ROI, VIEWS, _plain, _sql

def _places(shared: int, share: float) -> str:
    return rf"""
places as (select distinct wallet, market_id, nonusdc_side as side, direction, us // 86400000000 as day from views where market_id is not null and wallet is not null and us is not null and nonusdc_side is not null),
sizes as (select wallet, count(*) as n from places group by 1),
pairs as (select a, b, shared, shared / (x.n + y.n - shared) as share from (select p.wallet as a, q.wallet as b, count(*) as shared from places p join places q using (market_id, side, direction, day) where p.wallet < q.wallet group by all) join sizes x on x.wallet = a join sizes y on y.wallet = b where shared >= {shared} and shared / (x.n + y.n - shared) >= {share})"""


GROUPS = r"""
edges as (select a as node, b as other, shared from pairs union all select b, a, shared from pairs),
reach as (select node, node as other from edges union select r.node, e.other from reach r join edges e on e.node = r.other),
labels as (select node, min(other) as group_id, count(*) as group_size from reach group by 1)"""

#: Trades of token1 with a price, and closes of resolved markets.
CLOSES = r"""
told as (select market_id, us, price, ord from tape where nonusdc_side = 'token1' and price is not null and market_id is not null and us is not null),
closes as (select market_id, max(us) as closed_us, max(case when resolution = 'token1' then 1 else 0 end) as won from tape join outcomes using (market_id) where resolution in ('token1', 'token2') group by 1)"""


def _points(*hours: int) -> str:
    wanted = ", ".join(f"({h})" for h in hours)
    return rf"""
points as (select c.market_id, h.hours, any_value(c.won) as won, arg_max(price, struct_pack(us := t.us, ord := t.ord, p := price)) as price
  from closes c cross join (values {wanted}) h(hours) join told t on t.market_id = c.market_id and t.us <= c.closed_us - h.hours * 3600000000 group by 1, 2)"""


DAYS = r"""
days as (select market_id, us // 86400000000 as day, arg_max(price, struct_pack(us := us, ord := ord, p := price)) filter (nonusdc_side = 'token1' and price is not null) as price, cast(sum(cast(floor(usd_amount * 100 + 0.5) as bigint)) as bigint) as cents from tape where market_id is not null group by 1, 2),
grid as (select market_id, day, last_value(d.price ignore nulls) over (partition by market_id order by day rows unbounded preceding) as price, coalesce(d.cents, 0) as cents, d.cents is not null as traded
  from (select market_id, unnest(range(first, last + 1)) as day from (select market_id, min(day) filter (price is not null) as first, (select max(day) from days) as last from days group by 1) where first is not null) left join days d using (market_id, day))"""

INDEX = r"""
members as (select distinct 'all' as index_name, market_id from markets union all select 'fifth ' || (market_id % 5), market_id from markets),
moved as (select *, lag(price) over (partition by market_id order by day) as earlier, sum(cents) over (partition by market_id order by day range between 7 preceding and 1 preceding) as weight from grid),
steps as (select index_name, day, sum(cast(floor(price * 1000000 + 0.5) as hugeint) * weight) filter (earlier is not null and weight > 0) as now, sum(cast(floor(earlier * 1000000 + 0.5) as hugeint) * weight) filter (earlier is not null and weight > 0) as before,
    sum(weight) filter (earlier is not null and weight > 0) as weights, count(*) filter (earlier is not null and weight > 0) as markets from moved join members using (market_id) group by 1, 2),
ratios as (select *, case when now > 0 and before > 0 then cast(now as double) / cast(before as double) else 1.0::double end as ratio from steps)"""

HOURS = r"""
hours as (select market_id, us // 3600000000 as hour, cast(sum(cast(floor(usd_amount * 100 + 0.5) as bigint)) as bigint) as cents from tape where market_id is not null group by 1, 2),
rolled as (select market_id, hour, cents, least(168, hour - min(hour) over (partition by market_id)) as n, coalesce(sum(cents) over w, 0) as s, coalesce(sum(cast(cents as hugeint) * cents) over w, 0) as q from hours window w as (partition by market_id order by hour range between 168 preceding and 1 preceding)),
scores as (select market_id, hour, cents, n as hours, case when n >= 2 and n * q - s * s > 0 then (n * cents - cast(s as double)) / sqrt(cast(n * q - s * s as double)) end as z from rolled)"""


def _momentum(new_days: int) -> str:
    return rf"""
ends as (select max(us) as now from tape),
sums as (select market_id, coalesce(sum(cast(floor(usd_amount * 100 + 0.5) as bigint)) filter (us > now - 86400000000), 0) / 100.0::double as volume_24h, coalesce(sum(cast(floor(usd_amount * 100 + 0.5) as bigint)) filter (us > now - 172800000000 and us <= now - 86400000000), 0) / 100.0::double as volume_before,
    (any_value(now) - min(us)) / 3600000000 as hours_open, any_value(now) - min(us) <= {new_days} * 86400000000 as is_new from tape cross join ends where market_id is not null group by 1),
known as (select market_id, arg_max(price, struct_pack(us := us, ord := ord, p := price)) as price, arg_max(price, struct_pack(us := us, ord := ord, p := price)) filter (us <= now - 86400000000) as earlier from tape cross join ends where nonusdc_side = 'token1' and price is not null and market_id is not null group by 1),
tops as (select market_id, max(z) as top_z from scores cross join ends where hour > now // 3600000000 - 24 group by 1),
board as (select market_id, price, price - earlier as change_24h, volume_24h, volume_before, hours_open, is_new, top_z from sums left join known using (market_id) left join tops using (market_id))"""


def _top(name: str, where: str, by: str, value: str) -> str:
    return f"select '{name}' as board, row_number() over (order by round({by}, 9) desc, market_id) as place, market_id, cast({value} as double) as value from board where {where} qualify place <= 10"


NEWS = r"""
span as (select min(epoch_us(ts)) // 1000000 as first, max(epoch_us(ts)) // 1000000 as last from events),
stories as (select doc_id as story_id, first + (doc_id * 7919) % (last - first + 1) as told_at, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]{3,}')) as words from documents cross join span),
told as (select story_id, told_at, unnest(words) as word from stories),
spread as (select word, count(*) as df from told group by 1),
known as (select market_id, word from (select item_id as market_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}'))) as word from benchmark) left join spread using (word) where coalesce(df, 0) <= (select count(*) from documents) * 0.2),
sizes as (select market_id, count(*) as n from known group by 1),
overlap as (select k.market_id, story_id, any_value(told_at) as told_at, count(*) as shared from known k join told using (word) group by 1, 2),
found as (select spike_id, s.market_id, story_id, magnitude_pp, spike_end_ts // 1000000 as at, (spike_end_ts // 1000000 - told_at) // 60 as lag_minutes, shared, shared / n as keyword_score
  from spikes s join sizes using (market_id) join overlap o on o.market_id = s.market_id and told_at between spike_end_ts // 1000000 - 21600 and spike_end_ts // 1000000 where shared > n * 0.2 + 1e-9),
volumes as (select spike_id, coalesce(sum(cents), 0) / 100.0::double as volume_24h from spikes s left join (select market_id as m, us // 3600000000 as hour, sum(cast(floor(usd_amount * 100 + 0.5) as bigint)) as cents from tape where market_id is not null group by 1, 2) h on m = market_id and hour between spike_end_ts // 3600000000 - 24 and spike_end_ts // 3600000000 - 1 group by 1),
points as (select story_id, market_id, cast(floor(round(magnitude_pp * volume_24h, 6) * 1000000 + 0.5) as bigint) as points from found join volumes using (spike_id)),
per_market as (select story_id, market_id, sum(points) as points, count(*) as moves from points group by 1, 2)"""


def oracle_sql() -> dict[str, str]:
    events = [EVENT, LAST, CLOSES, _points(1, 24, 168)]
    lines = [DAY, LAST, CLOSES, _points(24, 168, 720)]
    boards = " union all ".join([_top("movers", "change_24h is not null", "abs(change_24h)", "change_24h"), _top("volume", "volume_24h > 0", "volume_24h", "volume_24h"), _top("new", "is_new", "-hours_open", "hours_open"), _top("spikes", "top_z >= 1", "top_z", "top_z")])
    return {
        "coordinated_pairs": _sql([EVENT, VIEWS, _places(3, 0.01)], "select a, b, shared, round(share, 6) as share from pairs"),
        "coordinated_groups": _plain([EVENT, VIEWS, _places(4, 0.02), GROUPS], "select node as wallet, group_id, group_size, count(*) as partners, cast(sum(shared) as bigint) as shared from edges join labels using (node) group by 1, 2, 3"),
        "wallet_ages": _sql([EVENT, VIEWS, r"""
per as (select wallet, market_id, min(us) as entered, max(us) as gone, cast(sum(cast(floor(usd_amount * 1000000 + 0.5) as bigint)) filter (direction = 'BUY') as bigint) as usd, from views where wallet is not null and market_id is not null and us is not null group by 1, 2),
aged as (select *, min(entered) over (partition by wallet) as born from per),
active as (select wallet, count(distinct us // 86400000000) as active_days from views where market_id is not null group by 1)"""],
            "select wallet, born as first_trade, max(gone) as last_trade, active_days, count(*) as num_markets, count(*) filter (entered - born < 172800000000) as fresh_markets, round(coalesce(cast(sum(usd) filter (entered - born < 172800000000) as double) / 1000000, 0), 4) as fresh_usd, round(coalesce(cast(sum(usd) as double) / 1000000, 0), 4) as bought_usd, count(*) <= 60 and count(*) = count(*) filter (entered - born < 172800000000) as is_fresh from aged join active using (wallet) group by wallet, born, active_days"),
        "entry_ages": _sql([EVENT, VIEWS, r"""
per as (select wallet, market_id, min(us) as entered, sum(cast(floor(usd_amount * 1000000 + 0.5) as bigint)) as usd from views where wallet is not null and market_id is not null and us is not null group by 1, 2),
aged as (select *, (entered - min(entered) over (partition by wallet)) / 3600000000 as age from per)"""],
            "select market_id, case when age < 24 then 'under a day' when age < 168 then 'under a week' when age < 720 then 'under a month' else 'a month or more' end as age_class, count(*) as wallets, round(cast(sum(usd) as double) / 1000000, 4) as usd_amount from aged group by 1, 2"),
        "entity_leaderboard": _sql([DAY, *BASE, ROI, r"""
suspects as (select wallet, round(roi, 6) as score from rois where roi > 2 and total_capital_deployed >= 500 and resolved_bet_count >= 5),
own as (select p.wallet, market_id, total_usd_in, p_brand as entity, score from positions p join part on p_partkey = market_id left join suspects s on s.wallet = p.wallet),
people as (select entity, wallet, max(score) as score, sum(cast(floor(total_usd_in * 1000000 + 0.5) as bigint)) as usd from own group by 1, 2),
entities as (select entity, count(*) as num_wallets, count(score) as suspicious_wallets, avg(score) as mean_score, arg_max(wallet, struct_pack(s := coalesce(score, -1), u := usd, w := wallet)) as top_wallet, cast(coalesce(sum(usd) filter (score is not null), 0) as double) / 1000000 as suspicious_usd, cast(sum(usd) as double) / 1000000 as total_usd from people group by 1),
hit as (select entity, count(distinct market_id) as num_markets, count(distinct case when score is not null then market_id end) as suspicious_markets from own group by 1)"""],
            "select entity, suspicious_wallets, suspicious_markets, num_wallets, num_markets, round(suspicious_usd, 4) as suspicious_usd, round(total_usd, 4) as total_usd, round(suspicious_usd / nullif(total_usd, 0), 6) as suspicious_share, round(mean_score, 6) as mean_score, top_wallet from entities join hit using (entity) where suspicious_wallets > 0 order by suspicious_wallets desc, entities.suspicious_usd desc, entity limit 100"),
        "horizon_prices": _sql(events, "select market_id, cast(hours as bigint) as hours, cast(won as bigint) as won, round(price, 6) as price from points"),
        "calibration_curve": _sql([*lines, "binned as (select *, cast(least(floor(round(price * 10, 9)), 9) as bigint) as bin from points)"], "select cast(hours as bigint) as hours, bin, count(*) as markets, round(cast(sum(cast(floor(price * 1000000000 + 0.5) as bigint)) as double) / 1000000000 / count(*), 6) as mean_price, round(sum(won) / count(*), 6) as won_share, round(sum(won) / count(*) - cast(sum(cast(floor(price * 1000000000 + 0.5) as bigint)) as double) / 1000000000 / count(*), 6) as gap from binned group by 1, 2"),
        "brier_by_horizon": _sql([*lines, "scored as (select p_brand as category, hours, count(*) as markets, cast(sum(cast(floor((price - won) * (price - won) * 1000000000 + 0.5) as bigint)) as double) / 1000000000 / count(*) as brier, sum(won) / count(*) * (1 - sum(won) / count(*)) as base_brier from points left join part on p_partkey = market_id group by 1, 2)"],
            "select category, cast(hours as bigint) as hours, markets, round(brier, 6) as brier, round(base_brier, 6) as base_brier, round(1 - brier / nullif(base_brier, 0), 6) as skill from scored"),
        "biggest_upsets": _plain(lines, "select market_id, floor(price * 1e6 + 0.5) / 1e6 as price, cast(won as bigint) as won, floor(abs(price - won) * 1e6 + 0.5) / 1e6 as surprise from points where hours = 168 order by round(abs(price - won), 9) desc, market_id limit 20"),
        "time_to_accuracy": _sql([EVENT, LAST, CLOSES, r"""
judged as (select t.market_id, us, t.ord, (won = 1 and price > 0.5) or (won = 0 and price < 0.5) as fine from told t join closes using (market_id)),
placed as (select *, row_number() over (partition by market_id order by us, ord) as nth from judged),
begun as (select market_id, min(us) filter (nth > coalesce(wrong, 0)) as since from (select *, max(case when not fine then nth end) over (partition by market_id) as wrong from placed) group by 1)"""],
            "select market_id, cast(won as bigint) as won, round((closed_us - since) / 3600000000, 6) as hours_right from closes left join begun using (market_id)"),
        "day_grid": _sql([EVENT, DAYS], "select market_id, day, round(price, 6) as price, cents, traded from grid"),
        "composite_index": _sql([EVENT, DAYS, INDEX], "select index_name, day, round(100 * exp(sum(ln(ratio)) over (partition by index_name order by day rows unbounded preceding)), 6) as level, round(ratio - 1, 6) as change, markets, round(cast(now as double) / (cast(weights as double) * 1000000), 6) as mean_price from ratios"),
        "volume_scores": _sql([EVENT, HOURS], "select market_id, hour, cents, hours, round(z, 6) as z from scores"),
        "momentum": _sql([EVENT, HOURS, _momentum(7)], "select market_id, round(price, 6) as price, round(change_24h, 6) as change_24h, round(volume_24h, 4) as volume_24h, round(volume_before, 4) as volume_before, round(hours_open, 6) as hours_open, is_new, round(top_z, 6) as top_z from board"),
        "news_attributions": _sql([*REAL, NEWS], "select spike_id, market_id, story_id, lag_minutes, shared, round(keyword_score, 6) as keyword_score from found"),
        "impact_feed": _sql([*REAL, NEWS], "select story_id, round(cast(sum(points) as double) / 1000000, 6) as impact_score, cast(sum(moves) as bigint) as moves, count(*) as markets_moved, arg_max(market_id, struct_pack(p := points, m := market_id)) as top_market from per_market group by 1 having sum(points) > 0 order by sum(points) desc, story_id limit 50"),
        "merged_stories": r"""
            with s as (select page_id as story_id, (1704067200 + (page_id * 7919) % 1009 * 60) * 1000000 as published_at, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as headline, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) as source from pages),
            k as (select *, trim(regexp_replace(strip_accents(lower(headline)), '[^\p{L}\p{N}]+', ' ', 'g')) as headline_key, regexp_extract(source, '([^.]+\.[^.]+|[^.]+)$', 1) as domain from s)
            select headline_key, domain, arg_min(story_id, struct_pack(p := published_at, s := story_id)) as story_id, min(published_at) as published_at, arg_min(headline, struct_pack(p := published_at, s := story_id)) as headline, arg_min(url, struct_pack(p := published_at, s := story_id)) as url,
                   array_to_string(list_sort(list_distinct(list(nullif(source, '')))), ',') as sources, count(*) as copies from k group by 1, 2""",
        "momentum_board": _plain([EVENT, HOURS, _momentum(30)], f"select board, place, market_id, floor(value * 1e6 + 0.5) / 1e6 as value from ({boards})"),
    }
