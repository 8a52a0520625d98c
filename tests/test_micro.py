"""Small inputs with answers worked out by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import clipped, counted_below, divide, nearest_quantile
from tidewatch.operators import metrics, quality, score, tape, timing
from tidewatch.operators.positions import last_prices, resolutions, wallet_positions
from tidewatch.sources import schemas
from tidewatch.sources.scratch import stored

POSITION = "wallet string, market_id long, side string, total_usd_in double, tokens_bought double, total_usd_out double, tokens_sold double, num_trades long, first_trade_timestamp timestamp, last_trade_timestamp timestamp, net_tokens double, avg_entry_price double, market_volume double, closed_time string, market_question string, resolution string, position_won boolean"
T0 = dt.datetime(2024, 1, 1)


def position(wallet="w", market=1, side="token1", usd=1.0, out=0.0, net=0.0, price=0.5, volume=100.0, resolution="token1", won=True, first=0.0, last=0.0):
    return (wallet, market, side, float(usd), 0.0, float(out), 0.0, 1, T0 + dt.timedelta(days=first), T0 + dt.timedelta(days=last), float(net), price, volume, "x", "q", resolution, won)


def table(spark, rows):
    return spark.createDataFrame(rows, POSITION)


def fills(spark, maker_asset, maker_amount, taker_asset, taker_amount):
    lookup = spark.createDataFrame([(1, "token1", "A"), (1, "token2", "B")], "market_id long, side string, asset_id string")
    rows = spark.createDataFrame([("1", 0, "m", maker_asset, maker_amount, "t", taker_asset, taker_amount, "x")], schemas.FILLS)
    return tape.fills_to_trades(rows, lookup).first()


@pytest.mark.parametrize("fill, expected", [
    (("A", 2_000_000, "0", 1_000_000), (1, "token1", "BUY", "SELL", 1.0, 2.0, 0.5)),
    (("0", 300_000, "B", 1_000_000), (1, "token2", "SELL", "BUY", 0.3, 1.0, 0.3)),
    (("Z", 2_000_000, "0", 1_000_000), (None, "USDC", "BUY", "SELL", 1.0, 2.0, 0.5)),
    (("0", 300_000, "Z", 1_000_000), (None, None, "SELL", "BUY", 0.3, 0.3, 0.3)),
    (("0", 300_000, "A", 0), (1, "token1", "SELL", "BUY", 0.3, 0.0, None)),
])
def test_fills(spark, fill, expected):
    row = fills(spark, *fill)
    assert (row.market_id, row.nonusdc_side, row.taker_direction, row.maker_direction, row.usd_amount, row.token_amount, row.price) == expected


def test_activity(spark):
    markets = spark.createDataFrame([("7", "c7"), ("8", "")], "id string, condition_id string")
    splits = spark.createDataFrame([("s", 0, "w", "c7", "4000000"), ("s", 0, "w", "c7", "4000000"), ("u", 0, "w", "c9", "1")], schemas.SPLITS)
    merges = spark.createDataFrame([], schemas.SPLITS)
    redeemed = spark.createDataFrame([("r", 0, "w", "c7", '["2"]', "3000000"), ("q", 0, "w", "c7", '["1","2"]', "1000000")], schemas.REDEMPTIONS)
    rows = sorted((r.transactionHash, r.nonusdc_side, r.taker_direction, r.usd_amount, r.token_amount, r.price) for r in tape.activity_to_trades(splits, merges, redeemed, markets).collect())
    assert rows == [("q", "token1", "SELL", 1.0, 1.0, 1.0), ("r", "token2", "SELL", 3.0, 3.0, 1.0), ("s", "token1", "BUY", 2.0, 4.0, 0.5), ("s", "token2", "BUY", 2.0, 4.0, 0.5)]


TAPE = "timestamp timestamp, market_id long, maker string, taker string, nonusdc_side string, maker_direction string, taker_direction string, price double, usd_amount double, token_amount double, transactionHash string, ord long"


def test_one_action_in_two_fills_counts_once(spark):
    rows = [(T0, 1, "w", "a", "token1", "BUY", "SELL", 0.5, 5.0, 10.0, "x", 1), (T0, 1, "b", "w", "token1", "SELL", "BUY", 0.5, 7.0, 14.0, "x", 2)]
    trades = spark.createDataFrame(rows, TAPE)
    markets = spark.createDataFrame([("1", "q", 12.0, "closed")], "id string, question string, volume double, closedTime string")
    own = wallet_positions(trades, markets).where("wallet = 'w'").collect()
    assert [(r.total_usd_in, r.num_trades, r.resolution, r.position_won) for r in own] == [(5.0, 1, "ambiguous", False)]


def test_resolution(spark):
    trades = spark.createDataFrame([(T0, m, "a", "b", "token1", "BUY", "SELL", p, 1.0, 1.0, "x", 1) for m, p in ((1, 0.85), (2, 0.15), (3, 0.5), (4, 0.99))], TAPE)
    markets = spark.createDataFrame([(str(m), "q", 1.0, None if m == 4 else "c") for m in range(1, 6)], "id string, question string, volume double, closedTime string")
    assert {r.market_id: r.resolution for r in resolutions(markets, last_prices(trades)).collect()} == {1: "token1", 2: "token2", 3: "ambiguous", 4: "unresolved", 5: "unresolved"}


def test_profit_and_roi(spark):
    rows = table(spark, [position(market=1, usd=4, out=3, net=6), position(market=2, usd=2, net=5, won=False, resolution="token2")])
    assert metrics.profit_factor(rows).first().profit_factor == 2.5
    row = metrics.roi(rows).first()
    assert (row.roi, row.win_rate) == (0.5, 0.5)


def test_annual_roi(spark):
    row = metrics.roi(table(spark, [position(usd=100, net=121, first=0, last=73)])).first()
    assert round(row.annualized_roi, 6) == 1.593742
    assert metrics.roi(table(spark, [position(usd=100, net=121, first=0, last=30)])).first().annualized_roi is None


def test_brier(spark):
    rows = table(spark, [position("a", usd=100, price=0.2), position("b", usd=300, price=0.6)])
    assert {r.wallet: round(r.brier_skill_vs_consensus, 6) for r in metrics.brier_skill(rows).collect()} == {"a": -1.56, "b": 0.36}


def test_a_side_without_buys_poisons_nobody(spark):
    rows = table(spark, [position("a", market=1, usd=0, price=None), position("a", market=2, usd=100, price=0.2), position("b", market=2, usd=300, price=0.6)])
    assert {r.wallet: round(r.brier_skill_vs_consensus, 6) for r in metrics.brier_skill(rows).collect()} == {"a": -1.56, "b": 0.36}


def test_streak(spark):
    row = metrics.win_streak(table(spark, [position(market=i, won=w, first=i, usd=1) for i, w in enumerate([True, True, False, True, True, True])])).first()
    assert (row.longest_win_streak, row.current_streak, round(row.streak_vs_expected_ratio, 6)) == (3, 3, 0.305267)


def test_concentration(spark):
    row = metrics.position_concentration(table(spark, [position(market=i, usd=u) for i, u in enumerate((6.0, 3.0, 1.0))])).first()
    assert (round(row.max_concentration, 9), round(row.hhi, 9), row.largest_bet_market) == (0.6, 0.46, 0)


def test_empty_positions_keep_their_schema(spark):
    for function, _ in metrics.ALL.values():
        out = function(table(spark, []))
        assert "wallet" in out.columns and len(out.columns) > 5 and out.count() == 0


def test_ranks_and_quantiles(spark):
    values = spark.createDataFrame([("a", "m", 10.0, 9), ("b", "m", 20.0, 9), ("c", "m", 20.0, 9), ("d", "m", 40.0, 9)], "wallet string, metric string, value double, bets long")
    assert [r.score for r in score.percentiles(values, 1).orderBy("wallet").collect()] == [0.25, 0.625, 0.625, 1.0]
    assert score.percentiles(values, 5).first().score is None
    x = spark.createDataFrame([(float(i),) for i in range(10, 70, 10)], "v double")
    assert nearest_quantile(x, "v", 0.25, "q").first().q == 20.0
    assert nearest_quantile(x.where("v > 99"), "v", 0.25, "q").first().q is None


def test_many_values_are_ranked_in_parts(spark):
    x = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") % 700).cast("double").alias("v"))
    got = {r.v: (r.below, r.n) for r in counted_below(x, "g", "v", 16).collect()}
    from collections import Counter
    counts, below = Counter(float(i % 700) for i in range(5000)), 0
    for v in sorted(counts):
        assert got[v] == (below, counts[v])
        below += counts[v]


def test_aggregate(spark):
    rows = spark.createDataFrame([("w", "roi", 1.0, 9, 0.8), ("w", "profit_factor", 1.0, 9, 1.0), ("w", "win_streak", 1.0, 9, 0.5), ("v", "roi", 1.0, 9, 0.8), ("v", "win_streak", 1.0, 9, 0.5)], "wallet string, metric string, value double, bets long, score double")
    out = {r.wallet: r for r in score.ranked(score.aggregate(rows)).collect()}
    assert round(out["w"].aggregate_score, 9) == 0.8 and round(out["w"].total_weight_coverage, 9) == 0.4 and out["w"].suspicion_rank == 1
    assert out["v"].aggregate_score is None and out["v"].suspicion_rank is None


def history(spark, rows):
    return spark.createDataFrame([(1, T0 + dt.timedelta(minutes=m), T0 + dt.timedelta(minutes=m + 5), p, 2, 1.0) for m, p in rows], schemas.PRICE_HISTORY)


def test_candidates(spark):
    rows = timing.spike_candidates(history(spark, [(0, 0.20), (5, 0.30), (30, 0.55), (90, 0.50)])).collect()
    assert [(r.spike_start_ts, r.spike_end_ts, round(r.magnitude_pp, 9), r.direction) for r in rows] == [(T0, T0 + dt.timedelta(minutes=30), 0.35, "up")]


CANDIDATE = "market_id long, spike_start_ts timestamp, spike_end_ts timestamp, price_before double, price_after double, magnitude_pp double, direction string"


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], -r[5], r[1], r[2])):
        if not any(k[0] == r[0] and k[1] <= r[1] and (r[1] <= k[2] or r[1] - k[2] < dt.timedelta(hours=1)) for k in kept):
            kept.append(r)
    return kept


def test_cooldown_by_hand_and_against_a_greedy_loop(spark):
    import random

    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, at(0), at(30), 0.0, 0.5, 0.5, "up"), (1, at(20), at(40), 0.0, 0.4, 0.4, "up"), (1, at(89), at(99), 0.0, 0.38, 0.38, "up"), (1, at(90), at(100), 0.0, 0.35, 0.35, "up"), (1, at(-10), at(10), 0.0, 0.3, 0.3, "up")]
    kept = timing.cooled_down(spark.createDataFrame(rows, CANDIDATE)).collect()
    assert sorted(r.magnitude_pp for r in kept) == [0.3, 0.35, 0.5]
    random.seed(3)
    many = {(m, s): (m, at(s), at(s + random.randrange(1, 30)), 0.0, 1.0, random.randrange(300, 900) / 1000, "up") for m in range(4) for s in random.sample(range(3000), 60)}
    rows = list(many.values())
    assert sorted(map(tuple, timing.cooled_down(spark.createDataFrame(rows, CANDIDATE)).collect())) == sorted(greedy(rows))


def test_look_back_window(spark):
    noon = T0 + dt.timedelta(hours=12)
    spikes = spark.createDataFrame([(0, 1, noon, noon, 0.2, 0.6, 0.4, "up")], schemas.SPIKES)
    times = [(dt.timedelta(hours=7, minutes=59, seconds=59), 5.0), (dt.timedelta(hours=8), 5.0), (dt.timedelta(hours=10, seconds=30), 5.0), (dt.timedelta(hours=11, minutes=30), 5.0), (dt.timedelta(hours=11, minutes=30, seconds=1), 5.0), (dt.timedelta(hours=10), 0.99)]
    trades = spark.createDataFrame([(T0 + t, 1, "m", "w", "token1", "SELL", "BUY", 0.2, usd, 1.0, str(i), i) for i, (t, usd) in enumerate(times)], TAPE)
    rows = timing.pre_spike_trades(spikes, trades).where("wallet = 'w'").orderBy("entry_timestamp").collect()
    assert [(r.lead_time_minutes, r.correct_direction) for r in rows] == [(240.0, True), (119.0, True), (30.0, True)]


def test_gaps(spark):
    intervals = spark.createDataFrame([(0, 100), (150, 200), (261, 300)], "start long, end long")
    expected = spark.createDataFrame([(0, 400)], "expected_start long, expected_end long")
    found = quality.gaps(intervals, expected)
    assert sorted(map(tuple, found.collect())) == [(200, 261), (300, 400)]
    assert round(quality.covered_share(found, expected).first().covered_pct, 6) == 59.75
    none = quality.gaps(intervals.where("start < 0"), expected)
    assert [tuple(r) for r in none.collect()] == [(0, 400)]


def test_plan_check(spark):
    plan = spark.createDataFrame([(0, 0, 10), (1, 10, 20)], "worker_id long, start_ts long, end_ts long")
    assert quality.plan_violations(plan, 0, 20).count() == 0
    assert {r.problem for r in quality.plan_violations(plan, 5, 30).collect()} == {"starts elsewhere", "ends elsewhere"}
    assert quality.plan_violations(plan.where("worker_id > 9"), 0, 20).first().problem == "empty plan"


def test_division_and_bounds_keep_null(spark):
    row = spark.range(1).select(divide(F.lit(1), F.lit(0)).alias("a"), clipped(F.lit(None).cast("double"), 0, 1).alias("b"), clipped(F.lit(7.0), 0, 1).alias("c")).first()
    assert (row.a, row.b, row.c) == (None, None, 1.0)


def test_cooldown_in_rounds_is_the_fold(spark):
    random.seed(6)
    rows = []
    for market in (1, 2, None):
        for _ in range(120):
            start = random.randrange(0, 40 * 3600, 300)
            rows.append((market, T0 + dt.timedelta(seconds=start), T0 + dt.timedelta(seconds=start + random.randrange(0, 1800, 300)), 0.1, 0.5, round(random.choice([0.3, 0.4, random.random()]), 3), "up"))
    frame = spark.createDataFrame(rows, "market_id long, spike_start_ts timestamp, spike_end_ts timestamp, price_before double, price_after double, magnitude_pp double, direction string").dropDuplicates(["market_id", "spike_start_ts", "spike_end_ts"])
    frame = stored(frame, "candidates")
    folded, rounds = (sorted(map(str, timing.cooled_down(frame, 3600, fold).collect())) for fold in (10**6, 2))
    assert folded == rounds and 0 < len(folded) < frame.count()


def test_fills_that_sum_up_a_transaction_go(spark):
    fill = lambda i, tx, gives, tokens, cash: (i, 0, "m", "A" if gives else "0", tokens if gives else cash, "t", "0" if gives else "A", cash if gives else tokens, tx)
    rows = [fill("1", "x", True, 10, 4), fill("2", "x", False, 20, 9), fill("3", "x", True, 30, 13), fill("4", "y", True, 5, 5), fill("5", "y", True, 5, 5), fill("6", "z", True, 10, 4), fill("7", "z", True, 20, 9), fill("8", "z", True, 30, 14), fill("9", None, True, 1, 1), fill("a", None, True, 1, 1), fill("b", None, True, 2, 2)]
    left = lambda tolerance: sorted(r.id for r in tape.without_aggregate_fills(spark.createDataFrame(rows, schemas.FILLS), tolerance).collect())
    assert left(0) == ["1", "2", "4", "5", "6", "7", "8", "9", "a", "b"] and left(1) == ["1", "2", "4", "5", "6", "7", "9", "a", "b"]
