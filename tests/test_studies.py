"""Coordination, calibration, indices and momentum on inputs small enough to count by hand or by force."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_micro import T0, TAPE, position, table
from tidewatch.functions import overlap
from tidewatch.functions.asof import as_of
from tidewatch.functions.graph import groups
from tidewatch.operators import calibration, coordination, indices


def trade(market, minutes, price=0.5, usd=10.0, side="token1", maker="m", taker="t", taker_direction="BUY", ord=0):
    return (T0 + dt.timedelta(minutes=minutes), market, maker, taker, side, "SELL" if taker_direction == "BUY" else "BUY", taker_direction, price, usd, usd, str(ord), ord)


def tape(spark, rows):
    return spark.createDataFrame(rows, TAPE)


@pytest.mark.parametrize("width", [1, 20])
def test_as_of_against_every_row(spark, width):
    random.seed(width)
    left = [(random.choice(["a", "b", None]), random.randrange(60), i) for i in range(80)] + [("c", 5, 98), ("a", None, 99)]
    right = [(random.choice(["a", "b", None]), random.randrange(60), random.random(), i) for i in range(40)] + [("b", None, 9.0, 99), ("a", 3, None, 77)]
    out = as_of(spark.createDataFrame(left, "k string, at long, id int"), spark.createDataFrame(right, "k string, at long, v double, n int"), ["k"], "at", ["v", "n"], ["n"], width)
    expected = []
    for k, at, i in left:
        known = [(r[1], r[3], r[2]) for r in right if k is not None and at is not None and r[0] == k and r[1] is not None and r[1] <= at]
        at_last = max(known, key=lambda x: x[:2]) if known else (None, None, None)
        expected.append((k, at, i, at_last[2], at_last[1]))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)


def test_groups_of_paths_hubs_and_pairs(spark):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(100)]
    hub = [("hub", f"z{i}") for i in range(50)]
    edges = [*path, *hub, ("x", "y"), ("y", "x"), ("same", "same")]
    found = {r.node: r.label for r in groups(spark.createDataFrame(random.Random(1).sample(edges, len(edges)), "a string, b string")).collect()}
    assert found == {f"p{i:03d}": "p000" for i in range(101)} | {f"z{i}": "hub" for i in range(50)} | {"hub": "hub", "x": "x", "y": "x"}
    assert groups(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("least_shared, least_share, crowd", [(1, 0.0, 3), (2, 0.3, 4), (3, 0.5, 256)])
def test_coordinated_pairs_against_all_pairs(spark, least_shared, least_share, crowd):
    random.seed(least_shared)
    own = {f"w{i}": set(random.sample(range(40), random.randrange(1, 9))) | ({100} if i % 2 else set()) for i in range(60)}
    for i in range(0, 40, 8):
        own[f"w{i + 1}"] = own[f"w{i + 2}"] = set(own[f"w{i}"]) | {100}
    places = spark.createDataFrame([(w, p) for w, s in own.items() for p in s], "wallet string, place int")
    expected = {(a, b): len(own[a] & own[b]) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) >= least_shared and len(own[a] & own[b]) >= least_share * len(own[a] | own[b])}
    pairs = coordination.coordinated_pairs(places, least_shared, least_share, crowd)
    assert {(r.a, r.b): r.shared for r in pairs.collect()} == expected and expected


@pytest.mark.parametrize("blocks", [1, 4])
def test_blocks_and_meetings_find_the_same_pairs(spark, blocks, monkeypatch):
    monkeypatch.setattr(overlap, "ROW", 3)
    monkeypatch.setattr(overlap, "STEP", 5)
    random.seed(blocks)
    own = {f"w{i}": set(random.sample(range(30), random.randrange(1, 12))) | ({100} if i % 2 else set()) for i in range(50)}
    places = spark.createDataFrame([(w, p) for w, s in own.items() for p in s], "wallet string, place int")
    rows = coordination._numbered(places, 2)
    expected = {(a, b): (len(own[a] & own[b]), len(own[a] & own[b]) / len(own[a] | own[b])) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) >= 2 and len(own[a] & own[b]) >= 0.2 * len(own[a] | own[b])}
    for pairs in (overlap.pairs_by_blocks(rows, blocks, 2, 0.2), coordination._along(coordination._leads(rows, 2, 0.2), rows, 2, 0.2, 4)):
        found = pairs.collect()
        assert {(r.a, r.b): (r.shared, r.share) for r in found} == expected and len(found) == len(expected) > 0


def test_wallets_that_all_meet_are_compared_by_blocks(spark):
    places = spark.range(400).selectExpr("concat('w', id) as wallet", "explode(sequence(0, 20)) as place")
    pairs = coordination.coordinated_pairs(places)
    assert "MapInArrow" in pairs._jdf.queryExecution().toString() and pairs.where("shared = 21 and share = 1 and a < b").count() == 400 * 399 // 2


def test_coordinated_groups_and_places(spark):
    rows = [trade(m, h * 60 + i, taker=w, maker=f"m{w}{h}", ord=h) for h, m in ((0, 1), (3, 2), (9, 1)) for i, w in enumerate("abc")] + [trade(1, 5, taker="d", maker="x"), trade(None, 5, taker="a", maker="y"), trade(1, 6, taker="CONTRACT_SPLIT", maker="z")]
    places = coordination.trade_places(tape(spark, rows))
    assert places.where("wallet = 'a'").count() == 3 and places.where("wallet like 'CONTRACT%'").count() == 0
    found = sorted(map(tuple, coordination.coordinated_groups(coordination.coordinated_pairs(places, 2, 0.5)).collect()))
    assert found == [(w, "a", 3, 2, 6) for w in "abc"]


def test_wallet_ages(spark):
    rows = [trade(1, 0, taker="old", maker="m"), trade(2, 3 * 1440, taker="old", maker="m"), trade(3, 4 * 1440, taker="old", maker="new", taker_direction="SELL", usd=7.0), trade(3, 4 * 1440 + 5, taker="old", maker="new", taker_direction="SELL", usd=2.0)]
    found = {r.wallet: (r.active_days, r.num_markets, r.fresh_markets, r.fresh_usd, r.bought_usd, r.is_fresh) for r in coordination.wallet_ages(tape(spark, rows)).collect()}
    assert found == {"old": (3, 3, 1, 10.0, 20.0, False), "new": (1, 1, 1, 9.0, 9.0, True), "m": (2, 2, 1, 0.0, 0.0, False)}
    ages = {(r.market_id, r.age_class): r.wallets for r in coordination.entry_ages(tape(spark, rows)).collect()}
    assert ages == {(1, "under a day"): 2, (2, "under a week"): 2, (3, "under a day"): 1, (3, "under a week"): 1}


def test_entity_leaderboard(spark):
    positions = table(spark, [position("a", 1, usd=10), position("a", 2, usd=20), position("b", 1, usd=30), position("c", 3, usd=5), position("c", 9, usd=5)])
    entities = spark.createDataFrame([(1, "X"), (2, "X"), (3, "Y"), (1, "Z"), (1, "Z")], "market_id long, entity string")
    suspects = spark.createDataFrame([("a", 0.9), ("b", 0.7)], "wallet string, score double")
    found = [tuple(r) for r in coordination.entity_leaderboard(positions, entities, suspects).collect()]
    assert found == [("X", 2, 2, 2, 2, 60.0, 60.0, 1.0, 0.8, "a"), ("Z", 2, 1, 2, 1, 40.0, 40.0, 1.0, 0.8, "a")]


def outcomes(spark, *rows):
    return spark.createDataFrame(rows, "market_id long, resolution string")


def test_horizons_calibration_and_upsets(spark):
    rows = [trade(1, 0, 0.4, ord=1), trade(1, 60, 0.3, ord=2), trade(1, 60, 0.2, ord=3), trade(1, 61, 0.9, side="token2", ord=4), trade(1, 120, 0.95, ord=5), trade(2, 100, 1.0, ord=6), trade(2, 160, 0.1, ord=7), trade(3, 0, 0.5, ord=8)]
    told = outcomes(spark, (1, "token1"), (2, "token2"), (3, "ambiguous"))
    points = calibration.horizon_prices(tape(spark, rows), told, (1, 2, 24), 600)
    assert sorted((r.market_id, r.hours, r.won, r.price) for r in points.collect()) == [(1, 1, 1, 0.2), (1, 2, 1, 0.4), (2, 1, 0, 1.0)]
    assert sorted((r.hours, r.bin, r.markets, r.won_share, round(r.gap, 9)) for r in calibration.calibration(points).collect()) == [(1, 2, 1, 1.0, 0.8), (1, 9, 1, 0.0, -1.0), (2, 4, 1, 1.0, 0.6)]
    assert [(r.market_id, r.surprise) for r in calibration.biggest_upsets(points, 1).collect()] == [(2, 1.0), (1, 0.8)]
    kinds = spark.createDataFrame([(1, "k"), (2, "k")], "market_id long, category string")
    assert [(r.category, r.markets, round(r.brier, 9), r.base_brier, round(r.skill, 9)) for r in calibration.brier_by_horizon(points.where("hours = 1"), kinds).collect()] == [("k", 2, 0.82, 0.25, -2.28)]
    right = {r.market_id: r.hours_right for r in calibration.time_to_accuracy(tape(spark, rows), told).collect()}
    assert right == {1: 0.0, 2: 0.0}


def test_day_grid_fills_days_and_the_index_is_chained(spark):
    day = 1440
    rows = [trade(1, 0, 0.4, 100.0), trade(1, 2 * day, 0.5, 50.0), trade(2, 0, 0.2, 300.0), trade(2, day, 0.3, 1.0, side="token2"), trade(2, day, 0.3, 0.0, ord=3), trade(3, 2 * day, 0.9, 5.0)]
    grid = {(r.market_id, r.day - 19723): (r.price, r.cents, r.traded) for r in indices.day_grid(tape(spark, rows)).collect()}
    assert grid == {(1, 0): (0.4, 10000, True), (1, 1): (0.4, 0, False), (1, 2): (0.5, 5000, True), (2, 0): (0.2, 30000, True), (2, 1): (0.3, 100, True), (2, 2): (0.3, 0, False), (3, 2): (0.9, 500, True)}
    members = spark.createDataFrame([("i", 1), ("i", 2), ("i", 3)], "index_name string, market_id long")
    found = {r.day - 19723: (round(r.level, 6), r.markets, r.mean_price) for r in indices.composite_index(tape(spark, rows), members).collect()}
    first = (0.4 * 100 + 0.3 * 300) / (0.4 * 100 + 0.2 * 300)
    second = (0.5 * 100 + 0.3 * 301) / (0.4 * 100 + 0.3 * 301)
    assert found[0] == (100.0, 0, None) and found[1] == (round(100 * first, 6), 2, 0.325) and found[2][:2] == (round(100 * first * second, 6), 2)


def test_volume_scores_count_empty_hours(spark):
    volumes = {0: 100, 1: 200, 3: 100, 10: 900}
    rows = [trade(1, h * 60, usd=float(v)) for h, v in volumes.items()]
    found = {r.hour - 473352: (r.hours, r.z) for r in indices.volume_scores(tape(spark, rows), 4).collect()}
    hours = [0.0, 0.0, 0.0, 0.0]
    assert found[0] == (0, None) and found[1] == (1, None) and found[10] == (4, None)  # the four hours before had none
    before = [100, 200, 0]
    mean = sum(before) / 3
    deviation = math.sqrt(sum((x - mean) ** 2 for x in before) / 3)
    assert found[3][0] == 3 and math.isclose(found[3][1], (100 - mean) / deviation) and hours == [0.0] * 4


def test_momentum_and_its_boards(spark):
    day = 1440
    rows = [trade(1, 0, 0.2, 5.0), trade(1, 9 * day, 0.5, 100.0), trade(1, 10 * day, 0.8, 50.0, ord=2), trade(2, 10 * day - 30, 0.9, 70.0), trade(3, day, 0.1, 1.0)]
    found = {r.market_id: (r.price, r.change_24h and round(r.change_24h, 6), r.volume_24h, r.volume_before, r.is_new) for r in indices.momentum(tape(spark, rows)).collect()}
    assert found == {1: (0.8, 0.3, 50.0, 100.0, False), 2: (0.9, None, 70.0, 0.0, True), 3: (0.1, 0.0, 0.0, 0.0, False)}
    board = [(r.board, r.place, r.market_id) for r in indices.momentum_board(indices.momentum(tape(spark, rows)), 5).orderBy("board", "place").collect()]
    assert board == [("movers", 1, 1), ("movers", 2, 3), ("new", 1, 2), ("spikes", 1, 1), ("volume", 1, 2), ("volume", 2, 1)] or board == [("movers", 1, 1), ("movers", 2, 3), ("new", 1, 2), ("volume", 1, 2), ("volume", 2, 1)]


def test_studies_of_nothing(spark):
    none, told = tape(spark, []), outcomes(spark)
    for rows in (coordination.wallet_ages(none), coordination.entry_ages(none), coordination.coordinated_groups(coordination.coordinated_pairs(coordination.trade_places(none))), calibration.horizon_prices(none, told), calibration.time_to_accuracy(none, told), indices.day_grid(none), indices.volume_scores(none), indices.momentum_board(indices.momentum(none))):
        assert rows.count() == 0
    assert indices.composite_index(none, spark.createDataFrame([("i", 1)], "index_name string, market_id long")).where(F.lit(True)).count() == 0
