"""Stories, alerts, feeds and backfills: batch against plain counts, streams against batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.test_micro import T0, TAPE
from tests.test_studies import tape, trade
from tidewatch import streaming
from tidewatch.functions import islands
from tidewatch.operators import news, quality, timing
from tidewatch.streaming import alerts, backfill, stories

STORY = "story_id long, headline string, url string, published_at timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_attributions_against_all_pairs(spark):
    random.seed(2)
    vocabulary = [f"word{i}" for i in range(60)]
    market_texts = [(m, " ".join(random.sample(vocabulary[m * 4 : m * 4 + 14] + ["The", "THE", "ab"], 12))) for m in range(8)] + [(8, None), (9, "unheard")]
    told = [(i, at(random.randrange(600)), " ".join(["the", *random.sample(vocabulary, random.randrange(2, 25))])) for i in range(120)] + [(200, None, "word1 word2"), (201, at(5), None)]
    moves = [(s, random.randrange(9), at(random.randrange(600)), 0.4) for s in range(40)]
    found = news.attributions(spark.createDataFrame(moves, "spike_id long, market_id long, at timestamp, magnitude_pp double"), spark.createDataFrame(told, "story_id long, published_at timestamp, text string"), spark.createDataFrame(market_texts, "market_id long, text string"))
    words = {i: {w for w in (t or "").lower().split() if len(w) > 2} for i, _, t in told}
    often = {w for s in words.values() for w in s if sum(w in x for x in words.values()) > 0.2 * len(told)}
    of_market = {m: {w for w in (t or "").lower().split() if len(w) > 2} - often for m, t in market_texts}
    expected = {}
    for s, m, when, _ in moves:
        for i, published, _ in told:
            shared = len(of_market[m] & words[i])
            if published and dt.timedelta(0) <= when - published <= dt.timedelta(hours=1) and of_market[m] and shared > 0.2 * len(of_market[m]) + 1e-9:
                expected[s, i] = (m, (when - published).seconds // 60, shared, round(shared / len(of_market[m]), 9))
    assert {(r.spike_id, r.story_id): (r.market_id, r.lag_minutes, r.shared, round(r.keyword_score, 9)) for r in found.collect()} == expected and expected


def test_impact_of_moves(spark):
    moves = spark.createDataFrame([(1, 7, at(125), 0.5), (2, 7, at(1600), -0.25), (3, 8, at(60), 0.4)], "spike_id long, market_id long, at timestamp, magnitude_pp double")
    trades = tape(spark, [trade(7, 0, usd=100.0), trade(7, 119, usd=20.0), trade(7, 121, usd=999.0), trade(8, 61, usd=5.0)])
    volumes = {r.spike_id: r.volume_24h for r in news.move_volumes(moves, trades).collect()}
    assert volumes == {1: 120.0, 2: 999.0, 3: 0.0}
    found = spark.createDataFrame([(1, 7, 10, 5), (2, 7, 10, 6), (1, 7, 11, 7), (3, 8, 12, 1)], "spike_id long, market_id long, story_id long, lag_minutes long")
    points = news.contributions(found, moves, news.move_volumes(moves, trades))
    assert [tuple(r) for r in news.impact_feed(points).collect()] == [(10, 309.75, 2, 1, 7), (11, 60.0, 1, 1, 7)]
    assert sorted(map(tuple, news.price_lags(found).collect())) == [(7, 2, 6.0), (8, 1, 1.0)]


STORIES = [(1, "Été: ACT Now!", "https://www.a.example.com/x", at(3)), (2, "ete act   now", "http://b.example.com", at(1)), (3, "ete act now", "http://b.example.org", at(0)), (4, "", None, at(5)), (5, None, "not a url", at(4)), (6, "ETE act now", "http://B.example.com/2", at(1))]


def test_merged_stories(spark):
    found = {(r.headline_key, r.domain): (r.story_id, r.sources, r.copies) for r in news.merged_stories(spark.createDataFrame(STORIES, STORY)).collect()}
    assert found == {("ete act now", "example.com"): (2, ["b.example.com", "www.a.example.com"], 3), ("ete act now", "example.org"): (3, ["b.example.org"], 1), ("", ""): (5, [], 2)}


def test_stream_of_stories_revises_them(spark, tmp_path):
    random.seed(5)
    rows = STORIES + [(10 + i, f"story {i % 7}", f"http://h{random.randrange(4)}.example.net/{i}", at(10 + i)) for i in range(60)]
    folder = f"{tmp_path}/in"
    for k in range(0, len(rows), 22):
        spark.createDataFrame(rows[k : k + 22], STORY).coalesce(1).write.mode("append").parquet(folder)
        stream = stories.stream_stories(streaming.landing(spark, folder, STORY))
        streaming.run_upserts(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    last = streaming.latest(spark, f"{tmp_path}/out", stories.KEY)
    columns = [*stories.KEY, "story_id", "published_at", "headline", "url", "sources", "copies"]
    batch = news.merged_stories(spark.createDataFrame(rows, STORY))
    assert sorted(map(str, last.select(columns).collect())) == sorted(map(str, batch.select(columns).collect())) and last.agg(F.max("version")).first()[0] > 1


def walk(seed, markets=3, n=150):
    random.seed(seed)
    rows, prices = [], [0.5] * markets
    minute = 0.0
    for i in range(n):
        minute += random.choice([0.0, 0.2, 1.0, 5.0, 90.0]) if i % 20 == 0 else random.choice([0.0, 0.2, 1.0])
        m = random.randrange(markets)
        prices[m] = min(0.99, max(0.01, prices[m] + random.uniform(-0.02, 0.02)))
        rows.append((m, at(minute), round(prices[m], 4), i))
    return rows


POINT = "market_id long, at timestamp, price double, ord long"


def plain_alerts(rows, most=10, seconds=600):
    out, held = [], {}
    for m, when, price, _ in sorted(rows, key=lambda r: (r[1], r[3])):
        own = held.setdefault(m, [])
        own.append((when, price))
        own[:] = [p for p in own[-most:] if (when - p[0]).total_seconds() <= seconds]
        if round(abs(price - own[0][1]), 9) >= 0.03:
            out.append((m, when, price, own[0][1]))
    return sorted(out)


def test_alerts_in_batch_and_as_a_stream(spark, tmp_path):
    rows = walk(1)
    frame = spark.createDataFrame(random.sample(rows, len(rows)), POINT)
    batch = alerts.alerts(frame, 0.03, 10, 600, 1200)
    assert sorted((r.market_id, r.at, r.price, r.price_before) for r in batch.collect()) == plain_alerts(rows) != []
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k : k + 60], POINT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = alerts.stream_alerts(streaming.landing(spark, f"{tmp_path}/in", POINT), "1 hour", 0.03, 10, 600)
        streaming.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.market_id, r.at, r.price, r.price_before) for r in out.collect()) == plain_alerts(rows)


def test_impact_feed_with_withdrawals(spark, tmp_path):
    random.seed(8)
    feed, points = stories.ImpactFeed(spark, str(tmp_path), 4), {}
    for number in range(6):
        batch = [(random.randrange(12), random.randrange(5), None if random.random() < (0.2 if number < 4 else 0.7) else float(random.randrange(1, 9)), number) for _ in range(14)]
        batch = list({(s, k): (s, k, p, r) for s, k, p, r in batch}.values())
        frame = spark.createDataFrame(batch, feed.POINTS)
        feed.apply(frame, number)
        if number == 2:
            feed.apply(frame, number)
        points.update({(s, k): p for s, k, p, _ in batch})
        scores = {}
        for (s, _), p in points.items():
            scores[s] = scores.get(s, 0.0) + (p or 0.0)
        expected = sorted(((s, p) for s, p in scores.items() if p > 0), key=lambda x: (-x[1], x[0]))[:4]
        assert [tuple(r) for r in feed.feed().collect()] == expected
    feed.apply(spark.createDataFrame([(s, k, None, 99) for s, k in points], feed.POINTS), 6)
    assert feed.feed().count() == 0


def test_backfill_of_late_days(spark, tmp_path):
    path = f"{tmp_path}/history"
    rows = [trade(m, d * 1440 + i, 0.1 * (i % 7) + 0.05, ord=i) for m in (1, 2, None) for d in range(3) for i in range(0, 60, 4)]
    late = [r for i, r in enumerate(rows) if r[1] == 2 and r[0].day == 2 and i % 2] + [trade(5, 4 * 1440)]
    on_time = [r for r in rows if r not in late]
    backfill.write_history(timing.price_history(tape(spark, on_time)), path)
    untouched = {p.name for p in (tmp_path / "history" / "day=2024-01-01").iterdir()}
    whole = tape(spark, [*rows, *late[-1:]])
    _, days = streaming.split_late(tape(spark, late), spark.createDataFrame([(at(10**5),)], "closed_until timestamp"))
    for _ in range(2):
        backfill.backfill(spark, path, days, whole)
        found = backfill.read_history(spark, path).drop("day")
        assert sorted(map(str, found.collect())) == sorted(map(str, timing.price_history(whole).select(found.columns).collect()))
    assert {p.name for p in (tmp_path / "history" / "day=2024-01-01").iterdir()} == untouched
    backfill.backfill(spark, path, spark.createDataFrame([(5, dt.date(2024, 1, 5))], "market_id long, day date"), tape(spark, rows))
    assert backfill.read_history(spark, path).where("market_id = 5").count() == 0


def test_islands_without_keys_are_those_of_one_key(spark):
    random.seed(4)
    rows = [(s, s + random.randrange(0, 400)) for s in (random.randrange(200_000) for _ in range(900))] + [(50, 90_000), (50, 60)]
    frame = spark.createDataFrame(rows, "start long, end long")
    keyed = frame.withColumn("k", F.lit(1))
    merged = lambda f, keys: sorted((r.start, r.end) for r in quality.merged_intervals(f, 60, keys).collect())
    assert merged(frame, ()) == merged(keyed, ("k",)) and len(merged(frame, ())) > 20
    assert islands(frame, [], "start", "end", 60).count() == len(rows)
    ends = spark.createDataFrame([(-500, 300_000)], "expected_start long, expected_end long")
    gaps = lambda f, e, keys: sorted((r.gap_start, r.gap_end) for r in quality.gaps(f, e, 60, keys).collect())
    assert gaps(frame, ends, ()) == gaps(keyed, ends.withColumn("k", F.lit(1)), ("k",))
    none = spark.createDataFrame([], "start long, end long")
    assert quality.merged_intervals(none).count() == 0 and [tuple(r) for r in quality.gaps(none, ends).collect()] == [(-500, 300_000)]


def test_tape_columns_are_those_of_the_fixture():
    assert [c.split()[0] for c in TAPE.split(", ")][:2] == ["timestamp", "market_id"]
