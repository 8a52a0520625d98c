"""Streams against batches."""

import datetime as dt

from tests.test_micro import T0, TAPE
from tidewatch import streaming
from tidewatch.operators import timing
from tidewatch.sources import chunk_columns, exists, flatten_fills, flatten_markets, read_fills, schemas, write_chunks


def trades(spark, folder, rows):
    table = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), 1, "m", "w", "token1", "SELL", "BUY", p, 10.0, 20.0, str(i), i) for i, (m, p) in enumerate(rows)], TAPE)
    table.coalesce(1).write.mode("append").parquet(folder)
    return table


def test_price_history_of_closed_windows(spark, tmp_path):
    table = trades(spark, f"{tmp_path}/in", [(0, 0.2), (1, 0.4), (7, 0.5), (300, 0.6)])
    stream = streaming.price_history(streaming.landing(spark, f"{tmp_path}/in", TAPE))
    streaming.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    closed = timing.price_history(table).where("bucket_start < '2024-01-01 04:00:00'")
    key = lambda x: sorted(map(str, x.select("market_id", "bucket_start", "avg_price", "num_trades").collect()))
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(closed) and closed.count() == 2


def test_spikes_by_arrival(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(minutes=m), T0 + dt.timedelta(minutes=m + 5), p, 2, 1.0) for m, p in ((0, 0.2), (5, 0.3), (30, 0.55), (35, 0.9), (200, 0.1), (205, 0.8))]
    spark.createDataFrame(rows, schemas.PRICE_HISTORY).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streaming.price_spikes(streaming.landing(spark, f"{tmp_path}/in", schemas.PRICE_HISTORY))
    streaming.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    found = [(r.direction, round(r.magnitude_pp, 6)) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("spike_start_ts").collect()]
    assert found == [("up", 0.35), ("up", 0.7)]


def test_positions_are_upserted(spark, tmp_path):
    for part in ([(0, 0.2), (1, 0.4)], [(2, 0.5)]):
        trades(spark, f"{tmp_path}/in", part)
        streaming.run_upserts(streaming.running_positions(streaming.landing(spark, f"{tmp_path}/in", TAPE)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    rows = streaming.latest(spark, f"{tmp_path}/out", ["wallet", "market_id", "side"]).where("wallet = 'w'").collect()
    assert [(r.total_usd_in, r.num_trades) for r in rows] == [(30.0, 3)]


def test_sources(spark, tmp_path):
    fills = spark.createDataFrame([("1", 5, "m", "A", 10, "t", "0", 4, 'x,"y"')], schemas.FILLS)
    write_chunks(fills, f"{tmp_path}/fills")
    assert list(map(tuple, read_fills(spark, f"{tmp_path}/fills").collect())) == list(map(tuple, fills.collect()))
    assert exists(spark, f"{tmp_path}/fills/*.gz") and not exists(spark, f"{tmp_path}/none")
    names = spark.createDataFrame([("chunk_3_20240101_20240105_part2.csv.gz",), ("other.csv",)], "f string")
    assert [tuple(r) for r in names.select(*chunk_columns(names.f)).collect()] == [(3, dt.date(2024, 1, 1), dt.date(2024, 1, 5), 2), (None,) * 4]
    raw = spark.createDataFrame([('{"id":"1","title":"t","outcomes":"[\\"Y\\",\\"N\\"]","clobTokenIds":["a","b"],"negRiskOther":true,"volume":"3.5","events":[{"ticker":"k"}]}',), ("broken",), ('{"question":"no id"}',)], "json string")
    rows = flatten_markets(raw).collect()
    assert [(r.id, r.question, r.answer1, r.token2, r.neg_risk, r.volume, r.ticker) for r in rows] == [("1", "t", "Y", "b", "true", 3.5, "k")]
    assert flatten_fills(raw).first().maker == ""


def test_repeated_ids_come_once(spark, tmp_path):
    for part in ([(0, 0.2), (1, 0.4)], [(0, 0.2), (1, 0.4), (2, 0.5)]):
        trades(spark, f"{tmp_path}/in", part)
        streaming.run_available(streaming.unique(streaming.landing(spark, f"{tmp_path}/in", TAPE), "transactionHash"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted(r.transactionHash for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["0", "1", "2"]


def test_late_rows_name_their_days(spark, tmp_path):
    rows = trades(spark, f"{tmp_path}/in", [(0, 0.2), (1, 0.4), (60, 0.5), (3000, 0.5)])
    closed = spark.createDataFrame([(T0 + dt.timedelta(minutes=60),)], "closed_until timestamp")
    kept, days = streaming.split_late(rows, closed)
    assert sorted(r.price for r in kept.collect()) == [0.5, 0.5] and kept.columns == rows.columns
    assert [(r.market_id, r.day) for r in days.collect()] == [(1, T0.date())]


def test_look_back_join_meets_by_hours_and_each_pair_once(spark):
    starts = [dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 12, 45)]
    spikes = spark.createDataFrame([(1, i, at, "up") for i, at in enumerate(starts)], "market_id long, spike_id long, spike_start_ts timestamp, direction string")
    times = sorted({at - dt.timedelta(minutes=m, microseconds=u) for at in starts for m in (29, 30, 60, 105, 239, 240) for u in (-1, 0, 1)})
    once = spark.createDataFrame([("w", 1, "buy", at, 5.0, 0.5) for at in times], "wallet string, market_id long, direction string, timestamp timestamp, usd_amount double, price double")
    met = streaming.pre_spike_trades(once, spikes)
    expected = sorted((i, at) for i, start in enumerate(starts) for at in times if dt.timedelta(minutes=30) <= start - at <= dt.timedelta(hours=4))
    assert sorted((r.spike_id, r.entry_timestamp) for r in met.collect()) == expected
    join = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in join and join.count("hour#") >= 4
