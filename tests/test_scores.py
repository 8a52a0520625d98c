"""The walk over positions that all metrics share, against each metric's own table; slices and reports of few wallets."""

import random
import re

from pyspark.sql import functions as F

from tests.test_micro import T0, position, table
from tests.test_studies import tape, trade
from tidewatch.functions import thinned
from tidewatch.operators import metrics, reports, score, timing
from tidewatch.operators.positions import wallet_positions
from tidewatch.plans import queries, studies
from tidewatch.sources import land_chunks, read_chunks, read_optional, schemas


def positions(spark, seed=3, n=400):
    random.seed(seed)
    rows = []
    for i in range(n):
        price = random.choice([None, 0.05, 0.15, 0.5, 0.92, round(random.random(), 3)])
        won = random.random() < 0.5
        rows.append(position(f"w{random.randrange(12)}", random.randrange(30), random.choice(["token1", "token2"]), random.choice([0.0, 10.0, 12_000.5, random.random() * 100]), random.random() * 50, random.random() * 90, price, random.choice([None, 5.0, 50.0, 500.0]), random.choice(["token1", "token2", "token1", "ambiguous", "unresolved"]), won, first=random.random() * 9, last=10 + i))
    return table(spark, rows)


def test_fused_values_are_those_of_the_tables(spark):
    rows = positions(spark)
    of = lambda frame: {(r.wallet, r.metric): (r.value and round(r.value, 9), r.bets) for r in frame.where("bets > 0").collect()}
    assert of(score.fused_values(rows)) == of(score._long(score.all_metrics(rows))) != {}
    assert score.fused_values(table(spark, [])).count() == 0


def test_metric_values_of_either_form(spark):
    rows = positions(spark, 4)
    of = lambda values: sorted(map(str, score.metric_values(values, 2).select("wallet", "metric", "value", "bets").collect()))
    assert of(score.fused_values(rows)) == of(score.all_metrics(rows))


def test_overview_of_scores(spark):
    scores = spark.createDataFrame([(f"w{i}", s) for i, s in enumerate([0.9, 0.5, 0.7, 0.1, None])], "wallet string, aggregate_score double")
    row = reports.overview(scores).first()
    assert (row.total_wallets, row.high_risk, row.medium_risk, row.max_score) == (5, 1, 2, 0.9) and abs(row.median_score - 0.6) < 1e-9


def test_wallet_figures_of_a_wallet_with_and_without_timing(spark):
    rows = positions(spark)
    scores = spark.createDataFrame([("w1", 0.7, 3)], "wallet string, aggregate_score double, suspicion_rank long")
    timings = schemas.empty(spark, schemas.TIMING)
    pre = timing.pre_spike_trades(schemas.empty(spark, schemas.SPIKES), tape(spark, [trade(1, 0)]))
    row = reports.wallet_figures("w1", rows, scores, timings, pre).first()
    own = metrics.roi(rows.where("wallet = 'w1'")).first()
    assert (row.wallet, row.aggregate_score, row.roi, row.num_pre_spike, row.excess_ratio) == ("w1", 0.7, own.roi, None, None) and row.num_positions == rows.where("wallet = 'w1'").count()
    assert reports.wallet_figures("nobody", rows, scores, timings, pre).first().num_positions == 0


def test_chunks_are_named_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), i, f"m{i}", "a", i, "t", "0", i, "x,\"y\"") for i in range(40)], schemas.FILLS)
    named = rows.withColumns({"worker": (F.col("timestamp") % 3).cast("int"), "part": (F.col("timestamp") / 20).cast("int"), "first_day": F.lit("2024-01-05").cast("date"), "last_day": F.lit("2024-02-01").cast("date")})
    land_chunks(named, f"{tmp_path}/chunks", "timestamp", "id")
    names = sorted(p.name for p in (tmp_path / "chunks").glob("chunk_*"))
    assert names == [f"chunk_{w}_20240105_20240201_part{p}.csv.gz" for w in range(3) for p in range(2)]
    read = read_chunks(spark, schemas.FILLS, f"{tmp_path}/chunks")
    assert sorted((r.worker, r.part, str(r.last_day), r.id, r.transactionHash) for r in read.collect()) == sorted((i % 3, i // 20, "2024-02-01", str(i), 'x,"y"') for i in range(40))


def test_an_optional_table_is_typed_when_it_is_missing(spark, tmp_path):
    none = read_optional(spark, f"{tmp_path}/none", schemas.TIMING)
    assert none.count() == 0 and none.columns == [c.split()[0] for c in schemas.TIMING.split(", ")]
    spark.createDataFrame([("w", 1)], "wallet string, num_spikes_preceded long").write.parquet(f"{tmp_path}/some")
    assert read_optional(spark, f"{tmp_path}/some", "wallet string, num_spikes_preceded long").count() == 1


def test_a_slice_of_a_market_has_its_pre_spike_figures(spark):
    rows = [trade(1, 0, 0.1, 50.0, maker="m", taker="a", ord=0), trade(1, 100, 0.2, 20.0, maker="m", taker="b", ord=1), trade(1, 105, 0.9, 30.0, maker="m", taker="c", ord=2), trade(2, 0, 0.5)]
    markets = spark.createDataFrame([("1", "q", 9.0, "x"), ("2", "r", 1.0, "x")], "id string, question string, volume double, closedTime string")
    row = reports.slice_summary(reports.market_slice(tape(spark, rows), markets, 1)).first()
    # the move starts at minute 100, so only the trade at minute 0 lies in its look-back, for both sides of it
    assert (row.pre_spike_trades, row.pre_spike_wallets, row.correct, row.pre_spike_usd) == (2, 2, 1, 100.0)
    assert wallet_positions(tape(spark, rows), markets).where("market_id = 1").count() == row.positions and T0


def test_positions_are_dealt_by_transaction_and_market_only(spark):
    """At any size: an exchange by wallet, transaction or side of the doubled trades would be there beside these."""
    rows = queries.day_positions(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    dealt = [[re.sub("#.*", "", c) for c in keys.split(", ")[:-1]] for keys in re.findall(r"Exchange hashpartitioning\((.*?)\), ", plan)]
    assert sorted(map(tuple, dealt)).count(("market_id", "slice")) >= 1 and not any("wallet" in keys or "nonusdc_side" in keys for keys in dealt) and "BroadcastHashJoin [transactionHash" not in plan
    assert rows.count() == rows.select("wallet", "market_id", "side").distinct().count()


def test_values_read_no_texts_of_markets(spark):
    kept = score.needed(queries.day_positions(spark, "/root/testdata/sf0.001"))
    assert "market_question" not in kept.columns and kept.where("resolution not in ('token1', 'token2')").isEmpty()


def test_timings_read_history_and_trades_ahead_from_stored_tables(spark):
    rows, spikes = queries.candidate_timings(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # the tape is read for the activity of wallets only, not again for each figure of trades, moves and history
    assert "row_number" not in plan and "price_before" in spikes.columns
    assert rows.count() == rows.select("wallet").distinct().count()


def test_metrics_read_positions_of_resolved_markets_only(spark):
    """The trades of other markets are left out before they are dealt by transaction; outcomes are looked up without sorting positions."""
    folder = "/root/testdata/sf0.001"
    rows, outcomes = queries.resolved_positions(spark, folder)
    columns = [c for c in rows.columns]
    whole = queries.day_positions(spark, folder).where("resolution in ('token1', 'token2')").select(*columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, whole.collect())) != [] and outcomes.where("resolution not in ('token1', 'token2')").isEmpty()
    plan = queries.FOUND["bet_size_vs_odds"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [l_partkey" in plan and "LeftSemi" in plan and "SortMergeJoin [market_id" not in plan


def test_trades_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    """A fixed number of partitions would sort ever more rows in a task, and spill."""
    folder = "/root/testdata/sf0.001"
    before = sorted(map(str, queries.day_positions(spark, folder).collect()))
    monkeypatch.setattr("tidewatch.functions.ROWS_A_TASK", 500)
    rows = queries.day_positions(spark, folder)
    tasks = {int(n) for n in re.findall(r"Exchange hashpartitioning\((?:transactionHash|order|market_id)#[^)]*?(\d+)\), REPARTITION_BY_NUM", rows._jdf.queryExecution().executedPlan().toString())}
    assert len(tasks) == 1 and tasks.pop() > 4 and sorted(map(str, rows.collect())) == before


def test_slices_and_entities_read_stored_positions_without_texts(spark, monkeypatch):
    """Positions are made once a query: what is asked of them twice isn't traced back to the trades twice."""
    folder, kept = "/root/testdata/sf0.001", []
    for run in (queries.FOUND["wallet_slice_profit_factor"], studies.FOUND["entity_leaderboard"]):
        rows = run(spark, folder)
        assert "lineitem" not in " ".join(rows.inputFiles()) and rows.columns
    monkeypatch.setattr(queries, "write_table", lambda df, path, *order: (kept.extend(df.columns), df.limit(3).write.parquet(path)))
    queries.FOUND["stored_slice"](spark, folder)
    assert "wallet" in kept and "market_question" not in kept


def test_thinned_loses_no_wanted_row(spark):
    rows, wanted = spark.range(200_000).selectExpr("if(id = 7, null, id) as k", "id"), spark.range(0, 200_000, 100).selectExpr("id as market_id")
    kept = [r.k for r in thinned(rows, "k", wanted, "market_id").collect()]
    # beside the 2,000 wanted ones those whose bit another key has set too
    assert len(kept) == len(set(kept)) < 2_100 and set(range(0, 200_000, 100)) <= set(kept)
    assert thinned(rows, "k", wanted.limit(0), "market_id").count() == 0 and thinned(rows, "k", wanted.union(wanted), "market_id").columns == ["k", "id"]


def test_lines_of_other_markets_are_left_out_where_they_are_read(spark):
    """Dealing all lines by market, only to leave out most of them, was the largest exchange of all."""
    plan = queries.resolved_positions(spark, "/root/testdata/sf0.001")[0]._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("ShuffledHashJoin [l_partkey") :]
    assert re.search(r"Exchange hashpartitioning\(l_partkey[^\n]*\n(?:(?!Exchange)[^\n]*\n)*[^\n]*BroadcastHashJoin [^\n]*LeftSemi", below)


def test_positions_are_dealt_to_wallets_without_volumes(spark):
    rows = score.needed(queries.day_positions(spark, "/root/testdata/sf0.001"))
    plan = score.fused_values(rows, queries.resolved_positions(spark, "/root/testdata/sf0.001")[1], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("market_volume|niche_volume", plan[: plan.index("Join LeftOuter")])
