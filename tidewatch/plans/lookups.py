"""Queries of landed files, of leaderboards by each of their columns, and of whole slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import exact_sum
from tidewatch.operators import metrics, quality, reports, score, tape, timing
from tidewatch.plans.queries import Query, _busiest, _resolved_slice, candidate_timings, candidates, day_positions, event_positions, shown
from tidewatch.sources import land_chunks, read_chunks, read_csv, read_optional, schemas, tapes
from tidewatch.sources.scratch import scratch, stored
from tidewatch.sources.tapes import table

FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def _landed(spark: SparkSession, d: str) -> str:
    """Fills of the events tape as gzipped chunks: the trade's last digit is the worker, its ten days the part."""
    path = scratch(spark, "chunks")
    at = F.timestamp_seconds("timestamp")
    ten = F.floor(F.dayofmonth(at) / 10) + 1
    rows = tapes.events_fills(spark, d).select("*", (F.col("id").cast("long") % 4).alias("worker"), ten.alias("part"), F.date_trunc("month", at).cast("date").alias("first_day"), F.last_day(at.cast("date")).alias("last_day"))
    land_chunks(rows, path, "timestamp", "id")
    return path


@query
def chunk_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows and times of chunk files by what their names say."""
    rows = read_chunks(spark, schemas.FILLS, _landed(spark, d))
    out = rows.groupBy("worker", "part", "first_day", "last_day").agg(F.count(F.lit(1)).alias("num_rows"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"), F.sum("takerAmountFilled").alias("taken"))
    return shown(out.withColumns({c: F.date_format(c, "yyyyMMdd") for c in ("first_day", "last_day")}))


@query
def chunk_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Chunk files with their rows, and whether each has bytes and a digest of its own."""
    path = _landed(spark, d)
    counts = read_chunks(spark, schemas.FILLS, path).groupBy("path", "worker", "part").agg(F.count(F.lit(1)).alias("num_rows"))
    rows = quality.manifest(spark, path, counts.select("path", "num_rows")).join(counts.select("path", "worker", "part"), "path")
    sums = rows.groupBy("md5").agg(F.count(F.lit(1)).alias("same"))
    return shown(rows.join(sums, "md5").select("worker", "part", "num_rows", (F.col("length") > 0).alias("has_bytes"), (F.col("md5").rlike("^[0-9a-f]{32}$") & (F.col("same") == 1)).alias("has_digest")))


@query
def markets_from_csv(spark: SparkSession, d: str) -> DataFrame:
    """Markets written as text and read with all their types, to tokens."""
    path = scratch(spark, "markets")
    names = [c.split() for c in schemas.MARKETS.split(", ")]
    there = tapes.events_markets(spark, d)
    rows = there.select(*(F.col(n) if n in there.columns else F.lit(None).cast(kind).alias(n) for n, kind in names))
    rows.write.option("header", True).option("escape", '"').csv(path)
    markets = read_csv(spark, schemas.MARKETS, path)
    return shown(tape.token_lookup(markets).join(markets.select(F.col("id").cast("long").alias("market_id"), "volume", "closedTime"), "market_id"))


def _board(spark: SparkSession, d: str, sort_by: str, with_timing: bool = True) -> DataFrame:
    rows = score.aggregate_score(event_positions(spark, d), least_wallets=10).withColumn("aggregate_score", F.round("aggregate_score", 6))
    if with_timing:
        timings, _ = candidate_timings(spark, d)
        timings = timings.withColumn("excess_ratio", F.round("excess_ratio", 6))
    else:
        timings = read_optional(spark, scratch(spark, "no-such-table"), schemas.TIMING)
    board = reports.leaderboard(rows, timings, 500, 1, 0.0, sort_by)
    return shown(board.select("wallet", "aggregate_score", "num_metrics_available", "num_spikes_preceded", "timing_hit_rate", "total_pre_spike_usd", "timing_excess_ratio", "timing_flagged"))


@query
def leaderboard_by_score(spark: SparkSession, d: str) -> DataFrame:
    return _board(spark, d, "aggregate_score")


@query
def leaderboard_by_usd(spark: SparkSession, d: str) -> DataFrame:
    return _board(spark, d, "total_pre_spike_usd")


@query
def leaderboard_without_timing(spark: SparkSession, d: str) -> DataFrame:
    """The leaderboard where the timing signal has no table yet."""
    return _board(spark, d, "aggregate_score", False)


@query
def top_flagged(spark: SparkSession, d: str) -> DataFrame:
    trades, spikes = tapes.events_tape(spark, d), candidates(spark, d)
    timings = timing.timing_scores(timing.pre_spike_trades(spikes, trades), spikes, timing.price_history(trades), trades)
    return shown(reports.top_flagged(timings.withColumn("excess_ratio", F.round("excess_ratio", 6)), 50))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query
def metric_previews(spark: SparkSession, d: str) -> DataFrame:
    """The ten first wallets of each metric's table in its own order; measures are rounded first, so that ties are ties in any engine."""
    positions = stored(day_positions(spark, d), "positions")
    parts = []
    for name, (function, order) in metrics.ALL.items():
        rows = function(positions)
        kinds = dict(rows.dtypes)
        rows = rows.withColumns({c: F.round(c, 4) for c in order if kinds[c] == "double"})
        parts.append(metrics.ranked_view(rows, name, 10).select(F.lit(name).alias("metric"), "wallet", F.col(order[-1]).cast("double").alias("measure")))
    return _union(parts)


@query
def wallet_slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All eight metrics of the wallet with the most positions, from its slice alone."""
    positions = stored(day_positions(spark, d), "positions")
    found = reports.wallet_slice(positions, _busiest(positions))
    parts = []
    for name, (value, bets, _) in score.SCORED.items():
        parts.append(found[name].select("wallet", F.lit(name).alias("metric"), F.col(value).cast("double").alias("value"), F.col(bets).cast("long").alias("bets")))
    return shown(_union(parts))


def _event_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Positions, scores, timing and pre-spike trades of the events tape, as a batch run stores them."""
    trades = tapes.events_tape(spark, d)
    history = stored(timing.price_history(trades), "history")
    spikes = stored(candidates(spark, d, history), "spikes")
    positions = stored(event_positions(spark, d), "positions")
    pre = stored(timing.pre_spike_trades(spikes, trades), "pre-spike")
    return {"positions": positions, "scores": stored(score.aggregate_score(positions, least_wallets=10), "scores"), "timings": stored(timing.timing_scores(pre, spikes, history, trades), "timings"), "pre_spike": pre}


@query
def wallet_slice_known(spark: SparkSession, d: str) -> DataFrame:
    """What is stored of the wallet with the most pre-spike trades: its score, timing, positions and these trades, as counts and sums."""
    found = _event_tables(spark, d)
    wallet = _busiest(found["pre_spike"])
    own = reports.wallet_slice(found["positions"], wallet, found["scores"], found["timings"], found["pre_spike"])
    figures = {"positions": "total_usd_in", "aggregate_scores": "aggregate_score", "timing_scores": "excess_ratio", "pre_spike_trades": "usd_amount"}
    return shown(_union([own[name].agg(F.lit(name).alias("part"), F.max("wallet").alias("wallet"), F.count(F.lit(1)).alias("n"), exact_sum(F.round(value, 6)).alias("total")) for name, value in figures.items()]))


@query
def wallet_figures(spark: SparkSession, d: str) -> DataFrame:
    """The report of the wallet with the most positions: one row of what each table says of it."""
    found = _event_tables(spark, d)
    return shown(reports.wallet_figures(_busiest(found["positions"]), found["positions"], found["scores"], found["timings"], found["pre_spike"]))


@query
def market_slice_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each of the twelve parts of a market's slice: its rows, and the sum of what it measures."""
    parts = _resolved_slice(spark, d)
    measures = {"positions": "total_usd_in", "price_history": "avg_price", "price_spikes": "magnitude_pp", "pre_spike_trades": "usd_amount"} | {n: v for n, (v, _, _) in score.SCORED.items()}
    return shown(_union([parts[n].agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), exact_sum(F.round(F.col(v).cast("double"), 4)).alias("total")) for n, v in measures.items()]))


@query
def whole_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of more than a minute in which no event of any user is under way, over the whole line of times."""
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = table(spark, d, "events").select(at.alias("start"), (at + 240).alias("end"))
    ends = rows.agg(F.min("start").alias("lo"), F.max("end").alias("hi")).select((F.col("lo") - 600).alias("expected_start"), (F.col("hi") + 600).alias("expected_end"))
    return shown(quality.gaps(rows, ends, 60))


@query
def whole_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events that are within a minute of each other, over the whole line of times."""
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = table(spark, d, "events").select(at.alias("start"), (at + 240).alias("end"))
    return shown(quality.merged_intervals(rows, 60))


@query
def fills_without_sums(spark: SparkSession, d: str) -> DataFrame:
    """Fills of six events a transaction and two tokens, and a fill that sums them up in every third transaction; what is left without these."""
    own = tapes.events_fills(spark, d).select("*", F.floor(F.col("id").cast("long") / 6).alias("six"), (F.col("id").cast("long") % 2).alias("two"))
    own = own.withColumns({"transactionHash": F.concat(F.lit("x"), "six"), "token": F.concat(F.lit("T"), "two")})
    gives = F.col("makerAssetId") != tape.CASH
    tokens, cash = F.when(gives, F.col("makerAmountFilled")).otherwise(F.col("takerAmountFilled")), F.when(gives, F.col("takerAmountFilled")).otherwise(F.col("makerAmountFilled"))
    named = own.withColumns({"makerAssetId": F.when(gives, F.col("token")).otherwise(F.col("makerAssetId")), "takerAssetId": F.when(gives, F.col("takerAssetId")).otherwise(F.col("token")), "tokens": tokens, "cash": cash})
    sums = named.where("six % 3 = 0").groupBy("transactionHash", "token").agg(F.sum("tokens").alias("makerAmountFilled"), F.sum("cash").alias("takerAmountFilled"), F.max("timestamp").alias("timestamp"))
    names = [c.split()[0] for c in schemas.FILLS.split(", ")]
    sums = sums.select(F.concat(F.lit("sum "), "transactionHash", F.lit(" "), "token").alias("id"), "timestamp", F.lit("book").alias("maker"), F.col("token").alias("makerAssetId"), "makerAmountFilled", F.lit("exchange").alias("taker"), F.lit("0").alias("takerAssetId"), "takerAmountFilled", "transactionHash")
    left = tape.without_aggregate_fills(named.select(*names).unionByName(sums))
    return left.groupBy("transactionHash").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("taker") == "exchange").alias("sums_left"), F.sum(F.when(F.col("makerAssetId") == "0", F.col("makerAmountFilled")).otherwise(F.col("takerAmountFilled"))).alias("cash"))


def queries() -> dict[str, Query]:
    return dict(FOUND)
