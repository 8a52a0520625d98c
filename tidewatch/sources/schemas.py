"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Column names and types that files of these kinds have: fixed values.
FILLS = "id string, timestamp long, maker string, makerAssetId string, makerAmountFilled long, taker string, takerAssetId string, takerAmountFilled long, transactionHash string"
SPLITS = "id string, timestamp long, stakeholder string, condition string, amount string"
REDEMPTIONS = "id string, timestamp long, redeemer string, condition string, indexSets string, payout string"
MARKETS = "createdAt string, id string, question string, answer1 string, answer2 string, neg_risk string, market_slug string, token1 string, token2 string, condition_id string, volume double, ticker string, closedTime string"
TRADES = "timestamp timestamp, market_id long, maker string, taker string, nonusdc_side string, maker_direction string, taker_direction string, price double, usd_amount double, token_amount double, transactionHash string"
PRICE_HISTORY = "market_id long, bucket_start timestamp, bucket_end timestamp, avg_price double, num_trades long, total_volume double"
SPIKES = "spike_id long, market_id long, spike_start_ts timestamp, spike_end_ts timestamp, price_before double, price_after double, magnitude_pp double, direction string"
TIMING = "wallet string, num_spikes_preceded long, num_markets long, avg_lead_time_minutes double, median_lead_time_minutes double, total_pre_spike_usd double, hit_rate double, total_trades_all long, total_markets_all long, spike_rate double, expected_spikes double, excess_ratio double, is_flagged boolean"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
