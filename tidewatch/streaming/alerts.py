"""Alerts of prices that have moved against the oldest of a market's recent points, as a stream and in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOVE, POINTS, SECONDS = 0.03, 60, 3600
OUT = "market_id long, at timestamp, price double, since timestamp, price_before double, delta double"
STATE = "at array<long>, price array<double>"


def alerts(points: DataFrame, move: float = MOVE, most: int = POINTS, seconds: int = SECONDS, slice_seconds: int = 6 * SECONDS) -> DataFrame:
    """An alert a point that is `move` or more away from the oldest of the last `most` points of its market that are at most `seconds` old, itself included.

    points: market_id, at (timestamp), price, ord (order of points at one time). A busy market is as many tasks as it has slices of time: a
    slice holds the points of the one before that its own look back on.
    """
    second = F.unix_micros("at")
    width, reach = slice_seconds * 1_000_000, seconds * 1_000_000
    own = F.floor(second / width)
    rows = points.where(F.col("at").isNotNull() & F.col("price").isNotNull()).select("market_id", second.alias("us"), "ord", "price", F.explode(F.sequence(own, F.floor((second + reach) / width))).alias("slice"), own.alias("own"))
    by = W.partitionBy("market_id", "slice")
    point = F.struct("us", "ord", "price")
    # the later of the oldest by number and the oldest by age
    order = by.orderBy("us", "ord", "price")
    rows = rows.withColumns({"by_number": F.first(point).over(order.rowsBetween(1 - most, 0)), "by_age": F.min(point).over(by.orderBy("us").rangeBetween(-reach, 0))})
    old = F.when(F.col("by_number") > F.col("by_age"), F.col("by_number")).otherwise(F.col("by_age"))
    rows = rows.withColumn("old", old).withColumn("delta", F.col("price") - F.col("old.price"))
    found = rows.where((F.col("slice") == F.col("own")) & (F.round(F.abs("delta"), 9) >= move))
    return found.select("market_id", F.timestamp_micros("us").alias("at"), "price", F.timestamp_micros("old.us").alias("since"), F.col("old.price").alias("price_before"), "delta")


class RecentPoints(StatefulProcessor):
    """A market's last points, bounded by number and age; a market that is silent for longer than the age is forgotten."""

    def __init__(self, move: float, most: int, seconds: int) -> None:
        self.move, self.most, self.seconds = move, most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("points", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """One read and one write of the state a call, however many rows there are."""
        held = list(zip(*self.state.get(), strict=True)) if self.state.exists() else []
        new = pd.concat(list(rows)).sort_values(["at", "ord", "price"], kind="stable")
        found = []
        for at, price in zip(new["at"].astype("datetime64[us]").astype("int64"), new["price"], strict=True):
            held.append((int(at), float(price)))
            held = [p for p in held[-self.most :] if at - p[0] <= self.seconds * 1_000_000]
            delta = price - held[0][1]
            if round(abs(delta), 9) >= self.move:
                found.append((key[0], pd.Timestamp(at, unit="us"), price, pd.Timestamp(held[0][0], unit="us"), held[0][1], delta))
        self.state.update(([p[0] for p in held], [p[1] for p in held]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[-1][0] // 1000 + self.seconds * 1000)
        if found:
            yield pd.DataFrame(found, columns=["market_id", "at", "price", "since", "price_before", "delta"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_alerts(points: DataFrame, late: str = "10 minutes", move: float = MOVE, most: int = POINTS, seconds: int = SECONDS) -> DataFrame:
    """The same for points that arrive in the order of their times; needs the RocksDB state store."""
    rows = points.where(F.col("price").isNotNull()).withWatermark("at", late)
    return rows.groupBy("market_id").transformWithStateInPandas(RecentPoints(move, most, seconds), OUT, "Append", "EventTime")
