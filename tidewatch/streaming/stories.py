"""Copies of stories merged as they arrive, and a feed of the stories that moved markets most."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.news import host, story_key
from tidewatch.sources import exists

OUT = "headline_key string, domain string, story_id long, published_at timestamp, headline string, url string, sources array<string>, copies long, version long"
STATE = "at long, story_id long, headline string, url string, sources array<string>, copies long, version long, last long"
KEY = ["headline_key", "domain"]


class StoryState(StatefulProcessor):
    """The earliest of a story's copies and the hosts that had it; it is forgotten when no copy has come for `keep` seconds."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("story", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        new["us"] = new["published_at"].astype("datetime64[us]").astype("int64")
        first = new.sort_values(["us", "story_id"]).iloc[0]
        own = (int(first["us"]), int(first["story_id"]), first["headline"], first["url"])
        sources, copies, version, last = set(new["source"].dropna()), len(new), 0, int(new["us"].max())
        if self.state.exists():
            *old, had, n, version, before = self.state.get()
            own, sources, copies, last = min(own, tuple(old), key=lambda x: x[:2]), sources | set(had), copies + n, max(last, before)
        names = sorted(sources)
        self.state.update((*own, names, copies, version + 1, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.keep * 1000)
        yield pd.DataFrame([(*key, own[1], pd.Timestamp(own[0], unit="us"), own[2], own[3], names, copies, version + 1)], columns=[*KEY, "story_id", "published_at", "headline", "url", "sources", "copies", "version"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_stories(stories: DataFrame, late: str = "1 hour", keep: int = 86_400) -> DataFrame:
    """Merged stories with a version, a new row whenever copies arrive, for the update mode; the last version is what the batch operator gives.

    stories: story_id, headline, url, published_at (not null). Needs the RocksDB state store.
    """
    rows = stories.withWatermark("published_at", late).select(*story_key(F.col("headline"), F.col("url")), host(F.col("url")).alias("source"), "story_id", "published_at", "headline", "url")
    return rows.groupBy(*KEY).transformWithStateInPandas(StoryState(keep), OUT, "Update", "EventTime")


class ImpactFeed:
    """The stories of most impact, kept from batch to batch below a folder.

    A batch has story_id, spike_id, points, revision: what a move adds to a story, or null points where an attribution is withdrawn; the
    highest revision of a (story, move) counts. A batch reads the earlier contributions of the stories that it touches only. The new feed is the best of
    the old one and of these; only where a story of a full feed has lost points may another one be due, and then all
    stories' last scores are looked at. Every step writes a folder named after the batch, so a repeated batch replaces what it wrote.
    """

    POINTS = "story_id long, spike_id long, points double, revision long"
    SCORES = "story_id long, impact_score double, batch long"

    def __init__(self, spark: SparkSession, folder: str, limit: int = 100) -> None:
        self.spark, self.folder, self.limit = spark, folder, limit

    def _before(self, kind: str, schema: str, number: int) -> DataFrame:
        """Rows of a kind of the batches before."""
        path = f"{self.folder}/{kind}"
        rows = self.spark.read.schema(f"{schema}, number long").parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], f"{schema}, number long")
        return rows.where(F.col("number") < number)

    def _put(self, rows: DataFrame, kind: str, number: int) -> DataFrame:
        path = f"{self.folder}/{kind}/number={number}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _top(self, scores: DataFrame) -> DataFrame:
        return scores.where("impact_score > 0").orderBy(F.desc("impact_score"), "story_id").limit(self.limit)

    def apply(self, batch: DataFrame, number: int) -> None:
        """One batch; batches come in the order of their numbers, and the last one may come again."""
        new = self._put(batch.select("story_id", "spike_id", "points", "revision"), "points", number)
        stories = new.select("story_id").distinct()
        known = self._before("points", self.POINTS, number).drop("number").join(stories, "story_id", "left_semi").unionByName(new)
        last = known.groupBy("story_id", "spike_id").agg(F.max_by("points", "revision").alias("points"))
        sums = last.groupBy("story_id").agg((F.coalesce(F.sum(F.floor(F.col("points") * 1_000_000 + 0.5)), F.lit(0)) / 1_000_000.0).alias("impact_score"))
        touched = self._put(sums.withColumn("batch", F.lit(number).cast("long")), "scores", number)
        old = self._last_feed(number)
        kept = old.join(touched.select("story_id"), "story_id", "left_anti")
        feed = kept.unionByName(touched.select("story_id", "impact_score"))
        lost = old.join(touched.select("story_id", F.col("impact_score").alias("now")), "story_id").where("now < impact_score")
        if old.count() >= self.limit and not lost.isEmpty():  # `limit` rows
            every = self._before("scores", self.SCORES, number).drop("number").unionByName(touched)
            feed = every.groupBy("story_id").agg(F.max_by("impact_score", "batch").alias("impact_score"))
        # a row without a story marks a feed that may be empty
        mark = self.spark.range(1).select(F.lit(None).cast("long").alias("story_id"), F.lit(0.0).alias("impact_score"))
        self._put(self._top(feed).unionByName(mark), "feed", number)

    def _last_feed(self, number: int) -> DataFrame:
        rows = self._before("feed", "story_id long, impact_score double", number)
        return rows.join(rows.agg(F.max("number").alias("number")), "number").drop("number").where("story_id is not null")

    def feed(self) -> DataFrame:
        """story_id, impact_score after the last batch, best first."""
        return self._last_feed(1 << 62).orderBy(F.desc("impact_score"), "story_id")
