"""Stories: their copies, the market moves they may explain, and the feed of those that moved most."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import binned_interval_join, divide, exact_sum, with_row
from tidewatch.operators.indices import hour_volumes
from tidewatch.sources.scratch import stored

LOOK_BACK = 3600
#: A keyword has so many letters or digits at least.
KEYWORD = r"[\p{L}\p{N}]{3,}"
LEAST_SCORE, MOST_STORIES = 0.2, 0.2
#: Latin letters with marks, and the letters that they are without.
MARKED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1}


def folded(text: Column) -> Column:
    """Lower case without marks on Latin letters; runs of anything but letters and digits are one space."""
    plain = F.translate(F.lower(text), "".join(MARKED), "".join(MARKED.values()))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def host(url: Column) -> Column:
    """The host of a URL in lower case, null where there is none."""
    return F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def domain(url: Column) -> Column:
    """The last two names of a URL's host."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+|[^.]+)$", 1)


def story_key(headline: Column, url: Column) -> list[Column]:
    """headline_key and domain: stories with equal ones are one story. A story without a host has the domain ''."""
    return [folded(F.coalesce(headline, F.lit(""))).alias("headline_key"), F.coalesce(domain(url), F.lit("")).alias("domain")]


def merged_stories(stories: DataFrame) -> DataFrame:
    """headline_key, domain, story_id, published_at, headline and url of the earliest, sources (hosts, in order), copies.

    stories: story_id, headline, url, published_at. Ties go to the smallest id. A story without a headline is a copy of the others without one
    on its domain; one without a time comes after all with one.
    """
    rows = stories.select(*story_key(F.col("headline"), F.col("url")), host(F.col("url")).alias("source"), "story_id", "published_at", "headline", "url")
    time = F.coalesce(F.unix_micros("published_at"), F.lit((1 << 63) - 1))
    first = F.min_by(F.struct("story_id", "published_at", "headline", "url"), F.struct(time, "story_id"))
    sums = rows.groupBy("headline_key", "domain").agg(first.alias("first"), F.array_sort(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("copies"))
    return sums.select("headline_key", "domain", "first.*", "sources", "copies")


def keywords(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, word: the different keywords of each text."""
    return rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(KEYWORD), F.lit(0)))).alias("word"))


def attributions(moves: DataFrame, stories: DataFrame, markets: DataFrame, seconds: int = LOOK_BACK, least_score: float = LEAST_SCORE, most_stories: float = MOST_STORIES) -> DataFrame:
    """spike_id, market_id, story_id, lag_minutes, shared, keyword_score: stories of the last `seconds` before a move that share more than `least_score` of the market's keywords.

    moves: spike_id, market_id, at. stories: story_id, published_at, text. markets: market_id, text. Words that more than `most_stories` of all
    stories have aren't keywords. A market and a story that share enough have one of the market's rarest words in common, whichever of its
    words they share; so only stories with such a word, in an hour that the move looks back on, are compared, and
    everyday words are never paired on.
    """
    told = stored(keywords(stories, "story_id", "text"), "story_words")
    spread = told.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = stories.agg(F.count(F.lit(1)).alias("stories"))
    known = keywords(markets, "market_id", "text").join(spread, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    known = stored(with_row(known, total).where(F.col("df") <= F.col("stories") * most_stories).select("market_id", "word", "df"), "market_words")
    sizes = known.groupBy("market_id").agg(F.count(F.lit(1)).alias("n"))
    need = F.floor(F.col("n") * least_score + 1e-9) + 1
    rarest = F.row_number().over(W.partitionBy("market_id").orderBy("df", "word"))
    leads = known.join(sizes, "market_id").withColumn("nth", rarest).where((F.col("nth") <= F.col("n") - need + 1) & (F.col("df") > 0)).select("market_id", "word")

    at = F.unix_seconds("at")
    windows = moves.select("spike_id", "market_id", (at - seconds).alias("from"), at.alias("to")).join(leads, "market_id")
    times = stories.select("story_id", F.unix_seconds("published_at").alias("told_at"))
    index = told.join(leads.select("word").distinct(), "word", "left_semi").join(times, "story_id")
    met = stored(binned_interval_join(index, windows, ["word"], "told_at", "from", "to", 3600).select("spike_id", "market_id", "story_id", "told_at", "to").distinct(), "met")
    pairs = met.select("market_id", "story_id").distinct()
    shared = pairs.join(known.select("market_id", "word"), "market_id").join(told, ["story_id", "word"]).groupBy("market_id", "story_id").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.join(sizes, "market_id").where(F.col("shared") >= need).withColumn("keyword_score", divide(F.col("shared"), F.col("n")))
    return met.join(scored, ["market_id", "story_id"]).select("spike_id", "market_id", "story_id", F.floor((F.col("to") - F.col("told_at")) / 60).alias("lag_minutes"), "shared", "keyword_score")


def move_volumes(moves: DataFrame, trades: DataFrame, hours: int = 24) -> DataFrame:
    """spike_id, volume_24h: USD of the market's trades in the `hours` whole hours before the one of the move."""
    hour = F.floor(F.unix_seconds("at") / 3600)
    windows = moves.select("spike_id", "market_id", (hour - hours).alias("from"), (hour - 1).alias("to"))
    met = binned_interval_join(hour_volumes(trades), windows, ["market_id"], "hour", "from", "to", hours)
    sums = met.groupBy("spike_id").agg((F.sum("cents") / 100.0).alias("volume_24h"))
    return moves.select("spike_id").join(sums, "spike_id", "left").withColumn("volume_24h", F.coalesce("volume_24h", F.lit(0.0)))


def contributions(found: DataFrame, moves: DataFrame, volumes: DataFrame) -> DataFrame:
    """story_id, spike_id, market_id, points: the size of the move times the market's volume, a row an attribution."""
    both = found.join(moves.select("spike_id", "magnitude_pp"), "spike_id").join(volumes, "spike_id")
    return both.select("story_id", "spike_id", "market_id", (F.abs("magnitude_pp") * F.col("volume_24h")).alias("points"))


def impact_feed(points: DataFrame, limit: int = 100) -> DataFrame:
    """story_id, impact_score, moves, markets_moved, top_market (most points): the stories that moved most; those that moved nothing aren't in it."""
    markets = points.groupBy("story_id", "market_id").agg(exact_sum(F.col("points")).alias("points"), F.count(F.lit(1)).alias("moves"))
    rows = markets.groupBy("story_id").agg(exact_sum(F.col("points")).alias("impact_score"), F.sum("moves").alias("moves"), F.count(F.lit(1)).alias("markets_moved"), F.max_by("market_id", F.struct("points", "market_id")).alias("top_market"))
    return rows.where("impact_score > 0").orderBy(F.desc("impact_score"), "story_id").limit(limit)


def price_lags(found: DataFrame) -> DataFrame:
    """market_id, stories, mean_lag: how long after stories a market moves."""
    return found.groupBy("market_id").agg(F.count_distinct("story_id").alias("stories"), F.avg("lag_minutes").alias("mean_lag"))
