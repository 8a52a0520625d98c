"""Mixing sources to target weights with the cube method.

A document's size is its number of words. The sources in code-point order (null last) weigh
3, 1, 2, repeating, and share `share` times all sizes by weight; no source gives more than
`most` times its size, and what it can't give is shared among the others by weight.
A source that must give r times its size takes floor(r) copies of each document, and one copy more
of a sample with inclusion probability r - floor(r). The cube method draws that sample: three
undecided documents at a time move along the one direction that changes neither the sum of
probabilities (documents) nor the sum of probability times size (words), until one of them reaches 0
or 1. That leaves two or so undecided documents in a block; the blocks' remainders meet in
further rounds, a factor of `FAN_IN` fewer blocks each, and the last few documents of a source land on
the 0/1 choice that is nearest to the words still owed; where the last round still sees decided
documents, one that is taken and one that isn't change places while that brings the words nearer.
A move goes either way with the chances that keep every document's inclusion probability.

Blocks hold about BLOCK documents of one source, so a source that holds a third of all rows is many
blocks. No random state is kept: draws come from hashes of ids, and reruns agree.

Results for odd input: a null text has size 0; equal rows are separate documents (the rows that
share id and size are told apart by their order, which no result depends on); a table without words
takes nothing; an empty table gives an empty result; other columns aren't returned.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.shared import written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BLOCK, FAN_IN = 8192, 1024
#: Decided documents of a block that may change places in the next round.
RESERVE = 128
WORD = r"[^\x20\x09-\x0D]+"
SOURCE = "struct<unknown:boolean,name:string>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, docs, source_size, target: one row a source, from rows with source (null last in its order) and size.

    A source's cap over its weight is the level at which it stops. In the order of these levels, the
    common level is the one at which the stopped sources' caps and the others' weights times the level
    make up the whole. The windows here have one row a source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    order = W.orderBy("source")
    rank = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("stop", F.col("cap") / F.col("weight"))
    by_stop = W.orderBy("stop", "source")
    until = by_stop.rowsBetween(W.unboundedPreceding, -1)
    rest = by_stop.rowsBetween(0, W.unboundedFollowing)
    owed = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(until), F.lit(0.0))
    per = per.withColumn("level", owed / F.sum("weight").over(rest))
    # the first source in this order that doesn't stop below its level sets the level of all later ones
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(W.partitionBy())["level"])
    return per.select("source", "docs", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _direction(sizes: np.ndarray) -> np.ndarray:
    """What leaves the sums of (1, 1, 1) and of the sizes as they are; one of them if all sizes are equal."""
    a, b, c = sizes
    way = np.array([b - c, c - a, a - b])
    return way if way.any() else np.array([1.0, -1.0, 0.0])


def _room(p: np.ndarray, way: np.ndarray) -> float:
    """How far p can go that way within 0 and 1."""
    moves = way != 0
    return float(np.min(np.where(way > 0, 1 - p, p)[moves] / np.abs(way[moves])))


def flight(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Chances moved to 0 or 1, but for two or so; their sum and their sum with the sizes stay."""
    chances = chances.copy()
    held: list[int] = []
    for at in np.flatnonzero((chances > 0) & (chances < 1)):
        held.append(int(at))
        while len(held) == 3:
            p, way = chances[held], _direction(sizes[held])
            up, down = _room(p, way), _room(p, -way)
            if draws[held[-1]] * (up + down) >= down:  # up with chance down / (up + down)
                way, up = -way, down
            p = p + up * way
            p = np.where((p < 1e-9) | (p > 1 - 1e-9), np.round(p), p)
            chances[held] = p
            held = [i for i in held if 0 < chances[i] < 1]
    return chances


def landing(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Of the 0/1 choices for the undecided, the one nearest to their sum of sizes, then to their number."""
    chances = chances.copy()
    left = np.flatnonzero((chances > 0) & (chances < 1))
    if len(left) > 12:
        raise ValueError("flight() leaves fewer")
    words, docs = float(chances[left] @ sizes[left]), float(chances[left].sum())
    choices = itertools.product((0.0, 1.0), repeat=len(left))
    chances[left] = min(choices, key=lambda x: (abs(float(np.dot(x, sizes[left])) - words), abs(sum(x) - docs), x)) if len(left) else ()
    return chances


def swapped(sizes: np.ndarray, chances: np.ndarray, before: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Swaps of a taken with an untaken free document, each the one that brings the words nearest to their sum before, until none does."""
    chances = chances.copy()
    over = float(chances @ sizes - before @ sizes)
    free = np.flatnonzero(free)
    while abs(over) > 1e-6:
        taken, untaken = free[chances[free] == 1], free[chances[free] == 0]
        if not len(taken) or not len(untaken):
            break
        untaken = untaken[np.argsort(sizes[untaken], kind="stable")]
        near = np.searchsorted(sizes[untaken], sizes[taken] - over)
        pairs = np.stack([np.clip(near - 1, 0, len(untaken) - 1), np.clip(near, 0, len(untaken) - 1)])
        left = over - sizes[taken] + sizes[untaken[pairs]]
        side, at = np.unravel_index(np.argmin(np.abs(left)), left.shape)
        if abs(left[side, at]) > abs(over) - 1e-6:
            break
        chances[taken[at]], chances[untaken[pairs[side, at]]] = 0.0, 1.0
        over = float(left[side, at])
    return chances


def reserve(chances: np.ndarray, free: np.ndarray, most: int = RESERVE) -> np.ndarray:
    """Whether a document, in the order of sizes, goes to the next round: the undecided, and `most` free ones, of the taken and untaken the longest, the shortest and some at even steps."""
    goes = (chances > 0) & (chances < 1)
    for kind in (0.0, 1.0):
        own = np.flatnonzero(free & (chances == kind))
        goes[own[: most // 8]] = goes[own[len(own) - min(len(own), most // 8) :]] = True
        goes[own[np.linspace(0, len(own) - 1, min(len(own), most // 4)).astype(int)]] = True
    return goes


def _flown(first: bool):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], kind="stable")
        sizes, before = rows["size"].to_numpy(float), rows["chance"].to_numpy(float)
        chances = flight(sizes, before, rows["draw"].to_numpy(float))
        # later rounds have only documents of sources whose chance lies between 0 and 1
        free = (before > 0) & (before < 1) if first else np.full(len(rows), True)
        last = rows["blocks"].iloc[0] == 1
        rows["chance"] = swapped(sizes, landing(sizes, chances), before, free) if last else chances
        rows["open"] = False if last else reserve(chances, free)
        return rows

    return block


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per row of df: doc_id, source, size, source_size, target, copies, taken (copies times size)."""
    name = F.col(source_col).cast("string")
    source = F.struct(name.isNull().alias("unknown"), F.coalesce(name, F.lit("")).alias("name"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = written(rows, "sizes")
    targets = written(source_targets(rows, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a rate within rounding of a whole number is that number
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    # rows that share source, id and size are one line with a count until they are dealt to blocks
    lines = rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    lines = lines.join(F.broadcast(targets) if targets.count() <= 10_000 else targets, "source").select(
        "source", "doc_id", "row", "size", "source_size", "target", F.floor(rate).cast("long").alias("base"), (rate - F.floor(rate)).alias("chance"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)).cast("long").alias("blocks"),
    )
    dealt = lines.withColumn("draw", F.pmod(F.xxhash64(F.col("doc_id"), F.col("row"), F.lit(11)), F.lit(1 << 40)) / float(1 << 40)).withColumn("block", F.pmod(F.xxhash64("doc_id", "row", F.lit(7)), F.col("blocks")))
    schema = f"source {SOURCE}, doc_id long, row long, size long, source_size long, target double, base long, chance double, blocks long, draw double, block long, open boolean"
    most_blocks = (dealt.agg(F.max("blocks")).first()[0] or 1) if not targets.isEmpty() else 1
    done: list[DataFrame] = []
    level = 0
    while True:
        flown = written(dealt.groupBy("source", "block").applyInPandas(_flown(level == 0), schema), f"flight{level}")
        done.append(flown.where("not open"))
        if most_blocks == 1:
            break
        most_blocks, level = math.ceil(most_blocks / FAN_IN), level + 1
        dealt = flown.where("open").withColumn("blocks", F.ceil(F.col("blocks") / FAN_IN)).withColumn("block", F.floor(F.col("block") / FAN_IN))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.col("chance")).cast("long")
    return out.select("doc_id", F.when(~F.col("source.unknown"), F.col("source.name")).alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df's rows as the mix takes them, with df's columns: a row that is taken twice is there twice."""
    copies = mixed(df, id_col, text_col, source_col).where("copies > 0").groupBy("doc_id", "source", "size")
    copies = copies.agg(F.array_sort(F.collect_list("copies")).alias("__tw_copies")).select(F.col("doc_id").alias("__tw_id"), F.col("source").alias("__tw_source"), F.col("size").alias("__tw_words"), "__tw_copies")
    own = df.withColumn("__tw_size", word_count(F.col(text_col)))
    repeated = not df.groupBy(id_col).count().where("count > 1").isEmpty()
    if repeated:
        own = own.withColumn("__tw_row", F.row_number().over(W.partitionBy(id_col, source_col, "__tw_size").orderBy(id_col)))
    else:
        own = own.withColumn("__tw_row", F.lit(1))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__tw_id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__tw_source")) & (F.col("__tw_size") == F.col("__tw_words"))
    times = F.coalesce(F.try_element_at("__tw_copies", F.col("__tw_row")), F.lit(0))
    # copies grow with df, so they aren't broadcast where their file happens to be small
    taken = own.join(copies.hint("merge"), same).withColumn("__tw_times", times.cast("int")).where("__tw_times > 0")
    return taken.withColumn("__tw_each", F.explode(F.sequence(F.lit(1), F.col("__tw_times")))).select(*(F.col(f"`{c}`") for c in df.columns))
