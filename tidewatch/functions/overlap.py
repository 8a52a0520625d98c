"""What pairs of sets have in common, counted in squares of blocks of sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets and members of a block at most, blocks that keep the cores of a small cluster busy, and the least sets of one of those.
SETS, MEMBERS, BUSY, FEW = 16_384, 4_000_000, 14, 256
#: Members of one set in a row, and meetings that are in memory at a time.
ROW, STEP = 4_096, 4_000_000


def blocks_of(sets: int, members: int) -> int:
    """Blocks that so many sets are cut into."""
    return max(1, -(-sets // SETS), -(-members // MEMBERS), min(BUSY, -(-sets // FEW)))


def _flat(rows: pa.Table, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member's set and itself."""
    members = rows["members"].combine_chunks()
    return np.repeat(code, members.value_lengths().to_numpy(zero_copy_only=False)), members.flatten().to_numpy(zero_copy_only=False)


def _square(rows: pa.Table, same: bool, least_shared: int, least_share: float) -> Iterator[pa.RecordBatch]:
    """Pairs of one square's left and right sets; a square on the diagonal has its sets once, as left ones."""
    coded = rows["wallet"].combine_chunks().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy()
    rank, size = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    size[code] = rows["n"].to_numpy()
    right = rows["right"].to_numpy()
    of_left, left = _flat(rows.filter(pa.array(~right)), code[~right])
    of_right, held = (of_left, left) if same else _flat(rows.filter(pa.array(right)), code[right])
    order = np.argsort(held, kind="stable")
    of_right, held = of_right[order], held[order]
    order = np.argsort(of_left, kind="stable")
    of_left, left = of_left[order], left[order]
    low = np.searchsorted(held, left, "left")
    meets = np.searchsorted(held, left, "right") - low
    sums = np.concatenate(([0], np.cumsum(meets)))
    owners, starts = np.unique(of_left, return_index=True)
    found, waiting = [], 0
    for owner, at, end in zip(owners, starts, np.append(starts[1:], len(of_left)), strict=True):
        shared = np.zeros(len(names), np.int64)
        while at < end:
            to = min(end, max(at + 1, int(np.searchsorted(sums, sums[at] + STEP, "right")) - 1))
            places = np.repeat(low[at:to] - (sums[at:to] - sums[at]), meets[at:to]) + np.arange(sums[to] - sums[at])
            shared += np.bincount(of_right[places], minlength=len(names))
            at = to
        # in the diagonal square each pair meets twice, and each set itself
        other = np.flatnonzero((shared >= max(least_shared, 1)) & (rank > rank[owner])) if same else np.flatnonzero(shared >= max(least_shared, 1))
        share = shared[other] / (size[owner] + size[other] - shared[other])
        other, share = other[share >= least_share], share[share >= least_share]
        if len(other):
            found.append((np.full(len(other), owner), other, shared[other], share))
            waiting += len(other)
        if waiting > 100_000:
            yield _batch(names, rank, found)
            found, waiting = [], 0
    if found:
        yield _batch(names, rank, found)


def _batch(names: pa.Array, rank: np.ndarray, found: list) -> pa.RecordBatch:
    x, y, shared, share = (np.concatenate(column) for column in zip(*found, strict=True))
    swap = rank[x] > rank[y]
    return pa.RecordBatch.from_arrays([names.take(pa.array(np.where(swap, y, x))), names.take(pa.array(np.where(swap, x, y))), pa.array(shared), pa.array(share)], ["a", "b", "shared", "share"])


def _squares(blocks: int, least_shared: int, least_share: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, square = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch["square"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if held and keys[start] != square:
                    yield from _square(pa.Table.from_batches(held), square // blocks == square % blocks, least_shared, least_share)
                    held = []
                square = int(keys[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield from _square(pa.Table.from_batches(held), square // blocks == square % blocks, least_shared, least_share)

    return run


def pairs_by_blocks(rows: DataFrame, blocks: int, least_shared: int, least_share: float) -> DataFrame:
    """a, b, shared, share of all pairs (a < b) of sets with as much in common; rows: wallet, n (the set's size), pid, each member once.

    A set's block is by its hash; each two blocks are a square, and one task at a time counts what the sets of a square share. What is shuffled is the members
    times the blocks, however many pairs there are, and pairs leave a task as they are found.
    """
    sets = rows.groupBy("wallet", "n", F.pmod(F.hash("pid"), F.ceil(F.col("n") / ROW)).alias("part")).agg(F.collect_list("pid").alias("members"))
    sets = sets.withColumn("block", F.pmod(F.xxhash64("wallet"), F.lit(blocks)).cast("int"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select((low * blocks + high).alias("square"), (F.col("block") > F.col("other")).alias("right"), "wallet", "n", "members")
    count = blocks * (blocks + 1) // 2
    dealt = dealt.repartition(min(count, 2_000), "square").sortWithinPartitions("square")
    return dealt.mapInArrow(_squares(blocks, least_shared, least_share), "a string, b string, shared long, share double")
