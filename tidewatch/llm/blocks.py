"""Sparse matrices in blocks of documents, and dictionaries that all blocks share.

A block is one row: the documents of a slice of text, a matrix of them in compressed rows (`indptr`, `indices`, `data`)
over the block's own dictionary, and that dictionary. What holds for the whole corpus (a word's number, a pair's count) is found
range by range: the dictionary's entries are dealt into ranges by a hash, a block sends one row to each range with all its
entries there, and gets one back. The commonest entry is sent once a block and not once a document. Numbers travel
as byte planes (first bytes of all, then second ones), which are a column of bytes for Spark and compress well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.shared import written

#: Bytes of text a block; a longer text is a block by itself.
BLOCK = 8 << 20
#: Entries of the corpus-wide dictionary in one range, of which one task holds all.
RANGE = 250_000
#: Entries that blocks send to one range, as long as a block sends FULL entries to each on average.
SENT, FULL = 2_000_000, 1000
#: One in so many hashes is counted to tell how many ranges there have to be.
PROBE = 1024


def packed(values: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers as byte planes."""
    return np.ascontiguousarray(values.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unpacked(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<i{width}").ravel().astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = BLOCK) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Numbers that are unique over all tasks, and slices of about `limit` bytes of text."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        ends = [*(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
        start = 0
        for end in ends:
            if end > start:
                yield number, batch.slice(start, end - start)
                number += 1
            start = int(end)


def counted(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """indptr, indices and data of a matrix in which each (row, column) of the entries counts 1."""
    keys, data = np.unique(rows.astype(np.int64) * max(n_columns, 1) + columns, return_counts=True)
    own = keys // max(n_columns, 1)
    return np.searchsorted(own, np.arange(n_rows + 1)), keys - own * max(n_columns, 1), data.astype(np.int64)


def row_sums(indptr: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; 0 for empty rows."""
    upto = np.concatenate(([0], np.cumsum(values)))
    return upto[indptr[1:]] - upto[indptr[:-1]]


def listed(values: pa.Array | np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column of one row that holds all values."""
    values = values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def word_places(words: bytes) -> np.ndarray:
    """Hashes of words that are joined by line feeds."""
    return pd.util.hash_array(np.array(words.split(b"\n"), object), categorize=False) if words else np.zeros(0, np.uint64)


def key_places(keys: bytes, shift: int = 0) -> np.ndarray:
    """Hashes of packed 64-bit keys, of their lower `shift` bits where these decide."""
    own = unpacked(keys, 8)
    return pd.util.hash_array(own & ((1 << shift) - 1) if shift else own, categorize=False)


def probed(hashes: np.ndarray) -> pa.Array:
    """The hashes by which ranges() counts."""
    return listed(hashes[hashes % PROBE == 0].astype(np.int64), pa.int64())


def ranges(blocks: DataFrame, size: int = RANGE) -> int:
    """How many ranges the dictionary of all blocks needs, by their column `probe`: so that one holds `size` different entries, and is sent SENT at most while rows stay full."""
    different = blocks.select(F.explode("probe").alias("x")).distinct().count() * PROBE
    sums = blocks.agg(F.coalesce(F.sum(F.size("probe")), F.lit(0)).alias("probes"), F.count(F.lit(1)).alias("blocks")).first()
    sent = sums["probes"] * PROBE
    return 1 + max(different // size, min(sent // SENT, sent // max(sums["blocks"], 1) // FULL))


def dealt(blocks: DataFrame, n: int, cut: Callable[[pa.RecordBatch, int], Iterator[tuple[int, bytes, dict[str, bytes]]]], columns: list[str]) -> DataFrame:
    """range, block, places and `columns` (bytes) of each block's entries by range. cut gives (range, places, columns' bytes) of a row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                parts = list(cut(row, n))
                block = row.column("block")[0].as_py()
                arrays = [pa.array([p[0] for p in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary()), *(pa.array([p[2][c] for p in parts], pa.binary()) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, ["range", "block", "places", *columns])

    return blocks.mapInArrow(build, "range int, block long, places binary, " + ", ".join(f"{c} binary" for c in columns))


def split(hashes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Ranges and the places of their entries."""
    own = ((hashes // np.uint64(PROBE)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[order], np.arange(n + 1))
    for i in np.unique(own):
        yield int(i), order[ends[i] : ends[i + 1]]


def numbered(blocks: DataFrame, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """For blocks with `block`, `words` and `probe`: (block, ids: structs of first, places and packed ids), and the dictionary (word, id). Ids are dense from 0."""
    n = ranges(blocks, size)

    def cut(row: pa.RecordBatch, n: int) -> Iterator[tuple[int, bytes, dict[str, bytes]]]:
        words = row.column("words")[0].as_py()
        each = np.array(words.split(b"\n"), object)
        for i, places in split(word_places(words), n):
            yield i, packed(places), {"words": b"\n".join(each[places])}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "block", "places", "data", "n"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        out = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds, strict=True)], names)
        now, ids = None, {}
        for batch in batches:
            for own, block, places, words in zip(*(batch.column(c).to_pylist() for c in ("range", "block", "places", "words")), strict=True):
                if own != now:
                    if now is not None:
                        yield out(now, None, None, b"\n".join(ids), len(ids))
                    now, ids = own, {}
                found = [ids.setdefault(w, len(ids)) for w in words.split(b"\n")]
                yield out(own, block, places, packed(np.array(found)), None)
        if now is not None:
            yield out(now, None, None, b"\n".join(ids), len(ids))

    rows = dealt(blocks.select("block", "words").where("length(words) > 0"), n, cut, ["words"])
    # the order of blocks decides the numbers, so that a task that runs again gives the same ones
    done = written(rows.repartition(n, "range").sortWithinPartitions("range", "block").mapInArrow(number, "range int, block long, places binary, data binary, n long"), "numbers")
    whole = done.where("block is null")
    first = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first")  # a row a range
    starts = whole.select("range", "n").select("range", first)
    columns = done.where("block is not null").select("range", "block", "places", "data").join(F.broadcast(starts), "range")
    dictionary = whole.select("range", F.posexplode(F.split(F.col("data").cast("string"), "\n")).alias("at", "word")).join(F.broadcast(starts), "range")
    return columns.groupBy("block").agg(F.collect_list(F.struct("first", "places", "data")).alias("ids")), dictionary.select("word", (F.col("first") + F.col("at")).alias("id"))


def in_order(parts: list[dict], n: int) -> np.ndarray:
    """The numbers of a block's entries in the order of its dictionary, from what numbered() gives."""
    out = np.zeros(n, np.int64)
    for part in parts or []:
        out[unpacked(part["places"])] = unpacked(part["data"]) + part["first"]
    return out
