"""Near copies of vectors by sorted projection passes.

A pass draws random hyperplanes and gives every vector the bits of the sides it lies on, one after the
other, as a number. Vectors in the order of these numbers are compared with their neighbours, 128 to 255 before them and
as many after; links of cosine `least` or more are verified in double precision there. Each pass has other
hyperplanes, and their number follows from the number of vectors, so that a pair at the threshold itself becomes neighbours in
one pass at least with probability `recall`, and nearer pairs oftener: both share the first log2(n / 128) bits of a pass with
probability (1 - angle / pi) to that power. Passes grow with n to the power .15 at a cosine of 0.95.

A window names one root for all that it links, not each pair, and components of these links are the groups. Within a group links
are then counted by comparing all of its different vectors tile by tile, which takes the square of a group's different vectors
in arithmetic, but writes a count a vector and tile. Equal vectors are one vector with a weight from the start.

Results for odd input: a vector that is null, empty or zero, or holds a null, NaN or infinite component links with nothing and is a component
by itself; vectors of unlike lengths aren't compared; rows that repeat an id are vectors of their own, which link by what they hold; a component's
id is its smallest vec_id, rows without an id have none to offer, and one that links with none has a null component and isn't kept;
of several rows with the smallest id all are kept; an empty table has no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.shared import dropped, written

LEAST, RECALL = 0.95, 0.999
#: Rows a window step: a vector meets this many neighbours at each side at least.
WINDOW = 128
#: Different vectors of one group that are compared with as many others at a time.
TILE = 1024
BITS = 62
#: Passes whose keys are sorted in one job.
AT_ONCE = 8
SEED = 20240


def passes_for(n: int, least: float = LEAST, recall: float = RECALL, window: int = WINDOW) -> int:
    """Passes after which a pair of cosine `least` has been neighbours with probability `recall`."""
    same = (1 - math.acos(least) / math.pi) ** min(BITS, max(1.0, math.log2(max(n, 1) / window)))
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def units(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length (bytes of doubles) as rows of length 1."""
    x = np.frombuffer(b"".join(vectors.to_pylist()), np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row of its component."""
    own = np.arange(len(linked))
    while True:
        nearest = np.minimum(own, np.where(linked, own[None, :], len(own)).min(axis=1))
        nearest = nearest[nearest]
        if (nearest == own).all():
            return own
        own = nearest


def weighted(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, h, g: two hashes of a vector that counts, else null), and the different vectors: cid, h, g, vec_id (smallest), n, size, vec."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), x).alias("vec"))
    key = lambda seed: F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(seed), F.col("vec")))
    rows = written(rows.select("vec_id", key(1).alias("h"), key(2).alias("g"), "vec"), "vectors")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            ends = np.cumsum(np.concatenate(([0], lists.value_lengths().to_numpy(zero_copy_only=False))))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            data = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield batch.set_column(batch.schema.get_field_index("vec"), "vec", pa.array(data, pa.binary()))

    # the place within the table, once it is written, is the class's number
    groups = rows.where("h is not null").groupBy("h", "g").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    groups = groups.select(F.monotonically_increasing_id().alias("cid"), "h", "g", "vec_id", "n", F.size("vec").alias("size"), "vec")
    return rows, written(groups.mapInArrow(packed, "cid long, h long, g long, vec_id long, n long, size int, vec binary"), "classes")


def keyed(classes: DataFrame, passes: range) -> DataFrame:
    """nth, size, key, cid, vec: each vector once a pass, with the pass's bits as a number."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                x = units(own.column("vec"))
                for nth in passes:
                    if (size, nth) not in planes:
                        planes[size, nth] = np.random.default_rng([SEED, int(size), nth]).standard_normal((int(size), BITS))
                    key = ((x @ planes[size, nth] > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).astype(np.int64)
                    numbers = np.full(len(key), nth, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers), own.column("size"), pa.array(key), own.column("cid"), own.column("vec")], ["nth", "size", "key", "cid", "vec"])

    return classes.select("cid", "size", "vec").mapInArrow(project, "nth int, size int, key long, cid long, vec binary")


OUT = "boundary long, nth int, size int, cid long, root long, vec binary"
OUT_SCHEMA = pa.schema([("boundary", pa.int64()), ("nth", pa.int32()), ("size", pa.int32()), ("cid", pa.int64()), ("root", pa.int64()), ("vec", pa.binary())])


def _found(nth: np.ndarray, size: int, cid: np.ndarray, x: np.ndarray, new: int, least: float) -> pa.RecordBatch | None:
    """Links (cid, root) among rows of one length, of which those from `new` on haven't been compared yet."""
    close = np.zeros((len(x), len(x)), bool)
    close[new:] = (x[new:] @ x.T >= least) & (nth[new:, None] == nth[None, :])
    close |= close.T
    np.fill_diagonal(close, False)
    if not close.any():
        return None
    root = roots(close)
    some = np.flatnonzero(root != np.arange(len(root)))
    none = pa.nulls(len(some))
    return pa.RecordBatch.from_arrays([none.cast(pa.int64()), pa.array(nth[some], pa.int32()), pa.array(np.full(len(some), size), pa.int32()), pa.array(cid[some]), pa.array(cid[root[some]]), none.cast(pa.binary())], schema=OUT_SCHEMA)


def _edge(boundary: int, rows: pa.Table) -> pa.RecordBatch:
    combined = rows.combine_chunks()
    none = pa.nulls(rows.num_rows, pa.int64())
    column = lambda c: combined.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type)
    return pa.RecordBatch.from_arrays([pa.array([boundary] * rows.num_rows, pa.int64()), column("nth"), column("size"), column("cid"), none, column("vec")], schema=OUT_SCHEMA)


def _windows(least: float, window: int):
    """For sorted rows: links within the window, and the first and last rows of the task, which meet the neighbouring task's later."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        before, head, seen, waiting = None, 0, None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if head < window and rows.num_rows:
                yield _edge(task - 1, rows.slice(0, window - head))
                head += min(window - head, rows.num_rows)
            waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
            while waiting.num_rows >= window:
                tile, waiting = waiting.slice(0, window), waiting.slice(window)
                yield from _steps(before, tile, least)
                before = tile
        if waiting is not None:
            if waiting.num_rows:
                yield from _steps(before, waiting, least)
            seen = waiting if before is None else pa.concat_tables([before, waiting])
            yield _edge(task, seen.slice(max(0, seen.num_rows - window)))

    return compare


def _steps(before: pa.Table | None, tile: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """Links of a tile of rows with each other and with those of the tile before."""
    rows = tile if before is None else pa.concat_tables([before, tile])
    new = rows.num_rows - tile.num_rows
    sizes, nth, cid = (rows.column(c).to_numpy() for c in ("size", "nth", "cid"))
    for size in np.unique(sizes[new:]):
        own = np.flatnonzero(sizes == size)
        found = _found(nth[own], int(size), cid[own], units(rows.column("vec").take(pa.array(own)).combine_chunks()), int((own < new).sum()), least)
        if found is not None:
            yield found


def _across(least: float):
    """Links between the last rows of a task and the first of the next."""

    def compare(edge: pa.Table) -> pa.Table:
        found = list(_steps(None, edge, least))
        return pa.Table.from_batches(found, OUT_SCHEMA).select(["cid", "root"])

    return compare


def candidate_links(classes: DataFrame, least: float = LEAST, recall: float = RECALL, window: int = WINDOW) -> DataFrame:
    """a, b of the roots that the windows of all passes found, each verified link by link, as a written table."""
    n = classes.count()
    total, found = passes_for(n, least, recall, window), None
    for first in range(0, total, AT_ONCE):
        passes = range(first, min(total, first + AT_ONCE))
        parts = max(1, min(n * len(passes) // (8 * window), 8 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), n * len(passes) // 2_000_000)
        order = ["nth", "size", "key", "cid"]
        rows = keyed(classes, passes).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        out = written(rows.mapInArrow(_windows(least, window), OUT), "windows")
        # a boundary has the last rows of one task and the first of the next: 2 * window at most
        edges = out.where("boundary is not null").groupBy("boundary").applyInArrow(_across(least), "cid long, root long")
        links = written(out.where("boundary is null").select("cid", "root").unionByName(edges).select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct(), "near")
        dropped(out)
        found = links if found is None else found.unionByName(links)
    return found


def link_counts(members: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """cid, links: rows of other vectors of the same component (comp, cid, n, size, vec) that a vector is linked with."""
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    rows = members.join(sizes, "comp").withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    tiles = rows.groupBy("comp", "tile", "tiles").agg(F.collect_list(F.struct("cid", "n", "vec")).alias("rows"))
    left = tiles.select("comp", F.col("tile").alias("t"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("u"), F.col("rows").alias("a"))
    right = tiles.where("tiles > 1 and tile > 0").select("comp", F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("t"), F.col("tile").alias("u"), F.col("rows").alias("b"))
    met = left.join(right, ["comp", "t", "u"], "left")

    def columns(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = rows.flatten()
        return flat.field("cid").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False), units(flat.field("vec"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                cid, n, x = columns(row.column("a"))
                if row.column("b").null_count:
                    found = [(cid, ((x @ x.T >= least) & ~np.eye(len(x), dtype=bool)) @ n)]
                else:
                    other, m, y = columns(row.column("b"))
                    close = x @ y.T >= least
                    found = [(cid, close @ m), (other, n @ close)]
                for ids, links in found:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64))], ["cid", "links"])

    spread = met.where("t < u or b is null").select("a", "b")
    return spread.mapInArrow(count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """A row a row of vectors: vec_id, n_links (others that are linked directly), component_id (smallest vec_id reachable), kept."""
    rows, classes = weighted(vectors, id_col, vector_col)
    comps = components(candidate_links(classes, least, recall)).select(F.col("id").alias("cid"), F.col("component").alias("comp"))
    members = written(classes.join(comps, "cid"), "members")
    names = members.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    known = members.select("cid", "comp").join(names, "comp").join(link_counts(members, least), "cid").select("cid", "component_id", "links")
    results = classes.select("cid", "h", "g", "vec_id", "n").join(known, "cid", "left")
    results = results.select("h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", F.col("vec_id")).alias("component_id"))
    out = rows.select("vec_id", "h", "g").join(written(results, "results"), ["h", "g"], "left")
    # a row that links with nothing is its own component
    component = F.when(F.coalesce("n_links", F.lit(0)) == 0, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
