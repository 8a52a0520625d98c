"""Exact dedup of texts over a cuckoo-filter index.

Texts are equal when they are identical after every run of 0x20 and 0x09-0x0D is replaced by one
space; a null text counts as empty. Each text becomes its SHA-256 in one scan. Every task first
runs its own rows through an index and passes on one row for each digest that it holds, so a
group of copies, however large, reaches the shuffle as one row a task. The rows then go by
the digest's first hex digits to one index for each such bucket.
An index asks its cuckoo filter first: a miss is a new digest, a hit is verified against the
digests stored in that bucket (so a false positive costs a comparison, never a wrong answer),
and an overflowing filter is rebuilt at twice the size from the stored digests.

Results for odd input: null and empty texts form one group; rows that repeat both doc_id and
text are numbered and only the first is kept; an empty table gives an empty result; other columns
are neither read nor returned by `exact_groups`, and returned as they are by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import written

SLOTS = 4
KICKS = 200
#: Hex digits of a digest that name its bucket: 16**4 indexes, each held by one task at a time.
BUCKET_DIGITS = 4
SPACE_RUN = r"[\x20\x09-\x0D]+"


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each digest at one of two places; insert says False on overflow."""

    def __init__(self, places: int = 256) -> None:
        self.mask = (1 << max(1, (places - 1).bit_length())) - 1
        self.rows: list[list[int]] = [[] for _ in range(self.mask + 1)]
        self.turn = 0

    def _at(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[10:18], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ ((mark * 0x5BD1E995 >> 3) & self.mask)

    def __contains__(self, digest: bytes) -> bool:
        mark, one, two = self._at(digest)
        return mark in self.rows[one] or mark in self.rows[two]

    def insert(self, digest: bytes) -> bool:
        mark, one, two = self._at(digest)
        for place in (one, two):
            if len(self.rows[place]) < SLOTS:
                self.rows[place].append(mark)
                return True
        place = one
        for _ in range(KICKS):
            self.turn = (self.turn + 1) % SLOTS
            mark, self.rows[place][self.turn] = self.rows[place][self.turn], mark
            place = self._other(place, mark)
            if len(self.rows[place]) < SLOTS:
                self.rows[place].append(mark)
                return True
        return False

    def delete(self, digest: bytes) -> None:
        mark, one, two = self._at(digest)
        self.rows[one if mark in self.rows[one] else two].remove(mark)


class CuckooIndex:
    """Live digests with a value each: a cuckoo filter in front of the stored digests it verifies against."""

    def __init__(self, places: int = 256) -> None:
        self.filter = CuckooFilter(places)
        self.stored: dict[bytes, list] = {}

    def get(self, digest: bytes) -> list | None:
        return self.stored.get(digest) if digest in self.filter else None

    def put(self, digest: bytes, value: list) -> None:
        self.stored[digest] = value
        if not self.filter.insert(digest):
            self.resize()

    def remove(self, digest: bytes) -> bool:
        if self.get(digest) is None:
            return False
        self.filter.delete(digest)
        del self.stored[digest]
        return True

    def resize(self) -> None:
        """A filter of twice the size, or larger, from the stored digests."""
        places = 2 * (self.filter.mask + 1)
        while True:
            self.filter = CuckooFilter(places)
            if all(map(self.filter.insert, self.stored)):
                return
            places *= 2


def normalised_sha256(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with each white-space run as one space; a null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ").cast("binary"), 256)


def _emitted(index: CuckooIndex) -> pa.RecordBatch:
    rows = index.stored
    return pa.record_batch([pa.array(map(bytes.hex, rows), pa.string()), pa.array((v[0] for v in rows.values()), pa.int64()), pa.array((v[1] for v in rows.values()), pa.int64())], ["text_sha256", "keep_id", "group_size"])


def _merge(index: CuckooIndex, digests: list, ids: list, counts: list) -> None:
    for digest, doc_id, n in zip(map(bytes.fromhex, digests), ids, counts, strict=True):
        live = index.get(digest)
        if live is None:
            index.put(digest, [doc_id, n])
        else:
            if doc_id is not None and (live[0] is None or doc_id < live[0]):
                live[0] = doc_id
            live[1] += n


#: Digests after which a task passes on what its own index holds and begins another.
LOCAL_DIGESTS = 200_000


def _within_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex(1024)
    for batch in batches:
        _merge(index, *(batch.column(x).to_pylist() for x in ("text_sha256", "doc_id", "n")))
        if len(index.stored) >= LOCAL_DIGESTS:
            yield _emitted(index)
            index = CuckooIndex(1024)
    yield _emitted(index)


def _within_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their buckets; one index is held at a time."""
    index, bucket = CuckooIndex(), None
    for batch in batches:
        digests, ids, counts = (batch.column(x).to_pylist() for x in ("text_sha256", "keep_id", "group_size"))
        at = 0
        while at < len(digests):
            if digests[at][:BUCKET_DIGITS] != bucket:
                if bucket is not None:
                    yield _emitted(index)
                index, bucket = CuckooIndex(), digests[at][:BUCKET_DIGITS]
            end = at
            while end < len(digests) and digests[end][:BUCKET_DIGITS] == bucket:
                end += 1
            _merge(index, digests[at:end], ids[at:end], counts[at:end])
            at = end
    if bucket is not None:
        yield _emitted(index)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, keep_id (smallest id of the equal texts), group_size, kept, text_sha256.

    doc_id null: such rows are in their text's group, and are kept only where no row of it has an id.
    """
    digests = df.select(F.col(id_col).cast("long").alias("doc_id"), normalised_sha256(F.col(text_col)).alias("text_sha256"))
    # rows that repeat id and text are one row with a count from here on
    rows = written(digests.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")), "digests")
    live = "text_sha256 string, keep_id long, group_size long"
    bucket = F.substring("text_sha256", 1, BUCKET_DIGITS)
    groups = rows.mapInArrow(_within_task, live).repartition(bucket).sortWithinPartitions(bucket).mapInArrow(_within_bucket, live)
    out = rows.join(groups, "text_sha256").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows that stay, with df's columns: of equal texts the one with the smallest id."""
    kept = exact_groups(df, id_col, text_col).where("kept").select(F.col("doc_id").alias("__tw_id"), F.col("text_sha256").alias("__tw_sha"))
    own = df.withColumn("__tw_sha", normalised_sha256(F.col(text_col)))
    rows = own.join(kept.withColumnRenamed("__tw_sha", "__tw_kept"), F.col(id_col).cast("long").eqNullSafe(F.col("__tw_id")) & (F.col("__tw_sha") == F.col("__tw_kept")), "left_semi")
    repeated = df.groupBy(id_col).count().where("count > 1")
    if not repeated.isEmpty():
        rows = rows.dropDuplicates([id_col, "__tw_sha"])
    return rows.drop("__tw_sha")


def update_index(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The live digests after inserts and deletes.

    index: text_sha256, live (rows that have that text). changes: text_sha256, delta (+1 an insert,
    -1 a delete). Returns text_sha256, live, first (true where the digest was not live before);
    digests without live rows are gone. A delete of a digest that isn't live has no effect.
    """
    bucket = F.substring("text_sha256", 1, BUCKET_DIGITS)
    rows = index.select("text_sha256", F.col("live").cast("long").alias("n"), F.lit(0).alias("turn")).unionByName(
        changes.groupBy("text_sha256").agg(F.sum(F.col("delta").cast("long")).alias("n")).withColumn("turn", F.lit(1))
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, name = CuckooIndex(), None

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(map(bytes.hex, live.stored), pa.string()), pa.array((v[0] for v in live.stored.values()), pa.int64()), pa.array((v[1] for v in live.stored.values()), pa.bool_())], ["text_sha256", "live", "first"])

        for batch in batches:
            for digest, n, turn in zip(*(batch.column(x).to_pylist() for x in ("text_sha256", "n", "turn")), strict=True):
                if digest[:BUCKET_DIGITS] != name:
                    if name is not None:
                        yield out()
                    live, name = CuckooIndex(), digest[:BUCKET_DIGITS]
                key = bytes.fromhex(digest)
                have = live.get(key)
                if have is not None and have[0] + n > 0:
                    have[0] += n
                elif have is not None:
                    live.remove(key)
                elif n > 0:
                    live.put(key, [n, bool(turn)])
        if name is not None:
            yield out()

    return rows.where("text_sha256 is not null").repartition(bucket).sortWithinPartitions(bucket, "turn").mapInArrow(apply, "text_sha256 string, live long, first boolean")
