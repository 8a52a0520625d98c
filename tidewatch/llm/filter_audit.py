"""What five filters remove alone and after each other, in every order of application.

Words are numbered over the whole corpus, and documents become shards of a sparse document-term matrix
over these numbers. A row's sum is a document's words, the row's entries are its distinct words; they decide filters A
and B. C and D are read from the text, E from the digests of all texts; then documents count by part, failed filters and label.
A part has at most 2**5 * 4 such counts, and the figures of all orders come from these.

Results for odd input: a null or empty text has no words, fails A and is a copy of the other empty ones; a null language is the
part ''; a document without an id is no copy, and no other is a copy of it; of rows with one id and text none is a copy of
the other; labels that repeat an id count as one, good or toxic where any is; documents without labels are neither;
very long texts are a block each; columns other than doc_id, text and lang (doc_id, quality and toxic of labels) aren't read, whatever
their names; an empty table has no parts, hence no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.blocks import BLOCK, counted, in_order, listed, numbered, packed, probed, row_sums, slices, unpacked, word_places
from tidewatch.llm.shared import written
from tidewatch.llm.words import text_bytes

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 100, 80, 10
#: Characters that fail filter D: fixed values.
MARKS = "#$%&*|"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]

DOCUMENT = {"doc_id": "long", "part": "string", "digest": "binary", "upper": "boolean", "marked": "boolean"}
KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
#: A matrix: where rows begin, columns (64 bits once they are the corpus's numbers), counts.
MATRIX = ["indptr", "indices", "data"]
UPPER, MARKED, LATER = (np.zeros(256, bool) for _ in range(3))
UPPER[ord("A") : ord("Z") + 1] = True
MARKED[list(MARKS.encode())] = True
LATER[0x80:0xC0] = True  # bytes that go on a code point


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


LISTS = {"block": "long", **{k: f"array<{v}>" for k, v in DOCUMENT.items()}, **dict.fromkeys(MATRIX, "binary")}


def read_texts(texts: pa.Array) -> dict[str, pa.Array]:
    """What filters read of texts beside their words: digest, upper, marked."""
    data, offsets = text_bytes(texts)
    per = lambda flags: row_sums(offsets, flags[data])
    upper = 100 * per(UPPER) > MOST_UPPER * (np.diff(offsets) - per(LATER))
    raw = data.tobytes()
    digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return {"digest": pa.array(digests, pa.binary()), "upper": pa.array(upper), "marked": pa.array(per(MARKED) > 0)}


def term_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of documents (doc_id, part, text) with their matrix over the block's own words, as a written table."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in slices(batches, "text", block):
            # splits at \x20 and \x09 to \x0D; leading and trailing ones leave empty words
            split = pc.ascii_split_whitespace(rows.column("text"))
            words, parents = pc.list_flatten(split), pc.list_parent_indices(split)
            filled = pc.greater(pc.binary_length(words), 0)
            found = words.filter(filled).dictionary_encode()
            parent = parents.filter(filled).to_numpy(zero_copy_only=False)
            matrix = counted(parent, found.indices.to_numpy(zero_copy_only=False), rows.num_rows, len(found.dictionary))
            joined = "\n".join(found.dictionary.to_pylist()).encode()
            read = {"doc_id": rows.column("doc_id"), "part": rows.column("part"), **read_texts(rows.column("text"))}
            columns = [listed(read[c], KINDS[kind]) for c, kind in DOCUMENT.items()] + [pa.array([x], pa.binary()) for x in (*map(packed, matrix), joined)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns, probed(word_places(joined))], [*LISTS, "words", "probe"])

    return written(docs.mapInArrow(build, _schema({**LISTS, "words": "binary", "probe": "array<long>"})), "terms")


def shards(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matrix with numbers of all words of the corpus, a row a block, and the dictionary (word, id)."""
    ids, dictionary = numbered(blocks)

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                local, parts = unpacked(row.column("indices")[0].as_py()), row.column("ids")[0].as_py()
                columns = in_order(parts, int(local.max()) + 1 if len(local) else 0)[local]
                yield row.set_column(row.schema.get_field_index("indices"), "indices", pa.array([packed(columns, 8)], pa.binary())).drop_columns(["ids"])

    return written(blocks.select(*LISTS).join(ids, "block", "left").select(*LISTS, "ids").mapInArrow(renumber, _schema(LISTS)), "shards"), dictionary


def word_counts(shard_rows: DataFrame) -> DataFrame:
    """The documents of the shards with words (the row's sum) and distinct (its entries)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                indptr, data = (unpacked(row.column(c)[0].as_py()) for c in ("indptr", "data"))
                sums = [pa.array(x, pa.int64()) for x in (row_sums(indptr, data), np.diff(indptr))]
                yield pa.RecordBatch.from_arrays([*(pc.list_flatten(row.column(c)) for c in DOCUMENT), *sums], [*DOCUMENT, "words", "distinct"])

    return shard_rows.select(*DOCUMENT, "indptr", "data").mapInArrow(count, _schema({**DOCUMENT, "words": "long", "distinct": "long"}))


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, part and text of documents, nulls replaced."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: fails the i-th filter), good, toxic, n: documents counted by what they fail.

    Filters A to D are the same for equal texts, so copies are told from first rows by counts: rows of one text are grouped
    with their ids first, which deals a large group of copies over all tasks, and then without.
    """
    any_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)) == 1
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(any_one("quality").alias("good"), any_one("toxic").alias("toxic"))
    a, b = F.col("words") < LEAST_WORDS, 100 * F.col("distinct") < LEAST_DISTINCT * F.col("words")
    bits = sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate((a, b, F.col("upper"), F.col("marked"))))
    rows = documents.select("doc_id", "part", "digest", bits.alias("mask")).join(known, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    group = ["digest", "part", "mask", "good", "toxic"]
    ids = rows.groupBy(*group, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    sums = ids.groupBy(*group).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    first = F.min("least.doc_id").over(W.partitionBy("digest"))  # a row a part and label
    sums = sums.withColumn("own", F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("own").alias("k")), F.struct((F.col("mask") + copy).alias("m"), (F.col("n") - F.col("own")).alias("k")))).alias("x")
    return sums.select("part", "good", "toxic", both).groupBy("part", F.col("x.m").alias("mask"), "good", "toxic").agg(F.sum("x.k").alias("n")).where("n > 0")


def interactions(counts: DataFrame) -> DataFrame:
    """Figures of each part, order and step from the counts of failures()."""
    places = [(order, step) for order in ORDERS for step in range(len(FILTERS))]
    own = [1 << FILTERS.index(order[step]) for order, step in places]
    before = [sum(1 << FILTERS.index(x) for x in order[:step]) for order, step in places]
    at = lambda values: F.element_at(F.lit(values), F.col("k") + 1)
    rows = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(places) - 1)))).withColumns({"own": at(own), "before": at(before)})
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~gone

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    out = rows.groupBy("part", "k", "own").agg(
        total(~gone & ~fails).alias("kept"), total(here).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"),
    )
    out = out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "own")))  # 120 rows a part and filter
    steps = len(FILTERS)
    order = F.element_at(F.lit(ORDERS), F.floor(F.col("k") / steps).cast("int") + 1)
    return out.select("part", order.alias("filter_order"), (F.col("k") % steps + 1).alias("step"), *(F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    matrix, _ = shards(term_blocks(prepared(docs)))
    return interactions(failures(word_counts(matrix), labels))
