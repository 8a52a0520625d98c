"""N-gram Jaccard self-join by prefix filters under several token orders.

A text's set is its distinct word n-grams; two texts link when 100 * intersection >= 80 * union.
Under any total order of the tokens, linked sets share one of their first n - ceil(0.8 n) + 1 tokens. So each of
several orders is a filter that loses no link, and candidates must pass all of them before their
sets are fetched and compared. All orders put the tokens that are rare in the corpus first, in fine, coarse
and very coarse classes of their exact counts, and order a class by different hashes.

1. One scan turns texts into blocks: the distinct sets of a task's stretch of texts. A block's tokens
   travel as differences of 48 bits of their hashes, with the place of the text that has them, to the
   task of their range. A token that a block has more than once travels once, with its count, so
   a token of a third of all texts is one entry a block; its places go past the ranges to the block.
2. A range adds up its tokens' counts over all blocks and answers each block with the class of every token that
   two texts or more have. The others can't be shared and travel no further.
3. Texts with equal sets are one class, represented by its smallest id; one text of each class goes on.
   What is gathered of it are its shared tokens: with m of them and n in all, it has a link only if
   m >= 0.8 n. For those texts alone, sets and prefixes are written. The n - m others are first in every order,
   so a prefix needs only the m - ceil(0.8 n) + 1 shared tokens that follow.
4. Each prefix token's texts are held against a hub, the text with the fewest unshared tokens, where sizes
   and the places of the token in both orders allow a link: with i - 1 and j - 1 tokens before it the
   intersection is 1 + min(n - i, m - j) at most, if it is the first that they share.
5. Texts that share a prefix token and aren't connected by then are compared with one another, under the
   same conditions. What is connected needs no comparison, so n near copies cost about n comparisons.

Results for odd input: a text without words has no set and links with nothing; one of fewer words
than n has its whole sequence as its one token; a null text has no words; rows with equal ids are one
document whose texts count as linked; a null id belongs to the class of its set, and to no link beyond it;
a very long text is one piece, and one block; repeated rows are repeated in the result; other columns
aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.shared import dropped, written
from tidewatch.llm.words import mixed, ngram_hashes, pieces, word_hashes

WORDS, SIMILAR = 5, 80
#: Bits of a token's hash; two tokens of one pair of texts fall together with a chance of about n**2 / 2**48.
BITS = 48
#: Tokens of a block, and about how many tokens of all texts a range has.
BLOCK, RANGE = 1 << 20, 1 << 21
#: A hash for each order, and how many eighths of a doubling of counts are one class.
ORDERS = ((0x2545F4914F6CDD1D, 1), (0xD6E8FEB86659FD93, 16), (0xA0761D6478BD642F, 48))
TEXT, LISTS, TOKENS = 0, 1, 2
SENT = "part long, kind int, block long, place int, doc_id long, n long, digest string, keys binary, places binary, more binary, counts binary"
SETS = "doc_id long, n long, m long, tokens array<long>, first array<long>, second array<int>, third array<int>"


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and sets (ascending distinct hashes) of the texts, batch by batch."""
    for batch in pieces(batches, "text"):
        grams, ends = ngram_hashes(*word_hashes(batch.column("text")), n)
        yield batch.column("doc_id").to_pylist(), [np.unique(grams[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys: the first, then differences, of four bytes each if they fit."""
    steps = np.diff(keys)
    return keys[:1].tobytes() + steps.astype(np.uint32 if not len(steps) or int(steps.max()) < 1 << 32 else np.uint64).tobytes()


def _unstepped(data: bytes, n: int) -> np.ndarray:
    rest = np.frombuffer(data, np.uint32 if len(data) == 4 + 4 * n else np.uint64, offset=8) if n else ()
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, min(n, 1)), np.asarray(rest, np.uint64)]), dtype=np.uint64)


def _five(keys: np.ndarray) -> bytes:
    """Five bytes of each key: what a key has beyond its range."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SENT.split(", ")])


def _runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    starts = np.flatnonzero(np.concatenate(([True], ascending[1:] != ascending[:-1]))) if len(ascending) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(ascending)))


def _blocks(n: int, bits: int):
    """Rows of the texts, and the tokens of blocks by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, texts, held, place_of, size = TaskContext.get().partitionId() << 24, [], [], {}, 0
        spread = (1 << bits) - 1

        def block() -> Iterator[pa.RecordBatch]:
            # rows that no range needs go past the ranges' tasks, dealt evenly over them
            home = (number >> 24) + number
            yield _rows([((home + place) & spread, TEXT, number, place, doc_id, count, digest, *[None] * 4) for doc_id, place, count, digest in texts])
            if not held:
                return
            token, place = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint16), list(map(len, held)))
            order = np.argsort(token, kind="stable")
            token, place = token[order], place[order]
            starts, count = _runs(token)
            single = np.repeat(count == 1, count)
            more, counts = token[starts[count > 1]], count[count > 1].astype(np.uint16)
            if len(more):
                yield _rows([(home & spread, LISTS, number, None, None, len(more), None, _steps(more), place[~single].tobytes(), None, counts.tobytes())])
            token, place = token[single], place[single]
            begins = np.arange(1 << bits, dtype=np.uint64) << np.uint64(BITS - bits)
            one, two = (np.append(np.searchsorted(x, begins), len(x)) for x in (token, more))
            full = np.flatnonzero(np.diff(one) + np.diff(two)).tolist()
            rows = [(i, TOKENS, number, None, None, None, None, _steps(token[a:b]), place[a:b].tobytes(), _steps(more[c:d]), counts[c:d].tobytes()) for i, a, b, c, d in zip(full, one[full].tolist(), one[1:][full].tolist(), two[full].tolist(), two[1:][full].tolist(), strict=True)]
            for at in range(0, len(rows), 256):
                yield _rows(rows[at : at + 256])

        for ids, sets in _sets(batches, n):
            for doc_id, own in zip(ids, sets, strict=True):
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if len(own) else ""
                if digest and digest not in place_of:
                    place_of[digest] = len(held)
                    held.append(np.unique(own >> np.uint64(64 - BITS)))
                    size += len(own)
                texts.append((doc_id, place_of.get(digest, 0), len(own), digest))
                if size >= BLOCK or len(held) == (1 << 16) - 1 or len(texts) == 1 << 18:
                    yield from block()
                    number, texts, held, place_of, size = number + 1, [], [], {}, 0
        if texts:
            yield from block()

    return run


def _answered(bits: int):
    """Answers to the blocks, from rows in the order of their ranges; rows of texts and lists go past.

    An answer has the keys, places and classes of the tokens that one text of the block has and another text of the corpus, and
    the classes of those that several texts of the block have. Class 0 is a count of 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            ones = [_unstepped(keys, len(places) // 2) for _, keys, places, _, _ in held]
            twos = [_unstepped(more, len(counts) // 2) for *_, more, counts in held]
            weights = [np.frombuffer(counts, np.uint16).astype(np.int64) for *_, counts in held]
            keys = np.concatenate([*ones, *twos])
            weight = np.concatenate([np.ones(sum(map(len, ones)), np.int64), *weights])
            order = np.argsort(keys, kind="stable")
            starts, length = _runs(keys[order])
            found = np.minimum(8 * np.log2(np.add.reduceat(weight[order], starts)), 255).astype(np.uint8)
            code = np.empty(len(keys), np.uint8)
            code[order] = np.repeat(found, length)
            inner = np.uint64((1 << (BITS - bits)) - 1)
            rows, at, then = [], 0, sum(map(len, ones))
            for (block, _, places, _, _), one, two in zip(held, ones, twos, strict=True):
                own = code[at : at + len(one)]
                shared = own > 0
                if shared.any() or len(two):
                    rows.append((part, TOKENS, block, None, None, None, None, _five(one[shared] & inner), np.frombuffer(places, np.uint16)[shared].tobytes(), code[then : then + len(two)].tobytes(), own[shared].tobytes()))
                at, then = at + len(one), then + len(two)
            for i in range(0, len(rows), 512):
                yield _rows(rows[i : i + 512])

        for batch in batches:
            other = batch.filter(pc.not_equal(batch.column("kind"), TOKENS))
            if other.num_rows:
                yield other
            tokens = batch.filter(pc.equal(batch.column("kind"), TOKENS))
            for own, *row in zip(*(tokens.column(x).to_pylist() for x in ("part", "block", "keys", "places", "more", "counts")), strict=True):
                if own != part:
                    if held:
                        yield from closed()
                    part, held = own, []
                held.append(row)
        if held:
            yield from closed()

    return run


def _gathered(bits: int, similar: int):
    """SETS of the texts that may have a link, from rows in the order of their blocks and ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, texts, lists, answers = None, [], None, []

        def closed() -> Iterator[pa.RecordBatch]:
            if not texts or not answers and lists is None:
                return
            token = [_unfive(keys) + (np.uint64(part) << np.uint64(BITS - bits)) for part, keys, *_ in answers]
            place = [np.frombuffer(places, np.uint16) for *_, places, _, _ in answers]
            code = [np.frombuffer(counts, np.uint8) for *_, counts in answers]
            if lists is not None:
                n, keys, places, counts = lists
                each = np.frombuffer(counts, np.uint16)
                token.append(np.repeat(_unstepped(keys, n), each))
                place.append(np.frombuffer(places, np.uint16))
                code.append(np.repeat(np.concatenate([np.frombuffer(more, np.uint8) for *_, more, _ in answers]), each))
            token, place, code = map(np.concatenate, (token, place, code))
            shared = np.bincount(place, minlength=1 << 16)
            wanted = {at: (doc_id, n) for at, doc_id, n in texts if shared[at] >= -(-similar * n // 100)}
            open_ = np.zeros(1 << 16, bool)
            open_[list(wanted)] = True
            take = open_[place]
            token, place, code = token[take], place[take], code[take]
            order = np.lexsort((token, place))
            token, place, code = token[order], place[order], code[order].astype(np.uint64)
            keys = [(code // np.uint64(step)) << np.uint64(56) | mixed(token * np.uint64(seed)) >> np.uint64(8) for seed, step in ORDERS]
            starts, length = _runs(place)
            rows = []
            for a, m in zip(starts.tolist(), length.tolist(), strict=True):
                doc_id, n = wanted[int(place[a])]
                own, most = token[a : a + m], m + (similar * -n // 100) + 1
                first, second, third = (own[np.argsort(x[a : a + m], kind="stable")[:most]] for x in keys)
                rows.append((doc_id, n, m, own.view(np.int64), first.view(np.int64), *(x.astype(np.uint32).view(np.int32) for x in (second, third))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows[at : at + 256], strict=True), kinds, strict=True)], [c.split()[0] for c in SETS.split(", ")])

        for batch in batches:
            for own, kind, part, place, doc_id, n, keys, places, more, counts in zip(*(batch.column(x).to_pylist() for x in ("block", "kind", "part", "place", "doc_id", "n", "keys", "places", "more", "counts")), strict=True):
                if own != block:
                    yield from closed()
                    block, texts, lists, answers = own, [], None, []
                if kind == TEXT:
                    texts.append((place, doc_id, n))
                elif kind == LISTS:
                    lists = (n, keys, places, counts)
                else:
                    answers.append((part, keys, places, more, counts))
        yield from closed()

    return run


def _allowed(x: tuple[Column, Column], y: tuple[Column, Column], similar: int) -> Column:
    """Whether sets of these sizes whose first shared token is at these places (1 is the first) may link."""
    (n, i), (m, j) = x, y
    return (F.least(n - i, m - j) + 1) * (100 + similar) >= (n + m) * similar


def _verified(pairs: DataFrame, sets: DataFrame, similar: int, name: str) -> DataFrame:
    """The links among pairs (a, b): the other orders' filters first, then the whole sets of those that pass."""
    side = lambda x, cols: sets.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))
    passed = pairs.join(side("b", ["second", "third"]), "b").join(side("a", ["second", "third"]), "a")
    passed = written(passed.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b"), f"{name}-passed")
    both = passed.join(side("b", ["n", "tokens"]), "b").join(side("a", ["n", "tokens"]), "a")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    links = written(both.where(common * (100 + similar) >= (F.col("n_a") + F.col("n_b")) * similar).select("a", "b"), f"{name}-links")
    dropped(passed)
    return links


def linked(df: DataFrame, words: int = WORDS, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word takes some seven bytes
    bits = max(8, math.ceil(math.log2(max(1, size / 7 / RANGE))))
    sent = docs.mapInArrow(_blocks(words, bits), SENT).repartition("part").sortWithinPartitions("part")
    sent = written(sent.mapInArrow(_answered(bits), SENT), "tokens")

    texts = sent.where(F.col("kind") == TEXT).select("doc_id", "n", "digest", F.struct("block", "place").alias("at"))
    classes = texts.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("at").alias("at"), F.first("n").alias("n"))
    classes = written(classes, "classes")
    texts = written(texts.join(classes.select("digest", "rep"), "digest", "left").select("doc_id", "n", "rep"), "texts")
    chosen = classes.where("rep is not null").select(F.lit(0).cast("long").alias("part"), F.lit(TEXT).alias("kind"), "at.block", "at.place", F.col("rep").alias("doc_id"), "n", *(F.lit(None).cast("binary").alias(c) for c in ("keys", "places", "more", "counts")))
    rows = sent.where(F.col("kind") != TEXT).select(chosen.columns).unionByName(chosen)
    sets = written(rows.repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(_gathered(bits, similar), SETS), "sets")
    dropped(sent, classes)

    posted = sets.select("doc_id", "n", "m", F.posexplode("first").alias("at", "token")).select("token", "doc_id", "n", (F.col("n") - F.col("m") + F.col("at") + 1).alias("place"), (F.col("n") - F.col("m")).alias("own"))
    posted = written(posted, "postings")
    hubs = posted.groupBy("token").agg(F.min(F.struct("own", "n", "doc_id", "place")).alias("hub"), F.count(F.lit(1)).alias("texts")).where("texts > 1").select("token", "hub")
    first = posted.join(hubs, "token").where((F.col("doc_id") != F.col("hub.doc_id")) & _allowed((F.col("n"), F.col("place")), (F.col("hub.n"), F.col("hub.place")), similar))
    first = written(first.select(F.greatest("doc_id", "hub.doc_id").alias("a"), F.least("doc_id", "hub.doc_id").alias("b")).distinct(), "hubpairs")
    links = _verified(first, sets, similar, "hub")

    labels = components(links)
    placed = posted.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("token", "doc_id", "n", "place", F.coalesce("component", "doc_id").alias("part"))
    groups = placed.groupBy("token", "part").agg(F.count(F.lit(1)).alias("texts")).groupBy("token").agg(F.max_by("part", F.struct("texts", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
    apart = written(placed.join(groups.where("parts > 1").select("token", "main"), "token"), "open")
    x = apart.where("part <> main").select("token", *(F.col(c).alias(f"{c}_x") for c in ("doc_id", "n", "place", "part")))
    met = x.join(apart, "token").where((F.col("part_x") != F.col("part")) & ((F.col("part") == F.col("main")) | (F.col("doc_id_x") < F.col("doc_id"))) & _allowed((F.col("n_x"), F.col("place_x")), (F.col("n"), F.col("place")), similar))
    second = met.select(F.greatest("doc_id_x", "doc_id").alias("a"), F.least("doc_id_x", "doc_id").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = _verified(written(second, "pairs"), sets, similar, "open")
    # rows that share an id are linked by it
    repeated = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.collect_set("rep").alias("reps")).where("rows > 1").select(F.col("doc_id").alias("a"), F.explode("reps").alias("b"))
    found = components(links.unionByName(more).unionByName(repeated))
    dropped(sets, posted, first, links, labels, apart, more)

    out = texts.withColumn("id", F.coalesce("rep", "doc_id")).join(found, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def deduplicated(df: DataFrame, words: int = WORDS, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows but for the texts that are linked to one of a smaller id; of rows with equal ids and sets all stay."""
    stay = linked(df, words, similar, id_col, text_col).where("doc_id <=> component_id").select(F.col("doc_id").alias("__tw_id")).distinct()
    return df.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("__tw_id")), "left_semi")
