"""Interpolated modified Kneser-Ney trigram model, counted in Spark and memory-mapped by workers.

Words become 64-bit hashes. Tasks add up the words of chunks of text; the shuffle brings each range
of hashes to one task, which writes the vocabulary's sorted hash array for that range; a word's id is
its place in all ranges. Trigrams u v w are counted the same way, by their bigram: a chunk's distinct keys (id of v *
V + id of w) travel as differences, each with its distinct u and their counts; each range of keys (of about equal mass, so a
frequent v is several ranges) is merged by one task and written as a sorted key array with the sorted u of each key, whose
number is the bigram's own count. One more shuffle adds up what words and pairs are as contexts. All
files are below one shared folder, and every worker maps them: the model takes page cache, not heap.

p(w | u v) = max(c(u v w) - D(c), 0) / c(u v) + (D1 N1(u v) + D2 N2(u v) + D3 N3+(u v)) / c(u v) * p(w | v), where p(w | v) is the
same discounting of the number of u that v w follows, and p(w) that of the number of v that w follows, interpolated with
1 / (V + 1) for each word and all unknown ones together. Every text ends with an end token, two of which are also the
context of its first word. All words and trigrams of the training texts count; nothing is pruned.

Results for odd input: a null text is empty and has the end token only; without training texts every
token has probability 1; rows with equal ids are separate texts; a very long text is one piece; columns of the
input that are named like results are replaced; other columns aren't read; an empty table gives an empty result; 2**32
distinct words or more raise an error. The distinct u of one bigram, which the vocabulary bounds, are in one task.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import exists, mapped, put, shared_folder, written
from tidewatch.llm.words import mixed, pieces, word_hashes

#: Tokens that a task adds up before it passes them on, and about how many distinct keys a range has.
CHUNK, RANGE = 1 << 21, 2_000_000
#: Ranges of hashes are 2**BITS at least, and more where a range would hold more than WORDS words of text.
BITS, WORDS = 6, 1 << 23
#: Keys of a range for which one number says where their words begin.
BLOCK = 8
END = mixed(np.array([0x454E44], np.uint64))[0]


def _dense(data: bytes, width: int) -> bytes:
    """Numbers of `width` bytes, compressed by planes: all lowest bytes, then the next ones; high bytes are mostly zero."""
    return zstandard.compress(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, width).T).tobytes(), 1)


def _loose(data: bytes, width: int) -> bytes:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T).tobytes()


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and compressed differences, of four bytes each if they fit; a byte says how many."""
    steps = np.diff(keys)
    kind = np.dtype(np.uint32 if len(keys) < 2 or int(steps.max()) < 1 << 32 else np.uint64)
    return keys[:1].tobytes() + bytes([kind.itemsize]) + _dense(steps.astype(kind).tobytes(), kind.itemsize)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(_loose(data[9:], data[8]), f"u{data[8]}").astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), steps]), dtype=np.uint64)


def _small(counts: np.ndarray) -> np.ndarray:
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


ADDED = "part int, n long, keys binary, counts binary"


def _sent(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """A row for each range of ascending keys that has any; bounds: where ranges begin, but for the first."""
    edges = np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))
    full = np.flatnonzero(np.diff(edges))
    cut = [slice(edges[i], edges[i + 1]) for i in full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([x.stop - x.start for x in cut], pa.int64()), pa.array([_packed(keys[x]) for x in cut], pa.binary()), pa.array([_small(counts[x]).tobytes() for x in cut], pa.binary())], ["part", "n", "keys", "counts"])


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each, and the offsets of each text's tokens."""
    words, offsets = word_hashes(texts)
    return np.insert(words, offsets[1:], END), offsets + np.arange(len(offsets))


def _added(keys_of, bounds: np.ndarray):
    """Chunks' sums of what keys_of() makes of batches, by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces(batches, "text"):
            held.append(keys_of(batch.column("text")))
            size += len(held[-1])
            if size >= CHUNK:
                yield _sent(*np.unique(np.concatenate(held), return_counts=True), bounds)
                held, size = [], 0
        if held:
            yield _sent(*np.unique(np.concatenate(held), return_counts=True), bounds)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sums of each range, from rows in the order of their ranges."""
    part, keys, counts, extra = None, [], [], 0

    def closed() -> tuple[int, np.ndarray, np.ndarray]:
        return (part, *_summed(np.concatenate(keys), np.concatenate(counts)))

    for batch in batches:
        for own, n, k, c in zip(*(batch.column(x).to_pylist() for x in ("part", "n", "keys", "counts")), strict=True):
            if own != part:
                if part is not None:
                    yield closed()
                part, keys, counts, extra = own, [], [], 0
            keys.append(_unpacked(k, n))
            counts.append(_wide(c, n))
            extra += n
            if extra > 4 * RANGE:  # what came in pieces is added up now and then
                _, one, two = closed()
                keys, counts, extra = [one], [two], 0
    if part is not None:
        yield closed()


TRIPLES = "part int, n long, m long, keys binary, groups binary, befores binary, counts binary"


def _triples(keys: np.ndarray, before: np.ndarray, counts: np.ndarray | None, size: int) -> tuple[np.ndarray, ...]:
    """Distinct ascending keys, how many distinct words come before each, these words, ascending for each key, and their sums."""
    distinct, at = np.unique(keys, return_inverse=True)
    codes = at.astype(np.uint64) * np.uint64(size) + before
    codes, counts = np.unique(codes, return_counts=True) if counts is None else _summed(codes, counts)
    at, before = codes // np.uint64(size), codes % np.uint64(size)
    return distinct, np.bincount(at.astype(np.int64), minlength=len(distinct)), before, counts


def _sent_triples(keys: np.ndarray, before: np.ndarray, bounds: np.ndarray, size: int) -> pa.RecordBatch:
    """A row for each range of keys that has any."""
    keys, groups, before, counts = _triples(keys, before, None, size)
    edges = np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))
    ends = np.concatenate(([0], np.cumsum(groups)))
    full = np.flatnonzero(np.diff(edges))
    rows = []
    for i in full:
        own = slice(edges[i], edges[i + 1])
        of = slice(ends[own.start], ends[own.stop])
        rows.append((int(i), own.stop - own.start, int(of.stop - of.start), _packed(keys[own]), _small(groups[own]).tobytes(), _dense(before[of].astype(np.uint32).tobytes(), 4), _small(counts[of]).tobytes()))
    columns = zip(*rows, strict=True) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["part", "n", "m", "keys", "groups", "befores", "counts"])


def _merged_triples(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """_triples() of each range, from rows in the order of their ranges."""
    part, held, extra = None, [], 0

    def closed() -> tuple[np.ndarray, ...]:
        return _triples(*(np.concatenate(x) for x in zip(*held, strict=True)), size)

    for batch in batches:
        for own, n, m, keys, groups, before, counts in zip(*(batch.column(x).to_pylist() for x in ("part", "n", "m", "keys", "groups", "befores", "counts")), strict=True):
            if own != part:
                if part is not None:
                    yield part, closed()
                part, held, extra = own, [], 0
            held.append((np.repeat(_unpacked(keys, n), _wide(groups, n).astype(np.int64)), np.frombuffer(_loose(before, 4), np.uint32).astype(np.uint64), _wide(counts, m)))
            extra += m
            if extra > 4 * RANGE:  # what came in pieces is added up now and then
                distinct, each, words, sums = closed()
                held, extra = [(np.repeat(distinct, each), words, sums)], 0
    if part is not None:
        yield part, closed()


def _filed(*arrays: np.ndarray) -> list[bytes]:
    """Arrays as one file: their number, their lengths in bytes, and each at a multiple of eight."""
    data = [np.ascontiguousarray(x).tobytes() for x in arrays]
    return [np.array([len(data), *map(len, data)], np.uint64).tobytes(), *(x + bytes(-len(x) % 8) for x in data)]


def _escaped(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts in a byte each, and places and values of those from 255 on."""
    at = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), at.astype(np.uint64), counts[at].astype(np.uint64)


def _looked_up(low: np.ndarray, places: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts at some places of what _escaped() has made."""
    found = low[at].astype(np.uint64)
    large = found == 255
    if large.any():
        found[large] = values.view(np.uint64)[np.searchsorted(places.view(np.uint64), at[large].astype(np.uint64))]
    return found


@dataclass
class Model:
    """Names and numbers of a trained model; the arrays are in files below root."""

    root: str
    bits: int = BITS
    offsets: list[int] = field(default_factory=lambda: [0])  # first id of each range of hashes
    tokens: int = 0
    bounds: list[int] = field(default_factory=list)
    present: list[int] = field(default_factory=list)  # ranges of keys that have files
    paired: list[int] = field(default_factory=list)  # and those of keys that are contexts
    discounts: list[float] = field(default_factory=lambda: [0.0] * 4)  # of trigrams
    middle: list[float] = field(default_factory=lambda: [0.0] * 4)  # of bigrams
    lower: list[float] = field(default_factory=lambda: [0.0] * 4)
    start: list[int] = field(default_factory=lambda: [0] * 4)  # of two end tokens as context, as PAIR has it
    types: int = 0  # distinct bigrams
    left: float = 1.0  # of p(w), what the words' own parts leave

    @property
    def size(self) -> int:
        return self.offsets[-1]


#: Numbers of a pair as a context: its total, and how many words follow it once, twice, more often.
PAIR = ("total", "ones", "twos", "more")
#: Arrays of a range of ids: token count, contexts it follows, its total as a context, and how many words follow it once, twice, more often.
FIELDS = ("count", "follows", "total", "ones", "twos", "more")


def _starts(bits: int) -> np.ndarray:
    """Where ranges of hashes begin, but for the first."""
    return np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)


#: Files of the model that a worker has mapped at a time.
OPEN = 512


class Mapped:
    """A model's arrays in one worker; files are mapped when they are needed, and those that haven't been for longest are let go."""

    def __init__(self, model: Model) -> None:
        self.model, self.files = model, collections.OrderedDict()
        self.offsets = np.array(model.offsets, np.int64)
        self.starts = _starts(model.bits)
        self.bounds = np.array(model.bounds, np.uint64)

    def array(self, name: str, kind: type = np.uint64) -> np.ndarray:
        if name not in self.files:
            self.files[name] = np.frombuffer(mapped(f"{self.model.root}/{name}"), kind)
            while len(self.files) > OPEN:
                self.files.popitem(last=False)
        self.files.move_to_end(name)
        return self.files[name]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of ascending distinct hashes, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        edges = np.concatenate(([0], np.searchsorted(hashes, self.starts), [len(hashes)]))
        for i in np.flatnonzero(np.diff(edges)):
            if self.offsets[i + 1] > self.offsets[i]:
                have, own = self.array(f"words-{i}"), hashes[edges[i] : edges[i + 1]]
                at = np.minimum(np.searchsorted(have, own), len(have) - 1)
                out[edges[i] : edges[i + 1]] = np.where(have[at] == own, self.offsets[i] + at, -1)
        return out

    def of_ids(self, ids: np.ndarray) -> np.ndarray:
        """FIELDS of ascending ids, a column each."""
        out = np.zeros((len(ids), len(FIELDS)))
        edges = np.searchsorted(ids, self.offsets)
        for i in np.flatnonzero(np.diff(edges)):
            n = self.offsets[i + 1] - self.offsets[i]
            have = self.array(f"ids-{i}").reshape(len(FIELDS), n)
            out[edges[i] : edges[i + 1]] = have[:, ids[edges[i] : edges[i + 1]] - self.offsets[i]].T
        return out

    def filed(self, name: str) -> list[np.ndarray]:
        """The arrays of _filed(), as bytes."""
        raw = self.array(name, np.uint8)
        n = int(raw[:8].view(np.uint64)[0])
        lengths = raw[8 : 8 + 8 * n].view(np.uint64).astype(np.int64)
        starts = 8 + 8 * n + np.concatenate(([0], np.cumsum(lengths + -lengths % 8)))
        return [raw[at : at + length] for at, length in zip(starts[:-1], lengths, strict=True)]

    def ranges(self, keys: np.ndarray, present: list[int]) -> Iterator[tuple[int, slice]]:
        """Ranges of those present, and which of ascending keys are theirs."""
        edges, present = np.concatenate(([0], np.searchsorted(keys, self.bounds), [len(keys)])), set(present)
        for i in np.flatnonzero(np.diff(edges)):
            if int(i) in present:
                yield int(i), slice(edges[i], edges[i + 1])

    def ngrams(self, keys: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of bigrams of ascending keys, and of the trigrams that they make with the words before (-1: none)."""
        two, three = np.zeros(len(keys)), np.zeros(len(keys))
        for i, own in self.ranges(keys, self.model.present):
            have, g1, g2, g3, begins, words, c1, c2, c3 = self.filed(f"range-{i}")
            groups = (g1, g2, g3)
            have, begins, words = have.view(np.uint64), begins.view(np.uint64), words.view(np.uint32)
            at = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
            known = have[at] == keys[own]
            at = at[known]
            n = _looked_up(*groups, at)
            two[own][known] = n
            # where the word before stands among those of its key: all keys' searches go on together
            block = at // BLOCK
            low = begins[block].astype(np.int64)
            inner = np.repeat(block * BLOCK, at - block * BLOCK) + _ramp(at - block * BLOCK)
            if len(inner):
                low += np.bincount(np.repeat(np.arange(len(at)), at - block * BLOCK), _looked_up(*groups, inner), len(at)).astype(np.int64)
            end = low + n.astype(np.int64)
            high, wanted = end.copy(), before[own][known]
            while (open_ := low < high).any():
                middle = (low + high) // 2
                less = open_ & (words[np.minimum(middle, len(words) - 1)] < wanted)
                low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
            low_ = np.minimum(low, len(words) - 1)
            hit = (low < end) & (words[low_] == wanted)
            three[own][known] = np.where(hit, _looked_up(c1, c2, c3, low_), 0)
        return two, three

    def pairs(self, keys: np.ndarray, start: int) -> np.ndarray:
        """PAIR of ascending distinct keys, a row each; start: the key of two end tokens."""
        out = np.zeros((len(PAIR), len(keys)))
        for i, own in self.ranges(keys, self.model.paired):
            have, tables = self.filed(f"range-{i}")[0].view(np.uint64), self.filed(f"pairs-{i}")
            at = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
            known = have[at] == keys[own]
            for row in range(len(PAIR)):
                out[row, own][known] = _looked_up(*tables[3 * row : 3 * row + 3], at[known])
        if not out[:, keys == start].any():
            out[:, keys == start] = np.array(self.model.start, float)[:, None]
        return out


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0 to length - 1 for each length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


_mapped: dict[str, Mapped] = {}


def in_worker(model: Model) -> Mapped:
    if model.root not in _mapped or _mapped[model.root].model != model:  # in training it has fewer files
        _mapped.clear()
        _mapped[model.root] = Mapped(model)
    return _mapped[model.root]


def _known(model: Mapped, hashes: np.ndarray) -> np.ndarray:
    distinct, at = np.unique(hashes, return_inverse=True)
    return model.ids(distinct)[at]


def _contexts(ids: np.ndarray, offsets: np.ndarray, end: int) -> np.ndarray:
    """The token before each, the end token before a text's first."""
    before = np.concatenate(([end], ids[:-1]))
    before[offsets[:-1]] = end
    return before


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 0, 1, 2, 3 and more, from the numbers of counts 1 to 4; half where they aren't defined."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    found = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.0), float(c)) for c, d in enumerate(found)]


def train(df: DataFrame, root: str, text_col: str = "text") -> Model:
    """A model of df's texts, with its files below root, a folder that driver and executors share."""
    spark, model = df.sparkSession, Model(root)
    texts = df.select(F.col(text_col).alias("text"))
    # a word takes some seven bytes
    model.bits = max(BITS, math.ceil(math.log2(max(1, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 7 / WORDS))))
    parts_of_words, starts = 1 << model.bits, _starts(model.bits)
    sums = texts.mapInArrow(_added(lambda x: _tokens(x)[0], starts), ADDED)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _merged(batches):
            put(f"{root}/words-{part}", [keys.tobytes()])
            put(f"{root}/count-{part}", [counts.tobytes()])
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())])], ["part", "n", "tokens"])

    by_part = lambda x: x.repartition("part").sortWithinPartitions("part")
    made = {r.part: r for r in written(by_part(sums).mapInArrow(words, "part int, n long, tokens long"), "words").collect()}  # a row for each range of hashes
    sizes = [made[i].n if i in made else 0 for i in range(parts_of_words)]
    masses = [made[i].tokens if i in made else 0 for i in range(parts_of_words)]
    model.offsets = np.concatenate(([0], np.cumsum(sizes))).tolist()
    model.tokens = sum(masses)
    if not model.tokens:
        return model
    size, offsets = model.size, np.array(model.offsets)
    if size >= 1 << 32:
        raise ValueError("a bigram's key has 64 bits, which is enough for 2**32 distinct words")

    # where ranges of keys of equal mass begin: a context has its count's mass, spread evenly over its words
    ranges = max(parts_of_words, -(-model.tokens // RANGE))
    wanted = [model.tokens * i / ranges for i in range(1, ranges)]
    before = np.concatenate(([0], np.cumsum(masses)))

    def begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                mass = before[part] + np.concatenate(([0.0], np.cumsum(np.frombuffer(mapped(f"{root}/count-{part}"), np.uint64).astype(float))))
                own = np.array([x for x in wanted if mass[0] <= x < mass[-1]])
                at = np.searchsorted(mass, own, "right") - 1
                share = (own - mass[at]) / (mass[at + 1] - mass[at])
                keys = (offsets[part] + at).astype(np.uint64) * np.uint64(size) + (share * size).astype(np.uint64)
                yield pa.record_batch([pa.array(keys.view(np.int64))], ["key"])

    filled = spark.createDataFrame([(i,) for i in range(parts_of_words) if sizes[i]], "part int").repartition("part")
    model.bounds = sorted({r.key for r in filled.mapInArrow(begins, "key long").collect()})  # one for each range
    bounds = np.array(model.bounds, np.uint64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks' sums of trigrams, by ranges of bigrams."""
        held, n = [], 0
        for batch in pieces(batches, "text"):
            here = in_worker(model)
            hashes, ends = _tokens(batch.column("text"))
            ids, end = _known(here, hashes), int(here.ids(np.array([END]))[0])
            context = _contexts(ids, ends, end)
            held.append(((context * size + ids).astype(np.uint64), _contexts(context, ends, end).astype(np.uint64)))
            n += len(ids)
            if n >= CHUNK:
                yield _sent_triples(*(np.concatenate(x) for x in zip(*held, strict=True)), bounds, size)
                held, n = [], 0
        if held:
            yield _sent_triples(*(np.concatenate(x) for x in zip(*held, strict=True)), bounds, size)

    names = ["place", "part", "kind", "n", *"abcde"]
    stats = "place string, part int, kind int, n long, a binary, b binary, c binary, d binary, e binary"

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (keys, groups, before, counts) in _merged_triples(batches, size):
            begins = np.concatenate(([0], np.cumsum(groups)))
            put(f"{root}/range-{part}", _filed(keys, *_escaped(groups), begins[:-1:BLOCK].astype(np.uint64), before.astype(np.uint32), *_escaped(counts)))
            few = [np.bincount(np.minimum(x, 5).astype(np.int64), minlength=6)[1:5].astype(np.uint64).tobytes() for x in (groups, counts)]
            rows = [("sums", part, 0, len(keys), *few, b"", b"", b"")]
            context, word = (keys // np.uint64(size)).astype(np.int64), (keys % np.uint64(size)).astype(np.int64)
            begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            sums = lambda x, at: [np.add.reduceat(y.astype(np.uint64), at) for y in (x, x == 1, x == 2, x > 2)]
            distinct, contexts = np.unique(word, return_counts=True)
            pair = before * np.uint64(size) + np.repeat(context, groups).astype(np.uint64)
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            for place, kind, ids, edges, base, values in (
                ("ids", 2, context[begin], np.searchsorted(context[begin], offsets), offsets, sums(groups, begin)), ("ids", 1, distinct, np.searchsorted(distinct, offsets), offsets, [contexts]),
                ("pairs", 0, pair[first], np.concatenate(([0], np.searchsorted(pair[first], bounds), [len(first)])), None, sums(counts[order], first)),
            ):
                for i in np.flatnonzero(np.diff(edges)):
                    cut = slice(edges[i], edges[i + 1])
                    own = ids[cut] if base is None else (ids[cut] - base[i]).astype(np.uint64)
                    blobs = [_packed(own), *(_small(v[cut]).tobytes() for v in values)]
                    rows.append((place, int(i), kind, len(own), *blobs, *[b""] * (5 - len(blobs))))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], names)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Files of what words and pairs are as contexts, from rows in the order of place and part; a row of numbers for each."""
        place, part, table, keys, odd = None, None, None, None, None

        def row(numbers: list[int], n: int = 0) -> pa.RecordBatch:
            return pa.record_batch([pa.array([place]), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([[int(x) for x in numbers]], pa.list_(pa.int64()))], ["place", "part", "n", "numbers"])

        def closed() -> pa.RecordBatch:
            if place == "ids":
                table[0] = np.frombuffer(mapped(f"{root}/count-{part}"), np.uint64)
                put(f"{root}/ids-{part}", [table.tobytes()])
                return row([*np.bincount(np.minimum(table[1], 5).astype(np.int64), minlength=6)[1:5], (table[1] > 2).sum()])
            put(f"{root}/pairs-{part}", _filed(*(x for numbers in table for x in _escaped(numbers))))
            return row(odd)

        for batch in batches:
            for at_place, own, kind, n, *blobs in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if (at_place, own) != (place, part):
                    if place in ("ids", "pairs"):
                        yield closed()
                    place, part = at_place, own
                    if place == "ids":
                        table = np.zeros((len(FIELDS), sizes[own]), np.uint64)
                    elif place == "pairs":
                        keys = Mapped(model).filed(f"range-{own}")[0].view(np.uint64) if exists(f"{root}/range-{own}") else np.zeros(0, np.uint64)
                        table, odd = np.zeros((len(PAIR), len(keys)), np.uint64), np.zeros(len(PAIR), np.uint64)
                if place == "sums":
                    yield row([*np.frombuffer(blobs[0], np.uint64), *np.frombuffer(blobs[1], np.uint64)], n)
                    continue
                at, values = _unpacked(blobs[0], n), [_wide(x, n) for x in blobs[1:] if x]
                if place == "pairs":  # all but two end tokens are bigrams too
                    own_at = np.minimum(np.searchsorted(keys, at), max(len(keys) - 1, 0))
                    known = keys[own_at] == at if len(keys) else np.zeros(n, bool)
                    odd += np.array([v[~known].sum() for v in values], np.uint64)
                    at, values = own_at[known], [v[known] for v in values]
                for i, v in enumerate(values):
                    table[kind + i, at.astype(np.int64)] += v
        if place in ("ids", "pairs"):
            yield closed()

    ranked = by_part(texts.mapInArrow(counted, TRIPLES)).mapInArrow(ranged, stats)
    placed = ranked.repartition("place", "part").sortWithinPartitions("place", "part")
    rows = written(placed.mapInArrow(finished, "place string, part int, n long, numbers array<long>"), "model").collect()  # a row for each range
    added = lambda place, k: np.sum([r.numbers for r in rows if r.place == place] or [[0] * k], axis=0).tolist()
    few, many, model.start = added("sums", 8), added("ids", 5), added("pairs", 4)
    model.present = sorted(r.part for r in rows if r.place == "sums")
    model.paired = sorted({r.part for r in rows if r.place == "pairs"} & set(model.present))
    model.types = sum(r.n for r in rows)
    model.middle, model.discounts, model.lower = _discounts(few[:4]), _discounts(few[4:]), _discounts(many[:4])
    model.left = (model.lower[1] * many[0] + model.lower[2] * many[1] + model.lower[3] * many[4]) / model.types
    return model


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df without the text, with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text)."""
    own = [c for c in df.columns if c not in (text_col, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    size, types = model.size, max(1, model.types)
    discounts, middle, lower = np.array(model.discounts), np.array(model.middle), np.array(model.lower)

    def part(c: np.ndarray, d: np.ndarray, total: np.ndarray) -> np.ndarray:
        """What is left of counts after their discounts, over their total."""
        left = np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0)
        return np.divide(left, total, out=np.zeros_like(left), where=total > 0)

    def passed(d: np.ndarray, total: np.ndarray, ones: np.ndarray, twos: np.ndarray, more: np.ndarray) -> np.ndarray:
        """What a context's discounts leave for the shorter one."""
        return np.divide(d[1] * ones + d[2] * twos + d[3] * more, total, out=np.ones_like(total), where=total > 0)

    def scored(texts: pa.Array) -> list[np.ndarray]:
        here = in_worker(model)
        hashes, offsets = _tokens(texts)
        ids = _known(here, hashes)
        distinct, at = np.unique(ids, return_inverse=True)
        table = here.of_ids(np.maximum(distinct, 0)) * (distinct >= 0)[:, None] if size else np.zeros((len(distinct), len(FIELDS)))
        count, follows, *context = table.T
        word = part(follows, lower, np.full(len(distinct), float(types))) + model.left / (size + 1)
        end = int(here.ids(np.array([END]))[0]) if size else -1
        before = _contexts(ids, offsets, end)
        first = _contexts(before, offsets, end)
        two, three = np.zeros(len(ids)), np.zeros(len(ids))
        both = np.flatnonzero((ids >= 0) & (before >= 0))
        both = both[np.argsort(before[both] * size + ids[both], kind="stable")]
        two[both], three[both] = here.ngrams((before[both] * size + ids[both]).astype(np.uint64), first[both])
        pair = np.zeros((len(PAIR), len(ids)))
        known = (before >= 0) & (first >= 0)
        keys, key_at = np.unique((first[known] * size + before[known]).astype(np.uint64), return_inverse=True)
        pair[:, known] = here.pairs(keys, end * size + end)[:, key_at]
        of = np.searchsorted(distinct, before)
        bigram = part(two, middle, context[0][of]) + passed(middle, *context)[of] * word[at]
        logs = np.log10(part(three, discounts, pair[0]) + passed(discounts, *pair) * bigram)
        base = np.log10((count[at] + 1) / (model.tokens + size + 1))
        add = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  every text has its end token
        return [np.diff(offsets), add((count[at] > 0).astype(np.int64)), np.full(len(texts), model.tokens), add(base), add(logs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 4 << 20):
            found = scored(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), *map(pa.array, found)], [*own, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = df.select(*(F.col(f"`{c}`") for c in own)).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return df.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row; the model learns from the rows that aren't held out."""
    rows = df.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    model = train(rows.where("not held_out"), shared_folder(df.sparkSession, "kneser-ney"))
    return score(rows, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
