"""Two tokenizers' tokens of the same texts, aligned at the bytes where both end.

Texts are cut into stretches before a space that follows anything but white space. Neither a byte-level
pattern nor a piece model without a piece that goes on after a space can have a token across such a cut, so a stretch has
the tokens that it has within its text. A block of documents knows its different stretches and sends each once to the range that
its hash is in; a range encodes each stretch of the corpus once and answers with its groups. A token's
end in bytes comes from the spans that the libraries give: character offsets of the first, byte spans of the
second, which calls its immutable spans `proto`. Tokens that share a character (parts of a multibyte one) or have an empty span (byte fallback) are
refined with the bytes that they decode to. Documents then become a sparse matrix by linked id pairs; pairs are dealt into ranges by their second
id, so that a range counts its pairs and knows each second id's highest count, and meet each block once a pair.

Results for odd input: a null or empty text, and one whose tokens' bytes aren't a space and the text (one that holds
U+2581, for instance), has no tokens: zeros and ''; rows that repeat an id are documents of their own and count as often as they are there; a
null id stays null; ties for the highest count all count; very long texts are a block each, and a stretch without a space
is encoded whole; other columns aren't read; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.blocks import BLOCK, counted, dealt, key_places, listed, packed, probed, ranges, row_sums, slices, split, unpacked
from tidewatch.llm.shared import written

#: Different stretches of the corpus in one range, of which one task holds all.
STRETCHES = 100_000
#: Stretches whose spans are in memory at a time.
AT_ONCE = 10_000
#: Documents' and matrices' columns of a block.
NUMBERS = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
MATRIX = ["indptr", "indices", "data"]
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Numbers(dict):
    """Numbers of stretches in the order in which they come; `new` has those that aren't encoded yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


def refined(coarse: list[int], sure: list[bool], lengths: list[int]) -> list[int]:
    """Ends of tokens: the coarse ones where they are sure, else the end before and the token's own bytes."""
    ends, at = [], 0
    for end, fine, length in zip(coarse, sure, lengths, strict=True):
        at = end if fine else at + length
        ends.append(at)
    return ends


class Aligner:
    """Both tokenizers, and what is known of stretches: tokens, groups and linked pairs."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        special = {i for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = {i: t.encode() if i in special else bytes(letters[c] for c in t) for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.byte_ids = {i for i in range(len(pieces)) if self.b.is_byte(i)}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if i in self.byte_ids else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(SPACE)
        self.digits = [str(i) for i in range(max(len(pieces), len(self.bytes_a)) + 1)]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of the second model goes on after a space, so texts can't be cut at spaces")
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.text: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # a, b, groups, whether the bytes are the stretch's
        self.pairs, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def spans_a(self, stretch: str, encoding) -> tuple[list[int], list[int], bool]:
        """Ids, ends in bytes, and whether the tokens' bytes are the stretch's."""
        ids, offsets = encoding.ids, encoding.offsets
        parts = [self.bytes_a[i] for i in ids]
        if stretch.isascii():  # a character is a byte, which no two tokens share
            return ids, [end for _, end in offsets], b"".join(parts) == stretch.encode()
        place = [0, *itertools.accumulate(len(c.encode()) for c in stretch)]
        sure = [i + 1 == len(offsets) or offsets[i + 1][0] >= end for i, (_, end) in enumerate(offsets)]
        return ids, refined([place[end] for _, end in offsets], sure, list(map(len, parts))), b"".join(parts) == stretch.encode()

    def spans_b(self, stretch: str, ids: list[int], proto) -> tuple[list[int], list[int], bool]:
        """The same for the second tokenizer, which adds the stretch's first space itself and gives spans without it."""
        ends = [p.end + 1 for p in proto.pieces]
        if not ids:
            ids, ends = [self.space], [1]
        parts = [self.bytes_b[i] for i in ids]
        if not self.byte_ids.isdisjoint(ids):
            ends = refined(ends, [i not in self.byte_ids for i in ids], list(map(len, parts)))
        return ids, ends, b"".join(parts) == stretch.encode()

    def learn(self) -> None:
        """Encode the stretches that have come up since."""
        for start in range(0, len(self.numbers.new), AT_ONCE):
            self._learn(self.numbers.new[start : start + AT_ONCE])
        self.numbers.new.clear()

    def _learn(self, new: list[str]) -> None:
        stretches = [" " + key for key in new]
        encodings = self.a.encode_batch(stretches, add_special_tokens=False)
        tokens, protos = self.b.encode(new, num_threads=1), self.b.encode(new, return_type="proto", num_threads=1)
        counts, pairs, lengths, digits = [], [], [], self.digits.__getitem__
        for stretch, encoding, ids, proto in zip(stretches, encodings, tokens, protos, strict=True):
            ids_a, ends_a, right_a = self.spans_a(stretch, encoding)
            ids_b, ends_b, right_b = self.spans_b(stretch, ids, proto)
            groups = []
            if right_a and right_b:
                place_b = {end: k for k, end in enumerate(ends_b, 1)}
                i = j = 0
                for k, end in enumerate(ends_a, 1):
                    m = place_b.get(end)
                    if m:
                        groups.append(",".join(map(digits, ids_a[i:k])) + "|" + ",".join(map(digits, ids_b[j:m])))
                        pairs.append(ids_a[k - 1] << 32 | ids_b[m - 1])
                        i, j = k, m
            self.text.append(";".join(groups))
            counts.append((len(ids_a), len(ids_b), len(groups), right_a and right_b))
            lengths.append(len(groups))
        self.counts = np.concatenate((self.counts, np.array(counts, np.int64)))
        self.pairs = np.concatenate((self.pairs, np.array(pairs, np.int64)))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(lengths)))


#: White space before a space: there a text isn't cut.
WIDE = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")


def stretches(text: str) -> list[str]:
    """The stretches of a space and the text, each without its first space."""
    if text.endswith(" ") or WIDE.search(text) or text.startswith(" "):
        return [s[1:] for s in CUT.split(" " + text)]
    return text.split(" ")


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _gathered(starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the numbered lists, and the lists' lengths."""
    lengths = starts[numbers + 1] - starts[numbers]
    shift = np.repeat(starts[numbers] - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(lengths.sum()) + shift, lengths


def stretch_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Blocks of documents as numbers of stretches, with the block's different stretches in the order of these numbers, as a written table."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in slices(batches, "text", block):
            numbers = Numbers()
            found = [np.fromiter(map(numbers.__getitem__, stretches(t)), np.int64) if t else np.zeros(0, np.int64) for t in rows.column("text").to_pylist()]
            keys = list(numbers)
            encoded = [k.encode() for k in keys]
            data = [packed(np.array(list(map(len, found)))), packed(np.concatenate([*found, np.zeros(0, np.int64)])), b"".join(encoded), packed(np.array(list(map(len, encoded)), np.int64))]
            columns = [pa.array([number], pa.int64()), listed(rows.column("doc_id"), pa.int64()), *(pa.array([x], pa.binary()) for x in data), probed(_hashes(keys))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "widths", "numbers", "keys", "lengths", "probe"])

    schema = "block long, doc_id array<long>, widths binary, numbers binary, keys binary, lengths binary, probe array<long>"
    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(build, schema), "stretches")


def _hashes(keys: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(keys, object), categorize=False) if keys else np.zeros(0, np.uint64)


def _cut(joined: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = [0, *np.cumsum(lengths).tolist()]
    return [joined[a:b] for a, b in itertools.pairwise(ends)]


#: What a range answers: places, and compressed: tokens of both, groups and whether the bytes are right (four numbers a stretch); groups as text; linked pairs.
FOUND = ["places", "counts", "text", "pairs"]


def _encoded(blocks: DataFrame, path_a: str, path_b: str, n: int) -> DataFrame:
    """block, found: structs of places and of what is known of the stretches there, a struct a range."""

    def cut(row: pa.RecordBatch, n: int) -> Iterator[tuple[int, bytes, dict[str, bytes]]]:
        each = _cut(row.column("keys")[0].as_py(), unpacked(row.column("lengths")[0].as_py()))
        for i, places in split(_hashes([k.decode() for k in each]), n):
            own = [each[j] for j in places.tolist()]
            yield i, packed(places), {"keys": b"".join(own), "lengths": packed(np.array(list(map(len, own))))}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, now = aligner(path_a, path_b), None
        small = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for own, block, places, keys, lengths in zip(*(batch.column(c).to_pylist() for c in ("range", "block", "places", "keys", "lengths")), strict=True):
                if own != now:
                    now = own
                    both.forget()
                numbers = np.fromiter((both.numbers[k.decode()] for k in _cut(keys, unpacked(lengths))), np.int64)
                both.learn()
                text = "\n".join(map(both.text.__getitem__, numbers.tolist())).encode()
                data = [places, small(packed(both.counts[numbers].T.ravel())), small(text), small(packed(both.pairs[_gathered(both.starts, numbers)[0]], 8))]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in data)], ["block", *FOUND])

    rows = dealt(blocks.select("block", "keys", "lengths").where("length(lengths) > 0"), n, cut, ["keys", "lengths"])
    kinds = "block long, " + ", ".join(f"{c} binary" for c in FOUND)
    found = rows.repartition(n, "range").sortWithinPartitions("range", "block").mapInArrow(encode, kinds)
    return found.groupBy("block").agg(F.collect_list(F.struct(*FOUND)).alias("found"))


def _joined(row: pa.RecordBatch) -> pa.RecordBatch:
    """A block's documents from its stretches and what is known of these."""
    widths, numbers = (unpacked(row.column(c)[0].as_py()) for c in ("widths", "numbers"))
    parts = row.column("found")[0].as_py() or []
    places = [unpacked(p["places"]) for p in parts]
    n = sum(map(len, places))
    counts, text, starts = np.zeros((n, 4), np.int64), [""] * n, np.zeros(n + 1, np.int64)
    whole = zstandard.ZstdDecompressor().decompress
    for at, part in zip(places, parts, strict=True):
        counts[at] = unpacked(whole(part["counts"])).reshape(4, -1).T
        for i, own in zip(at.tolist(), whole(part["text"]).decode().split("\n"), strict=True):
            text[i] = own
    starts[1:] = np.cumsum(counts[:, 2])
    pairs = np.zeros(starts[-1], np.int64)
    for at, part in zip(places, parts, strict=True):
        pairs[_gathered(starts, at)[0]] = unpacked(whole(part["pairs"]), 8)
    found = np.split(numbers, np.cumsum(widths)[:-1])
    found = [f if counts[f, 3].all() else f[:0] for f in found]
    digests = [hashlib.sha256(";".join(map(text.__getitem__, f.tolist())).encode()).hexdigest() if len(f) else "" for f in found]
    numbers, widths = np.concatenate([*found, np.zeros(0, np.int64)]), np.array(list(map(len, found)))
    sums = [row_sums(np.concatenate(([0], np.cumsum(widths))), counts[numbers, i]) for i in range(3)]
    places, lengths = _gathered(starts, numbers)
    keys, local = np.unique(pairs[places], return_inverse=True)
    links = np.repeat(np.repeat(np.arange(len(found)), widths), lengths)
    indptr, indices, data = counted(links, local, len(found), len(keys))
    columns = [row.column("doc_id"), *(listed(x, pa.int64()) for x in (*sums, np.bincount(links, minlength=len(found)))), listed(pa.array(digests, pa.string()), pa.string())]
    data = [packed(x) for x in (indptr, indices, data)] + [packed(keys, 8), packed(np.bincount(local, minlength=len(keys)), 8)]
    return pa.RecordBatch.from_arrays([row.column("block"), *columns, *(pa.array([x], pa.binary()) for x in data), probed(key_places(data[3]))], ["block", *NUMBERS, "groups_sha256", *MATRIX, "pairs", "times", "probe"])


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: figures of their groups, and the matrix of documents by linked pairs (packed pairs: a << 32 | b), as a written table."""
    blocks = stretch_blocks(docs, id_col, text_col)
    known = _encoded(blocks, path_a, path_b, ranges(blocks, STRETCHES))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _joined(batch.slice(i, 1))

    schema = "block long, " + ", ".join(f"{c} array<long>" for c in NUMBERS) + ", groups_sha256 array<string>, " + ", ".join(f"{c} binary" for c in (*MATRIX, "pairs", "times")) + ", probe array<long>"
    rows = blocks.select("block", "doc_id", "widths", "numbers").join(known, "block", "left")
    return written(rows.mapInArrow(build, schema), "aligned")


def _by_range(blocks: DataFrame, n: int) -> DataFrame:
    """range, block, places, pairs, times of each block's pairs; pairs of one second id are in one range."""

    def cut(row: pa.RecordBatch, n: int) -> Iterator[tuple[int, bytes, dict[str, bytes]]]:
        pairs, times = row.column("pairs")[0].as_py(), row.column("times")[0].as_py()
        own, counts = unpacked(pairs, 8), unpacked(times, 8)
        for i, places in split(key_places(pairs, 32), n):
            yield i, packed(places), {"pairs": packed(own[places], 8), "times": packed(counts[places], 8)}

    return dealt(blocks.select("block", "pairs", "times").where("length(pairs) > 0"), n, cut, ["pairs", "times"])


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(place, np.concatenate(times), len(keys)).astype(np.int64)


COUNTS = "range int, pairs binary, counts binary, best binary"


def counted_ranges(rows: DataFrame, n: int, most: int = 4_000_000) -> DataFrame:
    """range, and its pairs in ascending order, their counts, and 1 where no other pair of the second id has more (all packed), as a written table."""

    def table(now: int, pairs: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = _summed(pairs, times)
        second, place = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
        highest = np.zeros(len(second), np.int64)
        np.maximum.at(highest, place, counts)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([packed(x, 8)], pa.binary()) for x in (keys, counts, counts == highest[place]))], ["range", "pairs", "counts", "best"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, times, waiting = None, [], [], 0
        for batch in batches:
            for own, some, n_times in zip(*(batch.column(c).to_pylist() for c in ("range", "pairs", "times")), strict=True):
                if own != now:
                    if now is not None:
                        yield table(now, pairs, times)
                    now, pairs, times, waiting = own, [], [], 0
                pairs.append(unpacked(some, 8))
                times.append(unpacked(n_times, 8))
                waiting += len(pairs[-1])
                if waiting > most:  # what one range holds is its distinct pairs, and as many again
                    pairs, times = ([x] for x in _summed(pairs, times))
                    waiting = 0
        if now is not None:
            yield table(now, pairs, times)

    return written(rows.repartition(n, "range").sortWithinPartitions("range").mapInArrow(count, COUNTS), "counts")


def pair_counts(counts: DataFrame) -> DataFrame:
    """a, b, count, best: the alignment of both vocabularies from counted_ranges()."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, n, best = (unpacked(row[c], 8) for c in ("pairs", "counts", "best"))
                yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(n), pa.array(best == 1)], ["a", "b", "count", "best"])

    return counts.mapInArrow(flat, "a long, b long, count long, best boolean")


def _answers(rows: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """block, met: structs of places, counts and best (packed) of its pairs, a struct a range."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[np.ndarray] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["block"] is None:
                    table = [unpacked(row[c], 8) for c in ("pairs", "counts", "best")]
                else:
                    at = np.searchsorted(table[0], unpacked(row["pairs"], 8))
                    out.append((row["block"], row["places"], packed(table[1][at], 8), packed(table[2][at])))
            names, kinds = ["block", "places", "counts", "best"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    # a range's table comes before its blocks
    both = rows.drop("times").unionByName(counts.withColumn("block", F.lit(None).cast("long")), allowMissingColumns=True)
    both = both.repartition(n, "range").sortWithinPartitions("range", F.col("block").asc_nulls_first())
    found = both.select("block", "places", "pairs", "counts", "best").mapInArrow(answer, "block long, places binary, counts binary, best binary")
    return found.groupBy("block").agg(F.collect_list(F.struct("places", "counts", "best")).alias("met"))


def summed(blocks: DataFrame) -> DataFrame:
    """A row a document: its figures, n_best and count_sum over its links."""
    out = [*NUMBERS, "n_best", "count_sum"]
    n = ranges(blocks)
    rows = _by_range(blocks, n)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                indptr, indices, data = (unpacked(row.column(c)[0].as_py()) for c in MATRIX)
                counts, best = (np.zeros(int(indices.max()) + 1 if len(indices) else 0, np.int64) for _ in range(2))
                for part in row.column("met")[0].as_py() or []:
                    places = unpacked(part["places"])
                    counts[places], best[places] = unpacked(part["counts"], 8), unpacked(part["best"])
                sums = [pa.array(row_sums(indptr, data * x[indices]), pa.int64()) for x in (best, counts)]
                flat = [pc.list_flatten(row.column(c)) for c in (*NUMBERS, "groups_sha256")]
                yield pa.RecordBatch.from_arrays([*flat[:-1], *sums, flat[-1]], [*out, "groups_sha256"])

    met = blocks.select("block", *NUMBERS, "groups_sha256", *MATRIX).join(_answers(rows, counted_ranges(rows, n), n), "block", "left")
    return met.select(*NUMBERS, "groups_sha256", *MATRIX, "met").mapInArrow(total, ", ".join(f"{c} long" for c in out) + ", groups_sha256 string")


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    return summed(aligned_blocks(docs, path_a, path_b))
