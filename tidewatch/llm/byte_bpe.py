"""Byte-level BPE encoding and decoding with numpy.

A rank file (base64 token and rank a line) gives the vocabulary. Each match of the pattern is encoded by
itself. The distinct pieces that a worker hasn't seen lately are sorted into buckets by
length and become padded matrices of token ids, one row a piece; in each round every row merges its leftmost
pair of minimum rank, found through an open-addressing hash table of all pairs (left id, right id)
that make a token, and closes the gap; rows without such a pair leave the matrix. Pieces beyond
LONGEST bytes are merged one by one with a heap, in the same order of merges.

Results for odd input: a null text is empty and has no ids; ids that aren't in the vocabulary decode
to nothing; other columns are kept as they are (a column that has the output's name is replaced);
memory is bounded by SLICE bytes of text at a time, or one text if it is longer.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.words import mixed, pieces

LONGEST = 256
SLICE = 1 << 20
#: Stretches of text whose ids a worker remembers.
REMEMBERED = 300_000


class PairTable:
    """Ranks of pairs of ids: open addressing with linear probing, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(len(rank) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int32)
        keys = left.astype(np.int64) << 32 | right
        todo, place = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = self.keys[place] == -1
            first = np.unique(place[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[place[put]] = keys[todo[put]]
            self.ranks[place[put]] = rank[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, place = todo[rest], (place[rest] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out, place, todo = np.full(len(keys), none, np.int32), self._place(keys), np.arange(len(keys))
        while len(todo):
            there = self.keys[place]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[place[hit]]
            on = ~hit & (there != -1)
            todo, place = todo[on], (place[on] + 1) & (len(self.keys) - 1)
        return out.reshape(left.shape)


class Numbers(dict):
    """Numbers stretches of text in the order in which they come; `new` has those without ids."""

    def __init__(self) -> None:
        self.new: list[str | tuple[str]] = []

    def __missing__(self, key: str | tuple[str]) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class Vocabulary:
    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        # white space as the library that defines the ids has it: U+001C to U+001F are none
        self.pairs: PairTable | None = None
        self.findall = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.between = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
        size = max(self.ids.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.length = np.array([len(t) for t in self.tokens] + [0], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length[:-1])))
        self.joined = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._forget()

    def _merges(self) -> None:
        """The tables of merges, for the first piece that isn't a whole token."""
        split = [(a, b, rank) for token, rank in self.ids.items() for i in range(1, len(token)) if (a := self.ids.get(token[:i])) is not None and (b := self.ids.get(token[i:])) is not None]
        self.pairs = PairTable(*(np.array(x, np.int32) for x in zip(*split, strict=True)))
        self.rank_of = {a << 32 | b: rank for a, b, rank in split}

    def _matrix(self, encoded: list[bytes]) -> list[list[int]]:
        """Ids of pieces of about one length."""
        widths = np.array(list(map(len, encoded)))
        width = int(widths.max())
        ids = np.full((len(encoded), width), -1, np.int32)
        ids[np.arange(width) < widths[:, None]] = self.byte[np.frombuffer(b"".join(encoded), np.uint8)]
        out: list[list[int]] = [[]] * len(encoded)
        row, rank = np.arange(len(encoded)), self._ranks(ids)
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), self.NONE)
            over = least == self.NONE
            if over.any():
                for r, own in zip(row[over].tolist(), ids[over].tolist(), strict=True):
                    out[r] = [x for x in own if x >= 0]
                row, ids, rank, at, least = row[~over], ids[~over], rank[~over], at[~over], least[~over]
                if not len(row):
                    break
            each = np.arange(len(row))
            ids[each, at] = least
            # close the gap behind the merged pair, in ids and in ranks
            source = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
            full = int((ids >= 0).sum(axis=1).max())
            ids = ids[:, :full]
            rank = np.take_along_axis(rank, np.minimum(source[:, : max(full - 1, 0)], rank.shape[1] - 1), axis=1)
            if full > 1:
                for place in (at - 1, at):
                    ok = np.flatnonzero((place >= 0) & (place < full - 1))
                    left, right = ids[ok, place[ok]], ids[ok, place[ok] + 1]
                    rank[ok, place[ok]] = np.where(right >= 0, self.pairs.find(left, np.maximum(right, 0), self.NONE), self.NONE)
        return out

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        left, right = ids[:, :-1], ids[:, 1:]
        both = (left >= 0) & (right >= 0)
        return np.where(both, self.pairs.find(np.maximum(left, 0), np.maximum(right, 0), self.NONE), self.NONE)

    def _heap(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n, after, before = len(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank_of, heap = self.rank_of, []
        for i in range(n - 1):
            if (rank := rank_of.get(ids[i] << 32 | ids[i + 1])) is not None:
                heap.append((rank, i))
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank_of.get(rank << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank_of.get(ids[before[i]] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [x for x in ids if x >= 0]

    def _encoded(self, found: list[str]) -> dict[str, list[int]]:
        """Ids of pieces: whole tokens at once, the rest in buckets by length."""
        if self.pairs is None:
            self._merges()
        out: dict[str, list[int]] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in found:
            raw = piece.encode()
            whole = self.ids.get(raw)
            if whole is not None:
                out[piece] = [whole]
            elif len(raw) > LONGEST:
                out[piece] = self._heap(raw)
            else:
                buckets.setdefault((len(raw) + 1) // 2 if len(raw) <= 16 else 8 + (len(raw) - 1).bit_length(), []).append((piece, raw))
        for bucket in buckets.values():
            for at in range(0, len(bucket), 8192):
                part = bucket[at : at + 8192]
                out.update(zip((piece for piece, _ in part), self._matrix([raw for _, raw in part]), strict=True))
        return out

    def _learn(self) -> None:
        """Ids of the stretches that have a number since the last call."""
        new, self.seen.new = self.seen.new, []
        found = [self.findall(x[0] if isinstance(x, tuple) else " " + x) for x in new]
        ids = self._encoded(list({piece for one in found for piece in one}))
        rows = [[x for piece in one for x in ids[piece]] for one in found]
        self.counts = np.concatenate([self.counts, np.array([len(x) for x in rows], np.int64)])
        self.places = np.concatenate([[0], np.cumsum(self.counts)])
        self.flat = np.concatenate([self.flat, np.array([x for one in rows for x in one], np.int32)])
        joint = [not x[0] or x[0][-1].isspace() if isinstance(x, tuple) else not x or x[0].isspace() or x[-1].isspace() for x in new]
        self.joint = np.concatenate([self.joint, np.array(joint, bool)])

    def _forget(self) -> None:
        self.seen, self.counts, self.flat, self.joint = Numbers(), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def encode(self, texts: list[str | None]) -> pa.Array:
        """Ids of each text, as a list array.

        A space between two characters that are no white space always begins a match, so the
        stretches between such spaces are encoded by themselves and remembered. Where a stretch
        begins or ends with white space, the text is cut again with a pattern.
        """
        if len(self.seen) > REMEMBERED:
            self._forget()
        number = self.seen.__getitem__
        numbered = []
        for text in texts:
            first, *rest = text.split(" ") if text else ("",)
            numbered.append([number((first,)), *map(number, rest)] if text else [])
        self._learn()
        for at, numbers in enumerate(numbered):
            if numbers and self.joint[numbers].any():
                first, *rest = self.between.split(texts[at])
                numbered[at] = [number((first,)), *map(number, rest)]
        self._learn()
        flat = np.fromiter((x for one in numbered for x in one), np.int64) if len(numbered) < 2 else np.concatenate([np.array(one, np.int64) for one in numbered])
        counts = self.counts[flat]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self.flat[np.repeat(self.places[flat] - ends[:-1], counts) + np.arange(ends[-1])]
        offsets = ends[np.concatenate(([0], np.cumsum([len(one) for one in numbered])))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each list of ids, as a binary array; null stays null."""
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        counts = np.asarray(pc.list_value_length(ids).fill_null(0)).astype(np.int64)
        flat = np.asarray(ids.flatten().fill_null(-1))
        flat = np.where((flat >= 0) & (flat < len(self.tokens)), flat, len(self.tokens))
        length = self.length[flat]
        ends = np.concatenate(([0], np.cumsum(length)))
        places = np.repeat(np.append(self.start, 0)[flat] - ends[:-1], length) + np.arange(ends[-1])
        data = self.joined[places]
        offsets = ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int64)
        out = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        return pc.if_else(ids.is_valid(), out, None) if ids.null_count else out


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once a worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary(path, pattern)
    return _loaded[path, pattern]


def _with(df: DataFrame, name: str, kind: T.DataType, function, sliced) -> DataFrame:
    own = [c for c in df.columns if c != name]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), function(batch)], [*own, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """df with out_col: the ids of the whole text. `path` names the rank file on every worker."""

    def ids(batch: pa.RecordBatch) -> pa.Array:
        return vocabulary(path, pattern).encode(batch.column(batch.schema.get_field_index(text_col)).to_pylist())

    return _with(df, out_col, T.ArrayType(T.IntegerType()), ids, lambda batches: pieces(batches, text_col, SLICE))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col: the bytes that ids_col stands for."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            ends = np.cumsum(np.asarray(pc.list_value_length(batch.column(batch.schema.get_field_index(ids_col))).fill_null(0)).astype(np.int64))
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE // 2, "right")))
                yield batch.slice(at, end - at)
                at = end

    def data(batch: pa.RecordBatch) -> pa.Array:
        out = vocabulary(path, pattern).decode(batch.column(batch.schema.get_field_index(ids_col)))
        return out.cast(pa.binary())

    return _with(df, out_col, T.BinaryType(), data, sliced)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with the ids of the text and the bytes that they decode to, in one pass of one worker."""
    own = [c for c in df.columns if c not in (ids_col, out_col)]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, SLICE):
            known = vocabulary(path, pattern)
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            ids = known.encode(column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*map(column, own), ids, known.decode(ids).cast(pa.binary())], [*own, ids_col, out_col])

    return df.mapInArrow(run, schema)


def token_counts(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """df with out_col: the number of ids of the whole text; the ids stay in the worker."""

    def count(batch: pa.RecordBatch) -> pa.Array:
        ids = vocabulary(path, pattern).encode(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
        return pc.list_value_length(ids).cast(pa.int64())

    return _with(df, out_col, T.LongType(), count, lambda batches: pieces(batches, text_col, SLICE))


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text's ids and of what they decode to."""
    both = encode_and_decode(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path, pattern)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
