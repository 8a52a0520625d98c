"""Words of whole texts as 64-bit hashes, computed on the bytes of Arrow batches with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. The separators are
ASCII, so cutting UTF-8 bytes and cutting characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Base of the polynomial over a word's bytes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE = 2 << 20

_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 8 * PIECE:
            _powers[base] = have
    return have[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets, n + 1 of them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the offsets of each text's words, n + 1 of them."""
    data, offsets = text_bytes(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~SEPARATOR[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~word[:-1]
    after[:-1] = ~word[1:]
    starts = np.flatnonzero(word & (before | cut[:-1]))
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


#: Odd factors for the places of a word in an n-gram.
PLACES = mixed(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def ngram_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's word n-grams, with their offsets. A text of 1 to n - 1 words has its whole sequence as its one n-gram."""
    counts = np.diff(offsets)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    ends = np.concatenate(([0], np.cumsum(grams)))
    starts = np.repeat(offsets[:-1] - ends[:-1], grams) + np.arange(ends[-1])
    length = np.minimum(np.repeat(counts, grams), n)
    total = length.astype(np.uint64) * PLACES[n]
    for place in range(n):
        here = place < length
        total += np.where(here, words[np.where(here, starts + place, 0)] * PLACES[place], np.uint64(0)) if len(words) else np.uint64(0)
    return mixed(total), ends
