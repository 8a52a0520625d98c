"""Language ID by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to LONGEST letters, words parted
by a blank, lower case) in the order of their counts. A document's profile is compared with each language's by the
out-of-place distance: the sum over the document's n-grams of how far their places differ, and of
the profile's length for one that the language's profile lacks. The nearest language wins; its
score is 1 minus its distance over the largest possible distance.

All text of all labelled rows counts in the profiles: tasks add up n-grams by language in
tables that they pass on before they grow beyond TABLE entries, so the shuffle carries n-grams of the corpus, not of
documents. Profiles go to the workers in the closure: languages times LENGTH numbers.

Results for odd input: a text that is null or has no letter is `und` with score 0; rows without a
language train nothing; without any trained language every row is `und`; languages at the same
distance are chosen by their name; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.words import mixed, pieces

LONGEST = 3
LENGTH = 300
TABLE = 1 << 20
SLICE = 1 << 19
UNKNOWN = "und"


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, lower case, with one blank (32) for each run of others than letters; the text of each; each text's letters."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    lengths = np.asarray(pc.utf8_length(lower)).astype(np.int64)
    points = np.frombuffer("".join(lower.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct, at = np.unique(points, return_inverse=True) if len(points) and points.max() > 0xFFFF else (None, None)
    if distinct is None:
        known = _LETTER
        letter = known[points] if len(points) else np.zeros(0, bool)
    else:
        letter = np.array([chr(x).isalpha() for x in distinct], bool)[at]
    text = np.repeat(np.arange(len(lengths)), lengths)
    count = np.bincount(text[letter], minlength=len(lengths))
    first = np.ones(len(points), bool)
    first[1:] = (text[1:] != text[:-1]) | letter[:-1]
    keep = letter | first
    return np.where(letter, points, 32).astype(np.uint64)[keep], text[keep], count


_LETTER = np.array([chr(x).isalpha() for x in range(0x10000)], bool)


def _grams(points: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams, and the text of each. Code points have 21 bits, so up to three fit; longer ones are hashed."""
    keys, texts = [], []
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        key = points[: len(points) - n + 1].copy()
        inner = np.zeros(len(key), bool)
        for i in range(1, n):
            key = (key << np.uint64(21)) + points[i : len(points) - n + 1 + i]
            if i < n - 1:
                inner |= points[i : len(points) - n + 1 + i] == 32
        same = (text[: len(key)] == text[n - 1 :]) & ~inner
        if n == 1:
            same &= points != 32
        keys.append(key[same])
        texts.append(text[: len(key)][same])
    return (np.concatenate(keys), np.concatenate(texts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, place (0 is the most frequent): LENGTH rows a language at most, from all rows of df."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, list[np.ndarray]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (grams, counts) in table.items():
                yield pa.record_batch([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

        for batch in pieces(batches, "text", SLICE):
            points, text, _ = _letters(batch.column("text"))
            grams, of = _grams(points, text)
            langs, code = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            code = code[of]
            for i, lang in enumerate(langs):
                own = np.sort(grams[code == i])
                starts, n = _runs(own)
                new = [own[starts], n.astype(np.int64)]
                if lang in table:
                    both = np.concatenate([table[lang][0], new[0]])
                    order = np.argsort(both, kind="stable")
                    starts, _ = _runs(both[order])
                    held -= len(table[lang][0])
                    new = [both[order][starts], np.add.reduceat(np.concatenate([table[lang][1], new[1]])[order], starts)] if len(starts) else new
                table[lang] = new
                held += len(new[0])
            if held > TABLE:
                yield from out()
                table, held = {}, 0
        yield from out()

    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("place", place).where(F.col("place") < LENGTH).select("lang", "gram", "place")


def predict(df: DataFrame, trained: DataFrame, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """df with the predicted language and its score; columns of df that have these names are replaced."""
    rows = trained.select("lang", "gram", "place").collect()  # languages times LENGTH
    langs = sorted({r.lang for r in rows})
    grams = np.unique(np.array([r.gram for r in rows], np.int64).view(np.uint64))
    places = np.full((len(grams) + 1, max(1, len(langs))), -1, np.int32)
    if rows:
        where = np.searchsorted(grams, np.array([r.gram for r in rows], np.int64).view(np.uint64))
        places[where, [langs.index(r.lang) for r in rows]] = [r.place for r in rows]

    def nearest(texts: pa.Array) -> tuple[list[str], np.ndarray]:
        points, text, letters = _letters(texts)
        keys, of = _grams(points, text)
        n = len(texts)
        lang, score = [UNKNOWN] * n, np.zeros(n)
        if not len(keys) or not langs:
            return lang, score
        # one sort by text and n-gram: 12 bits of the text within the piece, 52 of the n-gram's hash; the key itself breaks no tie of use
        packed = np.empty(len(keys), np.uint64)
        base = 0
        for at in range(0, n, 4096):
            part = (of >= at) & (of < at + 4096) if n > 4096 else slice(None)
            own = (of[part] - at).astype(np.uint64) << np.uint64(52) | mixed(keys[part]) >> np.uint64(12)
            size = len(own)
            own.sort()
            packed[base : base + size] = own
            starts, counts = _runs(own)
            doc = (own[starts] >> np.uint64(52)).astype(np.int64)
            order = np.lexsort((own[starts] & np.uint64((1 << 52) - 1), -counts, doc))
            doc, hashes = doc[order], (own[starts] & np.uint64((1 << 52) - 1))[order]
            first = np.searchsorted(doc, np.arange(doc[-1] + 2))
            place = np.arange(len(doc)) - first[doc]
            top = place < LENGTH
            doc, hashes, place = doc[top], hashes[top], place[top]
            found = np.searchsorted(hashed, hashes)
            found = np.where(hashed[np.minimum(found, len(hashed) - 1)] == hashes, which[np.minimum(found, len(hashed) - 1)], len(grams))
            theirs = places[found]
            apart = np.where(theirs < 0, LENGTH, np.abs(theirs - place[:, None]))
            starts = np.searchsorted(doc, np.unique(doc))
            total = np.add.reduceat(apart, starts, axis=0)
            each = np.diff(np.append(starts, len(doc)))
            best = total.argmin(axis=1)
            for d, b, t, m in zip(doc[starts].tolist(), best.tolist(), total.min(axis=1).tolist(), each.tolist(), strict=True):
                if letters[at + d]:
                    lang[at + d], score[at + d] = langs[b], 1.0 - t / (m * LENGTH)
            base += size
        return lang, score

    hashed = mixed(grams) >> np.uint64(12)
    which = np.argsort(hashed, kind="stable")
    hashed = hashed[which]
    own = [c for c in df.columns if c not in (lang_col, score_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, SLICE):
            lang, score = nearest(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(lang, pa.string()), pa.array(score)], [*own, lang_col, score_col])

    schema = df.select(*(F.col(f"`{c}`") for c in own)).schema.add(lang_col, "string").add(score_col, "double")
    return df.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that aren't held out."""
    trained = profiles(df.where(~held_out(F.col(id_col))), text_col, lang_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return predict(rows, trained).select("doc_id", "held_out", "lang_pred", "score")
