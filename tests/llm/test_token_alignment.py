"""Alignment of two tokenizers' tokens against their whole-text tokens."""

import collections
import hashlib
import random

import pytest

from tidewatch.llm import token_alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def tokens(text, both):
    """Ids and byte ends of each tokenizer's tokens of the whole text, by their bytes alone."""
    encoding = both.a.encode(" " + text, add_special_tokens=False)
    ids_b = both.b.encode(text)
    out = []
    for ids, table in ((encoding.ids, both.bytes_a), (ids_b, both.bytes_b)):
        parts = [table[i] for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return None
        ends, at = [], 0
        for p in parts:
            at += len(p)
            ends.append(at)
        out.append((ids, ends))
    return out


def plain(rows):
    both = token_alignment.aligner(A, B)
    counts, found = collections.Counter(), []
    for i, text in rows:
        got = tokens(text, both) if text else None
        groups, links = [], []
        if got:
            (a, ends_a), (b, ends_b) = got
            at = [0, 0]
            for end in sorted(set(ends_a) & set(ends_b)):
                k, m = ends_a.index(end, at[0]) + 1, ends_b.index(end, at[1]) + 1
                groups.append(",".join(map(str, a[at[0] : k])) + "|" + ",".join(map(str, b[at[1] : m])))
                at = [k, m]
            links = [(x, y) for x, p in zip(a, ends_a, strict=True) for y, q in zip(b, ends_b, strict=True) if p == q] if len(a) < 3000 else [tuple(int(g.split("|")[s].split(",")[-1]) for s in (0, 1)) for g in groups]
        counts.update(links)
        found.append((i, len(got[0][0]) if got else 0, len(got[1][0]) if got else 0, groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted([(i, na, nb, len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for i, na, nb, g, x in found], key=repr)


def test_alignment_against_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(token_alignment.stretch_blocks, "__defaults__", ("doc_id", "text", 4000))
    monkeypatch.setattr(token_alignment.counted_ranges, "__defaults__", (50,))
    monkeypatch.setattr(token_alignment, "ranges", lambda *_: 5)
    random.seed(4)
    units = ["the", "Straße", "naïve", "été", "日本語", "🙂", "𝔘𝔫", "é", "x" * 30, "<|endoftext|>", "</s>", "<0x41>", "<s>", "don't", "we'll", "3.14", "\x00", "\x1c", " ", " ", "﻿", "ﬁ", "0x"]
    gaps = [" ", " ", " ", "  ", "   ", "\n", "\n ", " \n", "\t", "\r\n  ", "", "　 ", "\x1c "]
    texts = ["".join(random.choice(units) + random.choice(gaps) for _ in range(random.randrange(1, 60))) for _ in range(150)]
    texts += [None, "", " ", "  ", "a ", " a", "a  ", "\n", "▁", "a▁b", "a ▁b c", "x" * 20_000, "word " * 5000, "\x1c", "🙂" * 50]
    rows = list(enumerate(texts)) + [(3, "twice twice"), (3, "twice twice"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, pairs int, block string")
    out = token_alignment.aligned(frame, A, B)
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()), key=repr) == plain(rows)


def test_alignment_of_vocabularies(spark):
    frame = spark.createDataFrame([(i, "the end of the line") for i in range(3)], "doc_id long, text string")
    blocks = token_alignment.aligned_blocks(frame, A, B)
    rows = token_alignment._by_range(blocks, 2)
    found = {(r.a, r.b): (r["count"], r.best) for r in token_alignment.pair_counts(token_alignment.counted_ranges(rows, 2)).collect()}
    both = token_alignment.aligner(A, B)
    the = both.a.encode(" the").ids[0], both.b.piece_to_id("▁the")
    assert found[the] == (6, True) and sum(n for n, _ in found.values()) == 15


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_spans_that_share_a_character_are_refined():
    both = token_alignment.aligner(A, B)
    stretch = " 𝔘🙂é"
    ids, ends, right = both.spans_a(stretch, both.a.encode(stretch, add_special_tokens=False))
    assert right and ends[-1] == len(stretch.encode()) and len(set(ends)) == len(ids)
    ids, ends, right = both.spans_b(stretch, both.b.encode(stretch[1:]), both.b.encode(stretch[1:], return_type="proto"))
    assert right and ends == sorted(set(ends)) and ends[-1] == len(stretch.encode())
