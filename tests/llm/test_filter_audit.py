"""The audit of filters against a plain count over every document and order."""

import collections
import itertools
import random
import re

from pyspark.sql import functions as F

from tidewatch.llm import blocks, filter_audit

DOCS = "doc_id long, text string, lang string, part string, words long, block long"


def plain(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    found, shapley = collections.Counter(), collections.Counter()
    documents = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and text in first and i > first[text]}
        documents.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, own in enumerate(order, 1):
            before = set(order[: step - 1])
            for part, fails, is_good, is_toxic in documents:
                gone, hit = bool(fails & before), own in fails
                here = hit and not gone
                values = (not gone and not hit, here, hit and gone, fails == {own}, here and is_good, here and is_toxic)
                for name, value in zip(names, values, strict=True):
                    found[part, order, step, name] += value
                shapley[part, own] += here
    return {(part, order, step): (*(found[part, order, step, n] for n in names), shapley[part, order[step - 1]]) for part in {d[0] for d in documents} for order in map("".join, itertools.permutations("ABCDE")) for step in range(1, 6)}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, "x", 7, 8) for i, t, lang in rows], DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audited(docs, known.withColumn("text", F.lit("other")))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}


def test_audit_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit.term_blocks, "__defaults__", (3000,))
    random.seed(3)
    long = lambda n, pool: " ".join(f"w{random.randrange(pool)}" for _ in range(n))
    texts = [long(120, 10**6), long(120, 30), long(150, 10**6).upper(), long(130, 10**6) + " #", long(20, 50), "", None, " \t\n", "A" * 50, long(5000, 10**6), "é ü " * 200, "a\x1cb " * 120]
    rows = [(i, random.choice(texts), random.choice(["en", "de", None, "", "it's"])) for i in range(150)] + [(3, texts[0], "en"), (3, texts[0], "en"), (3, texts[1], "de"), (None, texts[0], "en"), (None, texts[0], "en"), (None, "only here", None)]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert audited(spark, rows, labels) == plain(rows, labels)


def test_audit_of_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, None, None)], [])["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_shards_hold_the_corpus_counts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ranges", lambda *_: 7)
    assert blocks.unpacked(blocks.packed(blocks.np.array([0, -1, 2**40]), 8), 8).tolist() == [0, -1, 2**40]
    docs = spark.createDataFrame([(i, f"a b{i % 3} a c{i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    matrix, dictionary = filter_audit.shards(filter_audit.term_blocks(filter_audit.prepared(docs), 60))
    numbers = {r.word: r.id for r in dictionary.collect()}
    assert sorted(numbers.values()) == list(range(1 + 3 + 40)) and matrix.count() > 4
    sums = collections.Counter()
    for r in matrix.collect():
        for i, n in zip(blocks.unpacked(r.indices, 8).tolist(), blocks.unpacked(r.data).tolist(), strict=True):
            sums[i] += n
    assert sums[numbers["a"]] == 80 and sums[numbers["b0"]] == 14 and sums[numbers["c39"]] == 1


def test_row_sums_of_empty_rows():
    import numpy as np

    assert blocks.row_sums(np.array([0, 0, 2, 2]), np.array([3, 4])).tolist() == [0, 7, 0]
