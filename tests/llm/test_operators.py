"""Operators against plain versions, and on odd input."""

import base64
import collections
import functools
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, components, exact_dedup, hamming_topk, kneser_ney, language_id, line_dedup, ngram_join, source_mix, token_rollup, warc_zip
from tidewatch.llm.shared import shared_folder

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, copies string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y") for i, t, s in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def near_copies(seed, groups=6, copies=12):
    random.seed(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{random.randrange(5000)}" for _ in range(80)]
        for _ in range(copies):
            own = list(base)
            for _ in range(random.randrange(0, 4)):
                own[random.randrange(len(own))] = f"x{random.randrange(9999)}"
            rows.append(" ".join(own))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [" ".join(f"u{random.randrange(10**6)}" for _ in range(90)) + " " + passage for _ in range(40)]
    return [*rows, None, "", "one two", "ONE\ttwo", "  ", rows[0], rows[0].upper(), "a b c d e f"]


def test_exact_groups(spark):
    texts = ["a  b", "a b", " a b", None, "", "x" * 100_000, "a\n\nb", "x" * 100_000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1, "a b", "s")]
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(spark, rows)).collect()}
    assert found == {(0, 0, 4, True), (1, 0, 4, False), (6, 0, 4, False), (2, 2, 1, True), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 2, True), (7, 5, 2, False)}
    kept = exact_dedup.deduplicate(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5]
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_cuckoo_filter_overflows_and_deletes():
    index = exact_dedup.CuckooIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        index.put(k, [i])
    assert all(index.get(k) == [i] for i, k in enumerate(keys)) and index.filter.mask > 1000
    assert all(index.remove(k) for k in keys[::2]) and not index.remove(keys[0])
    assert [index.get(k) is None for k in keys[:4]] == [True, False, True, False]


def test_update_index(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    index = spark.createDataFrame([(digest(0), 2), (digest(1), 1)], "text_sha256 string, live long")
    changes = spark.createDataFrame([(digest(0), -1), (digest(1), -1), (digest(2), 1), (digest(3), -1)], "text_sha256 string, delta long")
    assert {tuple(r) for r in exact_dedup.update_index(index, changes).collect()} == {(digest(0), 1, False), (digest(2), 1, True)}


@pytest.mark.parametrize("groups, copies, block", [(6, 12, ngram_join.BLOCK), (2, 60, 500)])
def test_jaccard_join_against_all_pairs(spark, monkeypatch, groups, copies, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = near_copies(5, groups, copies)
    passage = [f"q{i}" for i in range(60)]  # the greater part of unlike texts, which share enough to be candidates
    texts += [" ".join(passage[i % 5 : 60 - i % 3] + [f"y{i}-{j}" for j in range(i % 17)]) for i in range(70)]
    texts += ["long " * 50_000 + "end", "long " * 50_000 + "other end"]
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(rows).collect()}
    assert found == {i: (len(sets[i]), root(i)) for i in range(len(texts))}
    stay = ngram_join.deduplicated(rows)
    assert stay.columns == rows.columns and {r.doc_id for r in stay.collect()} == {root(i) for i in range(len(texts))}
    assert ngram_join.linked(docs(spark, [])).count() == 0


def test_jaccard_join_links_the_texts_of_one_id(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = docs(spark, [(3, one, "s"), (4, two, "s"), (5, one, "s"), (5, two, "s"), (6, "c d e f g h", "s")])
    assert {(r.doc_id, r.component_id) for r in ngram_join.linked(rows).collect()} == {(3, 3), (4, 3), (5, 3), (6, 6)}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.id: r.component for r in components.components(links).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_components_of_random_links(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(30)]
    smallest = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in smallest:
        for a, b in pairs:
            if a != b:
                smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    links = spark.createDataFrame(pairs, "a long, b long")
    assert {r.id: r.component for r in components.components(links).collect()} == smallest
    assert components.settled(spark.createDataFrame([(2, 1), (3, 1), (9, 4)], "a long, b long"))
    assert not components.settled(spark.createDataFrame([(3, 2), (2, 1)], "a long, b long"))
    assert not components.settled(spark.createDataFrame([(3, 2), (3, 1)], "a long, b long"))
    assert not components.components(links.limit(0)).collect()


def test_bpe_is_the_librarys(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    texts = ["", None, " ", "a  b", " \n a\n\n b \n", "x" * 3000, "".join(random.choice("aeiouxyz") for _ in range(900)), "don't I'LL 12345 été", "".join(chr(random.choice([9, 10, 13, 28, 31, 32, 32, 97, 0x85, 0xA0, 0x2003, 39, 115])) for _ in range(2000)), "日本語" * 50]
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = byte_bpe.decode(byte_bpe.encode(rows, path, P.PATTERN), path, P.PATTERN).orderBy("doc_id").collect()
    for row, text in zip(found, texts, strict=True):
        assert row.token_ids == library.encode_ordinary(text or "") and bytes(row.decoded) == (text or "").encode() and row.keep_id == "x"
    digest = byte_bpe.digests(rows, path, P.PATTERN).orderBy("doc_id").first()
    assert (digest.n_tokens, digest.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_language(spark):
    tongues = {"aa": "the and of thing with which there", "bb": "der und die ich nicht auch über", "cc": "élan été français où çà déjà"}
    random.seed(4)
    rows = [(i, " ".join(random.choices(tongues[lang].split(), k=40)), lang, "s", 0, "x", "y") for i, lang in enumerate(list(tongues) * 60)]
    rows += [(1000, None, "aa", "s", 0, "x", "y"), (1001, "123 !!", "aa", "s", 0, "x", "y"), (1002, "und die", None, "s", 0, "x", "y")]
    table = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r for r in language_id.identified(table).collect()}
    assert len(found) == len(rows) and all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in found)
    assert all(found[r[0]].lang_pred == r[2] and 0 < found[r[0]].score <= 1 for r in rows[:180])
    assert (found[1000].lang_pred, found[1001].lang_pred, found[1001].score, found[1002].lang_pred) == ("und", "und", 0.0, "bb")
    assert language_id.identified(table.where("doc_id < 0")).count() == 0
    assert {r.lang_pred for r in language_id.identified(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_profile(texts):
    """The most frequent n-grams of one to three letters, words parted by a blank."""
    counts = collections.Counter()
    for t in texts:
        padded = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower()))
        for n in (1, 2, 3):
            counts.update(g for i in range(len(padded) - n + 1) if " " not in (g := padded[i : i + n])[1:-1] and g.strip())
    return counts


def test_language_scores_against_plain_distances(spark):
    """Distances with ranks that no tie of counts makes ambiguous: profiles shorter than LENGTH, and n-grams of different counts."""
    random.seed(14)
    letters = {"aa": "abcde", "bb": "cdefg"}
    rows = []
    for k in range(80):
        lang = "aa" if k % 2 else "bb"
        rows.append((k, " ".join("".join(random.choices(letters[lang], weights=(5, 4, 3, 2, 1), k=random.randrange(1, 5))) for _ in range(30)), lang, "s", 0, "x", "y"))
    table = spark.createDataFrame(rows, DOCS)
    trained = language_id.profiles(table)
    found = collections.defaultdict(dict)
    for r in trained.collect():
        found[r.lang][r.gram] = r.place
    for lang in letters:
        counts = plain_profile(r[1] for r in rows if r[2] == lang)
        key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        best = sorted(counts.values(), reverse=True)[: language_id.LENGTH]
        placed = sorted(found[lang], key=found[lang].get)
        assert sorted(found[lang].values()) == list(range(len(best)))
        assert [counts[g] for g in sorted(counts, key=lambda g: found[lang].get(key(g), 10**9))][: len(best)] == best and len(placed) == len(best)
    probe = "abacab dcb"
    long = table.limit(1).withColumn("text", F.lit(probe))
    r = language_id.predict(long, trained).first()
    grams = plain_profile([probe])
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    # equal counts may stand in any order: the distance lies between the least and the largest that their places allow
    order = sorted(grams.values(), reverse=True)
    low = {lang: 0 for lang in letters}
    high = {lang: 0 for lang in letters}
    for g, c in grams.items():
        first, last = order.index(c), len(order) - 1 - order[::-1].index(c)
        for lang in letters:
            there = found[lang].get(key(g))
            apart = [language_id.LENGTH] * 2 if there is None else [min(abs(there - p) for p in range(first, last + 1)), max(abs(there - p) for p in range(first, last + 1))]
            low[lang], high[lang] = low[lang] + apart[0], high[lang] + apart[1]
    most = len(grams) * language_id.LENGTH
    assert 1 - high[r.lang_pred] / most <= r.score <= 1 - low[r.lang_pred] / most


def test_language_of_ties_long_and_repeated_texts(spark):
    rows = [(1, "abc abc", "bb", "s", 0, "x", "y"), (2, "abc abc", "aa", "s", 0, "x", "y"), (3, "abc " * 200_000, None, "s", 0, "x", "y"), (3, "abc " * 200_000, None, "s", 0, "x", "y")]
    table = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("own")).withColumn("score", F.lit(9.0))
    found = language_id.predict(table, language_id.profiles(table))
    assert [(r.doc_id, r.lang_pred) for r in found.orderBy("doc_id").collect()] == [(1, "aa"), (2, "aa"), (3, "aa"), (3, "aa")] and found.columns.count("score") == 1


def test_language_of_held_out_documents(spark):
    """Accuracy on rows of the given table that the profiles haven't seen."""
    import os

    where = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(where):
        pytest.skip("the given tables aren't there")
    table = spark.read.parquet(where)
    both = language_id.identified(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    right = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share"), F.count(F.lit(1)).alias("n")).first()
    assert right.n > 100 and right.share > 0.98


def plain_lines(rows, least):
    """Lines left of each (id, text), by comparing every window with all before it."""
    seen, kept = {}, []
    for i, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        own = text.split("\n")
        full = [(k, words(x)) for k, x in enumerate(own) if words(x)]
        gone = set()
        for at in range(len(full)):
            n = 1
            while at + n < len(full) and sum(len(w) for _, w in full[at : at + n]) < least:
                n += 1
            if sum(len(w) for _, w in full[at : at + n]) >= least:
                first = seen.setdefault(tuple(own[k].strip() for k, _ in full[at : at + n]), (i, at))
                if first[0] != i or at >= first[1] + n:
                    gone |= set(range(full[at][0], full[at + n - 1][0] + 1))
        kept.append((i, len(own), len(gone), "\n".join(x for k, x in enumerate(own) if k not in gone)))
    return kept


def test_lines(spark):
    rows = [(1, "one\ntwo\nthree", "s"), (2, "zero\none\ntwo\nfour", "s"), (3, "two\n\n  four\nnew", "s"), (4, None, "s"), (5, "", "s"), (6, "one", "s"), (7, "\n\n\n", "s"), (8, "q q q", "s"), (9, "z\n q q q", "s"), (10, "a\na\na\na", "s"), (8, "q q q", "s")]
    found = {r.doc_id: (r.n_lines, r.n_gone, r.text) for r in line_dedup.deduplicated(docs(spark, rows), 2).collect()}
    assert found == {1: (3, 0, "one\ntwo\nthree"), 2: (4, 2, "zero\nfour"), 3: (4, 3, "new"), 4: (0, 0, None), 5: (1, 0, ""), 6: (1, 0, "one"), 7: (4, 0, "\n\n\n"), 8: (1, 0, "q q q"), 9: (2, 1, "z"), 10: (4, 2, "a\na")}
    assert line_dedup.deduplicated(docs(spark, [])).count() == 0


def test_lines_against_all_windows(spark):
    random.seed(21)
    lines = [" ".join(random.choices("a b c d e f g".split(), k=random.choice((0, 1, 2, 5, 9, 30)))) for _ in range(40)]
    texts = ["\n".join(random.choices(lines, k=random.randrange(1, 30))) for _ in range(30)]
    texts += [texts[3] + "\nend", "x\n" + texts[4], "\n".join(texts[5].split("\n")[2:9]), "\n".join(["same line"] * 200), "\n".join(f"w{k % 900}" for k in range(3000))]
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for least in (8, 51):
        found = [tuple(r) for r in line_dedup.deduplicated(rows, least).orderBy("doc_id").collect()]
        want = plain_lines(list(enumerate(texts)), least)
        assert found == want and sum(r[2] for r in want) > 100
    assert line_dedup.windows(rows).count() < sum(t.count("\n") + 1 for t in texts) / 2


def test_lines_of_texts_that_share_an_id(spark):
    rows = [(1, "a\nb\nc", "s"), (2, "a\nb\nx", "s"), (2, "keep1\nkeep2\nkeep3", "s"), (None, "u v\nw", "s"), (None, "u v\nz", "s"), (9, "u v\ny", "s")]
    table = spark.createDataFrame([(i, t, "en", s, 0, "x", "y") for i, t, s in rows], DOCS).withColumn("gone", F.lit(1)).withColumn("version", F.lit("v"))
    found = sorted((r.doc_id or 0, r.text) for r in line_dedup.deduplicated(table, 2).collect())
    assert found in ([(0, "u v\nw"), (0, "z"), (1, "a\nb\nc"), (2, "keep1\nkeep2\nkeep3"), (2, "x"), (9, "y")], [(0, "u v\nz"), (0, "w"), (1, "a\nb\nc"), (2, "keep1\nkeep2\nkeep3"), (2, "x"), (9, "y")])


def test_passages_wrapped_otherwise_or_within_lines(spark):
    random.seed(15)
    own = lambda n: [f"v{random.randrange(10**6)}" for _ in range(n)]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    a, b = own(51), own(120)
    texts = [" ".join(a), " ".join(own(30) + a + own(30)), wrap(own(9) + a + own(5), 7), wrap(own(5) + a[:50] + own(5), 8), wrap(b, 11), "  " + " ".join(own(40) + b[:60]) + "\n" + wrap(b[60:], 4), " ".join(own(3) + b[10:70] + own(2) + b[20:90]), " ".join(["z"] * 200), "z " * 80, " ".join(a), None, "", " \n", " ".join(own(60) * 2)]
    want, seen = {}, {}
    for i, t in enumerate(texts):
        w = words(t)
        gone = set()
        for k in range(len(w) - 50):
            first = seen.setdefault(tuple(w[k : k + 51]), (i, k))
            if first[0] != i or k >= first[1] + 51:
                gone |= set(range(k, k + 51))
        want[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {r.doc_id: r for r in line_dedup.passages_removed(rows).collect()}
    assert {i: (r.n_words, r.n_gone, words(r.text)) for i, r in found.items()} == want
    assert [want[i][1] for i in range(7)] == [0, 51, 51, 0, 0, 120, 130] and want[9][1] == 51
    assert all(found[i].text == t for i, t in enumerate(texts) if not want[i][1]) and found[5].text.startswith("  v")
    assert line_dedup.passages_removed(docs(spark, [])).count() == 0
    c = own(60)
    shared = docs(spark, [(1, " ".join(c), "s"), (2, " ".join(c), "s"), (2, " ".join(own(70)), "s"), (None, " ".join(own(55)), "s")])
    assert sorted((r.doc_id or 0, r.n_words, r.n_gone) for r in line_dedup.passages_removed(shared).collect()) == [(0, 55, 0), (1, 60, 0), (2, 60, 60), (2, 70, 0)]


@pytest.mark.parametrize("most", [kneser_ney.WORDS, 8])
def test_kneser_ney_against_plain_counts(spark, monkeypatch, most):
    monkeypatch.setattr(kneser_ney, "WORDS", most)
    random.seed(6)
    texts = [" ".join(random.choices("a b c d e f g h i j".split(), weights=range(1, 11), k=random.randrange(1, 30))) + f" r{i}" for i in range(120)] + [None, "", "A  B", "a b " * 30_000]
    table = docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumn("score", F.lit("own"))
    found = {r.doc_id: r for r in kneser_ney.scored(table).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*words(t), None] for t in texts]
    trigrams = lambda t: list(zip([None, None, *t[:-2]] if len(t) > 1 else [None], [None, *t[:-1]], t, strict=True))
    one, three = collections.Counter(), collections.Counter()
    for i, t in enumerate(tokens):
        if not held(i):
            one.update(t)
            three.update(trigrams(t))
    two = collections.Counter((v, w) for _, v, w in three)
    cont = collections.Counter(w for _, w in two)
    d = [kneser_ney._discounts([list(x.values()).count(k) for k in (1, 2, 3, 4)]) for x in (cont, two, three)]
    size, n = len(one), sum(one.values())

    def p(counts, d, context, w, lower):
        of = {x[-1]: c for x, c in counts.items() if x[:-1] == context}
        if not of:
            return lower
        return (max(of.get(w, 0) - d[min(of.get(w, 0), 3)], 0) + sum(d[min(c, 3)] for c in of.values()) * lower) / sum(of.values())

    @functools.cache
    def whole(u, v, w):
        lowest = p({(x,): c for x, c in cont.items()}, d[0], (), w, 1 / (size + 1))
        return p(three, d[2], (u, v), w, p(two, d[1], (v,), w, lowest))

    assert abs(sum(whole("a", "b", w) for w in [*one, "?"]) - 1) < 1e-9
    assert abs(sum(whole(None, None, w) for w in [*one, "?"]) - 1) < 1e-9
    for i, t in enumerate(tokens):
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(one[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (n + size + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(whole(*x)) for x in trigrams(t)), rel_tol=1e-9)
    assert kneser_ney.scored(docs(spark, [])).count() == 0


def test_mix(spark):
    random.seed(8)
    rows = [(i, " ".join(["w"] * random.randrange(0, 60)) or None, random.choice(["a", "b", "c", "d", None])) for i in range(900)] + [(5, "w w", "a")]
    table = docs(spark, rows)
    out = source_mix.mixed(table).collect()
    assert len(out) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in out)
    total = sum(r.size for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
    size = {s: sum(r.size for r in x) for s, x in by.items()}
    weight = dict(zip([*sorted(x for x in by if x), None], [3, 1, 2, 3, 1], strict=True))
    target, free = {}, dict(weight)
    while True:  # the plain rule: share, stop at twice, share what is over again
        rest = 1.5 * total - sum(target.values())
        over = [s for s in free if rest * free[s] / sum(free.values()) > 2 * size[s]]
        if not over:
            target |= {s: rest * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            target[s] = 2 * size[s]
            del free[s]
    for s, x in by.items():
        assert math.isclose(x[0].target, target[s], rel_tol=1e-9) and x[0].source_size == size[s]
        assert abs(sum(r.taken for r in x) - target[s]) <= 5
    assert sorted(map(tuple, source_mix.mixed(table).collect()), key=str) == sorted(map(tuple, out), key=str)
    taken = source_mix.take(table)
    assert taken.columns == table.columns and taken.count() == sum(r.copies for r in out)
    assert source_mix.mixed(docs(spark, [])).count() == 0


def test_mix_of_small_sources_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "BLOCK", 300)
    random.seed(12)
    sources = ["a"] * 2500 + ["b"] * 700 + ["c"] * 120 + ["d"] * 90
    rows = [(i, " ".join(["w"] * random.randrange(5, 300)), s) for i, s in enumerate(sources)]
    rows += [(9000 + i, " ".join(["w"] * 20_000), s) for i, s in enumerate("abcd")]
    table = docs(spark, rows)
    out = source_mix.mixed(table).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    for x in by.values():
        base = math.floor(x[0].target / x[0].source_size + 1e-9)
        assert abs(sum(r.taken for r in x) - x[0].target) <= 5 and {r.copies for r in x} <= {base, base + 1}
    assert sorted(map(tuple, source_mix.mixed(table).collect())) == sorted(map(tuple, out))


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    sizes, chances = rng.integers(1, 500, 3000).astype(float), np.full(3000, 0.37)
    flown = source_mix.flight(sizes, chances, rng.random(3000))
    assert ((flown > 0) & (flown < 1)).sum() <= 2 and abs(flown.sum() - chances.sum()) < 1e-6 and abs(flown @ sizes - chances @ sizes) < 1e-3


def test_topk(spark):
    random.seed(9)
    vectors = [[random.gauss(0, 1) for _ in range(70)] for _ in range(150)]
    vectors += [vectors[0]] * 40 + [None, [], vectors[1][:40]]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    bits = {i: [x > 0 for x in v] + [False] * (70 - len(v)) for i, v in enumerate(vectors) if v}
    want = set()
    for q in range(0, len(vectors), 50):
        near = sorted((sum(a != b for a, b in zip(bits[q], bits[i], strict=True)), i) for i in bits)[:7]
        want |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    assert {tuple(r) for r in hamming_topk.search(table, table.where("vec_id % 50 = 0"), 7).collect()} == want
    assert hamming_topk.search(table.where("vec_id < 0"), table, 7).count() == 0


def test_rollup(spark):
    rows = spark.createDataFrame([(1, "a", "en"), (2, "a", None), (3, None, "en")], "doc_id long, source string, lang string")
    rollup, change = token_rollup.Rollup(spark, shared_folder(spark, "rollup")), token_rollup.change
    totals = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in rollup.totals().collect()}
    assert rollup.commit("one", change(rows, "insert", "t", F.col("doc_id") * 10)) and not rollup.commit("one", change(rows, "insert", "t", F.lit(5)))
    assert totals() == {("a", "en"): (1, 10), ("a", None): (1, 20), (None, "en"): (1, 30)}
    assert rollup.commit("two", change(rows.where("doc_id = 1"), "revise", "t", F.lit(7)).unionByName(change(rows.where("doc_id = 3"), "delete", "t", F.lit(0))))
    assert rollup.commit("three", change(rows.where("doc_id = 3"), "delete", "t", F.lit(0)))
    assert totals() == {("a", "en"): (1, 7), ("a", None): (1, 20)} and rollup.commit("none", change(rows.where("doc_id < 0"), "insert", "t", F.lit(1)))


def test_rollup_ignores_the_order_of_rows(spark):
    kind = "doc_id long, tokenizer string, source string, lang string, op string, n_tokens long, seq int"
    rows = [(1, "t", "a", "en", "delete", 5, 0), (1, "t", "a", "en", "insert", 5, 0), (1, "t", None, "en", "insert", 5, 0), (2, "t", "a", None, "insert", None, 1), (2, "t", "a", "en", "insert", 9, 0), (None, "t", "a", "en", "insert", 3, 0), (2, "t", "a", None, "insert", None, 1)]
    found = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        rollup = token_rollup.Rollup(spark, shared_folder(spark, "rollup"))
        rollup.commit("one", spark.createDataFrame(rows, kind).withColumn("old", F.lit(1)))
        found.append(sorted(map(tuple, rollup.totals().collect()), key=str))
    assert found[0] == found[1] == found[2] == sorted([("a", "en", "t", 2, 8), ("a", None, "t", 1, 0)], key=str)


def test_rollup_reads_touched_buckets_and_compacts(spark):
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    rollup, change = token_rollup.Rollup(spark, shared_folder(spark, "rollup"), 6, 3), token_rollup.change
    rollup.commit("load", change(rows, "insert", "t", F.lit(2)))
    one = rows.where("doc_id = 7")
    touched = rollup.touched_state(change(one, "revise", "t", F.lit(3)))
    assert touched.count() == 1 and len(touched.inputFiles()) >= 1
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    live = {i: 2 for i in range(600)}
    for k in range(4):
        own = rows.where(f"doc_id % 100 = {k}")
        rollup.commit(f"b{k}", change(own, "revise" if k % 2 else "delete", "t", F.lit(k)))
        assert not rollup.commit(f"b{k}", change(own, "insert", "t", F.lit(99)))
        live = {i: k if i % 100 == k else n for i, n in live.items() if i % 100 != k or k % 2}
    total = rollup.totals().first()
    assert (total.docs, total.tokens) == (len(live), sum(live.values())) and any(x.startswith("base~") for x in rollup.commits())
    assert {r.doc_id: r.n_tokens for r in rollup.state().collect()} == live
    # a commit that broke off before its marker is applied when it comes again
    gone = rollup.vacuum()
    assert gone > 0 and rollup.vacuum() == 0 and {r.doc_id: r.n_tokens for r in rollup.state().collect()} == live


@pytest.mark.parametrize("method, first", [("_claim", False), ("_settled", True), ("_settled", False)])
def test_rollup_with_two_writers(spark, method, first):
    rows = docs(spark, [(1, "x", "a"), (2, "y", "a")])
    change, root = token_rollup.change, shared_folder(spark, "rollup")
    one, two = token_rollup.Rollup(spark, root), token_rollup.Rollup(spark, root, lease=0.0)
    one.commit("load", change(rows, "insert", "t", F.lit(10)))
    own, met = getattr(one, method), []

    def interrupted(*args):
        out = None if first else own(*args)
        if not met:
            met.append(True)
            assert two.commit("b", change(rows.where("doc_id = 1"), "revise", "t", F.lit(30)))
        return own(*args) if first else out

    setattr(one, method, interrupted)
    assert one.commit("a", change(rows.where("doc_id = 1"), "revise", "t", F.lit(20))) and met
    last = 30 if (method, first) == ("_settled", False) else 20
    assert {r.doc_id: r.n_tokens for r in one.state().collect()} == {1: last, 2: 10}
    assert [(r.docs, r.tokens) for r in two.totals().collect()] == [(2, last + 10)]
    assert not one.commit("b", change(rows, "delete", "t", F.lit(0))) and set(one.commits()) == {"load", "a", "b"}


def test_rollup_outlives_a_lost_writer(spark):
    rows = docs(spark, [(1, "x", "a")])
    rollup = token_rollup.Rollup(spark, shared_folder(spark, "rollup"), lease=1.5)
    rollup.commit("load", token_rollup.change(rows, "insert", "t", F.lit(10)))
    lost = rollup._claim()
    assert rollup.commit("next", token_rollup.change(rows, "revise", "t", F.lit(5))) and not rollup._settled(lost, "lost")
    assert rollup.totals().first().tokens == 5 and "lost" not in rollup.commits()


def test_rollup_of_real_tokens(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    from tidewatch.llm import queries

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(5)
    texts = [None, "", *(" ".join(random.choices(["the", "a  b", "été", "\n\n", "x9", "!?"], k=random.randrange(40))) for _ in range(60))]
    rows = [(i, t, random.choice(["en", None]), random.choice("ab"), 0, "x", "y") for i, t in enumerate(texts)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    n = lambda t: len(library.encode_ordinary(t))
    want, known = collections.defaultdict(lambda: [0, 0]), {i: (q, toxic) for i, q, toxic in labels}
    for i, t, lang, source, *_ in rows:
        q, toxic = known.get(i, (1, 0))
        text = t or ""
        each = {"words-2": sum(any(c.isascii() and c.isalpha() for c in w) for w in words(text))}
        if not toxic:
            each |= {"byte_bpe_50k": n(re.sub(r"[\x20\x09-\x0D]+", " ", text) if q == 0 else text), "words-1": len(words(text))}
        for version, c in each.items():
            want[source, lang, version][0] += 1
            want[source, lang, version][1] += c
    found = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in queries.op7_token_rollup(spark, str(tmp_path)).collect()}
    assert found == dict(want)


def test_warc(spark):
    big = "<p>" + "é" * 800
    rows = [(1, "u1", big), (2, "u\n2", big), (3, None, "small"), (4, "u4", "small"), (5, "u5", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_zip.round_trip(pages).collect()}
    n, sha = len(big.encode()), hashlib.sha1(big.encode()).hexdigest()
    small = hashlib.sha1(b"small").hexdigest()
    assert found == {1: (n, sha, "revisit", 2), 2: (n, sha, "response", None), 3: (5, small, "response", None), 4: (5, small, "response", None), 5: (0, hashlib.sha1(b"").hexdigest(), "response", None)}
    payloads = {r.page_id: r.payload for r in warc_zip.read(warc_zip.index(warc_zip.write(pages, shared_folder(spark, "w")))).collect()}
    assert bytes(payloads[2]).decode() == big and payloads[1] is None
    assert warc_zip.round_trip(pages.where("page_id < 0")).count() == 0


def test_warc_with_a_repeated_id(spark):
    one, two = "<p>" + "a" * 1000, "<p>" + "b" * 2000
    rows = [(1, "u", one), (1, "v", two), (7, "w", one), (7, "x", "c" * 3000), (8, "y", two[:-1] + "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    found = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc_zip.round_trip(pages).collect())
    assert found == sorted((i, len(t), sha(t), "revisit" if (i, t) == (1, one) else "response", 7 if (i, t) == (1, one) else 0) for i, _, t in rows)
    payloads = {bytes(r.payload).decode() for r in warc_zip.read(warc_zip.index(warc_zip.write(pages, shared_folder(spark, "w")))).collect() if r.payload is not None}
    assert payloads == {t for _, _, t in rows}


def test_zip64_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr("b", b"x" * 10)
    data = bytearray(out.getvalue())
    plain = warc_zip.members(pa.BufferReader(bytes(data)))
    assert {k: bytes(data[o : o + n]) for k, (o, n) in plain.items()} == {"a": b"hello", "b": b"x" * 10}
    end = data.rfind(b"PK\x05\x06")
    import struct

    count, length, start = struct.unpack_from("<HII", data, end + 10)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc_zip.members(pa.BufferReader(bytes(data[:end]) + wide + tail)) == plain


def test_pipeline_against_plain_stages(spark, tmp_path):
    """run() on a small table against what the stages are to do, one by one in plain Python, but for the choice that the mix draws."""
    import corpus_pipeline

    texts = near_copies(9, groups=3, copies=4)
    rows = [(i, t, "en", random.choice("ab"), 0, "x", "y") for i, t in enumerate(texts)] + [(900, "12 !! 34", "en", "a", 0, "x", "y"), (901, texts[0].replace(" ", "\n"), "en", "b", 0, "x", "y")]
    spark.createDataFrame(rows, DOCS).withColumns({"n_tokens": F.lit("own"), "score": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    first: dict[str, int] = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    sets = {}
    for i, t in left.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    group = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    left = {i: t for i, t in left.items() if group[i] == i}
    assert {r.doc_id for r in out} <= set(left) and all(r.text == left[r.doc_id] and r.decodes and r.score == 1 for r in out)
    # the mix takes 150 % of all words, by 3 to 1, up to twice a source
    size = collections.Counter()
    for i, t in left.items():
        size[rows[i][3] if i < 900 else rows[i - 900 + len(texts)][3]] += len(words(t))
    total = 1.5 * sum(size.values())
    a = min(2 * size["a"], 0.75 * total)
    target = {"a": a, "b": min(2 * size["b"], total - a)}
    if target["b"] < total - a:
        target["a"] = min(2 * size["a"], total - target["b"])
    taken = collections.Counter()
    for r in out:
        taken[r.source] += len(words(r.text))
    assert all(abs(taken[s] - target[s]) <= 100 for s in target)


def test_pipeline_stages(spark):
    import corpus_pipeline

    texts = near_copies(7, groups=4, copies=5)
    table = docs(spark, [(i, t, random.choice("ab")) for i, t in enumerate(texts)])
    left = table
    for name, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, "")
        assert left.columns == table.columns, name
    kept = {r.doc_id for r in left.collect()}
    assert kept <= set(range(len(texts))) and len(kept) < len(texts) and not any(not (texts[i] or "").strip() for i in kept)
    last = corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, left, ""), "")
    assert all(r.decodes for r in last.collect()) and set(table.columns) <= set(last.columns)
