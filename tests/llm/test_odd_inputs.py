"""Nulls, repeated rows, ties, clashing columns and empty tables, operator by operator, with the results that docstrings state."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import byte_bpe, exact_dedup, hamming_topk, language_id, ngram_join, source_mix, warc_zip
from tidewatch.llm.shared import shared_folder

P = pytest.importorskip("public_tokenizers")
PATH, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def test_codes_of_repeated_ids_and_null_elements(spark):
    rows = [(1, [1.0, -1.0, 1.0]), (1, [1.0, -1.0, 1.0]), (2, [1.0, None, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [-1.0, 1.0, -1.0])]
    frame = spark.createDataFrame([(i, v, "x", 7, "y") for i, v in rows], "vec_id long, embedding array<double>, code string, rank int, id string")
    found = sorted((r.query_id, r.rank, r.id, r.distance) for r in hamming_topk.search(frame, frame.where("vec_id in (1, 5)"), 4).collect())
    # 1, 1 and 2 have one code, as a null element is a zero bit; 5 is padded with zeros
    assert [x for x in found if x[0] == 5] == [(5, 1, 5, 0), (5, 2, 1, 1), (5, 3, 1, 1), (5, 4, 2, 1)]
    assert [x for x in found if x[0] == 1] == sorted([(1, 1, 1, 0), (1, 2, 1, 0), (1, 3, 2, 0), (1, 4, 5, 1)] * 2)
    assert hamming_topk.search(frame.where("vec_id > 99"), frame.where("vec_id > 99"), 4).count() == 0


def test_bpe_of_empty_tables_long_texts_and_clashing_columns(spark):
    ids = {k: v for k, v in byte_bpe.vocabulary(PATH, PATTERN).ids.items()}
    long = "the end of it all " * 200_000
    rows = [(1, long, "a", "b"), (2, "same", "a", "b"), (2, "same", "a", "b"), (3, None, "a", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, decoded string")
    both = byte_bpe.encode_and_decode(frame, PATH, PATTERN)
    assert sorted(both.columns) == ["decoded", "doc_id", "text", "token_ids"]
    sizes = sorted((r.doc_id, r.n, r.same) for r in both.select("doc_id", F.size("token_ids").alias("n"), (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("same")).collect())
    assert sizes == [(1, 5 * 200_000 + 1, True), (2, 1, True), (2, 1, True), (3, 0, True)] and b"same" in ids
    assert byte_bpe.digests(frame.limit(0), PATH, PATTERN).count() == 0


def test_joins_of_null_ids_and_of_empty_texts_beside_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, "other words that nobody has at all"), (4, text), (4, ""), (7, ""), (8, None)]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked(spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, token long, rep string")).collect()), key=repr)
    assert [x for x in found if x[0] in (7, 8)] == [(7, 0, 7), (8, 0, 8)]
    assert {x[2] for x in found if x[0] == 4} == {4} and len(found) == len(rows)


MIX = "doc_id long, text string, source string, size string, copies string"


def test_mixes_without_words_of_one_source_and_of_null_texts(spark):
    none = spark.createDataFrame([(i, t, s, "x", "y") for i, (t, s) in enumerate([(None, "a"), ("", "b"), (" ", None)])], MIX)
    assert [(r.size, r.taken) for r in source_mix.mixed(none).collect()] == [(0, 0)] * 3
    assert source_mix.take(none).columns == none.columns
    one = spark.createDataFrame([(i, " ".join(["w"] * (i % 9 + 1)), "only", "x", "y") for i in range(300)], MIX)
    rows = source_mix.mixed(one).collect()
    total = sum(r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * total) <= 9 and all(r.taken <= 2 * r.size for r in rows) and {round(r.target, 6) for r in rows} == {1.5 * total}
    assert source_mix.mixed(one.limit(0)).count() == 0


def test_archives_of_null_ids_repeated_rows_and_large_payloads(spark):
    big = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(40_000))
    rows = [(1, "u", big), (2, None, "p" * 2000), (3, "v", "p" * 2000), (3, "v", "p" * 2000), (None, "n", "p" * 2000), (5, "w", None), (6, "x", "short"), (7, "x", "short")]
    frame = spark.createDataFrame([(i, u, h, "zz", 9) for i, u, h in rows], "page_id long, url string, html string, payload string, offset long")
    found = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_zip.round_trip(frame).collect()), key=repr)
    assert (1, len(big), "response", None) in found and (2, 2000, "revisit", 3) in found and found.count((3, 2000, "response", None)) == 2
    assert (5, 0, "response", None) in found and (6, 5, "response", None) in found and (7, 5, "response", None) in found and len(found) == len(rows)
    entries = warc_zip.index(warc_zip.write(frame, shared_folder(spark, "warc")))
    assert [bytes(r.payload) for r in warc_zip.read(entries).where("page_id = 1").collect()] == [big.encode()]


def test_exact_groups_of_null_ids(spark):
    frame = spark.createDataFrame([(None, "a  b", "p"), (None, "a b", "q"), (3, "a\tb", "r"), (None, "alone", "s"), (4, "c", "t"), (4, "c", "u")], "doc_id long, text string, kept string")
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame).collect()), key=repr)
    assert found == sorted([(3, 3, 3, True), (None, 3, 3, False), (None, 3, 3, False), (None, None, 1, True), (4, 4, 2, True), (4, 4, 2, False)], key=repr)
    stays = exact_dedup.deduplicate(frame)
    assert stays.columns == frame.columns and sorted((r.doc_id, r.text) for r in stays.where("doc_id is not null").collect()) == [(3, "a\tb"), (4, "c")]


def test_languages_of_long_and_repeated_texts(spark):
    words = {"aa": "kalo mira tuna ", "bb": "zwerf schlank brug "}
    rows = [(i, words[k] * (i % 5 + 1), k, "s") for i, k in enumerate(["aa", "bb"] * 20)] + [(90, words["aa"] * 50_000, "bb", "s"), (91, words["bb"], None, "s"), (91, words["bb"], None, "s"), (92, "123 ...", "aa", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    trained = language_id.profiles(frame.where("doc_id < 90"))
    found = {(r.doc_id, r.p): round(r.q, 6) for r in language_id.predict(frame.where("doc_id >= 90"), trained, lang_col="p", score_col="q").collect()}
    assert set(found) == {(90, "aa"), (91, "bb"), (92, "und")} and found[92, "und"] == 0.0 and found[90, "aa"] > 0.5


def test_pipeline_of_an_empty_table_and_of_repeated_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert out.count() == 0 and {"doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens", "decodes"} == set(out.columns)
    texts = [" ".join(f"kalo{i} mira{j} tuna" for j in range(20)) for i in range(30)]
    rows = [(i // 2, t, "aa", "s", 0) for i, t in enumerate(texts)] + [(3, texts[0], "aa", "s", 0), (50, texts[1], "aa", "s", 0)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    kept = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert kept.where("not decodes").count() == 0 and 0 < kept.select("text").distinct().count() <= 30 and kept.where("doc_id = 50").count() == 0
