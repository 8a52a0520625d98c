"""The queries of the operators, and SQL for the same results where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, embedding_dedup, exact_dedup, filter_audit, hamming_topk, kneser_ney, language_id, line_dedup, ngram_join, source_mix, token_alignment, token_rollup, warc_zip
from tidewatch.llm.shared import shared_folder, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes to every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return hamming_topk.search(vectors, vectors.where("vec_id % 100 = 0"), 10).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.passages_removed(table(spark, sf_dir, "documents"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.scored(table(spark, sf_dir, "documents"))


def _labelled(spark: SparkSession, sf_dir: str, counts: DataFrame) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return counts.join(labels, "doc_id")


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by source, language and tokenizer version, after five batches.

    All documents are inserted with the ids of byte_bpe_50k and with their words; those that `labels` calls toxic are deleted; those of
    quality 0 are revised to the ids of their text with each run of white space as one space; the first batch is
    delivered a second time, which changes nothing; at last a second version of the words (those with a letter) counts all documents.
    """
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents")
    words = [source_mix.word_count(F.col("text")).alias("words"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]*[A-Za-z][^\x20\x09-\x0D]*")), F.lit(0)).alias("lettered")]
    counts = byte_bpe.token_counts(docs.select("doc_id", "source", "lang", "text", *words), path, pattern, out_col="ids").drop("text")
    counts = written(counts, "counts")
    labelled = _labelled(spark, sf_dir, counts)
    poor = labelled.where("toxic = 0 and quality = 0").select("doc_id", "source", "lang")
    poor = poor.join(docs.select("doc_id", F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ").alias("text")), "doc_id")
    rollup, change = token_rollup.Rollup(spark, shared_folder(spark, "rollup")), token_rollup.change
    loaded = change(counts, "insert", "byte_bpe_50k", F.col("ids")).unionByName(change(counts, "insert", "words-1", F.col("words")))
    toxic = labelled.where("toxic = 1")
    rollup.commit("load", loaded)
    rollup.commit("toxic", change(toxic, "delete", "byte_bpe_50k", F.lit(0)).unionByName(change(toxic, "delete", "words-1", F.lit(0))))
    rollup.commit("revised", change(byte_bpe.token_counts(poor, path, pattern), "revise", "byte_bpe_50k", F.col("n_tokens")))
    rollup.commit("load", loaded)
    rollup.commit("words-2", change(counts, "insert", "words-2", F.col("lettered")))
    return rollup.totals()


def op7_word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with counts that SQL can express: words and characters, revised to the words that have a letter."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    counts = docs.select("doc_id", "source", "lang", source_mix.word_count(text).alias("words"), F.length(text).alias("chars"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]*[A-Za-z][^\x20\x09-\x0D]*")).alias("lettered"))
    counts = written(counts, "counts")
    labelled = _labelled(spark, sf_dir, counts)
    rollup, change = token_rollup.Rollup(spark, shared_folder(spark, "rollup")), token_rollup.change
    loaded = change(counts, "insert", "words-1", F.col("words")).unionByName(change(counts, "insert", "chars-1", F.col("chars")))
    toxic = labelled.where("toxic = 1")
    rollup.commit("load", loaded)
    rollup.commit("toxic", change(toxic, "delete", "words-1", F.lit(0)).unionByName(change(toxic, "delete", "chars-1", F.lit(0))))
    rollup.commit("revised", change(labelled.where("toxic = 0 and quality = 0"), "revise", "words-1", F.col("lettered")))
    rollup.commit("load", loaded)
    rollup.commit("words-2", change(counts, "insert", "words-2", F.col("lettered")))
    return rollup.totals()


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


ORACLE = {
    "op11_filter_audit": r"""
        with recursive l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
        t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by coalesce(text, '')) as first_id from documents),
        d as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
                list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: case x when 'A' then len(words) < 100 when 'B' then 100 * len(list_distinct(words)) < 80 * len(words)
                    when 'C' then 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) when 'D' then regexp_matches(text, '[#$%&*|]') else t.doc_id > first_id end) as fails
              from t left join l on l.doc_id = t.doc_id),
        g as (select part, good, toxic, fails, count(*) as n from d group by all),
        o as (select '' as filter_order union all select filter_order || x from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) where not contains(filter_order, x)),
        s as (select filter_order, step, substr(filter_order, step, 1) as own, string_split(substr(filter_order, 1, step - 1), '') as before from o, (select unnest(range(1, 6)) as step) where length(filter_order) = 5),
        r as (select part, filter_order, step, own, n, good, toxic, fails, list_contains(fails, own) as hit, list_has_any(fails, before) as gone from g, s),
        a as (select part, filter_order, step, own, coalesce(sum(n) filter (not hit and not gone), 0) as kept, coalesce(sum(n) filter (hit and not gone), 0) as removed, coalesce(sum(n) filter (hit and gone), 0) as redundant,
                coalesce(sum(n) filter (hit and len(fails) = 1), 0) as unique_fails, coalesce(sum(n) filter (hit and not gone and good), 0) as good_lost, coalesce(sum(n) filter (hit and not gone and toxic), 0) as toxic_lost from r group by all)
        select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
               cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from a""",
    "op12_embedding_dedup": r"""
        with recursive v as (select vec_id, cast(embedding as double[]) as x from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
        p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.95),
        c as (select vec_id, vec_id as reached from v union select c.vec_id, p.b from c join p on p.a = c.reached),
        m as (select vec_id, min(reached) as component_id from c group by 1),
        n as (select a as vec_id, count(*) as n from p group by 1)
        select e.vec_id, coalesce(n, 0) as n_links, coalesce(component_id, e.vec_id) as component_id, e.vec_id = coalesce(component_id, e.vec_id) as kept
        from embeddings e left join n using (vec_id) left join m using (vec_id)""",
    "op3_ngram_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
        g as (select distinct doc_id, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' '))
                                                  when len(words) > 0 then [list_aggregate(words, 'string_agg', ' ')] end) as token from w),
        n as (select doc_id, count(*) as n from g group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.token = b.token and a.doc_id <> b.doc_id group by all),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
        c as (select doc_id, doc_id as reached from n union select c.doc_id, l.b from c join l on l.a = c.reached),
        m as (select doc_id, min(reached) as component_id from c group by doc_id)
        select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.component_id, w.doc_id) as component_id from w left join n using (doc_id) left join m using (doc_id)""",
    "op1_hamming_topk": r"""
        with v as (select vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) as bits from embeddings where len(embedding) > 0),
        q as (select vec_id as query_id, bits as own from v where vec_id % 100 = 0),
        p as (select query_id, vec_id, cast(len(list_filter(range(1, len(own) + 1), lambda i: own[i] <> bits[i])) as bigint) as distance from q cross join v),
        r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from p)
        select query_id, rank, vec_id, distance from r where rank <= 10""",
    "op5_line_dedup": r"""
        with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as line from documents where text is not null),
        t as (select *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as own, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) as words from l),
        f as (select *, row_number() over (partition by doc_id order by line) as nth, sum(words) over (partition by doc_id order by line) as upto from t where words > 0),
        e as (select a.doc_id, a.nth, min(b.nth) as until from f a join f b on a.doc_id = b.doc_id and b.nth between a.nth and a.nth + 50 and b.upto - a.upto + a.words >= 51 group by all),
        w as (select e.doc_id, e.nth, e.until, min(line) as line, max(line) as last, string_agg(own, chr(10) order by f.nth) as run from e join f on f.doc_id = e.doc_id and f.nth between e.nth and e.until group by all),
        r as (select *, first_value(doc_id) over (partition by run order by doc_id, nth) as first_doc, first_value(nth) over (partition by run order by doc_id, nth) as first_nth from w),
        g as (select distinct doc_id, unnest(range(line, last + 1)) as line from r where doc_id <> first_doc or nth > first_nth + until - nth),
        s as (select l.doc_id, count(*) as n_lines, count(g.line) as n_gone, coalesce(string_agg(raw, chr(10) order by l.line) filter (where g.line is null), '') as text
              from l left join g on g.doc_id = l.doc_id and g.line = l.line group by l.doc_id)
        select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_gone, 0) as n_gone, s.text as text from documents d left join s using (doc_id)""",
    "op7_word_rollup": r"""
        with l as (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by doc_id),
        d as (select d.source, d.lang, l.toxic, l.quality,
                     cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as words,
                     cast(length(coalesce(text, '')) as bigint) as chars,
                     cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]*[A-Za-z][^\x20\x09-\x0D]*')) as bigint) as lettered
              from documents d left join l using (doc_id)),
        c as (select source, lang, 'words-1' as tokenizer, case when toxic = 0 and quality = 0 then lettered else words end as n from d where coalesce(toxic, 0) <> 1
              union all select source, lang, 'chars-1', chars from d where coalesce(toxic, 0) <> 1
              union all select source, lang, 'words-2', lettered from d)
        select source, lang, tokenizer, count(*) as docs, cast(sum(n) as bigint) as tokens from c group by all""",
    "op9_warc_zip": r"""
        with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        r as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as largest from p)
        select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> largest then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id <> largest then largest end as refers_to
        from r""",
    "op10_exact_dedup": r"""
        with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
               doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
        from d""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
