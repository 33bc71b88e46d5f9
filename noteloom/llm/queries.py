"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import (
    byte_bpe, chat_format, common, exact_dedup, hard_negatives, jaccard_join, language_id, mixing, periodic_runs, quality_rules, secret_scan, sentencepiece_codec, toxicity, url_filter,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.read_table(common.ready(spark), sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = language_id.fold() == 2
    model = language_id.train(language_id.bounded(docs.filter(~held & F.col("lang").isNotNull())))
    return language_id.identify(docs, model).withColumn("held_out", held)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir)).drop("found")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(_documents(spark, sf_dir))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.read_table(common.ready(spark), sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_documents(spark, sf_dir))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(common.read_table(common.ready(spark), sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_documents(spark, sf_dir), common.read_table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read_table(common.ready(spark), sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0, label=label)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find(periodic_runs.planted(_documents(spark, sf_dir))))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_secret_scan, op3_mixing, op4_sentencepiece, op5_url_filter, op6_quality_rules, op7_exact_dedup, op8_jaccard_join, op9_chat_format, op10_toxicity,
    op11_hard_negatives, op12_periodic_runs, op13_byte_bpe)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op3_mixing": rf"""
        WITH RECURSIVE sizes AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
        by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
        weighted AS (
            SELECT *, 3 * source_size AS cap,
                [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::BIGINT AS w FROM by_source),
        left_over AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::BIGINT AS lt, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS lw
            FROM weighted WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT arg_max(lt, lw) AS lt, max(lw) AS lw FROM left_over WHERE cap * lw > lt * w),
        targets AS (
            SELECT l.source, source_size, CASE WHEN cap * l.lw > l.lt * w THEN level.lt::DOUBLE * w / level.lw ELSE cap::DOUBLE END AS target
            FROM left_over l, level),
        rates AS (
            SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
                ('0x' || substr(sha256('mix-1:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
            FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        taken AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rates)
        SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM taken""",
    "op6_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)),
        starts AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        covered AS (
            SELECT doc_id, sum(n)::BIGINT AS n_repeat_words
            FROM (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8)) AS n FROM starts) GROUP BY doc_id),
        lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        m AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
        bits AS (
            SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (5 * n_symbols > n_words)::BIGINT
                + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS failed
            FROM m)
        SELECT *, (failed & 3) <> 0 AS base_failed, (failed & 47) = 0 AS kept FROM bits""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_chat_format": r"""
        WITH turns AS (
            SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'unknown') AS role,
                replace(replace(coalesce(role, 'unknown'), '<|', '<\|'), chr(10), '\n') AS name,
                replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations),
        speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
        pieces AS (
            SELECT t.*, perspective, role = perspective AS train, text || '<|im_end|>' || chr(10) AS body,
                '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || name END || chr(10) AS head
            FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
        placed AS (
            SELECT *, (sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective
                ORDER BY turn NULLS FIRST, role, text, rid ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM pieces)
        SELECT conv_id, perspective, count(*)::BIGINT AS n_turns,
            string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text, rid) AS rendered,
            coalesce(string_agg((stop - length(body)) || ':' || stop, ',' ORDER BY stop) FILTER (train), '') AS mask,
            coalesce(sum(length(body)) FILTER (train), 0)::BIGINT AS n_trained
        FROM placed GROUP BY conv_id, perspective""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
        positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
        pairs AS (SELECT row_number() OVER () AS pair, anchor, anchor_id, id AS positive_id, score AS positive_score FROM positives)
        SELECT p.anchor_id, positive_id, (row_number() OVER best)::INT AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
        FROM pairs p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
            AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
        WINDOW best AS (PARTITION BY pair ORDER BY n.score DESC, n.id)
        QUALIFY row_number() OVER best <= 10""",
}
