"""The registered queries of this package and their SQL.

Each query applies its operator with its usual parameters to its whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_scoring, mixing, near_duplicates, nearest, quality_classifier, quality_rules, sentencepiece_codec, sharding, token_counts, url_filter
from .common import SPACE_CLASS, bucket_of, cut, read_table, shared_dir, spread, words

#: The rules of op7.
URL_RULES = (
    url_filter.UrlRule("com", "/", "allow"),
    url_filter.UrlRule("example.com", "/en/", "block"),
    url_filter.UrlRule("www.example.com", "/en/", "allow"),
    url_filter.UrlRule("net", "/es/", "block"),
    url_filter.UrlRule("net", "/fr/", "block"),
)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE_POLICY)).alias("base_failed"),
        quality_rules.passes(quality_rules.WEB_POLICY).alias("kept"),
        "n_upper", "n_lines", "fail_mask",
    )


OP1_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT rid, doc_id, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_replace(l, '^[\x20\x09-\x0D]+', '') <> '') AS lines
  FROM base
), wins AS (
  SELECT rid, i AS p, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM parts)
), dup AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM wins) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM dup) GROUP BY rid
), m AS (
  SELECT parts.rid, doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN covered USING (rid)
), bits AS (
  SELECT *, ((n_words < 50)::BIGINT * 1
    + (100 * n_repeat_words > 50 * n_words)::BIGINT * 2
    + (100 * n_symbols > 25 * n_words)::BIGINT * 4
    + (100 * n_upper > 50 * word_chars)::BIGINT * 8
    + (n_lines >= 8 AND 100 * n_dup_lines > 70 * n_lines)::BIGINT * 16
    + (2 * word_chars < 3 * n_words)::BIGINT * 32
    + (word_chars > 30 * n_words)::BIGINT * 64)::BIGINT AS fail_mask
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_mask & 3) <> 0 AS base_failed, fail_mask = 0 AS kept, n_upper, n_lines, fail_mask
FROM bits
"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 5) == 1, F.lit(False))
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text"))
    model, counts = lm_scoring.train(docs.where(~F.col("held_out")))
    return lm_scoring.score(docs, model, counts)


#: Where vocabulary files lie; a parameter of the queries that need one.
TOKENIZERS = "/opt/tokenizers"


#: An address in a text, which op3's revision masks.
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Totals after all documents came, those with a mail address were revised (each address masked), and those
    of fewer than five words were deleted; the deletion is delivered twice and counts once."""
    counters = {"byte_bpe_50k/1": token_counts.byte_bpe_counter(spark, f"{tokenizers}/byte_bpe_50k.tiktoken"), "words/1": token_counts.word_counter()}
    store = token_counts.RollupStore(spark, f"{shared_dir(spark)}/keyloom-{spark.sparkContext.applicationId}-rollup-{uuid.uuid4().hex}")
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    store.commit("load", token_counts.changes(docs, counters))
    old = docs.where(F.col("text").contains("@") & F.col("text").rlike(MAIL))
    store.commit("mask", token_counts.revision(old, masked(old), counters))
    # Masking leaves the number of words as it is; six parts tell whether there are five words.
    parts = F.split(F.coalesce("text", F.lit("")), SPACE_CLASS + "+", 6)
    short = masked(docs.where(F.size(F.filter(parts, lambda w: w != "")) < 5))
    for _ in range(2):
        store.commit("short", token_counts.changes(short, counters, -1))
    return store.totals().select("source", "lang", "tokenizer", F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"), F.col("bytes").alias("n_bytes"))


def masked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.regexp_replace("text", MAIL, "<mail>"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    pieces = sentencepiece_codec.Pieces(spark, f"{tokenizers}/piece_bpe_32k.model")
    rows = sentencepiece_codec.encode_checked(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), pieces)
    return rows.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("piece_ids", " ").cast("binary")).alias("pieces_crc32"), "round_trip"
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    rows = quality_classifier.score(spread(docs), model)
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = cut(docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("size"), F.array("source").alias("sources")))
    sizes = mixing.sizes_by_source(rows)
    targets = mixing.weighted_targets(sizes)
    mixed = mixing.mix(rows, targets)
    known = spark.createDataFrame([(s, sizes[s], float(t)) for s, t in targets.items()], "source string, source_size long, target double")
    mixed = mixed.withColumn("__source", F.col("sources")[0])
    # One row a source, of which mix() admits a bounded number.
    return mixed.join(F.broadcast(known), F.col("__source").eqNullSafe(F.col("source")), "left").select("doc_id", "size", "source_size", "target", "taken")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.slots(sharding.place(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), near_duplicates.Settings(width=3, percent=85))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_token_counts": op3_token_counts,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_mixing": op6_mixing,
        "op7_url_filters": op7_url_filters,
        "op8_sharding": op8_sharding,
        "op9_nearest": op9_nearest,
        "op10_near_duplicates": op10_near_duplicates,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL}
