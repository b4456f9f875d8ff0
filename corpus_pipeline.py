"""The corpus pipeline: rules, classifier, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a
DataFrame; all but the last return the columns of ``documents``. ``run`` writes each stage's rows to the
shared folder before the next begins, so a lost executor costs no finished stage.

Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns are handled as the
operators' modules define; stages see the columns of ``documents`` only. Of rows that repeat one doc_id, the
near-duplicate stage keeps one: of different texts the least. Rows without doc_id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import mixing, near_duplicates, quality_classifier, quality_rules, sentencepiece_codec
from keyloom.llm.common import bucket_of, cut, drop, read_table, scope, spread, words

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZERS = "/opt/tokenizers"
FEW_IDS = 2_000_000


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the web policy."""
    return quality_rules.apply_policy(quality_rules.ledger(docs.select(*COLUMNS)), quality_rules.WEB_POLICY).select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good.

    It learns from the labelled rows of the whole ``documents`` table, as the rows that come here hold
    hardly any bad ones.
    """
    learn = bucket_of(F.col("doc_id"), 3) != 1
    model = quality_classifier.fit(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"), learn)
    return quality_classifier.score(spread(docs.select(*COLUMNS)), model, to="__score").where(F.col("__score") >= 0.5).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    docs = spread(docs.select(*COLUMNS))
    found = cut(near_duplicates.near_duplicates(docs, near_duplicates.Settings(width=5, percent=80)).select("doc_id", "kept"))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    side = F.broadcast if gone.count() <= FEW_IDS else (lambda x: x)
    docs = docs.join(side(gone), "doc_id", "left_anti").select(*COLUMNS)
    repeated = cut(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return docs
    side = F.broadcast if repeated.count() <= FEW_IDS else (lambda x: x)
    first = F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")
    once = docs.join(side(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(first).select("doc_id", "r.*")
    return docs.join(side(repeated), "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the sources' target weights; one taken twice comes twice."""
    rows = docs.select(*COLUMNS, F.size(words(F.col("text"))).cast("long").alias("size"), F.array("source").alias("sources"))
    small = cut(rows.select("doc_id", "size", "sources"))
    mixed = mixing.mix(rows, mixing.weighted_targets(mixing.sizes_by_source(small)), narrow=small)
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    return mixed.where("repeats > 0").withColumn("__copy", copies).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, and whether they decode to its text."""
    pieces = sentencepiece_codec.Pieces(spark, f"{TOKENIZERS}/piece_bpe_32k.model")
    rows = sentencepiece_codec.encode_checked(spread(docs.select(*COLUMNS)), pieces)
    return rows.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near duplicates", near_dedup),
    ("mixing", mix),
    ("SentencePiece", encode),
]

#: Dictionaries, sketches and piece models are beyond SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table, and what it wrote on the way, goes when the next one stands."""
    docs, old = read_table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scope() as made:
            docs = cut(stage(spark, docs, sf_dir))
        drop(spark, [*old, *made[:-1]])
        old = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
