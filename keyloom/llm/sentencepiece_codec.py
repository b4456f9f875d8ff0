"""SentencePiece encoding and decoding.

Two ways, as the model's type asks:

``encode_lattice`` is relational and serves unigram models. Texts are parted into words, each
distinct word's substrings up to the longest piece are exploded and joined to the piece table, the
edges that remain are grouped by word, and a fold over positions (Viterbi) keeps the best path to each.

``encode`` runs the piece model's own merges and serves BPE models. Their scores are merge ranks,
not log probabilities: the best path over ranks is another segmentation than the merges give, so the
lattice can't give right results for them.

Defined results: null and empty texts have no pieces; characters outside the vocabulary become byte
pieces (``encode``) or ``<unk>`` (``encode_lattice``); repeated rows are encoded one by one; other
columns pass through; an empty table gives an empty result; texts are encoded whole at any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import returning

MARK = "▁"  # stands for a space
UNKNOWN = -1
STEP = 200  # rows that are worked on at once, whatever the size of a batch


class Pieces:
    """A piece model's bytes, held for all tasks; the file is read on the driver alone."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            self.held = spark.sparkContext.broadcast(f.read())  # one model, of fixed size


def _mapped(rows: DataFrame, column: str, pieces: Pieces, fields: list[T.StructField], work: Callable) -> DataFrame:
    """``rows`` with the columns that ``work(model, values)`` makes of ``column``, a few rows at a time."""
    names = [f.name for f in fields]
    rows = rows.select(*[c for c in rows.columns if c not in names])
    at, held, step = rows.columns.index(column), pieces.held, STEP

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_proto=held.value)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                made = work(model, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return rows.mapInArrow(lambda batches: returning(of, batches), T.StructType([*rows.schema.fields, *fields]))


def _ids(model: sentencepiece.SentencePieceProcessor, texts: list[str | None]) -> tuple[pa.Array, list[np.ndarray]]:
    found = [np.array(model.encode(t or ""), dtype=np.int32) for t in texts]
    ends = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)]))), found


IDS, DECODED, ROUND = T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("round_trip", T.BooleanType())


def encode(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids``, the ids of the text's pieces (array<int>)."""
    return _mapped(docs, text, pieces, [IDS], lambda model, texts: [_ids(model, texts.to_pylist())[0]])


def decode(rows: DataFrame, pieces: Pieces, ids: str = "piece_ids") -> DataFrame:
    """``rows`` with ``decoded``, the text that the pieces spell."""
    spell = lambda model, found: [pa.array([model.decode(x) if x else "" for x in found.to_pylist()], pa.string())]
    return _mapped(rows, ids, pieces, [DECODED], spell)


def encode_checked(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids`` and ``round_trip``: whether decoding them gives the text back.

    Both directions run in one pass, so ids don't travel back to be decoded.
    """

    def work(model, texts):
        bodies = [t or "" for t in texts.to_pylist()]
        array, found = _ids(model, bodies)
        same = [(model.decode(x.tolist()) if len(x) else "") == t for x, t in zip(found, bodies, strict=True)]
        return [array, pa.array(same, pa.bool_())]

    return _mapped(docs, text, pieces, [IDS, ROUND], work)


def encode_lattice(words: DataFrame, pieces: DataFrame, unknown: float = -20.0) -> DataFrame:
    """(word, piece_ids) of each distinct word of ``words``, by the best path over ``pieces``.

    ``pieces`` has piece, id and score (a log probability); it is a vocabulary, so it is broadcast.
    A character that starts no piece costs ``unknown`` and gives ``UNKNOWN``. Of equal paths the one
    whose last piece is longest wins.
    """
    longest = pieces.agg(F.max(F.length("piece"))).first()[0] or 1
    distinct = words.where(F.col("word").isNotNull() & (F.col("word") != "")).select("word").distinct()
    spans = distinct.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    spans = spans.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start") + 1))).alias("n"))
    spans = spans.select("word", "start", "n", F.expr("substring(word, start, n)").alias("piece"))
    known = F.broadcast(pieces.select("piece", "id", F.col("score").cast("double").alias("score")))
    edges = spans.join(known, "piece", "left").where(F.col("id").isNotNull() | (F.col("n") == 1)).select(
        "word",
        F.struct((F.col("start") + F.col("n") - 1).alias("end"), (-F.col("n")).alias("less"), F.coalesce("id", F.lit(UNKNOWN)).alias("id"), F.coalesce("score", F.lit(unknown)).alias("score")).alias("edge"),
    )
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    # best: for each position the best (score, ids) that reaches it; position 0 starts with none.
    fold = """
      aggregate(sequence(1, length(word)),
        array(named_struct('score', 0.0D, 'ids', cast(array() as array<int>))),
        (best, at) -> concat(best, array(aggregate(
          filter(edges, e -> e.end = at),
          named_struct('score', cast('-Infinity' as double), 'ids', cast(array() as array<int>)),
          (top, e) -> if(best[at + e.less].score + e.score > top.score,
            named_struct('score', best[at + e.less].score + e.score, 'ids', concat(best[at + e.less].ids, array(e.id))), top)))),
        best -> element_at(best, -1).ids)
    """
    return lattice.select("word", F.expr(fold).alias("piece_ids"))
