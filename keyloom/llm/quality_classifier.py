"""Compression classifier: which of two dictionaries makes a text smaller.

A zstandard dictionary is built from good labelled text and one from bad. Each text is compressed
with both; the difference of the two sizes over the text's own is the raw score. A logistic calibration
of that one number, a slope and an offset fitted on labelled rows that built neither dictionary and
weighted to the classes' shares of all labels, makes it a probability.

Bounds: at most ``max_fit`` labelled rows of each class are learnt from, those with the smallest hash
of their id, and each of them whole. Every other one builds its class's dictionary of at most
``dictionary_bytes``, out of pieces of ``sample_bytes`` that lie evenly over all their text; these texts come
to the driver, the first of each class and then as many as fit in ``max_dictionary_bytes``. The rest calibrate
where they lie. Scoring reads whole texts.

Defined results: a null text counts as empty; an empty text has no difference and so the offset's score;
labels that are null or whose id is null or unknown are not learnt from, nor are those of an id with both;
of several texts of one id the least is learnt from; ids that tie in the hash go by id; repeated rows are
scored one by one, and texts of any length whole; a class without any labels makes every score 0.5; an
empty table gives an empty result; a column called as the score is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, returning

STEP = 200  # rows that are worked on at once, whatever the size of a batch


@dataclass(frozen=True)
class Settings:
    max_fit: int = 4000
    max_dictionary_bytes: int = 32 << 20
    dictionary_bytes: int = 4 << 20
    sample_bytes: int = 1024
    level: int = 9
    ridge: float = 0.001


@dataclass
class Model:
    good: bytes
    bad: bytes
    offset: float
    slope: float
    level: int

    def scorer(self) -> Scorer:
        return Scorer(self)


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
    if held is not None:
        held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False)


def _differences(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """How many bytes more the bad dictionary needs for each byte of text."""
    return np.array([(len(bad.compress(t)) - len(good.compress(t))) / max(1, len(t)) for t in texts], dtype=np.float64)


class Scorer:
    """Scores texts with a model's dictionaries, loaded once."""

    def __init__(self, model: Model):
        self.model = model
        self.good, self.bad = _compressor(model.good, model.level), _compressor(model.bad, model.level)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        z = self.model.offset + self.model.slope * _differences(texts, self.good, self.bad)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def _by_step(texts: pa.Array, work: Callable[[list[bytes]], np.ndarray]) -> pa.Array:
    """``work`` over a batch's texts, a few at a time: a batch has up to 10,000 rows by default, whatever their length."""
    found = [work(texts.slice(i, STEP).cast(pa.binary()).to_pylist()) for i in range(0, len(texts), STEP)]
    return pa.array(np.concatenate([*found, np.empty(0)]), pa.float64())


def _dictionary(texts: list[bytes], settings: Settings) -> bytes:
    pieces = [t[i : i + settings.sample_bytes] for t in texts for i in range(0, len(t), settings.sample_bytes)]
    most = max(1, settings.dictionary_bytes // settings.sample_bytes)
    return b"".join(pieces[len(pieces) * i // most] for i in range(most)) if len(pieces) > most else b"".join(pieces)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30.0, 30.0)))
        curve = (a * (weight * p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, a.T @ (weight * (y - p)) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def _unlearnt(settings: Settings) -> Model:
    return Model(b"", b"", 0.0, 0.0, settings.level)


def _calibrated(dictionaries: list[bytes], x: np.ndarray, y: np.ndarray, share: float, settings: Settings) -> Model:
    """``share``: of good ones among all labels."""
    mean, spread = x.mean(), x.std() + 1e-9
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    offset, slope = _logistic((x - mean) / spread, y, weight, settings.ridge)
    return Model(*dictionaries, float(offset - slope * mean / spread), float(slope / spread), settings.level)


def _within(rows: list, sizes: list[int], most: int) -> list:
    """The first of ``rows``, and those after it while their bytes stay within ``most``."""
    return rows[: max(1, int(np.searchsorted(np.cumsum(sizes), most, side="right")))]


def fit_texts(good: list[bytes], bad: list[bytes], settings: Settings, share: float | None = None) -> Model:
    """Every other text builds its class's dictionary, the rest calibrate; ``share``: of good ones, else these texts'."""
    if not good or not bad:
        return _unlearnt(settings)
    build = [_within(texts[::2], [len(t) for t in texts[::2]], settings.max_dictionary_bytes) for texts in (good, bad)]
    dictionaries = [_dictionary(texts, settings) for texts in build]
    held = [good[1::2] or good, bad[1::2] or bad]
    x = _differences(held[0] + held[1], *(_compressor(d, settings.level) for d in dictionaries))
    share = len(good) / (len(good) + len(bad)) if share is None else share
    return _calibrated(dictionaries, x, np.r_[np.ones(len(held[0])), np.zeros(len(held[1]))], share, settings)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """``fit_texts`` over the labelled rows of ``docs`` for which ``learn`` (over ``doc_id``) holds."""
    marks = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").alias("__mark"), F.min("quality").alias("__least"))
        .where((F.col("__mark") == F.col("__least")) & learn)
        .withColumn("__order", F.xxhash64("doc_id"))
    )
    of_class = {r["__mark"]: int(r["n"]) for r in marks.groupBy("__mark").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = None
    for mark in (0, 1):
        part = marks.where(F.col("__mark") == mark).orderBy("__order", "doc_id").limit(settings.max_fit).select("doc_id", "__mark", "__order")
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * max_fit ids by construction: small enough to send to every task.
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", body.alias("__body")).join(F.broadcast(chosen), "doc_id")
    rows = cut(rows.groupBy("doc_id", "__mark", "__order").agg(F.min("__body").alias("__body")))  # at most 2 * max_fit
    found = sorted(rows.select("doc_id", "__mark", "__order", F.octet_length("__body").alias("__bytes")).collect(), key=lambda r: (r["__order"], r["doc_id"]))
    classes = [[r for r in found if r["__mark"] == mark] for mark in (1, 0)]
    if not all(classes):
        return _unlearnt(settings)

    def of(ids: list[int]) -> DataFrame:
        return rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], rows.select("doc_id").schema)), "doc_id")

    build = [_within(own[::2], [r["__bytes"] for r in own[::2]], settings.max_dictionary_bytes) for own in classes]
    bodies = {r["doc_id"]: bytes(r["__body"]) for r in of([r["doc_id"] for own in build for r in own]).select("doc_id", "__body").collect()}
    dictionaries = [_dictionary([bodies[r["doc_id"]] for r in own], settings) for own in build]
    level = settings.level

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = (_compressor(d, level) for d in dictionaries)
        for b in batches:
            x = _by_step(b.column(1), lambda texts: _differences(texts, good, bad))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), x], names=["doc_id", "x"])

    held = [r for own in classes for r in (own[1::2] or own)]
    x = {r["doc_id"]: r["x"] for r in of([r["doc_id"] for r in held]).select("doc_id", "__body").mapInArrow(lambda batches: returning(terms, batches), "doc_id long, x double").collect()}
    share = of_class[1] / (of_class[0] + of_class[1])
    return _calibrated(dictionaries, np.array([x[r["doc_id"]] for r in held]), np.array([float(r["__mark"]) for r in held]), share, settings)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with ``to`` (double, 0 to 1); its other columns pass through in place."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most dictionary_bytes

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = held.value.scorer()
        for batch in batches:
            yield _by_step(batch, scorer)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from returning(scored, batches)

    return docs.withColumn(to, probability(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
