"""Nearest neighbours by score-aware four-bit quantisation and exact reranking.

The nearest vector maximises the inner product of (q, 1) with (x, -|x|^2/2), so the search is one for
maximum inner product. Vectors are cut into short subspaces of 16 centroids each. Centroids and
codes minimise an anisotropic loss, which weighs the part of the residual parallel to the vector
``eta`` times as much as the rest, as that part moves the largest scores most.

Vectors are encoded once, in blocks of ``scan_rows``, which are written with their codes, two to a byte.
Every block is scanned with each query's tables; the norm term is exact. The ``rerank`` best of a block, and
all within a margin of the last of them (half the usual error of the codes), are measured exactly on the
original vectors in double precision.

Codebooks are fitted on the ``sample`` vectors with the smallest hash of their id; every vector is
indexed and scanned. Queries are taken in blocks of about ``query_block``, one broadcast and one pass over
the codes each, so work grows with queries times vectors; tasks and driver hold one block of either.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor
do those of another length than most have (of lengths that tie, the longer counts); equal distances go to the
smaller id; two vectors under one id are two candidates, of which the nearer one stands for the id, and as a
query each is asked and the nearer answers stand; of one vector's exact copies each block keeps the ``k + 1``
smallest ids, which no answer can lack; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, piled

CODES = 16


@dataclass(frozen=True)
class Settings:
    width: int = 2
    sample: int = 16384
    rounds: int = 6
    eta: float = 2.6
    rerank: int = 128
    query_block: int = 4096
    scan_rows: int = 8192


@dataclass
class Index:
    books: np.ndarray  # subspaces x CODES x width
    dim: int
    eta: float
    error: float  # root mean square of a residual


def _split(x: np.ndarray, width: int) -> np.ndarray:
    """n x d -> n x subspaces x width, filled up with zeros."""
    spare = -x.shape[1] % width
    return np.pad(x, ((0, 0), (0, spare))).reshape(len(x), -1, width)


def _assign(parts: np.ndarray, unit: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes of least anisotropic loss, by coordinate descent over subspaces."""
    n, m, _ = parts.shape
    codes = np.empty((n, m), dtype=np.uint8)
    along = np.empty((n, m))
    for s in range(m):
        gap = parts[:, s, None, :] - books[s][None]
        codes[:, s] = np.argmin((gap**2).sum(-1), axis=1)
        along[:, s] = (gap[np.arange(n), codes[:, s]] * unit[:, s]).sum(-1)
    total = along.sum(1)
    for _ in range(sweeps):
        for s in range(m):
            gap = parts[:, s, None, :] - books[s][None]
            ahead = (gap * unit[:, s, None, :]).sum(-1)
            rest = total - along[:, s]
            codes[:, s] = np.argmin((gap**2).sum(-1) + (eta - 1) * (rest[:, None] + ahead) ** 2, axis=1)
            along[:, s] = ahead[np.arange(n), codes[:, s]]
            total = rest + along[:, s]
    return codes


def _rebuild(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return books[np.arange(books.shape[0])[None, :], codes]


def fit_vectors(x: np.ndarray, settings: Settings) -> Index:
    parts = _split(x, settings.width)
    unit = _split(x / np.linalg.norm(x, axis=1, keepdims=True), settings.width)
    n, m, width = parts.shape
    dice = np.random.default_rng(11)
    books = np.stack([parts[dice.choice(n, CODES, replace=n < CODES), s] for s in range(m)])
    for _ in range(settings.rounds):
        codes = _assign(parts, unit, books, settings.eta, sweeps=1)
        left = parts - _rebuild(codes, books)
        along = (left * unit).sum(-1)
        rest = along.sum(1, keepdims=True) - along
        for s in range(m):
            u, p = unit[:, s], parts[:, s]
            for c in range(CODES):
                own = codes[:, s] == c
                if not own.any():
                    books[s, c] = p[dice.integers(n)]
                    continue
                weight = own.sum() * np.eye(width) + (settings.eta - 1) * u[own].T @ u[own]
                pull = p[own].sum(0) + (settings.eta - 1) * (u[own] * ((u[own] * p[own]).sum(1) + rest[own, s])[:, None]).sum(0)
                books[s, c] = np.linalg.solve(weight, pull)
    left = parts - _rebuild(_assign(parts, unit, books, settings.eta), books)
    return Index(books, x.shape[1], settings.eta, float(np.sqrt((left**2).sum((1, 2)).mean())))


def _distinct(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id, at most ``keep`` ids of each vector."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    _, which = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    by = np.lexsort((ids, which))
    by = by[np.r_[True, (which[by][1:] != which[by][:-1]) | (ids[by][1:] != ids[by][:-1])]] if len(by) else by
    first = np.searchsorted(which[by], which[by])  # where each vector's rows begin
    held = np.sort(by[np.arange(len(by)) - first < keep])
    return ids[held], x[held]


@dataclass
class Block:
    """Some vectors with their packed codes and half their squared lengths."""

    ids: np.ndarray
    x: np.ndarray
    packed: np.ndarray
    half: np.ndarray


def encode(ids: np.ndarray, x: np.ndarray, index: Index, k: int, settings: Settings) -> Block:
    ids, x = _distinct(ids, x, k + 1)
    width = settings.width
    codes = _assign(_split(x, width), _split(x / np.linalg.norm(x, axis=1, keepdims=True), width), index.books, index.eta)
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return Block(ids, x, codes[:, ::2] | codes[:, 1::2] << 4, ((x**2).sum(1) / 2).astype(np.float32))


def scan(block: Block, query_ids: np.ndarray, queries: np.ndarray, index: Index, k: int, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, distance) of each query's k nearest rows of one block."""
    ids, x, packed, half = block.ids, block.x, block.packed, block.half
    tables = np.einsum("qsw,scw->qsc", _split(queries, settings.width), index.books).astype(np.float32)
    if tables.shape[1] % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    tables = (tables[:, 1::2, :, None] + tables[:, ::2, None, :]).reshape(len(queries), -1, CODES * CODES)
    margin = 0.5 * index.error * np.linalg.norm(queries, axis=1) / np.sqrt(index.dim)
    at, who, far = [], [], []
    for q in range(len(queries)):
        near = -half.copy()
        for s in range(packed.shape[1]):
            near += tables[q, s][packed[:, s]]
        if len(near) > settings.rerank:
            least = np.partition(near, len(near) - settings.rerank)[len(near) - settings.rerank]
            chosen = np.flatnonzero(near >= least - margin[q])
        else:
            chosen = np.arange(len(near))
        chosen = chosen[ids[chosen] != query_ids[q]]
        distance = np.sqrt(((x[chosen] - queries[q]) ** 2).sum(1))
        best = np.lexsort((ids[chosen], distance))
        best = best[np.sort(np.unique(ids[chosen[best]], return_index=True)[1])][:k]
        at.append(np.full(len(best), q))
        who.append(ids[chosen[best]])
        far.append(distance[best])
    return np.concatenate(at), np.concatenate(who), np.concatenate(far)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that take part."""
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = rows.where(F.forall("embedding", fine) & F.exists("embedding", lambda v: v != 0))
    most = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (most["n"] if most else 0))


def _matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["vec_id"] for r in rows], dtype=np.int64), np.array([r["embedding"] for r in rows], dtype=np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    _, sample = _matrix(rows.withColumn("__h", F.xxhash64("vec_id")).orderBy("__h", "vec_id").limit(settings.sample).select("vec_id", "embedding").collect())
    queries = rows.where(is_query)
    asked = queries.count()
    if not len(sample) or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit_vectors(sample, settings)
    held = spark.sparkContext.broadcast((index, k, settings))

    def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, k, settings = held.value
        for batch in batches:
            for i in range(0, len(batch), settings.scan_rows):
                part = batch.iloc[i : i + settings.scan_rows]
                b = encode(part["vec_id"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(np.float64), index, k, settings)
                yield pd.DataFrame([[v.tobytes() for v in (b.ids, b.x, b.packed, b.half)]], columns=["ids", "x", "packed", "half"])

    encoded = cut(rows.mapInPandas(blocks_of, "ids binary, x binary, packed binary, half binary"))
    blocks = max(1, -(-asked * 5 // (settings.query_block * 4)))

    def found() -> Iterator[DataFrame]:
        for number in range(blocks):
            own = queries.where(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(blocks)) == number)
            asks = spark.sparkContext.broadcast(_matrix(own.collect()))  # about query_block rows

            def answers(batches: Iterator[pd.DataFrame], asks=asks) -> Iterator[pd.DataFrame]:
                (query_ids, query_rows), (index, k, settings) = asks.value, held.value
                for batch in batches:
                    for ids, x, packed, half in zip(batch["ids"], batch["x"], batch["packed"], batch["half"], strict=True):
                        ids = np.frombuffer(ids, np.int64)
                        block = Block(ids, np.frombuffer(x, np.float64).reshape(len(ids), -1), np.frombuffer(packed, np.uint8).reshape(len(ids), -1), np.frombuffer(half, np.float32))
                        if len(query_ids):
                            at, who, far = scan(block, query_ids, query_rows, index, k, settings)
                            yield pd.DataFrame({"query_id": query_ids[at], "vec_id": who, "score": far})

            yield encoded.mapInPandas(answers, "query_id long, vec_id long, score double")
            asks.destroy()

    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    nearest = piled(spark, found()).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return nearest.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
