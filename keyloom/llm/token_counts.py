"""Token counts kept by deltas: rollups by source, language and tokenizer version.

A batch brings signed changes: documents inserted (+1), deleted (-1) or revised (-1 for the old
text, +1 for the new). Its changes are summed by group before they are stored, and the totals are
the sums over all batches, so totals never need the documents again. A batch is stored under its
own name, and storing it again replaces it: a batch that is retried counts once.

A commit writes the batch's sums to a new folder and then creates one empty file, whose name says
batch, number and folder; readers go by the highest number of each batch. So readers see a batch as it
was or as it is, never a part of it or none, and a writer that dies changes nothing.

Defined results: null texts count no tokens; null sources and languages are groups of their own;
repeated rows count each time; texts are counted whole at any length; sums know no ties; groups whose
totals have all come to zero are left out; an empty store or table gives no rows; other columns play no
part, also where they are called ``docs``, ``tokens``, ``bytes`` or ``tokenizer``.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import words

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens", "bytes")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"

#: Fixed value: the pattern that parts texts for the byte-level vocabularies.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Counter = Callable[[Column], Column]


def word_counter() -> Counter:
    return lambda text: F.size(words(text)).cast("long")


def byte_bpe_counter(spark: SparkSession, path: str) -> Counter:
    """Counts tokens of a byte-level vocabulary file; the file is read on the driver alone."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    held = spark.sparkContext.broadcast(ranks)  # one vocabulary, of fixed size

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = tiktoken.Encoding("held", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=held.value, special_tokens={})
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) for t in batch], dtype="int64")

    return lambda text: count(F.coalesce(text, F.lit("")))


def changes(docs: DataFrame, counters: Mapping[str, Counter], sign: int = 1) -> DataFrame:
    """The delta of inserting (``sign`` 1) or deleting (-1) ``docs``, summed by group."""
    text = F.col("text").cast("string")
    names = list(counters)
    counted = docs.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
        *[counters[name](text).alias(f"__t{i}") for i, name in enumerate(names)],
    )
    sums = counted.groupBy("source", "lang").agg(
        F.count("*").alias("docs"), F.sum("bytes").alias("bytes"), *[F.sum(f"__t{i}").alias(f"__t{i}") for i in range(len(names))]
    )
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"__t{i}").alias("tokens")) for i, name in enumerate(names)])
    rows = sums.select("source", "lang", "docs", "bytes", F.inline(each))
    return rows.select(*KEYS, *[(F.lit(sign) * F.col(c)).cast("long").alias(c) for c in SUMS])


def revision(old: DataFrame, new: DataFrame, counters: Mapping[str, Counter]) -> DataFrame:
    """The delta of replacing ``old`` rows by ``new``."""
    return merge(changes(old, counters, -1).unionByName(changes(new, counters)))


def merge(deltas: DataFrame) -> DataFrame:
    """Sum deltas by group; groups that come to nothing go."""
    sums = deltas.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
    return sums.where(" OR ".join(f"{c} <> 0" for c in SUMS))


@dataclass
class RollupStore:
    """Batches of deltas in one folder that driver and executors share."""

    spark: SparkSession
    path: str

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/batches")
        return hadoop.Path, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _heads(self) -> dict[str, tuple[int, str]]:
        """Number and folder of each batch as it stands; one name a commit comes to the driver."""
        _, folder, files = self._files()
        heads: dict[str, tuple[int, str]] = {}
        for status in files.listStatus(folder) if files.exists(folder) else ():
            batch, number, of = status.getPath().getName().split("~")
            heads[batch] = max(heads.get(batch, (0, "")), (int(number), of))
        return heads

    def commit(self, batch: str, delta: DataFrame) -> None:
        """Store a batch; a batch of the same name is replaced as a whole.

        Of two writers of one batch at once one stands, the same for all readers.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        of = uuid.uuid4().hex
        merge(delta).write.parquet(f"{self.path}/data/{of}")
        path, folder, files = self._files()
        number = self._heads().get(batch, (0, ""))[0]
        files.createNewFile(path(f"{self.path}/batches/{batch}~{number + 1:012d}~{of}"))
        if number > 1:  # what stood before the batch that was just replaced; readers of that one may still run
            for status in files.listStatus(folder):
                name, n, gone = status.getPath().getName().split("~")
                if name == batch and int(n) < number:
                    files.delete(status.getPath(), False)
                    files.delete(path(f"{self.path}/data/{gone}"), True)

    def totals(self) -> DataFrame:
        folders = [f"{self.path}/data/{of}" for _, of in self._heads().values()]
        rows = self.spark.read.schema(DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], DELTA)
        return merge(rows)
