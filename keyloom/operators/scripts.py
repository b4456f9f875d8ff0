"""Scripts: named Python functions over groups of keys that share a hash tag.

A group is what a script sees at once; its rows sit in one task, as keys of one tag do on one shard.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.scalars import hash_tag


class ScriptRegistry:
    """SCRIPT LOAD, EXISTS and FLUSH; scripts are known by the SHA-1 of their source."""

    def __init__(self):
        self._scripts: dict[str, tuple[Callable, str]] = {}

    def load(self, script: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> str:
        name = hashlib.sha1(inspect.getsource(script).encode()).hexdigest()
        self._scripts[name] = (script, schema)
        return name

    def exists(self, *names: str) -> list[bool]:
        return [n in self._scripts for n in names]

    def flush(self) -> None:
        self._scripts.clear()

    def evalsha(self, rows: DataFrame, name: str) -> DataFrame:
        if name not in self._scripts:
            raise KeyError("NOSCRIPT no matching script")
        return evaluate(rows, *self._scripts[name])


def evaluate(rows: DataFrame, script: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """EVAL: run ``script`` on the rows of each hash tag, ordered by key."""
    tagged = rows.withColumn("tag", hash_tag(F.col("key")))
    return tagged.groupBy("tag").applyInPandas(lambda group: script(group.sort_values("key")), schema)
