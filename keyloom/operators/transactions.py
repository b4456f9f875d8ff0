"""MULTI, EXEC and DISCARD over a log of commands (session, seq, cmd, key, args).

Order is a matter of windows over each session; the log itself is never sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def executed(commands: DataFrame) -> DataFrame:
    """The commands that take effect, with ``at``: the moment that they do, as a ``seq``.

    Commands outside of transactions act at once. Those queued after MULTI act together at their EXEC, in the
    order they came; DISCARD drops them, and so does a session that ends without either. A MULTI inside a
    transaction, and an EXEC or DISCARD outside of one, do nothing. Effects are ordered by (at, seq).
    """
    cmd = F.upper("cmd")
    line = W.partitionBy("session").orderBy("seq")
    # A session is cut after each EXEC or DISCARD; in a piece all is queued from its first MULTI on.
    ends = F.when(cmd.isin("EXEC", "DISCARD"), 1).otherwise(0)
    step = commands.withColumn("__piece", F.sum(ends).over(line) - ends)
    piece = W.partitionBy("session", "__piece")
    step = step.withColumns({
        "__open": F.min(F.when(cmd == "MULTI", F.col("seq"))).over(piece),
        "__exec": F.max(F.when(cmd == "EXEC", F.col("seq"))).over(piece),
    })
    queued = F.col("seq") > F.col("__open")
    rows = step.where(~cmd.isin("MULTI", "EXEC", "DISCARD") & (F.coalesce(~queued, F.lit(True)) | F.col("__exec").isNotNull()))
    return rows.withColumn("at", F.when(queued, F.col("__exec")).otherwise(F.col("seq"))).drop("__piece", "__open", "__exec")
