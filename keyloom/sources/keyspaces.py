"""Keyspaces derived from relational tables, and versions for their records.

A keyspace is a DataFrame with one row for each element of each key: hashes have (key, field, value),
sets (key, member), sorted sets (key, member, score), lists (key, pos, value), streams (key, ms, seq,
fields). Log forms also carry a version: ``hlc`` (48 bits of milliseconds, 16 of a counter) and ``origin``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal an input of fewer partitions than cores over all of them; larger inputs stay as they are read.

    For work in Python, which costs more a row than a small shuffle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


#: Rows of a table that one task is given.
TASK_ROWS = 500_000


def in_tasks(rows: DataFrame, *by: Column | str) -> DataFrame:
    """A table read from files, dealt to tasks by ``by`` (else evenly), whose size does not grow with it.

    Tasks that Spark sizes itself hold as many rows as compress to 64 MB. Files tell their number of rows.
    """
    n = rows.count()
    if n <= TASK_ROWS and by:
        return rows
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *by)


def millis(ts: Column) -> Column:
    """Milliseconds since the epoch of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def hlc(ms: Column, logical: Column | int = 0) -> Column:
    return F.shiftleft(ms, 16) + (F.lit(logical) if isinstance(logical, int) else logical)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", millis(F.col("ts")))


def user_hashes_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, field, value, hlc, origin, ttl_ms, tomb): each event writes a field of its user's hash."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("field"), "value",
        (F.shiftleft("ms", 16) + F.col("event_id") % 65536).alias("hlc"), (F.col("event_id") % NODES).cast("int").alias("origin"), "event_id", "ms",
        (F.col("ms") + F.floor(F.col("value") * 1000)).alias("ttl_ms"), (F.col("event_type") == "error").alias("tomb"),
    )


def hit_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter slots (key, base_hlc, base_origin, base, node, pos, neg) as each node saw them grow."""
    node = (F.col("user_id") % 4).cast("int")
    grown = F.row_number().over(W.partitionBy("event_type", node).orderBy("event_id"))
    return events(spark, sf_dir).select(
        F.concat(F.lit("hits:"), "event_type").alias("key"), F.lit(0).cast("long").alias("base_hlc"), F.lit(0).alias("base_origin"), F.lit(0).cast("long").alias("base"),
        node.alias("node"), grown.cast("decimal(20,0)").alias("pos"), F.floor(grown / 3).cast("decimal(20,0)").alias("neg"),
    )


def customer_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), F.concat_ws("|", "c_name", "c_mktsegment").alias("value"), F.col("c_custkey").alias("seq")
    )


def segment_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("seg:"), "c_mktsegment").alias("key"), F.format_string("n%02d", "c_nationkey").alias("member"))


def brand_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("brand:"), "p_brand").alias("key"), F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("member"))


def customer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("rank:"), F.col("c_nationkey").cast("string")).alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score")
    )


def part_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted sets by brand whose members (part names) repeat across brands."""
    return table(spark, sf_dir, "part").groupBy(F.concat(F.lit("parts:"), "p_brand").alias("key"), F.col("p_name").alias("member")).agg(F.max("p_size").cast("double").alias("score"))


def order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    key = F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("key")  # parts the rows, so that later steps by key need no other shuffle
    nth = F.row_number().over(W.partitionBy("key").orderBy(*by))
    return in_tasks(table(spark, sf_dir, "lineitem").select(key, *by), "key").select("key", (nth - 1).cast("long").alias("pos"), (F.col("l_partkey") % 50).alias("value"))


def user_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(
        F.struct(F.lit("type").alias("f"), F.col("event_type").alias("v")), F.struct(F.lit("k").alias("f"), F.get_json_object("props", "$.k").alias("v"))
    )
    return events(spark, sf_dir).select(
        F.concat(F.lit("st:"), F.col("user_id").cast("string")).alias("key"), "ms", F.col("event_id").alias("seq"), fields.alias("fields")
    )
