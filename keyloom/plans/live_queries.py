"""Recorded command logs, live forms run to their end, transactions, clocks, counters and Protobuf edits."""

from __future__ import annotations

import uuid
from importlib.util import find_spec

from pyspark.sql import functions as F

from keyloom.operators import keyspace, lists, merge, pubsub, replicas, scripts, transactions
from keyloom.sources import keyspaces as ks
from keyloom.sources.folders import shared_dir
from keyloom.streaming import live

from .document_queries import tokens
from .registry import query


def live_events(spark, d):
    """The events as a stream of files."""
    schema = ks.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if not _is_folder(spark, d) else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")


def _is_folder(spark, d) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def folder(spark) -> str:
    return f"{shared_dir(spark)}/keyloom-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def queue_log(rows):
    """Purchases and errors pop from one of 50 queues, all other events push onto it."""
    op = F.when(F.col("event_type").isin("purchase", "error"), "pop").otherwise("push")
    key = F.concat(F.lit("q:"), (F.col("user_id") % 50).cast("string"))
    return rows.select(key.alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.when(op == "push", F.col("event_id").cast("string")).alias("value"))


#: The n-th pop of a queue gets its n-th push.
QUEUE = (
    "WITH c AS (SELECT 'q:' || user_id % 50 AS key, event_id AS seq, event_type IN ('purchase', 'error') AS pop FROM events), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY key, pop ORDER BY seq) AS i FROM c), "
    "m AS (SELECT a.key, a.seq, b.seq AS pushed FROM n a JOIN n b ON a.key = b.key AND a.i = b.i AND a.pop AND NOT b.pop) "
)


@query("blpop_log", QUEUE + "SELECT key, seq, pushed::VARCHAR AS value FROM m")
def _(spark, d):
    return lists.blocking_pops(queue_log(ks.table(spark, d, "events")))


@query("blpop_live", QUEUE + "SELECT key, seq, pushed::VARCHAR AS value FROM m")
def _(spark, d):
    return live.settled(live.blocking_pop(queue_log(live_events(spark, d))), folder(spark))


@query("blmove_live", QUEUE + "SELECT 'done:' || seq % 3 AS dst, seq, pushed::VARCHAR AS value FROM m")
def _(spark, d):
    log = queue_log(live_events(spark, d)).withColumn("dst", F.concat(F.lit("done:"), (F.col("seq") % 3).cast("string")))
    return live.settled(live.blocking_move(log, from_left=True), folder(spark))


@query("bzpopmin_live", QUEUE + "SELECT key, seq, 'm' || pushed AS member, pushed::DOUBLE AS score FROM m")
def _(spark, d):
    log = queue_log(live_events(spark, d))
    adds = log.select("key", "seq", F.when(F.col("op") == "push", "add").otherwise("pop").alias("op"), F.concat(F.lit("m"), "value").alias("member"), F.col("value").cast("double").alias("score"))
    return live.settled(live.blocking_zpop(adds), folder(spark))


def channel_messages(rows):
    return rows.select(F.col("event_type").alias("channel"), F.col("event_id").alias("seq"))


@query("subscribe_live", "SELECT event_type AS channel, event_id AS seq FROM events WHERE event_type IN ('view', 'error')")
def _(spark, d):
    return live.settled(live.subscribe(channel_messages(live_events(spark, d)), "view", "error", "quiet"), folder(spark))


@query("psubscribe_live", "SELECT event_type AS channel, event_id AS seq FROM events WHERE regexp_matches(event_type, '^[vp].*e')")
def _(spark, d):
    return live.settled(live.psubscribe(channel_messages(live_events(spark, d)), "[vp]*e*"), folder(spark))


@query("replicaof_live", "SELECT key, field AS elem, value::DECIMAL(18,2)::VARCHAR AS value FROM hm")
def _(spark, d):
    """A replica that has followed the log to its end holds the merged state."""
    rows = live_events(spark, d)
    ms = ks.millis(F.col("ts"))
    records = rows.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("elem"), F.col("value").cast("decimal(18,2)").cast("string").alias("value"),
        (F.shiftleft(ms, 16) + F.col("event_id") % 65536).alias("hlc"), (F.col("event_id") % ks.NODES).cast("int").alias("origin"),
    )
    at = folder(spark)
    live.merge_into_table(records, f"{at}/log", f"{at}/at").awaitTermination()
    return live.read_merged(spark, f"{at}/log").select("key", "elem", "value")


def session_log(spark, d):
    """Sessions by user: signups begin transactions, purchases execute them, errors discard them."""
    cmd = F.when(F.col("event_type") == "signup", "MULTI").when(F.col("event_type") == "purchase", "EXEC").when(F.col("event_type") == "error", "DISCARD").otherwise("SET")
    return ks.table(spark, d, "events").select((F.col("user_id") % 40).alias("session"), F.col("event_id").alias("seq"), cmd.alias("cmd"), F.concat(F.lit("k"), (F.col("event_id") % 9).cast("string")).alias("key"))


@query(
    "multi_exec",
    "WITH c AS (SELECT user_id % 40 AS session, event_id AS seq, event_type AS t, 'k' || event_id % 9 AS key FROM events), "
    "b AS (SELECT c.*, (SELECT max(x.seq) FROM c x WHERE x.session = c.session AND x.t IN ('purchase', 'error') AND x.seq < c.seq) AS from_seq, "
    "(SELECT min(x.seq) FROM c x WHERE x.session = c.session AND x.t IN ('purchase', 'error') AND x.seq > c.seq) AS end_seq FROM c WHERE t NOT IN ('signup', 'purchase', 'error')), "
    "q AS (SELECT b.*, EXISTS (SELECT 1 FROM c x WHERE x.session = b.session AND x.t = 'signup' AND x.seq > coalesce(b.from_seq, -1) AND x.seq < b.seq) AS queued, "
    "(SELECT x.t FROM c x WHERE x.session = b.session AND x.seq = b.end_seq) AS how FROM b) "
    "SELECT session, seq, 'SET' AS cmd, key, CASE WHEN queued THEN end_seq ELSE seq END AS at FROM q WHERE NOT queued OR how = 'purchase'",
)
def _(spark, d):
    return transactions.executed(session_log(spark, d))


@query(
    "hlc_clock",
    "WITH steps AS (SELECT user_id % 5 AS node, event_id AS seq, epoch_us(ts) // 1000 AS wall_ms, CASE WHEN event_id % 4 = 0 THEN (epoch_us(ts) // 1000 + event_id % 9000) * 65536 END AS remote FROM events), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq) AS i, CASE WHEN remote IS NULL THEN wall_ms * 65536 ELSE least(remote, (wall_ms + 5000) * 65536) + 1 END AS x FROM steps) "
    "SELECT node, seq, (i + max(x - i) OVER (PARTITION BY node ORDER BY seq))::BIGINT AS hlc FROM n",
)
def _(spark, d):
    e = ks.events(spark, d)
    remote = F.when(F.col("event_id") % 4 == 0, F.shiftleft(F.col("ms") + F.col("event_id") % 9000, 16))
    return replicas.clock(e.select((F.col("user_id") % 5).alias("node"), F.col("event_id").alias("seq"), F.col("ms").alias("wall_ms"), remote.alias("remote"))).select("node", "seq", "hlc")


@query(
    "debug_counterstate",
    "SELECT key, 0::BIGINT AS base, string_agg('n' || node || ':+' || pos || '-' || (pos // 3), ' ' ORDER BY node) AS slots FROM (SELECT key, node, max(pos) AS pos FROM hits GROUP BY ALL) GROUP BY key",
)
def _(spark, d):
    return merge.counter_state(ks.hit_slots(spark, d)).select("key", "base", "slots")


@query("renamenx", "WITH p AS (SELECT 'cust:' || c_custkey AS src, 'cust:' || (c_custkey * 2) AS dst FROM customer WHERE c_custkey % 3 = 1), ok AS (SELECT * FROM p WHERE dst NOT IN (SELECT key FROM str)) SELECT coalesce(dst, key) AS key, value FROM str LEFT JOIN ok ON src = key")
def _(spark, d):
    held = ks.customer_strings(spark, d).select("key", "value")
    number = F.regexp_extract("key", r"(\d+)$", 1).cast("bigint")
    pairs = held.where(number % 3 == 1).select(F.col("key").alias("src"), F.concat(F.lit("cust:"), (number * 2).cast("string")).alias("dst"))
    return keyspace.rename(held, pairs, only_new=True)


@query("evalsha_by_tag", "SELECT c_mktsegment AS tag, max(c_custkey)::BIGINT AS last FROM customer GROUP BY 1")
def _(spark, d):
    rows = ks.table(spark, d, "customer").select(F.concat(F.lit("{"), "c_mktsegment", F.lit("}:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").alias("v"))

    def script(group):
        import pandas as pd

        return pd.DataFrame({"tag": [group["tag"].iloc[0]], "last": [int(group["v"].max())]})

    known = scripts.ScriptRegistry()
    return known.evalsha(rows, known.load(script, "tag string, last long"))


@query("script_exists", "SELECT 'loaded' AS name, true AS known UNION ALL SELECT 'other', false")
def _(spark, d):
    known = scripts.ScriptRegistry()
    name = known.load(_same, "key string")
    return spark.createDataFrame(list(zip(("loaded", "other"), known.exists(name, "0" * 40), strict=True)), "name string, known boolean")


def _same(group):
    return group[["key"]]


@query(
    "budget_release",
    "SELECT o_orderpriority AS key, o_orderkey AS token, (CASE WHEN status = 'OK' THEN a - a // 4 END)::VARCHAR AS credited, status FROM (SELECT *, floor(o_totalprice)::BIGINT AS a, "
    "CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN 'TOKENUSED' WHEN o_orderstatus = 'P' THEN 'TOKENEXPIRED' ELSE 'OK' END AS status FROM orders)",
)
def _(spark, d):
    from keyloom.operators import budgets

    held = tokens(spark, d)
    ask = held.select("key", "token", F.lit(None).cast("bigint").alias("spent"), F.lit(999).cast("bigint").alias("at_ms"))
    return budgets.settle(held.drop("spent"), ask).withColumn("credited", F.col("credited").cast("string"))


if find_spec("google") is not None and find_spec("google.protobuf") is not None:

    def event_type():
        """A message type (kind, user, note) as its descriptors and name."""
        from google.protobuf import descriptor_pb2

        file = descriptor_pb2.FileDescriptorProto(name="event.proto", package="demo", syntax="proto3")
        message = file.message_type.add(name="Event")
        kinds = descriptor_pb2.FieldDescriptorProto
        for number, (name, kind) in enumerate((("kind", kinds.TYPE_STRING), ("user", kinds.TYPE_INT64), ("note", kinds.TYPE_STRING)), 1):
            message.field.add(name=name, number=number, type=kind, label=kinds.LABEL_OPTIONAL)
        return descriptor_pb2.FileDescriptorSet(file=[file]).SerializeToString(), "demo.Event"

    def messages(spark, d):
        """(key, value): each event as a message."""
        from keyloom.operators import proto

        text = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("user")))
        rows = ks.spread(ks.table(spark, d, "events").select(F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("key"), text.alias("j"), "event_id", "event_type"))
        return rows.select("key", proto.set_json(F.col("j"), *event_type()).alias("value"), "event_id", "event_type")

    USER = "CASE WHEN user_id = 0 THEN '' ELSE ',\"user\":\"' || user_id || '\"' END"

    @query("proto_getjson", f"SELECT 'ev:' || event_id AS key, '{{\"kind\":\"' || event_type || '\"' || {USER} || '}}' AS doc FROM events")
    def _(spark, d):
        from keyloom.operators import proto

        return messages(spark, d).select("key", proto.get_json(F.col("value"), *event_type()).alias("doc"))

    @query("proto_setfield", f"SELECT 'ev:' || event_id AS key, '{{\"kind\":\"' || event_type || '\",\"note\":\"new\"' || {USER} || '}}' AS doc FROM events")
    def _(spark, d):
        from keyloom.operators import proto

        return messages(spark, d).select("key", proto.get_json(proto.set_fields(F.col("value"), *event_type(), {"note": "new"}), *event_type()).alias("doc"))

    @query("proto_clearfield", "SELECT 'ev:' || event_id AS key, CASE WHEN user_id = 0 THEN '{}' ELSE '{\"user\":\"' || user_id || '\"}' END AS doc FROM events")
    def _(spark, d):
        from keyloom.operators import proto

        return messages(spark, d).select("key", proto.get_json(proto.clear_fields(F.col("value"), *event_type(), ["kind", "note"]), *event_type()).alias("doc"))

    @query("proto_info", "SELECT 'ev:' || event_id AS key, 'events' AS schema, 1 AS version, 'demo.Event' AS type, strlen(event_type) + 2 + CASE WHEN user_id = 0 THEN 0 WHEN user_id < 128 THEN 2 WHEN user_id < 16384 THEN 3 WHEN user_id < 2097152 THEN 4 ELSE 5 END AS bytes FROM events")
    def _(spark, d):
        from keyloom.operators import proto

        return proto.info(messages(spark, d).select("key", "value"), "demo.Event", "events", 1)

    @query("proto_hset_hgetfield", "SELECT 'user:' || user_id AS key, event_type AS field, event_type AS kind, nullif(user_id, 0)::VARCHAR AS who FROM events GROUP BY ALL")
    def _(spark, d):
        """Messages written into hashes by user and type; what is no message is refused."""
        from keyloom.operators import proto

        rows = ks.table(spark, d, "events").select(F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("ev"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"))
        held = messages(spark, d).select(F.col("key").alias("ev"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("seq")).join(rows, "ev").drop("ev")
        bad = held.select("key", F.lit("refused").alias("field"), F.lit(b"\xff\xff").alias("value"), "seq")
        after, _ = proto.hset(held.limit(0), held.unionByName(bad), *event_type())
        get = lambda path: proto.get_field(F.col("value"), *event_type(), path)
        return after.select("key", "field", get("kind").alias("kind"), get("user").alias("who"))

    @query("proto_sadd", "SELECT event_type AS kind, count(DISTINCT user_id) AS members FROM events GROUP BY 1")
    def _(spark, d):
        from keyloom.operators import proto

        held = messages(spark, d).select(F.concat(F.lit("set:"), "event_type").alias("key"), F.col("value").alias("member"))
        after, _ = proto.sadd(held.limit(0), held, *event_type())
        return after.groupBy("key").agg(F.count("*").alias("members")).select(F.substring("key", 5, 99).alias("kind"), "members")

    @query("proto_recompose", f"SELECT 'ev:' || event_id AS key, '{{\"kind\":\"' || event_type || '\"' || {USER} || '}}' AS doc FROM events")
    def _(spark, d):
        """Messages parted into fields and put together again."""
        from keyloom.operators import proto

        fields = messages(spark, d).select("key", F.inline(proto.decompose(F.col("value"), *event_type())))
        return proto.recompose(fields, *event_type()).select("key", proto.get_json(F.col("value"), *event_type()).alias("doc"))

    @query("proto_get", "SELECT 'ev:' || event_id AS key, '0A' || printf('%02X', strlen(event_type)) || hex(event_type) AS head FROM events")
    def _(spark, d):
        from keyloom.operators import proto

        held = proto.get(messages(spark, d)).join(messages(spark, d).select("key", "event_type"), "key")
        return held.select("key", F.substring(F.hex("value"), F.lit(1), 4 + 2 * F.length("event_type")).alias("head"))


@query("get", "SELECT key, value FROM str WHERE key IN ('cust:7', 'cust:12', 'cust:nobody')")
def _(spark, d):
    from keyloom.operators import strings

    return strings.get(ks.customer_strings(spark, d), "cust:7", "cust:12", "cust:nobody")


@query("config_get", "SELECT 'loglevel' AS name, 'ERROR' AS value UNION ALL SELECT 'gc_grace_ms', '3600000'")
def _(spark, d):
    from keyloom.operators import server

    settings = server.Settings()
    settings.set("loglevel", "ERROR")
    return spark.createDataFrame([(n, str(settings.get(n))) for n in ("loglevel", "gc_grace_ms")], "name string, value string")


@query("time_parts", "SELECT 1705000000 AS seconds, 123000 AS micros, 'hello' AS echo")
def _(spark, d):
    from keyloom.operators import server

    return server.ping(spark, "hello").select(*[F.lit(v).alias(n) for n, v in zip(("seconds", "micros"), server.time(1_705_000_000_123), strict=True)], F.col("reply").alias("echo"))


@query("unsubscribe", "SELECT event_id AS seq, event_type AS channel, (event_type = 'view')::BIGINT AS receivers FROM events")
def _(spark, d):
    """Two subscribers of a channel, one of whom has left again."""
    held = spark.createDataFrame([("x", "view"), ("y", "view"), ("y", "error")], "subscriber string, channel string")
    messages_ = ks.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("channel"))
    return pubsub.receivers(messages_, held.where("subscriber <> 'y'"), [])
