"""JSON documents, budgets, channels, bindings, sequences and Protobuf."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import functions as F

from keyloom.functions.patterns import glob_match
from keyloom.operators import budgets, json_docs, merge, pubsub
from keyloom.sources import keyspaces as ks

from .registry import query


def docs(spark, d, deal=lambda rows: rows):
    """(key, doc, n): an order and its customer as one document."""
    o = deal(ks.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority"))
    doc = F.to_json(F.struct(
        F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("code"), (F.col("o_orderkey") % 2 == 0).alias("even")).alias("status"),
        F.array(F.col("o_custkey"), F.col("o_custkey") + 1, F.lit(7)).alias("nums"), F.col("o_orderpriority").alias("priority"),
    ))
    return o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), doc.alias("doc"), F.col("o_orderkey").alias("n"))


def dealt(spark, d):
    """The documents in even tasks of bounded size over all cores, for work in Python."""
    return docs(spark, d, ks.in_tasks)


K = "'order:' || o_orderkey AS key"


@query("json_get_static", f"SELECT {K}, '\"' || o_orderstatus || '\"' AS code, (o_custkey + 1)::VARCHAR AS second, NULL::VARCHAR AS missing, '[' || o_orderkey || ']' AS id, '[]' AS none FROM orders WHERE json_valid('\"' || o_orderstatus || '\"')")
def _(spark, d):
    get = lambda p: json_docs.json_get(F.col("doc"), p)
    return docs(spark, d).select("key", get("status.code").alias("code"), get("nums[1]").alias("second"), get("zz").alias("missing"), get("$.id").alias("id"), get("$.zz").alias("none"))


@query("json_get_dynamic", f"SELECT {K}, '[\"' || o_orderstatus || '\"]' AS code, '[7]' AS last, '[' || array_to_string(list_filter([o_custkey, o_custkey + 1], lambda x: x > 7), ',') || ']' AS big FROM orders")
def _(spark, d):
    get = lambda p: json_docs.json_get(F.col("doc"), p)
    return dealt(spark, d).select("key", get("$..code").alias("code"), get("$.nums[-1]").alias("last"), get("$.nums[?(@>7)]").alias("big"))


@query("json_get_many", f"SELECT key, value FROM (SELECT {K}, '{{\"$.id\":[' || o_orderkey || '],\"priority\":\"' || o_orderpriority || '\",\"status.code\":\"' || o_orderstatus || '\",\"zz\":null}}' AS value FROM orders) WHERE json_valid(value)")
def _(spark, d):
    return json_docs.get_many(docs(spark, d), ["priority", "status.code", "zz", "$.id"])


@query("json_get_pretty", f"SELECT {K}, '{{' || chr(10) || '  \"code\": \"' || o_orderstatus || '\",' || chr(10) || '  \"even\": ' || (CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END) || chr(10) || '}}' AS status FROM orders")
def _(spark, d):
    return dealt(spark, d).select("key", json_docs.json_get(F.col("doc"), "status", "  ", "\n", " ").alias("status"))


@query("json_mget", "SELECT o_orderkey AS seq, 'order:' || (o_orderkey * 2) AS key, (SELECT '\"' || x.o_orderstatus || '\"' FROM orders x WHERE x.o_orderkey = orders.o_orderkey * 2) AS value FROM orders")
def _(spark, d):
    wanted = ks.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("order:"), (F.col("o_orderkey") * 2).cast("string")).alias("key"))
    return json_docs.mget(docs(spark, d), wanted, "status.code")


@query("json_type", f"SELECT {K}, 'integer' AS id, 'object' AS status, 'boolean' AS even, 'array' AS nums, 'string' AS priority, NULL::VARCHAR AS missing FROM orders")
def _(spark, d):
    kind = lambda p: json_docs.type_of(F.col("doc"), p)
    return docs(spark, d).select("key", kind("$.id").alias("id"), kind("$.status").alias("status"), kind("$.status.even").alias("even"), kind("$.nums").alias("nums"), kind("$.priority").alias("priority"), kind("$.zz").alias("missing"))


@query("json_numincrby", f"SELECT {K}, '[' || (o_orderkey + 5) || ']' AS added, (o_orderkey * 3)::VARCHAR AS multiplied, '[null]' AS none, '[]' AS missing, o_orderkey || '.5' AS half FROM orders")
def _(spark, d):
    step = lambda p, n, t=False: json_docs.numincrby(F.col("doc"), p, n, t)
    return docs(spark, d).select("key", step("$.id", 5).alias("added"), step("id", 3, True).alias("multiplied"), step("$.priority", 1).alias("none"), step("$.zz", 1).alias("missing"), step("id", 0.5).alias("half"))


@query("json_objkeys", f"SELECT {K}, 'id,nums,priority,status' AS keys, 2 AS inner_length FROM orders")
def _(spark, d):
    return docs(spark, d).select("key", F.array_join(json_docs.objkeys(F.col("doc")), ",").alias("keys"), json_docs.objlen(F.col("doc"), "$.status").alias("inner_length"))


@query("json_lengths", f"SELECT {K}, strlen(o_orderpriority) AS text, 3 AS list FROM orders")
def _(spark, d):
    return docs(spark, d).select("key", json_docs.strlen(F.col("doc"), "$.priority").alias("text"), json_docs.arrlen(F.col("doc"), "$.nums").alias("list"))


def _edited(name: str, path: str, change, doc_sql: str, reply_sql: str, create: bool = False) -> None:
    @query(name, f"SELECT {K}, {doc_sql} AS doc, {reply_sql} AS reply FROM orders")
    def _(spark, d):
        return json_docs.edit(dealt(spark, d), path, change, create)


BODY = {
    "id": "o_orderkey", "nums": "'[' || o_custkey || ',' || (o_custkey + 1) || ',7]'", "priority": "'\"' || o_orderpriority || '\"'",
    "status": "'{\"code\":\"' || o_orderstatus || '\",\"even\":' || (CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END) || '}'",
}


def doc_sql(**changed: str) -> str:
    """SQL of the document with some members given anew (None: left out)."""
    body = {k: v for k, v in (BODY | changed).items() if v is not None}
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {body[k]}" for k in sorted(body)) + " || '}'"


LESS = "'[' || (o_custkey + 1) || ',7]'"
_edited("json_set", "$.priority", json_docs.set_to(1), doc_sql(priority="'1'"), "'[\"OK\"]'")
_edited("json_set_new", "$.extra", json_docs.set_to([1, 2]), doc_sql(extra="'[1,2]'"), "'[\"OK\"]'", create=True)
_edited("json_del", "$.nums[0]", json_docs.delete(), doc_sql(nums=LESS), "'[1]'")
_edited("json_strappend", "priority", json_docs.strappend("é"), doc_sql(priority="'\"' || o_orderpriority || 'é\"'"), "(strlen(o_orderpriority) + 2)::VARCHAR")
_edited("json_toggle", "$.status.even", json_docs.toggle(), doc_sql(status=BODY["status"].replace("% 2 = 0", "% 2 = 1")), "'[' || (o_orderkey % 2) || ']'")
_edited("json_arrappend", "$.nums", json_docs.arrappend("x", 5), doc_sql(nums="'[' || o_custkey || ',' || (o_custkey + 1) || ',7,\"x\",5]'"), "'[5]'")
_edited("json_arrinsert", "$.nums", json_docs.arrinsert(-1, True), doc_sql(nums="'[' || o_custkey || ',' || (o_custkey + 1) || ',true,7]'"), "'[4]'")
_edited("json_arrpop", "$.nums", json_docs.arrpop(0), doc_sql(nums=LESS), "'[' || o_custkey || ']'")
_edited("json_arrtrim", "$.nums", json_docs.arrtrim(1, -1), doc_sql(nums=LESS), "'[2]'")
_edited("json_arrindex", "$.nums", json_docs.arrindex(7), doc_sql(), "'[' || (CASE WHEN o_custkey = 7 THEN 0 WHEN o_custkey = 6 THEN 1 ELSE 2 END) || ']'")
_edited("json_clear", "$.*", json_docs.clear(), doc_sql(id="'0'", nums="'[]'", status="'{}'"), "'[' || (o_orderkey <> 0)::INT || ',1,0,1]'")
_edited("json_merge", "$", json_docs.merge({"priority": None, "status": {"even": None, "new": 1}}), doc_sql(priority=None, status="'{\"code\":\"' || o_orderstatus || '\",\"new\":1}'"), "'[\"OK\"]'")


@query("json_nodes", f"WITH v AS (SELECT {K}, o_orderkey, o_orderstatus, o_custkey, o_orderpriority FROM orders) " + " UNION ALL ".join(
    f"SELECT key, '{p}' AS path, '{k}' AS kind, {v} AS value FROM v" for p, k, v in (
        ("$", "object", "NULL"), ("$.id", "integer", "o_orderkey::VARCHAR"), ("$.status", "object", "NULL"), ("$.status.code", "string", "'\"' || o_orderstatus || '\"'"),
        ("$.status.even", "boolean", "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END"), ("$.nums", "array", "NULL"), ("$.nums[0]", "integer", "o_custkey::VARCHAR"),
        ("$.nums[1]", "integer", "(o_custkey + 1)::VARCHAR"), ("$.nums[2]", "integer", "'7'"), ("$.priority", "string", "'\"' || o_orderpriority || '\"'"))))
def _(spark, d):
    return dealt(spark, d).select("key", F.inline(json_docs.decompose("doc")))


@query("json_build", f"SELECT {K}, {doc_sql()} AS doc FROM orders")
def _(spark, d):
    """Documents read back from their nodes."""
    return json_docs.build(dealt(spark, d).select("key", F.inline(json_docs.decompose("doc"))))


# Budgets


def shares(spark, d):
    """Each priority's budget, shared by three nodes."""
    held = ks.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg((F.count("*") * 10_000 + 2).alias("capacity"))
    return budgets.create(held.withColumn("nodes", F.array(F.lit("n2"), F.lit("n0"), F.lit("n1"), F.lit("n0"))))


def requests(spark, d):
    return ks.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("key"), F.concat(F.lit("n"), (F.col("o_custkey") % 3).cast("string")).alias("node"), F.col("o_orderkey").alias("seq"), F.floor("o_totalprice").cast("bigint").alias("amount")
    )


SHARE = "(SELECT o_orderpriority AS key, 'n' || i AS node, (count(*) * 10000 + 2) // 3 + (i < (count(*) * 10000 + 2) % 3)::BIGINT AS alloc FROM orders, range(3) t(i) GROUP BY o_orderpriority, i)"


@query("budget_create", f"SELECT key, node, alloc::BIGINT AS alloc FROM {SHARE}")
def _(spark, d):
    return shares(spark, d)


@query("budget_topup", f"SELECT key, node, (alloc + 33 + (node = 'n0')::BIGINT)::BIGINT AS alloc FROM {SHARE}")
def _(spark, d):
    held = shares(spark, d)
    return budgets.topup(held, held.select("key").distinct().withColumn("amount", F.lit(100)))


@query(
    "budget_admit",
    "WITH RECURSIVE q AS (SELECT o_orderpriority AS key, 'n' || (o_custkey % 3) AS node, o_orderkey AS seq, floor(o_totalprice)::BIGINT AS amount, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 3 ORDER BY o_orderkey) AS i FROM orders), "
    f"r AS (SELECT q.key, q.node, q.seq, q.amount, q.i, s.alloc, q.amount <= s.alloc AS granted, CASE WHEN q.amount <= s.alloc THEN q.amount ELSE 0 END AS used FROM q JOIN {SHARE} s USING (key, node) WHERE i = 1 "
    "UNION ALL SELECT q.key, q.node, q.seq, q.amount, q.i, r.alloc, r.used + q.amount <= r.alloc, r.used + CASE WHEN r.used + q.amount <= r.alloc THEN q.amount ELSE 0 END FROM r JOIN q ON q.key = r.key AND q.node = r.node AND q.i = r.i + 1) "
    "SELECT key, node, seq, amount, granted FROM r",
)
def _(spark, d):
    return budgets.reserve(requests(spark, d), shares(spark, d))


@query("budget_window", "SELECT o_orderpriority AS key, epoch_us(o_orderdate) // 1000 // 86400000 // 30 AS win, sum(floor(o_totalprice)::BIGINT)::BIGINT AS asked FROM orders GROUP BY ALL")
def _(spark, d):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    rows = ks.table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), budgets.window_of(ks.millis(F.col("o_orderdate")) if dict(ks.table(spark, d, "orders").dtypes)["o_orderdate"] == "timestamp_ntz" else ms, 30 * 86_400_000).alias("win"), F.floor("o_totalprice").alias("a"))
    return rows.groupBy("key", "win").agg(F.sum("a").cast("bigint").alias("asked"))


def tokens(spark, d):
    """Orders as tokens: their status is the token's rank."""
    rank = F.when(F.col("o_orderstatus") == "O", budgets.OPEN).when(F.col("o_orderstatus") == "P", budgets.EXPIRED).otherwise(budgets.FOLDED)
    amount = F.floor("o_totalprice").cast("bigint")
    return ks.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("token"), F.concat(F.lit("n"), (F.col("o_custkey") % 3).cast("string")).alias("node"), amount.alias("amount"),
        F.floor(amount / 4).cast("bigint").alias("spent"), F.floor(amount / 4).cast("bigint").alias("drawn"), rank.alias("rank"), F.lit(1000).cast("bigint").alias("deadline_ms"),
    )


@query(
    "budget_commit",
    "SELECT o_orderpriority AS key, o_orderkey AS token, (CASE WHEN status = 'OK' THEN a - b END)::VARCHAR AS credited, status FROM (SELECT *, floor(o_totalprice)::BIGINT AS a, floor(o_totalprice)::BIGINT // 2 AS b, "
    "CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN 'TOKENUSED' WHEN o_orderstatus = 'P' OR o_orderkey % 3 = 0 THEN 'TOKENEXPIRED' ELSE 'OK' END AS status FROM orders)",
)
def _(spark, d):
    held = tokens(spark, d)
    ask = held.select("key", "token", F.floor(F.col("amount") / 2).cast("bigint").alias("spent"), F.when(F.col("token") % 3 == 0, 1000).otherwise(999).alias("at_ms"))
    return budgets.settle(held.drop("spent"), ask).withColumn("credited", F.col("credited").cast("string"))


@query(
    "budget_info",
    f"WITH cap AS (SELECT key, sum(alloc) AS capacity FROM {SHARE} GROUP BY key), t AS (SELECT o_orderpriority AS key, sum(floor(o_totalprice)::BIGINT // 10) AS o, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS n, "
    "sum(floor(o_totalprice)::BIGINT - floor(o_totalprice)::BIGINT // 4) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS m FROM orders GROUP BY 1) "
    "SELECT key, capacity::BIGINT AS capacity, o::BIGINT AS outstanding, (capacity - o)::BIGINT AS available, n AS open_tokens, coalesce(m, 0)::BIGINT AS open_amount FROM cap JOIN t USING (key)",
)
def _(spark, d):
    slots = tokens(spark, d).select("key", F.lit(1).alias("gen"), "node", F.floor(F.col("amount") / 10).cast("bigint").alias("granted"), F.lit(0).cast("bigint").alias("returned"))
    out = budgets.info(shares(spark, d), slots, tokens(spark, d))
    return out.select("key", *[F.col(c).cast("bigint").alias(c) for c in ("capacity", "outstanding", "available", "open_tokens", "open_amount")])


@query(
    "budget_reclaim",
    f"WITH u AS (SELECT o_orderpriority AS key, sum(CASE WHEN o_orderstatus IN ('O', 'P') THEN 1 ELSE 0 END) AS t FROM orders WHERE o_custkey % 3 = 1 GROUP BY 1), "
    f"x AS (SELECT s.key, least(alloc, coalesce(t, 0)) AS keep, alloc - least(alloc, coalesce(t, 0)) AS free FROM {SHARE} s LEFT JOIN u USING (key) WHERE node = 'n1') "
    f"SELECT key, node, (CASE node WHEN 'n1' THEN keep ELSE alloc + free // 2 + (node = 'n0' AND free % 2 = 1)::BIGINT END)::BIGINT AS alloc FROM {SHARE} s JOIN x USING (key)",
)
def _(spark, d):
    held = tokens(spark, d).withColumns({"amount": F.lit(1).cast("bigint"), "spent": F.lit(0).cast("bigint")})
    slots = held.select("key", "node", F.lit(0).cast("bigint").alias("granted"), F.lit(0).cast("bigint").alias("returned")).distinct()
    return budgets.reclaim(shares(spark, d), slots, held, "n1")


# Channels and bindings

PATTERNS = [("a", "v*"), ("b", "[ce]*"), ("c", "?ignup"), ("d", "view")]


@query("pubsub_receivers", "SELECT event_id AS seq, event_type AS channel, (CASE WHEN event_type LIKE 'v%' THEN 1 ELSE 0 END + CASE WHEN regexp_matches(event_type, '^[ce]') THEN 1 ELSE 0 END + CASE WHEN event_type LIKE '_ignup' THEN 1 ELSE 0 END + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END + CASE WHEN event_type IN ('view', 'error') THEN 2 ELSE 0 END)::BIGINT AS receivers FROM events")
def _(spark, d):
    messages = ks.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("channel"))
    subscribed = spark.createDataFrame([(s, c) for s in "xy" for c in ("view", "error", "quiet")], "subscriber string, channel string")
    return pubsub.receivers(messages, subscribed, PATTERNS)


@query("pubsub_match", "SELECT event_id AS seq, event_type AS channel, s AS subscriber, p AS pattern FROM events, (VALUES ('a', 'v*', '^v'), ('b', '[ce]*', '^[ce]'), ('c', '?ignup', '^.ignup$'), ('d', 'view', '^view$')) t(s, p, r) WHERE regexp_matches(event_type, r)")
def _(spark, d):
    return pubsub.deliveries(ks.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("channel")), PATTERNS)


@query("pubsub_numsub", "SELECT event_type AS channel, count(DISTINCT user_id) AS n FROM events WHERE event_type LIKE '%i%' GROUP BY 1")
def _(spark, d):
    return pubsub.channels(ks.table(spark, d, "events").select(F.col("user_id").alias("subscriber"), F.col("event_type").alias("channel")).distinct(), "*i*")


@query("bind_longest_prefix", "SELECT 'cust:' || c_custkey AS key, CASE WHEN c_custkey::VARCHAR LIKE '12%' THEN 'cust:12' WHEN c_custkey::VARCHAR LIKE '1%' THEN 'cust:1' ELSE 'cust:' END AS prefix, CASE WHEN c_custkey::VARCHAR LIKE '12%' THEN 'c' WHEN c_custkey::VARCHAR LIKE '1%' THEN 'b' ELSE 'a' END AS type FROM customer")
def _(spark, d):
    bound = spark.createDataFrame([("cust:", "a"), ("cust:1", "b"), ("cust:12", "c"), ("other:", "d")], "prefix string, type string")
    return pubsub.bind_longest_prefix(ks.customer_strings(spark, d), bound)


@query("glob_classes", "SELECT c_name FROM customer WHERE regexp_matches(c_name, '^C.st.*[^3-9][05]$')")
def _(spark, d):
    c = ks.table(spark, d, "customer").select("c_name")
    return c.where(glob_match(F.col("c_name"), "C?st*[!3-9][05]"))


@query("rga_order", "SELECT 'u:' || user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS nth, event_type AS value FROM events WHERE event_type <> 'error'")
def _(spark, d):
    """Every event is inserted at the head of its user's array; errors are dead."""
    e = ks.table(spark, d, "events")
    return merge.rga(e.select(
        F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("hlc"), F.lit(0).alias("origin"), F.lit(-1).cast("bigint").alias("left_hlc"), F.lit(0).alias("left_origin"),
        F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("tomb"),
    ))


if find_spec("google") is not None and find_spec("google.protobuf") is not None:

    @query("proto_fields", "SELECT 'ev:' || event_id AS key, event_type AS kind, nullif(user_id, 0)::VARCHAR AS who, NULL::VARCHAR AS missing FROM events")
    def _(spark, d):
        from google.protobuf import descriptor_pb2

        from keyloom.operators import proto

        file = descriptor_pb2.FileDescriptorProto(name="event.proto", package="demo", syntax="proto3")
        message = file.message_type.add(name="Event")
        kinds = descriptor_pb2.FieldDescriptorProto
        for number, (name, kind) in enumerate((("kind", kinds.TYPE_STRING), ("user", kinds.TYPE_INT64), ("note", kinds.TYPE_STRING)), 1):
            message.field.add(name=name, number=number, type=kind, label=kinds.LABEL_OPTIONAL)
        registry = proto.Registry()
        registry.set_schema("events", descriptor_pb2.FileDescriptorSet(file=[file]).SerializeToString())
        registry.bind("ev:", "demo.Event")
        name, held = registry.bound("ev:1")
        text = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("user")))
        rows = ks.table(spark, d, "events").select(F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("key"), proto.set_json(text, held, name).alias("value"))
        get = lambda path: proto.get_field(F.col("value"), held, name, path)
        return rows.select("key", get("kind").alias("kind"), get("2").alias("who"), get("note").alias("missing"))
