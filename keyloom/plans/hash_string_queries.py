"""Strings, counters, hashes, merges and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions.scalars import render_double
from keyloom.operators import hashes, keyspace, merge, replicas, snapshot, strings
from keyloom.sources import keyspaces as ks

from .registry import query

NOW = 1_705_000_000_000  # a moment within the events' month


def merged(spark, d):
    """Hashes after the merge: (key, field, value, ttl_ms)."""
    log = ks.user_hashes_log(spark, d).select("key", "field", "value", "ttl_ms", "hlc", "origin")
    return merge.lww(log, ["key", "field"]).select("key", "field", "value", "ttl_ms")


def field_requests(spark, d):
    """Every event asks for the field `view` of a user, some of whom don't exist."""
    return ks.table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("user:"), (F.col("user_id") + F.col("event_id") % 7).cast("string")).alias("key"), F.lit("view").alias("field")
    )


FIELD_REQUESTS = "(SELECT event_id AS seq, 'user:' || (user_id + event_id % 7) AS key, 'view' AS field FROM events)"
CUST_REQUESTS = "(SELECT o_orderkey AS seq, 'cust:' || (o_custkey + o_orderkey % 3 * 1000) AS key FROM orders)"


def customer_requests(spark, d):
    return ks.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("cust:"), (F.col("o_custkey") + F.col("o_orderkey") % 3 * 1000).cast("string")).alias("key"))


@query("lww_merge_hash", "SELECT key, field, value FROM hm")
def _(spark, d):
    return merged(spark, d).select("key", "field", "value")


@query("hgetall", "SELECT key, string_agg(field || '=' || value::DECIMAL(18,2), ',' ORDER BY field) AS entries FROM hm GROUP BY key")
def _(spark, d):
    text = lambda e: F.concat_ws("=", e["field"], e["value"].cast("decimal(18,2)").cast("string"))
    return hashes.hgetall(merged(spark, d)).select("key", F.array_join(F.transform("entries", text), ",").alias("entries"))


@query("hkeys", "SELECT key, string_agg(field, ',' ORDER BY field) AS fields FROM hm GROUP BY key")
def _(spark, d):
    return hashes.hkeys(merged(spark, d)).select("key", F.array_join("fields", ",").alias("fields"))


@query("hvals", "SELECT key, string_agg(value::DECIMAL(18,2), ',' ORDER BY field) AS vals FROM hm GROUP BY key")
def _(spark, d):
    return hashes.hvals(merged(spark, d)).select("key", F.array_join(F.transform("values", lambda v: v.cast("decimal(18,2)").cast("string")), ",").alias("vals"))


@query("hlen", "SELECT key, count(*) AS length FROM hm GROUP BY key")
def _(spark, d):
    return hashes.hlen(merged(spark, d))


@query("hget", f"SELECT seq, r.key, r.field, value FROM {FIELD_REQUESTS} r LEFT JOIN hm USING (key, field)")
def _(spark, d):
    return hashes.hget(merged(spark, d), field_requests(spark, d))


@query("hmget", "SELECT key, max(CASE WHEN field = 'view' THEN value END) AS v, max(CASE WHEN field = 'nothing' THEN value END) AS n, max(CASE WHEN field = 'click' THEN value END) AS c FROM hm GROUP BY key")
def _(spark, d):
    got = hashes.hmget(merged(spark, d), ["view", "nothing", "click"])
    return got.select("key", F.col("values")[0].alias("v"), F.col("values")[1].alias("n"), F.col("values")[2].alias("c"))


@query("hexists", f"SELECT seq, r.key, r.field, (hm.key IS NOT NULL)::BIGINT AS reply FROM {FIELD_REQUESTS} r LEFT JOIN hm USING (key, field)")
def _(spark, d):
    return hashes.hexists(merged(spark, d), field_requests(spark, d))


@query("hstrlen", "SELECT s.seq, s.key, coalesce(strlen(v.value), 0) AS length FROM " + CUST_REQUESTS + " s LEFT JOIN str v USING (key)")
def _(spark, d):
    held = ks.customer_strings(spark, d).select("key", F.lit("f").alias("field"), "value")
    return hashes.hstrlen(held, customer_requests(spark, d).withColumn("field", F.lit("f"))).select("seq", "key", "length")


@query("hset_created", "SELECT key, count(DISTINCT field) FILTER (WHERE field <> 'view') AS created FROM h GROUP BY key")
def _(spark, d):
    log = ks.user_hashes_log(spark, d)
    held = merged(spark, d).where("field = 'view'")
    return hashes.hset(held, log.select("key", "field", "value", F.col("event_id").alias("seq")))[1]


@query("hsetnx", "SELECT key, field, arg_min(value, event_id) AS value FROM h WHERE field <> 'view' GROUP BY key, field")
def _(spark, d):
    log = ks.user_hashes_log(spark, d).select("key", "field", "value", F.col("event_id").alias("seq"))
    return hashes.hsetnx(log.where("field = 'view'"), log)


@query("hsetex_fnx", "SELECT req, key, field, value FROM (SELECT event_id // 3 AS req, key, field, value, bool_and(field <> 'view') OVER (PARTITION BY event_id // 3) AS ok FROM h) WHERE ok")
def _(spark, d):
    log = ks.user_hashes_log(spark, d)
    held = log.where("field = 'view'").select("key", "field").distinct()
    return hashes.hsetex(held, log.select(F.floor(F.col("event_id") / 3).alias("req"), "key", "field", "value"), "FNX")


@query("hdel", "SELECT key, field, value FROM hm WHERE field NOT IN ('click', 'nothing')")
def _(spark, d):
    held = merged(spark, d).select("key", "field", "value")
    gone = held.select("key").distinct().select("key", F.explode(F.array(F.lit("click"), F.lit("nothing"))).alias("field"))
    return hashes.hdel(held, gone)[0]


@query("hgetdel", "SELECT key, field, value FROM hm WHERE field = 'click'")
def _(spark, d):
    held = merged(spark, d).select("key", "field", "value")
    return hashes.hgetdel(held, held.select("key").distinct().withColumn("field", F.lit("click")))[0]


@query("hincrby", "SELECT 'user:' || user_id AS key, event_type AS field, (sum(event_id % 100) + 5)::BIGINT AS value, false AS error FROM events GROUP BY 1, 2")
def _(spark, d):
    log = ks.user_hashes_log(spark, d)
    held = log.select("key", "field").distinct().withColumn("value", F.lit("5"))
    return hashes.hincrby(held, log.select("key", "field", (F.col("event_id") % 100).alias("delta")))


@query("hincrbyfloat", "SELECT 'user:' || user_id AS key, event_type AS field, sum(event_id % 100) / 4.0 + 0.5 AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    log = ks.user_hashes_log(spark, d)
    held = log.select("key", "field").distinct().withColumn("value", F.lit("0.5"))
    return hashes.hincrbyfloat(held, log.select("key", "field", (F.col("event_id") % 100 / 4).alias("delta")))


@query("hrandfield", "SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('7|' || field), field) AS n FROM hm) WHERE n <= 2")
def _(spark, d):
    return hashes.hrandfield(merged(spark, d), 2, seed=7)


@query("hscan_glob", "SELECT key, field, value FROM hm WHERE regexp_matches(field, '^[b-d]l.*k$')")
def _(spark, d):
    return hashes.hscan(merged(spark, d), "[b-d]l*k").select("key", "field", "value")


@query("hash_field_ttl", f"SELECT seq, r.key, r.field, CASE WHEN hm.key IS NULL THEN -2 ELSE floor((ttl_ms - {NOW}) / 1000)::BIGINT END AS reply FROM {FIELD_REQUESTS} r LEFT JOIN hm USING (key, field)")
def _(spark, d):
    return hashes.httl(merged(spark, d), field_requests(spark, d), NOW)


@query("hexpire_gt", f"SELECT key, field, {NOW + 86_400_000} AS deadline, (CASE WHEN {NOW + 86_400_000} > ttl_ms THEN 1 ELSE 0 END)::BIGINT AS reply FROM hm")
def _(spark, d):
    held = merged(spark, d)
    return hashes.hexpire(held, held.select("key", "field", F.lit(NOW + 86_400_000).alias("deadline")), NOW, "GT")


@query("hpersist", f"SELECT r.key, r.field, (CASE WHEN hm.key IS NULL THEN -2 ELSE 1 END)::BIGINT AS reply FROM {FIELD_REQUESTS} r LEFT JOIN hm USING (key, field)")
def _(spark, d):
    return hashes.hpersist(merged(spark, d), field_requests(spark, d))


@query(
    "or_merge_visible",
    "WITH c AS (SELECT DISTINCT a.key, a.field, a.hlc, a.origin FROM h a JOIN h b ON a.key = b.key AND a.field = b.field AND b.event_id % 5 = 0 AND a.hlc < b.hlc) "
    "SELECT key, field, arg_max(value, row(hlc, origin)) AS value, max(hlc) AS hlc, count(*) AS live FROM h ANTI JOIN c USING (key, field, hlc, origin) GROUP BY key, field",
)
def _(spark, d):
    """Every fifth event covers the dots of its field that came before it."""
    log = ks.user_hashes_log(spark, d)
    seen = log.where("event_id % 5 = 0").groupBy("key", "field").agg(F.max("hlc").alias("upto"))
    covers = log.join(seen, ["key", "field"]).where("hlc < upto").select("key", F.col("field").alias("elem"), "hlc", "origin")
    return merge.or_elements(log.withColumnRenamed("field", "elem"), covers).select("key", F.col("elem").alias("field"), "value", "hlc", "live")


@query("ttl_snapshot", f"SELECT key, field, value, hlc FROM h WHERE NOT tomb AND ttl_ms > {NOW}")
def _(spark, d):
    return snapshot.visible(ks.user_hashes_log(spark, d), NOW).select("key", "field", "value", "hlc")


@query(
    "delete_clock_filter",
    f"WITH c AS (SELECT key, max(hlc) AS del FROM h WHERE field = 'signup' GROUP BY key) SELECT h.key, field, value, hlc FROM h LEFT JOIN c USING (key) WHERE NOT tomb AND ttl_ms > {NOW} AND hlc > coalesce(del, 0)",
)
def _(spark, d):
    log = ks.user_hashes_log(spark, d)
    heads = log.where("field = 'signup'").select("key", F.col("hlc").alias("del_hlc"), F.lit(0).cast("bigint").alias("hlc"), F.lit(0).cast("bigint").alias("ttl_ms"), F.lit(False).alias("tomb"))
    return snapshot.visible(log, NOW, heads).select("key", "field", "value", "hlc")


@query("expiry_sweep", f"SELECT key, field, ttl_ms * 65536 AS hlc FROM h WHERE NOT tomb AND ttl_ms <= {NOW}")
def _(spark, d):
    return snapshot.expiry_sweep(ks.user_hashes_log(spark, d), NOW).select("key", "field", "hlc")


@query("tombstone_gc", f"SELECT key, field, hlc FROM h WHERE NOT (tomb AND ms < {NOW} - 3600000)")
def _(spark, d):
    return snapshot.collect_garbage(ks.user_hashes_log(spark, d), NOW).select("key", "field", "hlc")


@query("pn_counter_value", "SELECT key, (sum(p) - sum(p // 3))::BIGINT AS value, false AS overflow FROM (SELECT key, node, max(pos) AS p FROM hits GROUP BY key, node) GROUP BY key")
def _(spark, d):
    return merge.pn_counters(ks.hit_slots(spark, d))


@query("incrby", "SELECT 'cust:' || o_custkey AS key, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE (count(*) + o_custkey)::BIGINT::VARCHAR END AS value, o_custkey % 50 = 0 AS error FROM orders GROUP BY o_custkey")
def _(spark, d):
    """Every fiftieth counter starts at the greatest 64-bit number, so adding to it is an error."""
    orders = ks.table(spark, d, "orders")
    key = F.concat(F.lit("cust:"), F.col("o_custkey").cast("string"))
    start = F.when(F.col("o_custkey") % 50 == 0, F.lit("9223372036854775807")).otherwise(F.col("o_custkey").cast("string"))
    held = orders.select(key.alias("key"), start.alias("value")).distinct()
    return strings.incrby(held, orders.select(key.alias("key"), F.lit(1).alias("delta"))).withColumn("value", F.col("value").cast("string"))


@query("incrbyfloat", "SELECT 'cust:' || o_custkey AS key, CASE WHEN count(*) % 2 = 0 THEN (count(*) // 2)::VARCHAR ELSE (count(*) // 2)::VARCHAR || '.5' END AS value FROM orders GROUP BY o_custkey")
def _(spark, d):
    key = F.concat(F.lit("cust:"), F.col("o_custkey").cast("string"))
    none = ks.customer_strings(spark, d).limit(0)
    return strings.incrbyfloat(none, ks.table(spark, d, "orders").select(key.alias("key"), F.lit(0.5).alias("delta")))


@query("mget", f"SELECT seq, r.key, value FROM {CUST_REQUESTS} r LEFT JOIN (SELECT key, value FROM str) USING (key)")
def _(spark, d):
    return strings.mget(ks.customer_strings(spark, d), customer_requests(spark, d))


@query("strlen", f"SELECT r.seq, r.key, coalesce(strlen(value), 0) AS length FROM {CUST_REQUESTS} r LEFT JOIN str USING (key)")
def _(spark, d):
    return strings.strlen(ks.customer_strings(spark, d), customer_requests(spark, d))


@query("append", "SELECT 'cust:' || o_custkey AS key, coalesce(any_value(value), '') || string_agg(o_orderpriority, '' ORDER BY o_orderkey) AS value FROM orders LEFT JOIN str ON str.key = 'cust:' || o_custkey GROUP BY o_custkey")
def _(spark, d):
    patches = ks.table(spark, d, "orders").select(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("patch"))
    return strings.append(ks.customer_strings(spark, d), patches).select("key", "value")


@query("getrange", "SELECT key, substr(value, 3, 6) AS a, right(value, 4) AS b, '' AS c FROM str")
def _(spark, d):
    v = F.col("value")
    return ks.customer_strings(spark, d).select("key", strings.getrange(v, 2, 7).alias("a"), strings.getrange(v, -4, -1).alias("b"), strings.getrange(v, 5, 2).alias("c"))


@query("setrange", "SELECT key, left(value, 4) || 'XYZ' || substr(value, 8) AS value FROM str")
def _(spark, d):
    return ks.customer_strings(spark, d).select("key", strings.setrange(F.col("value"), 4, "XYZ").cast("string").alias("value"))


@query("set_last_wins", "SELECT key, value FROM str WHERE key NOT IN (SELECT 'cust:' || o_custkey FROM orders) UNION ALL SELECT 'cust:' || o_custkey, arg_max(o_orderpriority, o_orderkey) FROM orders GROUP BY o_custkey")
def _(spark, d):
    writes = ks.table(spark, d, "orders").select(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    return strings.set_values(ks.customer_strings(spark, d), writes)


@query("setnx_guard", f"SELECT DISTINCT r.key, (str.key IS NULL)::BIGINT AS reply FROM {CUST_REQUESTS} r LEFT JOIN str USING (key)")
def _(spark, d):
    return strings.setnx(ks.customer_strings(spark, d), customer_requests(spark, d))


@query("msetnx", "WITH r AS (SELECT o_orderkey // 2 AS req, 'cust:' || (o_custkey + o_orderkey % 3 * 1000) AS key, o_orderpriority AS value FROM orders) SELECT req, key, value FROM r WHERE req NOT IN (SELECT req FROM r JOIN str USING (key))")
def _(spark, d):
    requests = ks.table(spark, d, "orders").select(
        F.floor(F.col("o_orderkey") / 2).alias("req"), F.concat(F.lit("cust:"), (F.col("o_custkey") + F.col("o_orderkey") % 3 * 1000).cast("string")).alias("key"), F.col("o_orderpriority").alias("value")
    )
    return strings.msetnx(ks.customer_strings(spark, d), requests)


@query("getset", "SELECT 'cust:' || o_custkey AS key, any_value(value) AS old, arg_max(o_orderpriority, o_orderkey) AS value FROM orders LEFT JOIN (SELECT key, value FROM str) v ON v.key = 'cust:' || o_custkey GROUP BY o_custkey".replace("any_value(value)", "any_value(v.value)"))
def _(spark, d):
    writes = ks.table(spark, d, "orders").select(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    return strings.getset(ks.customer_strings(spark, d), writes)


@query("getdel_rest", "SELECT key, value FROM str WHERE seq % 4 <> 0")
def _(spark, d):
    held = ks.customer_strings(spark, d)
    return strings.getdel(held, held.where("seq % 4 = 0").select("key"))[1].select("key", "value")


@query("get_counter_text", "SELECT c_name AS key, CASE WHEN floor(c_acctbal) = c_acctbal THEN floor(c_acctbal)::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END AS value FROM customer")
def _(spark, d):
    return ks.table(spark, d, "customer").select(F.col("c_name").alias("key"), render_double(F.col("c_acctbal")).alias("value"))


# Whole keys


def catalog(spark, d):
    """Strings, hashes and sorted sets in one catalog."""
    s = ks.customer_strings(spark, d).select("key", F.lit("string").alias("type"), F.lit(0).cast("bigint").alias("ttl_ms"))
    h = merged(spark, d).groupBy("key").agg(F.lit("hash").alias("type"), F.max("ttl_ms").alias("ttl_ms")).select("key", "type", "ttl_ms")
    z = ks.customer_ranks(spark, d).select("key").distinct().select("key", F.lit("zset").alias("type"), F.lit(0).cast("bigint").alias("ttl_ms"))
    return s.unionByName(h).unionByName(z)


CATALOG = "(SELECT key, 'string' AS type, 0 AS ttl_ms FROM str UNION ALL SELECT key, 'hash', max(ttl_ms) FROM hm GROUP BY key UNION ALL SELECT DISTINCT key, 'zset', 0 FROM z)"
MIXED = "(SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'cust:' WHEN 1 THEN 'user:' ELSE 'rank:' END || user_id AS key FROM events)"


def mixed_requests(spark, d):
    head = F.when(F.col("event_id") % 3 == 0, "cust:").when(F.col("event_id") % 3 == 1, "user:").otherwise("rank:")
    return ks.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(head, F.col("user_id").cast("string")).alias("key"))


@query("type_of", f"SELECT seq, r.key, coalesce(type, 'none') AS type FROM {MIXED} r LEFT JOIN {CATALOG} c USING (key)")
def _(spark, d):
    return keyspace.type_of(catalog(spark, d), mixed_requests(spark, d))


@query("exists_multi", f"SELECT count(*) AS n FROM {MIXED} r WHERE key IN (SELECT key FROM {CATALOG})")
def _(spark, d):
    return keyspace.exists(catalog(spark, d), mixed_requests(spark, d))


@query("ttl_keys", f"SELECT seq, r.key, CASE WHEN c.key IS NULL THEN -2 WHEN ttl_ms = 0 THEN -1 ELSE floor((ttl_ms - {NOW}) / 1000)::BIGINT END AS reply FROM {MIXED} r LEFT JOIN {CATALOG} c USING (key)")
def _(spark, d):
    return keyspace.ttl(catalog(spark, d), mixed_requests(spark, d), NOW)


@query("expiretime", f"SELECT seq, r.key, CASE WHEN c.key IS NULL THEN -2 WHEN ttl_ms = 0 THEN -1 ELSE ttl_ms // 1000 END AS reply FROM {MIXED} r LEFT JOIN {CATALOG} c USING (key)")
def _(spark, d):
    return keyspace.ttl(catalog(spark, d), mixed_requests(spark, d), NOW, absolute=True)


@query("expire_keys", f"SELECT key, type, CASE WHEN type = 'string' THEN {NOW + 5000} ELSE ttl_ms END AS ttl_ms FROM {CATALOG} c WHERE type <> 'zset'")
def _(spark, d):
    held = catalog(spark, d)
    due = held.where("type <> 'hash'").select("key", F.when(F.col("type") == "zset", F.lit(NOW - 1)).otherwise(F.lit(NOW + 5000)).alias("deadline"))
    return keyspace.expire(held, due, NOW)[0]


@query("persist_keys", f"SELECT key, (ttl_ms <> 0)::BIGINT AS reply FROM {CATALOG} c")
def _(spark, d):
    held = catalog(spark, d)
    return keyspace.persist(held, held.select("key"))[1]


@query("keys_glob", f"SELECT key FROM {CATALOG} c WHERE regexp_matches(key, '^cust:1[0-4].$')")
def _(spark, d):
    return keyspace.keys(catalog(spark, d), "cust:1[0-4]?")


@query("scan_page", f"SELECT key FROM {CATALOG} c WHERE key > 'cust:5' ORDER BY key LIMIT 100")
def _(spark, d):
    return keyspace.scan(catalog(spark, d), "cust:5", 100)


@query("dbsize", f"SELECT count(DISTINCT key) AS n FROM {CATALOG} c")
def _(spark, d):
    return keyspace.dbsize(catalog(spark, d))


@query("info_keyspace", f"SELECT type, count(*) AS keys, count(*) FILTER (WHERE ttl_ms <> 0) AS expiring FROM {CATALOG} c GROUP BY type")
def _(spark, d):
    return keyspace.info(catalog(spark, d))


@query("object_encoding", f"SELECT key, CASE type WHEN 'string' THEN 'raw' WHEN 'hash' THEN 'hashtable' ELSE 'skiplist' END AS encoding FROM {CATALOG} c")
def _(spark, d):
    return keyspace.object_encoding(catalog(spark, d))


@query("delete_keys", f"SELECT key, {NOW} * 65536 AS hlc, true AS tomb FROM {CATALOG} c WHERE type = 'hash'")
def _(spark, d):
    held = catalog(spark, d)
    ask = held.where("type = 'hash'").select("key").unionByName(spark.createDataFrame([("nothing",)], "key string"))
    return keyspace.delete(held, ask, F.lit(NOW << 16)).select("key", "hlc", "tomb")


@query("rename_copy", "SELECT CASE WHEN seq % 10 = 0 THEN 'moved:' || seq ELSE key END AS key, value FROM str WHERE key NOT IN (SELECT 'cust:' || (seq + 1) FROM str WHERE seq % 10 = 5) UNION ALL SELECT 'cust:' || (seq + 1), value FROM str WHERE seq % 10 = 5")
def _(spark, d):
    """Keys ending in 0 are renamed, keys ending in 5 are copied over the next."""
    held = ks.customer_strings(spark, d)
    number = F.col("seq")
    moved = keyspace.rename(held.select("key", "value"), held.where(number % 10 == 0).select(F.col("key").alias("src"), F.concat(F.lit("moved:"), number.cast("string")).alias("dst")))
    return keyspace.copy(moved, held.where(number % 10 == 5).select(F.col("key").alias("src"), F.concat(F.lit("cust:"), (number + 1).cast("string")).alias("dst")), replace=True)


X = "(xor(c >> 8, b) & 255)"
Y = f"xor({X}, {X} >> 4)"
CRC = f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, strlen(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)), lambda c, b: xor(xor(xor(c << 8, {Y} << 12), {Y} << 5), {Y}) & 65535)"


@query("keyslot", f"SELECT '{{' || key || '}}:x' AS key, key AS tag, ({CRC} % 16384)::INT AS slot, ({CRC} % 16384 // 4)::INT AS pid FROM str")
def _(spark, d):
    return keyspace.slots(ks.customer_strings(spark, d).select(F.concat(F.lit("{"), F.col("key"), F.lit("}:x")).alias("key")))


@query("randomkey", f"SELECT key FROM str ORDER BY {CRC} % 16384 // 4, key LIMIT 1")
def _(spark, d):
    return keyspace.randomkey(ks.customer_strings(spark, d))


@query("hrw_owners", "WITH p AS (SELECT unnest(range(0, 4096)) AS pid), n AS (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS node), r AS (SELECT pid, node, row_number() OVER (PARTITION BY pid ORDER BY left(md5(node || '|' || pid), 15) DESC, node) - 1 AS place FROM p, n) SELECT pid, node, place FROM r WHERE place < 3")
def _(spark, d):
    return replicas.owners(["a", "b", "c", "d", "e"], spark.range(4096).withColumnRenamed("id", "pid"), 3)


def replica(spark, d, part):
    """A replica that has missed every seventh record, or every eleventh."""
    log = ks.user_hashes_log(spark, d).where(F.col("event_id") % part != 0).withColumn("value", F.col("value").cast("decimal(18,2)").cast("string"))
    return merge.lww(log.select("key", "field", "hlc", "origin", "value"), ["key", "field"])


REPLICAS = "WITH a AS (SELECT key, field, max(hlc) AS hlc, arg_max(origin, hlc) AS origin FROM h WHERE event_id % 7 <> 0 GROUP BY key, field), b AS (SELECT key, field, max(hlc) AS hlc, arg_max(origin, hlc) AS origin FROM h WHERE event_id % 11 <> 0 GROUP BY key, field) "


@query("ae_diff", REPLICAS + "SELECT coalesce(a.key, b.key) AS key, coalesce(a.field, b.field) AS field, CASE WHEN b.key IS NULL OR a.hlc > b.hlc THEN 'push' ELSE 'pull' END AS action FROM a FULL JOIN b ON a.key = b.key AND a.field = b.field WHERE a.hlc IS DISTINCT FROM b.hlc")
def _(spark, d):
    return replicas.diff(replica(spark, d, 7), replica(spark, d, 11), ["key", "field"])


@query(
    "ae_digest",
    "WITH a AS (SELECT key || '/' || field AS key, max(hlc) AS hlc, arg_max(value, hlc)::DECIMAL(18,2)::VARCHAR AS value FROM h GROUP BY h.key, field) "
    "SELECT ('0x' || left(md5(key), 2))::INT AS bucket, count(*) AS n, bit_xor(('0x' || left(md5(key || '|' || hlc || '|' || md5(value)), 15))::BIGINT) AS digest FROM a GROUP BY 1",
)
def _(spark, d):
    log = ks.user_hashes_log(spark, d)
    state = merge.lww(log.select("key", "field", "hlc", "origin", F.col("value").cast("decimal(18,2)").cast("string").alias("value")), ["key", "field"])
    return replicas.digests(state.withColumn("key", F.concat_ws("/", "key", "field")))
