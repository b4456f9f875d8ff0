"""Small worked examples of single operators, with nulls, ties and empty inputs."""

import pytest
from pyspark.sql import functions as F

from keyloom.functions.jsonpath import json_get, parse, walk
from keyloom.functions.patterns import glob_match, glob_to_regex
from keyloom.functions.scalars import keyslot, lex_between, render_double, score_between
from keyloom.operators import budgets, hashes, hll, json_docs, keyspace, lists, pubsub, scripts, server, sets, strings, zsets
from keyloom.sources import record_log


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "pattern,yes,no",
    [("h?llo", ["hello", "h\nllo"], ["hllo"]), ("h[ae]llo", ["hallo"], ["hillo"]), ("h[!e]llo", ["hallo"], ["hello"]), ("[a-c]*", ["b1"], ["d"]), ("a\\*", ["a*"], ["ab"]), ("x[", [], ["x[", "x"]), ("a.c", ["a.c"], ["abc"]), ("*", ["", "z"], []), ("[]]", ["]"], ["["])],
)
def test_glob(spark, pattern, yes, no):
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert sorted(r.t for r in df.where(glob_match(F.col("t"), pattern)).collect()) == sorted(yes), glob_to_regex(pattern)


def test_keyslots(spark):
    # CRC-16 of "123456789" is 0x31C3; keys of one tag share a slot.
    df = spark.createDataFrame([("123456789",), ("{123456789}x",), ("",), ("{}123456789",)], "k string")
    got = [r[0] for r in df.select(keyslot(F.col("k"))).collect()]
    assert got[0] == got[1] == 0x31C3 % 16384 and got[2] == 0 and got[3] != got[0]


def test_numbers_and_bounds(spark):
    df = spark.createDataFrame([(3.0,), (2.5,), (float("inf"),), (-0.0,)], "x double")
    assert [r[0] for r in df.select(render_double(F.col("x"))).collect()] == ["3", "2.5", "inf", "0"]
    assert df.where(score_between(F.col("x"), "(2.5", "+inf")).count() == 2
    members = spark.createDataFrame([(m,) for m in "alpha bar cool down elephant foo great hill omega".split()], "m string")
    pick = lambda a, b: [r.m for r in members.where(lex_between(F.col("m"), a, b)).orderBy("m").collect()]
    assert pick("-", "[cool") == ["alpha", "bar", "cool"] and pick("(great", "+") == ["hill", "omega"] and len(pick("[bar", "(foo")) == 4 and pick("+", "-") == []


def test_strings(spark):
    held = spark.createDataFrame([("k1", "v1"), ("n", "10"), ("big", str(2**63 - 1)), ("bad", "x")], "key string, value string")
    patch = spark.createDataFrame([("k1", 2, "3"), ("k1", 1, "2"), ("new", 1, "z")], "key string, seq int, patch string")
    assert sorted(one(strings.append(held, patch))) == [("k1", "v123", 4), ("new", "z", 1)]
    deltas = spark.createDataFrame([("n", 1), ("n", -5), ("big", 1), ("bad", 1), ("fresh", 7)], "key string, delta long")
    assert sorted(one(strings.incrby(held, deltas))) == [("bad", None, True), ("big", None, True), ("fresh", 7, False), ("n", 6, False)]
    v = spark.createDataFrame([("v123",), ("",), (None,), ("é",)], "value string")
    assert [r[0] for r in v.select(strings.getrange(F.col("value"), 1, 2)).collect()][:3] == ["12", "", None]
    assert [bytes(r[0]) for r in v.select(strings.setrange(F.col("value"), 5, "X")).collect()] == [b"v123\0X", b"\0\0\0\0\0X", b"\0\0\0\0\0X", "é".encode() + b"\0\0\0X"]
    writes = spark.createDataFrame([("k1", "a", 1), ("z", "b", 1), ("z", "c", 2)], "key string, value string, seq int")
    assert ("z", "b") in one(strings.set_values(held, writes, "NX")) and ("k1", "v1") in one(strings.set_values(held, writes, "NX"))
    assert ("k1", "a") in one(strings.set_values(held, writes, "XX")) and "z" not in [k for k, _ in one(strings.set_values(held, writes, "XX"))]
    assert strings.mget(held.limit(0), writes.select("seq", "key")).where("value IS NULL").count() == 3


def test_hash_deadlines(spark):
    held = spark.createDataFrame([("h", "a", "1", 0), ("h", "b", "2", 5000)], "key string, field string, value string, ttl_ms long")
    ask = lambda f, t: spark.createDataFrame([("h", f, t)], "key string, field string, deadline long")
    reply = lambda f, t, c: hashes.hexpire(held, ask(f, t), 1000, c).collect()[0].reply
    assert [reply("a", 9000, "GT"), reply("a", 9000, "LT"), reply("b", 9000, "GT"), reply("b", 900, None), reply("x", 1, None), reply("b", 9000, "NX")] == [0, 1, 1, 2, -2, 0]
    after = hashes.restamp(held, hashes.hexpire(held, ask("b", 900), 1000))
    assert one(after) == [("h", "a", "1", 0)]


def test_sets_and_zsets(spark):
    s = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "z")], "key string, member string")
    assert one(sets.sinter(s, "a", "b")) == [("y",)] and one(sets.sdiff(s, "a", "b")) == [("x",)] and sets.sunion(s, "a", "b").count() == 3
    assert one(sets.sinter(s, "a", "none")) == [] and sorted(one(sets.srandmember(s.where("key = 'a'"), -5)))[-1] == ("a", 5, "x")
    z = spark.createDataFrame([("za", "a", 1.0), ("za", "b", 2.0), ("za", "c", 3.0), ("zb", "b", 1.0), ("zb", "c", 2.0), ("zb", "d", 3.0)], "key string, member string, score double")
    assert sorted(one(zsets.zunion(z, ["za", "zb"], [2, 3]))) == [("a", 2.0), ("b", 7.0), ("c", 12.0), ("d", 9.0)]
    assert one(zsets.zintercard(z, ["za", "zb"], 1)) == [(1,)] and one(zsets.zdiff(z, "za", "zb")) == [("a", 1.0)]
    assert [r.member for r in zsets.zmpop(z, ["no", "za"], 2).orderBy("rank").collect()] == ["a", "b"]
    ties = spark.createDataFrame([("t", m, 0.0) for m in "cab"], "key string, member string, score double")
    assert [r.member for r in zsets.zrange(ties, 0, -1).orderBy("rank").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        zsets.zadd(z, z.withColumn("seq", F.lit(1)), "NX", "GT")


def test_lists(spark):
    held = spark.createDataFrame([("l", i, v) for i, v in enumerate("abcab")] + [("m", 0, None)], "key string, pos long, value string")
    text = lambda df, by="pos": "".join(r.value or "-" for r in df.where("key = 'l'").orderBy(by).collect())
    assert text(lists.lrem(held, 1, F.lit("a"))) == "bcab" and text(lists.lrem(held, -1, F.lit("b"))) == "abca" and text(lists.lrem(held, 0, F.lit("a"))) == "bcb"
    assert text(lists.linsert(held, F.lit("b"), F.lit("X"), before=False), "index") == "abXcab" and text(lists.linsert(held, F.lit("q"), F.lit("X")), "index") == "abcab"
    assert [r["index"] for r in lists.lpos(held, F.lit("b"), rank=-1, count=0).orderBy("nth").collect()] == [4, 1]
    assert text(lists.ltrim(held, -2, -1)) == "ab" and one(lists.lindex(held.where("key = 'm'"), 3)) == [("m", None)]
    writes = spark.createDataFrame([("l", 1, "y"), ("l", 2, "z"), ("new", 1, "n")], "key string, seq int, value string")
    assert text(lists.push(held, writes, left=True)) == "zyabcab" and lists.push(held, writes, only_existing=True).where("key = 'new'").count() == 0
    after, moved = lists.lmove(held, spark.createDataFrame([("l", "k2")], "src string, dst string"), True, False)
    assert text(after) == "bcab" and one(moved) == [("l", "k2", "a")]


def test_hll(spark):
    rows = spark.createDataFrame([("k", f"e{i}") for i in range(1, 501)], "key string, element string")
    for native in (True, False):
        assert 485 <= hll.pfcount(hll.pfadd(rows, native)).collect()[0].estimate <= 515
    assert hll.pfcount(hll.pfadd(rows.limit(0))).count() == 0


def test_json(spark):
    docs = spark.createDataFrame([("d", '{"a":{"b":2},"b":3}'), ("n", None)], "key string, doc string")
    get = lambda p: docs.where("key = 'd'").select(json_get(F.col("doc"), p)).collect()[0][0]
    assert get("$..b") in ("[3,2]", "[2,3]") and get("$.zz") == "[]" and get(".zz") is None and get("a.b") == "2" and get("$['a','b']") == '[{"b":2},3]'
    assert docs.where("key = 'n'").select(json_get(F.col("doc"), "$..b")).collect()[0][0] is None
    assert [v for _, v in walk([{"p": 1}, {"p": 3, "q": "x"}], parse("$[?(@.p>2 && @.q=='x')].p"))] == [3]
    run = json_docs.apply_edits
    assert run('{"a":[1,2,3]}', "$.a", json_docs.arrappend(4, 5)) == ('{"a":[1,2,3,4,5]}', "[5]")
    assert run('{"a":[1,2,3]}', "$.a", json_docs.arrinsert(1, "x"))[0] == '{"a":[1,"x",2,3]}'
    assert run('{"a":1}', "$.b.c", json_docs.set_to(1), create=True) == ('{"a":1}', "[]")
    assert run('{"a":[1,2,1]}', "$.a[*]", json_docs.delete())[0] == '{"a":[]}'
    assert json_docs.merge_patch({"a": "b", "c": {"d": 1, "e": 2}}, {"a": None, "c": {"d": None}}) == {"c": {"e": 2}}
    assert json_docs.resp({"a": [1, True, 1.5]}) == ["{", "a", ["[", 1, "true", "1.5"]]


def test_json_answers_are_json(spark):
    """Every path's answer is a JSON text: strings quoted, null as null, whole floats without a fraction."""
    import json

    text = '{"a":1,"b":[true,null,"s"],"q":"x\\"y","f":1.0,"h":1.5,"n":null,"o":{"z":1,"c":"\\u00e9"}}'
    docs = spark.createDataFrame([("d", text), ("bad", "{oops"), ("none", None)], "key string, doc string")
    get = lambda p, *form: docs.where("key = 'd'").select(json_get(F.col("doc"), p, *form)).collect()[0][0]
    whole = json.loads(text)
    assert json.loads(get(".")) == whole and json.loads(get("$")) == [whole] and get("q") == '"x\\"y"' and get("$.q") == '["x\\"y"]'
    assert get("n") == "null" and get("$.n") == "[null]" and get("f") == "1" and get("$.f") == "[1]" == get("$..f") and get("h") == "1.5"
    assert get("b[2]") == '"s"' and get("$.b[9]") == "[]" and get("b[9]") is None and get("o") == '{"c":"é","z":1}'
    assert get("o", "\t", "\n", " ") == '{\n\t"c": "é",\n\t"z": 1\n}' and get("$.zz", " ", "\n") == "[]"
    for path in ("a", "$.a", "$..a"):
        assert [r[0] for r in docs.where("key <> 'd'").select(json_get(F.col("doc"), path)).collect()] == [None, None]
    found = {r.key: r.value for r in json_docs.get_many(docs, ["q", "$.a", "zz", "n"]).collect()}
    assert found == {"d": '{"$.a":[1],"n":null,"q":"x\\"y","zz":null}', "bad": None, "none": None}


def test_json_numbers(spark):
    docs = spark.createDataFrame([('{"s":"5","i":1,"f":1.5,"b":9223372036854775807,"e":1e21,"d":0.1,"m":12345678.25,"a":[1]}',)], "doc string")
    step = lambda p, by, times=False: docs.select(json_docs.numincrby(F.col("doc"), p, by, times)).collect()[0][0]
    assert step("s", 1) is None and step("$.s", 1) == "[null]" and step("$.zz", 1) == "[]" and step("a", 1) is None
    assert step("i", 2) == "3" and step("$.i", -4) == "[-3]" and step("f", 0.5) == "2" and step("f", 2, True) == "3" and step("f", 0.25) == "1.75"
    assert float(step("b", 1)) == 2.0**63 and step("e", 1) == "1e21" and step("d", 0.2) == "0.30000000000000004" and step("m", 0.5) == "12345678.75"


def test_json_build(spark):
    texts = ['{"a":{"b":[1,[],{"c":"x\\"y"}],"d":null},"e":{},"f":[true]}', "3", "[]", "{}", "null", '["z",{"k":[[2]]}]']
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, doc string")
    rows = docs.select("key", F.inline(json_docs.decompose("doc")))
    assert {r.key: r.doc for r in json_docs.build(rows.repartition(5)).collect()} == {str(i): t for i, t in enumerate(texts)}
    assert json_docs.build(rows.limit(0)).count() == 0


def test_transactions(spark):
    from keyloom.operators import transactions

    log = [(1, "SET"), (2, "MULTI"), (3, "GET"), (4, "MULTI"), (5, "SET"), (6, "EXEC"), (7, "GET"), (8, "MULTI"), (9, "SET"), (10, "DISCARD"), (11, "EXEC"), (12, "SET"), (13, "MULTI"), (14, "GET")]
    rows = spark.createDataFrame([("s", n, c, "k", []) for n, c in log], "session string, seq long, cmd string, key string, args array<string>")
    assert sorted((r.at, r.seq) for r in transactions.executed(rows.repartition(3)).collect()) == [(1, 1), (6, 3), (6, 5), (7, 7), (12, 12)]


def test_clock(spark):
    from keyloom.operators import replicas

    steps = [("n", 1, 100, None), ("n", 2, 100, None), ("n", 3, 100, (103 << 16) + 7), ("n", 4, 101, None), ("n", 5, 101, 1 << 60), ("n", 6, 90, None), ("m", 1, 5, 9)]
    got = [r.hlc for r in replicas.clock(spark.createDataFrame(steps, "node string, seq long, wall_ms long, remote long")).orderBy("node", "seq").collect()]
    last, want = {}, []
    for node, _, wall, remote in sorted(steps[:6]) :
        prev = last.get(node, 0)
        last[node] = max(prev + 1, wall << 16) if remote is None else max(prev, min(remote, (wall + replicas.DRIFT_MS) << 16)) + 1
        want.append(last[node])
    assert got[1:] == want and got[0] == 10


def test_proto_collections(spark):
    from google.protobuf import descriptor_pb2

    from keyloom.operators import proto

    kinds = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")
    message = file.message_type.add(name="M")
    for number, (name, kind, label) in enumerate((("id", kinds.TYPE_STRING, kinds.LABEL_OPTIONAL), ("tags", kinds.TYPE_STRING, kinds.LABEL_REPEATED), ("big_one", kinds.TYPE_INT64, kinds.LABEL_OPTIONAL)), 1):
        message.field.add(name=name, number=number, type=kind, label=label)
    held = descriptor_pb2.FileDescriptorSet(file=[file]).SerializeToString()
    rows = spark.createDataFrame([("a", '{"id":"x","tags":["p","q"],"bigOne":"9"}'), ("b", "{}")], "key string, j string").select("key", proto.set_json(F.col("j"), held, "t.M").alias("value"))
    fields = rows.select("key", F.inline(proto.decompose(F.col("value"), held, "t.M")))
    assert {r.key: bytes(r.value) for r in proto.recompose(fields, held, "t.M").collect()} == {r.key: bytes(r.value) for r in rows.where("key = 'a'").collect()}
    writes = rows.select("key", F.lit("f").alias("field"), "value", F.lit(1).alias("seq")).unionByName(spark.createDataFrame([("a", "g", bytearray(b"\xff\xff"), 2)], "key string, field string, value binary, seq int"))
    after, refused = proto.hset(writes.limit(0), writes, held, "t.M")
    assert sorted((r.key, r.field) for r in after.collect()) == [("a", "f"), ("b", "f")] and [(r.key, r.field) for r in refused.collect()] == [("a", "g")]
    members, refused = proto.sadd(rows.limit(0).withColumnRenamed("value", "member"), writes.select("key", F.col("value").alias("member")), held, "t.M")
    assert members.count() == 2 and refused.count() == 1 and proto.get(rows).columns == ["key", "value"]


def test_budgets(spark):
    shares = spark.createDataFrame([("b", "n0", 50)], "key string, node string, alloc long")
    asks = spark.createDataFrame([("b", "n0", i, 10) for i in range(10)], "key string, node string, seq long, amount long")
    assert budgets.reserve(asks, shares).where("granted").agg(F.sum("amount")).first()[0] == 50
    asks = spark.createDataFrame([("b", "n0", 1, 40), ("b", "n0", 2, 20), ("b", "n0", 3, 10)], "key string, node string, seq long, amount long")
    assert [r.granted for r in budgets.reserve(asks, shares).orderBy("seq").collect()] == [True, False, True]
    split = budgets.create(spark.createDataFrame([("b", 10, ["z", "a", "m", "a"])], "key string, capacity long, nodes array<string>"))
    assert one(split.orderBy("node")) == [("b", "a", 4), ("b", "m", 3), ("b", "z", 3)]


def test_keyspace_bindings_scripts_server(spark):
    held = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    pairs = spark.createDataFrame([("a", "b"), ("none", "c")], "src string, dst string")
    assert one(keyspace.rename(held, pairs)) == [("b", "1")] and sorted(one(keyspace.rename(held, pairs, only_new=True))) == [("a", "1"), ("b", "2")]
    assert sorted(one(keyspace.copy(held, pairs, replace=True))) == [("a", "1"), ("b", "1")]
    bound = spark.createDataFrame([("a", "T")], "prefix string, type string")
    assert sorted(one(pubsub.bind_longest_prefix(held, bound))) == [("a", "a", "T"), ("b", None, None)]
    assert pubsub.bind_longest_prefix(held, bound.limit(0)).where("type IS NULL").count() == 2

    def total(group):
        import pandas as pd

        return pd.DataFrame({"tag": [group["tag"].iloc[0]], "n": [int(group["v"].sum())]})

    registry = scripts.ScriptRegistry()
    name = registry.load(total, "tag string, n long")
    rows = spark.createDataFrame([("{t}1", 1), ("{t}2", 2), ("u", 5)], "key string, v long")
    assert sorted(one(registry.evalsha(rows, name))) == [("t", 3), ("u", 5)] and registry.exists(name, "x") == [True, False]
    registry.flush()
    with pytest.raises(KeyError):
        registry.evalsha(rows, name)
    assert server.command(spark).count() > 150 and one(server.ping(spark)) == [("PONG",)]
    with pytest.raises(KeyError):
        server.Settings().set("unknown", 1)


def test_every_command_has_an_answer():
    pytest.importorskip("google.protobuf")
    names = [name for listed in (*server.OWN.values(), *server.OTHER.values()) for name in listed]
    assert len(names) == len(set(names)) > 200 and all(callable(server.answered_by(n)) for n in names)
    with pytest.raises(KeyError):
        server.answered_by("AUTH")


def test_plans(spark, data):
    """Ranges from a key's front are cut before the shuffle; prefix globs reach the scan; no query pairs all rows."""
    from keyloom.plans.queries import queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("zrange_index", "zrange_rev", "zpopmin", "zrandmember", "zrangebyscore", "spop_topn", "lrange", "rpop", "xrevrange_count", "xread_after", "xtrim_maxlen", "hrandfield"):
        assert "WindowGroupLimit" in plan(queries()[name](spark, data)), name
    scanned = spark.read.parquet(f"{data}/customer.parquet").where(glob_match(F.col("c_name"), "Customer#00*")).select("c_acctbal")
    assert "StringStartsWith(c_name,Customer#00)" in plan(scanned) and "c_nationkey" not in plan(scanned)
    for name, query in queries().items():
        text = plan(query(spark, data))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_proto(spark):
    pytest.importorskip("google.protobuf")
    from google.protobuf import descriptor_pb2

    from keyloom.operators import proto

    kinds = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(name="o.proto", package="p", syntax="proto3")
    m = file.message_type.add(name="Order")
    for i, (n, k, label) in enumerate((("id", kinds.TYPE_STRING, 1), ("total", kinds.TYPE_UINT64, 1), ("tags", kinds.TYPE_STRING, 3), ("paid", kinds.TYPE_BOOL, 1)), 1):
        m.field.add(name=n, number=i, type=k, label=label)
    registry = proto.Registry()
    assert registry.set_schema("s", descriptor_pb2.FileDescriptorSet(file=[file]).SerializeToString()) == 1
    registry.bind("o:", "p.Order")
    name, held = registry.bound("o:1")
    rows = spark.createDataFrame([('{"id":"o-1","total":"18446744073709551615","tags":["a","b"],"paid":true}',), ("{bad",), (None,)], "j string")
    rows = rows.select(proto.set_json(F.col("j"), held, name).alias("v"))
    get = lambda path: [r[0] for r in rows.select(proto.get_field(F.col("v"), held, name, path)).collect()]
    assert get("total") == ["18446744073709551615", None, None] and get("tags.1")[0] == "b" and get("3.9")[0] is None and get("paid")[0] == "true"
    changed = rows.select(proto.get_json(proto.clear_fields(proto.set_fields(F.col("v"), held, name, {"id": "z"}), held, name, ["tags", "paid"]), held, name)).collect()[0][0]
    assert changed == '{"id":"z","total":"18446744073709551615"}'
    assert registry.table(spark).count() == 1 and registry.unbind("o:") and registry.delete_schema("s") and registry.get_schema("s", 1)


def test_record_log(spark, tmp_path):
    commands = tmp_path / "log.json"
    commands.write_text('{"seq":1,"cmd":"HSET","key":"h","args":["a","1","b","2"]}\n{"seq":2,"cmd":"HDEL","key":"h","args":["a"]}\n{"seq":3,"cmd":"SET","key":"s","args":["v"]}\n')
    records = record_log.commands_to_records(record_log.read_commands(spark, str(commands)), now_ms=1000, origin=1)
    rows = records.withColumn("observed", F.array().cast("array<struct<hlc:long,origin:int>>"))
    record_log.append(rows.select("key", "kind", "elem", "value", "hlc", "origin", "ttl_ms", "tomb", "observed"), str(tmp_path / "log"))
    from keyloom.operators import merge, snapshot

    state = snapshot.visible(merge.lww(record_log.read(spark, str(tmp_path / "log")), ["key", "kind", "elem"]), 2000)
    assert sorted(one(state.select("key", "elem", "value"))) == [("h", "b", "2"), ("s", "", "v")]
    keys = [r.key for r in records.select("key").distinct().collect()]
    found = spark.createDataFrame([(k, record_log.bucket_of_key(k)) for k in [*keys, "{t}a", "{}b", "é"]], "key string, bucket int")
    from keyloom.functions.scalars import partition_id

    assert found.where(partition_id(F.col("key")) % 64 != F.col("bucket")).count() == 0
    some = record_log.read_keys(spark, str(tmp_path / "log"), "s")
    assert one(some.select("key", "value")) == [("s", "v")] and "PartitionFilters: [bucket" in some._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket", "bucket")
    record_log.compact(spark, str(tmp_path / "log"), str(tmp_path / "compact"))
    assert record_log.read(spark, str(tmp_path / "compact")).count() == 3
