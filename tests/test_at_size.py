"""What shows only on larger tables: plans that Spark changes while it runs, loaded sketches, long queues, deep documents."""

import time
from contextlib import contextmanager

import duckdb
import pytest

from keyloom.operators import budgets
from keyloom.plans import document_queries
from keyloom.plans.queries import oracle_sql, queries
from keyloom.sources import keyspaces
from keyloom.streaming import live


@contextmanager
def conf(spark, **values):
    """Settings while a query runs; ``__`` stands for a dot."""
    before = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_budget_ledgers_stay_whole(spark):
    """A join of the requests with their shares that turns into a broadcast leaves each ledger in one task."""
    asked = [(f"k{i % 5}", f"n{i % 2}", i, 1 + i * 7 % 13) for i in range(4000)]
    requests = spark.createDataFrame(asked, "key string, node string, seq long, amount long")
    held = {(f"k{k}", f"n{n}"): 300 + 900 * n for k in range(5) for n in (0, 1)}
    shares = spark.createDataFrame([(*k, v) for k, v in held.items()], "key string, node string, alloc long")
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="2k", spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = {r.seq: r.granted for r in budgets.reserve(requests, shares).collect()}
    want = {}
    for key, node, seq, amount in asked:
        want[seq] = amount <= held[key, node]
        held[key, node] -= amount if want[seq] else 0
    assert got == want and 0 < sum(want.values()) < 4000


def compare(spark, folder, *names):
    """Queries over tables in ``folder`` against their SQL."""
    con = duckdb.connect()
    for path in folder.iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    for name in names:
        found, relation = queries()[name](spark, str(folder)), con.sql(oracle_sql()[name])
        assert sorted(map(tuple, found.select(*relation.columns).collect()), key=repr) == sorted(relation.fetchall(), key=repr), name


def test_loaded_sketches(spark, tmp_path):
    """Beyond 2.5 elements a register the SQL still counts linearly."""
    duckdb.sql(f"COPY (SELECT i AS event_id, i AS user_id, 'view' AS event_type FROM range(70000) t(i)) TO '{tmp_path}/events.parquet'")
    compare(spark, tmp_path, "pfcount_registers", "pfmerge_count")


def pops(commands, most):
    """BZPOPMIN and BZPOPMAX one command at a time."""
    held, waiting, out = {}, [], []
    for seq, op, member, score in commands:
        if op == "add":
            held[member] = score
        else:
            waiting.append(seq)
        while held and waiting:
            chosen = (max if most else min)(held, key=lambda m: (held[m], m))
            out.append((waiting.pop(0), chosen, held.pop(chosen)))
    return out


@pytest.mark.parametrize("most", [False, True])
def test_long_sorted_queue(spark, tmp_path, most):
    """Members that come again, equal scores and pops that wait; 60,000 members are popped without going through all of them."""
    few = [(i, "pop", None, None) if i % 3 == 2 else (i, "add", f"m{i * 7 % 11}", float(i * 5 % 4)) for i in range(300)]
    rows = [("few", *r) for r in few] + [("many", i, "add", f"m{i:05}", float(i % 9)) for i in range(60_000)] + [("many", 60_000 + i, "pop", None, None) for i in range(60_000)]
    schema = "key string, seq long, op string, member string, score double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    begun = time.monotonic()
    got = live.settled(live.blocking_zpop(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), most), f"{tmp_path}/out").collect()
    assert time.monotonic() - begun < 60
    assert sorted(tuple(r)[1:] for r in got if r.key == "few") == sorted(pops(few, most))
    assert [r.score for r in sorted((r for r in got if r.key == "many"), key=lambda r: r.seq)] == sorted((i % 9 for i in range(60_000)), reverse=most)


def test_lists_in_many_tasks(spark, tmp_path, monkeypatch):
    """No task gets more rows of a long table than the bound, and lists stay whole."""
    monkeypatch.setattr(keyspaces, "TASK_ROWS", 1000)
    for name, last in (("lineitem", "l_linenumber"), ("orders", "o_orderkey")):
        duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{name}.parquet' ORDER BY {last}) TO '{tmp_path}/{name}.parquet'")
    assert keyspaces.order_lists(spark, str(tmp_path)).rdd.getNumPartitions() >= 6
    compare(spark, tmp_path, "linsert", "lpush", "rpushx")


def test_documents_in_many_tasks(spark, tmp_path, monkeypatch):
    """No task gets more documents of a long table than the bound; building them reads their nodes once."""
    monkeypatch.setattr(keyspaces, "TASK_ROWS", 100)
    duckdb.sql(f"COPY (FROM '/root/testdata/sf0.001/orders.parquet') TO '{tmp_path}/orders.parquet'")
    assert document_queries.dealt(spark, str(tmp_path)).rdd.getNumPartitions() >= 15
    built = queries()["json_build"](spark, str(tmp_path))
    assert built._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    compare(spark, tmp_path, "json_build", "json_nodes", "json_get_dynamic", "json_debug_memory")
