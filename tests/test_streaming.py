"""Live forms give what the batch forms give, in any number of micro-batches."""

from pyspark.sql import functions as F

from keyloom.operators.merge import lww
from keyloom.streaming import live


def run(query_of, name, spark, tmp_path, frames, mode="append"):
    folder = tmp_path / "in"
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = query_of(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


RECORD = "key string, elem string, value string, hlc long, origin int"


def test_merge_stream(spark, tmp_path):
    rows = [("k", "e", f"v{h}", h, 0) for h in (5, 9, 2)] + [("k", "f", "x", 1, 0)]
    frames = [spark.createDataFrame([r], RECORD) for r in rows]
    out = run(live.merge_stream, "merged", spark, tmp_path, frames, "update")
    assert sorted(map(tuple, lww(out, ["key", "elem"]).collect())) == sorted(map(tuple, lww(spark.createDataFrame(rows, RECORD), ["key", "elem"]).collect()))


def test_merge_into_table(spark, tmp_path):
    for h in (3, 7, 5):
        spark.createDataFrame([("k", "e", f"v{h}", h, 0)], RECORD).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.merge_into_table(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.value for r in live.read_merged(spark, str(tmp_path / "log")).collect()] == ["v7"]


def test_blocking_pop(spark, tmp_path):
    schema = "key string, seq long, op string, value string"
    frames = [spark.createDataFrame([r], schema) for r in (("l", 1, "pop", None), ("l", 2, "push", "a"), ("l", 3, "push", "b"), ("l", 4, "pop", None))]
    assert sorted(map(tuple, run(live.blocking_pop, "popped", spark, tmp_path, frames).collect())) == [("l", 1, "a"), ("l", 4, "b")]


def test_blocking_move(spark, tmp_path):
    schema = "key string, seq long, op string, value string, dst string"
    frames = [spark.createDataFrame([r], schema) for r in (("l", 1, "move", None, "d1"), ("l", 2, "push", "a", None), ("l", 3, "push", "b", None), ("l", 4, "move", None, "d2"))]
    assert sorted(map(tuple, run(live.blocking_move, "moved", spark, tmp_path, frames).collect())) == [("d1", 1, "a"), ("d2", 4, "b")]


def test_expire_stream(spark, tmp_path):
    rows = [spark.sql(f"SELECT timestamp_millis({t}) AS ts, 'k' AS key, '{e}' AS elem, {t + d} AS ttl_ms") for t, e, d in ((1000, "a", 500), (5000, "b", 99_000), (9000, "c", 99_000))]
    out = run(live.expire_stream, "due", spark, tmp_path, rows)
    assert [tuple(r) for r in out.collect()] == [("k", "a", 1500 << 16)]


def test_blocking_zpop(spark, tmp_path):
    schema = "key string, seq long, op string, member string, score double"
    frames = [spark.createDataFrame([("z", 1, "add", "m", 2.0), ("z", 2, "add", "n", 1.0), ("z", 3, "pop", None, None)], schema)]
    assert list(map(tuple, run(live.blocking_zpop, "zpopped", spark, tmp_path, frames).collect())) == [("z", 3, "n", 1.0)]


def test_subscriptions_and_windows(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_millis(id * 600000) AS ts, 'b' AS key, id AS amount, concat('c', id % 3) AS channel FROM range(60)")
    out = run(lambda s: live.psubscribe(s, "c[01]"), "heard", spark, tmp_path, [rows])
    assert out.count() == 40 and live.subscribe(rows, "c2").count() == 20
    win = run(lambda s: live.budget_windows(s.select("ts", "key", "amount")), "wins", spark, tmp_path / "w", [rows, rows.where("id = 59") if "id" in rows.columns else rows.where(F.col("amount") == 59)])
    assert win.where("asked = 15").count() == 1
