"""Batches that count once, sinks that break off, and files that stay closed."""

import pandas as pd
import pytest
from millrace.operators import commits
from millrace.streaming import streams as M
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("day", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("value", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, path, ledger=True, **more):
    return sorted(map(tuple, commits.read(spark, path, SCHEMA, ledger, **more).collect()), key=str)


def broken(monkeypatch):
    """Writes stop after the files and ahead of the mark that they are complete."""

    def put(df, folder, keys, buckets):
        real(df, folder, keys, buckets)
        for mark in commits.found(df.sparkSession, f"{folder}/_SUCCESS"):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(mark)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, False)
        raise RuntimeError("killed")

    real = commits.put
    monkeypatch.setattr(commits, "put", put)


def test_append_counts_a_batch_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    commits.write(frame(spark, [(1, "a", 1)]), path, 0, ["day"])
    with monkeypatch.context() as m:
        broken(m)
        with pytest.raises(RuntimeError):
            commits.write(frame(spark, [(2, "b", 2), (3, "c", 3)]), path, 1, ["day"])
    assert held(spark, path) == [(1, "a", 1)] and commits.next_batch(spark, path) == 1
    for _ in range(2):
        commits.write(frame(spark, [(2, "b", 2), (3, "c", 3)]), path, 1, ["day"])
    assert held(spark, path) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    commits.compact(spark, path, SCHEMA, ["day"], ledger=True)
    assert held(spark, path) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)] and len(commits.folders(spark, path)) == 1
    commits.write(frame(spark, [(9, "late", 9)]), path, 1, ["day"])  # a number that the compaction stands for
    assert len(held(spark, path)) == 3


def test_ledger_opens_only_what_may_hold_its_keys(spark, tmp_path):
    path, keys = str(tmp_path / "ledger"), ["day", "code"]
    for n in range(4):  # a hundred days a batch
        opened = commits.add(frame(spark, [(100 * n + d, c, n) for d in range(100) for c in ("x", None)]), path, n, keys, ["value"])
        assert opened == []  # later days are in no earlier file's range
    files = len(commits.groups(spark, path))
    opened = commits.add(frame(spark, [(250, "x", 7), (250, "new", 8), (250, "new", 9)]), path, 4, keys, ["value"])
    assert 0 < len(opened) <= 2 and files >= 100
    assert [r for r in held(spark, path) if r[0] == 250] == [(250, "new", 8), (250, "x", 2), (250, None, 2)]
    before = held(spark, path)
    commits.add(frame(spark, [(d, "x", 99) for d in range(400)]), path, 5, keys, ["value"])
    assert held(spark, path) == before
    commits.compact(spark, path, SCHEMA, keys, ledger=True)
    commits.add(frame(spark, [(d, None, 99) for d in range(401)]), path, 6, keys, ["value"])
    assert held(spark, path) == sorted([*before, (400, None, 99)], key=str)


def test_null_keys_are_keys(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for n in range(2):
        commits.add(frame(spark, [(None, "a", n), (1, "a", n)]), path, n, ["day", "code"], ["value"])
    assert held(spark, path) == sorted([(1, "a", 0), (None, "a", 0)], key=str)


def test_ledger_that_broke_off(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    sink = M.ledger_sink(path, ["day", "code"], ["value"])
    sink(frame(spark, [(1, "a", 1)]), 0)
    with monkeypatch.context() as m:
        broken(m)
        with pytest.raises(RuntimeError):
            sink(frame(spark, [(1, "a", 5), (2, "a", 5)]), 1)
    assert held(spark, path) == [(1, "a", 1)]
    for _ in range(2):
        sink(frame(spark, [(1, "a", 6), (2, "a", 6)]), 1)
    assert held(spark, path) == [(1, "a", 1), (2, "a", 6)]


def test_upserts_open_their_buckets_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "now")
    commits.write(frame(spark, [(d, "old", 0) for d in range(200)]), path, 0, ["day"])
    sink = M.upsert_sink(path, SCHEMA, ["day"], ["code"], [F.col("value").desc()], {"value": 1})
    with monkeypatch.context() as m:
        broken(m)
        with pytest.raises(RuntimeError):
            sink(frame(spark, [(5, "lost", 1)]), 0)
    assert all(r[1] == "old" for r in held(spark, path, ledger=False))
    for _ in range(2):
        sink(frame(spark, [(5, "no", 1), (5, "new", 2), (900, "more", 1)]), 0)
    now = held(spark, path, ledger=False)
    assert len(now) == 201 and {r[:2] for r in now if r[1] != "old"} == {(5, "new"), (900, "more")} and (5, "new", 1) in now
    assert len([g for g in commits.groups(spark, path) if g[0] == 1]) <= 2
    commits.compact(spark, path, SCHEMA, ["day"])
    assert held(spark, path, ledger=False) == now


def test_upkeep_that_broke_off(spark, tmp_path, monkeypatch):
    """A replayed or half-done batch changes nothing: each child change counts once."""
    path = str(tmp_path / "parents")
    commits.write(frame(spark, [(d, "open", 0) for d in range(50)]), path, 0, ["day"])

    def apply(rows, changed):
        return rows.join(changed.withColumn("hit", F.lit(1)), "day", "left").select("day", "code", (F.col("value") + F.coalesce("hit", F.lit(0))).alias("value"))

    sink = M.upkeep_sink(path, SCHEMA, "day", "parent", apply)
    batch = spark.createDataFrame([(3,), (3,), (4,), (None,)], "parent int")
    with monkeypatch.context() as m:
        broken(m)
        with pytest.raises(RuntimeError):
            sink(batch, 0)
    for _ in range(2):
        sink(batch, 0)
    assert [r for r in held(spark, path, ledger=False) if r[2]] == [(3, "open", 1), (4, "open", 1)]


def hour(h):
    return (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()


def test_exact_users_of_a_stream(spark, tmp_path):
    """Days come out once the watermark has passed them, with the users that a batch counts."""
    schema = "ts timestamp, user_id long, status int, duration_ms long"
    frames = [[(hour(1), 1, 200, 10), (hour(2), 1, 500, 21), (hour(3), None, 200, None)], [(hour(4), 2, 200, 30), (hour(26), 2, 404, 40)], [(hour(200), 9, 200, 1)]]
    for k, f in enumerate(frames):
        spark.createDataFrame(f, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "f=*"))
    q = M.daily_stats_exact(stream).writeStream.outputMode("append").format("memory").queryName("exact").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = M.daily_stats_exact(spark.createDataFrame([r for f in frames for r in f], schema)).orderBy("day").collect()
    assert [tuple(r)[1:] for r in batch] == [(4, 2, 1, 20), (1, 1, 1, 40), (1, 1, 0, 1)]
    assert [tuple(r) for r in spark.table("exact").orderBy("day").collect()] == [tuple(r) for r in batch][:2]


def test_messages_end(spark, tmp_path):
    schema = "key string, seq int, tok string, ts timestamp"
    for k, f in enumerate([[("m", 2, "lo", hour(0)), ("m", 1, "hel", hour(0))], [("n", 1, "later", hour(5))], [("z", 1, "end", hour(50))]]):
        spark.createDataFrame(f, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "f=*"))
    q = M.assemble_text(stream, "key", "seq", "tok", ts="ts").writeStream.outputMode("append").format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("ended").collect())) == [("m", "hello", 2), ("n", "later", 1)]


def test_tasks_are_counted_by_rows(spark, tmp_path, monkeypatch):
    """Keys that compress to next to nothing are still sorted by several tasks, and a large bucket is written as several files."""
    monkeypatch.setattr(commits, "TASK_ROWS", 8)
    rows = spark.range(400).select(F.col("id").alias("key"), F.lit("x").alias("name"))
    commits.write(rows, str(tmp_path / "t"), 0, ["key"], buckets=2)
    files = list((tmp_path / "t" / "batch=0" / "bucket=0").glob("*.parquet"))
    assert len(files) > 3 and sorted(r.key for r in commits.read(spark, str(tmp_path / "t"), rows.schema).collect()) == list(range(400))
    met = commits.dealt_by_rows(rows, ["key"], 400)
    assert met.rdd.getNumPartitions() == 51
    assert rows.join(met, "key", "left_semi").rdd.getNumPartitions() == 51
