"""Late pages, a crawl's visited pages, and a log that is followed: what is opened, and what comes of restarts."""

import random

import pytest
from millrace.operators import pages as L
from millrace.operators import paging
from millrace.streaming.tail_source import Files, TailReader, tail_stream
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("__range", T.StringType())])


def test_a_late_page_opens_the_ranges_that_hold_it(spark, tmp_path):
    path, random_ = str(tmp_path / "pages"), random.Random(1)
    df = spark.range(2000).select("id", F.timestamp_seconds(F.col("id") % 7).alias("at"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("name"))
    keys = [F.col("name").desc_nulls_first(), F.col("id")]
    paging.build_pages(df, keys, path, range_rows=100)
    want = [tuple(r) for r in df.orderBy(*keys).collect()]
    assert paging.page_count(spark, path, 30) == 67
    for number in [1, 2, 66, 67, *random_.sample(range(3, 66), 3)]:
        got = paging.seek_page(spark, path, df.schema, number, 30)
        assert [tuple(r) for r in got.collect()] == want[30 * (number - 1) : 30 * number]
        assert len(paging.holding(spark, path, number, 30)) <= 2 and len(got.inputFiles()) <= 2
    assert paging.seek_page(spark, path, df.schema, 68, 30).count() == 0
    assert [tuple(r) for r in paging.seek_page(spark, path, df.schema, 0, 30).collect()] == want[:30]
    plan = paging.seek_page(spark, path, df.schema, 40, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the page's own rows, by their place


def test_pages_of_an_empty_table_and_of_repeated_rows(spark, tmp_path):
    none = spark.createDataFrame([], "id long, name string")
    paging.build_pages(none, ["id"], str(tmp_path / "none"))
    assert paging.page_count(spark, str(tmp_path / "none")) == 0 and paging.seek_page(spark, str(tmp_path / "none"), none.schema, 1).collect() == []
    same = spark.createDataFrame([(None, "x")] * 5 + [(1, "y")], "id long, name string")
    paging.build_pages(same, ["id"], str(tmp_path / "same"), range_rows=2)
    assert [[tuple(r) for r in paging.seek_page(spark, str(tmp_path / "same"), same.schema, n, 4).collect()] for n in (1, 2)] == [[(None, "x")] * 4, [(None, "x"), (1, "y")]]


def reached(links, seeds, depth):
    out = {(s, s): 0 for s in seeds}
    now = list(out)
    for d in range(1, depth + 1):
        now = sorted({(s, b) for s, u in now for a, b in links if a == u and b is not None and s is not None and b.startswith(s)} - set(out))
        out |= {x: d for x in now}
    return out


def test_crawl_equals_plain_search(spark):
    random_ = random.Random(2)
    urls = [f"h{i % 3}/{i}" for i in range(60)]
    links = [(random_.choice(urls), random_.choice(urls)) for _ in range(150)] + [("h0/0", u) for u in urls] + [(None, "h0/1"), ("h0/1", None)] * 2
    links = [(s, u) for s, u in links if s != "h0/0" or u != "h1/1"] + [("h0/", "h0/0"), ("h1/", "h1/1"), ("h2/", "h2/2"), ("h2/", "h2/2")]
    seeds = ["h0/", "h1/", "h1/", "h", "gone"]
    for depth in (0, 1, 3, 50):
        got = L.reachable(spark.createDataFrame(links, "src string, dst string").withColumn("bucket", F.lit(1)), spark.createDataFrame([(s,) for s in seeds], "seed string"), depth, buckets=8)
        rows = [tuple(r) for r in got.collect()]
        assert sorted(((s, u), d) for s, u, d in rows) == sorted(reached(links, seeds, depth).items())
    assert L.reachable(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([], "seed string"), 3).count() == 0
    assert L.reachable(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([("a",)], "seed string"), 3).count() == 1


def test_crawl_levels_keep_their_plan_and_open_their_buckets(spark, monkeypatch):
    opened, plans = [], []
    real = L.commits.read_folders

    def read(spark_, where, schema):
        if "depth" in schema.names and any("/visited/" in x for x in where):
            opened.append(len(where))
        got = real(spark_, where, schema)
        plans.append(len(got._jdf.queryExecution().analyzed().toString().splitlines()))
        return got

    monkeypatch.setattr(L.commits, "read_folders", read)
    n = 12
    chain = spark.createDataFrame([("u", "u0")] + [(f"u{i}", f"u{i + 1}") for i in range(n)], "src string, dst string")
    got = L.reachable(chain, spark.createDataFrame([("u",)], "seed string"), n)
    assert sorted(r.depth for r in got.collect()) == list(range(n + 1))
    assert max(plans) == 1 and max(opened[:-1]) <= n // 2  # a level reads the frontier's folder and those of one bucket


def write(spark, folder, ids, **columns):
    spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.timestamp_seconds("id").alias("at"), *[F.lit(v).alias(k) for k, v in columns.items()]).coalesce(1).write.mode("append").parquet(folder)


def follow(spark, folder, checkpoint, out, after=None):
    """What a run of the stream adds to ``out``."""

    def sink(batch, n):
        out.extend(map(tuple, batch.select("id", F.unix_seconds("at"), "__range").collect()))

    job = tail_stream(spark, folder, SCHEMA, "id", after).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert not job.isActive and job.exception() is None


def test_a_followed_log_loses_and_repeats_nothing(spark, tmp_path):
    log, checkpoint, out = str(tmp_path / "log"), str(tmp_path / "cp"), []
    follow(spark, log, checkpoint, out, 2)  # no folder yet
    assert out == []
    write(spark, log, [1, 2, 3, 4], __range="a")
    write(spark, log, [None, 5, 6])
    follow(spark, log, checkpoint, out, 2)
    assert sorted(out) == [(3, 3, "a"), (4, 4, "a"), (5, 5, None), (6, 6, None)]
    follow(spark, log, checkpoint, out, 2)
    assert len(out) == 4
    write(spark, log, [6, 7, 8, 8])
    write(spark, log, [None])
    follow(spark, log, checkpoint, out, 2)  # from the checkpoint's last key
    assert sorted(x[0] for x in out) == [3, 4, 5, 6, 7, 8, 8]


def test_a_batch_that_breaks_off_comes_again(spark, tmp_path):
    log, checkpoint, out = str(tmp_path / "log"), str(tmp_path / "cp"), []
    write(spark, log, range(10))

    def broken(batch, n):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        tail_stream(spark, log, SCHEMA, "id").writeStream.foreachBatch(broken).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    write(spark, log, range(10, 15))
    follow(spark, log, checkpoint, out)
    assert sorted(x[0] for x in out) == list(range(10))
    follow(spark, log, checkpoint, out)
    assert sorted(x[0] for x in out) == list(range(15))


def test_tail_reader_opens_only_files_above_the_last_key(spark, tmp_path):
    log = str(tmp_path / "log")
    for low in range(0, 50, 10):
        write(spark, log, range(low, low + 10))
    reader = TailReader(SCHEMA, {"path": f"file://{log}", "key": "id"})
    assert reader.latestOffset() == {"last": 49} and reader.initialOffset()["last"] < 0
    parts = reader.partitions({"last": 29}, {"last": 49})
    assert sum(len(p.paths) for p in parts) == 2
    assert sorted(i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()) == list(range(30, 50))
    assert reader.partitions({"last": 49}, {"last": 49}) == [] and list(reader.read(Files([], 0, 1))) == []
