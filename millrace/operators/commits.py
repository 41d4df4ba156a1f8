"""Tables that batches are committed to once, and that keyed changes open only in part.

A batch is written into the folder of its number and counts once Spark has marked that write as complete. A batch that broke off leaves a folder without the mark, which no reader
looks at and the next try replaces; a batch that is replayed after its commit changes nothing. Rows lie in folders by a hash of their keys (``bucket``), so a
change opens the buckets of its keys only:

- in a ledger (``ledger=True``) a batch adds rows, and a bucket is what all batches wrote to it; ``ranges`` tells the values of the first key in each, so that groups of
  files that can't hold a batch's keys stay closed;
- in a table of current rows a batch writes whole buckets anew, and a bucket is what the last batch wrote to it.

``compact`` brings all batches so far into one folder that stands for them. Batch numbers are those of one stream or job: another one begins at ``next_batch``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32
#: Rows that one task sorts, about. Tasks are counted by rows: keys compress so well that tasks cut by bytes would hold too many.
TASK_ROWS = 500_000


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in whatever store the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    got = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(x.getPath().toString()) for x in got or [])


def folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(batch, folder) of what counts: the last compaction and the batches after it."""
    done = [x.rpartition("/")[0] for kind in ("merged", "batch") for x in found(spark, f"{path}/{kind}=*/_SUCCESS")]
    numbered = [(int(m[2]), m[1] == "merged", x) for x in done if (m := re.search(r"(merged|batch)=(\d+)$", x))]
    base = max((n for n, merged, _ in numbered if merged), default=-1)
    return sorted((n, x) for n, merged, x in numbered if (merged and n == base) or (not merged and n > base))


def next_batch(spark: SparkSession, path: str) -> int:
    return max((n for n, _ in folders(spark, path)), default=-1) + 1


def groups(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(batch, bucket, folder) of all buckets that count."""
    at = dict((x, n) for n, x in folders(spark, path))
    every = [x for kind in ("merged", "batch") for x in found(spark, f"{path}/{kind}=*/bucket=*")]
    return sorted((at[x.rpartition("/")[0]], int(x.rpartition("=")[2]), x) for x in every if x.rpartition("/")[0] in at)


def write(df: DataFrame, path: str, batch: int, keys: list[str], buckets: int = BUCKETS) -> None:
    """Commit rows as batch ``batch``; nothing happens if it is committed. The rows' order within files is by key."""
    spark = df.sparkSession
    if any(n >= batch for n, _ in folders(spark, path)):
        return
    put(dealt(df, keys, buckets, df.count()), f"{path}/batch={batch}", keys, buckets)


def put(df: DataFrame, folder: str, keys: list[str], buckets: int) -> None:
    df.withColumn("bucket", bucket_of(keys, buckets)).sortWithinPartitions("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(folder)


def dealt(df: DataFrame, keys: list[str], buckets: int, rows: int) -> DataFrame:
    """``df`` of about ``rows`` rows by bucket; a bucket of more than TASK_ROWS goes to several tasks, which write a file each."""
    shares = rows // (buckets * TASK_ROWS) + 1
    tasks = min(buckets * shares, rows // (TASK_ROWS // 4) + 1)
    return df.repartition(tasks, bucket_of(keys, buckets), F.pmod(F.xxhash64(F.lit("share"), *keys), F.lit(shares)))


def dealt_by_rows(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` by its keys in tasks of about TASK_ROWS of ``rows`` rows; what is joined with it by these keys is dealt likewise, and merges."""
    return df.repartition(max(rows // TASK_ROWS + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys).hint("merge")


def read_folders(spark: SparkSession, where: list[str], schema: T.StructType) -> DataFrame:
    """Rows of bucket folders, without the bucket."""
    return spark.read.schema(schema).parquet(*where) if where else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: T.StructType, ledger: bool = False, buckets: list[int] | None = None) -> DataFrame:
    """The committed rows, of some buckets or of all."""
    every = [g for g in groups(spark, path) if buckets is None or g[1] in buckets]
    last = {b: x for _, b, x in every}  # batches ascend
    return read_folders(spark, [x for _, _, x in every] if ledger else list(last.values()), schema)


def add(rows: DataFrame, path: str, batch: int, keys: list[str], order: list, buckets: int = BUCKETS) -> list[str]:
    """Insert-ignore into a ledger: of the rows whose keys it doesn't hold, the first of each key (by ``order``) comes in. Returns the folders that were opened.

    Which folders may hold a key: those of its bucket whose range of the first key meets the batch's. Keys that are null are keys like any other.
    """
    from .position import latest_per

    spark, first = rows.sparkSession, keys[0]
    if any(n >= batch for n, _ in folders(spark, path)):
        return []
    rows = rows.withColumn("__bucket", bucket_of(keys, buckets))
    new = latest_per(rows, keys, order)
    low_high = [F.count(F.lit(1)).alias("n"), F.min(first).alias("low"), F.max(first).alias("high"), F.max(F.col(first).isNull()).alias("none")]
    asked = {r["__bucket"]: r for r in new.groupBy("__bucket").agg(*low_high).collect()}  # a row a bucket at most
    every = [g for g in groups(spark, path) if g[1] in asked]
    known = {}
    if every:
        kinds = {g[0]: g[2].rpartition("/")[0].rpartition("/")[2] for g in every}  # batch=n or merged=n
        ranges = spark.read.parquet(*[f"{path}/_ranges/{kind}" for kind in sorted(kinds.values())])
        known = {(r.batch, r.bucket): r for r in ranges.where(F.col("bucket").isin(sorted(asked))).collect()}

    def may(batch_: int, bucket: int) -> bool:
        a, b = asked[bucket], known[batch_, bucket]
        return bool(a.none and b.none) or None not in (a.low, b.low) and a.low <= b.high and b.low <= a.high

    opened = [x for n, b, x in every if may(n, b)]
    schema = T.StructType([f for f in rows.schema.fields if f.name != "__bucket"])
    held = read_folders(spark, opened, schema).select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    come = new.join(held, same, "left_anti").drop("__bucket") if opened else new.drop("__bucket")
    describe(come, path, batch, keys, buckets)
    put(dealt(come, keys, buckets, sum(r.n for r in asked.values())), f"{path}/batch={batch}", keys, buckets)
    return opened


def describe(rows: DataFrame, path: str, batch: int, keys: list[str], buckets: int, kind: str = "batch") -> None:
    """The ranges of a batch's buckets; written ahead of its rows, and read only once these count."""
    first = keys[0]
    each = rows.groupBy(bucket_of(keys, buckets).alias("bucket")).agg(F.min(first).alias("low"), F.max(first).alias("high"), F.max(F.col(first).isNull()).alias("none"))
    each.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("overwrite").parquet(f"{path}/_ranges/{kind}={batch}")


def change(rows: DataFrame, path: str, batch: int, keys: list[str], schema: T.StructType, apply, buckets: int = BUCKETS) -> None:
    """Next rows of the buckets that ``rows`` has keys in: ``apply(current rows of these buckets, rows)``; other buckets stay closed."""
    spark = rows.sparkSession
    if any(n >= batch for n, _ in folders(spark, path)):
        return
    touched = [r.b for r in rows.select(bucket_of(keys, buckets).alias("b")).distinct().collect()]  # BUCKETS at most
    if touched:
        now = read(spark, path, schema, buckets=touched)
        put(dealt(apply(now, rows), keys, buckets, now.count() + rows.count()), f"{path}/batch={batch}", keys, buckets)


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], ledger: bool = False, buckets: int = BUCKETS) -> None:
    """One folder in place of all batches so far. It counts once it is complete; what it stands for is then deleted."""
    old = folders(spark, path)
    if len(old) < 2:
        return
    last, whole = old[-1][0], read(spark, path, schema, ledger)
    if ledger:
        describe(whole, path, last, keys, buckets, "merged")
    put(dealt(whole, keys, buckets, whole.count()), f"{path}/merged={last}", keys, buckets)
    hadoop = spark._jvm.org.apache.hadoop.fs
    for _, folder in old:
        at = hadoop.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
