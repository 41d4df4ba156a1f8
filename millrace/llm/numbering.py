"""Gapless numbering of the rows of each group without sending a group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gapless(df: DataFrame, group: str, order: list[str], out: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... within each value of ``group``.

    Rows are dealt into hash buckets of ``order``; a bucket's first number is the number of rows of the
    group in the buckets before it (a table of group x bucket counts), and only the rows of one
    (group, bucket) are ever sorted together. The number of buckets follows the rows, so that a bucket keeps its size.
    ``df`` is read twice: pass a table or a plan that is cheap and gives the same rows again.
    Repeated rows get numbers of their own; an empty table stays empty.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // rows_per_bucket + 1)
    bucket = F.pmod(F.xxhash64(*order), F.lit(n)).cast("int")
    dealt = df.withColumn("__bucket", bucket)
    counts = dealt.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("__group"), F.col("__bucket").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(group, "__bucket").orderBy(*order)
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1)
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__bucket") == F.col("__at")))
    return joined.withColumn(out, (F.col("__start") + F.col("__rank")).cast("long")).drop("__bucket", "__rank", "__group", "__at", "__start")
