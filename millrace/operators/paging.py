"""Pages of an order (O2) from stored ranges: a late page opens the ranges that hold it and sorts nothing else.

The rows are written once by ranges of the order's keys, a folder and a sorted file a range, beside a table of how many rows each range has and how many come before it. A row's place
in the order is the number before its range and its place in the file, so page k is found without a look at the pages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a range is laid out for.
RANGE_ROWS = 1_000_000


def build_pages(df: DataFrame, keys: list, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Store ``df`` under ``path`` in the order of ``keys``, which end in a unique one and may be descending; nulls come as in ``orderBy``.

    One shuffle by ranges. The number of ranges follows the number of rows; an empty table has none. A range is one task's and one file.
    """
    ranges = -(-df.count() // range_rows) or 1
    ranged = df.repartitionByRange(ranges, *keys).withColumn("__range", F.spark_partition_id())
    ranged.sortWithinPartitions("__range", *keys).write.option("maxRecordsPerFile", 0).partitionBy("__range").parquet(f"{path}/rows")
    counted = df.sparkSession.read.schema(_ranged(df.schema)).parquet(f"{path}/rows").groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")).coalesce(1).write.parquet(f"{path}/counts")


def _ranged(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("__range", T.IntegerType())])


def counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("__range int, n long, before long").parquet(f"{path}/counts")


def page_count(spark: SparkSession, path: str, size: int = 50) -> int:
    """Number of pages; 0 for an empty table."""
    rows = counts(spark, path).agg(F.sum("n").alias("n")).first().n or 0
    return -(-rows // size)


def holding(spark: SparkSession, path: str, number: int, size: int = 50) -> dict[int, int]:
    """Ranges that hold rows of a page, with the number of rows before each: ``size`` ranges at most."""
    start = max(0, (number - 1) * size)
    held = counts(spark, path).where((F.col("before") < start + size) & (F.col("before") + F.col("n") > start))
    return {r["__range"]: r.before for r in held.collect()}


def seek_page(spark: SparkSession, path: str, schema: T.StructType, number: int, size: int = 50) -> DataFrame:
    """O2: page ``number`` from 1 of what ``build_pages`` stored, in its order. Past the last page there are no rows; numbers below 1 give the first page."""
    found = holding(spark, path, number, size)
    if not found:
        return spark.createDataFrame([], schema)
    start = max(0, (number - 1) * size)
    read = spark.read.schema(_ranged(schema)).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/__range={r}" for r in sorted(found)])
    first = F.element_at(F.create_map(*[F.lit(x) for r, before in found.items() for x in (r, before)]), F.col("__range"))
    placed = read.withColumn("__place", first + F.col("_metadata.row_index"))
    return placed.where((F.col("__place") >= start) & (F.col("__place") < start + size)).orderBy("__place").select(*schema.names)
