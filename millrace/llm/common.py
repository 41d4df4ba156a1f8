"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.durable import durable, new_path, shared_dir  # noqa: F401
from ..sources.feeds import spread

#: Rows of one Arrow batch handed to Python: a batch of long texts stays within a few tens of MB.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    return durable(df, name)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing needs any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def files(uri: str):
    """The ``pyarrow.fs`` file system of a shared folder's URI or path, and the path in it; for use in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}") if not uri.startswith("file:/") or uri.startswith("file://") else fs.FileSystem.from_uri("file://" + uri[5:])


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts. The size of a batch is a setting of the session, there is none of the call's own; it stays set."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(f, schema)


def fold(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def field(df: DataFrame, name: str, rename: str | None = None) -> T.StructField:
    return T.StructField(rename or name, df.schema[name].dataType, True)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
