"""M4 as a stream source of its own: the rows of a growing log with a key above the last one seen.

The offset is the last key, so a stream's checkpoint says in the reader's own terms how far it has come. A log is a folder of Parquet files whose keys grow as files are
added (whole numbers). The driver reads the footer of each new file once and keeps two numbers of it; the tasks skip row groups by their own statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "millrace_tail"
#: Bytes of log files that one task reads, a file more at most.
TASK_BYTES = 128 << 20
ANY = (-(1 << 63), (1 << 63) - 1)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """Store and path in it: a URI that pyarrow knows (file, hdfs, s3, gs, abfs) or a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def key_range(meta: pq.FileMetaData, group: int, key: str) -> tuple[int, int] | None:
    """Least and greatest key of a row group; None if it holds none. Without statistics: all keys are possible."""
    stats = next(c for c in map(meta.row_group(group).column, range(meta.num_columns)) if c.path_in_schema == key).statistics
    if stats is not None and stats.has_min_max:
        return stats.min, stats.max
    return ANY if stats is None or stats.num_values else None


@dataclass
class Files(InputPartition):
    paths: list[str]
    after: int
    upto: int


class TailReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options):
        self.path, self.key, self.after = options["path"], options["key"], int(options.get("after", -(1 << 63)))
        self.fields = to_arrow_schema(schema)
        self.known: dict[str, tuple[int, int, int]] = {}  # file -> least key, greatest key, bytes

    def look(self) -> None:
        """Take in the files that are new."""
        store, root = open_folder(self.path)
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.path in self.known or not f.is_file or f.base_name[0] in "._" or not f.base_name.endswith(".parquet"):
                continue
            with store.open_input_file(f.path) as file:
                opened = pq.ParquetFile(file)
                held = [r for g in range(opened.metadata.num_row_groups) if (r := key_range(opened.metadata, g, self.key))]
                if ANY in held:
                    keys = pc.min_max(opened.read(columns=[self.key]).column(0))
                    held = [(keys["min"].as_py(), keys["max"].as_py())] if keys["min"].is_valid else []
            self.known[f.path] = (min(r[0] for r in held), max(r[1] for r in held), f.size) if held else (0, -1, 0)

    def initialOffset(self) -> dict:
        return {"last": self.after}

    def latestOffset(self) -> dict:
        self.look()
        return {"last": max([self.after, *[high for low, high, _ in self.known.values() if low <= high]])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.look()
        after, upto = start["last"], end["last"]
        out, paths, size = [], [], 0
        for path, (low, high, n) in sorted(self.known.items(), key=lambda x: x[1]):
            if low <= upto and high > after and low <= high:
                paths.append(path)
                size += n
                if size >= TASK_BYTES:
                    out.append(Files(paths, after, upto))
                    paths, size = [], 0
        return out + ([Files(paths, after, upto)] if paths else [])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as file:
                opened = pq.ParquetFile(file)
                groups = [g for g in range(opened.metadata.num_row_groups) if (r := key_range(opened.metadata, g, self.key)) and r[0] <= partition.upto and r[1] > partition.after]
                for batch in opened.iter_batches(batch_size=8192, row_groups=groups, columns=list(dict.fromkeys([*self.fields.names, self.key]))):
                    keys = batch.column(self.key)
                    now = batch.filter(pc.and_(pc.greater(keys, partition.after), pc.less_equal(keys, partition.upto)))
                    if now.num_rows:
                        yield pa.RecordBatch.from_arrays([now.column(f.name).cast(f.type) if f.name in now.schema.names else pa.nulls(now.num_rows, f.type) for f in self.fields], schema=self.fields)

    def commit(self, end: dict) -> None:
        """Nothing to let go: the log is its owner's."""


class TailSource(DataSource):
    """Options: ``path``, ``key``, ``after`` (the last key seen before the stream began; default: all rows). The schema is the reader's, its columns by name."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: T.StructType) -> TailReader:
        return TailReader(schema, self.options)


def tail_stream(spark: SparkSession, path: str, schema: T.StructType, key: str, after: int | None = None) -> DataFrame:
    """M4: a stream of the log's rows whose ``key`` is above the last one seen (``after`` at first, then the checkpoint's).

    Columns that a file lacks are null. Rows whose key is null or not above what the stream has passed are not given, as by a poll for keys above the last: the log has one writer whose keys grow.
    Nothing comes of an empty or missing folder. With the trigger ``availableNow`` a run is one batch: one that broke off comes again, with the same rows, and the next run goes on from there.
    """
    spark.dataSource.register(TailSource)
    made = spark.readStream.format(NAME).schema(schema).option("path", path).option("key", key)
    return (made if after is None else made.option("after", str(after))).load()
