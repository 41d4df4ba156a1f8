"""Streaming twins of the append, poll and upkeep operators. Each takes a streaming DataFrame; all work on batch frames too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import commits
from ..operators.changes import upsert
from ..operators.position import latest_per


def daily_stats(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """M1 with the day so far (complete or update mode): requests (ts, user_id, status, duration_ms) by day; users are counted approximately, as one aggregate of a stream allows."""
    day = F.window("ts", "1 day")
    return stream.withWatermark("ts", lateness).groupBy(day).agg(
        F.count(F.lit(1)).alias("total"), F.approx_count_distinct("user_id").alias("users"), F.count_if(F.col("status") >= 400).alias("errors"),
        F.coalesce(F.floor(F.avg("duration_ms")).cast("long"), F.lit(0)).alias("mean_ms"),
    ).select(F.col("window.start").cast("date").alias("day"), "total", "users", "errors", "mean_ms")


def daily_stats_exact(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """M1: requests by day, users counted exactly.

    Two windows in a chain: sums of each user's day, then of the day. On a stream (append mode) a day comes out once the watermark has passed it, and its
    users leave the state with it.
    """
    own = stream.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("day"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 400).alias("errors"), F.sum("duration_ms").alias("ms"), F.count("duration_ms").alias("timed"),
    )
    return own.groupBy(F.window(F.window_time("day"), "1 day").alias("day")).agg(
        F.sum("n").alias("total"), F.count("user_id").alias("users"), F.sum("errors").alias("errors"), F.coalesce(F.floor(F.sum("ms") / F.sum("timed")).cast("long"), F.lit(0)).alias("mean_ms"),
    ).select(F.col("day.start").cast("date").alias("day"), "total", "users", "errors", "mean_ms")


def ledger_stream(stream: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """M2: first write wins among rows that arrive within ``lateness`` of each other."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def ledger_sink(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """M2, for all time: a foreachBatch sink that adds the keys that a ledger (``commits``) does not hold, and opens only files that may hold them.

    A batch that is repeated finds all its keys there and adds nothing; one that broke off was no part of the ledger. One stream writes to a ledger at a time.
    """

    def sink(batch: DataFrame, _: int) -> None:
        commits.add(batch, path, commits.next_batch(batch.sparkSession, path), keys, order)

    return sink


def upsert_sink(path: str, schema, keys: list[str], cols: list[str], order: list, flags: dict[str, object] | None = None, first: int = 1) -> Callable[[DataFrame, int], None]:
    """C1 as a foreachBatch sink over a table of current rows (``commits``): each key's first row by ``order`` in a batch counts; only buckets that hold a batch's keys are opened.

    Batch n of the stream is batch ``first`` + n of the table; one that broke off or is repeated changes nothing.
    """

    def sink(batch: DataFrame, number: int) -> None:
        commits.change(latest_per(batch, keys, order), path, first + number, keys, schema, lambda now, rows: upsert(now, rows, keys, cols, flags))

    return sink


def current_state(stream: DataFrame, keys: list[str], cols: list[str], order: str) -> DataFrame:
    """M3: the latest row of each key (update mode)."""
    return stream.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in cols])


def task_state(stream: DataFrame) -> DataFrame:
    """M3 with the rule that 0 percent starts the clock anew: document_id, task_type, status, percent, updated_at, start_time (update mode).

    The clock stands at the latest row at 0 percent, or at the first row if there is none; whatever order a task's rows arrive in, within a batch or over several, the state is the same.
    A row without a percentage leaves that of the row before it.
    """
    at = F.col("updated_at")
    return stream.groupBy("document_id", "task_type").agg(
        F.max_by("status", at).alias("status"), F.max_by("percent", F.when(F.col("percent").isNotNull(), at)).alias("percent"), F.max(at).alias("updated_at"),
        F.coalesce(F.max(F.when(F.col("percent") == 0, at)), F.min(at)).alias("start_time"),
    )


def tail(df: DataFrame, last_id: int, key: str = "id") -> DataFrame:
    """M4: rows after the last one seen; on a stream the checkpoint keeps the place."""
    return df.where(F.col(key) > last_id)


def status_upkeep(apply: Callable[[DataFrame], None], parent: str) -> Callable[[DataFrame, int], None]:
    """M5: a foreachBatch sink that hands the distinct parents changed in a batch to ``apply``."""

    def sink(batch: DataFrame, _: int) -> None:
        apply(batch.select(parent).where(F.col(parent).isNotNull()).distinct())

    return sink


def upkeep_sink(path: str, schema, key: str, parent: str, apply: Callable[[DataFrame, DataFrame], DataFrame], first: int = 1) -> Callable[[DataFrame, int], None]:
    """M5 over a table of current rows (``commits``): ``apply(rows, changed)`` gives the next rows of the buckets that hold the distinct parents (``key``) changed in a batch.

    Batch n of the stream is batch ``first`` + n of the table; one that broke off or is repeated changes nothing.
    """

    def sink(batch: DataFrame, number: int) -> None:
        changed = batch.select(F.col(parent).alias(key)).where(F.col(key).isNotNull()).distinct()
        commits.change(changed, path, first + number, [key], schema, apply)

    return sink


def assemble_text(stream: DataFrame, key: str, seq: str, token: str, sep: str = "", ts: str | None = None, gap: str = "10 minutes") -> DataFrame:
    """M6: the text so far of each message, its tokens in order. With ``ts`` a message ends after ``gap`` without a token: it then comes out (append mode) and leaves the state."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce(token, F.lit("")).alias("t"))))
    made = [F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias("text"), F.count(F.lit(1)).alias("tokens")]
    if ts is None:
        return stream.groupBy(key).agg(*made)
    return stream.withWatermark(ts, gap).groupBy(key, F.session_window(ts, gap)).agg(*made).drop("session_window")
