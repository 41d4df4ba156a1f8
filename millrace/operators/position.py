"""Ranking, order, pages, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n_per(df: DataFrame, part: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each group before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def latest_per(df: DataFrame, part: list[str], order: list) -> DataFrame:
    """W1."""
    return first_n_per(df, part, order, 1)


def last_n_per(df: DataFrame, part: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group; ``order`` is ascending."""
    return first_n_per(df, part, [c.desc() for c in order], n)


def latest_side_by_side(df: DataFrame, key: str, value: str, order: list[str], names: list[str]) -> DataFrame:
    """The latest value of each named series in one row, null if there is none."""
    return df.agg(*[F.max_by(F.when(F.col(key) == n, F.col(value)), F.when(F.col(key) == n, F.struct(*order))).alias(n) for n in names])


def rank_zero(df: DataFrame, part: list[str], order: list) -> DataFrame:
    """Positions from 0 within each group, best first; ``order`` ends in a unique key.

    Rows are numbered over all groups by ranges, less their group's first number, so that a group is never sorted in one task.
    """
    from .changes import assign_ids

    numbered = assign_ids(df, 0, [*[F.col(c) for c in part], *order], "__number")
    first = numbered.groupBy(*[F.col(c).alias(f"__of_{c}") for c in part]).agg(F.min("__number").alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in part])
    return numbered.join(first, same).withColumn("rank", F.col("__number") - F.col("__first")).drop("__number", "__first", *[f"__of_{c}" for c in part])


def fill_forward(df: DataFrame, part: list[str], order: list, cols: list[str]) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def group_runs(df: DataFrame, part: list[str], order: list, is_value: Column) -> DataFrame:
    """A run of labels followed by a run of values is one record; adds ``run`` from 1."""
    w = Window.partitionBy(*part).orderBy(*order)
    value = F.coalesce(is_value, F.lit(False))
    flagged = df.withColumn("__v", value).withColumn("__starts", F.when(~F.col("__v") & F.coalesce(F.lag("__v").over(w), F.lit(True)), 1).otherwise(0))
    return flagged.withColumn("run", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__v", "__starts")


def attach_next(df: DataFrame, part: list[str], order: list, text: str, is_code: Column, is_number: Column) -> DataFrame:
    """A line that is only a code merges with the next line unless that is a number.

    In a row of code lines every second one is taken up by the one before it.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    flagged = df.withColumns({"__code": F.coalesce(is_code, F.lit(False)), "__num": F.coalesce(is_number, F.lit(True))})
    flagged = flagged.withColumn("__takes", F.col("__code") & F.coalesce(~F.lead("__num").over(w), F.lit(False)))
    # place in an unbroken row of lines that could take the next: odd ones do
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    flagged = flagged.withColumn("__at", F.row_number().over(w))
    place = F.col("__at") - F.coalesce(F.max(F.when(~F.col("__takes"), F.col("__at"))).over(so_far), F.lit(0))
    flagged = flagged.withColumn("__takes", F.col("__takes") & (place % 2 == 1))
    merged = F.when(F.col("__takes"), F.concat_ws(" ", F.trim(text), F.trim(F.lead(text).over(w)))).otherwise(F.col(text))
    return flagged.withColumns({text: merged, "__taken": F.coalesce(F.lag("__takes").over(w), F.lit(False))}).where(~F.col("__taken")).drop("__code", "__num", "__takes", "__at", "__taken")


def latest_active_group(df: DataFrame, key: str, status: str, running: tuple[str, ...], updated: str) -> DataFrame:
    """All rows of the group that was active last, by update time; the one-row key is broadcast."""
    last = df.where(F.col(status).isin(*running)).agg(F.max_by(key, F.struct(updated, key)).alias("__key"))
    return df.join(F.broadcast(last), F.col(key) == F.col("__key"), "left_semi").orderBy(updated)


def ordered(df: DataFrame, *keys) -> DataFrame:
    """O1: nulls first ascending, last descending, as Spark has it."""
    return df.orderBy(*keys)


def page(df: DataFrame, keys: list, number: int, size: int = 50) -> DataFrame:
    """O2: page ``number`` from 1; ``keys`` end in a unique one."""
    return df.orderBy(*keys).offset((number - 1) * size).limit(size)


def top_n(df: DataFrame, keys: list, n: int, cap: int) -> DataFrame:
    """O3: the first ``n``, between 1 and ``cap``."""
    return df.orderBy(*keys).limit(max(1, min(n, cap)))


def order_numeric(df: DataFrame, c: str, *then: str) -> DataFrame:
    """Text codes in numeric order; what is no number comes first."""
    return df.orderBy(F.col(c).try_cast("int"), *then)


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """O5."""
    return df.orderBy(F.col(score).desc(), tie).limit(k)


def options_with(df: DataFrame, c: str, constants: list[str]) -> DataFrame:
    """Distinct non-null values and constants, sorted."""
    fixed = df.sparkSession.createDataFrame([(x,) for x in constants], f"`{c}` string")
    return df.select(F.col(c).cast("string").alias(c)).where(F.col(c).isNotNull()).union(fixed).distinct().orderBy(c)


def concat_series(*dfs: DataFrame) -> DataFrame:
    """Series one after another, latest period first."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.orderBy(F.col("period").desc(), F.col("id").desc())


def first_by(df: DataFrame, key: str, order: list, cap: int | None = None) -> DataFrame:
    """The first row of each non-blank key, ``cap`` rows at most in arrival order."""
    k = F.col(key)
    firsts = latest_per(df.where(k.isNotNull() & (k.cast("string") != "")), [key], order)
    return firsts if cap is None else firsts.orderBy(*order).limit(cap)


def distinct_in_order(first: Column, rest: Column) -> Column:
    """U4: the original, then trimmed variants without blanks and repeats."""
    return F.array_distinct(F.concat(F.array(first), F.filter(F.transform(rest, lambda x: F.trim(x)), lambda x: x != "")))
