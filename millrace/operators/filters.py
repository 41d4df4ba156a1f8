"""Projections, filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, key: str, v) -> DataFrame:
    """P1."""
    return df.where(F.col(key) == v)


def active(df: DataFrame, flag: str, *order: str) -> DataFrame:
    """Rows whose flag is 1, in order."""
    rows = df.where(F.col(flag) == 1)
    return rows.orderBy(*order) if order else rows


def to_target(df: DataFrame, renames: dict[str, str], constants: dict[str, object]) -> DataFrame:
    """Renamed columns, constants, and typed nulls where a constant is ``(None, type)``."""
    fixed = [F.lit(None).cast(v[1]).alias(k) if isinstance(v, tuple) else F.lit(v).alias(k) for k, v in constants.items()]
    return df.select(*[F.col(a).alias(b) for a, b in renames.items()], *fixed)


def status_class(df: DataFrame, code: str, cls: str) -> DataFrame:
    """2xx, 3xx, 4xx, or 5xx, the last without an upper bound."""
    low = int(cls[0]) * 100
    return df.where(F.col(code) >= low) if low == 500 else df.where((F.col(code) >= low) & (F.col(code) < low + 100))


def where_supplied(df: DataFrame, **eq) -> DataFrame:
    """P5: equality on each supplied column; None is not supplied."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in eq.items() if v is not None], df)


def rate_filter(df: DataFrame, kind: str | None = None, on=None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Rates (rate_type, effective_date, rate_value, id) by what is supplied; with nothing supplied the latest of each type."""
    from .position import latest_per

    if kind is None and on is None and lo is None and hi is None:
        return latest_per(df, ["rate_type"], [F.col("effective_date").desc(), F.col("id").desc()])
    tests = [(kind, lambda v: F.col("rate_type") == v), (on, lambda v: F.col("effective_date") == v), (lo, lambda v: F.col("rate_value") >= v), (hi, lambda v: F.col("rate_value") <= v)]
    return reduce(lambda d, t: d.where(t[1](t[0])), [t for t in tests if t[0] is not None], df)


def indicator_filter(df: DataFrame, code: str | None = None, text: str | None = None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Indicators (code, period, value) by code, part of the period in any case, and range."""
    tests = [(code, lambda v: F.col("code") == v), (text, lambda v: F.lower("period").contains(v.lower())), (lo, lambda v: F.col("value") >= v), (hi, lambda v: F.col("value") <= v)]
    return reduce(lambda d, t: d.where(t[1](t[0])), [t for t in tests if t[0] is not None], df)


def eq_or_blank(c: Column, v) -> Column:
    """P8."""
    return c.isNull() | (c == "") | (c == v)


def in_ids(df: DataFrame, c: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``c`` is in the first column of ``ids``; Spark broadcasts that side when it is small."""
    key = ids.columns[0]
    return df.join(ids.select(F.col(key).alias("__id")), F.col(c) == F.col("__id"), "left_semi")


def text_filter_options(df: DataFrame, c: str, v: str, option_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """P10: rows whose column equals ``v`` as text, and the options left in other columns after that filter."""
    rows = df.where(F.col(c).cast("string") == v)
    return rows, rows.agg(*[F.array_sort(F.collect_set(F.col(x).cast("string"))).alias(x) for x in option_cols])


def deadline_class(c: Column, asof) -> Column:
    """None, overdue, today, week (the next seven days), later."""
    today = F.lit(asof).cast("date")
    return F.when(c.isNull(), "none").when(c < today, "overdue").when(c == today, "today").when(c <= F.date_add(today, 7), "week").otherwise("later")


def has_assignee(c: Column, id_: str) -> Column:
    """Membership in a comma list."""
    return F.array_contains(F.split(F.coalesce(c, F.lit("")), r"\s*,\s*"), id_)


def due_state(df: DataFrame, deadline: str, status: str, asof) -> DataFrame:
    """Days left, overdue and soon (three days) unless done."""
    left = F.datediff(F.col(deadline), F.lit(asof).cast("date"))
    return df.withColumns({"days_left": left, "due": F.when((left < 0) & (F.col(status) != "done"), "overdue").when((left <= 3) & (F.col(status) != "done"), "soon").otherwise("")})


def on_day(c: Column, day: str) -> Column:
    """A half-open range, so that it reaches the scan."""
    return (c >= F.to_timestamp_ntz(F.lit(day))) & (c < F.to_timestamp_ntz(F.lit(day)) + F.expr("INTERVAL 1 DAY"))
