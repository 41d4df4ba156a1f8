"""Aggregations of the relational views; each is one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import project_status


def count_where(df: DataFrame, cond: Column | None = None) -> DataFrame:
    """A1."""
    return df.agg(F.count(F.lit(1)).alias("n") if cond is None else F.count_if(cond).alias("n"))


def request_stats(df: DataFrame, day: Column) -> DataFrame:
    """A2: per day requests, distinct known users, errors, whole mean duration. Columns: user_id, status, duration_ms."""
    return df.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("status") >= 400).alias("errors"),
        F.coalesce(F.floor(F.avg("duration_ms")).cast("long"), F.lit(0)).alias("mean_ms"),
    )


def customer_overview(customers: DataFrame, deals: DataFrame, key: str) -> DataFrame:
    """A3: customers with their number of deals, zero included, and a constant size."""
    counts = deals.groupBy(key).agg(F.count(F.lit(1)).alias("deals"))
    return customers.join(counts, key, "left").withColumns({"deals": F.coalesce("deals", F.lit(0)), "size": F.lit(0)})


def product_counts(products: DataFrame, deals: DataFrame, key: str) -> DataFrame:
    """A4."""
    return products.join(deals.groupBy(key).agg(F.count(F.lit(1)).alias("deals")), key, "left").withColumn("deals", F.coalesce("deals", F.lit(0)))


def language_pivot(df: DataFrame, id_: str, lang: str, text: str, langs: list[str]) -> DataFrame:
    """A5: one row per id with the text of each language."""
    return df.groupBy(id_).pivot(lang, langs).agg(F.max(text))


def kr_from_products(krs: DataFrame, deals: DataFrame) -> DataFrame:
    """Krs (kr_id, product, statuses: JSON list), deals (product, status, amount) -> kr_id, value; all at once.

    No deal gives 0; an empty or unreadable list of statuses gives no row, so that the old value stays.
    """
    wanted = krs.withColumn("s", F.from_json("statuses", "array<string>")).where(F.size("s") > 0)
    sums = deals.groupBy("product", "status").agg(F.sum("amount").alias("amount"))
    each = wanted.select("kr_id", "product", F.explode(F.array_distinct("s")).alias("status")).join(sums, ["product", "status"], "left")
    return each.groupBy("kr_id").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("value"))


def kr_from_projects(krs: DataFrame, items: DataFrame) -> DataFrame:
    """Krs (kr_id, project_id, target), items (project_id, status) -> kr_id, value: share done of the target."""
    counts = child_counts(items, "project_id")
    share = F.when(F.col("total") > 0, F.col("done") / F.col("total") * 100.0).otherwise(0.0)
    return krs.join(counts, "project_id", "left").select("kr_id", F.round(share * F.col("target") / 100.0, 2).alias("value"))


def child_counts(items: DataFrame, parent: str) -> DataFrame:
    """Items (status) counted once for all three numbers."""
    return items.groupBy(parent).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status").isin("in_progress", "blocked")).alias("in_progress"))


def join_text(df: DataFrame, key: str, text: str, order: str, sep: str) -> DataFrame:
    """Texts of a key in order; nulls are left out."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias(text))


def collect_children(items: DataFrame, prereqs: DataFrame, subs: DataFrame, owners: DataFrame) -> DataFrame:
    """A10: items (item_id) with their prerequisites, sub-items and owners as sorted arrays, empty if there are none."""
    p = prereqs.groupBy("item_id").agg(F.array_sort(F.collect_list("requires")).alias("prereqs"))
    s = subs.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "title", "status"))).alias("subitems"))
    o = owners.groupBy("item_id").agg(F.array_sort(F.collect_list("owner")).alias("owners"))
    joined = items.join(p, "item_id", "left").join(s, "item_id", "left").join(o, "item_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.array()) for c in ("prereqs", "subitems", "owners")})


def timing_summary(df: DataFrame, *measures: str) -> DataFrame:
    """Runs, whole means of the timings, errors (a non-null ``error``)."""
    return df.agg(F.count(F.lit(1)).alias("runs"), *[F.round(F.avg(m)).cast("long").alias(f"mean_{m}") for m in measures], F.count_if(F.col("error").isNotNull()).alias("errors"))


def timing_by(df: DataFrame, c: str, measure: str) -> DataFrame:
    """Successful runs by model or method, fastest first."""
    return df.where(F.col("status") == "ok").groupBy(c).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(measure)).cast("long").alias("mean")).orderBy("mean", c)


def options(df: DataFrame, c: str) -> DataFrame:
    """A13."""
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


def coverage(deals: DataFrame, offers: DataFrame) -> DataFrame:
    """Deals (deal_id, amount) against the sum of offers (deal_id, offered): percent and class."""
    sums = offers.groupBy("deal_id").agg(F.sum("offered").alias("offered"))
    percent = F.when(F.col("amount") > 0, F.coalesce("offered", F.lit(0.0)) / F.col("amount") * 100).otherwise(0.0)
    joined = deals.join(sums, "deal_id", "left").withColumn("percent", percent)
    return joined.withColumn("class", F.when(F.col("percent") >= 100, "full").when(F.col("percent") >= 75, "near").otherwise("low"))


def progress(krs: DataFrame) -> DataFrame:
    """Achieved and with the pipeline, in percent of the target and 100 at most; 0 without a target."""
    capped = lambda c: F.when(F.col("target") > 0, F.least(c / F.col("target") * 100, F.lit(100.0))).otherwise(0.0)
    return krs.withColumns({"achieved_pct": capped(F.col("achieved")), "total_pct": capped(F.col("achieved") + F.col("pipeline"))})


def backlog_counts(items: DataFrame, kinds: list[str]) -> DataFrame:
    """Items by parent type and done ones."""
    return items.agg(*[F.count_if(F.col("parent_type") == k).alias(k) for k in kinds], F.count_if(F.col("status") == "done").alias("done"))


def period_summary(lines: DataFrame) -> DataFrame:
    """Lines (period_code, period_date, period_label, line_order): what the first line of each period says."""
    return lines.groupBy("period_code").agg(F.min_by("period_date", "line_order").alias("period_date"), F.min_by("period_label", "line_order").alias("period_label"))


def ingest_counts(batch: DataFrame, ledger: DataFrame, keys: list[str], source: str) -> DataFrame:
    """New and ignored rows of a batch by source, with a total row (null source)."""
    known = ledger.select(*keys).distinct().withColumn("__known", F.lit(True))
    firsts = batch.groupBy(source, *[k for k in keys if k != source]).agg(F.count(F.lit(1)).alias("__n"))
    flagged = firsts.join(known, keys, "left").withColumn("__new", F.when(F.col("__known").isNull(), 1).otherwise(0))
    return flagged.rollup(source).agg(F.sum("__new").cast("long").alias("inserted"), F.sum(F.col("__n") - F.col("__new")).cast("long").alias("ignored"))


def busy(df: DataFrame, status: str, running: tuple[str, ...]) -> DataFrame:
    """Is any job running?"""
    return df.agg((F.count_if(F.col(status).isin(*running)) > 0).alias("busy"))


def total_size(df: DataFrame, c: str) -> DataFrame:
    """Nulls count as 0."""
    return df.agg(F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias("total"))


def task_board(tasks: DataFrame, kinds: list[str]) -> DataFrame:
    """Tasks (document_id, task_type, status, message, percent), one row per document with defaults for missing tasks."""
    wide = tasks.groupBy("document_id").pivot("task_type", kinds).agg(F.max("status").alias("status"), F.max("message").alias("message"), F.max("percent").alias("percent"))
    fill = {f"{k}_status": F.coalesce(f"{k}_status", F.lit("Not Started")) for k in kinds} | {f"{k}_message": F.coalesce(f"{k}_message", F.lit("")) for k in kinds} | {f"{k}_percent": F.coalesce(f"{k}_percent", F.lit(0)) for k in kinds}
    return wide.withColumns(fill)


def project_states(items: DataFrame, parent: str) -> DataFrame:
    """Status and percentage of each parent from its items."""
    counts = child_counts(items, parent)
    return counts.withColumn("x", project_status(F.col("total"), F.col("done"), F.col("in_progress"))).select(parent, "total", "done", "in_progress", "x.status", "x.percent")
