"""Change application: a table and a set of changes give the next version of the table.

Change sets are whole tables, so each operator is one join on the key, whatever the number of changes. A change set must hold
each key once; ``insert_ignore`` and ``add_links`` take care of repeats themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import split_owner
from .aggregates import kr_from_products, kr_from_projects, project_states
from .durable import durable
from .joins import any_attribute, latest_snapshot, orphans
from .position import latest_per


def prefixed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in df.columns if c not in keys], F.lit(True).alias("__hit"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], cols: list[str], set_flags: dict[str, object] | None = None) -> DataFrame:
    """The listed columns of matched rows are overwritten (a null too), flags set; new keys come in; other columns stay."""
    flags = set_flags or {}
    joined = target.withColumn("__old", F.lit(True)).join(prefixed(source.select(*keys, *cols), keys), keys, "full")
    new = {c: F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c)) for c in cols} | {c: F.when(F.col("__hit"), F.lit(v)).otherwise(F.col(c)) for c, v in flags.items()}
    return joined.withColumns(new).select(*target.columns)


def upsert_long(target: DataFrame, wide: DataFrame, key: str, mapping: dict[str, str]) -> DataFrame:
    """Wide edits (key, a column for each language) into long rows (key, lang, text); blank ids are skipped."""
    rows = wide.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "").unpivot(key, list(mapping), "lang", "text")
    rows = rows.replace(mapping, subset=["lang"])
    return upsert(target, rows, [key, "lang"], ["text"])


def insert_ignore(ledger: DataFrame, batch: DataFrame, keys: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """First write wins, in the ledger and within the batch; (ledger after, rows inserted)."""
    inserted = latest_per(batch, keys, order).join(ledger.select(*keys), keys, "left_anti").select(*ledger.columns)
    return ledger.unionByName(inserted), inserted


def update_matched(target: DataFrame, source: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """C4: columns of matched rows from the source; no row comes or goes."""
    joined = target.join(prefixed(source.select(*keys, *cols), keys), keys, "left")
    return joined.withColumns({c: F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c)) for c in cols}).select(*target.columns)


def patch(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial updates; a null in the changes was not supplied."""
    cols = [c for c in changes.columns if c != key]
    joined = target.join(prefixed(changes, [key]), key, "left")
    return joined.withColumns({c: F.coalesce(f"__n_{c}", c) for c in cols}).select(*target.columns)


def set_flag(target: DataFrame, ids: DataFrame, key: str, flag: str, value: int) -> DataFrame:
    """Set or clear a flag for a set of keys."""
    return update_matched(target, ids.select(key).distinct().withColumn(flag, F.lit(value)), [key], [flag])


def soft_delete(target: DataFrame, ids: DataFrame, key: str, flag: str = "is_active") -> DataFrame:
    """C6."""
    return set_flag(target, ids, key, flag, 0)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Rows of every table (frame, key column) whose key is among the first column of ``ids`` go."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone"))
    return {n: df.join(gone, F.col(key) == F.col("__gone"), "left_anti") for n, (df, key) in tables.items()}


def replace_group(target: DataFrame, batch: DataFrame, group: str) -> DataFrame:
    """The batch's groups are replaced as a whole."""
    return target.join(batch.select(group).distinct(), group, "left_anti").unionByName(batch)


def upsert_task(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Task states (document_id, task_type, status, message, percent, updated_at, start_time).

    A batch row starts the clock anew only at 0 percent; a task not known before starts with its row.
    """
    keys, cols = ["document_id", "task_type"], ["status", "message", "percent", "updated_at"]
    joined = state.withColumn("__old", F.lit(True)).join(prefixed(batch.select(*keys, *cols), keys), keys, "full")
    anew = F.col("__hit") & ((F.col("__n_percent") == 0) | F.col("__old").isNull())
    new = {c: F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c)) for c in cols}
    return joined.withColumns({**new, "start_time": F.when(anew, F.col("__n_updated_at")).otherwise(F.col("start_time"))}).select(*state.columns)


def remap(df: DataFrame, c: str, mapping: dict[str, str]) -> DataFrame:
    """C10."""
    chain = reduce(lambda w, kv: w.when(F.col(c) == kv[0], kv[1]), list(mapping.items())[1:], F.when(F.col(c) == next(iter(mapping)), next(iter(mapping.values()))))
    return df.withColumn(c, chain.otherwise(F.col(c)))


def deactivate_orphans(items: DataFrame, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """C11: items (item_id, parent_type, parent_id, is_active) of each parent type whose parent is gone become inactive."""
    lost = reduce(DataFrame.unionByName, [orphans(items.where(F.col("parent_type") == kind), df, "parent_id", key).select("item_id") for kind, (df, key) in parents.items()])
    return soft_delete(items, lost, "item_id")


def retain(df: DataFrame, ts: str, asof: str, days: int = 90) -> DataFrame:
    """Rows younger than ``days`` at ``asof``; null times go."""
    return df.where(F.col(ts) >= F.to_timestamp_ntz(F.lit(asof)) - F.expr(f"INTERVAL {days} DAYS"))


def assign_ids(df: DataFrame, start: int, order: list, out: str = "id", parts: int | None = None) -> DataFrame:
    """Ids from ``start`` in the order of the natural key, by ranges: only the ranges' counts meet in one place.

    The ranged rows are written out first, since ranges drawn from a sample could differ from one reading to the next.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("__part").orderBy(*order)
    numbered = ranged.withColumn("__rn", F.row_number().over(within)).join(F.broadcast(starts), "__part")
    return numbered.withColumn(out, (F.col("__before") + F.col("__rn") + F.lit(start - 1)).cast("long")).drop("__part", "__rn", "__before")


def replace_owners(links: DataFrame, item_ids: DataFrame, codes: DataFrame) -> DataFrame:
    """C14: links (item_id, kind, owner_id, is_active): those of the items become inactive, the codes (item_id, code) new ones.

    Codes that are neither ``U-n`` nor ``S-n`` are dropped.
    """
    new = codes.withColumn("x", split_owner(F.col("code"))).where(F.col("x").isNotNull()).select("item_id", "x.kind", F.col("x.id").alias("owner_id"), F.lit(1).alias("is_active"))
    return soft_delete(links, item_ids, "item_id").unionByName(new)


def add_links(links: DataFrame, batch: DataFrame) -> DataFrame:
    """Links (item_id, requires, is_active): a pair that is active already is not added again."""
    known = links.where(F.col("is_active") == 1).select("item_id", "requires")
    return links.unionByName(batch.select("item_id", "requires").distinct().join(known, ["item_id", "requires"], "left_anti").withColumn("is_active", F.lit(1)))


def sync_status(projects: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Projects (project_id, status, updated_at) get the status that their items (project_id, status) give; without items it is not started."""
    states = project_states(items, "project_id").select("project_id", F.col("status").alias("__status"))
    joined = projects.join(states, "project_id", "left")
    return joined.withColumns({"status": F.coalesce("__status", F.lit("Not Started")), "updated_at": now}).select(*projects.columns)


def recalculate(krs: DataFrame, deals: DataFrame, items: DataFrame) -> DataFrame:
    """C17: krs (kr_id, measurement, product, statuses, project_id, target, achieved): automatic ones get their new value."""
    by_product = kr_from_products(krs.where((F.col("measurement") == "product") & (F.coalesce("product", F.lit("")) != "")), deals)
    by_project = kr_from_projects(krs.where((F.col("measurement") == "project") & F.col("project_id").isNotNull()), items)
    new = by_product.unionByName(by_project).withColumnRenamed("value", "achieved")
    return update_matched(krs, new, ["kr_id"], ["achieved"])


def abort(df: DataFrame, status_from: tuple[str, ...], status_to: str, note: str) -> DataFrame:
    """Stale tasks (status, message)."""
    stale = F.col("status").isin(*status_from)
    return df.withColumns({"message": F.when(stale, note).otherwise(F.col("message")), "status": F.when(stale, status_to).otherwise(F.col("status"))})


def sync_customers(local: DataFrame, source: DataFrame, limits: DataFrame, sectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Customers (customer_id, name, credit_limit, sector) brought up to date from a source (customer_id, name).

    limits (customer_id, as_of, amount) count at their latest snapshot, summed and rounded. With a ``line`` amounts are added as doubles from the least line on, as SQL adds rows read in their order;
    without one exactly to six decimals, as the order of additions would decide the rounding of some halves. One sector (customer_id, sector, line) is taken at the least line. Only the given ids change.
    """
    wanted = source.join(ids.select("customer_id").distinct(), "customer_id", "left_semi")
    latest = latest_snapshot(limits, "as_of")
    if "line" in limits.columns:
        so_far = Window.partitionBy("customer_id").orderBy("line", "amount").rowsBetween(Window.unboundedPreceding, 0)
        total = latest.withColumn("__sum", F.sum("amount").over(so_far)).groupBy("customer_id").agg(F.max_by("__sum", F.struct("line", "amount")).alias("__sum"))
    else:
        total = latest.groupBy("customer_id").agg(F.sum(F.col("amount").cast("decimal(28,6)")).alias("__sum"))
    now = total.select("customer_id", F.round("__sum").cast("long").alias("credit_limit"))
    one = any_attribute(sectors, "customer_id", "sector", ["line"])
    new = wanted.join(now, "customer_id", "left").join(one, "customer_id", "left")
    return update_matched(local, new, ["customer_id"], ["name", "credit_limit", "sector"])
