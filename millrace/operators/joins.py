"""Join operators of the relational views. Small sides are left to Spark to broadcast by their size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import full_name, label
from .position import first_by


def deal_list(headers: DataFrame, deals: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Deals with their header, customer and (where known) product, latest expected date first.

    Keys: deal_id, customer_id, product_id. Serves every kind of deal.
    """
    return deals.join(headers, "deal_id").join(customers, "customer_id").join(products, "product_id", "left").orderBy(F.col("expected").desc(), "deal_id", "line")


def deal_detail(headers: DataFrame, deals: DataFrame, customers: DataFrame, products: DataFrame, deal_id) -> DataFrame:
    """One deal; the key reaches both scans."""
    return deal_list(headers.where(F.col("deal_id") == deal_id), deals.where(F.col("deal_id") == deal_id), customers, products)


def with_user(docs: DataFrame, users: DataFrame, name: str, uploaded: str) -> DataFrame:
    """Documents with the user of the same natural name, newest first."""
    return docs.join(users, name, "left").orderBy(F.col(uploaded).desc())


def recent_history(hist: DataFrame, jobs: DataFrame, key: str, order: list[Column], n: int = 50) -> DataFrame:
    """The newest ``n`` entries with their job; the limit comes first, since the join drops nothing."""
    return hist.orderBy(*order).limit(n).join(jobs, key, "left")


def parent_names(items: DataFrame, projects: DataFrame, deals: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Items (parent_type, parent_id) with the parent's name.

    ``projects``: project_id, project; ``deals``: deal_id, customer. ``kinds``: deal-like parent type -> its label.
    A parent of another type, or an unknown one, has no name.
    """
    p = projects.select(F.col("project_id").alias("__p"), F.col("project").alias("__project"))
    d = deals.select(F.col("deal_id").alias("__d"), F.col("customer").alias("__customer"))
    joined = items.join(p, (F.col("parent_type") == "project") & (F.col("parent_id") == F.col("__p")), "left")
    joined = joined.join(d, F.col("parent_type").isin(*kinds) & (F.col("parent_id") == F.col("__d")), "left")
    name = F.when(F.col("parent_type") == "project", F.col("__project"))
    for kind, text in kinds.items():
        name = name.when(F.col("parent_type") == kind, label(F.col("__customer"), text, F.col("parent_id")))
    return joined.withColumn("parent_name", name).drop("__p", "__project", "__d", "__customer")


def latest_attribute(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The value of the latest row of each key; one pre-aggregated pass."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def any_attribute(df: DataFrame, key: str, value: str, tie: list[str]) -> DataFrame:
    """One value of each key, by a declared tie-break."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(*tie)).alias(value))


def latest_snapshot(df: DataFrame, c: str) -> DataFrame:
    """Rows of the latest snapshot; the one-row maximum is broadcast."""
    return df.join(F.broadcast(df.agg(F.max(c).alias("__last"))), F.col(c) == F.col("__last"), "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children without a parent; a null key is no orphan."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """J10."""
    return df.join(seen.select(key), key, "left_anti")


def decode(df: DataFrame, codes: DataFrame, c: str, defaults: dict[str, str]) -> DataFrame:
    """Codes (code, description, value1 ...) joined on ``c``; missing or blank texts take their default."""
    joined = df.join(codes.withColumnRenamed("code", "__code"), F.col(c) == F.col("__code"), "left").drop("__code")
    return joined.withColumns({k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(v)) for k, v in defaults.items()})


def owner_name(df: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The name from ``first`` (a_id, a_name), else name and surname from ``second`` (b_id, b_name, b_surname)."""
    joined = df.join(first, "a_id", "left").join(second, "b_id", "left")
    return joined.withColumn("owner", F.coalesce("a_name", full_name(F.col("b_name"), F.col("b_surname")))).drop("a_name", "b_name", "b_surname")


def blocked(items: DataFrame, prereqs: DataFrame) -> DataFrame:
    """Items (item_id, status) with an unfinished prerequisite (item_id, requires) among the items."""
    open_ = items.where(F.col("status") != "done").select(F.col("item_id").alias("requires"))
    return items.join(prereqs.join(open_, "requires", "left_semi"), "item_id", "left_semi")


def project_board(projects: DataFrame, objectives: DataFrame, items: DataFrame) -> DataFrame:
    """Projects with objective and item counts, from one pre-aggregate."""
    from .aggregates import child_counts

    joined = projects.join(objectives, "objective_id", "left").join(child_counts(items, "project_id"), "project_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "done", "in_progress")})


#: Queries that a vector meets in one row; a block of them is of bounded size.
QUERY_BLOCK = 64


def score_pairs(queries: DataFrame, vectors: DataFrame, score) -> DataFrame:
    """Each vector against a stated set of queries (query_id, query); ``score(query, embedding)`` is a Column.

    Queries are held in blocks of about QUERY_BLOCK; each vector meets each block once. Whether the blocks are broadcast is left to Spark and
    their size. A null vector or query scores as ``score`` has it.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    held = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("__block")).agg(F.collect_list(F.struct("query_id", "query")).alias("__queries"))
    each = vectors.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(held, "__block").select(*vectors.columns, F.explode("__queries").alias("__q"))
    return each.select(*vectors.columns, F.col("__q.query_id").alias("query_id"), score(F.col("__q.query"), F.col("embedding")).alias("score"))


#: Vectors and queries of a cell of ``cosine_pairs``, about, and pairs that a task scores at a time: it holds a cell's queries and a batch of vectors.
CELL_VECTORS, CELL_QUERIES, PIECE = 8192, 8192, 1_000_000


def matrix(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as rows of unit length, filled with zeros at the end; their lengths, -1 for a null and for one that holds a null). A vector without a length is zero."""
    lists = lists.combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    out = np.zeros((len(size), max(1, size.max(initial=0))))
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    place = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    out[row, place] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls as NaN
    size = np.where(np.isnan(out).any(axis=1), -1, size)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=(length > 0) & (size[:, None] >= 0)), size


def cells(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cells (i, j) of ``cosine_pairs``, one to a task: the cell's queries (side 0), then its vectors (side 1)."""
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows, columns = max(1, -(-vectors.count() // CELL_VECTORS)), max(1, -(-queries.count() // CELL_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(deal("id", rows).alias("i"), every(columns).alias("j"), F.lit(1).alias("side"), "id", "embedding")
    right = queries.select(every(rows).alias("i"), deal("query_id", columns).alias("j"), F.lit(0).alias("side"), "query_id", "query")
    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartitionById(rows * columns, F.col("i") * columns + F.col("j")).sortWithinPartitions("i", "j", "side")


def cosine_pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """J15 with F18 as the score: (id, query_id, score) of all pairs of vectors (id, embedding) and queries (query_id, query), by cells of both in numpy.

    The pairs grow with the product of both tables; what is shuffled for them is a row for each vector and block of queries, and for each query and block of vectors. A task holds
    the queries of its cell and goes through the vectors, a piece of pairs at a time. 0 where a vector is zero or null, null where lengths differ.
    """

    def score(a: pa.RecordBatch, ids: pa.Array, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        x, m = matrix(pa.chunked_array([a.column("embedding")]))
        wide = max(x.shape[1], y.shape[1])
        x, y = (np.pad(z, ((0, 0), (0, wide - z.shape[1]))) for z in (x, y))
        bare = ((x == 0).all(axis=1)[:, None] | (y == 0).all(axis=1)[None, :]).ravel()
        at = np.arange(len(m) * len(n))
        scores = pa.array((x @ y.T).ravel(), mask=(m[:, None] != n[None, :]).ravel() & ~bare)
        return pa.RecordBatch.from_arrays([a.column("id").take(pa.array(at // len(n))), ids.take(pa.array(at % len(n))), scores], names=["id", "query_id", "score"])

    def run(batches):
        now, held, ready = None, [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("i", "j", "side")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                *cell, side = place[:, a].tolist()
                if cell != now:
                    now, held, ready = cell, [], None
                if side == 0:
                    held.append(batch.slice(a, b - a))
                elif held:
                    if ready is None:
                        asked = pa.Table.from_batches(held)
                        ready = (asked.column("query_id").combine_chunks(), *matrix(asked.column("query")))
                    step = max(1, PIECE // len(ready[0]))
                    for k in range(a, b, step):
                        yield score(batch.slice(k, min(step, b - k)), *ready)

    kinds = dict(vectors.dtypes) | dict(queries.dtypes)
    return cells(queries, vectors).mapInArrow(run, f"id {kinds['id']}, query_id {kinds['query_id']}, score double")


def lookup_with_flag(src: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Source rows with blanks for null texts and a 1/0 flag of whether the key is known locally."""
    flags = first_by(local.select(key), key, [key]).withColumn("known", F.lit(1))
    texts = {c: F.coalesce(c, F.lit("")) for c, t in src.dtypes if t == "string"}
    return src.join(flags, key, "left").withColumns({**texts, "known": F.coalesce("known", F.lit(0))})
