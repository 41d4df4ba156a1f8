"""Trees by parent id: rollups and listings by pointer doubling.

A node first points at its parent, in the next round at that node's parent, then four levels up, and so on: the rounds, each a join and a written table, grow with the
logarithm of the depth, and no path is ever built. Sums over subtrees follow the same pointers: what a node has gathered from fewer than 2^k levels below
goes to the node 2^k levels up. Sums over the siblings ahead, added up along the way to the root, are the places of a listing, so a subtree is an
interval of places.

Joins of tables as long as the tree are asked to merge: Spark would send such a table through the driver while its file is small, and there is one a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_parent
from .durable import durable


def with_parents(defs: DataFrame) -> DataFrame:
    """defs (id, parent_id as text, code, name, is_leaf) with integer parents; an unknown parent leaves the node without one."""
    clean = defs.withColumn("parent_id", clean_parent(F.col("parent_id")))
    known = defs.select(F.col("id").cast("int").alias("__k"), F.lit(True).alias("__known")).distinct()
    return clean.join(known.hint("merge"), F.col("parent_id") == F.col("__k"), "left").withColumn("has_parent", F.coalesce("__known", F.lit(False))).drop("__k", "__known")


def pointers(defs: DataFrame) -> list[DataFrame]:
    """Tables (id, up, hops, done), one a round: ``up`` is the ancestor 2^k levels up, or, where ``done``, the last one that there is, ``hops`` levels up.

    In the last table all are done but nodes on or under a cycle, which a number of rounds beyond the logarithm of the number of nodes tells.
    """
    nodes = with_parents(defs).select("id", "has_parent", "parent_id")
    up, hops = F.when(F.col("has_parent"), F.col("parent_id")).otherwise(F.col("id")), F.col("has_parent").cast("int")
    out = [durable(nodes.select("id", up.alias("up"), hops.alias("hops"), (~F.col("has_parent")).alias("done")), "pointers")]
    open_ = out[0].agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("done")).alias("open")).first()
    most, left = int(open_.n or 0).bit_length() + 1, open_.open
    while left and len(out) <= most:
        now = out[-1]
        onward = now.select(F.col("id").alias("__of"), F.col("up").alias("__up"), F.col("hops").alias("__hops"), F.col("done").alias("__done"))
        moved = now.where(~F.col("done")).join(onward.hint("merge"), F.col("up") == F.col("__of")).select("id", F.col("__up").alias("up"), (F.col("hops") + F.col("__hops")).alias("hops"), F.col("__done").alias("done"))
        out.append(durable(now.where("done").union(moved), "pointers"))
        left = out[-1].where(~F.col("done")).count()
    return out


def rooted(defs: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(id, depth) of the nodes whose last ancestor is a root: it has no parent, not an unknown one."""
    roots = with_parents(defs).where(F.col("parent_id").isNull()).select(F.col("id").alias("__root"))
    return rounds[-1].where("done").join(roots.hint("merge"), F.col("up") == F.col("__root"), "left_semi").select("id", F.col("hops").alias("depth"))


def subtree_sums(own: DataFrame, rounds: list[DataFrame], by: list[str], value: str) -> DataFrame:
    """(id, *by, value): own values (one row for each id and ``by``) summed over each node and all its descendants."""
    now = own
    for k, jump in enumerate(rounds):
        whole = jump.where(F.col("hops") == 2**k).select("id", "up")
        passed = now.join(whole.hint("merge"), "id").select(F.col("up").alias("id"), *by, value)
        now = durable(now.unionByName(passed).groupBy("id", *by).agg(F.sum(value).alias(value)), "sums")
    return now


def rollup_tree(defs: DataFrame, amounts: DataFrame) -> DataFrame:
    """Amounts (id, period_id, original_value) summed over each node and all its descendants: id, period_id, amount.

    Nodes have a row for every period of the amounts, 0 if nothing is booked. A node that no root leads to (an unknown parent, or a cycle, on the way) keeps its own amounts.
    Ids are unique; amounts of unknown ids count nowhere.
    """
    own = amounts.groupBy("id", "period_id").agg(F.sum(F.coalesce("original_value", F.lit(0.0))).alias("amount"))
    rounds = pointers(defs)
    inside = rooted(defs, rounds).select("id")
    own = durable(own.join(defs.select("id").hint("merge"), "id", "left_semi"), "own")
    sums = subtree_sums(own.join(inside.hint("merge"), "id", "left_semi"), rounds, ["period_id"], "amount").unionByName(own.join(inside.hint("merge"), "id", "left_anti"))
    periods = amounts.agg(F.array_sort(F.collect_set("period_id")).alias("periods"))  # one row
    grid = defs.select("id").join(F.broadcast(periods)).select("id", F.explode("periods").alias("period_id"))  # every node reports every period
    return grid.join(sums.hint("merge"), ["id", "period_id"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows ahead in ``order``, by ranges, so that no task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__part").agg(F.sum(value).alias("__sum")).select(F.col("__part").alias("__at"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))  # a row a range
    ahead = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__ahead", ahead).join(F.broadcast(starts), F.col("__part") == F.col("__at")).withColumn(out, F.col("__start") + F.col("__ahead")).drop("__part", "__at", "__start", "__ahead")


def intervals(defs: DataFrame) -> DataFrame:
    """(id, depth, place, size) of the nodes under a root: places from 0, parents before children, siblings by text code, then id; a subtree is ``size`` places from ``place`` on."""
    rounds = pointers(defs)
    inside = durable(rooted(defs, rounds), "inside")
    sizes = subtree_sums(inside.select("id", F.lit(1).cast("long").alias("size")), rounds, [], "size")
    known = with_parents(defs).select("id", F.when(F.col("has_parent"), F.col("parent_id")).alias("of"), F.col("code").cast("string").alias("__code"))
    # the sizes of the siblings ahead: those of all nodes ahead by (parent, code, id), less those ahead of the parent's first child
    ahead = running_total(sizes.join(known.hint("merge"), "id"), [F.col("of"), F.col("__code"), F.col("id")], "size", "ahead")
    first = ahead.groupBy(F.col("of").alias("__of")).agg(F.min("ahead").alias("__first"))
    step = F.col("ahead") - F.col("__first") + F.when(F.col("of").isNull(), 0).otherwise(1)
    steps = durable(ahead.join(first.hint("merge"), F.col("of").eqNullSafe(F.col("__of"))).select("id", "size", step.alias("step")), "steps")
    way = steps.join(rounds[0].select("id", "hops").hint("merge"), "id").select("id", (F.col("step") * F.col("hops")).alias("way"))  # along a pointer, without its end
    for jump in rounds[:-1]:
        there = way.select(F.col("id").alias("__id"), F.col("way").alias("__way"))
        on = jump.where(~F.col("done")).select("id", F.col("up").alias("__up"))
        way = durable(way.join(on.hint("merge"), "id", "left").join(there.hint("merge"), F.col("__up") == F.col("__id"), "left").select("id", (F.col("way") + F.coalesce("__way", F.lit(0))).alias("way")), "ways")
    ends = rounds[-1].select("id", F.col("up").alias("__root")).join(steps.select(F.col("id").alias("__root"), F.col("step").alias("__step")).hint("merge"), "__root")
    return inside.join(way.hint("merge"), "id").join(ends.hint("merge"), "id").join(steps.select("id", "size").hint("merge"), "id").select("id", "depth", (F.col("way") + F.col("__step")).alias("place"), "size")


def preorder(defs: DataFrame) -> DataFrame:
    """Nodes under a root with depth, children flag, place and size of the subtree, parents before children, siblings by text code."""
    parents = with_parents(defs).where("has_parent").select(F.col("parent_id").alias("id")).distinct().withColumn("has_children", F.lit(True))
    listed = intervals(defs).join(defs.select("id", "code", "name").hint("merge"), "id").join(parents.hint("merge"), "id", "left")
    return listed.select("id", "code", "name", "depth", F.coalesce("has_children", F.lit(False)).alias("has_children"), "place", "size").orderBy("place")


def asset_series(rolled: DataFrame, defs: DataFrame) -> DataFrame:
    """Per period codes 1 and 2 together; if neither exists, the leaves whose code starts with 1 or 2."""
    code = F.col("code").cast("string")
    flags = defs.select("id", code.isin("1", "2").alias("top"), ((F.col("is_leaf") == 1) & (code.startswith("1") | code.startswith("2"))).alias("leaf"))
    any_top = defs.agg(F.coalesce(F.max(code.isin("1", "2")), F.lit(False)).alias("any_top"))
    joined = rolled.join(flags, "id").join(F.broadcast(any_top))
    return joined.groupBy("period_id").agg(F.sum(F.when(F.col("any_top"), F.when(F.col("top"), F.col("amount"))).when(F.col("leaf"), F.col("amount")).otherwise(0.0)).alias("assets")).withColumn("assets", F.coalesce("assets", F.lit(0.0)))
