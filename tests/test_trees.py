"""Trees against plain recursion: chains, stars, cycles, unknown parents."""

import random

import pytest
from millrace.operators import trees as TR
from pyspark.sql import functions as F

DEFS = "id int, parent_id string, code string, name string, is_leaf int"


def plain(parents, codes, own):
    """(sums, listing) as recursion gives them."""
    children = {}
    for i, p in parents.items():
        children.setdefault(p, []).append(i)
    sums, listing = dict(own), []
    stack = [(i, 0, False) for i in sorted(children.get(None, []), key=lambda x: (codes[x], x), reverse=True)]
    at = {}
    while stack:
        i, depth, seen = stack.pop()
        if seen:
            sums[i] = own.get(i, 0) + sum(sums.get(c, 0) for c in children.get(i, []))
            listing[at[i]] = (i, depth, i in children, at[i], len(listing) - at[i])
        else:
            at[i] = len(listing)
            listing.append(None)
            stack.append((i, depth, True))
            stack += [(c, depth + 1, False) for c in sorted(children.get(i, []), key=lambda x: (codes[x], x), reverse=True)]
    return sums, listing


def check(spark, parents, own):
    codes = {i: str(i % 7) for i in parents}
    defs = spark.createDataFrame([(i, None if p is None else str(p), codes[i], f"n{i}", 0) for i, p in parents.items()], DEFS)
    amounts = spark.createDataFrame([(i, 1, float(v)) for i, v in own.items()], "id int, period_id int, original_value double")
    sums, listing = plain(parents, codes, own)
    assert {r.id: r.amount for r in TR.rollup_tree(defs, amounts).collect()} == {i: float(sums.get(i, 0)) for i in parents}
    assert [tuple(r) for r in TR.preorder(defs).select("id", "depth", "has_children", "place", "size").collect()] == listing


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    draw = random.Random(seed)
    parents = {i: None if i < 4 or draw.random() < 0.02 else draw.randrange(1, i) for i in range(1, 300)}
    parents |= {400: 999, 401: 400, 402: 401}  # under an unknown parent
    parents |= {500: 502, 501: 500, 502: 501, 503: 500, 504: 504}  # on and under cycles
    check(spark, parents, {i: i * i % 17 for i in parents if i % 3})


def test_a_chain_takes_few_rounds(spark):
    """5,000 levels: 14 tables, and no row holds a path."""
    parents = {i: i - 1 if i > 1 else None for i in range(1, 5001)}
    defs = spark.createDataFrame([(i, None if p is None else str(p), str(i), "", 0) for i, p in parents.items()], DEFS)
    assert len(TR.pointers(defs)) <= 2 * 13
    amounts = spark.createDataFrame([(5000, 1, 1.0), (2500, 1, 2.0), (1, 1, 4.0)], "id int, period_id int, original_value double")
    got = {r.id: r.amount for r in TR.rollup_tree(defs, amounts).collect()}
    assert got == {i: (1.0 if i > 2500 else 3.0) + (4.0 if i == 1 else 0.0) for i in parents}


def test_a_star_and_an_empty_tree(spark):
    check(spark, {1: None} | {i: 1 for i in range(2, 400)}, {i: 1 for i in range(1, 400)})
    none = spark.createDataFrame([], DEFS)
    assert TR.preorder(none).count() == 0 and TR.rollup_tree(none, spark.createDataFrame([(1, 1, 1.0)], "id int, period_id int, original_value double")).count() == 0


def test_tables_as_long_as_the_tree_do_not_pass_the_driver(spark):
    defs = spark.range(1, 200).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") > 1, F.floor(F.col("id") / 2).cast("string")).alias("parent_id"), F.col("id").cast("string").alias("code"), F.lit("n").alias("name"), F.lit(0).alias("is_leaf"))
    plan = TR.preorder(defs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
