"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A row descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with
``u`` a hash of (key, child) in (0, 1); the smallest draw wins, so a child gets rows in proportion to its weight.
A child's draw depends on nothing but the key, its own name and its own weight: if weights change in one
subtree, only rows that enter or leave that subtree move, and a new child takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .numbering import gapless

#: A topology is a list of regions, a region a list of racks, a rack a list of (shard, weight).
Topology = list[list[list[tuple[int, float]]]]

FOUNDING_SHARDS, RACKS_PER_REGION, SHARDS_PER_RACK = 24, 2, 4
HASH_SPACE = float(1 << 53)


def topology(shards: int, founding: int = FOUNDING_SHARDS, weights: dict[int, float] | None = None) -> Topology:
    """Regions of two racks of four shards for the ``founding`` ones; each later shard opens a region of its own.

    So one more shard changes no weight of any other subtree: rows move only into it. ``weights``: of shards whose weight isn't 1.
    """
    if shards < founding:
        raise ValueError(f"{shards} shards are fewer than the {founding} that the tree was founded with; with a smaller tree rows would move between old shards")
    weight = lambda s: (s, float((weights or {}).get(s, 1.0)))
    racks = [[weight(s) for s in range(a, min(a + SHARDS_PER_RACK, founding))] for a in range(0, founding, SHARDS_PER_RACK)]
    regions = [racks[i : i + RACKS_PER_REGION] for i in range(0, len(racks), RACKS_PER_REGION)]
    return regions + [[[weight(s)]] for s in range(founding, shards)]


def draw(key: Column, names: list, weight: Column) -> Column:
    """Exponential draw of one child: smaller is likelier for a larger weight; null where the weight is not positive."""
    u = (F.shiftrightunsigned(F.xxhash64(key, *names), 11).cast("double") + 0.5) / HASH_SPACE
    return F.when(weight > 0, -F.log(u) / weight)


def nested(values: list) -> Column:
    return F.array(*[nested(x) if isinstance(x, list) else F.lit(float(x)) for x in values])


def assign_shards(df: DataFrame, key: str, regions: Topology, out: str = "shard") -> DataFrame:
    """Add ``out``: a weighted draw at each of the three levels; children of weight 0 get nothing.

    A null key is a key like any other; rows of equal keys share a shard. Of equal draws the earlier child's wins.
    """
    of = F.coalesce(F.col(key).cast("string"), F.lit(""))
    racks, shards = max(map(len, regions)), max(len(k) for r in regions for k in r)
    pad = lambda xs, n, x: [*xs, *[x] * (n - len(xs))]
    weight = [pad([pad([w for _, w in k], shards, 0) for k in r], racks, [0] * shards) for r in regions]
    number = [pad([pad([s for s, _ in k], shards, -1) for k in r], racks, [-1] * shards) for r in regions]

    def least(n: int, names: list, weight_of) -> Column:
        children = [F.struct(draw(of, [*names, F.lit(i)], weight_of(i)).alias("draw"), F.lit(i).alias("child")) for i in range(n)]
        return F.array_min(F.array(*[F.when(x["draw"].isNotNull(), x) for x in children]))["child"]

    at = lambda array, *path: at(F.get(array, path[0]), *path[1:]) if path else array
    region, rack = F.col("__region"), F.col("__rack")
    rack_weight = nested([[sum(k) for k in r] for r in weight])
    df = df.withColumn("__region", least(len(regions), [F.lit("region")], lambda i: F.lit(float(sum(map(sum, weight[i]))))))
    df = df.withColumn("__rack", least(racks, [F.lit("rack"), region], lambda i: at(rack_weight, region, F.lit(i))))
    df = df.withColumn("__shard", least(shards, [F.lit("shard"), region, rack], lambda i: at(nested(weight), region, rack, F.lit(i))))
    return df.withColumn(out, at(nested(number), region, rack, F.col("__shard")).cast("int")).drop("__region", "__rack", "__shard")


def shard_documents(docs: DataFrame, shards: int = FOUNDING_SHARDS, founding: int = FOUNDING_SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """Documents with their size, text checksum, shard, slot and the shard they get with one shard more.

    A null text has size 8 and the checksum of an empty text; repeated rows get slots of their own. Fewer shards than ``founding`` are an error.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign_shards(rows, "doc_id", topology(shards, founding, weights))
    rows = assign_shards(rows, "doc_id", topology(shards + 1, founding, weights), "grown_shard")
    numbered = gapless(rows, "shard", ["doc_id", "size", "text_crc32"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
