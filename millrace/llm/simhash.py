"""SimHash near-duplicates by covering locality-sensitive hashing.

Each fingerprint bit i carries a non-zero vector m(i) of r + 1 bits. For each of the 2^(r+1) - 1 non-zero vectors v there is a
table whose mask keeps the bits with odd <m(i), v>. Up to r differing bits span at most r dimensions, so some v is
orthogonal to all of them: in that table the two masked fingerprints are equal. No pair within the radius is missed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import field, map_arrow, materialise, table, text_bytes
from .components import components
from .similar import band_keys, minima, packed, similar_sets, sketch

BITS, SEED = 64, 42
WIDTH, RADIUS = 4, 4
#: Jaccard similarity of near-duplicates in the pipeline, over shingles of so many words.
SIMILARITY, DEDUP_WIDTH = 0.8, 5
#: Members of a bucket that one task compares with each other; larger buckets go by shared midpoints.
BUCKET = 16_384


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS) -> list[int]:
    top = (1 << (radius + 1)) - 1
    vector = [i % top + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, top + 1)]


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; none if there is no word."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    w = min(width, len(words))
    return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[: len(words) - w + 1].tolist(), ends[w - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Majority bits of the shingle hashes; 0 if there is no word."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""
    names = ["doc_id"]

    def run(batches):
        for batch in batches:
            fps = [signed(fingerprint(x, width)) for x in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(fps, pa.int64())], names=[*names, "fp"])

    schema = T.StructType([*[field(docs, c) for c in names], T.StructField("fp", T.LongType())])
    return map_arrow(docs.select(*names, "text"), run, schema)


def stars(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, least member of its group) for groups of values linked at ``radius`` or fewer bits."""
    left, out = np.unique(values).astype(np.int64).view(np.uint64), []
    while len(left):
        group, edge, left = [left[:1]], left[:1], left[1:]
        while len(edge) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(edge), 64):
                near |= (np.bitwise_count(edge[i : i + 64, None] ^ left[None, :]) <= radius).any(axis=0)
            edge, left = left[near], left[~near]
            group.append(edge)
        members = np.concatenate(group).view(np.int64)
        if len(members) > 1:
            root = int(members.min())
            out += [(int(x), root) for x in members if x != root]
    return out


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``radius`` bits, fewer than all pairs.

    ``fps``: distinct fp. Buckets of two are compared as they are. In larger ones a task finds the groups. Buckets beyond
    ``bucket`` members are spread out: two values within 4 bits share a value within 2 bits of each, at most 529 of a
    bucket's values meet in one such midpoint, and all that meet are within 4 bits.
    """
    spark, masks = fps.sparkSession, covering_masks(radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("x")).select("fp", "x.t", "x.key")
    sizes = materialise(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    two = sizes.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    crowded = sizes.where("n > 2").select("t", "key", "n")
    members = keyed.join(crowded, ["t", "key"])

    def run(batches):
        for batch in batches:
            found = [x for values in batch.column(0) for x in stars(np.array(values.values), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    small = map_arrow(members.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps"), run, "a long, b long")
    flips = [(t, signed(sum(1 << i for i in c))) for t, m in enumerate(masks) for free in [[i for i in range(BITS) if not m >> i & 1]] for k in range(radius // 2 + 1) for c in combinations(free, k)]
    flip = F.broadcast(spark.createDataFrame(flips, "t int, flip long"))  # a fixed table of some 16,000 rows
    near = members.where(F.col("n") > bucket).join(flip, "t").select("t", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    met = near.groupBy("t", "key", "mid").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    large = met.select(F.explode("fps").alias("a"), "b").where("a <> b")
    return two.union(small).union(large)


def groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root) of every distinct fingerprint."""
    rows = materialise(fingerprints(docs, width), "fingerprints")
    distinct = rows.select("fp").distinct()
    roots = components(links(distinct, radius))
    return rows, distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the least doc_id reachable over links of at most ``radius`` bits.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with a null id take part;
    a component of null ids alone has a null id. Repeated rows come back each.
    """
    rows, roots = groups(docs, width, radius)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = materialise(least.join(roots, "fp"), "classes")
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialise(classes.join(ids, "root").select(F.col("fp").alias("of"), "component_id"), "members")
    return rows.join(by_fp, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_groups(sets: DataFrame) -> DataFrame:
    """(node, group) of sets (node, fp): the component of the set's fingerprint over all links of at most RADIUS bits, as in ``groups``."""
    roots = components(links(sets.select("fp").distinct())).withColumnRenamed("node", "of")
    return sets.join(roots, F.col("fp") == F.col("of"), "left").select("node", F.coalesce("root", "fp").alias("group"))


def drop_near_duplicates(docs: DataFrame, width: int = DEDUP_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id, null ids last.

    Near-duplicates: sets of shingles of ``width`` words with a Jaccard similarity of ``similarity`` or more, verified on the
    sets (see ``similar``). Candidates are first those whose SimHash fingerprints are linked at RADIUS bits, none of which covering masks miss; pairs at the bar
    differ in more bits than that, and MinHash tables bring these together. The columns are those of ``docs``. Rows equal in all columns count as one; texts without a word are a group.
    """
    key = docs.withColumn("__row", F.xxhash64(*docs.columns))

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(x, width) for x in text_bytes(batch.column("text"))]
            fps = [signed(majority(h)) for h in hashes]
            sets = [np.unique(h) for h in hashes]
            least = [minima(s) if len(s) else None for s in sets]
            columns = [
                batch.column("doc_id"), batch.column("__row"), pa.array([signed(xxh64_intdigest(s.tobytes(), SEED)) if len(s) else 0 for s in sets], pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(fps, pa.int64()),
                pa.array([[] if x is None else band_keys(x).view(np.int64) for x in least], pa.list_(pa.int64())), pa.array([b"" if x is None else sketch(x) for x in least], pa.binary()), pa.array([packed(s) for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "__row", "node", "n", "fp", "keys", "sketch", "hashes"])

    schema = T.StructType([field(docs, "doc_id"), *T._parse_datatype_string("__row long, node long, n int, fp long, keys array<long>, sketch binary, hashes binary")])
    rows = materialise(map_arrow(key.select("doc_id", "__row", "text"), run, schema), "fingerprints")
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row"))
    near = materialise(simhash_groups(rows.where("n > 0").groupBy("node").agg(F.min("fp").alias("fp"))), "simhash")
    each = rows.groupBy("node").agg(F.min(best).alias("best"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    # the SimHash groups are the first table; a set without a word is in none
    keys = F.when(F.col("group").isNotNull(), F.concat(F.array(F.xxhash64(F.lit("simhash"), "group")), "keys")).otherwise(F.col("keys"))
    per_set = materialise(each.join(near, "node", "left").select("node", "best", "n", keys.alias("keys"), "sketch"), "classes")
    roots = similar_sets(per_set.select("node", "n", "keys", "sketch"), rows.select("node", "hashes"), similarity).withColumnRenamed("node", "of")
    rooted = per_set.join(roots, F.col("node") == F.col("of"), "left").select("best", F.coalesce("root", "node").alias("root"))
    kept = materialise(rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("__id"), F.col("best.row").alias("__of")), "kept")
    stay = key.join(kept, (F.col("__row") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return stay.dropDuplicates(["__row", "doc_id"]).select(*docs.columns)


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
