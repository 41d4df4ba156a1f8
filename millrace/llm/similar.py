"""Links between all documents whose shingle sets reach a Jaccard similarity, each one verified on the sets themselves.

A set's minima under HASHES hash functions, ROWS at a time, are its keys in BANDS tables: by the model a pair exactly at 0.8 meets in none of them in
one case of twenty million. Ahead of them stands a table of SimHash groups (``simhash.simhash_groups``), with a key more. A sketch (a byte of each minimum) tells which pairs that meet can't reach the bar: it passes over a pair
only if it is DEVIATIONS standard errors below, by the model one pair in two million at 0.8. All others count, in three steps that each make at most a row for each member of a bucket:

1. Members of a bucket are linked to the first one they may be similar to; these pairs are verified, and give groups.
2. Members that may be similar to one of another group are passed on with their sets, in the first bucket where the two meet. Which that is
   their keys in the tables before tell.
3. There every such pair that links made so far don't join is verified.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialise
from .components import components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
DEVIATIONS = 5
#: Members of a bucket that meet in one task; larger buckets are cut in blocks, and each pair of blocks meets.
BUCKET = 16_384
#: Bytes of a shingle's hash in the sets that are kept and sent for verification.
SET_BYTES = 5

_DRAW = np.random.default_rng(42)
FLIP, ODD = _DRAW.integers(0, 1 << 64, HASHES, np.uint64), _DRAW.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
FACTOR, TABLE = _DRAW.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1), _DRAW.integers(0, 1 << 64, BANDS, np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """Least value of a set of hashes under each of the hash functions."""
    return np.concatenate([((s[None, :] ^ FLIP[a : a + 16, None]) * ODD[a : a + 16, None]).min(axis=1) for a in range(0, HASHES, 16)])


def band_keys(least: np.ndarray) -> np.ndarray:
    x = (least.reshape(BANDS, ROWS) * FACTOR).sum(axis=1, dtype=np.uint64) ^ TABLE
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


def sketch(least: np.ndarray) -> bytes:
    return (least & np.uint64(255)).astype(np.uint8).tobytes()


def packed(s: np.ndarray) -> bytes:
    """A set's hashes as SET_BYTES bytes each, ascending. Two of n shingles share such a hash once in 2^41 / n^2 documents."""
    low = np.unique(s & np.uint64((1 << 8 * SET_BYTES) - 1)).astype("<u8")
    return low.view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def unpacked(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(x, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8").ravel()


def least_matches(similarity: float) -> int:
    """Equal bytes of two sketches below which the pair counts as less similar."""
    return int(HASHES * similarity - DEVIATIONS * np.sqrt(HASHES * similarity * (1 - similarity)))


def reach(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two ascending sets is ``similarity`` or more."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = int((y[place] == x).sum())
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


class Bucket:
    """Members of a bucket: node, n (size of the set), sketch, past (their keys in the tables before) and, where asked for, root."""

    def __init__(self, table: pa.Table, similarity: float):
        self.table, self.similarity, self.least = table, similarity, least_matches(similarity)
        self.node, self.n = table.column("node").to_numpy(), table.column("n").to_numpy()
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
        self.past = table.column("past").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)

    def may(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that i may be similar to."""
        n, m = self.n[others], self.n[i]
        others = others[np.minimum(n, m) >= self.similarity * np.maximum(n, m) - 1e-9]
        return others[(self.sketch[others] == self.sketch[i]).sum(axis=1) >= self.least]

    def leaders(self) -> list[tuple[int, int]]:
        """(member, first member that it may be similar to and that isn't itself such a member)."""
        out, left = [], np.argsort(self.node)
        while len(left) > 1:
            first, left = left[0], left[1:]
            near = self.may(first, left)
            out += [(a, int(self.node[first])) for a in self.node[near].tolist()]
            left = left[~np.isin(left, near)] if len(near) else left
        return out

    def open_pairs(self, joined: Callable[[int], np.ndarray] | None = None):
        """(i, others) that may be similar, are in different groups and meet first in this table."""
        root = self.table.column("root").to_numpy()
        if (root == root[0]).all():
            return
        for i in range(len(root) - 1):
            near = self.may(i, i + 1 + np.flatnonzero(root[i + 1 :] != root[i]))
            near = near[~(self.past[near] == self.past[i]).any(axis=1)]
            if len(near):
                yield i, near

    def unsettled(self) -> pa.Table:
        """Members of open pairs."""
        some = np.zeros(len(self.node), bool)
        for i, near in self.open_pairs():
            some[i], some[near] = True, True
        return self.table.filter(pa.array(some))

    def verified(self) -> list[tuple[int, int]]:
        """Links among the members of open pairs; pairs that links found before them join are passed over."""
        sets = [unpacked(x) for x in self.table.column("hashes").to_pylist()]
        of = {r: r for r in self.table.column("root").to_pylist()}
        root, out = self.table.column("root").to_pylist(), []

        def find(x: int) -> int:
            while of[x] != x:
                of[x] = of[of[x]]
                x = of[x]
            return x

        for i, near in self.open_pairs():
            for j in near.tolist():
                a, b = find(root[i]), find(root[j])
                if a != b and reach(sets[i], sets[j], self.similarity):
                    of[max(a, b)] = min(a, b)
                    out.append((int(self.node[i]), int(self.node[j])))
        return out


def by_bucket(members: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of all rows of each (key, i, j), which come to one task one bucket after another."""
    at = ["key", "i", "j"]

    def run(batches):
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in at])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (mine := tuple(place[:, a].tolist())) != now:
                    if held:
                        yield from f(pa.Table.from_batches(held)).to_batches()
                    held, now = [], mine
                held.append(batch.slice(a, b - a))
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return map_arrow(members.repartition(*at).sortWithinPartitions(*at), run, schema)


def pair_table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({c: pa.array([p[k] for p in pairs], pa.int64()) for k, c in enumerate("ab")})


def similar_sets(nodes: DataFrame, sets: DataFrame, similarity: float, bucket: int = BUCKET) -> DataFrame:
    """(node, root) of the groups of sets linked by a similarity of ``similarity`` or more.

    ``nodes``: distinct node (long) with n, keys (array of its keys in all tables: of its SimHash group, then its band keys) and sketch; ``sets``: node and hashes (``packed``) of at least these,
    a written table that is deleted once those of crowded buckets are copied.
    """
    keyed = nodes.select("node", F.posexplode("keys").alias("t", "key"))
    sizes = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "buckets")
    blocks = F.ceil(F.col("many") / F.lit(bucket)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    # only members of a bucket of several get their sketch and keys sent along
    dealt = keyed.join(sizes, "key").select("key", "t", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    whole = dealt.join(nodes, "node").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "t", "node", "n", "sketch", F.slice("keys", F.lit(1), F.col("t")).alias("past"))
    members = materialise(whole, "members")
    crowded = materialise(sets.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")
    discard(sets)
    discard(sizes)

    first = materialise(by_bucket(members, lambda x: pair_table(Bucket(x, similarity).leaders()), "a long, b long").distinct(), "pairs")
    left, right = (crowded.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")

    def check(batches):
        for batch in batches:
            of_a, of_b = ([unpacked(x) for x in batch.column(k).to_pylist()] for k in (2, 3))
            keep = pa.array([reach(x, y, similarity) for x, y in zip(of_a, of_b, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    sure = materialise(map_arrow(first.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b"), check, "a long, b long"), "sure")
    discard(first)
    groups = components(sure).withColumnRenamed("node", "of")
    rooted = members.join(groups, F.col("node") == F.col("of"), "left").select(*members.columns, F.coalesce("root", "node").alias("root"))
    schema = "key long, i int, j int, t int, node long, n int, sketch binary, past array<long>, root long"
    unsettled = materialise(by_bucket(rooted, lambda x: Bucket(x, similarity).unsettled(), schema), "unsettled")
    more = by_bucket(unsettled.join(crowded, "node"), lambda x: pair_table(Bucket(x, similarity).verified()), "a long, b long")
    return components(sure.union(more))
