import math
import zlib
from collections import Counter

import pytest
import xxhash
from millrace.llm.sharding import assign_shards, shard_documents, topology


def test_law_sizes_and_slots(sample):
    rows = shard_documents(sample).collect()
    texts = {r.doc_id: r.text.encode() for r in sample.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]))
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_weights_confine_movement(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "k")
    tree = topology(24)
    heavier = [[list(k) for k in r] for r in tree]
    heavier[1][0][2] = (heavier[1][0][2][0], 3.0)
    both = assign_shards(assign_shards(keys, "k", tree, "a"), "k", heavier, "b").collect()
    moved = [(r.a, r.b) for r in both if r.a != r.b]
    assert moved and all(8 <= b < 16 for _, b in moved)  # only into the region whose weight changed
    inside = [(a, b) for a, b in moved if 8 <= a < 16]
    assert all(b in (8, 9, 10, 11) for _, b in inside)  # there only into the rack, and in the rack only to the shard
    assert all(b == 10 for a, b in inside if a in (8, 9, 10, 11))
    counts = Counter(r.b for r in both)
    assert math.isclose(counts[10] / 40_000, 3 / 26, rel_tol=0.1) and all(math.isclose(counts[s] / 40_000, 1 / 26, rel_tol=0.2) for s in range(24) if s != 10)
    empty = assign_shards(keys, "k", [[[(0, 1.0), (1, 0.0)]]], "s").select("s").distinct().collect()
    assert [r.s for r in empty] == [0]


def plain_shard(key, tree):
    """The draws one by one; Spark's xxhash64 of several columns takes each hash as the next one's seed."""

    def least(names, weights):
        draws = []
        for i, w in enumerate(weights):
            h = 42
            for x in [key, *names, i]:
                h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x.to_bytes(4, "little"), h)
            if w > 0:
                draws.append((-math.log(((h >> 11) + 0.5) / (1 << 53)) / w, i))
        return min(draws)[1]

    region = least(["region"], [sum(w for k in r for _, w in k) for r in tree])
    rack = least(["rack", region], [sum(w for _, w in k) for k in tree[region]])
    return tree[region][rack][least(["shard", region, rack], [w for _, w in tree[region][rack]])][0]


@pytest.mark.parametrize("weights", [None, {3: 2.5, 17: 0.25, 20: 0.0, 24: 3.0}])
def test_shards_equal_plain_draws(sample, weights):
    for r in shard_documents(sample, weights=weights).collect():
        assert (r.shard, r.grown_shard) == tuple(plain_shard(str(r.doc_id), topology(n, weights=weights)) for n in (24, 25))


def test_growth_moves_rows_only_into_new_shards(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "k")
    for founding, sizes in ((24, (24, 25, 26)), (5, (5, 6, 7, 8))):
        for n in sizes[:-1]:
            both = assign_shards(assign_shards(keys, "k", topology(n, founding), "a"), "k", topology(n + 1, founding), "b").where("a <> b").select("b").distinct().collect()
            assert [r.b for r in both] == [n]
    with pytest.raises(ValueError):
        topology(20)


def test_edges(edge, docs_of):
    rows = shard_documents(edge).collect()
    assert len(rows) == 8 and len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(8, 0)}
    assert shard_documents(docs_of([])).count() == 0
