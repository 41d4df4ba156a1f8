import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from millrace.llm.similar import BANDS, HASHES, Bucket
from millrace.llm.simhash import covering_masks, drop_near_duplicates, fingerprint, links, near_duplicates, signed


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(values, pairs):
    of = {v: v for v in values}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def test_masks_cover_every_pair():
    masks, rng = covering_masks(4), random.Random(1)
    assert len(masks) == 31
    for bits in itertools.chain(itertools.combinations(range(64), 2), (rng.sample(range(64), 4) for _ in range(20_000))):
        diff = sum(1 << b for b in bits)
        assert any(not m & diff for m in masks)


def test_equals_brute_force(sample):
    rows = near_duplicates(sample).collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in sample.collect()}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{f:016x}" for d, f in fps.items()}
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert {r.doc_id: r.component_id for r in rows} == roots(fps, near)


def test_crowded_buckets_link_the_same(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(50)}
    for centre in list(values)[:3]:
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3) for _ in range(30)}
    values = sorted(map(signed, values))
    near = [(a, b) for a, b in itertools.combinations(values, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for bucket in (16_384, 3):
        got = [(r.a, r.b) for r in links(fps, bucket=bucket).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 or bucket > 3 for a, b in got)
        assert roots(values, got) == roots(values, near)


def test_dedup_keeps_one(docs_of):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(9, base), (4, base), (4, base), (7, base + " extra"), (1, "something else entirely in this one"), (None, base), (None, None), (3, "")]
    kept = drop_near_duplicates(docs_of(rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4]


def test_dedup_follows_similarity(docs_of):
    rng = random.Random(11)
    rows, groups = [], []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(400)]
        changed = list(words)
        for at in rng.sample(range(400), (g % 4) * 4):  # 0, 4, 8 or 12 of 400 words changed: similarity 1, 0.9, 0.82, 0.74
            changed[at] = f"x{at}"
        rows += [(g * 2, " ".join(words)), (g * 2 + 1, " ".join(changed).upper())]
        groups.append(g % 4)
    kept = {r.doc_id for r in drop_near_duplicates(docs_of(rows)).collect()}
    assert kept == exact_groups({i: t.lower() for i, t in rows})
    assert all(g * 2 in kept for g in range(60)) and not any(g * 2 + 1 in kept for g in range(60) if groups[g] < 2)


def test_edges(edge, docs_of):
    rows = near_duplicates(edge).collect()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert len(rows) == 8 and by[(2, "0" * 16)] == by[(5, "0" * 16)] == 1
    assert {c for (d, _), c in by.items() if d in (3, 4)} == {3}
    assert near_duplicates(docs_of([])).count() == 0 and drop_near_duplicates(docs_of([])).count() == 0


def exact_groups(texts, bar=0.8):
    """Least id of each group of texts linked by the Jaccard similarity of their 5-word shingles."""
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.split()]}
    near = [(a, b) for a, b in itertools.combinations(texts, 2) if len(grams[a] & grams[b]) >= bar * len(grams[a] | grams[b])]
    return set(roots(texts, near).values())


def test_dedup_finds_all_at_the_bar(docs_of):
    rng, texts = random.Random(12), {}
    for g in range(300):
        words = [f"g{g}w{i}" for i in range(400)]
        changed = list(words)
        for k in range(8 + g % 2):  # 8 or 9 of 400 words changed, apart from each other: similarity 0.817 or 0.796
            changed[k * 44 + rng.randint(5, 38)] = "x"
        texts |= {2 * g: " ".join(words), 2 * g + 1: " ".join(changed)}
    kept = {r.doc_id for r in drop_near_duplicates(docs_of(list(texts.items()))).collect()}
    assert kept == exact_groups(texts) and len(kept) == 450


def test_dedup_looks_behind_close_siblings(docs_of, monkeypatch):
    """Families that share most of a template: copies near the bar have many siblings that are as close but below it."""
    rng = random.Random(13)
    for bucket in (None, 7):
        texts, template = {}, [f"t{i}" for i in range(300)]
        for i in range(120):
            words = list(template)
            for at in rng.sample(range(300), rng.randint(2, 14)):
                words[at] = f"d{i}"
            texts[i] = " ".join(words)
        if bucket:
            monkeypatch.setattr("millrace.llm.similar.similar_sets.__defaults__", (bucket,))
        assert {r.doc_id for r in drop_near_duplicates(docs_of(list(texts.items()))).collect()} == exact_groups(texts)


def test_equal_sketches_are_no_earlier_meeting():
    """Two members meet in table 3. Only equal keys tell that they met before: low bytes of other minima may be equal, too."""
    sketch = bytes(range(HASHES))
    past = {"never": ([1, 2, 3], [4, 5, 6]), "before": ([1, 2, 3], [4, 2, 6])}
    for case, keys in past.items():
        rows = {"node": [7, 9], "n": pa.array([10, 10], pa.int32()), "sketch": [sketch, sketch], "past": pa.array(keys, pa.list_(pa.int64())), "root": [7, 9], "t": pa.array([3, 3], pa.int32())}
        bucket = Bucket(pa.table(rows), 0.8)
        assert [(i, near.tolist()) for i, near in bucket.open_pairs()] == ([(0, [1])] if case == "never" else [])
        assert bucket.unsettled().num_rows == (2 if case == "never" else 0)


def test_members_of_the_first_table_have_no_past():
    rows = {"node": [7, 9], "n": pa.array([10, 10], pa.int32()), "sketch": [bytes(HASHES)] * 2, "past": pa.array([[], []], pa.list_(pa.int64())), "root": [7, 9], "t": pa.array([0, 0], pa.int32())}
    assert [near.tolist() for _, near in Bucket(pa.table(rows), 0.8).open_pairs()] == [[1]]


def keys_that_never_meet(least):
    return np.arange(BANDS, dtype=np.uint64) + np.uint64(xxhash.xxh64_intdigest(least.tobytes()))


def test_dedup_finds_simhash_links_without_minhash(docs_of, monkeypatch):
    """Pairs within four bits of SimHash are candidates by the covering masks alone; those below the bar stay apart."""
    monkeypatch.setattr("millrace.llm.simhash.band_keys", keys_that_never_meet)
    rng, texts = random.Random(14), {}
    for g in range(80):
        words = [f"g{g}w{i}" for i in range(600)]
        changed = list(words)
        at = rng.randint(20, 560)
        changed[at : at + g % 8] = ["y"] * (g % 8)
        texts |= {2 * g: " ".join(words), 2 * g + 1: " ".join(changed)}
    # a word repeated over and over decides all bits of two texts with little else in common
    texts |= {1000: "a " * 400 + " ".join(f"p{i}" for i in range(60)), 1001: "a " * 400 + " ".join(f"q{i}" for i in range(60))}
    fps = {i: fingerprint(t.encode(), 5) for i, t in texts.items()}
    close = [g for g in range(80) if (fps[2 * g] ^ fps[2 * g + 1]).bit_count() <= 4]
    assert len(close) > 20 and (fps[1000] ^ fps[1001]).bit_count() <= 4
    kept = {r.doc_id for r in drop_near_duplicates(docs_of(list(texts.items()))).collect()}
    assert {1000, 1001} <= kept and kept == set(texts) - {2 * g + 1 for g in close}
