import random
from collections import Counter

import numpy as np
from millrace.llm.decontaminate import Benchmark, drop_contaminated, find_contamination

EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def plain(text):
    return [x for w in (text or "").encode().split() if (x := w.lower().strip(EDGES.encode()))]


def brute(text, item):
    """Best weighted Jaccard of a window as long as the item."""
    words, wanted = plain(text), plain(item)
    if not wanted:
        return 0.0
    k = min(5, len(wanted))
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want, best = grams(wanted), 0.0
    for i in range(len(words) - len(wanted) + 1):
        got = grams(words[i : i + len(wanted)])
        best = max(best, sum((got & want).values()) / sum((got | want).values()))
    return best


def test_equals_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    items, rows = bench.collect(), docs.collect()
    keys = {" ".join(w.decode() for w in plain(i.text)[j : j + 5]): i.item_id for i in items for j in range(len(plain(i.text)))}
    expect = {}
    for d in rows:
        words = [w.decode() for w in plain(d.text)]
        if any(" ".join(words[j : j + 5]) in keys for j in range(len(words))):
            for i in items:
                alike = brute(d.text, i.text)
                if alike >= 0.8:
                    expect[d.doc_id, i.item_id] = alike
    got = find_contamination(docs, bench).collect()
    assert expect and {(r.doc_id, r.item_id) for r in got} == set(expect)
    assert all(abs(r.similarity - expect[r.doc_id, r.item_id]) < 1e-9 for r in got)
    assert {(r.doc_id, r.item_id) for r in find_contamination(docs, bench, block_chars=1500).collect()} == set(expect)  # several blocks
    kept = {r.doc_id for r in drop_contaminated(docs, bench, block_chars=1500).collect()}
    assert kept == {d.doc_id for d in rows} - {d for d, _ in expect}


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(8)
    bench = Benchmark([(i, " ".join(f"{i}w{j}" for j in range(20))) for i in range(300)])
    queries = np.array([f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for f in bench.fps[:100] for k in (0, 5, 12, 19, 22)], np.uint64)
    row, item = bench.near(queries)
    expect = {(q, i) for q in range(len(queries)) for i in range(300) if int(np.bitwise_count(queries[q] ^ bench.fps[i])) <= 19}
    assert set(zip(row.tolist(), item.tolist(), strict=True)) == expect


def test_edited_passages(spark, docs_of):
    rng = random.Random(6)
    item = [f"word{i}" for i in range(80)]
    text = lambda w: " ".join(["before", "it", *w, "after", "it"])
    one = [*item[:40], "changed", *item[41:]]
    many = ["x" if i % 8 == 0 else w for i, w in enumerate(item)]
    shuffled = rng.sample(item, 80)
    docs = docs_of([(1, text(item)), (2, text(one)), (3, text(many)), (4, text(shuffled)), (5, text([w.upper() + "," for w in item])), (6, text(item[:60])), (None, text(item)), (7, None), (8, ""), (9, "tiny thing"), (9, "tiny thing")])
    bench = spark.createDataFrame([(100, " ".join(item)), (101, None), (102, ""), (None, "tiny thing")], "item_id long, text string")
    got = find_contamination(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(1, 100), (2, 100), (5, 100), (None, 100), (9, None), (9, None)], key=str)
    first = next(r for r in got if r.doc_id == 1)
    assert text(item)[first.start : first.end] == " ".join(item)
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == [3, 4, 6, 7, 8]


def test_edges(spark, edge, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert sorted(r.doc_id for r in find_contamination(edge, bench).collect()) == [3, 3, 4]
    assert find_contamination(edge, bench.where("false")).count() == 0 and drop_contaminated(edge, bench.where("false")).count() == 8
    assert find_contamination(docs_of([]), bench).count() == 0


def test_shortened_documents(spark, docs_of):
    """A whole document that is an item less some words: 91, 77 and 75 of its 96 shingles."""
    item = [f"word{i}" for i in range(100)]
    docs = docs_of([(1, " ".join(item[:95])), (2, " ".join(item[10:91])), (3, " ".join(item[:79])), (4, "word1 word2 word3")])
    bench = spark.createDataFrame([(100, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in find_contamination(docs, bench).collect()}
    assert set(got) == {1, 2} and abs(got[1].similarity - 91 / 96) < 1e-9 and abs(got[2].similarity - 77 / 96) < 1e-9
    assert (got[1].start, got[1].end) == (0, len(" ".join(item[:95])))
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == [3, 4]
