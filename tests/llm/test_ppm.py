import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from millrace.llm import ppm
from millrace.llm.common import fold
from millrace.llm.ppm import EDGE, LOW, ORDER, SYMBOLS, Trie, batches_of, frequent_orders, keys, load_orders, low_orders, score_documents, split_contexts, trie_table, whole_trie


def plain_trie(texts, least, low):
    counts = defaultdict(Counter)
    for t in texts:
        symbols = [EDGE] * ORDER + list(t) + [EDGE]
        for i in range(ORDER, len(symbols)):
            for k in range(ORDER + 1):
                counts[tuple(symbols[i - k : i])][symbols[i]] += 1
    return {c: x for c, x in counts.items() if len(c) < low or sum(x.values()) >= least}


def plain_probability(trie, context, symbol):
    """PPM with method D escapes and exclusion, from the definition."""
    p, excluded = 1.0, set()
    for k in range(ORDER, -1, -1):
        c = tuple(context[ORDER - k :])
        if c not in trie:
            continue
        left = {s: n for s, n in trie[c].items() if s not in excluded}
        if symbol in left:
            return p * (left[symbol] - 0.5) / sum(left.values())
        if left:
            p *= 0.5 * len(left) / sum(left.values())
        excluded |= set(trie[c])
    return p / (SYMBOLS - len(excluded))


TRAIN = [b"the cat sat on the mat", b"the hat", b"", b"abracadabra abracadabra", "é über".encode(), b"the cat"]
HELD = [b"the cat sat", b"zebra", b"", b"abracat \xc3\xa9\xfe", b"the mat on the cat"]


NONE = [np.zeros(0, np.uint64)] * (ORDER - LOW)


def plain_score(trie, text):
    symbols = [EDGE] * ORDER + list(text) + [EDGE]
    return sum(math.log10(plain_probability(trie, symbols[i - ORDER : i], symbols[i])) for i in range(ORDER, len(symbols)))


@pytest.mark.parametrize("most, least", [(1000, 1), (150, 2)])
def test_scores_equal_the_definition(spark, docs_of, most, least):
    table = trie_table(docs_of([(i, t.decode()) for i, t in enumerate(TRAIN)]), NONE).cache()
    kept = load_orders(frequent_orders(table, most))
    trie, plain = Trie([*low_orders(table), *kept]), plain_trie(TRAIN, least, LOW)
    assert sum(len(g) for g, _ in kept) == sum(len(x) for c, x in plain.items() if len(c) >= LOW) <= most
    for text, got in zip(HELD, trie.scores(HELD)[0], strict=True):
        assert math.isclose(got, plain_score(plain, text), rel_tol=1e-9)
    for text in HELD:  # all symbols after a context add up to one
        context = int.from_bytes(([EDGE] * ORDER + list(text))[-ORDER:], "big")
        grams = np.array([context << 8 | s for s in range(SYMBOLS)], np.uint64)
        assert math.isclose(float((10 ** trie.log10(grams)[0]).sum()), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("most", [1000, 150, 3])
def test_a_score_is_the_same_wherever_its_positions_are_scored(spark, docs_of, monkeypatch, most):
    monkeypatch.setattr(ppm.frequent_orders, "__defaults__", (most,))
    held = [t for t in HELD if b"\xfe" not in t] + ["über abra éé".encode()]
    train, frame = docs_of([(i, t.decode()) for i, t in enumerate(TRAIN)]), docs_of([(i, t.decode()) for i, t in enumerate(held)])
    plain = plain_trie(TRAIN, 1, LOW)
    got = {r.doc_id: r.score for r in score_documents(frame, train).collect()}
    assert all(math.isclose(got[i], plain_score(plain, t), rel_tol=1e-9) for i, t in enumerate(held))


@pytest.mark.parametrize("parts", [30, 100])
@pytest.mark.parametrize("most", [1000, 3])
def test_split_contexts_change_no_count_and_no_score(spark, docs_of, monkeypatch, parts, most):
    monkeypatch.setattr(ppm.frequent_orders, "__defaults__", (most,))
    monkeypatch.setattr(ppm.split_contexts, "__defaults__", (parts, 5000))
    train = docs_of([(i, t.decode()) for i, t in enumerate(TRAIN)])
    split = split_contexts(train)
    assert 0 < len(split[0]) <= parts and all(set(b & np.uint64((1 << 8 * (LOW + i)) - 1)) <= set(a) for i, (a, b) in enumerate(zip(split, split[1:])))
    assert len(split[-1]) > 0 or parts == 30
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(whole_trie(trie_table(train, split), split)) == rows(trie_table(train, NONE))
    held = [t for t in HELD if b"\xfe" not in t]
    plain = plain_trie(TRAIN, 1, LOW)
    got = {r.doc_id: r.score for r in score_documents(docs_of([(i, t.decode()) for i, t in enumerate(held)]), train).collect()}
    assert all(math.isclose(got[i], plain_score(plain, t), rel_tol=1e-9) for i, t in enumerate(held))


def test_the_largest_task_shrinks_with_the_number_of_tasks(spark):
    """A passage's end that a third of all n-grams have before them is no task's alone."""
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" the ", *[F.substring(F.md5(F.concat_ws("/", "id", F.lit(i))), 1, 4) for i in range(20)]).alias("text"))
    shares = []
    for parts in (4, 64, 512):
        split = split_contexts(docs, parts)
        counts = ppm.gram_counts(docs).select(F.pmod(ppm.by_context(F.col("gram"), split), F.lit(parts)).alias("task"), "gram").distinct().groupBy("task").count()
        shares.append(counts.agg(F.max("count") / F.sum("count")).first()[0] * parts)
    assert len(split[0]) > 0 and max(shares) < 4, shares  # the largest task against the mean


def test_positions():
    texts = [b"ab", b"", b"c", b"abcdefghij" * 3]
    want = sorted(((p + t + b"\xff")[i : i + ORDER + 1], d) for p in [b"\xff" * ORDER] for d, t in enumerate(texts) for i in range(len(t) + 1))
    for window in (1 << 21, 7):
        got = np.concatenate(list(keys(texts, window)))
        assert sorted((int(x >> 8).to_bytes(ORDER + 1, "big"), int(x & 255)) for x in got.tolist()) == want
    assert [b - a for a, b in batches_of([b""] * 600)] == [256, 256, 88] and list(batches_of([])) == []


def check_base(docs, rows):
    texts = [(d, (t or "").encode().lower()) for d, t in docs]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(w for d, t in texts if not held(d) for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), held(d), len(t.split()) + 1, sum(counts[w] > 0 for w in [*t.split(), None]), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.split(), None]), 6)) for d, t in texts)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want


def test_sample(sample):
    rows = score_documents(sample, sample.where(fold("doc_id") != 1)).collect()
    check_base([(r.doc_id, r.text) for r in sample.collect()], rows)
    assert all(r.score < 0 for r in rows)


def test_held_out_texts_code_shorter_than_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = [r for r in score_documents(docs, docs.where(fold("doc_id") != 1)).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(edge, docs_of):
    from tests.llm.conftest import EDGE as ROWS

    check_base(ROWS, score_documents(edge, edge.where(fold("doc_id") != 1)).collect())
    alone = score_documents(docs_of([(1, "ab")]), docs_of([])).first()
    assert alone.base_score == 0 and math.isclose(alone.score, -3 * math.log10(SYMBOLS)) and alone.train_tokens == 0
    assert score_documents(docs_of([]), docs_of([])).count() == 0
