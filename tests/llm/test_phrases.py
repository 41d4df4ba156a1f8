"""Phrases against plain counting, and the index against plain search."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm.phrases import DEPTH, FMIndex, Shard, WordIds, collocations, ranked, transform, word_sequence


def pieces_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower) if (w := re.findall(r"[^\x20\x09]+", piece))]


def plain(rows, least, top=2000):
    """The contract on (lang, text) rows."""
    out = []
    by = {}
    for lang, text in rows:
        by.setdefault(lang or "und", []).extend(pieces_of(text))
    for lang, pieces in by.items():
        f, before, behind = Counter(), Counter(), Counter()
        for w in pieces:
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    g = tuple(w[i : i + k])
                    f[g] += 1
                    before[g] += i > 0
                    behind[g] += i + k < len(w)
        n = sum(map(len, pieces))
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = set()
        for g, a in found.items():
            for k in range(2, len(g)):
                gone |= {g[i : i + k] for i in range(len(g) - k + 1) if 100 * a >= 80 * found[g[i : i + k]]}
        kept = []
        for g in set(found) - gone:
            a = found[g]
            score, _, l, r = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), a, l, r, score, before[g], behind[g]))
        out += [(lang, i + 1, x[2].decode(), x[3], x[4], x[5], n, x[6], x[7], x[8]) for i, x in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("words", [500, 1_500_000])
def test_equals_plain_counting(sample, words):
    """In few shards or in many."""
    rows = [(r.lang, r.text) for r in sample.collect()]
    want = plain(rows, 10)
    got = sorted(map(tuple, collocations(sample, least=10, shard_words=words).collect()))
    assert got == want and len(want) > 100


def test_edges(spark, edge, docs_of):
    got = sorted(map(tuple, collocations(edge, least=2).collect()))
    assert got == plain([(None, r.text) for r in edge.collect()], 2) != []
    assert collocations(edge.where("false")).count() == 0
    assert collocations(docs_of([(1, None), (2, ""), (3, " .,\n")])).count() == 0


def test_top_and_ties(spark):
    rows = [("en", f"same{i} pair{i}. ") for i in range(20) for _ in range(3)] + [("fr", "la la la la la la")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, collocations(docs, least=3, top=7).collect())) == plain(rows, 3, 7)


def test_case_marks_and_odd_blanks(spark):
    rows = [(None, "A\tB a b É é;A B\x0bA B\x1cC a b"), ("und", "a b a b a b")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, collocations(docs, least=2).collect())) == plain(rows, 2)


SEQUENCE = st.lists(st.integers(0, 4), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(SEQUENCE)
def test_index_counts_and_extends(symbols):
    """Intervals give the counts of all patterns of up to DEPTH symbols without a mark; extensions are all words in front."""
    s = np.array([0, *symbols, 0], np.int32)
    forward, backward = FMIndex(transform(s)), FMIndex(transform(s[::-1]))
    runs = Counter(tuple(s[i : i + k].tolist()) for k in range(1, DEPTH + 1) for i in range(len(s) - k + 1) if s[i : i + k].all())
    for g, n in runs.items():
        column = [np.array([x]) for x in g]
        (lo, hi), (low, high) = forward.find(column[::-1]), backward.find(column)
        assert hi[0] - lo[0] == high[0] - low[0] == n
        assert forward.extended(lo, hi)[0] == sum(s[i - 1] > 0 for i in range(1, len(s) - len(g) + 1) if tuple(s[i : i + len(g)]) == g)
        assert backward.extended(low, high)[0] == sum(s[i + len(g)] > 0 for i in range(len(s) - len(g)) if tuple(s[i : i + len(g)]) == g)
    shard = Shard(np.array([20, 30, 40]), forward.bwt, backward.bwt)  # symbol 1 is for rare words
    live, at = [shard.words], 1
    while at < DEPTH:
        words, n = shard.extend(live)
        got = dict(zip(zip(*[w.tolist() for w in words], strict=True), n.tolist(), strict=True))
        at += 1
        assert got == {tuple(10 * x for x in g): n for g, n in runs.items() if len(g) == at and 1 not in g}
        live = words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=40), st.sampled_from([1, 1 << 40]))
def test_ranks(pairs, scale):
    """Packed into 63 bits or not."""
    a, b = (np.array(x, np.int64) * scale for x in zip(*pairs, strict=True))
    order, rank = ranked(a, b)
    assert order.tolist() == sorted(range(len(pairs)), key=lambda i: (*pairs[i], i))
    assert rank.tolist() == [sorted(set(pairs)).index(p) for p in pairs]


def test_sequences():
    known = WordIds()
    assert word_sequence(b"..A b, ,B\tc!", known).tolist() == [1, 2, 0, 2, 3, 0]
    assert word_sequence(b"", known).tolist() == []
    assert list(known) == [b"\xff", b"a", b"b", b"c"]
