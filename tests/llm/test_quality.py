"""Rule statistics against plain Python, the forest on planted anomalies, the threshold on held-out labels."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm.quality import FEATURES, Forest, expected_path, fit, judge, op13_quality_forest, rule_statistics, scored, statistics, threshold
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = st.lists(st.text(alphabet="ab \n\t#é\x1c　", max_size=80), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_counts_equal_plain_python(texts):
    counts, _ = rule_statistics([x.encode() for x in texts])
    assert [tuple(r) for r in counts.tolist()] == [plain(x) for x in texts]


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op13_quality_forest(spark, SF).collect()
    assert len(got) == len(docs) and got[0].__fields__[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for r in got:
        assert tuple(r)[1:6] == plain(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_edges(spark, edge):
    labels = spark.createDataFrame([(6, 1, 0, "x"), (3, None, 0, "x"), (None, 0, 0, "x")], "doc_id long, quality int, toxic int, score string")
    got = judge(edge, labels).collect()
    assert len(got) == edge.count()
    assert {r.doc_id: (r.n_words, r.base_failed) for r in got} == {1: (0, True), 2: (0, True), 3: (7, True), 4: (7, True), None: (3, True), 5: (0, True), 6: (30_000, True)}
    assert judge(edge.where("false"), labels).count() == 0


def test_without_labels_the_fixed_rules_decide(spark, sample):
    got = judge(sample, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(r.kept != r.base_failed for r in got)


def test_forest_tells_planted_anomalies():
    draw = np.random.default_rng(1)
    usual, odd = draw.normal(0, 1, (2000, len(FEATURES))), draw.normal(8, 1, (20, len(FEATURES)))
    n = np.full(2000, 100)
    f = Forest(usual, n)
    assert f.score(odd, n[:20]).min() > np.quantile(f.score(usual, n), 0.99)
    assert (Forest(usual[:0], n[:0]).score(odd, n[:20]) == 0.5).all()


def test_path_lengths_by_hand():
    """A forest of one tree walks its rows to the leaves that splitting gives."""
    rows = np.zeros((8, len(FEATURES)))
    rows[:, 0] = [0, 0, 0, 0, 0, 0, 0, 100]
    n = np.full(8, 10**9)
    f = Forest(rows, n, trees=1, sample=8)
    assert np.isclose(f.path[0].max(), 1 + expected_path(7))
    assert np.allclose(f.score(rows, n), 2 ** -(np.array([1 + expected_path(7)] * 7 + [1.0]) / expected_path(8)))


def test_expected_path_is_the_mean_of_random_trees():
    def splits(n, draw):
        return 0 if n <= 1 else 1 + (lambda k: splits(k, draw) if draw.random() < k / n else splits(n - k, draw))(int(draw.integers(1, n)))

    assert expected_path(1) == 0 and expected_path(2) == 1
    draw = np.random.default_rng(3)
    assert abs(np.mean([splits(64, draw) for _ in range(4000)]) - expected_path(64)) < 0.3


def test_held_out_labels(spark):
    """Fitted on four fifths of the labelled rows: hardly a good document of the other fifth goes, most junk does."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = statistics(docs.join(labels.select("doc_id"), "doc_id", "left_semi")).where(~F.col("base_failed")).join(labels.select("doc_id", "quality"), "doc_id")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    forest = fit(rows.where(~held).select("n_words", "features", "quality"))
    least = threshold(scored(rows.where(~held).select("n_words", "features", "quality"), forest))
    got = scored(rows.where(held).select("n_words", "features", "quality"), forest).collect()
    dropped = {q: np.mean([r.score >= least for r in got if r.quality == q]) for q in (0, 1)}
    assert dropped[1] <= 0.01 and dropped[0] >= 0.8


def test_repeated_doc_ids_and_labels(spark, docs_of):
    text = " ".join(f"word{i}" for i in range(40))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert judge(docs_of([(1, text), (1, text), (2, text)]), labels).count() == 3
