"""The stored index against BM25 over the texts, and what it reads."""

import random

import pytest
from millrace.functions.scalars import tokens
from millrace.operators import retrieval as R
from millrace.operators import search as X
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(draw.choices(words, [1 / (k + 1) for k in range(60)], k=draw.randint(1, 40)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "w0 w0 w0 w5"), (2003, "w0 w0 w0 w5"), (2004, "w0 unique w1")]
    return spark.createDataFrame(rows, "id long, text string").repartition(4).persist()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("a", "w3 w3 w40 zzz"), ("b", "W0 w1 w59"), ("c", "nothing here"), ("d", "w0")], "query_id string, query string")


@pytest.fixture(scope="module")
def path(corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index") / "one")
    X.add_segment(corpus, at, 0)
    return at


def scores(df):
    return {(r.query_id, r.id): round(r.score, 9) for r in df.collect()}


def test_equals_bm25_over_the_texts(spark, corpus, asked, path):
    assert scores(X.search(spark, path, asked)) == scores(R.bm25(corpus, asked)) != {}


def test_segments_add_up(spark, corpus, asked, tmp_path):
    at = str(tmp_path / "index")
    for k in (0, 1, 1):  # a segment that is written again replaces itself
        X.add_segment(corpus.where(F.col("id") % 2 == k), at, k)
    assert scores(X.search(spark, at, asked)) == scores(R.bm25(corpus, asked))
    want = {k: v for k, v in best(R.bm25(corpus, asked), 5).items()}
    assert scores(X.search(spark, at, asked, n=5)) == want


def best(df, n):
    out, rows = {}, df.collect()
    for q in {r.query_id for r in rows}:
        out |= {(q, r.id): round(r.score, 9) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: (-round(r.score, 9), r.id))[:n]}
    return out


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_the_best_chunks(spark, corpus, asked, path, n):
    assert scores(X.search(spark, path, asked, n=n)) == best(R.bm25(corpus, asked), n)


def test_blocks_that_cannot_matter_stay_closed(spark, corpus, path, monkeypatch):
    """Few cells reach the best score of a rare word; the frequent word's other blocks are left out, and no text is read."""
    one = spark.createDataFrame([("q", "w0 unique")], "query_id string, query string")
    asked, words = X.asked_words(spark, path, one)
    every, kept = X.cells(spark, path, asked, words, 1.5, 0.75, 1, first=1)
    needed, blocks = X.needed_blocks(every, kept).count(), X.postings_of(spark, path, asked, words).count()
    assert 0 < needed < blocks
    monkeypatch.setattr(X, "FIRST_CELLS", 1)
    assert scores(X.search(spark, path, one, n=1)) == best(R.bm25(corpus, one), 1)
    read = X.search(spark, path, one).inputFiles()
    assert read and all("/postings/" in f or "/words/" in f or "/statistics/" in f for f in read)
    buckets = {f.split("bucket=")[1].split("/")[0] for f in read if "/postings/" in f}
    assert len(buckets) <= X.BUCKETS


def test_blocks_are_of_bounded_size(spark, path):
    sizes = [r.n for r in spark.read.parquet(f"{path}/postings").select(F.size("chunks").alias("n")).collect()]
    assert max(sizes) <= 2 * X.BLOCK and sum(sizes) == spark.read.parquet(f"{path}/words").agg(F.sum("df")).first()[0]


def test_an_empty_index_and_no_words(spark, corpus, path, tmp_path):
    none = spark.createDataFrame([("q", "!!"), ("r", None)], "query_id string, query string")
    assert X.search(spark, path, none).count() == 0 and X.search(spark, path, none, n=3).count() == 0


def test_many_queries_go_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 13), float(i % 7) + 1, 1.0]) for i in range(200)], "id int, embedding array<double>")
    queries = vectors.where("id < 30").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = R.score_pairs(queries, vectors, R.cosine).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "id").limit(11)
    want = [(r.id, round(r.score, 12)) for r in pairs.collect()]
    for block in (64, 4):
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        assert [(r.id, round(r.score, 12)) for r in R.semantic_multi(vectors, queries, 11).collect()] == want


def test_postings_are_dealt_once(spark, corpus, asked, path, tmp_path, monkeypatch):
    """Words are counted within their chunk, without a shuffle; a folder's postings go to several tasks, with the same answers."""
    odd = spark.createDataFrame([(1, "b a B"), (2, None), (3, "")], "id long, text string")
    assert "Exchange" not in X.term_rows(odd)._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in X.term_rows(odd).collect()} == {(1, 3, None, 0), (1, 3, "a", 1), (1, 3, "b", 2), (2, 0, None, 0), (3, 0, None, 0)}
    monkeypatch.setattr(X, "TASK_TERMS", 10)
    at = str(tmp_path / "index")
    X.add_segment(corpus, at, 0)
    both = [{tuple(r) for r in X.search(spark, p, asked).collect()} for p in (path, at)]
    assert both[0] == both[1] and both[0]


def test_words_are_the_tokens(spark):
    """Python counts what ``tokens`` finds, also where folding leaves ASCII or ends in other letters."""
    texts = ["It's İstanbul, K2 xſy café ΣΣ A\u0000b\tc d 9' --", "a" * 5000 + " B b", "'", None, ""]
    odd = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = odd.select("id", F.explode(tokens(F.col("text"))).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    got = X.term_rows(odd).where("word is not null").select("id", "word", "tf")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in words.collect()} != set()


def test_words_of_many_chunks_go_as_lists(spark, corpus, asked, path, tmp_path, monkeypatch):
    """What is dealt is a row for each word of many chunks, not one for each word of each chunk; no term is lost where lists and batches end."""
    terms, lists = X.term_rows(corpus), X.word_lists(corpus)
    assert lists.count() * 5 < terms.count()
    many = {(r.word, r.n, r.length) for r in lists.groupBy("word").agg(F.sum(F.size("ids")).alias("n"), F.sum("length").alias("length")).collect()}
    assert many == {(r.word, r.n, r.length) for r in terms.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("length")).collect()}
    rows = lambda p: sorted((r.word, r.bits, r.block, r.most, r.shortest, sorted(map(tuple, r.chunks))) for r in spark.read.parquet(f"{p}/postings").collect())
    monkeypatch.setattr(X, "BATCH_TERMS", 7)
    monkeypatch.setattr(X, "LIST_TERMS", 50)
    small = spark.createDataFrame(corpus.collect(), corpus.schema).repartition(3)
    for name, size in (("one", X.TASK_TERMS), ("several", 10)):
        monkeypatch.setattr(X, "TASK_TERMS", size)
        X.add_segment(small, str(tmp_path / name), 0)
        assert rows(tmp_path / name) == rows(path)


def test_ids_may_be_texts(spark, tmp_path):
    """An index of chunks with ids of another kind."""
    X.add_segment(spark.createDataFrame([("p", "a b a"), ("q", "b c"), ("r", None)], "id string, text string"), str(tmp_path / "index"), 0)
    found = X.search(spark, str(tmp_path / "index"), spark.createDataFrame([("x", "a c")], "query_id string, query string"))
    assert {r.id for r in found.collect()} == {"p", "q"}
