"""Retrieval: chunks, keyword and vector search, rank fusion."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine, md5, tokens
from .changes import assign_ids
from .durable import durable
from .joins import QUERY_BLOCK, score_pairs
from .position import first_n_per, latest_per
from .search import add_segment, search  # noqa: F401

SEPARATORS = ("\n\n", "\n", " ", "")


def stride_chunks(docs: DataFrame, size: int, overlap: int, cap: int | None = None) -> DataFrame:
    """R1, fixed stride: docs (document_id, text) -> document_id, chunk_no from 0, text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(size - overlap))
    cut = docs.select("document_id", F.posexplode(F.transform(starts, lambda s: F.substring(F.col("text"), s, F.lit(size)))).alias("chunk_no", "chunk"))
    kept = cut if cap is None else cut.where(F.col("chunk_no") < cap)
    return kept.where(F.col("chunk") != "").withColumnRenamed("chunk", "text")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does; neighbours share up to ``overlap``."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    glue, finer = separators[at], separators[at + 1 :]
    parts = list(text) if glue == "" else [p for p in text.split(glue) if p]
    out: list[str] = []
    held: deque[str] = deque()
    letters = 0  # of the pieces held, without the glue between them
    length = lambda count, size: size + len(glue) * max(0, count - 1)

    def flush() -> None:
        if (made := glue.join(held).strip()):
            out.append(made)

    for p in parts:
        if len(p) > size:
            flush()
            held.clear()
            letters = 0
            out.extend(split_text(p, size, overlap, finer))
        else:
            if held and length(len(held) + 1, letters + len(p)) > size:
                flush()
                while held and (length(len(held), letters) > overlap or length(len(held) + 1, letters + len(p)) > size):
                    letters -= len(held.popleft())
            held.append(p)
            letters += len(p)
    flush()
    return out


def chunk(docs: DataFrame, size: int, overlap: int, cap: int | None = None) -> DataFrame:
    """R1, recursive separators: document_id, chunk_no, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, c) for d, t in zip(f.document_id, f.text, strict=True) for i, c in enumerate(split_text(t or "", size, overlap)[:cap])]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_no", "text"])

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInPandas(run, f"document_id {kind}, chunk_no int, text string")


def dedupe_chunks(chunks: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """R2: chunks by content hash across documents, the first document and chunk wins; adds ``id``."""
    hashed = chunks.withColumn("id", md5(F.col("text")))
    firsts = latest_per(hashed, ["id"], ["document_id", "chunk_no"])
    return firsts if existing is None else firsts.join(existing.select("id"), "id", "left_anti")


def bm25(chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """Chunks (id, text), queries (query_id, query) -> query_id, id, score of chunks that share a word.

    Negative idf values are replaced by ``floor`` times the mean idf of all words; a word counts as often as the query holds it.
    """
    words = chunks.select("id", tokens(F.col("text")).alias("w")).withColumn("len", F.size("w"))
    # one pass gives the document frequency of each word and, in the row without a word, the number of chunks and of all their words
    entry = lambda word, n: F.struct(word.alias("word"), n.alias("len"))
    entries = F.concat(F.array(entry(F.lit(None).cast("string"), F.col("len"))), F.transform(F.array_distinct("w"), lambda x: entry(x, F.lit(0))))
    df = durable(words.select(F.explode(entries).alias("x")).groupBy("x.word").agg(F.count(F.lit(1)).alias("df"), F.sum("x.len").alias("len")), "words")
    sizes = df.where("word is null").agg(F.sum("df").alias("n"), (F.sum("len") / F.sum("df")).alias("mean"))
    raw = df.where("word is not null").join(F.broadcast(sizes)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    low = raw.agg((F.avg("idf") * floor).alias("eps"))
    wanted = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("word")).groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("times"))
    idf = raw.join(wanted.select("word").distinct(), "word", "left_semi").join(F.broadcast(low)).select("word", F.when(F.col("idf") < 0, F.col("eps")).otherwise(F.col("idf")).alias("idf"), "mean")
    asked = wanted.join(idf, "word")
    hits = words.select("id", "len", F.explode("w").alias("word")).join(asked, "word").groupBy("query_id", "id", "len", "word", "times", "idf", "mean").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    parts = F.array_sort(F.collect_list(part))  # one for each word of the query; added in order, so that equal texts have equal scores
    return hits.groupBy("query_id", "id").agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("score"))


def best_scores(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The ``n`` vectors (id, embedding) with the best score over queries (query_id, query): id, score; ties by id.

    A vector meets a block of queries in one row, which gives its best score there; each partition keeps ``n`` rows of a block and no more are shuffled. A vector that is
    among the best overall is so in the block where it has its best score.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    held = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("__block")).agg(F.collect_list("query").alias("__queries"))
    each = vectors.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(held, "__block")
    scored = each.select("id", "__block", F.array_max(F.transform("__queries", lambda q: cosine(q, F.col("embedding")))).alias("score"))
    order = [F.col("score").desc(), F.col("id")]
    if blocks == 1:
        return scored.select("id", "score").orderBy(*order).limit(n)
    return first_n_per(scored, ["__block"], order, n).groupBy("id").agg(F.max("score").alias("score")).orderBy(*order).limit(n)


def semantic(vectors: DataFrame, queries: DataFrame, n: int = 4) -> DataFrame:
    """Vectors (id, embedding) nearest to one query (query_id, query)."""
    return score_pairs(queries, vectors, cosine).select("id", "score").orderBy(F.col("score").desc(), "id").limit(n)


def semantic_multi(vectors: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    """The best score over several queries."""
    return best_scores(vectors, queries, n)


def ranked(df: DataFrame, score: str = "score") -> DataFrame:
    """(id, rank from 0), best first, ties by id; numbered by ranges, so that no task sees all rows."""
    return assign_ids(df.select("id", score), 0, [F.col(score).desc(), F.col("id")], "rank").select("id", "rank")


def fuse(*lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) lists: id, score."""
    out = lists[0].select("id", "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select("id", "rank"))
    return out.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def hybrid(chunks: DataFrame, vectors: DataFrame, text: str, queries: DataFrame, docs: list | None = None, n: int = 20, index: str | None = None) -> DataFrame:
    """Keyword and multi-query vector search fused: id, score.

    Corpus statistics count all chunks (id, document_id, and text unless there is an ``index``, a folder of ``search.add_segment``); the filter on documents
    comes after them, before ranking. Both lists are ranked to their ends.
    """
    spark = chunks.sparkSession
    asked = spark.createDataFrame([("q", text)], "query_id string, query string")
    allowed = chunks.select("id") if docs is None else chunks.where(F.col("document_id").isin(docs)).select("id")
    words = bm25(chunks, asked) if index is None else search(spark, index, asked)
    keyword = allowed.join(words.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    meaning = score_pairs(queries, vectors.join(allowed, "id", "left_semi"), cosine).groupBy("id").agg(F.max("score").alias("score"))
    return fuse(ranked(meaning), ranked(keyword)).orderBy(F.col("score").desc(), "id").limit(n)


def context(chunks: DataFrame, order: str, sep: str, by: list[str] | None = None) -> DataFrame:
    """The retrieved chunks (text) of each request (``by``) joined in order, with their number and length. A request's chunks are a few dozen."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    joined = chunks.groupBy(*(by or [])).agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias("context"), F.count(F.lit(1)).alias("chunks"))
    return joined.withColumn("chars", F.length("context"))


def rank_summaries(summaries: DataFrame, query: DataFrame | None, n: int = 15) -> DataFrame:
    """Summaries (id, text, embedding) nearest to the query; without a query vector the first ones."""
    if query is None:
        return summaries.select("id", F.lit(None).cast("double").alias("score")).orderBy("id").limit(n)
    return semantic(summaries, query, n)
