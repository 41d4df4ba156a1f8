"""R3 over a stored index: postings of words in blocks, built once, added to by segments, asked without reading a text.

An index is a folder of Parquet tables, each written by segment:

- ``postings``: a row for each word and block with the block's chunks (``ids``, ``tf``, ``len``), the largest tf and the least length; partitioned by a hash of the word.
- ``words``: how many chunks of the segment hold each word. ``sizes``: the segment's chunks and words. ``statistics``: for the segments up to and with this one
  the number of chunks, the mean length and the floor of the idf, so that a request reads no vocabulary.

A chunk lies in block ``hash(id) mod 2^k`` of a word, k such that blocks hold about BLOCK chunks: no word's list is ever one task's or one row. The blocks of two words
nest, as both are low bits of one hash. So the blocks of a request's most split word are cells that all its words' chunks fall into, and a cell has a bound: the sum of the largest shares that
each word can have there. ``search`` with ``n`` scores the most promising cells first, and then only cells whose bound reaches the n-th best score. Nothing is lost by that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import tokens
from .durable import durable
from .position import first_n_per

#: Chunks of a block, about; folders that words are dealt to.
BLOCK, BUCKETS = 128, 32
#: Terms of an index that one task groups into blocks, about.
TASK_TERMS = 1_000_000
#: Terms of a batch that Python counts, and of those that it lists by word at once, about.
BATCH_TERMS, LIST_TERMS = 50_000, 500_000
#: What goes along with a chunk's id in a word's list.
REST = np.dtype([("hash", "<i8"), ("tf", "<i4"), ("len", "<i4")])
#: All bytes but those of words are blanks.
BLANKED = bytes(i if chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789'" else 32 for i in range(256))
#: Cells that ``search`` scores first.
FIRST_CELLS = 16
#: Words of a request that are pushed into the scan as values; beyond them the scan is joined with the words.
PUSHED_WORDS = 1000


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def low_bits(bits: str) -> Column:
    return F.expr(f"shiftleft(1L, {bits}) - 1")


def hash_of(chunk: Column) -> Column:
    return F.xxhash64(F.lit("cell"), chunk)


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of each row's text, and once without word, a row with len, word, tf and the columns besides ``text``. Words are those of ``tokens``."""
    for batch in batches:
        texts = batch.column("text")
        others = batch.drop_columns(["text"])
        start, size, length, words, times = 0, [], [], [], []
        for i, text in enumerate(texts, 1):
            found = (text.as_py() or "").lower().encode().translate(BLANKED).split()
            counts = Counter(found)
            size.append(len(counts) + 1)
            length.append(len(found))
            words += [None, *counts]
            times += [0, *counts.values()]
            if len(words) >= BATCH_TERMS or i == len(texts):
                at = np.repeat(np.arange(len(size)), size)
                mine = others.slice(start, len(size)).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(np.array(length, np.int32)[at]), pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int32())], names=[*others.schema.names, "len", "word", "tf"])
                start, size, length, words, times = i, [], [], [], []


def term_rows(chunks: DataFrame) -> DataFrame:
    """(id, len, word, tf): a row for each word of each chunk (id, text), and one without word for the chunk. Words are counted within their row."""
    return chunks.select("id", "text").mapInArrow(counted, f"id {kind_of(chunks)}, len int, word string, tf int")


def kind_of(chunks: DataFrame) -> str:
    return chunks.schema["id"].dataType.simpleString()


def gathered(batches: Iterable[pa.RecordBatch], terms: Callable[[pa.RecordBatch], int], least: int) -> Iterator[pa.RecordBatch]:
    """Batches brought together until they hold ``least`` terms."""
    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += terms(batch)
        if many >= least:
            yield pa.concat_batches(held)
            held, many = [], 0
    if held:
        yield pa.concat_batches(held)


def lists_of(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([*starts, len(values)], pa.int32()), values)


def cut(rest: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Each list's part of ``rest`` as bytes: Spark hands bytes on as they are, other than lists of rows."""
    ends = np.append(starts[1:], len(rest))
    return pa.array([rest[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())


def changes(*columns: np.ndarray) -> np.ndarray:
    """Places at which a row differs from the one before; the first is one."""
    return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))) if len(columns[0]) else np.zeros(0, np.int64)


def word_lists(chunks: DataFrame) -> DataFrame:
    """(word, n, length, ids, rest): for some LIST_TERMS terms at a time, a row for each word with its chunks, and one without word for all of them.

    ``n``, ``length``: the chunks and their words. ``rest``: for each of ``ids`` what REST holds.
    """

    def run(batches):
        for terms in gathered(counted(batches), lambda b: b.num_rows, LIST_TERMS):
            coded = terms.column("word").dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy()
            order, n = np.argsort(code, kind="stable"), np.bincount(code, minlength=len(coded.dictionary))
            rest = np.empty(len(code), REST)
            for c in REST.names:
                rest[c] = terms.column(c).to_numpy()
            starts, rest = np.cumsum(n) - n, rest[order]
            columns = [coded.dictionary, pa.array(n, pa.int64()), pa.array(np.bincount(code, terms.column("len").to_numpy(), len(n)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, lists_of(terms.column("id").take(pa.array(order)), starts), cut(rest, starts)], names=["word", "n", "length", "ids", "rest"])

    return chunks.select("id", hash_of(F.col("id")).alias("hash"), "text").mapInArrow(run, f"word string, n long, length long, ids array<{kind_of(chunks)}>, rest binary")


def terms_of(batch: pa.RecordBatch) -> int:
    return len(batch.column("ids").flatten())


def flat(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """ids and rest of all rows, each one's row, and its block by the row's bits."""
    row = np.repeat(np.arange(batch.num_rows), batch.column("ids").value_lengths().to_numpy())
    rest = np.frombuffer(b"".join(batch.column("rest").to_pylist()), REST)
    return batch.column("ids").flatten(), rest, row, rest["hash"] & ((np.int64(1) << batch.column("bits").to_numpy().astype(np.int64)) - 1)[row]


def dealt(placed: DataFrame, shares: int, kind: str) -> DataFrame:
    """(bucket, share, word, bits, ids, rest): rows (word, bits, ids, rest) cut by the share that a word's block belongs to."""
    names = ["bucket", "word", "bits"]

    def run(batches):
        for batch in batches:
            ids, rest, row, block = flat(batch)
            mixed = block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            share = ((mixed + batch.column("draw").to_numpy().astype(np.uint64)[row]) % np.uint64(shares)).astype(np.int32)
            order = np.lexsort((share, row))
            share, row, rest = share[order], row[order], rest[order]
            starts = changes(row, share)
            whose = [batch.column(c).take(pa.array(row[starts])) for c in names]
            yield pa.RecordBatch.from_arrays([*whose, pa.array(share[starts]), lists_of(ids.take(pa.array(order)), starts), cut(rest, starts)], names=[*names, "share", "ids", "rest"])

    draw = F.shiftrightunsigned(F.xxhash64(F.lit("share"), "word"), 34).alias("draw")
    rows = placed.select(bucket_of(F.col("word")).alias("bucket"), "word", "bits", draw, "ids", "rest")
    if shares > 1:
        rows = rows.mapInArrow(run, f"bucket int, word string, bits int, share int, ids array<{kind}>, rest binary")
    else:
        rows = rows.select(*names, F.lit(0).alias("share"), "ids", "rest")
    return rows.repartition(BUCKETS * shares, "bucket", "share")


def block_rows(rows: DataFrame, kind: str) -> DataFrame:
    """(bucket, word, bits, block, chunks, most, shortest): a row for each word and block of the rows of ``dealt``, which lie together in a partition."""
    key = ["bucket", "share", "word"]

    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rest, row, block = flat(batch)
        firsts = changes(*codes(batch))
        whose = np.repeat(firsts, np.diff(firsts, append=batch.num_rows))[row]  # the first row of the word
        order = np.lexsort((rest["hash"], block, whose))
        rest, block, whose = rest[order], block[order], whose[order]
        starts = changes(whose, block)
        tf, length = (np.ascontiguousarray(rest[c]) for c in ("tf", "len"))
        chunks = pa.StructArray.from_arrays([ids.take(pa.array(order)), pa.array(tf), pa.array(length)], names=["id", "tf", "len"])
        bucket, word, bits = (batch.column(c).take(pa.array(whose[starts])) for c in ("bucket", "word", "bits"))
        columns = [bucket, word, bits, pa.array(block[starts]), lists_of(chunks, starts), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length, starts))]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "word", "bits", "block", "chunks", "most", "shortest"])

    def codes(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(c).dictionary_encode().indices.to_numpy() for c in key]

    def run(batches):
        held = None  # the last word of a batch may go on in the next one
        for batch in gathered((b for b in batches if b.num_rows), terms_of, LIST_TERMS):
            batch = batch if held is None else pa.concat_batches([held, batch])
            last = int(changes(*codes(batch))[-1])
            if last:
                yield blocks(batch.slice(0, last))
            held = batch.slice(last)
        if held is not None:
            yield blocks(held)

    schema = f"bucket int, word string, bits int, block long, chunks array<struct<id: {kind}, tf: int, len: int>>, most int, shortest int"
    return rows.sortWithinPartitions(*key).mapInArrow(run, schema)


def add_segment(chunks: DataFrame, path: str, segment: int, floor: float = 0.25) -> None:
    """Index chunks (id, text) as segment ``segment`` (0, 1, ...) of the index at ``path``. Writing a segment anew replaces it; an id belongs to one segment only.

    A null text has no words; it counts as a chunk of length 0. A chunk's row may come once only.
    """
    spark = chunks.sparkSession
    at = lambda table: f"{path}/{table}/segment={segment}"
    lists = durable(word_lists(chunks), "lists")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    lists.where("word is null").agg(total("n").alias("n"), total("length").alias("len")).write.mode("overwrite").parquet(at("sizes"))
    found = lists.where("word is not null")
    found.groupBy("word").agg(F.sum("n").alias("df")).withColumn("bucket", bucket_of(F.col("word"))).repartition("bucket").sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(at("words"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("df") / BLOCK)).cast("int"))
    split = durable(spark.read.parquet(at("words")).select("word", bits.alias("bits")).where("bits > 0"), "split")  # a table of its own, so that Spark knows how small it is
    placed = found.join(split, "word", "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    # postings are dealt once, by folder and share of its blocks, and are grouped and written where they come
    shares = lists.agg(total("n")).first()[0] // (BUCKETS * TASK_TERMS) + 1
    blocks = block_rows(dealt(placed, shares, kind_of(chunks)), kind_of(chunks))
    # a word's blocks are in order within their file, so that the file's own index of values finds them
    blocks.sortWithinPartitions("bucket", "word", "block").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
    sizes, words = (spark.read.parquet(f"{path}/{t}").where(F.col("segment") <= segment) for t in ("sizes", "words"))
    total = sizes.agg(F.sum("n").alias("n"), (F.sum("len") / F.sum("n")).alias("mean"))
    # words of equal df have equal idf: sums over the distinct values, in order, do not depend on where the words lie
    same = words.groupBy("word").agg(F.sum("df").alias("df")).groupBy("df").agg(F.count(F.lit(1)).alias("words"))
    each = same.join(F.broadcast(total)).select(F.struct("df", (idf_of(F.col("n"), F.col("df")) * F.col("words")).alias("idf"), "words").alias("x"))  # one row of totals
    sums = each.agg(F.sort_array(F.collect_list("x")).alias("x"), F.sum("x.words").alias("words"))
    eps = sums.select((F.aggregate("x", F.lit(0.0), lambda a, x: a + x["idf"]) / F.col("words") * floor).alias("eps"))
    total.join(F.broadcast(eps)).write.mode("overwrite").parquet(at("statistics"))


def idf_of(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def asked_words(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """(query_id, word, times, idf, mean) of the words of the requests that the index holds; the words themselves where they are few."""
    wanted = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("word")).groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("times"))
    some = [r.word for r in wanted.select("word").distinct().limit(PUSHED_WORDS + 1).collect()]
    some = some if len(some) <= PUSHED_WORDS else None
    last = spark.read.parquet(f"{path}/statistics").orderBy(F.col("segment").desc()).limit(1).drop("segment")
    df = held(spark.read.parquet(f"{path}/words"), some).groupBy("word").agg(F.sum("df").alias("df"))
    idf = idf_of(F.col("n"), F.col("df"))
    known = wanted.join(df, "word").join(F.broadcast(last))  # one row
    return known.select("query_id", "word", "times", F.when(idf < 0, F.col("eps")).otherwise(idf).alias("idf"), "mean"), some


def held(table: DataFrame, words: list[str] | None) -> DataFrame:
    """Rows of some words; folder and word reach the scan."""
    if words is None:
        return table
    buckets = [r.b for r in table.sparkSession.createDataFrame([(w,) for w in words], "w string").select(bucket_of(F.col("w")).alias("b")).distinct().collect()] if words else []
    return table.where(F.col("bucket").isin(buckets) & F.col("word").isin(words))


def part(tf: Column, length: Column, k1: float, b: float) -> Column:
    """A word's share of a chunk's score: it grows with tf and falls with the chunk's length."""
    return F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("mean")))


def scores(postings: DataFrame, k1: float, b: float) -> DataFrame:
    """query_id, id, score of all chunks in blocks of postings that are joined with the words asked for."""
    each = postings.select("query_id", "times", "idf", "mean", F.explode("chunks").alias("x")).select("query_id", F.col("x.id").alias("id"), part(F.col("x.tf"), F.col("x.len"), k1, b).alias("part"))
    parts = F.array_sort(F.collect_list("part"))  # one for each word of the request; added in order, so that equal texts have equal scores
    return each.groupBy("query_id", "id").agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("score"))


def search(spark: SparkSession, path: str, queries: DataFrame, k1: float = 1.5, b: float = 0.75, n: int | None = None) -> DataFrame:
    """Queries (query_id, query) -> query_id, id, score of the chunks that share a word, of each query's ``n`` best where ``n`` is given (ties: least id).

    Negative idf values are replaced by a floor times the mean idf of all words; a word counts as often as the query holds it. Requests whose words the index
    doesn't hold have no row. With ``n``, blocks that can't matter are not read; see ``cells``.
    """
    asked, words = asked_words(spark, path, queries)
    postings = held(spark.read.parquet(f"{path}/postings"), words).join(asked, "word")
    if n is None:
        return scores(postings, k1, b)
    asked = durable(asked, "asked")
    every, kept = cells(spark, path, asked, words, k1, b, n)
    return first_n_per(scores(in_cells(postings_of(spark, path, asked, words), every, kept), k1, b), ["query_id"], [F.col("score").desc(), "id"], n)


def postings_of(spark: SparkSession, path: str, asked: DataFrame, words: list[str] | None) -> DataFrame:
    return held(spark.read.parquet(f"{path}/postings"), words).join(asked, "word")


def needed_blocks(every: DataFrame, kept: DataFrame) -> DataFrame:
    """(query_id, word, segment, block) that hold a cell of ``kept`` (query_id, cell); ``every``: a query's words with their bits by segment."""
    splits = every.select("query_id", "word", "segment", "bits").distinct()
    return kept.select("query_id", "cell").join(splits, "query_id").select("query_id", "word", "segment", F.col("cell").bitwiseAND(low_bits("bits")).alias("block")).distinct()


def in_cells(postings: DataFrame, every: DataFrame, kept: DataFrame) -> DataFrame:
    """Postings of the blocks that hold a cell of ``kept``, with only the chunks of such cells."""
    blocks = durable(needed_blocks(every, kept), "blocks")
    few = [r.block for r in blocks.select("block").distinct().limit(PUSHED_WORDS + 1).collect()]
    if len(few) <= PUSHED_WORDS:
        postings = postings.where(F.col("block").isin(few))
    whole = postings.join(blocks, ["query_id", "word", "segment", "block"], "left_semi")
    width = kept.groupBy("query_id").agg(F.max("width").alias("width"))
    each = whole.join(width, "query_id").select("query_id", "word", "times", "idf", "mean", "width", F.explode("chunks").alias("x")).withColumn("cell", hash_of(F.col("x.id")).bitwiseAND(low_bits("width")))
    return each.join(kept.select("query_id", "cell"), ["query_id", "cell"], "left_semi").withColumn("chunks", F.array("x"))


def split_words(spark: SparkSession, path: str, asked: DataFrame, words: list[str] | None) -> DataFrame:
    """(query_id, word, segment, bits, width) of a query's words; ``width``: bits of its most split word, which are those of its cells."""
    each = postings_of(spark, path, asked, words).select("query_id", "word", "segment", "bits").distinct()
    return each.join(each.groupBy("query_id").agg(F.max("bits").alias("width")), "query_id")


def cell_bounds(postings: DataFrame, every: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, cell, width, bound): no chunk of a cell has a larger score. For words as split as the cells the blocks' maxima tell; of the others, which are rarer, the chunks themselves."""
    each = postings.join(every.select("query_id", "word", "segment", "width"), ["query_id", "word", "segment"])
    above = lambda tf, length: F.greatest(F.lit(0.0), part(tf, length, k1, b)).alias("bound")
    whole = each.where("bits = width").select("query_id", "width", "word", F.col("block").alias("cell"), above(F.col("most"), F.col("shortest")))
    rarer = each.where("bits < width").select("query_id", "width", "word", "times", "idf", "mean", F.explode("chunks").alias("x"))
    exact = rarer.select("query_id", "width", "word", hash_of(F.col("x.id")).bitwiseAND(low_bits("width")).alias("cell"), above(F.col("x.tf"), F.col("x.len")))
    per_word = whole.union(exact).groupBy("query_id", "width", "cell", "word").agg(F.max("bound").alias("bound"))
    return per_word.groupBy("query_id", "width", "cell").agg(F.sum("bound").alias("bound"))


def cells(spark: SparkSession, path: str, asked: DataFrame, words: list[str] | None, k1: float, b: float, n: int, first: int = FIRST_CELLS) -> tuple[DataFrame, DataFrame]:
    """(``split_words``, (query_id, cell, width) of the cells that may hold one of a query's ``n`` best chunks)."""
    every = durable(split_words(spark, path, asked, words), "splits")
    bounds = durable(cell_bounds(postings_of(spark, path, asked, words), every, k1, b), "cells")
    best = durable(first_n_per(bounds, ["query_id"], [F.col("bound").desc(), "cell"], first), "first")
    tried = scores(in_cells(postings_of(spark, path, asked, words), every, best), k1, b)
    enough = first_n_per(tried, ["query_id"], [F.col("score").desc(), "id"], n).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
    # sums in another order may differ in the last digits
    may = F.col("found").isNull() | (F.col("found") < n) | (F.col("bound") >= F.col("least") - F.abs("least") * 1e-9)
    return every, bounds.join(enough, "query_id", "left").where(may).select("query_id", "cell", "width")
