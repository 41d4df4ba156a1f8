"""Phrases that stick together, counted on FM-indexes.

Each task cuts its texts into shards of one language, as sequences of word ids with a mark between pieces. A shard gets an FM-index of its sequence and one
of the sequence read backwards: Burrows-Wheeler transforms sorted by DEPTH words, as no phrase is longer. A phrase is an interval in both. A word
put in front is a step in the first index, a word behind it a step in the second, so the intervals give how often a phrase, and a phrase with any
word before or behind it, occurs in the shard.

Shards are extended level by level. A phrase that is frequent in all shards together consists of two frequent phrases that are one word shorter; so a level
only looks at extensions of phrases whose sums over the shards reached the bar. A shard deals its distinct phrases with their counts out to buckets by hash, packed; a bucket
sums the shards and answers each with those of its phrases that reach the bar.
"""

from __future__ import annotations

import uuid
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import files, map_arrow, materialise, new_path, table, text_bytes

DEPTH, LEAST, TOP = 4, 30, 2000
#: A phrase goes if a longer one makes up so many hundredths of its occurrences.
ABSORBED = 80
#: Words of a shard; it ends with the document that reaches them.
SHARD_WORDS = 3_000_000
#: Words of the corpus to a bucket: at most as many phrases with their counts meet in a task at once.
BUCKET_WORDS = 1_500_000
#: What the symbols of an index stand for below the first word: a mark between pieces, words too rare for any phrase.
MARK, RARE, FIRST = 0, 1, 2

#: Separators become 0xFF, which UTF-8 has nowhere; tabs blanks.
TO_MARKS = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))


class WordIds(dict):
    """Words by number, in the order in which they come; 0 is the mark."""

    def __init__(self):
        super().__init__({b"\xff": MARK})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_sequence(text: bytes, known: WordIds) -> np.ndarray:
    """Ids of the words of a text, a mark behind each piece that has words."""
    parts = text.lower().translate(TO_MARKS).replace(b"\xff", b" \xff ").split()
    ids = np.fromiter(map(known.__getitem__, parts), np.int32, len(parts))
    ids = np.append(ids, np.int32(MARK))
    return ids[(ids != MARK) | (np.concatenate(([MARK], ids[:-1])) != MARK)]


def ranked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each place) by pairs; equal pairs have equal ranks, and their places ascend."""
    n = len(first)
    bits = max(int(n).bit_length(), int(first.max()).bit_length(), int(second.max()).bit_length()) if n else 0
    if 3 * bits <= 63:
        packed = first.astype(np.int64) << 2 * bits | second.astype(np.int64) << bits | np.arange(n)
        packed.sort()
        order, key = packed & ((1 << bits) - 1), packed >> bits
        new = np.concatenate(([False], key[1:] != key[:-1]))
    else:
        order = np.lexsort((second, first))
        new = np.concatenate(([False], (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def transform(s: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of a circular sequence, sorted by DEPTH = 4 symbols."""
    _, pairs = ranked(s, np.roll(s, -1))
    order, _ = ranked(pairs, np.roll(pairs, -2))
    return s[order - 1]


class FMIndex:
    """Intervals of patterns of up to DEPTH symbols; ``step`` puts a symbol in front."""

    def __init__(self, bwt: np.ndarray):
        self.bwt, self.n = bwt, len(bwt)
        # occurrences of each symbol, ascending: the k-th key is where the k-th of the sorted symbols stands in the transform
        self.keys = np.sort(bwt.astype(np.int64) * (self.n + 1) + np.arange(self.n))
        self.words = np.concatenate(([0], np.cumsum(bwt != MARK)))

    def step(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = c * (self.n + 1)
        return np.searchsorted(self.keys, at + lo), np.searchsorted(self.keys, at + hi)

    def find(self, symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns; ``symbols``: their last symbols first."""
        lo, hi = np.zeros(len(symbols[0]), np.int64), np.full(len(symbols[0]), self.n)
        for c in symbols:
            lo, hi = self.step(lo, hi, c)
        return lo, hi

    def extended(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many occurrences of each interval's pattern have a word in front."""
        return self.words[hi] - self.words[lo]

    def extensions(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, pattern, prefix, count) of all words in front of disjoint patterns of one length, where the new pattern without its last symbol (the prefix) is among them too."""
        size = hi - lo
        at = np.full(self.n, -1, np.int64)
        at[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(np.arange(len(lo)), size)
        symbol, place = np.divmod(self.keys, self.n + 1)
        pattern = at[place]
        k = np.flatnonzero((pattern >= 0) & (at >= 0) & (symbol >= FIRST))  # the new pattern's interval starts at its first k, which lies in its prefix's
        new = np.flatnonzero(np.concatenate(([True], (symbol[k[1:]] != symbol[k[:-1]]) | (pattern[k[1:]] != pattern[k[:-1]])))) if len(k) else k
        first = k[new]
        return symbol[first], pattern[first], at[first], np.diff(np.append(new, len(k)))


class Shard:
    """Both indexes of a shard, and the ids of its frequent words, ascending: symbol FIRST + i stands for the i-th."""

    def __init__(self, words: np.ndarray, bwt: np.ndarray, back: np.ndarray):
        self.words, self.forward, self.backward = words, FMIndex(bwt), FMIndex(back)

    def extend(self, live: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """(words, counts) of phrases one word longer; ``live``: a column of word ids for each place of the phrases."""
        symbols = [np.searchsorted(self.words, w) + FIRST for w in live]
        c, pattern, _, n = self.forward.extensions(*self.forward.find(symbols[::-1]))
        return [self.words[c - FIRST], *[w[pattern] for w in live]], n

    def around(self, live: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """How many occurrences of each phrase have a word before, and behind, it."""
        symbols = [np.searchsorted(self.words, w) + FIRST for w in live]
        return self.forward.extended(*self.forward.find(symbols[::-1])), self.backward.extended(*self.backward.find(symbols))


def write_arrays(folder: str, name: str, *arrays: np.ndarray) -> str:
    """Arrays in a file of their own in the shared folder; its path, under that folder's URI."""
    from zstandard import ZstdCompressor

    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    system, at = files(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as out:
        for x in arrays:
            data = ZstdCompressor(level=1).compress(x.tobytes())
            out.write(len(data).to_bytes(8, "little") + data)
    return path


def read_arrays(path: str, *kinds: str) -> list[np.ndarray]:
    from zstandard import ZstdDecompressor

    system, at = files(path)
    with system.open_input_stream(at) as f:
        return [np.frombuffer(ZstdDecompressor().decompress(f.read(int.from_bytes(f.read(8), "little"))), k) for k in kinds]


def pack(columns_: list[np.ndarray]) -> bytes:
    """Columns of longs, byte by byte, so that the bytes that are zero throughout take no room."""
    from zstandard import ZstdCompressor

    planes = np.stack([np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8) for c in columns_], axis=0)
    return ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes())


def unpack(data: bytes, width: int) -> np.ndarray:
    """The columns as an array."""
    from zstandard import ZstdDecompressor

    planes = np.frombuffer(ZstdDecompressor().decompress(data), np.uint8).reshape(width, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[:, :, 0]


def mixed(words: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, lang, words, counts, path): each shard's words with their counts, and the file of its sequence."""
    folder = new_path(docs.sparkSession, "sequences")

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        open_: dict[str, tuple[WordIds, list[np.ndarray], list[int]]] = {}

        def closed(lang: str):
            nonlocal made
            known, parts, _ = open_.pop(lang)
            s = np.concatenate([np.array([MARK], np.int32), *parts])
            shard, made = task << 32 | made, made + 1
            counts = np.bincount(s, minlength=len(known))[1:]
            words = pa.ListArray.from_arrays(pa.array([0, len(known) - 1], pa.int32()), pa.array(list(known)[1:], pa.binary()))
            counts = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([lang], pa.string()), words, counts, pa.array([write_arrays(folder, str(shard), s)])], names=["shard", "lang", "words", "counts", "path"])

        for batch in batches:
            for text, lang in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                known, parts, size = open_.setdefault(lang, (WordIds(), [], [0]))
                parts.append(word_sequence(text, known))
                size[0] += len(parts[-1])
                if size[0] >= shard_words:
                    yield closed(lang)
            if sum(size[0] for _, _, size in open_.values()) >= 2 * shard_words:  # many languages at once
                yield closed(max(open_, key=lambda x: open_[x][2][0]))
        for lang in list(open_):
            if open_[lang][2][0]:
                yield closed(lang)

    each = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return materialise(map_arrow(each, run, "shard long, lang string, words array<binary>, counts array<long>, path string"), "shards")


def indexed(made: DataFrame, frequent: DataFrame) -> DataFrame:
    """(shard, lang, path): the file of each shard's indexes. ``frequent``: lang, word, id."""
    folder = new_path(made.sparkSession, "indexes")
    each = made.select("shard", "lang", F.posexplode("words").alias("place", "word")).join(frequent.select("lang", "word", "id"), ["lang", "word"])
    live = each.groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("live"))  # at most a shard's words

    def run(batches):
        for batch in batches:
            out = []
            for k, (shard, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                place, ids = (x.to_numpy() for x in batch.column(2)[k].values.flatten())
                (s,) = read_arrays(path, "<i4")
                order = np.argsort(ids)
                symbol = np.full(int(s.max()) + 1, RARE, np.int32)
                symbol[MARK] = MARK
                symbol[place[order] + 1] = np.arange(FIRST, FIRST + len(ids))
                s = symbol[s]
                out.append(write_arrays(folder, str(shard), ids[order].astype("<i8"), transform(s).astype("<i4"), transform(s[::-1]).astype("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("lang"), pa.array(out, pa.string())], names=["shard", "lang", "path"])

    return materialise(map_arrow(dealt(made.select("shard", "path", "lang").join(live, "shard").select("shard", "path", "live", "lang")), run, "shard long, lang string, path string"), "indexes")


def dealt(rows: DataFrame) -> DataFrame:
    """A row a shard, dealt out so that tasks get a few each."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "shard")


def columns(size: int) -> list[str]:
    return [f"w{i + 1}" for i in range(size)]


def level(index: DataFrame, size: int, buckets: int, live: DataFrame | None = None) -> DataFrame:
    """(bucket, shard, data): phrases of ``size`` words of every shard and their counts. ``live`` (shard, data): phrases one word shorter, of which both parts must be; without it all frequent words are."""
    words_only = live is None

    def run(batches):
        for batch in batches:
            for k, (shard, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = Shard(*read_arrays(path, "<i8", "<i4", "<i4"))
                of = [own.words] if words_only else list(np.concatenate([unpack(x, size - 1) for x in batch.column(2)[k].values.to_pylist()], axis=1))
                words, n = own.extend(of)
                bucket = (mixed(words) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((*words[::-1], bucket))
                bucket, table = bucket[order], [c[order] for c in (*words, n)]
                first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(n) else np.zeros(0, np.int64)
                data = [pack([c[a:b] for c in table]) for a, b in pairwise(np.append(first, len(n)).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(np.full(len(first), shard)), pa.array(data, pa.binary())], names=["bucket", "shard", "data"])

    rows = index.select("shard", "path") if live is None else index.select("shard", "path").join(live.groupBy("shard").agg(F.collect_list("data").alias("live")), "shard")  # a shard's own
    return map_arrow(dealt(rows), run, "bucket int, shard long, data binary")


def frequent_phrases(counts: DataFrame, size: int, least: int) -> DataFrame:
    """Sums over the shards of a level's counts: a row (w1, ..., f) for each phrase that reaches ``least``, and a row (shard, data) with those that a shard has in a bucket."""
    names = columns(size)
    schema = ", ".join(f"{c} long" for c in (*names, "f", "shard")) + ", data binary"

    def summed(held: list[tuple[int, bytes]]):
        parts = [unpack(x, size + 1) for _, x in held]
        table = np.concatenate(parts, axis=1)
        of = np.repeat(np.arange(len(parts)), [x.shape[1] for x in parts])
        order = np.lexsort(table[-2::-1])
        table, of = table[:, order], of[order]
        first = np.flatnonzero(np.concatenate(([True], (table[:-1, 1:] != table[:-1, :-1]).any(axis=0))))
        f = np.add.reduceat(table[-1], first)
        keep = f >= least
        whole = first[keep]
        none = pa.nulls(len(whole), pa.int64())
        yield pa.RecordBatch.from_arrays([*[pa.array(c[whole]) for c in table[:-1]], pa.array(f[keep]), none, pa.nulls(len(whole), pa.binary())], names=[*names, "f", "shard", "data"])
        kept = np.repeat(keep, np.diff(np.append(first, table.shape[1])))
        table, of = table[:-1, kept], of[kept]
        by = np.argsort(of, kind="stable")
        table, of = table[:, by], of[by]
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else of
        data = [pack(list(table[:, a:b])) for a, b in pairwise(np.append(starts, len(of)).tolist())]
        none = pa.nulls(len(data), pa.int64())
        yield pa.RecordBatch.from_arrays([*[none] * (size + 1), pa.array([held[k][0] for k in of[starts].tolist()], pa.int64()), pa.array(data, pa.binary())], names=[*names, "f", "shard", "data"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            for bucket, shard, data in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                if bucket != now and held:
                    yield from summed(held)
                    held = []
                now = bucket
                held.append((shard, data))
        if held:
            yield from summed(held)

    return map_arrow(counts.repartition("bucket").sortWithinPartitions("bucket"), run, schema)


def surroundings(index: DataFrame, results: DataFrame) -> DataFrame:
    """(w1, ..., before, behind) of some phrases (lang, w1, ..., missing words null), a bounded number of each language: occurrences with a word before, and behind, them."""
    names = columns(DEPTH)
    asked = results.groupBy("lang").agg(F.collect_list(F.struct(*[F.coalesce(c, F.lit(-1)).alias(c) for c in names])).alias("asked"))

    def run(batches):
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                own = Shard(*read_arrays(path, "<i8", "<i4", "<i4"))
                table = np.stack([x.to_numpy() for x in batch.column(1)[k].values.flatten()])
                known = np.isin(table, own.words) | (table < 0)
                table = table[:, known.all(axis=0)]
                for size in range(2, DEPTH + 1):
                    mine = table[:, (table >= 0).sum(axis=0) == size]
                    before, behind = own.around(list(mine[:size]))
                    words = [pa.array(c) if i < size else pa.nulls(mine.shape[1], pa.int64()) for i, c in enumerate(mine)]
                    yield pa.RecordBatch.from_arrays([*words, pa.array(before), pa.array(behind)], names=[*names, "before", "behind"])

    each = map_arrow(dealt(index.join(asked, "lang").select("path", "asked", "shard")).select("path", "asked"), run, ", ".join(f"{c} long" for c in (*names, "before", "behind")))
    return each.groupBy(*names).agg(F.sum("before").alias("before"), F.sum("behind").alias("behind"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, before, behind: the ``top`` phrases of 2 to 4 words of each language.

    Phrases with a >= ``least`` occurrences are cut where floor(2000000 a / (l + r)) is lowest, ties at the first place; those that lie in a longer
    phrase with at least 80 hundredths of their occurrences go. ``before`` and ``behind``: occurrences with a word on that side in the same piece. A null
    language is ``und``, a null text empty; repeated rows count each. Without a frequent phrase there is no row.
    """
    made = shards(docs, shard_words)
    each = made.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    sums = materialise(each.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = sums.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = materialise(sums.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "frequent")
    index = indexed(made, frequent)
    found = {1: frequent.select("lang", F.col("id").alias("w1"), "f", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))}
    buckets = int((totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS) + 1
    live = None
    for size in range(2, DEPTH + 1):
        names = columns(size)
        got = materialise(frequent_phrases(level(index, size, buckets, live), size, least), f"level{size}")
        live = got.where(F.col("shard").isNotNull()).select("shard", "data")
        shorter = found[size - 1]
        head = shorter.select(*names[:-1], "lang", F.col("phrase").alias("__head"), F.col("heads").alias("__heads"))
        tail = shorter.select(*[F.col(a).alias(b) for a, b in zip(columns(size - 1), names[1:], strict=True)], "last", F.col("tails").alias("__tails"))
        own = got.where(F.col("shard").isNull()).select(*names, "f").join(head, names[:-1]).join(tail, names[1:])
        whole = own.select("lang", *names, "f", F.concat_ws(" ", "__head", "last").alias("phrase"), "last", F.concat("__heads", F.array("f")).alias("heads"), F.concat("__tails", F.array("f")).alias("tails"))
        found[size] = materialise(whole, f"phrases{size}")

    out = None
    for size in range(2, DEPTH + 1):
        names, own = columns(size), found[size]
        if size < DEPTH:
            longer = columns(size + 1)
            within = [found[size + 1].select(*[F.col(a).alias(b) for a, b in zip(longer[k : k + size], names, strict=True)], F.col("f").alias("in")) for k in (0, 1)]
            most = within[0].union(within[1]).groupBy(*names).agg(F.max("in").alias("in"))
            own = own.join(most, names, "left").where(F.coalesce(F.col("in") * 100 < F.col("f") * ABSORBED, F.lit(True)))
        cuts = F.array(*[F.struct(F.expr(f"2000000BD * CAST(f AS DECIMAL(20, 0)) div CAST(heads[{k - 1}] + tails[{size - k - 1}] AS DECIMAL(20, 0))").alias("score"), F.lit(k).alias("k"), F.get("heads", F.lit(k - 1)).alias("l"), F.get("tails", F.lit(size - k - 1)).alias("r")) for k in range(1, size)])
        words = [F.col(f"w{i + 1}") if i < size else F.lit(None).cast("long").alias(f"w{i + 1}") for i in range(DEPTH)]
        part = own.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score", *words)
        out = part if out is None else out.union(part)

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))  # so that a language's phrases never meet in one task unless among the first
    firsts = out.withColumn("__k", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("__k") <= top)
    last = materialise(firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top), "best")
    around = surroundings(index, last).withColumnsRenamed({c: f"__{c}" for c in columns(DEPTH)})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns(DEPTH)]
    return last.join(around, same).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "before", "behind")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
