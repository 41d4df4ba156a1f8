"""Harmonic packing of token sequences.

A document is cut into pieces whose lengths are reciprocal parts of the capacity C: full pieces of C, then
repeatedly the longest ``C // i`` that fits, down to a rest shorter than ``C // LAST_CUT``, which stays as it is. All pieces of a length l are a
class, and each sequence of the class takes exactly ``C // l`` of them, so that a piece's sequence and offset follow
from its number within the class alone and workers fill their sequences independently.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_arrow, materialise, table
from .numbering import gapless

CAPACITY = 2048
END_ID = 1
#: Rests shorter than C // LAST_CUT are not cut further.
LAST_CUT = 24
#: Runs whose ids a Python worker keeps in each of two generations, across its tasks.
CACHE_WORDS = 500_000
#: Runs of letters that are encoded as one text.
TOGETHER = 256
#: Letters with ASCII punctuation on either side; an apostrophe ahead of letters may be the start of a contraction.
RUN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([^\W\d_]*)([!-/:-@\[-`{-~]*)")
#: Beyond these, the case of a letter may depend on its neighbours, or marks may combine with it.
OTHER_LETTERS = re.compile("[^\x00-\u012f\u0131-\u017f]")


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, longest first."""
    pieces = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        i = -(-capacity // rest)
        if i > 1 and capacity // (i - 1) <= rest:  # C // i also rounds down
            i -= 1
        size = capacity // i if i <= LAST_CUT else rest
        pieces.append(size)
        rest -= size
    return pieces


class WordIds:
    """Ids (as little-endian bytes) of runs of text between blanks. White space always ends a token of this vocabulary.

    New runs of a batch are encoded together. Most are letters with ASCII punctuation around them, and the vocabulary cuts a run at these
    places; the letters of many runs are encoded as one text and told apart by the tokens that end a word. All other runs are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def alone(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, cores: list[str]) -> None:
        """Encode runs of letters, each of which is one word to the vocabulary unless its letters are not letters there."""
        groups = [cores[a : a + TOGETHER] for a in range(0, len(cores), TOGETHER)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(cuts) == len(group) and (not len(ids) or (ids < len(self.ends)).all() and cuts[-1] == len(ids)):
                data = ids.tobytes()
                self.known |= {core: data[4 * a : 4 * b] for core, a, b in zip(group, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)}
            else:
                self.known |= {core: self.alone(core) for core in group}

    def learn(self, runs: set[str]) -> set[str]:
        """Make ``runs`` known; all that became known with them."""
        known, older = self.known, self.older
        parts = []
        for run in runs:
            if run in older:
                known[run] = older[run]
            elif (m := RUN.fullmatch(run)) and "<|" not in run:  # special tokens stay whole
                parts.append((run, *m.groups()))
            else:
                known[run] = self.alone(run)
        cores = {core for _, _, core, _ in parts if core and core not in known}
        self.letters(list(cores))
        for run, *pieces in parts:
            if run not in known:
                known |= {x: self.alone(x) for x in pieces if x not in known}
                known[run] = b"".join([known[x] for x in pieces]) if pieces[1] else self.alone(run)
        return runs | cores

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        runs = [self.plain(x).replace("\n", " ").split(" ") for x in texts]
        fresh = self.learn(set().union(*runs).difference(self.known))
        out = [b"".join(map(self.known.__getitem__, r)) for r in runs]
        for run in fresh:
            if len(run) > 64:
                self.known.pop(run, None)
        if len(self.known) >= CACHE_WORDS:
            self.known, self.older = {"": b""}, self.known
        return out

    @staticmethod
    def plain(text: str) -> str:
        """In lower case, as the vocabulary's normaliser would have it, where that is the same for each letter by itself; special tokens are told by their case."""
        return text if "<|" in text or not text.isascii() and OTHER_LETTERS.search(text) else text.lower()


WORDS: dict[str, WordIds] = {}


def word_ids(path: str | None) -> WordIds:
    """The worker's vocabulary; without a path the public 49k word-end BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in WORDS:
        WORDS[path] = WordIds(path)
    return WORDS[path]


def piece_table(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches):
        words, end = word_ids(vocabulary), END_ID.to_bytes(4, "little")
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, found in zip(batch.column(0), words.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids = found + end
                n, start, view = len(ids) // 4, 0, memoryview(ids)
                for size in cut(n, capacity):
                    for column, x in zip(rows, (doc, start, size, zlib.crc32(view[4 * start : 4 * (start + size)]), n), strict=True):
                        column.append(x)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(0).type), *[pa.array(x, pa.int64()) for x in rows[1:]]], names=schema.fieldNames())

    schema = T.StructType([field(docs, "doc_id"), *[T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens")]])
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def merge_last(last: list[tuple[int, int]], capacity: int) -> dict[int, tuple[int, int]]:
    """Where the pieces of the classes' unfilled last sequences go: class -> (sequence of the merged ones, offset).

    ``last``: (class, ids) of at most one sequence a class; first fit by decreasing ids.
    """
    used: list[int] = []
    where = {}
    for length, ids in sorted(last, key=lambda x: (-x[1], x[0])):
        at = next((i for i, u in enumerate(used) if u + ids <= capacity), len(used))
        used[at:] = used[at:] or [0]
        where[length] = (at, used[at])
        used[at] += ids
    return where


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: each id of each document lies in exactly one piece.

    Pieces are numbered within the class of their length l; with i = C // l, number // i is the sequence and (number mod i) l the offset.
    The last, unfilled sequence of each class (there are about a hundred classes, whatever the input) is merged with those of
    other classes. A null text is a document of the end id alone; repeated rows are packed each; an empty table gives no pieces.
    """
    pieces = materialise(piece_table(docs, vocabulary, capacity), "pieces")
    totals = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()  # a row a class
    where = merge_last([(r.length, r.n % (capacity // r.length) * r.length) for r in totals if r.n % (capacity // r.length)], capacity)
    full, plan = 0, []
    for r in totals:
        plan.append((r.length, full, r.n // (capacity // r.length)))
        full += plan[-1][2]
    plan = [(k, base, whole, full + where[k][0] if k in where else 0, where[k][1] if k in where else 0) for k, base, whole in plan]
    classes = F.broadcast(docs.sparkSession.createDataFrame(plan, "length long, base long, whole long, last_id long, last_offset long"))
    per_bin = F.floor(F.lit(capacity) / F.col("length"))
    placed = gapless(pieces, "length", ["doc_id", "start", "length", "ids_crc32"], "number").join(classes, "length").withColumn("bin", F.floor(F.col("number") / per_bin))
    merged = F.col("bin") >= F.col("whole")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(merged, F.col("last_id")).otherwise(F.col("base") + F.col("bin")).cast("long").alias("sequence_id"),
        (F.pmod(F.col("number"), per_bin) * F.col("length") + F.when(merged, F.col("last_offset")).otherwise(0)).cast("long").alias("offset"),
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
