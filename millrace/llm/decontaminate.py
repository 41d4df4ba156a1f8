"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

Every window of a document that is as long as some benchmark item gets a SimHash over its 5-word shingles. Item fingerprints are
indexed in five blocks of bits; two fingerprints within 19 bits differ by at most 3 in one of the blocks, so probing
each block with all changes of up to 3 bits finds every item within the radius. Candidates are verified by the weighted
Jaccard similarity of their shingles (weight: how often a shingle occurs). Windows that can't reach the bar whatever the item, since too
few of their shingles occur in the benchmark at all, are passed over; that loses nothing. A document shorter than an item is one window.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from .common import field, map_arrow, table, text_bytes

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCK_BITS = 19, (13, 13, 13, 13, 12)
#: Text of the benchmark items that are held by each task at once; a larger benchmark is gone through in blocks.
BLOCK_CHARS = 16 << 20
CACHE_WORDS = 400_000
#: Words of a document whose window fingerprints are computed together.
STRIDE = 1 << 16
EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHash(dict):
    """64-bit hash of a word in lower case without edge punctuation; 0 where nothing is left. Two generations are kept."""

    def __init__(self):
        super().__init__()
        self.older: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        got = self.older.get(word)
        if got is None:
            plain = word.lower().strip(EDGES)
            got = xxh64_intdigest(plain, 7) | 1 if plain else 0
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


#: A Python worker's words, kept across its tasks.
KNOWN = WordHash()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    h = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - width + 1 + j]
    return mixed(h)


def word_hashes(text: bytes, known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and for each its place among the runs between blanks."""
    parts = text.split()
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    at = np.flatnonzero(h)
    return h[at], at


def window_fingerprints(s: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the shingles s[start : start + n] for each start (ascending)."""
    out = np.zeros(len(starts), np.uint64)
    if len(starts):
        s, starts = s[starts[0] : starts[-1] + n], starts - starts[0]
    stride = max(STRIDE, 2 * n)
    for a in range(0, len(s), stride):
        some = (starts >= a) & (starts < a + stride)
        if some.any():
            part = s[a : a + stride + n]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
            at = starts[some] - a
            out[some] = np.packbits((sums[at + n] - sums[at]) * 2 > n, axis=1, bitorder="little").view("<u8").ravel()
    return out


class Benchmark:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[int | None, str | None]], radius: int = RADIUS, similarity: float = SIMILARITY):
        known = WordHash()
        self.radius, self.similarity = radius, similarity
        self.ids, self.words, self.counts, fps, every = [], [], [], [], []
        for item, text in items:
            h, _ = word_hashes((text or "").encode("utf-8", "surrogatepass"), known)
            if len(h):
                s = shingles(h, min(SHINGLE, len(h)))
                self.ids.append(item)
                self.words.append(len(h))
                self.counts.append(Counter(s.tolist()))
                fps.append(window_fingerprints(s, np.zeros(1, np.int64), len(s))[0])
                every.append(s)
        self.fps, self.lengths = np.array(fps, np.uint64), np.array(self.words, np.int64)
        self.sizes = sorted(set(self.words))
        # for each shingle width: the benchmark's shingles, and the item lengths in which each occurs
        self.every = {}
        for w in {min(n, SHINGLE) for n in self.words}:
            of = [(s, n) for s, n in zip(every, self.words, strict=True) if min(n, SHINGLE) == w]
            pairs = np.unique(np.stack([np.concatenate([s for s, _ in of]), np.concatenate([np.full(len(s), n, np.uint64) for s, n in of])], axis=1), axis=0)
            keys, first = np.unique(pairs[:, 0], return_index=True)
            self.every[w] = keys, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)
        self.probes, self.blocks, shift = [], [], 0
        within = radius // len(BLOCK_BITS)
        for bits in BLOCK_BITS:
            value = (self.fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.blocks.append((np.uint64(shift), bits, order, np.searchsorted(value[order], np.arange((1 << bits) + 1))))
            self.probes.append(np.array([sum(1 << i for i in c) for k in range(within + 1) for c in combinations(range(bits), k)], np.int64))
            shift += bits

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``fps``, item) of all pairs within the radius."""
        found = []
        for (shift, bits, order, bounds), probes in zip(self.blocks, self.probes, strict=True):
            value = (fps >> shift & np.uint64((1 << bits) - 1)).astype(np.int64)
            probe = value[:, None] ^ probes[None, :]
            a, n = bounds[probe], bounds[probe + 1] - bounds[probe]
            row = np.repeat(np.arange(len(fps)), n.sum(axis=1))
            a, n = a.ravel(), n.ravel()
            a, n = a[n > 0], n[n > 0]
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(row * len(self.fps) + order[at])
        pairs = np.unique(np.concatenate(found))
        row, item = np.divmod(pairs, max(1, len(self.fps)))
        close = np.bitwise_count(fps[row] ^ self.fps[item]) <= self.radius
        return row[close], item[close]

    def hits(self, text: bytes, known: WordHash) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, last word) of the best window for each item found; words counted between blanks."""
        h, at = word_hashes(text, known)
        best: dict[int, tuple[float, int]] = {}
        for width, (keys, bounds, lengths) in self.every.items():
            if len(h) < width:
                continue
            s = shingles(h, width)
            place = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == s)
            if not len(hit):
                continue
            spread = bounds[place[hit] + 1] - bounds[place[hit]]
            size_of = lengths[np.repeat(bounds[place[hit]] - (np.cumsum(spread) - spread), spread) + np.arange(spread.sum())]
            where = np.repeat(hit, spread)
            for size in np.unique(size_of).tolist():
                self.windows(s, where[size_of == size], size, width, best)
        return [(i, alike, int(at[a]), int(at[min(a + self.words[i], len(at)) - 1])) for i, (alike, a) in sorted(best.items())]

    def windows(self, s: np.ndarray, hit: np.ndarray, size: int, width: int, best: dict[int, tuple[float, int]]) -> None:
        """Look at the windows for items of ``size`` words; ``hit``: where shingles of such items are (ascending)."""
        n = size - width + 1
        m = min(n, len(s))  # shingles of a window: a shorter document is one whole
        need = int(np.ceil((m + n) * self.similarity / (1 + self.similarity) - 1e-9))  # shared shingles that the bar asks for
        if len(hit) < need:
            return
        # a window that reaches ``need`` can be taken to start within m before a hit
        starts = np.unique((hit[:, None] - np.arange(m)[None, :]).ravel()) if len(hit) * m < len(s) else np.arange(len(s) - m + 1)
        starts = starts[(starts >= 0) & (starts <= len(s) - m)]
        starts = starts[np.searchsorted(hit, starts + m) - np.searchsorted(hit, starts) >= need]
        for part in np.array_split(starts, max(1, -(-len(starts) // 4096))):
            if not len(part):
                continue
            row, item = self.near(window_fingerprints(s, part, m))
            for r, i in zip(row.tolist(), item.tolist(), strict=True):
                if self.words[i] == size:
                    a = int(part[r])
                    shared = sum(min(k, self.counts[i][x]) for x, k in Counter(s[a : a + m].tolist()).items() if x in self.counts[i])
                    alike = shared / (m + n - shared)
                    if alike >= self.similarity and (i not in best or (alike, -a) > (best[i][0], -best[i][1])):
                        best[i] = alike, a


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """The benchmark in blocks of about ``block_chars`` characters, each a broadcast."""
    spark = benchmark.sparkSession
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // block_chars + 1
    for b in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Benchmark([(r.item_id, r.text) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id if r.item_id is not None else 0, r.text or ""))]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, similarity, start, end (code points) of the best window of each document for each item found.

    Documents without a match have no row. Null and empty texts and items match nothing; an item shorter than a
    shingle is one shingle. Repeated rows are reported each.
    """
    schema = T.StructType([field(docs, "doc_id"), field(benchmark, "item_id"), *T._parse_datatype_string("similarity double, start long, end long")])
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for shared in blocks(benchmark, block_chars):

        def run(batches, shared=shared):
            known, bench = KNOWN, shared.value
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                    found = bench.hits(text, known)
                    if found:
                        spans = [m.span() for m in WORD.finditer(text)]
                        rows += [(doc, bench.ids[i], alike, len(text[: spans[a][0]].decode()), len(text[: spans[b][1]].decode())) for i, alike, a, b in found]
                kinds = (batch.schema.field(0).type, item_type, pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=schema.fieldNames())

        part = map_arrow(docs.select("doc_id", "text"), run, schema)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents without a window that matches a benchmark item; their columns and values stay as they are."""
    at = docs.columns.index("text")
    for shared in blocks(benchmark, block_chars):

        def run(batches, shared=shared):
            known, bench = KNOWN, shared.value
            for batch in batches:
                yield batch.filter(pa.array([not bench.hits(x, known) for x in text_bytes(batch.column(at))], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
