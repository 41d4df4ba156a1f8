"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: each slot holds a bit for every language (bit-sliced), so that the AND of an
n-gram's slots is the set of all languages that contain it. A text's n-grams vote with these masks; each language's count is corrected for
the false positives that its fill of the filter lets expect, and the largest corrected count decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, fold, map_arrow, materialise, table

GRAM = 4
HASHES = 3
SLOTS = 1 << 20
#: An n-gram belongs to a language if it makes up this share of the language's n-grams: at most 1 / SHARE n-grams each.
SHARE = 2e-5
#: n-grams of a task are summed up whenever so many have gathered.
GATHER = 2_000_000
#: All bytes but ASCII letters and those of other scripts become a blank.
KEEP = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def grams(text: bytes) -> np.ndarray:
    """Codes of the 4-byte n-grams of the letters, blanks between words included."""
    data = np.frombuffer(b" " + text.translate(KEEP) + b" ", np.uint8).astype(np.uint32)
    data = data[np.concatenate(([True], (data[1:] != 32) | (data[:-1] != 32)))]
    if len(data) < GRAM:
        return np.zeros(0, np.uint32)
    return data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]


def lower(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows with a language; each task sums before it passes anything on."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold_in(lang):
            keys, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            if lang in sums:
                both, back = np.unique(np.concatenate([keys, sums[lang][0]]), return_inverse=True)
                keys, n = both, np.bincount(back, weights=np.concatenate([n, sums[lang][1]])).astype(np.int64)
            sums[lang] = keys, n

        def out():
            for lang, (keys, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams(lower(text)))
            for lang in [k for k, v in held.items() if sum(map(len, v)) > GATHER]:
                fold_in(lang)
            if sum(len(k) for k, _ in sums.values()) > 2 * GATHER:
                yield from out()
                sums.clear()
        for lang in list(held):
            fold_in(lang)
        yield from out()

    return map_arrow(docs.where(F.col("lang").isNotNull()).select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def slots_of(gram: np.ndarray, slots: int = SLOTS) -> list[np.ndarray]:
    """The n-gram's slots by double hashing."""
    x = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = x >> np.uint64(32), (x ^ x >> np.uint64(29)) & np.uint64(0xFFFFFFFF) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


class LanguageFilters:
    """The bit-sliced filter (slots x words of 64 languages) and each language's false-positive rate."""

    def __init__(self, langs: list[str], kept: dict[str, np.ndarray], prior: list[int], slots: int = SLOTS):
        self.langs, self.slots = langs, slots
        self.common = langs[int(np.argmax(prior))] if langs else "und"
        self.bits = np.zeros((slots, max(1, -(-len(langs) // 64))), np.uint64)
        self.false = np.zeros(len(langs))
        for i, lang in enumerate(langs):
            where = np.unique(np.concatenate(slots_of(kept[lang], slots)))
            self.bits[where, i // 64] |= np.uint64(1 << i % 64)
            self.false[i] = (len(where) / slots) ** HASHES

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram."""
        first, *rest = slots_of(gram, self.slots)
        got = self.bits[first]
        for s in rest:
            got = got & self.bits[s]
        return got

    def counts(self, gram: np.ndarray) -> np.ndarray:
        """Corrected number of the n-grams that each language contains."""
        hits, n = np.zeros(len(self.langs)), len(gram)
        for start in range(0, n, 1 << 18):
            got = self.masks(gram[start : start + (1 << 18)])
            for i in range(len(self.langs)):
                hits[i] += np.count_nonzero(got[:, i // 64] & np.uint64(1 << i % 64))
        return np.maximum(hits - n * self.false, 0) / np.maximum(1 - self.false, 1e-9)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the best count's share of the best two; 0.5 without evidence. ``und``: no letter."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        counts = self.counts(grams(lower(text)))
        best = int(np.argmax(counts))
        if counts[best] <= 0:
            return self.common, 0.5
        second = float(np.partition(counts, -2)[-2]) if len(counts) > 1 else 0.0
        return self.langs[best], float(counts[best] / (counts[best] + second))


def learn(docs: DataFrame, share: float = SHARE, slots: int = SLOTS) -> LanguageFilters:
    """Filters from all rows of ``docs`` with a language. At most 1 / share n-grams of each language come to the driver."""
    counts = materialise(gram_counts(docs), "grams")
    sums = {r.lang: r.n for r in docs.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_ = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    kept = counts.join(F.broadcast(all_), "lang").where(F.col("n") >= F.col("all") * share).select("lang", "gram").toPandas()
    langs = sorted(sums)
    return LanguageFilters(langs, {x: kept.gram[kept.lang == x].to_numpy(np.int64) for x in langs}, [sums[x] for x in langs], slots)


def predict(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # slots x 8 bytes for 64 languages

    def run(batches):
        model = shared.value
        for batch in batches:
            got = [model.predict(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text")
    return map_arrow(rows, run, T.StructType([field(docs, "doc_id"), *T._parse_datatype_string("held_out boolean, lang_pred string, score double")]))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose fold is not 0 and predict all.

    Null and empty texts and texts without a letter are ``und`` with score 0; with nothing to learn from all are.
    Repeated rows are predicted each.
    """
    return predict(docs, learn(docs.where(fold("doc_id") != 0)))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
