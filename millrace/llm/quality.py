"""Quality rules: statistics of each text, an isolation forest over them, a threshold calibrated on labelled rows.

A tree splits a small sample of documents at random: a random statistic, a random value within its range in the node. Few splits set an odd
document apart, so short paths over many trees mean an anomaly. The score is 2 ^ -(mean path length / expected length), between 0 and 1.
The threshold is the score that drops the most labelled junk while it drops no more than MOST_LOST of the labelled good documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_arrow, materialise, table, text_bytes

#: Trees, and labelled documents that each of them splits: the forest is fitted on at most TREES * SAMPLE labelled rows.
TREES, SAMPLE, SEED = 200, 256, 13
#: Splits from root to leaf.
DEPTH = 8
#: Share of the labelled good documents that the threshold may drop.
MOST_LOST = 0.001
#: Scores are calibrated in steps of 1 / STEPS.
STEPS = 10_000
#: The fixed rules.
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 0.2

BLANKS, SYMBOLS, STOPS, LATER = (np.frombuffer(x, np.uint8) for x in (b" \t\n\x0b\x0c\r", b"#*$%&|<>", b".,;:!?", bytes(range(0x80, 0xC0))))
#: A word of these alone is bare.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees: symbols a character, bare words a word, bytes of the median word, log of distinct words by log of words, stops a word.
FEATURES = ("symbols", "bare", "word_length", "distinct", "stops")
#: A text of so many words counts half: its statistics are drawn to the middle of the sample's, as few words say little.
HALF_WORDS = 20


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int = WINDOW) -> np.ndarray:
    """For each document the number of its words in a window of ``width`` words (5) that it holds twice or more.

    ``words``: ids of the words of all documents one after another; ``doc``: the document of each. Windows are numbered exactly:
    runs of one, two and four words by pairs of runs half as long, then the last word is added.
    """
    run, have = words, 1
    while have < width:
        step = min(have, width - have)
        if len(run) <= step:
            return np.zeros(n_docs, np.int64)
        more = run[step:]
        run = np.unique(run[: len(more)] * (int(run.max()) + 1) + more, return_inverse=True)[1].astype(np.int64)
        have += step
    whole = doc[: len(run)] == doc[width - 1 :]
    at = np.flatnonzero(whole)
    _, number, times = np.unique(doc[at] * (int(run.max()) + 1) + run[at], return_inverse=True, return_counts=True)
    starts = at[times[number] > 1] if len(at) else at
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return np.bincount(doc[np.cumsum(covered)[:-1] > 0], minlength=n_docs)


def rule_statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(COUNTS as columns, FEATURES as columns) of each text. A text without a word has zeros throughout."""
    n = len(texts)
    counts, features = np.zeros((n, len(COUNTS)), np.int64), np.zeros((n, len(FEATURES)))
    ids: dict[bytes, int] = {}
    split = [text.split() for text in texts]
    words = [np.fromiter([ids.setdefault(w, len(ids)) for w in parts], np.int64, len(parts)) for parts in split]
    bare, length = (np.fromiter(x, np.int64, len(ids)) for x in ((not w.strip(MARKS) for w in ids), map(len, ids)))
    for i, text in enumerate(texts):
        if not (own := len(words[i])):
            continue
        of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        lines = [x for x in text.split(b"\n") if x.strip()]
        chars = len(text) - of[LATER].sum() - of[BLANKS].sum()
        counts[i, :4] = own, chars, of[SYMBOLS].sum(), len(lines) - len(set(lines))
        variety = np.log(len(set(split[i]))) / np.log(own) if own > 1 else 1
        features[i] = counts[i, 2] / chars, bare[words[i]].mean(), np.median(length[words[i]]), variety, of[STOPS].sum() / own
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts[:, 4] = repeated_words(np.concatenate(words), np.repeat(np.arange(n), sizes), n) if n else 0
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (counts[:, 4] > MOST_REPEATED * counts[:, 0])


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean number of splits that set one of ``n`` rows apart in a random tree."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    harmonic = np.log(m - 1) + np.euler_gamma + 1 / (2 * (m - 1)) - 1 / (12 * (m - 1) ** 2)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * harmonic - 2 * (m - 1) / m))


class Forest:
    """Isolation trees as arrays: node k has the children 2 k + 1 and 2 k + 2. Rows are FEATURES, each with its number of words."""

    def __init__(self, rows: np.ndarray, n_words: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.middle = np.median(rows, axis=0) if len(rows) else np.zeros(len(FEATURES))
        rows = self.damped(rows, n_words)
        nodes = 2 ** (DEPTH + 1) - 1
        self.feature, self.cut, self.path = np.zeros((trees, nodes), np.int32), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
        self.usual = float(expected_path(min(sample, len(rows)))) if len(rows) else 0.0
        for t in range(trees if len(rows) else 0):
            held = {0: draw.choice(len(rows), min(sample, len(rows)), replace=False)}
            for depth in range(DEPTH + 1):
                for k in range(2**depth - 1, 2 ** (depth + 1) - 1):
                    mine = held.pop(k, None)
                    if mine is None:
                        continue
                    low, high = rows[mine].min(axis=0), rows[mine].max(axis=0)
                    open_ = np.flatnonzero(high > low)
                    if depth == DEPTH or not len(open_):  # a leaf; rows equal in all statistics can't be told apart
                        self.path[t, k:] = np.where(self.below(k, nodes)[k:], depth + expected_path(len(mine)), self.path[t, k:])
                        continue
                    f = int(draw.choice(open_))
                    cut = draw.uniform(low[f], high[f])
                    cut = cut if cut > low[f] else high[f]
                    self.feature[t, k], self.cut[t, k] = f, cut
                    right = rows[mine, f] >= cut
                    held[2 * k + 1], held[2 * k + 2] = mine[~right], mine[right]

    @staticmethod
    def below(k: int, nodes: int) -> np.ndarray:
        """Node k and all under it."""
        out = np.zeros(nodes, bool)
        first, last = k, k
        while first < nodes:
            out[first : last + 1] = True
            first, last = 2 * first + 1, 2 * last + 2
        return out

    def damped(self, rows: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return (rows - self.middle) * (n_words / (n_words + HALF_WORDS))[:, None]

    def score(self, rows: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher: odder. 0.5 if nothing was fitted."""
        if not self.usual:
            return np.full(len(rows), 0.5)
        rows = self.damped(rows, n_words)
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(rows), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (np.take_along_axis(rows, self.feature[trees, node], axis=1) >= self.cut[trees, node])
        return 2 ** -(self.path[trees, node].mean(axis=1) / self.usual)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the COUNTS, base_failed and features of each text, written to the shared folder."""

    def run(batches):
        for batch in batches:
            counts, features = rule_statistics(text_bytes(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(features) + 1, dtype=np.int32) * len(FEATURES)), pa.array(features.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts.T.copy()), pa.array(base_failed(counts)), lists], names=["doc_id", *COUNTS, "base_failed", "features"])

    schema = T.StructType([field(docs, "doc_id"), *T._parse_datatype_string(", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, features array<double>")])
    return materialise(map_arrow(docs.select("doc_id", "text"), run, schema), "statistics")


def matrix(features: pa.Array) -> np.ndarray:
    return features.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def fit(labelled: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> Forest:
    """A forest over at most ``trees`` * ``sample`` labelled rows (n_words, features): those with the least hashes of their statistics."""
    rows = labelled.select("n_words", "features").orderBy(F.xxhash64("features"), "n_words").limit(trees * sample).toArrow()
    return Forest(matrix(rows.column(1).combine_chunks()), rows.column(0).to_numpy(), trees, sample)


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """``rows`` (with n_words and features) with ``score`` in place of features."""
    kept = [c for c in rows.columns if c != "features"]

    def run(batches):
        for batch in batches:
            score = forest.score(matrix(batch.column("features")), batch.column("n_words").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(score)], names=[*kept, "score"])

    return map_arrow(rows, run, T.StructType([*[field(rows, c) for c in kept], T.StructField("score", T.DoubleType())]))


def threshold(labelled: DataFrame, most_lost: float = MOST_LOST) -> float:
    """Least score (of labelled rows with score, quality) from which documents are dropped: at most ``most_lost`` of the good ones are. Infinite without labelled rows of both kinds."""
    bins = labelled.groupBy(F.floor(F.col("score") * STEPS).alias("bin")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).toArrow()  # STEPS + 1 rows at most
    at = np.argsort(bins.column("bin").to_numpy())[::-1]
    bin_, good, bad = (bins.column(c).to_numpy()[at] for c in ("bin", "good", "bad"))
    fits = np.flatnonzero((np.cumsum(good) <= most_lost * good.sum()) & (bad > 0))
    return float(bin_[fits[-1]]) / STEPS if len(fits) and good.sum() else float("inf")


def judge(docs: DataFrame, labels: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """doc_id, the COUNTS, base_failed, kept and score of every document.

    Null and empty texts have no word and fail the fixed rules, as do texts of under 10 words or with over a fifth of their words in repeated windows.
    Labels (doc_id, quality) count for each row with their doc_id; null qualities, and documents that fail the fixed rules, take no part in
    the fit. Repeated rows come back each; without labelled rows the fixed rules alone decide.
    """
    rows = statistics(docs)
    quality = labels.select(F.col("doc_id").alias("__id"), "quality").where("quality is not null")
    labelled = materialise(rows.where(~F.col("base_failed")).join(quality, F.col("doc_id") == F.col("__id")).select("n_words", "features", F.col("quality").cast("int").alias("quality")), "labelled")
    forest = fit(labelled)
    least = threshold(scored(labelled, forest), most_lost)
    return scored(rows, forest).select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.floor(F.col("score") * STEPS) < F.lit(least * STEPS))).alias("kept"), "score")


def op13_quality_forest(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
