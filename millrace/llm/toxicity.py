"""Toxicity by a linear-chain conditional random field over tokens.

Two states, clean and toxic. A token's emission is a sum of weights of its features: the token itself, its first letters and its shape;
features are hashed into tables of fixed size. Token labels come from the labelled documents: in a toxic document the tokens whose
document frequency points to toxicity are toxic, those where it may do so have no label, and all others, as all of a clean document, are clean. The field
is fitted by the likelihood of the labels, summed over the states of tokens without one. Forward-backward marginals of every token of the whole text are aggregated to a document
score by a logistic fit; tokens with a marginal of 0.5 or more are its spans.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field as part

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, fold, map_arrow, table, text_bytes

#: Labelled documents that the model is fitted on, drawn by a hash of their id.
SAMPLE_DOCS = 6000
#: A token is labelled toxic if so many sampled toxic documents hold it and its smoothed log-odds, less so many
#: standard errors, reach this bar.
LEAST_DOCS, LOG_ODDS, ERRORS = 3, 1.0, 2.6
#: The field is fitted on windows: so many tokens on either side of a labelled one, and at most so many windows of toxic documents (drawn at random) and as
#: many of clean ones, half of those around tokens that toxic documents share.
CONTEXT, MOST_WINDOWS = 6, 10_000
ROUNDS, STEP, RIDGE = 40, 0.3, 1.0
#: Slots of the hashed features: tokens, first letters, shapes. Letters of a token that count as its first ones.
TOKENS, HEADS, SHAPES = 1 << 16, 1 << 15, 1 << 5
SLOTS, HEAD = TOKENS + HEADS + SHAPES, 6
#: Marginals are computed in pieces of this many tokens side by side.
PIECE = 64
#: Text whose marginals are held at once; a longer text stands alone.
GROUP_BYTES = 1 << 20
CACHE_WORDS = 300_000
EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def token(word: bytes) -> bytes:
    return word.lower().strip(EDGES)


def shape(word: bytes, plain: bytes) -> int:
    """Case, digits, final mark and length class of a word as written."""
    return (word.isupper() and len(plain) > 1) | word[:1].isupper() << 1 | (len(word.translate(None, b"0123456789")) < len(word)) << 2 | (word[-1:] in (b"!", b"?")) << 3 | (len(plain) > 4) << 4


def slots(word: bytes) -> tuple[int, int, int]:
    """Slots of a word's features."""
    plain = token(word)
    return zlib.crc32(plain) % TOKENS, TOKENS + zlib.crc32(b"<" + plain[:HEAD]) % HEADS, TOKENS + HEADS + shape(word, plain)


class Words(dict):
    """Emission of each word as written; kept for words seen before."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: bytes) -> float:
        a, b, c = slots(word)
        got = self.weights[a] + self.weights[b] + self.weights[c]
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got

    def emissions(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of all words of the texts end to end, and the number of words of each text."""
        parts = [x.split() for x in texts]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter((self[w] for p in parts for w in p), float, int(lengths.sum())), lengths


#: A Python worker's words, by the model they belong to, kept across its tasks.
HELD: dict[int, Words] = {}


def held_words(model: Field) -> Words:
    key = zlib.crc32(model.weights.tobytes())
    if key not in HELD:
        HELD.clear()
        HELD[key] = Words(model.weights)
    return HELD[key]


@dataclass
class Field:
    """start (2), steps (2 x 2): log potentials; weights of the hashed features."""

    start: np.ndarray
    steps: np.ndarray
    weights: np.ndarray = part(default_factory=lambda: np.zeros(SLOTS))
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)


def products(m: np.ndarray) -> np.ndarray:
    """Running products over axis 1 of (pieces, length, 2, 2), scaled to avoid underflow; piece by piece side by side."""
    out = np.empty_like(m)
    now = m[:, 0] / m[:, 0].max(axis=(1, 2), keepdims=True)
    out[:, 0] = now
    for t in range(1, m.shape[1]):
        now = now @ m[:, t]
        now = now / now.max(axis=(1, 2), keepdims=True)
        out[:, t] = now
    return out


def scan(m: np.ndarray) -> np.ndarray:
    """Running products of the 2 x 2 matrices m[0], m[0] m[1], ... up to a factor each."""
    n = len(m)
    if n == 0:
        return m
    if n <= PIECE:
        return products(m[None])[0]
    pieces = -(-n // PIECE)
    padded = np.concatenate([m, np.broadcast_to(np.eye(2), (pieces * PIECE - n, 2, 2))]).reshape(pieces, PIECE, 2, 2)
    inside = products(padded)
    ahead = scan(inside[:, -1])
    inside[1:] = ahead[:-1, None] @ inside[1:]
    inside /= inside.max(axis=(2, 3), keepdims=True)
    return inside.reshape(-1, 2, 2)[:n]


def marginals(model: Field, emission: np.ndarray, starts: np.ndarray, pairs: bool = False):
    """P(toxic) of each token of many texts laid end to end; ``starts``: where each non-empty text begins.

    A text's first matrix has equal rows (the start potentials), so that nothing flows in from the text before.
    With ``pairs`` also the expected number of each transition and of each start state.
    """
    n = len(emission)
    if n == 0:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    local = np.stack([np.ones(n), np.exp(np.clip(emission, -60, 60))], axis=1)
    local /= local.max(axis=1, keepdims=True)
    first = np.zeros(n, bool)
    first[starts] = True
    steps = np.exp(model.steps)
    forward = steps[None] * local[:, None, :]
    forward[first] = np.exp(model.start)[None, None, :] * local[first][:, None, :]
    alpha = scan(forward).sum(axis=1)
    alpha /= alpha.sum(axis=1, keepdims=True)
    # beta_t = steps (local_{t+1} * beta_{t+1}), ones where a text ends: running products from the right
    last = np.zeros(n, bool)
    last[np.concatenate([starts[1:] - 1, [n - 1]])] = True
    after = np.concatenate([local[1:], np.ones((1, 2))])
    back = steps[None] * after[:, None, :]
    back[last] = 1.0
    beta = scan(back[::-1].transpose(0, 2, 1)).transpose(0, 2, 1)[::-1].sum(axis=2)
    beta /= beta.sum(axis=1, keepdims=True)
    both = alpha * beta
    toxic = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return toxic
    inner = ~first
    p = alpha[:-1, :, None] * steps[None] * (local * beta)[1:, None, :]
    p = p[inner[1:]]
    p /= p.sum(axis=(1, 2), keepdims=True)
    t = toxic[first].sum()
    return toxic, p.sum(axis=0), np.array([first.sum() - t, t])


def tokens_of(text: bytes) -> list[bytes]:
    return [token(w) for w in text.split()]


def label(texts: list[bytes], toxic: np.ndarray) -> tuple[set[bytes], set[bytes]]:
    """The toxic vocabulary, tokens of toxic documents whose log-odds reach the bar; and the tokens whose log-odds would but for the standard errors.

    Of copies with the same label (their least shingle is equal) only one counts as evidence.
    """
    hits, rest, docs, seen = Counter(), Counter(), [0, 0], set()
    for text, bad in zip(texts, toxic.tolist(), strict=True):
        t = tokens_of(text)
        mark = bad, min((zlib.crc32(b" ".join(t[j : j + 4])) for j in range(max(1, len(t) - 3))), default=0)
        if mark not in seen:
            seen.add(mark)
            docs[bad] += 1
            (hits if bad else rest).update(set(t))
    odds = lambda k, n: np.log((k + 0.5) / (max(n, k) - k + 0.5))
    sure = lambda w, k: odds(k, docs[1]) - odds(rest[w], docs[0]) - ERRORS * np.sqrt(1 / (k + 0.5) + 1 / (rest[w] + 0.5))
    bad = {w for w, k in hits.items() if w and k >= LEAST_DOCS and sure(w, k) >= LOG_ODDS}
    return bad, {w for w, k in hits.items() if w not in bad and odds(k, docs[1]) - odds(rest[w], docs[0]) >= LOG_ODDS}


def windows_of(texts: list[bytes], toxic: np.ndarray, bad: set[bytes], unsure: set[bytes], rng) -> list[tuple[list[bytes], list[int]]]:
    """Windows with their labels: 1 toxic, 0 clean, -1 none."""
    marked, hard, usual = [], [], []
    for text, is_toxic in zip(texts, toxic.tolist(), strict=True):
        words = text.split()
        plain = [token(w) for w in words]
        at, end = [i for i, w in enumerate(plain) if w in bad], 0
        for i in at:
            if i >= end:
                a, end = max(end, i - CONTEXT), i + CONTEXT + 1
                (marked if is_toxic else hard).append((words[a:end], [0 if not is_toxic else 1 if w in bad else -1 if w in unsure else 0 for w in plain[a:end]]))
        if words and not is_toxic:
            i = int(rng.integers(len(words)))
            some = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
            usual.append((some, [0] * len(some)))
    for some in (marked, hard, usual):
        rng.shuffle(some)
    marked = marked[:MOST_WINDOWS]
    hard = hard[: max(len(marked), 100) // 2]
    return marked + hard + usual[: max(len(marked), 100) - len(hard)]


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 1) -> Field:
    """Fit the field by gradient ascent on labelled windows, then the document score on the sampled documents."""
    windows = windows_of(texts, toxic, *label(texts, toxic), np.random.default_rng(seed))
    model = Field(np.zeros(2), np.zeros((2, 2)))
    lengths = np.array([len(words) for words, _ in windows], np.int64)
    n = int(lengths.sum())
    if n:
        made = {w: slots(w) for words, _ in windows for w in words}
        slot = np.array([made[w] for words, _ in windows for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        marks = np.array([m for _, some in windows for m in some])
        held = np.where(marks == 1, 60.0, np.where(marks == 0, -60.0, 0.0))
        seen = [np.full(SLOTS, 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)]
        for _ in range(ROUNDS):
            emission = model.weights[slot].sum(axis=1)
            free, moves, opened = marginals(model, emission, starts, pairs=True)
            told, told_moves, told_opened = marginals(model, emission + held, starts, pairs=True)
            slopes = np.bincount(slot.ravel(), np.repeat(told - free, 3), SLOTS), told_moves - moves, told_opened - opened
            for x, slope, squares in zip((model.weights, model.steps, model.start), slopes, seen, strict=True):
                slope = slope - RIDGE * x
                squares += slope * slope
                x += STEP * slope / np.sqrt(squares)  # what has moved much takes shorter steps
    calibrate(model, features(model, texts), toxic)
    return model


def features(model: Field, texts: list[bytes], words: Words | None = None) -> np.ndarray:
    """Per text: log of one plus the expected number of toxic tokens, and the largest marginal. Also see ``score``."""
    return aggregate(*token_marginals(model, texts, words))


def token_marginals(model: Field, texts: list[bytes], words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens end to end, and the number of tokens of each text; worked out for GROUP_BYTES of text at a time."""
    words = held_words(model) if words is None else words
    parts, counts, group, size = [], [], [], 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= GROUP_BYTES or i == len(texts) - 1:
            emission, lengths = words.emissions(group)
            starts = np.cumsum(lengths) - lengths
            parts.append(marginals(model, emission, starts[lengths > 0]))
            counts.append(lengths)
            group, size = [], 0
    return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0), np.zeros(0, np.int64))


def aggregate(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out, starts = np.zeros((len(lengths), 2)), np.cumsum(lengths) - lengths
    full = lengths > 0
    if full.any():
        sure = np.where(p >= 0.05, p, 0.0)  # thousands of near-zero marginals of a long text don't add up to evidence
        out[full, 0] = np.log1p(np.add.reduceat(sure, starts[full]))
        out[full, 1] = np.maximum.reduceat(p, starts[full])
    return out


def calibrate(model: Field, x: np.ndarray, toxic: np.ndarray) -> None:
    """Logistic fit of the document label on the aggregated marginals, by Newton steps."""
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    y, w = toxic.astype(float), np.zeros(3)
    for _ in range(25 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(3)
        w = w + np.linalg.solve(h, z.T @ (y - p) - 0.1 * w)
    model.calibration = tuple(w.tolist())


def score(model: Field, x: np.ndarray) -> np.ndarray:
    a, b, c = model.calibration
    return 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Train on a sample of ``sample_docs`` labelled documents whose fold is not 0. Null labels and null ids are not used."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where(fold("doc_id") != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").collect()
    return train([(r.text or "").encode("utf-8", "surrogatepass") for r in rows], np.array([r.toxic == 1 for r in rows], bool))


def spans_of(text: bytes, p: np.ndarray) -> str:
    """``start:end`` in code points of the tokens with a marginal of 0.5 or more."""
    found = [m.span() for m, x in zip(WORD.finditer(text), p, strict=True) if x >= 0.5]
    return ",".join(f"{len(text[:a].decode())}:{len(text[:b].decode())}" for a, b in found)


def score_rows(docs: DataFrame, model: Field, keep: list[str]) -> DataFrame:
    """The columns ``keep``, score and spans of every row; the order of rows and all other columns play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        words = held_words(model)
        for batch in batches:
            texts = text_bytes(batch.column("__text"))
            p, lengths = token_marginals(model, texts, words)
            ends = np.cumsum(lengths)
            found = score(model, aggregate(p, lengths))
            spans = [spans_of(x, part) if len(part) and part.max() >= 0.5 else "" for x, part in ((x, p[e - n : e]) for x, n, e in zip(texts, lengths, ends, strict=True))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.float64()), pa.array(spans, pa.string())], names=[*keep, "__score", "__spans"])

    schema = T.StructType([*[field(docs, c) for c in keep], T.StructField("__score", T.DoubleType()), T.StructField("__spans", T.StringType())])
    return map_arrow(docs.withColumn("__text", F.col("text")).select(*keep, "__text"), run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and toxic spans of every row.

    A null or empty text gets the score of no toxic token. Without labels every score is 0.5 or the sample's rate.
    Repeated rows are scored each.
    """
    rows = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text")
    scored = score_rows(rows, learn(docs, labels), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"), F.col("__spans").alias("spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame, bar: float = 0.5) -> DataFrame:
    """Documents with a score below ``bar``; their columns and values stay as they are."""
    return score_rows(docs, learn(docs, labels), docs.columns).where(F.col("__score") < bar).select(*docs.columns)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
