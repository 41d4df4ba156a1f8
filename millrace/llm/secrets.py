"""Secret scans: fixed patterns, plus strings that a battery of randomness tests tells from ordinary writing.

Each long run of code-like characters gets an inferred encoding, the smallest alphabet that has all its characters (hex, one case of letters, base32,
base36, base62, base64). Three tests look at it: chi-squared uniformity over the encoding's alphabet, the number of runs of character classes, and lag-1 serial
correlation. The hypothesis to be rejected is "ordinary writing": characters drawn by the frequencies, and class changes at the rate, of the corpus' own
short runs (``Writing``). The p-value says how seldom ordinary writing of this length looks so even and so mixed. Runs that are certainly not random
(uniformity or independence rejected) get p = 1. Benjamini-Hochberg control over the whole corpus, within classes of length and encoding, decides which are reported.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_arrow, materialise, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: The patterns below take whole runs, so asking for the least length at once equals dropping short matches.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
MIN_ASSIGN = 12

LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets of the encodings, smallest first; those of one case are written in lower case.
ALPHABETS = {"hex": DIGITS + "abcdef", "letters": LETTERS, "base32": LETTERS + "234567", "base36": LETTERS + DIGITS, "base62": LETTERS.upper() + LETTERS + DIGITS, "base64": LETTERS.upper() + LETTERS + DIGITS + "+/"}
ONE_CASE = ("hex", "letters", "base32", "base36")
#: Below this a randomness test says "certainly not random".
NOT_RANDOM = 1e-3
#: Share of false ones among the reported random strings.
FALSE_DISCOVERIES = 1e-3
#: p-values are kept as -log10 p in steps; rounding is towards larger p.
STEPS, MOST = 50, 30
LENGTHS = (32, 48, 64)
#: Runs of the corpus that ordinary writing is fitted on: long enough to be words or names, too short to be keys.
SHORT = (8, 20)
#: What is assumed ahead of the corpus: letters from frequent to seldom by Zipf's law, a share of digits and capitals, a rate of class changes; and the weight of it.
USUAL, USUAL_SHARES, USUAL_CHANGES, WEIGHT = "etaoinsrhldcumfpgwybvkxjqz", (0.03, 0.03, 0.002), 0.03, 1000.0
#: Class of a byte: 1 digit, 2 capital, 3 other code-like character, 0 anything else.
CLASS = np.zeros(256, np.uint8)
CLASS[[*b"abcdefghijklmnopqrstuvwxyz+/_-"]], CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]], CLASS[[*b"0123456789"]] = 3, 2, 1


def encoding(run: str) -> str:
    """The smallest alphabet that has all characters of the run; separators and padding don't count."""
    plain = run.replace("-", "").replace("_", "").rstrip("=")
    for kind in ONE_CASE:
        alphabet = ALPHABETS[kind]
        if not set(plain).difference(alphabet) or not set(plain).difference(alphabet.upper()):
            return kind
    return "base64" if set(plain).intersection("+/") else "base62"


@dataclass(frozen=True)
class Writing:
    """Ordinary writing: for each encoding sums of squares and cubes of its characters' chances, and the chance of a class change."""

    squares: dict[str, float]
    cubes: dict[str, float]
    changes: float

    @classmethod
    def of(cls, counts: dict[int, int]) -> Writing:
        """``counts``: of bytes below 128, of pairs of neighbours at 128, of class changes among them at 129."""
        letters = np.array([counts.get(ord(c), 0) + counts.get(ord(c.upper()), 0) for c in LETTERS], float)
        upper, digits, other = (sum(counts.get(b, 0) for b in some) for some in (LETTERS.upper().encode(), DIGITS.encode(), b"+/"))
        total = letters.sum() + digits + other
        d, u, o = ((n + WEIGHT * share) / (m + WEIGHT) for n, m, share in zip((digits, upper, other), (total, letters.sum(), total), USUAL_SHARES, strict=True))
        zipf = np.array([1 / (1 + USUAL.index(c)) for c in LETTERS])
        q = letters + WEIGHT * zipf / zipf.sum()
        q /= q.sum()
        chance = dict(zip(LETTERS, q, strict=True)) | dict.fromkeys(DIGITS, d / 10) | dict.fromkeys("+/", o / 2)
        squares, cubes = {}, {}
        for kind, alphabet in ALPHABETS.items():
            w = np.array([chance[c.lower()] * (1.0 if not c.isalpha() or kind in ONE_CASE else u if c.isupper() else 1 - u) for c in alphabet])
            w /= w.sum()
            squares[kind], cubes[kind] = float((w**2).sum()), float((w**3).sum())
        return cls(squares, cubes, (counts.get(129, 0) + WEIGHT * USUAL_CHANGES) / (counts.get(128, 0) + WEIGHT))


def short_runs(data: bytes, most: int = 1 << 20) -> np.ndarray:
    """Counts of the bytes, neighbours and class changes in runs of SHORT code-like characters; long data are cut at a blank."""
    out, a = np.zeros(130, np.int64), 0
    while a < len(data):
        b = len(data) if len(data) - a <= most else data.rfind(b" ", a, a + most) + 1 or a + most
        part = np.frombuffer(data, np.uint8, b - a, a)
        kinds = CLASS[part]
        turns = np.flatnonzero(np.diff(np.concatenate(([0], (kinds > 0).view(np.int8), [0]))))
        starts, ends = turns[::2], turns[1::2]
        some = (ends - starts >= SHORT[0]) & (ends - starts < SHORT[1])
        steps = np.zeros(len(part) + 1, np.int8)
        steps[starts[some]], steps[ends[some]] = 1, -1
        inside = np.cumsum(steps[:-1], dtype=np.int8).view(bool)
        pairs = inside[1:] & inside[:-1]
        out[:128] += np.bincount(part[inside], minlength=128)[:128]
        out[128] += pairs.sum()
        out[129] += (pairs & (kinds[1:] != kinds[:-1])).sum()
        a = b
    return out


def ordinary(docs: DataFrame) -> Writing:
    """Ordinary writing fitted on the short runs of all texts; 130 counts come to the driver."""

    def run(batches):
        total = np.zeros(130, np.int64)
        for batch in batches:
            total += short_runs("\n".join(x for x in batch.column(0).to_pylist() if x).encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(130)), pa.array(total)], names=["what", "n"])

    counts = map_arrow(docs.select("text"), run, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()
    return Writing.of({r.what: r.n for r in counts})


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def binomial_tail(n: int, p: float, k: int) -> float:
    """P(X >= k) for a binomial X."""
    mean, sd = n * p, math.sqrt(n * p * (1 - p))
    i = max(k, int(mean - 40 * sd))  # what lies below is less than rounding
    if i <= 0:
        return 1.0
    term, total = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)), 0.0
    while i <= n and (i <= mean or term > 1e-17 * total):
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p)
        i += 1
    return min(1.0, total)


def p_value(run: str, kind: str, writing: Writing) -> float:
    """How seldom ordinary writing passes for as random as ``run`` does."""
    plain = run.replace("-", "").replace("_", "").rstrip("=")
    n, size = len(plain), len(ALPHABETS[kind])
    if n < 16 or plain.isdigit():
        return 1.0
    kinds = CLASS[np.frombuffer(plain.encode(), np.uint8)]
    place = np.zeros(128, np.int64)
    place[np.frombuffer(ALPHABETS[kind].encode(), np.uint8)] = np.arange(size)
    codes = place[np.frombuffer((plain.lower() if kind in ONE_CASE else plain).encode(), np.uint8)]
    squares = float((np.bincount(codes, minlength=size).astype(float) ** 2).sum())
    chi, df = squares * size / n - n, size - 1
    if upper_tail(((max(chi, 0.0) / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))) < NOT_RANDOM:  # cube roots of chi-squared are all but normal
        return 1.0
    spread = float(((codes - codes.mean()) ** 2).sum())
    serial = float(((codes[1:] - codes.mean()) * (codes[:-1] - codes.mean())).sum()) / spread if spread else 1.0
    if 2 * upper_tail(abs(serial + 1 / n) * math.sqrt(n)) < NOT_RANDOM:
        return 1.0
    # pairs of equal characters, of which chi-squared is a multiple, and their mean and variance in ordinary writing
    s2, s3 = writing.squares[kind], writing.cubes[kind]
    pairs, all_pairs = (squares - n) / 2, n * (n - 1) / 2
    variance = all_pairs * (s2 - s2 * s2) + all_pairs * 2 * (n - 2) * (s3 - s2 * s2)
    p_even = upper_tail((all_pairs * s2 - pairs - 0.5) / math.sqrt(variance))
    p_runs = binomial_tail(n - 1, writing.changes, int((kinds[1:] != kinds[:-1]).sum()))
    both = max(p_even, 1e-40) * max(p_runs, 1e-40)
    return min(1.0, both * (1 - math.log(both)))  # Fisher's combination of two


def outside(start: int, end: int, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Parts of a run that no span of ``base`` (sorted) touches, less the separators where it was cut, and long enough to test."""
    parts, a = [], start
    for x, _, y in base:
        if x >= end:
            break
        if y > a:
            parts.append((a, x))
            a = y
    parts.append((a, end))
    out = []
    for a, b in parts:
        while a < b and a > start and text[a] in "-_=":
            a += 1
        while a < b and b < end and text[b - 1] in "-_=":
            b -= 1
        if CANDIDATE.fullmatch(text, a, b) if a < b else None:
            out.append((a, b))
    return out


def scan(text: str, writing: Writing) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """(start, kind, end) of the patterns' spans; (start, end, class, step) of tested runs, or parts of runs, that overlap none of them."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    tested, ahead = [], base  # a span that ends before a run can't touch a later one
    for m in CANDIDATE.finditer(text):
        done = 0
        while done < len(ahead) and ahead[done][2] <= m.start():
            done += 1
        ahead = ahead[done:] if done else ahead
        for a, b in outside(m.start(), m.end(), text, ahead):
            kind = encoding(text[a:b])
            p = p_value(text[a:b], kind, writing)
            step = int(min(-math.log10(p), MOST) * STEPS) if p < 1 else 0
            tested.append((a, b, list(ALPHABETS).index(kind) * 10 + sum(b - a >= x for x in LENGTHS), step))
    return base, tested


BASE_TYPE = "array<struct<start:bigint,kind:bigint,end:bigint>>"
TESTED_TYPE = "array<struct<start:bigint,end:bigint,class:bigint,step:bigint>>"


def scan_table(docs: DataFrame, writing: Writing) -> DataFrame:
    """doc_id, base spans, tested runs."""

    def run(batches):
        kinds = (pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "kind", "end")])), pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "class", "step")])))
        for batch in batches:
            found = [scan(text or "", writing) for text in batch.column(1).to_pylist()]
            base = [[dict(zip(("start", "kind", "end"), x, strict=True)) for x in b] for b, _ in found]
            tested = [[dict(zip(("start", "end", "class", "step"), x, strict=True)) for x in t] for _, t in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kinds[0]), pa.array(tested, kinds[1])], names=["doc_id", "base", "tested"])

    schema = T.StructType([field(docs, "doc_id"), T.StructField("base", T._parse_datatype_string(BASE_TYPE)), T.StructField("tested", T._parse_datatype_string(TESTED_TYPE))])
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def cutoffs(tested: DataFrame, q: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """The least step reported in each class of encoding and length (Benjamini-Hochberg over the counts of all tested runs).

    ``tested``: rows with class and step. The counts are a few thousand rows at most, whatever the input.
    """
    counts: dict[int, dict[int, int]] = {}
    for r in tested.groupBy("class", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["class"], {})[r.step] = r.n
    out = {}
    for kind, steps in counts.items():
        total, above = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            above += steps[step]
            if step and 10 ** (-step / STEPS) <= q * above / total:
                out[kind] = step
    return out


def spans(scanned: DataFrame, least: dict[int, int]) -> DataFrame:
    """Add ``random`` (reported runs) and ``all_spans`` (start, kind, end) in order."""
    bar = F.create_map(*[F.lit(x).cast("long") for k, v in least.items() for x in (k, v)]) if least else F.create_map().cast("map<bigint,bigint>")
    random = F.filter("tested", lambda x: F.coalesce(x["step"] >= F.element_at(bar, x["class"]), F.lit(False)))
    found = F.transform(random, lambda x: F.struct(x["start"].alias("start"), F.lit(3).cast("long").alias("kind"), x["end"].alias("end")))
    return scanned.withColumn("all_spans", F.array_sort(F.concat("base", found)))


def written(array) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.element_at(names, (x["kind"] + 1).cast("int")), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per document: counts of each pattern, digest of their spans, and all spans as text.

    A null or empty text has none; repeated rows each get theirs.
    """
    scanned = materialise(scan_table(docs, ordinary(docs)), "secrets")
    least = cutoffs(scanned.select(F.explode("tested").alias("x")).select("x.class", "x.step"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return spans(scanned, least).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"),
        (F.size("all_spans") - F.size("base")).cast("long").alias("n_random"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Documents with every secret replaced by ``mark``; other texts stay as they are, a null stays null.

    Texts are read three times: for ordinary writing, for the corpus-wide counts, and to replace. ``n_chars``, where there, follows the text.
    """
    writing = ordinary(docs)
    least = cutoffs(scan_table(docs, writing).select(F.explode("tested").alias("x")).select("x.class", "x.step"))
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, tested = scan(text, writing)
        found = sorted([(a, b) for a, _, b in base] + [(a, b) for a, b, kind, step in tested if kind in least and step >= least[kind]])
        out, done = [], 0
        for a, b in found:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join(out) + text[done:] if found else text

    def run(batches):
        for batch in batches:
            texts = pa.array([clean(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    out = map_arrow(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
