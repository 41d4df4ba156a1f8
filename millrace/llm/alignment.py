"""Alignment of two tokenisations of the same bytes by diagonal run skipping.

Tokens are given by the byte offsets where they end. Where both end at the same offset a group closes. Most tokens pair one to one, so
the walk stays on a diagonal: it compares slices of the two end arrays at the current index shift, of lengths 1, 2, 4, ..., and jumps
over all that agree. Where they differ it steps through the two arrays up to the next common end, which is an irregular group, and goes on
with the new shift.

Runs of text between blanks are cut the same way whatever stands around them, in both vocabularies: a blank followed by text always begins a token.
A worker encodes and aligns each distinct run of a batch once and keeps the result for the next batches.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type as schema_type

from .common import field, files, map_arrow, materialise, new_path, table, text_bytes

#: Runs that a Python worker keeps in each of two generations.
CACHE_RUNS = 300_000
#: Pairs of the corpus-wide counts that a worker holds (17 bytes each); the rest is joined.
MOST_HELD = 4_000_000
#: Distinct pairs that a task gathers before it gives their counts on.
GATHERED = 2_000_000
#: A run begins at a blank between two characters that aren't blank.
CUT = re.compile(r"(?<=\S)(?= \S)")
LINK_BITS = 20  # a pair's code: A id << LINK_BITS | B id


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """(tokens of A, tokens of B) up to the end of each group; ``a`` and ``b``: ascending byte ends of the tokens, with the same last end."""
    upto_a: list[int] = []
    upto_b: list[int] = []
    i = j = 0
    while i < len(a):
        run, step = 0, 1
        while True:  # along the diagonal j - i, twice as far each time
            x, y = a[i + run : i + run + step], b[j + run : j + run + step]
            if x and x == y:
                run += step
                step *= 2
                continue
            same = 0
            while same < min(len(x), len(y)) and x[same] == y[same]:
                same += 1
            run += same
            break
        run = min(run, len(a) - i)
        upto_a.extend(range(i + 1, i + run + 1))
        upto_b.extend(range(j + 1, j + run + 1))
        i, j = i + run, j + run
        if i < len(a):  # an irregular group, up to the next common end; from there the shift is another one
            while a[i] != b[j]:
                if a[i] < b[j]:
                    i += 1
                else:
                    j += 1
            i, j = i + 1, j + 1
            upto_a.append(i)
            upto_b.append(j)
    return upto_a, upto_b


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of all pairs of tokens whose byte ranges overlap; ``a`` and ``b`` as in ``align``."""
    every = np.union1d(a, b)  # between two ends there is one token of each side
    return np.searchsorted(a, every), np.searchsorted(b, every)


@dataclass(slots=True)
class Aligned:
    """One run: numbers of tokens, groups and links, codes of its links (as bytes), its groups as text; None as text where the bytes don't match."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    codes: bytes = b""
    groups: bytes | None = None


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [c for c in range(256) if c not in plain]
    return {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(rest)}


class Pair:
    """The two tokenizers, and the runs aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.bytes_a = {i: bytes(alphabet[c] for c in token) for token, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in token)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # no piece of B may go on behind a blank, else runs would not be independent
        self.runs_apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.length_a, self.length_b = np.zeros(max(self.bytes_a, default=0) + 1, np.int64), np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        self.length_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.known: dict[str, Aligned] = {}
        self.older: dict[str, Aligned] = {}

    def runs(self, text: str) -> list[str]:
        """A text with its blank in front, cut in runs; the first holds that blank."""
        full = " " + text
        return CUT.split(full) if self.runs_apart else [full]

    def aligned(self, runs: list[str]) -> list[Aligned]:
        """New runs: encoded as one text, and aligned as one stream of bytes. Each begins with a blank and no run of them but the last ends with one, so
        none changes another; where the whole isn't given back byte for byte, each run is looked at by itself."""
        whole = "".join(runs)
        wanted = whole.encode("utf-8", "surrogatepass")
        ids_a, ids_b = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.b.encode(whole[1:], num_threads=1)
        if b"".join([self.bytes_a.get(i, b"") for i in ids_a]) != wanted or b"".join([self.bytes_b[i] for i in ids_b]) != wanted:
            return [Aligned()] if len(runs) == 1 else [x for run in runs for x in self.aligned([run])]
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        last = np.cumsum([len(run.encode("utf-8", "surrogatepass")) for run in runs]) if len(runs) > 1 else end_a[-1:]
        # tokens and links of each run; both sides end where it ends, so nothing crosses it
        cut_a, cut_b = np.searchsorted(end_a, last, side="right"), np.searchsorted(end_b, last, side="right")
        upto_a, upto_b = align(end_a.tolist(), end_b.tolist())
        at_a, at_b = links(end_a, end_b)
        codes = ids_a[at_a] << LINK_BITS | ids_b[at_b]
        groups, cut = np.searchsorted(upto_a, cut_a, side="right").tolist(), np.searchsorted(at_a, cut_a, side="left")
        list_a, list_b = ids_a.tolist(), ids_b.tolist()
        texts, i, j = [], 0, 0
        for p, q in zip(upto_a, upto_b, strict=True):
            texts.append(f"{list_a[i]}|{list_b[j]}" if p - i == 1 == q - j else f"{','.join(map(str, list_a[i:p]))}|{','.join(map(str, list_b[j:q]))}")
            i, j = p, q
        data, n_a, n_b, n_links = codes.tobytes(), *(np.diff(x, prepend=0).tolist() for x in (cut_a, cut_b, cut))
        out, g, x = [], 0, 0
        for a, b, h, n in zip(n_a, n_b, groups, n_links, strict=True):
            out.append(Aligned(a, b, h - g, n, data[x : x + 8 * n], ";".join(texts[g:h]).encode()))
            g, x = h, x + 8 * n
        return out

    def learn(self, runs: set[str]) -> dict[str, Aligned]:
        """All of ``runs``, aligned; new ones are encoded together."""
        out, new = {}, []
        for run in runs:
            got = self.known.get(run) or self.older.get(run)
            if got is None:
                new.append(run)
            else:
                out[run] = got
        plain = [run for run in new if not run[-1].isspace() and run[:1] == " " and not run[1:2].isspace()]
        for at in range(0, len(plain), 4096):
            out |= zip(plain[at : at + 4096], self.aligned(plain[at : at + 4096]), strict=True)
        for run in new:
            if run not in out:
                out[run] = self.aligned([run])[0]
        if len(self.known) >= CACHE_RUNS:
            self.known, self.older = {}, self.known
        self.known |= {run: out[run] for run in runs if len(run) <= 64}
        return out


def summed(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and how often each occurs (or the sums of ``n``)."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(codes, kind="stable") if n is not None else None
    codes = np.sort(codes) if order is None else codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes))) if n is None else np.add.reduceat(n[order], first)


def pack(codes: np.ndarray, n: np.ndarray) -> bytes:
    """A document's pairs, ascending, as differences and counts, compressed."""
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress(np.diff(codes, prepend=0).astype("<i8").tobytes() + n.astype("<i4").tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    from zstandard import ZstdDecompressor

    raw = ZstdDecompressor().decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<i8", n)), np.frombuffer(raw, "<i4", n, 8 * n).astype(np.int64)


OUT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def tokens_aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row a document (row, doc_id, OUT, pairs) and rows without ``row`` that hold counts of pairs (codes, counts); written to the shared folder."""
    schema = T.StructType([T.StructField("row", T.LongType()), field(docs, "doc_id"), *T._parse_datatype_string(OUT + ", pairs binary, codes array<long>, counts array<long>")])

    def run(batches):
        pair, at = pair_of(path_a, path_b), TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kinds = [schema_type(f.dataType) for f in schema.fields]

        def merged():
            held[:] = [summed(*map(np.concatenate, zip(*held, strict=True)))]

        def counts():
            merged()
            lists = [pa.array([x], pa.list_(pa.int64())) for x in held.pop()]
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds[:-2]], *lists], names=schema.fieldNames())

        for batch in batches:
            split = [pair.runs(x.decode("utf-8", "surrogatepass")) if x else [] for x in text_bytes(batch.column(1))]
            of = pair.learn({r for runs in split for r in runs})
            index, all_ = {r: k for k, r in enumerate(of)}, list(of.values())
            size = np.array([[x.n_a for x in all_], [x.n_b for x in all_], [x.n_groups for x in all_], [x.n_links for x in all_]], np.int64).T
            texts, codes = [x.groups for x in all_], np.frombuffer(b"".join([x.codes for x in all_]), np.int64)
            wrong = np.array([x is None for x in texts], bool)
            start, often = np.cumsum(size[:, 3]) - size[:, 3], np.zeros(len(all_), np.int64)
            rows, digests, pairs = np.zeros((len(split), 4), np.int64), [""] * len(split), [b""] * len(split)
            for k, runs in enumerate(split):
                own = np.fromiter(map(index.__getitem__, runs), np.int64, len(runs))
                if not len(own) or wrong[own].any():
                    continue
                many = size[own, 3]
                place = np.repeat(start[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                pairs[k] = pack(*summed(codes[place]))
                np.add.at(often, own, 1)
                rows[k] = size[own].sum(axis=0)
                digests[k] = hashlib.sha256(b";".join([texts[x] for x in own.tolist()])).hexdigest()
            columns = [np.arange(at, at + len(rows)), batch.column(0), *rows.T.copy(), digests, pairs]
            yield pa.RecordBatch.from_arrays([*[x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=False)], *[pa.nulls(len(rows), k) for k in kinds[-2:]]], names=schema.fieldNames())
            at += len(rows)
            if often.any():
                n = np.repeat(often, size[:, 3])
                held.append(summed(codes[n > 0], n[n > 0]))
            if sum(len(x) for x, _ in held) >= GATHERED:
                merged()
                if len(held[0][0]) >= GATHERED // 2:
                    yield counts()
        if held:
            yield counts()

    return materialise(map_arrow(docs.select("doc_id", "text"), run, schema), "aligned")


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """A Python worker's tokenizers and runs, kept across its tasks."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n, best) of every pair of ids that is linked anywhere; best: no other A id is linked to this B id more often."""
    each = aligned.where("row is null").select(F.explode(F.arrays_zip("codes", "counts")).alias("x")).select("x.codes", "x.counts")
    sums = materialise(each.groupBy(F.col("codes").alias("code")).agg(F.sum("counts").alias("n")), "pairs")
    b = F.col("code").bitwiseAND(F.lit((1 << LINK_BITS) - 1))
    most = sums.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each B id
    return sums.join(most, b == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def held_pairs(counts: DataFrame, most: int) -> tuple[str, int]:
    """A folder with the most frequent pairs, no more than ``most``, and the least power of two of their counts."""
    sizes = {r.e: r.n for r in counts.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 63 rows at most
    least = 0
    while sum(n for e, n in sizes.items() if e >= least) > most:
        least += 1
    path = new_path(counts.sparkSession, "frequent")
    counts.where(F.floor(F.log2("n")) >= least).write.parquet(path)
    return path, least


_LOADED: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def loaded(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, n, best) by ascending code; the last folder read is kept across a worker's tasks."""
    if path not in _LOADED:
        import pyarrow.parquet as pq

        _LOADED.clear()
        system, at = files(path)
        t = pq.read_table(at, filesystem=system)
        code, n, best = (t.column(c).to_numpy() for c in ("code", "n", "best"))
        order = np.argsort(code)
        _LOADED[path] = code[order], n[order], best[order]
    return _LOADED[path]


def align_documents(docs: DataFrame, path_a: str, path_b: str, most_held: int = MOST_HELD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    A is a byte-level BPE that encodes a blank and the text, B a sentencepiece BPE that puts that blank in front by itself. Null and empty texts, and texts that either
    vocabulary doesn't give back byte for byte, have zeros and an empty digest. Repeated rows come back each and all count in the corpus-wide counts.
    Counts of the most frequent pairs are held by each worker; a document's other pairs are joined with the table of counts, with the same sums.
    """
    aligned = tokens_aligned(docs, path_a, path_b)
    counts = materialise(pair_counts(aligned), "counts")
    path, _ = held_pairs(counts, most_held)
    kept = ["row", "doc_id", *[x.split()[0] for x in OUT.split(", ")]]

    def run(batches):
        code, n, best = loaded(path)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            sums, bests, rest = [], [], [none]
            for data in batch.column("pairs").to_pylist():
                own, times = unpack(data) if data else none
                place = np.minimum(np.searchsorted(code, own), max(0, len(code) - 1))
                hit = code[place] == own if len(code) else np.zeros(len(own), bool)
                sums.append(int((n[place[hit]] * times[hit]).sum()))
                bests.append(int(times[hit][best[place[hit]]].sum()))
                rest.append((own[~hit], times[~hit]))
            rare = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rest, strict=True)], names=["code", "times"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x, _ in rest]), pa.int32()), rare)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), lists], names=[*kept, "n_best", "count_sum", "rest"])

    rows = aligned.where("row is not null").select(*kept, "pairs")
    schema = T.StructType([*[field(rows, c) for c in kept], *T._parse_datatype_string("n_best long, count_sum long, rest array<struct<code:long,times:long>>")])
    found = materialise(map_arrow(rows, run, schema), "found")
    rare = found.select("row", F.explode("rest").alias("x")).select("row", "x.code", "x.times").join(counts, "code")
    more = rare.groupBy(F.col("row").alias("of")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = found.join(more, F.col("row") == F.col("of"), "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
