"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ORDER symbols, pretrained on the training documents. A symbol is coded in
the longest known context; if it never followed that context, the escape probability (method D: half the distinct
symbols over the count; each known symbol gives up half a count) is paid and the next shorter context tries, with all symbols that the longer one knew
excluded. Below order 0 the remaining symbols are equally likely. The end of the text is a symbol of its own.

Counting is a distributed aggregation of byte n-grams over all training texts, and no context is left out: the trie, a table in the shared folder,
grows with the corpus. N-grams are dealt by the three symbols ahead of the last one, so that a task holds an n-gram with all its suffixes of four
symbols or more, and its context's other symbols. A context that would hold more than a task's share of all distinct n-grams is split: its n-grams are dealt by one symbol more, up to all
ORDER of them. What follows a split context itself, at most 256 symbols, is summed over the tasks, and every task that needs it has it. Which contexts are split is told by a
sample of the texts; it changes no count, only where things are counted. The most frequent contexts, down to a count that leaves at most MOST_KEPT n-grams, are written as files of their own that
each Python worker loads once, together with all n-grams of up to three symbols, and score a text where it is read. Positions with a rarer or unknown
context are passed on as (row, n-gram, times) to the tasks that hold the trie's parts. Where a position is scored does not change its score.
The unigram base needs exact counts of every word: frequent words (at most 1 / WORD_SHARE of them) are broadcast,
all others are looked up by a shuffled join.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, field, files, fold, map_arrow, materialise, new_path, table, text_bytes

ORDER = 6
#: The edge symbol stands before a text and after it; UTF-8 has no such byte.
EDGE, SYMBOLS = 0xFF, 256
#: Orders below this are kept whole by every task: at most 256^3 n-grams, whatever the corpus.
LOW = 3
#: N-grams of the higher orders that a worker holds, with their contexts about 16 bytes each.
MOST_KEPT = 8_000_000
#: Texts of the sample that tells which contexts are split over tasks: some hundred thousand n-grams.
SPLIT_DOCS = 500
WORD_SHARE = 1e-6
END = "\n"  # the token after a text's last word; no word holds white space
#: Entries that a task gathers before it passes them on, and positions that it sorts at once.
GATHER, WINDOW = 3_000_000, 1 << 21
HELD_OUT = 1
DOC_BITS = 8


def batches_of(texts: list[bytes], most: int = 1 << 20):
    """Slices of the list with about ``most`` bytes and at most 256 texts each; a longer text stands alone."""
    start = size = 0
    for i, x in enumerate(texts):
        if i - start == 1 << DOC_BITS or size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x) + 1
    if start < len(texts):
        yield start, len(texts)


def keys(texts: list[bytes], window: int = WINDOW):
    """Ascending arrays of (n-gram of ORDER + 1 symbols << 8 | place of the text), one for each byte and the end of each of at most 256 texts."""
    pad = bytes([EDGE]) * ORDER
    data = np.frombuffer(pad.join([b"", *texts, b""]) + bytes(8), np.uint8)
    blocks = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER  # windows that start in a text's pad or in the text; the last ORDER - 1 are none of its n-grams
    ends = np.cumsum(blocks)
    for a in range(0, int(ends[-1]), window):
        b = min(a + window, int(ends[-1]))
        wide = np.ndarray((b - a,), ">u8", data, a, (1,)).astype(np.uint64)
        key = wide >> np.uint64(8 * (7 - ORDER)) << np.uint64(DOC_BITS)
        first, last = np.searchsorted(ends, [a, b - 1], side="right")
        key |= np.repeat(np.arange(first, last + 1, dtype=np.uint64), np.diff(np.concatenate(([a], ends[first:last], [b]))))
        dropped = 0
        for i in range(1, ORDER):
            at = ends[(ends - i >= a) & (ends - i < b)] - i - a
            key[at] = np.uint64((1 << 64) - 1)
            dropped += len(at)
        key.sort()
        yield key[: len(key) - dropped]


def first_of(x: np.ndarray) -> np.ndarray:
    """Places where a new value starts in an ascending array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def lengths_of(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def summed(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    first = first_of(x)
    return x[first], np.add.reduceat(n, first) if len(x) else n


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) of all texts, an n-gram once or more: each task sums before it passes anything on."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(sums):
            return pa.RecordBatch.from_arrays([pa.array(sums[0].astype(np.int64)), pa.array(sums[1])], names=["gram", "n"])

        for batch in batches:
            texts = [x.lower() for x in text_bytes(batch.column(0))]
            for a, b in batches_of(texts):
                for key in keys(texts[a:b]):
                    gram = key >> np.uint64(DOC_BITS)
                    first = first_of(gram)
                    held.append((gram[first], lengths_of(first, len(gram))))
                if sum(len(k) for k, _ in held) > GATHER:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > GATHER // 2:
                        yield out(held[0])
                        held = []
        if held:
            yield out(summed(*map(np.concatenate, zip(*held, strict=True))))

    return map_arrow(docs.select("text"), run, "gram long, n long")


def context(gram: Column, length: int) -> Column:
    """The ``length`` symbols ahead of the last one."""
    return F.shiftright(gram, 8).bitwiseAND(F.lit((1 << 8 * length) - 1))


def split_contexts(docs: DataFrame, parts: int | None = None, most: int = SPLIT_DOCS) -> list[np.ndarray]:
    """Contexts of LOW ... ORDER - 1 symbols that hold more than one part in ``parts`` (shuffle partitions) of the distinct n-grams of at most about ``most`` texts: ``parts`` at most of each length."""
    parts, rows = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count()
    chosen = docs if rows <= most else docs.sample(most / rows, seed=7)
    longest = gram_counts(chosen).select("gram").distinct().groupBy(context(F.col("gram"), ORDER - 1).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(longest, "contexts")
    all_ = sizes.agg(F.sum("n")).first()[0] or 0
    out = []
    for length in range(LOW, ORDER):
        cut = F.col("c").bitwiseAND(F.lit((1 << 8 * length) - 1))
        heavy = sizes.groupBy(cut.alias("c")).agg(F.sum("n").alias("n")).where(F.col("n") * parts > all_) if not out or len(out[-1]) else None
        out.append(np.sort(np.array([r.c for r in heavy.collect()] if heavy else [], np.int64)).view(np.uint64))
    discard(sizes)
    return out


def by_context(gram: Column, split: list[np.ndarray]) -> Column:
    """What deals n-grams to tasks: the LOW symbols ahead of the last one, more where these are split."""
    deal = F.xxhash64(F.lit(ORDER), context(gram, ORDER))
    for length in range(ORDER - 1, LOW - 1, -1):
        inner = context(gram, length)
        heavy = split[length - LOW].view(np.int64).tolist()
        here = F.xxhash64(F.lit(length), inner)
        deal = F.when(inner.isin(heavy), deal).otherwise(here) if heavy else here
    return deal


def is_split(k: Column, gram: Column, split: list[np.ndarray]) -> Column:
    """Whether an n-gram of order k follows a split context."""
    out = F.lit(False)
    for i, heavy in enumerate(split):
        if len(heavy):
            out = out | (k == LOW + i) & context(gram, LOW + i).isin(heavy.view(np.int64).tolist())
    return out


def fold_in(batches, columns: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (n-gram, count) batches; what is gathered stays within GATHER above the distinct ones."""
    held, gathered = [], 0
    for b in batches:
        held.append((b.column(columns[0]).to_numpy().view(np.uint64), b.column(columns[1]).to_numpy()))
        gathered += b.num_rows
        if gathered > GATHER + len(held[0][0]):
            held, gathered = [summed(*map(np.concatenate, zip(*held, strict=True)))], 0
            pa.default_memory_pool().release_unused()
    return summed(*map(np.concatenate, zip(*held, strict=True))) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def trie_table(docs: DataFrame, split: list[np.ndarray]) -> DataFrame:
    """(k, g, n, t): count n of each n-gram g of the orders LOW ... ORDER, and count t of its context. Those of split contexts come in parts, t being 0: see ``whole_trie``."""

    def run(batches):
        gram, n = fold_in(batches)
        pa.default_memory_pool().release_unused()
        if not len(gram):
            return
        for order in range(ORDER, LOW - 1, -1):
            if order < ORDER:
                gram, n = summed(gram & np.uint64((1 << 8 * (order + 1)) - 1), n)
            first = first_of(gram >> np.uint64(8))
            t = np.repeat(np.add.reduceat(n, first), lengths_of(first, len(gram)))
            if order < ORDER and len(split[order - LOW]):
                t[find(split[order - LOW], gram >> np.uint64(8)) >= 0] = 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), order, np.int32)), pa.array(gram.view(np.int64)), pa.array(n), pa.array(t)], names=["k", "g", "n", "t"])

    return map_arrow(gram_counts(docs).repartition(by_context(F.col("gram"), split)), run, "k int, g long, n long, t long")


def whole_trie(parts: DataFrame, split: list[np.ndarray]) -> DataFrame:
    """``trie_table``'s rows with the parts of split contexts summed up."""
    if not any(map(len, split)):
        return parts
    sums = parts.where("t = 0").groupBy("k", "g").agg(F.sum("n").alias("n"))
    after = sums.withColumn("t", F.sum("n").over(Window.partitionBy("k", F.shiftright("g", 8))))  # 256 rows at most
    return parts.where("t > 0").unionByName(after)


def low_orders(trie: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of the orders below LOW."""
    got = trie.where(F.col("k") == LOW).groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * LOW) - 1)).alias("g")).agg(F.sum("n").alias("n")).toArrow()
    out = [summed(got.column("g").to_numpy().view(np.uint64), got.column("n").to_numpy())]
    for order in range(LOW - 1, 0, -1):
        out.insert(0, summed(out[0][0] & np.uint64((1 << 8 * order) - 1), out[0][1]))
    return out


def frequent_orders(trie: DataFrame, most: int = MOST_KEPT) -> list[str]:
    """Folders with (g, n) of the orders from LOW on, of the most frequent contexts: all whose count is at least the power of two that leaves ``most`` n-grams."""
    sizes = {r.e: r.n for r in trie.groupBy(F.floor(F.log2("t")).alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 63 rows at most
    least = 0
    while sum(n for e, n in sizes.items() if e >= least) > most:
        least += 1
    out = []
    for order in range(LOW, ORDER + 1):
        out.append(new_path(trie.sparkSession, f"order{order}"))
        trie.where((F.col("k") == order) & (F.floor(F.log2("t")) >= least)).select("g", "n").write.parquet(out[-1])
    return out


def load_orders(folders: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of each folder."""
    out = []
    for folder in folders:
        system, path = files(folder)
        out.append(by_gram(pq.read_table(path, columns=["g", "n"], filesystem=system)))
        pa.default_memory_pool().release_unused()
    return out


#: A Python worker's trie, by its folders, kept across its tasks.
HELD: dict[tuple[str, ...], Trie] = {}


def held_trie(low: list[tuple[np.ndarray, np.ndarray]], folders: list[str]) -> Trie:
    key = tuple(folders)
    if key not in HELD:
        HELD.clear()
        HELD[key] = Trie([*low, *load_orders(folders)] if low else [])
    return HELD[key]


def by_gram(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    g, n = rows.column("g").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(g)
    return g[order], narrow(n[order])


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in four bytes where they fit."""
    return n.astype(np.int32) if len(n) and n.max() < 1 << 31 else n


def split_orders(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    k = rows.column("k").to_numpy()
    return [by_gram(rows.filter(pa.array(k == order))) for order in range(LOW, ORDER + 1)]


def find(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in an ascending array, -1 where they are not in it."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


class Trie:
    """N-grams and contexts of the orders 0 ... ORDER with their counts. Each context has all its symbols and all its suffixes."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.grams, self.counts, self.nodes, self.totals, self.kinds, self.excluded = [], [], [], [], [], []
        for order, (gram, n) in enumerate(counts):
            context = gram >> np.uint64(8)
            first = first_of(context)
            shorter = gram & np.uint64((1 << 8 * order) - 1)
            # what the shorter context counts for the symbols known here
            before = counts[order - 1][1][np.searchsorted(counts[order - 1][0], shorter)] if order and len(gram) else np.zeros(len(gram), np.int64)
            self.grams.append(gram)
            self.counts.append(n)
            self.nodes.append(context[first])
            self.totals.append(narrow(np.add.reduceat(n, first, dtype=np.int64)) if len(gram) else n)
            self.kinds.append(lengths_of(first, len(gram)).astype(np.int16))
            self.excluded.append(narrow(np.add.reduceat(before, first, dtype=np.int64)) if len(gram) else before)

    def log10(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(last symbol | those before it) of ascending n-grams of ORDER + 1 symbols, and whether the whole context is known."""
        out, known_context = np.zeros(len(gram)), np.zeros(len(gram), bool)
        live = np.arange(len(gram))
        gone, kinds = np.zeros(len(gram)), np.zeros(len(gram))  # counts and symbols excluded so far
        for order in range(len(self.grams) - 1, -1, -1):
            if not len(self.grams[order]) or not len(live):
                continue
            code = gram[live] & np.uint64((1 << 8 * (order + 1)) - 1)
            node = find(self.nodes[order], code >> np.uint64(8))
            known = node >= 0
            if order == ORDER:
                known_context = known
            total = np.where(known, self.totals[order][node] - gone, 0)
            fresh = np.where(known, self.kinds[order][node] - kinds, 0)
            at = find(self.grams[order], code)
            hit = at >= 0
            out[live[hit]] += np.log10((self.counts[order][at[hit]] - 0.5) / total[hit])
            escape = ~hit & (fresh > 0)
            out[live[escape]] += np.log10(0.5 * fresh[escape] / total[escape])
            gone = np.where(known, self.excluded[order][node], gone)[~hit]
            kinds = np.where(known, self.kinds[order][node], kinds)[~hit]
            live = live[~hit]
        out[live] -= np.log10(SYMBOLS - kinds)
        return out, known_context

    def scores(self, texts: list[bytes], defer: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """log10 probability of each text; with ``defer`` without the positions whose context is not known. Those come as (place of the text, n-gram, times), by text."""
        out, rest = np.zeros(len(texts)), []
        for a, b in batches_of(texts):
            for key in keys(texts[a:b]):
                gram = key >> np.uint64(DOC_BITS)
                first = first_of(gram)
                p, known = self.log10(gram[first])
                if defer:
                    p[~known] = 0.0
                    late = key[np.repeat(~known, lengths_of(first, len(gram)))]
                    at = first_of(late)
                    rest.append((late[at], lengths_of(at, len(late)), np.full(len(at), a)))
                each = np.repeat(p, lengths_of(first, len(gram)))
                out[a:b] += np.bincount((key & np.uint64(255)).astype(np.int64), weights=each, minlength=b - a)
        if not rest:
            return out, [np.zeros(0, np.int64)] * 3
        late, times, base = map(np.concatenate, zip(*rest, strict=True))
        text = (late & np.uint64(255)).astype(np.int64) + base
        order = np.argsort(text, kind="stable")
        return out, [text[order], (late >> np.uint64(DOC_BITS)).view(np.int64)[order], times[order]]


def settle(left: DataFrame, trie: DataFrame, low: list[tuple[np.ndarray, np.ndarray]], split: list[np.ndarray], most: int = 200_000) -> DataFrame:
    """(row, x) of positions passed on (row, g, n): their log10 probabilities times n, summed over the part of a row that a task holds.

    In each task the trie's n-grams come first and stay; the positions stream past them. What follows split contexts, at most 256 n-grams for each of them, goes to all tasks.
    """
    common = None
    if any(map(len, split)):
        within = is_split(F.col("k"), F.col("g"), split)
        common, trie = trie.where(within).select("k", "g", "n").toArrow(), trie.where(~within)
    shared = left.sparkSession.sparkContext.broadcast((low, common))
    both = trie.select(F.lit(0).alias("side"), "k", "g", "n", F.lit(0).cast("long").alias("row")).union(left.select(F.lit(1), F.lit(0), "g", F.col("n").cast("long"), "row"))

    def run(batches):
        model, trie, held = [], None, []

        def out():
            g, n, row = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("g", "n", "row"))
            distinct, at = np.unique(g.view(np.uint64), return_inverse=True)
            rows, of = np.unique(row, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(of, weights=trie.log10(distinct)[0][at] * n))], names=["row", "x"])

        for batch in batches:
            cut = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            if cut:
                model.append(batch.slice(0, cut))
            if cut < batch.num_rows:
                if trie is None:
                    low, common = shared.value
                    own = pa.Table.from_batches(model, batch.schema).select(["k", "g", "n"])
                    trie = Trie([*low, *split_orders(own if common is None else pa.concat_tables([own, common.cast(own.schema)]))])
                    model = []
                held.append(batch.slice(cut))
                if sum(b.num_rows for b in held) >= most:
                    yield out()
                    held = []
        if held:
            yield out()

    return map_arrow(both.repartition(by_context(F.col("g"), split)).sortWithinPartitions("side"), run, "row long, x double")


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n) of all texts, the end token included."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                counts.update(text.lower().split())
            counts[END.encode()] += batch.num_rows
            if len(counts) > GATHER // 4:
                yield out()
                counts = Counter()
        yield out()

    return map_arrow(docs.select("text"), run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Both scores are of the text with A-Z in lower case. Null and empty texts have one token, the end. Repeated rows
    are scored each. Without training texts a word's base is 1 and the bytes are equally likely.
    """
    spark = docs.sparkSession
    split = split_contexts(training)
    table_ = whole_trie(materialise(trie_table(training, split), "trie"), split)
    low = low_orders(table_)
    positions = int(low[0][1].sum())
    folders = frequent_orders(table_) if positions else []
    words = materialise(word_counts(training).where("n > 0"), "words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    below = np.log10(total + 0.5 * (kinds + 1))
    frequent = {r.token.encode(): r.n for r in words.where(F.col("n") >= max(1.0, total * WORD_SHARE)).toLocalIterator()}
    shared = spark.sparkContext.broadcast((low if positions else [], {w: (float(np.log10(n + 0.5) - below)) for w, n in frequent.items()}))
    rare_type = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))

    def run(batches):
        from pyspark import TaskContext

        low, frequent = shared.value
        trie = held_trie(low, folders)
        row = TaskContext.get().partitionId() << 40
        end = frequent.get(END.encode())
        for batch in batches:
            texts = [x.lower() for x in text_bytes(batch.column(2))]
            base, tokens, known, rare = [], [], [], []
            for text in texts:
                counts = Counter(text.split())
                n = sum(counts.values())
                usual = [(frequent[w], k) for w, k in counts.items() if w in frequent]
                seldom = [{"token": w.decode(), "n": k} for w, k in counts.items() if w not in frequent]
                if end is None:
                    seldom.append({"token": END, "n": 1})
                base.append(sum(x * k for x, k in usual) + (end or 0.0))
                tokens.append(n + 1)
                known.append(sum(k for _, k in usual) + (end is not None))
                rare.append(seldom)
            scores, (of, gram, times) = trie.scores(texts, defer=positions > 0)
            offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            late = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(gram), pa.array(times.astype(np.int32))], ["g", "n"]))
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            columns = [batch.column(0), batch.column(1), pa.array(rows), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array(rare, rare_type), late]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    schema = T.StructType([field(docs, "doc_id"), *T._parse_datatype_string("held_out boolean, row long, n_tokens long, known long, base double, near double, rare array<struct<token:string,n:bigint>>, late array<struct<g:bigint,n:int>>")])
    rows = materialise(map_arrow(docs.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "text"), run, schema), "scored")
    looked_up = rows.select("row", F.explode("rare").alias("x")).select("row", F.col("x.token").alias("token"), F.col("x.n").alias("k")).join(words, "token", "left")
    each = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5)) - F.lit(float(below))
    none = F.lit(0.0)
    rest = looked_up.select("row", (each * F.col("k")).alias("base"), F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0).alias("also"), none.alias("score"))
    if positions:
        far = settle(rows.select("row", F.explode("late").alias("x")).select("row", "x.g", "x.n"), table_, low, split)
        rest = rest.union(far.select("row", none, F.lit(0).cast("long"), "x"))
    rest = rest.groupBy("row").agg(F.sum("base").alias("more"), F.sum("also").alias("also"), F.sum("score").alias("far"))
    return rows.drop("rare", "late").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", none)).alias("base_score"), (F.col("near") + F.coalesce("far", none)).alias("score"),
    )


def op1_ppm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, docs.where(fold("doc_id") != HELD_OUT))
