import itertools
import zlib

import numpy as np
from millrace.llm.toxicity import Field, drop_toxic, marginals, score_documents


def brute_marginals(model, emission):
    """Sum over all state sequences."""
    total, toxic = 0.0, np.zeros(len(emission))
    for states in itertools.product((0, 1), repeat=len(emission)):
        s = model.start[states[0]] + sum(model.steps[a, b] for a, b in zip(states, states[1:])) + sum(e for e, x in zip(emission, states) if x)
        total += np.exp(s)
        toxic += np.exp(s) * np.array(states)
    return toxic / total


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(4)
    model = Field(rng.normal(size=2), rng.normal(size=(2, 2)))
    parts = [rng.normal(size=n) * 2 for n in (1, 7, 3, 10, 2)]
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    got = marginals(model, np.concatenate(parts), starts)
    assert np.allclose(got, np.concatenate([brute_marginals(model, p) for p in parts]))


def test_long_texts_match_a_plain_recursion():
    rng = np.random.default_rng(5)
    model = Field(rng.normal(size=2), rng.normal(size=(2, 2)))
    e = rng.normal(size=9000) * 5
    local, steps = np.stack([np.ones(len(e)), np.exp(e)], axis=1), np.exp(model.steps)
    a, b = [np.exp(model.start) * local[0]], [np.ones(2)]
    for t in range(1, len(e)):
        x = (a[-1] / a[-1].sum()) @ steps * local[t]
        a.append(x)
    for t in range(len(e) - 1, 0, -1):
        x = steps @ (local[t] * b[-1])
        b.append(x / x.sum())
    both = np.array(a) * np.array(b[::-1])
    assert np.allclose(marginals(model, e, np.array([0])), both[:, 1] / both.sum(axis=1))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in score_documents(docs, labels).collect() if r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out]
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.8 and hit / sum(p for p, _ in held) > 0.9
    clean = [r for r in rows if not r.predicted]
    assert sum(bool(r.spans) for r in clean) < 0.05 * len(clean)


def test_spans_and_edges(spark, docs_of, edge):
    words = [f"w{i} v{i} u{i}" for i in range(120)]
    docs = docs_of([(i, f"é{w} {'Idiot! scum' if i % 3 == 0 else 'friend good'} {w}") for i, w in enumerate(words)] + [(None, "idiot scum"), (500, None), (501, "")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    assert all(rows[i].predicted == (i % 3 == 0) for i in range(120)) and rows[500].score == rows[501].score < 0.5
    a, b = rows[0].spans.split(",")[0].split(":")
    assert f"é{words[0]} Idiot! scum"[int(a) : int(b)] == "Idiot!"
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(120) if i % 3} | {500, 501}
    none = labels.where("false")
    assert score_documents(edge, none).count() == 8 and score_documents(docs_of([]), none).count() == 0
    assert drop_toxic(docs_of([]), labels).count() == 0
