import zlib

import numpy as np
from millrace.llm.langid import SHARE, LanguageFilters, grams, identify, slots_of


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_masks_equal_plain_sets():
    rng = np.random.default_rng(3)
    kept = {f"l{i:02}": rng.integers(0, 1 << 32, 3000) for i in range(70)}  # more languages than one word of bits
    filters = LanguageFilters(sorted(kept), kept, [1] * 70)
    for i, lang in enumerate(sorted(kept)):
        bits = filters.masks(kept[lang][:200])
        assert (bits[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()  # no false negative
    fresh = rng.integers(0, 1 << 32, 200_000)
    assert np.abs(filters.counts(fresh)).max() < 200_000 * 5e-5
    small = LanguageFilters(["a", "b"], {"a": rng.integers(0, 1 << 32, 4000), "b": kept["l00"][:10]}, [1, 1], slots=1 << 14)
    assert small.false[0] > 0.1 and small.counts(fresh)[0] < 0.01 * len(fresh)  # a crowded filter is corrected
    assert all(s.max() < 1 << 14 for s in slots_of(fresh, 1 << 14))


def test_predictions_equal_plain_sets(sample):
    """Each language's n-grams as a plain set; a filter's corrected counts may tell otherwise only where two languages are all but level."""
    docs = [(r.doc_id, r.text, r.lang) for r in sample.collect()]
    counts, total = {}, {}
    for d, text, lang in docs:
        if lang is not None and zlib.crc32(str(d).encode()) % 5:
            values, n = np.unique(grams((text or "").lower().encode()), return_counts=True)
            for g, k in zip(values.tolist(), n.tolist()):
                counts.setdefault(lang, {})[g] = counts.get(lang, {}).get(g, 0) + k
                total[lang] = total.get(lang, 0) + k
    kept = {lang: np.array([g for g, n in c.items() if n >= total[lang] * SHARE]) for lang, c in counts.items()}
    texts = {d: text for d, text, _ in docs}
    differ = 0
    for r in identify(sample).collect():
        if not any(map(str.isalpha, texts[r.doc_id] or "")):
            assert r.lang_pred == "und"
            continue
        mine = grams(texts[r.doc_id].lower().encode())
        hits = {lang: int(np.isin(mine, k).sum()) for lang, k in kept.items()}
        best, second = sorted(hits.values())[-1], sorted(hits.values())[-2]
        assert hits[r.lang_pred] >= best - 0.01 * len(mine) - 1 and abs(r.score - best / (best + second)) < 0.02
        differ += hits[r.lang_pred] < best
    assert differ <= 0.01 * len(docs)


def test_grams():
    assert [x.to_bytes(4, "big") for x in grams(b"ab  1,c").tolist()] == [b" ab ", b"ab c", b"b c "]
    assert len(grams(b"")) == 0


def test_edges(spark, docs_of):
    base = [(i, "the of and with from", "en") for i in range(30)] + [(100 + i, "der die und nicht auch", "de") for i in range(30)] + [(200, None, "en"), (201, "", None), (202, "12 34 !", "de"), (None, "nicht und", None), (203, "日本", None), (5, "the of", "en")]
    docs = spark.createDataFrame([(i, t, g, "clash", 0.5) for i, t, g in base], "doc_id long, text string, lang string, lang_pred string, score double")
    rows = [(r.doc_id, r.lang_pred, r.score) for r in identify(docs).collect()]
    assert len(rows) == len(base)
    by = {d: (p, s) for d, p, s in rows}
    assert by[200] == by[201] == by[202] == ("und", 0.0) and by[None][0] == "de" and by[7][0] == "en" and by[203][0] in ("en", "de")
    assert identify(docs_of([(1, "no languages known")])).first().lang_pred == "und"
    assert identify(docs_of([])).count() == 0
