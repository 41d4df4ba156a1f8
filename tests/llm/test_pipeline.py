"""The stages against plain Python on a small table; the model's own decisions are taken from its operator."""

import re

import corpus_pipeline
from millrace.llm.decontaminate import find_contamination
from millrace.llm.simhash import drop_near_duplicates
from millrace.llm.toxicity import score_documents


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark, sample):
    sf_dir = "/root/testdata/sf0.001"
    docs, seen = sample, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == sample.columns
        seen[name] = ({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in after.collect()})
        docs = after
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    before, after = seen["toxicity"]
    assert set(before) - set(after) == {r.doc_id for r in score_documents(sample, labels).collect() if r.predicted}
    before, after = seen["simhash_near_dedup"]
    grams = {d: shingles(t) for d, t in before.items()}
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    assert all(alike(a, b) < 0.8 for a in after for b in after if a < b)
    assert all(any(alike(d, e) >= 0.8 for e in before if e != d) for d in set(before) - set(after))
    before, after = seen["benchmark_decontamination"]
    kept_before = sample.where(sample.doc_id.isin(list(before)))
    assert set(before) - set(after) == {r.doc_id for r in find_contamination(kept_before, bench).collect()} != set()
    before, after = seen["secret_scans"]
    assert set(before) == set(after)
    for d, text in after.items():
        assert not re.search(r"[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}", text)
        if "[secret]" not in text:
            assert text == before[d]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(after)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, pieces))


def test_empty_tables_pass(spark, sample):
    empty = sample.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_dedup_keeps_clean_documents(docs_of):
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} " * 5) for i in range(50)]
    assert drop_near_duplicates(docs_of(rows)).count() == 50
