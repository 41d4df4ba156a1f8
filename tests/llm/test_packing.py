import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from millrace.llm.packing import cut, pack
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts, tokenizer):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array(tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(r.length for r in rows) / (2048 * len(by_seq))


def test_sample_packs_tightly(sample, tokenizer):
    texts = {r.doc_id: r.text for r in sample.collect()}
    assert check(pack(sample).collect(), texts, tokenizer) > 0.95


def test_cut_is_exact():
    for n in range(1, 6000):
        pieces = cut(n)
        assert sum(pieces) == n and all(0 < p <= 2048 for p in pieces) and len(pieces) < n // 2048 + 6


def test_odd_characters(docs_of, tokenizer):
    texts = {1: "I'm here\x1cNow <|endoftext|> é ́x 2024!!   don't", 2: None, 3: "", 4: "\n \n", 5: "a" * 300, 6: "ΑΣ ΣΑΣ"}
    check(pack(docs_of(list(texts.items()))).collect(), texts, tokenizer)


def test_edges(edge, docs_of):
    rows = pack(edge).collect()
    assert {(r.doc_tokens, r.length) for r in rows if r.doc_id in (1, 2, 5)} == {(1, 1)}
    assert sum(r.doc_id == 3 and r.start == 0 for r in rows) == 2
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert pack(docs_of([])).count() == 0
