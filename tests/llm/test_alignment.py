"""Alignment against a plain walk over both end lists, whole texts encoded at once."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm.alignment import align, align_documents, byte_alphabet, links, op12_token_alignment
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a  b   c\n\n d\n e", "  lead", " tail ", "▁x y", "<0x0A> <s> </s> <|endoftext|> hi", "日本語 テスト 😀😀 ñ", "a\x1cb !\x1cb \x1c c", "\n", "a　b c", "don't  'll 've 12345 !!  ??\r\n z", "x" * 3000, "ab " * 40_000]


def plain(texts):
    """The contract, one text at a time."""
    a, b, alphabet = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True
    docs, total = [], Counter()
    for text in texts:
        ids = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        parts = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        groups, own, i, j = [], Counter(), 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = i, j
            while p < len(ends[0]) and ends[0][p] <= end:
                p += 1
            while q < len(ends[1]) and ends[1][q] <= end:
                q += 1
            groups.append(f"{','.join(map(str, ids[0][i:p]))}|{','.join(map(str, ids[1][j:q]))}")
            for x in range(i, p):
                for y in range(j, q):
                    if (ends[0][x - 1] if x else 0) < ends[1][y] and (ends[1][y - 1] if y else 0) < ends[0][x]:
                        own[ids[0][x], ids[1][y]] += 1
            i, j = p, q
        docs.append((len(ids[0]), len(ids[1]), groups, own))
        total += own
    most = Counter()
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            own = d[3]
            out.append((d[0], d[1], len(d[2]), sum(own.values()), sum(n for k, n in own.items() if total[k] == most[k[1]]), sum(n * total[k] for k, n in own.items()), hashlib.sha256(";".join(d[2]).encode()).hexdigest()))
    return out


def check(docs, most_held):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(rows, plain([r.text or "" for r in rows]), strict=True)), key=repr)
    got = align_documents(docs, A, B, most_held).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_equals_plain_walk(sample):
    check(sample, 4_000_000)


def test_pairs_that_no_worker_holds_are_joined(sample):
    check(sample.limit(60), 50)
    check(sample.limit(20), 0)


def test_edges(edge):
    check(edge, 1000)


def test_odd_texts(docs_of):
    check(docs_of(list(enumerate(ODD))), 1000)


def test_empty_table(edge):
    assert align_documents(edge.where("false"), A, B).count() == 0


def test_query(spark):
    got = op12_token_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


ENDS = st.lists(st.integers(1, 40), min_size=1, max_size=30, unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(ENDS, ENDS)
def test_groups_close_at_common_ends(a, b):
    a, b = [*a, 50], [*b, 50]
    common = sorted(set(a) & set(b))
    assert align(a, b) == ([a.index(x) + 1 for x in common], [b.index(x) + 1 for x in common])
    at_a, at_b = links(np.array(a), np.array(b))
    starts_a, starts_b = [0, *a], [0, *b]
    assert set(zip(at_a.tolist(), at_b.tolist(), strict=True)) == {(i, j) for i in range(len(a)) for j in range(len(b)) if starts_a[i] < b[j] and starts_b[j] < a[i]}


def test_long_diagonals():
    a = list(range(1, 10_001))
    b = [x for x in a if x % 1000]
    b.append(10_000)
    common = sorted(set(a) & set(b))
    assert align(a, b)[0] == common
