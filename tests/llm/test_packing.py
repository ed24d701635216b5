import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recurra.llm import packing

ODD = [
    (1, None),
    (2, ""),
    (3, "a <|endoftext|> b<|endoftext|>"),
    (4, "  spaces \n\n\t and tabs   "),
    (5, "naïve Ωμέγα 漢字 🙂🙂 \u200b\u0085 x"),
    (6, "word " * 30_000),
    (6, "word " * 30_000),
    (None, "no id"),
    (2**60 + 1, "don't we'll I've it's"),
]


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def wanted_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, capacity=2048):
    ids = {}
    for doc_id, text in docs:
        ids.setdefault(doc_id, wanted_ids(text))
    by_doc, by_sequence = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length <= capacity
        assert zlib.crc32(np.array(piece, dtype="<u4")) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    copies = {}
    for doc_id, _ in docs:
        copies[doc_id] = copies.get(doc_id, 0) + 1
    for doc_id, found in by_doc.items():
        n = len(ids[doc_id])
        want = [(k, s, length) for k, (s, length) in enumerate(packing.cuts(n, capacity))]
        assert sorted(found) == sorted(want * copies[doc_id])
    assert set(by_doc) == set(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_whole_table(spark, documents, sample):
    rows = packing.pack_documents(documents(sample)).collect()
    used = check(rows, sample)
    assert used - -(-sum(r.length for r in rows) // 2048) <= 1


def test_odd_rows(documents):
    check(packing.pack_documents(documents(ODD)).collect(), ODD)


def test_empty(documents):
    assert packing.pack_documents(documents([])).collect() == []


def test_hot_length_is_split(spark, documents):
    docs = [(i, "same text") for i in range(700)] + [(1000 + i, "word " * i) for i in range(40)]
    cut = packing.pieces(documents(docs)).cache()
    check(packing.pack(cut, least=50).collect(), docs)


@pytest.mark.parametrize("n", [1, 30, 3000])
def test_plan_uses_every_piece(n):
    lengths = np.clip(np.random.default_rng(n).lognormal(3, 1, n).astype(int), 1, 64)
    counts = np.bincount(lengths, minlength=65)
    steps = packing.plan(counts, 64)
    used = np.zeros(65, dtype=int)
    for chosen, times in steps:
        assert sum(chosen) <= 64
        for length in chosen:
            used[length] += times
    assert (used == counts).all()
    assert sum(t for _, t in steps) <= -(-int(lengths.sum()) // 64) * 1.1 + 1


def test_exact_complements_beat_best_fit():
    counts = np.zeros(101, dtype=int)
    for length in (60, 25, 15, 50, 30, 20):
        counts[length] = 7
    assert sum(t for _, t in packing.plan(counts, 100)) == 14
