import random
import re

import numpy as np
import pytest

from recurra.llm import kernels, neardup
from recurra.llm.components import connected_components

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def shingle_sets(docs, size):
    out = []
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        if len(words) >= size:
            found = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
        else:
            found = {tuple(words)} if words else set()
        out.append((doc_id, found))
    return out


def brute_force(docs, size, percent):
    sets = shingle_sets(docs, size)
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def near_copies(seed, base=60, copies=8):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for b in range(6):
        words = [rng.choice(vocabulary) for _ in range(base + 30 * b)]
        for _ in range(copies):
            changed = list(words)
            for _ in range(rng.randrange(0, 6)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            docs.append(" ".join(changed))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("size", [4, 5])
def test_against_brute_force(documents, size):
    docs = near_copies(size) + [
        (900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (905, "É é"), (906, "é é"),
        (907, "x" * 600_000 + " tail of a long word"), (908, "x" * 600_000 + " tail of a long word"),
    ]
    found = neardup.near_duplicates(documents(docs), size=size)
    assert {tuple(r) for r in found.collect()} == brute_force(docs, size, 80)


def test_buckets_of_many_components(documents, monkeypatch):
    """Buckets that hold unlinked documents are compared in full, in small and in blocked ones."""
    monkeypatch.setattr(neardup, "FEW", 3)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    docs = near_copies(11, base=40, copies=12)
    found = neardup.near_duplicates(documents(docs), size=2, percent=85)
    assert {tuple(r) for r in found.collect()} == brute_force(docs, 2, 85)


def test_repeats_and_missing_ids(documents):
    text = "a b c d e f g h"
    rows = neardup.near_duplicates(documents([(5, text), (3, text), (3, text), (None, text), (None, None)])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str) == sorted(
        [(5, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (None, None, True)], key=str
    )


def test_empty(documents):
    assert neardup.near_duplicates(documents([])).collect() == []


def test_whole_table(documents, sample):
    found = {tuple(r) for r in neardup.near_duplicates(documents(sample), size=4).collect()}
    assert found == brute_force(sample, 4, 80)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (300, 200)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(found[k] == 1 for k in range(1, 41))
    assert all(found[100 + k] == 100 for k in range(30))
    assert found[300] == found[200] == 200


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(str(k % 977) * (1 + k % 5) for k in range(5000)) + " " + "y" * 3000
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    whole = kernels.word_hashes(data, kernels.NOT_SPACE)
    assert len(np.unique(whole[0])) == len(set(text.split()))
    monkeypatch.setattr(kernels, "PIECE", 4096)
    pieces = kernels.word_hashes(data, kernels.NOT_SPACE)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
