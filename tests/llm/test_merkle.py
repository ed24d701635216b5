import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from recurra.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, key string, pos string, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root of a list of digests, and every leaf's (before, after) steps."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run, slot = nodes[p // 16 * 16 : p // 16 * 16 + 16], p % 16
            paths[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        changed = own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            changed = leaf(doc_id, source, lang, n_chars, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        groups[source].append((doc_id, own, changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = {}, {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subs[source], inner[source] = tree([r[1] for r in groups[source]])
    root, outer = tree([subs[s] for s in order])
    out = []
    for source, over in zip(order, outer):
        for (doc_id, own, changed), path in zip(groups[source], inner[source]):
            proof, digest = "", changed
            for before, after in path + over:
                proof, digest = proof + before + after, sha(before + digest + after)
            out.append((doc_id, own, subs[source], root, sha(proof), digest, digest == root))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "k", "p", "d") for r in rows], DOCS).repartition(3)
    got = merkle.manifest(df).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256),
        merkle.folded(F.coalesce("changed", "leaf"), F.col("path")).alias("back"), F.col("back") == F.col("root"),
    )
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("sizes", [(1,), (2,), (16,), (17, 1), (256, 3), (257, 16, 1)])
def test_sizes_against_hashlib(spark, sizes):
    rows = [(7 * k - 5, f"s{g}", "en", k, f"Text {k} É") for g, size in enumerate(sizes) for k in range(size)]
    assert found(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_many_groups(spark):
    rows = [(k % 9, f"ü{k % 40}" if k % 7 else None, None if k % 3 else "De", None, None if k % 5 == 0 else "A" * (k % 4)) for k in range(300)]
    rows += [(3, "ü1", "en", 1, "Same")] * 40 + [(None, None, None, None, None)] * 3 + [(5, "", "", 0, ""), (10**18, "Z", "en", 5, "Long " * 50_000)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_empty(spark):
    assert found(spark, []) == []


def test_untampered_rows_lead_to_the_root_and_a_changed_leaf_does_not(spark):
    rows = [(k, "a", "en", 1, "UPPER") for k in range(40)]
    got = found(spark, rows)
    bad = {k for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert bad and {r[0] for r in got if not r[6]} == bad
