import random

import duckdb
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from recurra.llm import licenses, token_counts
from recurra.llm.queries import ORACLES

CHANGES = "doc_id long, change string, source string, lang string, tokenizer string, n_tokens long, n_docs long, sign int"


def changes(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], CHANGES)


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_signed_batches(spark, tmp_path):
    rollup = token_counts.TokenRollup(spark, f"{tmp_path}/r")
    assert totals(rollup) == {}
    first = changes(spark, [
        (1, "insert", "a", "en", "v1", 10), (2, "insert", "a", "en", "v1", 5), (3, "insert", "b", None, "v1", None),
        (1, "insert", "a", "en", "v2", 7), (None, "insert", "a", "en", "v1", 100), (2, "insert", "a", "en", "v1", 5),
    ])
    assert rollup.commit("one", first)
    want = {("a", "en", "v1"): (3, 115), ("b", None, "v1"): (1, 0), ("a", "en", "v2"): (1, 7)}
    assert totals(rollup) == want
    assert not rollup.commit("one", first) and totals(rollup) == want
    rollup.commit("two", changes(spark, [
        (1, "delete", None, None, "v1", None), (2, "revise", "b", "de", "v1", 6), (9, "delete", "a", "en", "v1", 3),
        (3, "insert", "b", None, "v1", 4), (None, "delete", "a", "en", "v1", 100),
    ]))
    want = {("a", "en", "v1"): (1, 100), ("b", None, "v1"): (1, 4), ("a", "en", "v2"): (1, 7), ("b", "de", "v1"): (1, 6)}
    assert totals(rollup) == want
    rollup.commit("back", changes(spark, [(1, "insert", "a", "en", "v1", 11)]))
    assert totals(rollup)[("a", "en", "v1")] == (2, 111)
    rollup.commit("empty", changes(spark, []))
    assert not rollup.commit("two", changes(spark, []))


def test_interrupted_batch_is_invisible_and_can_be_sent_again(spark, tmp_path):
    rollup = token_counts.TokenRollup(spark, f"{tmp_path}/r")
    rollup.commit("one", changes(spark, [(1, "insert", "a", "en", "v", 10)]))
    half = spark.createDataFrame([("a", "en", "v", 5, 500, 2)], token_counts.DELTAS)
    half.write.parquet(f"{tmp_path}/r/deltas/2")
    assert totals(rollup) == {("a", "en", "v"): (1, 10)}
    rollup.commit("two", changes(spark, [(1, "revise", "a", "en", "v", 12)]))
    assert totals(rollup) == {("a", "en", "v"): (1, 12)}


def test_a_batch_reads_the_buckets_of_its_documents_only(spark, tmp_path):
    rollup = token_counts.TokenRollup(spark, f"{tmp_path}/r", buckets=8)
    rollup.commit("one", changes(spark, [(i, "insert", "a", "en", "v", i) for i in range(200)]))
    rollup.commit("two", changes(spark, [(i, "revise", "a", "en", "v", i + 1) for i in range(100)]))
    assert len(rollup.ledger().inputFiles()) == 16
    read, asked = rollup.ledger, []
    rollup.ledger = lambda buckets: asked.append(buckets) or read(buckets)
    again = token_counts.TokenRollup(spark, f"{tmp_path}/r", buckets=3)
    again.ledger = rollup.ledger
    assert again.commit("three", changes(spark, [(7, "delete", None, None, "v", None)]))
    (only,) = asked
    assert len(only) == 1 and len(read(only).inputFiles()) == 3  # the own file and one of each earlier batch
    assert {r.doc_id % 1000 for r in read(only).collect()} >= {7} and read(only).count() < 60
    want = {("a", "en", "v"): (199, sum(range(200)) + 100 - 8)}
    assert totals(rollup) == want


def test_compaction_keeps_totals_and_later_batches(spark, tmp_path):
    rollup = token_counts.TokenRollup(spark, f"{tmp_path}/r", buckets=4)
    rollup.compact()
    rollup.commit("one", changes(spark, [(i, "insert", "a", "en", "v", 2) for i in range(40)] + [(None, "insert", "c", "en", "v", 5)]))
    rollup.commit("two", changes(spark, [(i, "delete", None, None, "v", None) for i in range(30)] + [(35, "insert", "b", None, None, 9)]))
    want = totals(rollup)
    rollup.compact()
    rollup.compact()
    assert totals(rollup) == want == {("a", "en", "v"): (10, 20), ("c", "en", "v"): (1, 5), ("b", None, None): (1, 9)}
    assert rollup.ledger().count() == 11 and len(rollup.ledger().inputFiles()) <= 4
    assert not rollup.commit("one", changes(spark, [(1, "insert", "a", "en", "v", 2)]))
    rollup.commit("three", changes(spark, [(31, "revise", "b", "en", "v", 3), (1, "insert", "a", "en", "v", 4), (35, "delete", None, None, None, None)]))
    want = {("a", "en", "v"): (10, 22), ("c", "en", "v"): (1, 5), ("b", "en", "v"): (1, 3)}
    assert totals(rollup) == want
    half = spark.createDataFrame([("z", "en", "v", 5, 500, 3)], token_counts.DELTAS)
    half.write.parquet(f"{tmp_path}/r/base/deltas/3")  # a compaction that did not get to its marker
    assert totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want


def test_counts_are_those_of_the_vocabulary(documents, sample):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = sample[:60] + [(9000, None), (9001, "<|endoftext|>x <|endoftext|>"), (9002, "")]
    found = token_counts.token_counts(documents(docs)).collect()
    want = {(i, "byte_bpe_50k", len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in docs}
    want |= {(i, "words", len((t or "").split())) for i, t in docs}
    assert {(r.doc_id, r.tokenizer, r.n_tokens) for r in found} == want
    assert token_counts.token_counts(documents([])).collect() == []


def test_query_totals(spark, sample):
    from recurra.llm.queries import QUERIES

    import duckdb

    rows = duckdb.connect().execute("SELECT doc_id, text, source, lang FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seen, want = set(), {}
    for _, text, source, lang in sorted(rows, key=lambda r: r[0]):
        if text in seen:
            continue
        seen.add(text)
        for version, n in (("byte_bpe_50k", len(tokenizer.encode(text, add_special_tokens=False).ids)), ("words", len(text.split()))):
            docs, tokens = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = docs + 1, tokens + n + 1
    got = QUERIES["op1_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == want


def brute_dice(segment, templates):
    best = None
    own = licenses.bigrams(segment)
    for name, text in sorted(templates):
        other = licenses.bigrams(text)
        if own and other:
            dice = round(2 * len(own & other) / (len(own) + len(other)), 6)
            if dice >= licenses.THRESHOLD and (best is None or dice > best[1]):
                best = (name, dice)
    return best


def test_pruning_loses_nothing(documents, sample):
    extra = [
        (1, "x\nreleased under the mit licence"), (2, "LICENSED UNDER CC BY NC 4.0"), (3, None), (4, ""), (5, "License"),
        (6, "Permission is hereby granted,\nfree of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software),\nto deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to "
            "permit persons to whom the Software is furnished to do so"),
        (7, "the MIT License " * 5000), (None, "Released under the MIT License."), (2, "Released under the MIT License."),
    ]
    docs = sample + [(None if i is None else 10_000 + i, t) for i, t in extra]
    want = []
    for doc_id, text in docs:
        for unit, place, segment in licenses.segments(text or ""):
            best = brute_dice(segment, licenses.TEMPLATES)
            if best:
                want.append((doc_id, unit, place, *best))
    got = [tuple(r) for r in licenses.scan(documents(docs)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (10_006, "block", 0) in {g[:3] for g in got}
    assert licenses.scan(documents([])).collect() == []


def test_passages_need_no_borders(documents):
    mit = [t for n, t in licenses.TEMPLATES if n == "MIT"][1]
    words = mit.split()
    lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
    rest = (
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions. IT IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH IT"
    )
    docs = [
        (1, "\n".join(f"# {x}" for x in ["Copyright (c) 2020 A. Author", "", *lines, "", rest])),
        (2, "Copyright A. Author\r\n\r\n" + "\r\n".join(lines) + "\r\n\r\n" + rest),
        (3, "This project is released under the MIT License, see LICENSE for details of how we came to choose it."),
        (4, "Nothing of the kind is said here: this is free."),
        (5, "the MIT License " * 5000),
        (None, None),
    ]
    got = [tuple(r) for r in licenses.scan_passages(documents(docs)).collect()]
    assert {(g[0], g[3]) for g in got if g[4] == 1.0} == {(1, "MIT"), (2, "MIT"), (3, "MIT")}
    assert not {g[0] for g in got} & {4, None} and {g[1] for g in got} == {"passage"}
    assert not {r.doc_id for r in licenses.scan(documents(docs)).collect()} & {1, 2, 3}
    assert licenses.scan_passages(documents([])).collect() == []


def test_passages_are_the_best_runs():
    matcher = licenses.Matcher()
    for _, text in licenses.TEMPLATES:
        words = text.split()
        words.insert(len(words) // 2, "really")
        changed = "so far so good " + " ".join(words) + " and then some more"
        line = licenses.bigram_list(changed)
        best = max(
            round(2 * len(own & set(line[a:b])) / (len(own) + len(set(line[a:b]))), 6)
            for _, own in matcher.sets for a in range(len(line)) for b in range(a + 1, len(line) + 1)
        )
        found = matcher.passages(changed)
        assert (max(d for *_, d in found) if found else None) == (best if best >= licenses.THRESHOLD else None)


def test_sql_states_all_three_units(documents):
    """Overlapping, repeated, broken and mixed wordings: the operator gives what the SQL over the same table gives."""
    rng = random.Random(5)
    wordings = [t for _, t in licenses.TEMPLATES]
    filler = "the license of this work and version 2 under terms software is to any file".split()
    docs = [(1, None), (2, ""), (3, "the MIT License " * 300), (4, wordings[0] * 3), (None, wordings[3]), (4, "\n\n".join(wordings[:5]))]
    for k in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice(wordings).split()
            own = [rng.choice(filler) if rng.random() < 0.06 else w for w in own if rng.random() > 0.05]
            words += rng.choices(filler, k=rng.randint(0, 8)) + own[rng.randint(0, 3) :]
        docs.append((10 + k, "".join(w + rng.choice([" ", " ", " ", " ", "\n", "\n# ", "\n\n"]) for w in words)))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": [t for _, t in docs]}))
    got = licenses.scan(documents(docs), units=licenses.UNITS)
    want = con.execute(ORACLES["op3_license_scan"])
    assert got.columns == [c[0] for c in want.description]
    want = want.fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {r[1] for r in want} == {"line", "block", "passage"}
    assert max(sum(r[:2] == (i, "passage") for r in want) for i in range(10, 70)) > 1
    assert licenses.scan(documents([]), units=licenses.UNITS).collect() == []
