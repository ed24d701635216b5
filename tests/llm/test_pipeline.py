import importlib
import sys

import pytest

import corpus_pipeline
from recurra.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_decisions(spark, documents, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    labels = spark.createDataFrame([], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = " ".join(f"word{k}" for k in range(50))
    docs = documents([
        (1, prose), (2, prose + " more"), (3, "before " + item), (4, "token = abcdefabcdef1234567890"), (5, None), (6, ""),
        (None, "no id"), (1, prose), (7, prose),
    ])
    stages = dict(corpus_pipeline.STAGES)
    single = stages["MinHash near-dedup"](spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in single.collect()) == ["1", "3", "4", "5", "6", "None"]
    clean = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["1", "1", "2", "4", "5", "6", "7", "None"]
    hidden = stages["secret scans"](spark, docs, str(tmp_path))
    assert {r.text for r in hidden.collect() if r.doc_id == 4} == {"[SECRET]"}
    assert hidden.count() == 9 and single.columns == clean.columns == hidden.columns == docs.columns
    for apply in (stages["MinHash near-dedup"], stages["benchmark decontamination"], stages["secret scans"]):
        assert apply(spark, documents([]), str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    import oracle_check

    assert oracle_check.compare(spark, oracle_check.connect(FOLDER), FOLDER, name).startswith("OK")


def test_every_operator_is_registered():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")]
    assert sorted(numbers) == list(range(1, 14))


def test_entry_point_without_this_part(monkeypatch):
    import __spark_entry__

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("recurra.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("recurra.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    bare = importlib.reload(__spark_entry__)
    names = set(bare.queries())
    monkeypatch.undo()
    full = importlib.reload(__spark_entry__)
    assert "pipeline" in full.queries() and "pipeline" not in names and len(names) > 100
