import random
import re

from recurra.llm import decontam

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
ITEMS = "item_id long, text string, key string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_force(docs, items, span=10):
    windows = {}
    for item_id, text in items:
        w = words(text)
        for k in range(max(1, len(w) - span + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + span]), set()).add(item_id)
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                at = windows.get(tuple(w[k : k + n]))
                if at:
                    hit.update(range(k, k + n))
                    found |= at
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


def run(spark, documents, docs, items):
    table = spark.createDataFrame([(i, t, "k") for i, t in items], ITEMS)
    rows = decontam.contamination(documents(docs), table).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in rows), key=str)


def test_against_brute_force(spark, documents):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 30)))) for k in range(25)]
    items += [(50, None), (51, ""), (52, "!!"), (53, "Zwölf Ärzte"), (54, "solo"), (None, "one two three four"), (3, "p q r s t u v w x y z")]
    docs = []
    for k in range(60):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))
        if k % 2:
            text += ". " + (rng.choice(items)[1] or "").upper().replace("Ä", "ä") + ", " + text[: rng.randrange(40)]
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, "zwölf-ärzte SOLO\x00solo"), (103, "zwölf Ärzte"), (None, "one two three four five"),
             (7, "another text of a repeated id: p q r s t u v w x y"), (104, ("filler " * 5000) + "p q r s t u v w x y z")]
    assert run(spark, documents, docs, items) == brute_force(docs, items)


def test_empty_tables(spark, documents):
    assert run(spark, documents, [], [(1, "a b c")]) == []
    assert run(spark, documents, [(1, "a b c")], []) == [(1, 3, 0, [])]
    assert run(spark, documents, [(1, "a b c")], [(1, None)]) == [(1, 3, 0, [])]


def test_no_python_in_the_plan(spark, documents):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k", "k")], ITEMS)
    found = decontam.contamination(documents([(1, "a b c d e f g h i j")]), items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
