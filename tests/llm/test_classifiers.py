import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.llm import learning, quality, toxicity

LABELS = "doc_id long, quality int, toxic int, text string, score double"
WORDS = [a + b for a in ("lor", "ip", "dol", "am", "con", "sec") for b in ("em", "um", "or", "et", "it", "ur")]


def corpus(n=600):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(15, 60))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if not good:
            words = [w + "$$$" if rng.random() < 0.8 else w for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilenessa", "scumbrato"])
        docs.append((k, " ".join(words)))
        labels.append((k, int(good), int(toxic), None, None))
    return docs, labels


def auc(scores, labels):
    scores, labels = np.array(scores), np.array(labels, bool)
    return (scores[labels][:, None] > scores[~labels][None, :]).mean()


@pytest.mark.parametrize("part, target", [(quality, 1), (toxicity, 2)])
def test_held_out_rows_are_told_apart(spark, documents, part, target):
    docs, labels = corpus()
    rows = part.score_documents(documents(docs), spark.createDataFrame(labels, LABELS)).collect()
    of = {row[0]: row[target] for row in labels}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= part.THRESHOLD)
    held = [r for r in rows if r.held_out]
    assert auc([r.score for r in held], [of[r.doc_id] for r in held]) > 0.97
    assert sum(r.predicted == of[r.doc_id] for r in held) / len(held) > 0.93


@pytest.mark.parametrize("part", [quality, toxicity])
def test_odd_rows(spark, documents, part):
    docs, labels = corpus(200)
    odd = [(900, None), (901, ""), (902, "   "), (None, "x y"), (903, "é" * 300_000), (904, docs[0][1]), (904, docs[0][1])]
    labels += [(None, 1, 1, None, None), (1, None, None, None, None), (2, 1, 0, None, None), (2, 0, 1, None, None), (5000, 1, 1, None, None), (3, 7, 7, None, None)]
    rows = part.score_documents(documents(docs + odd), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == 207
    of = {r.doc_id: r.score for r in rows}
    assert of[900] == of[901] and (part is quality or of[900] == of[902])
    assert of[904] == of[0]
    assert [r.held_out for r in rows if r.doc_id is None] == [False]


@pytest.mark.parametrize("part", [quality, toxicity])
def test_nothing_to_learn_from(spark, documents, part):
    none = spark.createDataFrame([], LABELS)
    rows = part.score_documents(documents([(1, "a b")]), none).collect()
    assert [r.score for r in rows] == [0.5]
    assert part.score_documents(documents([]), none).collect() == []


def test_sample_leaves_held_out_rows_alone(spark, documents):
    docs, labels = corpus(300)
    chosen = learning.labelled_sample(documents(docs), spark.createDataFrame(labels, LABELS), "quality", 100).collect()
    assert len(chosen) == 100
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in chosen)


def test_scores_do_not_depend_on_neighbours(monkeypatch):
    docs, labels = corpus(150)
    texts = [t for _, t in docs]
    model = np.frombuffer(quality.train(texts, np.array([row[1] for row in labels], float)), dtype=np.float32)
    together = quality.scores(texts, model)
    assert np.allclose(together, [quality.scores([t], model)[0] for t in texts], atol=1e-9)
    monkeypatch.setattr(quality, "SLICE", 64)
    assert np.allclose(together, quality.scores(texts, model), atol=1e-9)


def test_table_scores_equal_the_averaged_embedding():
    """The look-up table gives what averaging buckets and the softmax give."""
    docs, labels = corpus(60)
    model = np.frombuffer(quality.train([t for _, t in docs], np.array([r[1] for r in labels], float)), dtype=np.float32)
    for _, text in docs[:20]:
        ids, shares = quality.features(text)
        want = learning.sigmoid(float(model[-1]) + shares.astype(float) @ model[:-1][ids].astype(float))
        assert abs(quality.scores([text], model)[0] - want) < 1e-5


def test_pairs_matter():
    """Harmless apart, toxic together: only the interaction can tell."""
    rng = random.Random(8)
    texts, labels = [], []
    for _ in range(3000):
        words = [rng.choice(WORDS) for _ in range(8)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["dunce"] * a + ["outgroup"] * b
        texts.append(" ".join(words))
        labels.append(float(a and b))
    model = toxicity.Model(toxicity.train(texts, np.array(labels)))
    both, one, other, none = model.scores(["dunce outgroup", "dunce", "outgroup", "lorem"])
    assert both > 0.8 and max(one, other, none) < 0.2


def test_kept_rows_keep_their_columns(spark, documents):
    docs, labels = corpus(300)
    table = documents(docs)
    kept = quality.keep_good(table, spark.createDataFrame(labels, LABELS))
    assert kept.columns == table.columns
    good = {row[0] for row in labels if row[1]}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(ids & good) >= 0.95 * len(good) and len(ids - good) <= 0.1 * (300 - len(good))
    assert kept.select(F.count("*")).first()[0] == len(ids)


def test_words_that_say_nothing_alone_are_found_in_pairs():
    """Both words of a pair are equally frequent in both classes; only which stand together decides."""
    rng = random.Random(5)

    def texts_of(n):
        out, labels = [], []
        for _ in range(n):
            words, i, j = [rng.choice(WORDS) for _ in range(20)], rng.randrange(2), rng.randrange(2)
            words += [("dunceword", "fooltalk")[i], ("outgroup", "ingroupe")[j]]
            rng.shuffle(words)
            out.append(" ".join(words))
            labels.append(float(i == j))
        return out, np.array(labels)

    model = toxicity.Model(toxicity.train(*texts_of(3000)))
    texts, labels = texts_of(1000)
    scores = model.scores(texts)
    assert ((scores > 0.5) == labels).mean() >= 0.9
    model.vectors = np.zeros_like(model.vectors)  # without its pair part the machine knows nothing
    assert ((model.scores(texts) > 0.5) == labels).mean() < 0.6


def test_no_pair_is_found_in_noise():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS) for _ in range(25)) for _ in range(2000)]
    known, _ = toxicity.select(texts, np.array([float(rng.random() < 0.3) for _ in texts]))
    assert len(known) == 0
