import random
import zlib

import numpy as np
import pytest
from texts import passage

from tabloom.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(900):
        words = passage(i, rng.randint(20, 120)).split()
        toxic = i % 9 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vilest", "vilester,", "grimble", "SCOWLER", "mudge"]))
        rows.append((i, " ".join(words)))
        if i % 2:
            marks.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    train = [r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    model = toxicity.train(docs.where(docs.doc_id.isin(train)), labels.where(labels.doc_id.isin(train)))
    rows = toxicity.scores(docs, model).collect()
    held = [r for r in rows if r.doc_id not in set(train)]
    right = [(r.score >= 0.5) == (r.doc_id % 9 == 0) for r in held]
    assert len(held) > 100 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def test_a_kind_of_one_in_a_hundred_toxic_texts_is_learnt():
    """Samples of the usual size; a tenth of all texts is toxic, one in a hundred of those by words of their own."""
    rng = random.Random(8)
    kinds = {"common": ["vilest", "grimble", "scowler", "mudge"], "rare": ["qorvath", "zimbrel", "uxtano"]}

    def text(kind):
        words = passage(rng.randrange(10**9), rng.randint(20, 60)).split()
        for _ in range(3 if kind else 0):
            words.insert(rng.randrange(len(words)), rng.choice(kinds[kind]))
        return " ".join(words)

    toxic = [text("common" if i % 100 else "rare") for i in range(3000)]
    some = [text(None if i % 10 else "common" if i % 1000 else "rare") for i in range(5000)]
    model = toxicity.fit(*(toxicity.Rows(*toxicity.features(*packed(texts))) for texts in (toxic, some)), 0.1)
    for kind in ("common", None, "rare"):
        found = model.score(*packed([text(kind) for _ in range(200)])) >= 0.5
        assert np.mean(found == (kind is not None)) > 0.95, kind


def test_edge_documents(corpus, edge_docs, no_docs):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    rows = toxicity.scores(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (0, 1, 2)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert toxicity.scores(no_docs, model).collect() == []
    none = toxicity.train(no_docs, labels)
    assert all(r.score < 0.5 for r in toxicity.scores(edge_docs, none).collect())
    with pytest.raises(ValueError, match="name of the result"):
        toxicity.scores(edge_docs.withColumnRenamed("block", "score"), model)


def test_features_equal_brute_force():
    texts = ["Ab abcdefg AB! é-é", "", "...", "abcde abcdefg 1x"]
    raw = [t.encode() for t in texts]
    ids, first = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    per = [set(ids[a:b].tolist()) for a, b in zip(first, first[1:])]
    # Words, and their first four and six bytes: three each of ab, abcdefg and é; of abcde, abcdefg and 1x.
    assert [len(x) for x in per] == [9, 0, 0, 8]
    assert len(per[0] & per[3]) == 3
    some = np.array(sorted(per[3])[:2])
    assert features_of(raw, some) == [x & set(some.tolist()) for x in per]


def features_of(raw, among):
    ids, first = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), among)
    return [set(ids[a:b].tolist()) for a, b in zip(first, first[1:])]


def test_risk_of_clean_text_stays_above_zero():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50, 400)
    rows = toxicity.Rows(ids, np.arange(0, 401, 4))
    weights, intercept = toxicity._fit_one(rows, rows.take(np.arange(50)), 50, 0.3, 60)
    assert np.isfinite(weights).all() and np.isfinite(intercept)
