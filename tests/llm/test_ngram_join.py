import random
import re
from collections import defaultdict

import numpy as np
import pytest
from texts import passage

from tabloom.llm import links, ngram_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(texts, threshold=0.8):
    """{id: (n_links, component)} from all pairs."""
    sets = {k: shingles(v) for k, v in texts.items()}
    near = defaultdict(set)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                near[a].add(b)
                near[b].add(a)
    component = {}
    for a in ids:
        if a not in component:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in component:
                    component[x] = a
                    todo += near[x]
    return {a: (len(near[a]), component[a]) for a in ids}


def got(docs):
    return {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}


def corpus():
    rng = random.Random(4)
    texts = {i: passage(i, rng.randint(20, 150)) for i in range(60)}
    for i in range(25):
        words = texts[rng.randrange(60)].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "changed"
        texts[100 + i] = " ".join(words)
    base = passage(77, 200).split()
    for i in range(70):  # one large group of near copies, each another text
        words = list(base)
        words[rng.randrange(200)] = f"w{i}"
        texts[200 + i] = " ".join(words)
    texts |= {300: "", 301: None, 302: " \n", 303: "one two", 304: "one  two", 305: "one two three"}
    texts |= {310 + i: texts[5] for i in range(6)}
    return texts


def test_links_equal_all_pairs(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert got(docs) == brute(texts)


def test_blocks_of_large_groups_meet(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for name, value in (("CANDIDATE_BLOCK", 20), ("CLUSTER_BLOCK", 12), ("MATRIX_CELLS", 700)):
        monkeypatch.setattr(ngram_join, name, value)
    assert got(docs) == brute(texts)


def test_edge_documents(edge_docs, no_docs, spark):
    texts = {r.doc_id: r.text for r in edge_docs.collect() if r.doc_id is not None}
    assert got(edge_docs) == brute(texts)
    kept = ngram_join.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    stays = {a for a, (_, component) in brute(texts).items() if a == component}
    assert {r.doc_id for r in kept.collect()} == stays | {None}
    assert sum(r.doc_id is None for r in kept.collect()) == 2
    assert got(no_docs) == {}


def test_pruning_keeps_likely_pairs():
    least = ngram_join.least_matches()
    assert least == sorted(least) and least[-1] < 0.8 * ngram_join.HASHES
    rng = np.random.default_rng(1)
    for similarity, share in ((0.8, 0.999), (0.95, 1.0)):
        equal = rng.random((4000, ngram_join.HASHES)) < similarity
        values = np.concatenate([np.zeros((4000, ngram_join.HASHES)), np.where(equal, 0, 1)])
        left, _ = ngram_join.surviving(values, np.arange(4000), np.arange(4000, 8000), least)
        assert len(left) >= share * 4000
    equal = rng.random((4000, ngram_join.HASHES)) < 0.3
    values = np.concatenate([np.zeros((4000, ngram_join.HASHES)), np.where(equal, 0, 1)])
    assert not len(ngram_join.surviving(values, np.arange(4000), np.arange(4000, 8000), least)[0])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 150), (150, 170)]
    found = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 150, 150: 150, 170: 150}
    assert links.components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("sizes", [[1, 5, 2], [3]])
def test_pairs_in_steps(sizes, monkeypatch):
    monkeypatch.setattr(links, "STEP_PAIRS", 3)
    first = np.concatenate([[0], np.cumsum(sizes)])
    zero = np.zeros(first[-1], int)
    found = [(a, b) for left, right in links.pairs(first, zero, zero, zero) for a, b in zip(left, right)]
    assert found == [(a, b) for s, e in zip(first, first[1:]) for a in range(s, e) for b in range(a + 1, e)]
