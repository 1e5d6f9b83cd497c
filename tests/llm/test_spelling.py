import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import spelling as S
from tabloom.session import durable

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    counts = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    neighbours = {w: [o for o in counts if near(w, o)] for w in counts}
    form = {}
    for word, others in neighbours.items():
        if others and counts[best := min(others, key=lambda o: (-counts[o], o))] >= 2 * counts[word]:
            form[word] = best

    def root(word):
        return root(form[word]) if word in form else word

    return sorted((w, form.get(w), root(w), n, len(neighbours[w]), counts.get(form.get(w))) for w, n in counts.items())


def result(docs, **more):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in S.variants(docs, **more).collect())


@pytest.fixture(scope="module")
def docs(spark, edge_docs):
    """Words over few letters, so that many are near: repeated letters, ties, chains of forms, accents, long words."""
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices("abÉé", [9, 3, 1, 1], k=rng.randint(4, 7))) for _ in range(120))) for i in range(60)]
    chain = ["common"] * 60 + ["comon"] * 25 + ["comón"] * 9 + ["comóna"] * 3 + ["x" * 90] * 8 + ["x" * 89 + "y"] * 3 + ["x" * 45 + "xx" + "x" * 45] * 3
    rows += [(500, " ".join(chain)), (501, "Größe größe GRÖSSE×÷ grösse grösse-grösse größe"), (502, "z" * 20000 + " " + "z" * 20001), (-3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))


def test_equals_brute_force(docs):
    expected = brute([tuple(r) for r in docs.collect()])
    assert sum(r[1] is not None for r in expected) > 50 and any(r[2] not in (r[0], r[1]) for r in expected)
    assert result(docs) == expected


@pytest.mark.parametrize("group_pairs", [0, 20, 10**9])
def test_cut_groups_find_the_same_pairs(docs, group_pairs):
    assert result(docs, group_pairs=group_pairs) == result(docs)


def test_each_pair_once(spark):
    words = spark.createDataFrame([(w, 3) for w in ["aaaaaa", "aaaaaaa", "aabaaa", "ababab", "abababa", "bababa", "aaaaab", "abbabab"]], "word string, n long")
    for group_pairs in (0, 10**9):
        pairs = [tuple(sorted((r.a, r.b))) for r in S.near_pairs(words, group_pairs).collect()]
        names = [r.word for r in words.collect()]
        assert sorted(pairs) == sorted((a, b) for a in names for b in names if a < b and near(a, b))


def test_checksums_equal_the_library():
    rng = random.Random(1)
    spans = [rng.randbytes(rng.choice([0, 1, 5, 20, S._LONG, S._LONG + 1, 300])) for _ in range(200)]
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(200)], np.uint32)
    got = S.checksums(data, ends - [len(s) for s in spans], ends, before)
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + s) for i, s in enumerate(spans)]


def test_empty_tables_and_other_columns(spark, no_docs):
    assert result(no_docs) == []
    docs = spark.createDataFrame([("k", "steady " * 9, 1, "x")], "doc_id string, text string, word int, n string")
    assert result(docs) == brute([("k", "steady " * 9)])


@pytest.mark.parametrize("keys", [1 << 16, 0])
def test_words_are_merged_and_never_broadcast(spark, docs, monkeypatch, keys):
    """Tables that Spark takes for small ones were broadcast after words had been cut into chunks."""
    monkeypatch.setattr(S, "BROADCAST_KEYS", keys, raising=False)
    words = durable(S.word_counts(docs))
    pairs = S.near_pairs(words, 20)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (pairs, S.forms(words, pairs))]
    for plan in plans:
        assert plan.count("SortMergeJoin") >= 2
        joins = re.findall("BroadcastHashJoin (.*)", plan)
        assert all(re.search("LeftAnti|LeftSemi", j) for j in joins) and bool(joins) == (keys > 0 and plan is plans[0])
    assert result(docs, group_pairs=20) == brute([tuple(r) for r in docs.collect()])
