import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from texts import passage

from tabloom.llm import suffix_dedup


def brute(texts):
    """Covered bytes of each document of {id: text}, by a table of all strings of 100 bytes."""
    seen, out = set(), {}
    for doc in sorted(texts):
        raw = (texts[doc] or "").encode()
        covered = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            covered[i : i + 100] |= raw[i : i + 100] in seen
            seen.add(raw[i : i + 100])
        out[doc] = covered
    return out


def expected(texts):
    rows = {}
    for doc, covered in brute(texts).items():
        raw = np.frombuffer((texts[doc] or "").encode(), np.uint8)
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        rows[doc] = (len(raw), int(covered.sum()), spans, hashlib.sha256(raw[~covered].tobytes()).hexdigest())
    return rows


def got(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs.select("doc_id", "text")).collect()}


def corpus():
    """Passages that texts share at many offsets, overlaps, runs of one letter, periodic and multibyte text."""
    rng = random.Random(8)
    shared = [passage(100 + i, rng.randint(14, 60)) for i in range(8)]
    texts = {}
    for i in range(150):
        parts = [passage(1000 + i, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            cut = rng.randint(0, 40)
            parts += [piece[cut : len(piece) - rng.randint(0, 40)], passage(rng.randint(0, 10**6), rng.randint(0, 20))]
        texts[i * 3] = rng.choice([" ", "", "\n"]).join(parts)
    texts |= {1000: "a" * 400, 1001: "a" * 350 + "b", 1002: "abc" * 100, 1003: "élan größe 日本 " * 20, 1004: "", 1005: None, 1006: "x" * 99}
    texts |= {2000 + i: texts[0] for i in range(5)}
    return texts


def test_digests_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert got(docs) == expected(texts)


def test_hot_keys_are_cut_into_windows(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 2)
    assert got(docs) == expected(texts)


def around_one_passage(n):
    """A passage in different text: the pieces at its edges differ in every document, their windows do not."""
    shared = passage(7, 40)
    return {i: f"{passage(5000 + i, 6)} {shared} {passage(9000 + i, 6)}" for i in range(n)}


def test_a_passage_shared_by_many_documents(spark, monkeypatch):
    texts = around_one_passage(300)
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 8)
    assert got(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)) == expected(texts)


def test_groups_of_equal_windows_are_bounded():
    texts, found = around_one_passage(2000), []
    parts = 2000 // 16 + 1
    for doc, text in texts.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        start, n, lead, key, _ = suffix_dedup.pieces(raw, np.array([0, len(raw)]))
        wanted = [{"key": int(k), "at": int(a), "parts": parts} for k, a in zip(key.view(np.int64), suffix_dedup._packed(start, lead, n))]
        found.append(pa.record_batch({"doc": [doc], "wanted": [wanted], "text": [text]}))
    groups = Counter((r["key"], r["part"]) for batch in suffix_dedup._texts(iter(found)) for r in batch.select(["key", "part"]).to_pylist())
    assert max(groups.values()) < 3 * 16 < 2000


def test_edge_documents(edge_docs, no_docs, spark):
    texts = {r.doc_id: r.text for r in edge_docs.collect() if r.doc_id is not None}
    rows = got(edge_docs)
    assert {k: v for k, v in rows.items() if k is not None} == expected(texts)
    assert suffix_dedup.digests(edge_docs).count() == edge_docs.count()
    assert suffix_dedup.digests(no_docs).collect() == []
    with pytest.raises(ValueError, match="names of results"):
        suffix_dedup.digests(edge_docs.withColumnRenamed("block", "n_bytes"))


def test_cut_texts_are_whole_characters(spark, edge_docs):
    texts = corpus() | {3000: "ü" * 300, 3001: "xü" + "ü" * 299}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, spare int")
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    covered = brute(texts)
    for row in cut.collect():
        if texts[row.doc_id] is None:
            assert row.text is None
            continue
        at, kept = 0, []
        for c in texts[row.doc_id]:
            n = len(c.encode())
            if not covered[row.doc_id][at : at + n].all():
                kept.append(c)
            at += n
        assert row.text == "".join(kept)
    before = Counter((r.doc_id is None, r.source) for r in edge_docs.collect())
    assert Counter((r.doc_id is None, r.source) for r in suffix_dedup.without_repeats(edge_docs).collect()) == before


def test_rounds_sort_the_suffixes_of_each_column():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab", k=suffix_dedup.COLUMNS)).encode() for _ in range(40)]
    texts[7] = texts[3]
    lead = np.full(40, suffix_dedup.PLACES - 1)
    for column, order, prefix in suffix_dedup.Rounds(texts, lead):
        suffixes = [texts[i][column:] for i in order]
        assert suffixes == sorted(suffixes)
        for a, b, n in zip(suffixes, suffixes[1:], prefix[1:]):
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or a == b and n == len(a)
