import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabloom.llm import mixing


def brute_targets(sizes):
    """Fill again and again: share what is left among the sources that aren't stopped."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        stopped = {s for s in free if share * weight[s] >= 3 * sizes[s]}
        for s in stopped or free:
            target[s] = 3.0 * sizes[s] if stopped else share * weight[s]
            left -= target[s]
        free -= stopped or free
    return target


def test_targets_equal_brute_force(spark):
    for case in ({"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 5, None: 7}, {"a": 0, "b": 9}, {"a": 0}, {f"s{i:02}": (i * 37) % 91 for i in range(25)}):
        rows = spark.createDataFrame([(s, n) for s, n in case.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        expected = brute_targets(case)
        assert got.keys() == expected.keys()
        for s in expected:
            assert (got[s] or 0.0) == pytest.approx(expected[s]), (case, s)


def test_mix_of_edge_documents(edge_docs, no_docs):
    rows = mixing.repetition(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += r["size"]
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= int(rate) + 1 and r.copies <= 3
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    again = mixing.mixed(edge_docs)
    assert again.columns == edge_docs.columns
    expected = sum((Counter({r.doc_id: r.copies}) for r in rows), Counter())
    assert Counter(r.doc_id for r in again.collect()) == expected
    assert mixing.mixed(no_docs).collect() == []
    with pytest.raises(ValueError, match="names of results"):
        mixing.mixed(edge_docs.withColumnRenamed("block", "size"))


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "repeat('w ', cast(5 + id % 40 as int)) as text", "concat('s', id % 7) as source", "id")
    rows = mixing.repetition(docs).groupBy("source").agg({"target": "max"}).collect()
    taken = {r.source: r.t for r in mixing.repetition(docs).selectExpr("source", "size * copies as t").groupBy("source").sum("t").withColumnRenamed("sum(t)", "t").collect()}
    for r in rows:
        assert taken[r.source] == pytest.approx(r[1], rel=0.05)


def test_many_sources_take_linear_time(spark):
    """Every row its own source: the targets still sum to the total."""
    sizes = spark.range(200_000).select(F.col("id").cast("string").alias("source"), (F.col("id") % 97).alias("size"))
    row = mixing.targets(sizes).agg(F.sum("target"), F.sum("source_size"), F.count("*")).first()
    assert row[0] == pytest.approx(row[1]) and row[2] == 200_000
