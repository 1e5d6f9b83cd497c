import zlib
from collections import Counter

from tabloom.llm import sharding


def check(docs, n_shards):
    rows = sharding.shards(docs, n_shards).collect()
    texts = docs.collect()
    assert len(rows) == len(texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in texts
    )
    counts = Counter(r.shard for r in rows)
    assert all(0 <= s < n_shards for s in counts)
    assert max(counts.values(), default=0) - min((counts[s] for s in range(n_shards)), default=0) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    return rows


def test_every_shard_matches_the_mixture(spark):
    docs = spark.range(7001).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 17)) as source")
    rows = check(docs.repartition(5), 40)
    total = Counter(r.source for r in rows)
    for s in range(40):
        own = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(own[x] - total[x] / 40) <= 2 for x in total)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shards(docs.repartition(2), 40).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    # Ids aren't laid out in order.
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))][:20] != sorted(r.doc_id for r in rows)[:20]


def test_buckets_do_not_change_the_law(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    docs = spark.range(500).selectExpr("id as doc_id", "cast(id as string) as text", "if(id % 2 = 0, 'a', null) as source")
    rows = check(docs, 7)
    assert all(abs(sum(r.source == "a" for r in rows if r.shard == s) - 500 / 14) <= 1 for s in range(7))


def test_edge_documents(edge_docs, no_docs):
    check(edge_docs, 4)
    check(edge_docs, 1000)
    assert check(no_docs, 3) == []
