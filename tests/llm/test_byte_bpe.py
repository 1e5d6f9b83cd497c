import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tabloom.llm import blocks as B, byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.load(PATH, public_tokenizers.PATTERN)


def test_digests_equal_the_library(edge_docs, encoding):
    got = byte_bpe.encode(edge_docs.drop("block"), PATH, public_tokenizers.PATTERN, digests=True).collect()
    texts = {(r.doc_id, r.source): r.text or "" for r in edge_docs.where("doc_id is not null").collect()}
    assert len(got) == edge_docs.count()
    for row in (r for r in got if r.doc_id is not None):
        text = texts[row.doc_id, row.source]
        ids = encoding.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_ids_and_round_trip(edge_docs, no_docs, encoding):
    rows = byte_bpe.encode(edge_docs.select("doc_id", "text", "block"), PATH, public_tokenizers.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect() if r.doc_id is not None}
    for row in (r for r in rows if r.doc_id is not None):
        assert row.ids == encoding.encode_ordinary(texts[row.doc_id])
        assert bytes(row.decoded).decode() == texts[row.doc_id]
        assert row.block == "x"
    assert byte_bpe.encode(no_docs, PATH, public_tokenizers.PATTERN).collect() == []
    with pytest.raises(ValueError, match="names of results"):
        byte_bpe.encode(edge_docs.withColumnRenamed("block", "ids"), PATH, public_tokenizers.PATTERN)


def test_special_tokens_are_text(spark, encoding):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).first().ids == encoding.encode_ordinary("a <|endoftext|> b")


def test_random_unicode(vocabulary, encoding):
    rng = random.Random(3)
    ranges = [(0, 128), (128, 0x250), (0x370, 0x600), (0x900, 0xE00), (0x2000, 0x2070), (0x3040, 0xA000), (0x1F300, 0x1F700)]
    encoder = byte_bpe.Encoder(vocabulary)
    for _ in range(300):
        text = "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randint(0, 60)))
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = encoder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == encoding.encode_ordinary(text), text


def test_hash_is_minimal_and_perfect(vocabulary):
    keys = B.mixed(np.arange(5000, dtype=np.uint64))
    assert sorted(byte_bpe.PerfectHash(keys)(keys).tolist()) == list(range(5000))
    # Every token is found by the first tier, and the second tier gives the same single id.
    tokens = random.Random(1).sample(sorted(vocabulary.ranks), 500)
    data = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    starts = np.concatenate([[0], ends[:-1]])
    assert vocabulary.lookup(data, starts, ends, B.SpanHash(data)(starts, ends)).tolist() == [vocabulary.ranks[t] for t in tokens]


def test_merges_of_a_block_are_taken_together(vocabulary, encoding, monkeypatch):
    """Missed pre-tokens of all lengths: short ones are never merged one by one, and all get the library's ids."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß中") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["q" * n for n in range(1, 130)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + [""]
    alone = []
    merge = vocabulary.merge
    monkeypatch.setattr(vocabulary, "merge", lambda token: alone.append(token) or merge(token))
    monkeypatch.setattr(byte_bpe, "MATRIX_CELLS", 1000)
    raw = [t.encode() for t in texts]
    ids, first = byte_bpe.Encoder(vocabulary).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for text, a, b in zip(texts, first, first[1:]):
        assert ids[a:b].tolist() == encoding.encode_ordinary(text)
    assert alone and min(map(len, alone)) > 64


def test_vocabulary_without_all_bytes():
    """Parts that are no tokens can't be looked up by ids; such spans are merged one by one."""
    small = byte_bpe.Vocabulary({b"ab": 0, b"c": 1, b"abc": 2, b"d": 3}, r"\S+|\s+")
    data = np.frombuffer(b"abcdabd", np.uint8)
    assert byte_bpe.Encoder(small).encode(data, np.array([0, 7]))[0].tolist() == [2, 3, 0, 3]
