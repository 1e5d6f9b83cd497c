import base64
import hashlib
import importlib.util
import os
import random
from collections import Counter, defaultdict

import public_tokenizers
import test_mixing
import test_ngram_join
import test_quality
import test_suffix_dedup
import tiktoken
from texts import edge_texts, passage

from tabloom.llm import mixing, quality

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SPEC = importlib.util.spec_from_file_location("corpus_pipeline", os.path.join(ROOT, "corpus_pipeline.py"))
corpus_pipeline = importlib.util.module_from_spec(SPEC)
SPEC.loader.exec_module(corpus_pipeline)


def corpus():
    rng = random.Random(12)
    shared = [passage(900 + i, 40) for i in range(3)]
    texts = [passage(i, rng.randint(60, 140)) + "\n" + rng.choice(["", *shared]) for i in range(60)]
    texts += [t + " tail" for t in texts[:10]] + texts[5:9] + ["Be " * 90, "ab cd", "größe " + passage(77, 80) + " ü" * 3]
    texts += edge_texts()
    return {i: (t, ["a", "b", None, "c", "a"][i % 5]) for i, t in enumerate(texts)}


def good(text):
    m = test_quality.brute(text)
    return (
        m["n_words"] >= 50
        and 100 * m["n_repeat_words"] <= 50 * m["n_words"]
        and m["dup_line_chars"] <= quality.LINE_LIMIT * (m["word_chars"] + m["n_words"])
        and all(m[f"chars_in_repeated_{n}"] <= limit * m["word_chars"] for n, limit in quality.NGRAM_LIMITS.items())
    )


def without(text, covered):
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out += [] if covered[at : at + n].all() else [c]
        at += n
    return "".join(out)


def copies(docs):
    """Of each document: the whole part of its source's rate, and one more by a seeded hash of the id."""
    sizes = {k: test_quality.brute(t)["n_words"] for k, (t, _) in docs.items()}
    per = defaultdict(int)
    for k, (_, s) in docs.items():
        per[s] += sizes[k]
    target = test_mixing.brute_targets(per)
    out = {}
    for k, (_, s) in docs.items():
        rate = min(3.0, target[s] / per[s]) if per[s] else 0.0
        coin = int(hashlib.md5(f"{k}-{mixing.SEED}".encode()).hexdigest()[:13], 16) / 2**52
        out[k] = int(rate) + (coin < rate - int(rate))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = corpus()
    rows = [(k, t, "en", s, None if t is None else len(t), 5) for k, (t, s) in docs.items()]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cluster int")
    table.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    docs = {k: v for k, v in docs.items() if good(v[0])}
    classes = test_ngram_join.brute({k: t for k, (t, _) in docs.items()})
    docs = {k: v for k, v in docs.items() if classes[k][1] == k}
    covered = test_suffix_dedup.brute({k: t for k, (t, _) in docs.items()})
    docs = {k: (without(t, covered[k]), s) for k, (t, s) in docs.items()}
    times = copies(docs)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in found) == Counter({k: n for k, n in times.items() if n})
    assert len(found) > 60
    for r in found:
        text, source = docs[r.doc_id]
        assert (r.text, r.source, r.n_chars, r.cluster) == (text, source, len(text), 5)
        assert r.ids == encoding.encode_ordinary(text) and r.n_tokens == len(r.ids)


def test_stages_keep_the_columns(edge_docs, no_docs, spark):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert name == "byte_bpe" or out.columns == docs.columns
            assert out.count() <= 3 * docs.count()
