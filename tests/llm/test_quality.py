import re
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import blocks as B, quality


def brute(text):
    text = text or ""
    words = [(m.group(), len(m.group())) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup, dup_chars = dup + (line in seen), dup_chars + (len(line) if line in seen else 0)
            seen.add(line)

    def covered(n, copies_only=True):
        grams = [tuple(w for w, _ in words[i : i + n]) for i in range(len(words) - n + 1)]
        counts = Counter(grams)
        first_at = {g: i for i, g in reversed(list(enumerate(grams)))}
        marked = {i for i, g in enumerate(grams) if (first_at[g] < i if copies_only else counts[g] > 1)}
        return {i + k for i in marked for k in range(n)}

    out = {
        "n_words": len(words),
        "word_chars": sum(n for _, n in words),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "dup_line_chars": dup_chars,
        "n_repeat_words": len(covered(3, copies_only=False)),
    }
    return out | {f"chars_in_repeated_{n}": sum(words[i][1] for i in covered(n)) for n in quality.NGRAM_LIMITS}


def test_measures_equal_brute_force(edge_docs):
    measured = quality.verdicts(quality.repetition(edge_docs)).collect()
    assert len(measured) == edge_docs.count()
    for row in measured:
        expected = brute(row.text)
        assert {k: row[k] for k in expected} == expected
        failed = expected["n_words"] < 50 or 100 * expected["n_repeat_words"] > 50 * expected["n_words"]
        shares = all(expected[f"chars_in_repeated_{n}"] <= limit * expected["word_chars"] for n, limit in quality.NGRAM_LIMITS.items())
        lines = expected["dup_line_chars"] <= quality.LINE_LIMIT * (expected["word_chars"] + expected["n_words"])
        assert row.base_failed == failed
        assert row.kept == (not failed and shares and lines)


def test_blocks_do_not_change_measures(edge_docs):
    texts = [r.text or "" for r in edge_docs.collect()]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    together = quality.measure(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, text in enumerate(texts):
        assert {k: int(v[i]) for k, v in together.items()} == brute(text)


def test_filter_keeps_columns_and_clean_text(edge_docs, no_docs):
    kept = quality.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {6, 7, 8, 9} <= {r.doc_id for r in kept.collect()}
    assert not {0, 1, 2, 11} & {r.doc_id for r in kept.collect()}
    assert quality.keep_good(no_docs).collect() == []
    with pytest.raises(ValueError, match="names of measures"):
        quality.repetition(edge_docs.withColumnRenamed("block", "n_words"))


def test_hashes_of_spans():
    data = np.frombuffer(b"abcabcab", np.uint8)
    h = B.SpanHash(data)
    a = h(np.array([0, 3, 0, 1]), np.array([3, 6, 2, 3]))
    assert a[0] == a[1] and len(set(a.tolist())) == 3
