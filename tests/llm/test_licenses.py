import re

import pytest
from texts import passage

from tabloom.llm import licenses


def shingle_list(text):
    w = [x for x in re.split("[^a-z0-9]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(texts):
    """(id, license) where some window, one step wider on either side, holds 0.8 of the template."""
    out = {}
    for name, template in licenses.TEMPLATES.items():
        whole = set(shingle_list(template))
        n = len(whole)
        step = max(1, n // 8)
        for doc, text in texts.items():
            s = shingle_list(text)
            best = max((len(whole & set(s[max(0, a - step) : max(0, a - step) + n + 2 * step])) / n for a in range(0, len(s), step)), default=0)
            if best >= 0.8:
                out[doc, name] = best
    return out


def corpus():
    texts, i = {}, 0
    for name, template in sorted(licenses.TEMPLATES.items()):
        words = template.split()
        texts[i] = template
        texts[i + 1] = passage(i, 60) + "\n" + template.upper() + "\n" + passage(i + 1, 40)
        texts[i + 2] = passage(i, 30) + " " + " ".join(words[: max(3, len(words) // 2)])
        texts[i + 3] = passage(i, 17) + " " + " ".join(words[: len(words) - len(words) // 10]) + " " + passage(i, 9)
        i += 4
    texts |= {500: passage(9, 6000) + licenses.TEMPLATES["MIT"] + passage(8, 5000), 501: "license license license copyright public domain", 502: ""}
    texts |= {503: "\n".join([licenses.TEMPLATES["MIT-notice"], licenses.TEMPLATES["BSD"], licenses.TEMPLATES["MIT-notice"]])}
    return texts


def test_finds_equal_brute_force(spark):
    texts = corpus()
    found = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    expected = brute(texts)
    assert {(r.doc_id, r.license) for r in found} == set(expected)
    assert all(r.containment <= expected[r.doc_id, r.license] + 1e-9 and r.containment >= 0.8 for r in found)


def test_edge_documents(edge_docs, no_docs, spark):
    assert licenses.scan(edge_docs).collect() == []
    assert licenses.scan(no_docs).collect() == []
    twice = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.license) for r in licenses.scan(twice).collect()) == [(0, "MIT-notice"), (1, "MIT-notice")]
    with pytest.raises(ValueError, match="fewer than 5"):
        licenses.scan(no_docs, {"short": "a b"})


def test_plan_has_no_python(edge_docs, capsys):
    licenses.scan(edge_docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
