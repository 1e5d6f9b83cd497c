from collections import defaultdict

import numpy as np
import pytest

from tabloom.llm import cap_filters


def brute(rows, least=0.93):
    ok = {}
    for key, vector, label in rows:
        if key is not None and label is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            ok[key] = (label, np.array(vector, np.float32).astype(float))
    near = defaultdict(set)
    for a in ok:
        for b in ok:
            if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]):
                x, y = ok[a][1], ok[b][1]
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    near[a].add(b)
                    near[b].add(a)
    component = {}
    for key in sorted(k for k, _, _ in rows if k is not None):
        todo = [key]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = key
                todo += near[x]
    return {k: (len(near[k]), c, k == c) for k, c in component.items()}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cap_filters.near_duplicates(df).collect()}


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(25):
        center = rng.standard_normal(48)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (center + 0.2 * rng.standard_normal(48)).astype(np.float32).tolist(), int(c % 3)))
    center = rng.standard_normal(48)
    for i in range(80):  # one large group
        rows.append((len(rows), (center + 0.1 * rng.standard_normal(48)).astype(np.float32).tolist(), 1))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(4)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


@pytest.mark.parametrize(
    ("kind", "labels"),
    [("double", [1.2, 1.9, 0.0, -0.0, None]), ("string", ["1", "01", "a", "a ", None]), ("boolean", [True, False, None, True, False])],
)
def test_labels_are_compared_as_they_are(spark, kind, labels):
    rng = np.random.default_rng(9)
    center = rng.standard_normal(24)
    rows = [(i, (center + 0.05 * rng.standard_normal(24)).astype(np.float32).tolist(), labels[i % 5]) for i in range(40)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")
    assert got(df) == brute(rows)


def test_blocks_of_large_groups_meet(spark, monkeypatch):
    rng = np.random.default_rng(5)
    center = rng.standard_normal(16)
    rows = [(i, (center + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist(), 4) for i in range(120)]
    monkeypatch.setattr(cap_filters, "FILTER_BLOCK", 16)
    monkeypatch.setattr(cap_filters, "COMPONENT_BLOCK", 16)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None),
        (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [-1.0, 0.0], 1), (11, [1.0], 1), (12, [3.0], 1), (13, [1.0, 0.0, 0.0], 1), (14, [1.0, 0.0], 2),
        (15, [3e38, 1e30], 3), (16, [1e-38, 0.0], 3),
    ]
    df = spark.createDataFrame(rows + [(None, [1.0, 0.0], 1)], SCHEMA)
    found = got(df)
    assert found.pop(None) == (0, None, True)
    assert found == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == {}


def test_recall_at_the_least_cosine():
    """Pairs at exactly 0.93 nearly always pass a filter together, whatever the size of the table."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((400, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * side
    for rows in (1_000, 100_000, 10_000_000):
        code = cap_filters.ProductCode(64, rows)
        passed = []
        for part in (a, b):
            row, filters = code.decode(part)
            passed.append(set(zip(row.tolist(), filters.tolist())))
            # List-decoding finds all filters that a row exceeds.
            i, j = filters // len(code.second), filters % len(code.second)
            inner = (part[row][:, : code.half] * code.first[i]).sum(axis=1) + (part[row][:, code.half :] * code.second[j]).sum(axis=1)
            assert (inner >= code.least - 1e-9).mean() > 0.99
            whole = (part[0, : code.half] @ code.first.T)[:, None] + (part[0, code.half :] @ code.second.T)[None, :]
            assert (whole >= code.least).sum() in {(row == 0).sum(), 0}
        assert len({r for r, _ in passed[0] & passed[1]}) / 400 > 0.97, rows


def uneven(kind, rng, n=300, dims=64):
    """Pairs of unit vectors at cosine 0.935 whose energy lies unevenly over the components."""
    scale = np.ones(dims)
    if kind == "padded":
        scale[dims // 2 :] = 0
    elif kind == "pca":
        scale = 1 / np.arange(1.0, dims + 1)
    keep = np.argsort(rng.random((n, dims)), axis=1) < 6 if kind == "sparse" else np.ones((n, dims), bool)
    a, side = (rng.standard_normal((n, dims)) * scale * keep for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return a, 0.935 * a + (1 - 0.935**2) ** 0.5 * side


@pytest.mark.parametrize("kind", ["isotropic", "padded", "pca", "sparse"])
def test_recall_of_uneven_vectors(kind):
    """Padded, sparse and variance-ordered vectors meet as often as isotropic ones."""
    parts = uneven(kind, np.random.default_rng(21))
    for rows in (2_000, 1_000_000):
        code = cap_filters.ProductCode(64, rows)
        passed = [set(zip(*(x.tolist() for x in code.decode(code.turned(part))))) for part in parts]
        assert len({r for r, _ in passed[0] & passed[1]}) / 300 > 0.95, rows


@pytest.mark.parametrize("kind", ["padded", "pca"])
def test_links_of_uneven_vectors(spark, kind):
    """Lone pairs, so that no other member of a component makes up for a pair that is missed."""
    rows = [(2 * i + j, part[i].astype(np.float32).tolist(), 1) for j, part in enumerate(uneven(kind, np.random.default_rng(22))) for i in range(300)]
    linked = sum(n for n, _, _ in got(spark.createDataFrame(rows, SCHEMA)).values())
    assert linked >= 0.97 * sum(n for n, _, _ in brute(rows).values())
