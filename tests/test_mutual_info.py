import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import mutual_info as M
from tabloom.operators import selection


def psi(m):
    """Digamma of whole numbers by its sum."""
    sums = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 10_000))])
    return sums[np.asarray(m, int) - 1] - 0.5772156649015329


def brute(x, y, k=3):
    x, y = x / (x.std() or 1.0), y / (y.std() or 1.0)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1][:, None]
    nx, ny = (((g < r) | ((r == 0) & (g == 0))).sum(axis=1) for g in (dx, dy))
    return max(0.0, float(psi(len(x)) + psi(k) - psi(nx).mean() - psi(ny).mean()))


@pytest.fixture(scope="module")
def rows():
    """2,000 rows: continuous, few values, a hot value, an outlier, constant, a copy of the target."""
    random = np.random.default_rng(1)
    n = 2000
    a, hot = random.normal(size=n), np.where(random.random(n) < 0.6, 1.0, random.random(n))
    few, far = random.integers(0, 4, n).astype(float), random.random(n)
    far[7] = 1e6
    y = a + 0.5 * few + 0.3 * random.normal(size=n)
    return {"a": a, "few": few, "hot": hot, "far": far, "same": np.ones(n), "copy": y.copy(), "y": y}


@pytest.fixture(scope="module")
def df(spark, rows):
    names = list(rows)
    data = [tuple(float(rows[c][i]) for c in names) for i in range(len(rows["y"]))]
    return spark.createDataFrame(data, ", ".join(f"{c} double" for c in names)).repartition(5)


@pytest.mark.parametrize("cell_rows, block_rows", [(4096, 16_384), (40, 30)])
@pytest.mark.parametrize("k", [1, 3])
def test_equals_brute_force(df, rows, cell_rows, block_rows, k):
    names = [c for c in rows if c != "y"]
    found = M.neighbour_mutual_info(df, "y", names, k, jitter=0.0, cell_rows=cell_rows, block_rows=block_rows)
    scores = {r.feature: r.score for r in found.collect()}
    assert scores == pytest.approx({c: brute(rows[c], rows["y"], k) for c in names}, abs=2e-6)


def test_jitter_breaks_ties_and_cells_do_not_matter(df):
    names = ["few", "hot", "same"]
    few, many = (
        {r.feature: r.score for r in M.neighbour_mutual_info(df.coalesce(1), "y", names, cell_rows=c, block_rows=b).collect()} for c, b in ((4096, 16_384), (100, 64))
    )
    assert few == many and few["few"] > 0.05 > few["same"]


def test_missing_values_and_short_columns(spark, rows):
    data = [(float(rows["a"][i]) if i % 3 else None, 1.0 if i < 2 else None, float(rows["y"][i]) if i % 7 else float("nan"), None) for i in range(600)]
    df = spark.createDataFrame(data, "a double, short double, y double, none double")
    found = {r.feature: r.score for r in M.neighbour_mutual_info(df, "y", ["a", "short", "none"], jitter=0.0).collect()}
    kept = [i for i in range(600) if i % 3 and i % 7]
    assert found == pytest.approx({"a": brute(rows["a"][kept], rows["y"][kept]), "short": 0.0, "none": 0.0}, abs=2e-6)
    assert M.neighbour_mutual_info(df.limit(0), "y", ["a"]).collect()[0].score == 0.0


def test_ranks_near_ends():
    values = np.array([0.0, 0.1, 0.1, 0.3, 0.7])
    at, r = np.array([0.1, 0.1, 0.3, 0.0]), np.array([0.0, 0.2, 0.4, 0.1])
    low, high = (M.inside_radius(values, at, r, side) for side in (-1, 1))
    expected = [sum((abs(v - a) < d) or (d == 0 and v == a) for v in values) for a, d in zip(at, r)]
    assert (high - low).tolist() == expected


def test_digamma(spark):
    found = spark.range(1, 200).select("id", M.psi(F.col("id")).alias("p")).collect()
    assert [r.p for r in found] == pytest.approx(psi([r.id for r in found]).tolist(), abs=1e-9)


def test_selection_by_neighbours(df):
    assert selection.statistical_selection(df, "y", "mutual_info", 0.05).selected[0] == "copy"
