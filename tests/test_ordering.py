"""The block algorithms against plain windows, with one key that holds most rows."""

import math
import random

import pytest
from pyspark.sql import Window, functions as F

from tabloom.functions import ordering
from tabloom.functions.ordering import fill_from_neighbours, number_rows, over_neighbours, running_totals
from tabloom.functions.quantiles import exact_quantiles, group_quantiles
from tabloom.functions import quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    generator = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if generator.random() < 0.5 else generator.choice(["a", "b", None, *map(str, range(40))])
        value = None if generator.random() < 0.3 or 900 < i < 1500 else round(generator.gauss(0, 10), 1)
        rows.append((i, key, value, generator.choice([0.0, 0.0, 1.0, generator.random()])))
    generator.shuffle(rows)
    return spark.createDataFrame(rows, "i int, k string, v double, w double").repartition(5)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordering, "SMALLEST_BLOCK", 37)


def test_positions(skewed):
    numbered = number_rows(skewed, ["k", "i"])
    rows = numbered.rows.orderBy("_position").collect()
    assert numbered.total == 3000 and [r["_position"] for r in rows] == list(range(3000))
    order = [(r["k"] or "", r["i"]) for r in rows]
    assert order == sorted(order)


def test_empty_table(skewed):
    empty = skewed.where("i < 0")
    assert number_rows(empty, ["i"]).total == 0
    assert fill_from_neighbours(empty, ["v"], "i").count() == 0
    assert exact_quantiles(empty, "v", [0.5]) == {"v": [None]}


@pytest.mark.parametrize("key", [None, "k"])
def test_neighbours(skewed, key):
    build = lambda w: {"l": F.lag("v", 5).over(w), "a": F.lead("v", 3).over(w), "s": F.sum("v").over(w.rowsBetween(-60, 0))}
    found = over_neighbours(skewed, build, "i", key, before=60, after=3, group_rows=0)
    window = Window.partitionBy(*([key] if key else [])).orderBy("i")
    expected = skewed.withColumns(build(window))
    digits = lambda d: d.withColumn("s", F.round("s", 6))
    assert found.count() == 3000 and digits(found).exceptAll(digits(expected)).count() == 0


@pytest.mark.parametrize("key", [None, "k"])
@pytest.mark.parametrize("forward", [True, False])
def test_fills(skewed, key, forward):
    found = fill_from_neighbours(skewed, ["v"], "i", key, forward, group_rows=0)
    window = Window.partitionBy(*([key] if key else [])).orderBy("i")
    window = window.rowsBetween(Window.unboundedPreceding, 0) if forward else window.rowsBetween(0, Window.unboundedFollowing)
    expected = skewed.withColumn("v", (F.last if forward else F.first)("v", True).over(window))
    assert found.count() == 3000 and found.exceptAll(expected).count() == 0


def test_blocks_have_no_single_partition_sort(skewed):
    plan = over_neighbours(skewed, lambda w: {"l": F.lag("v").over(w)}, "i", before=1)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("key", [None, "k"])
def test_running_totals(skewed, key):
    found = running_totals(skewed, "i", {"t": "w"}, key)
    window = Window.partitionBy(*([key] if key else [])).orderBy("i")
    expected = skewed.select("i", F.sum("w").over(window).alias("e"))
    assert found.join(expected, "i").where("abs(t - e) < 1e-6").count() == 3000


PROBABILITIES = [0.0, 0.013, 0.25, 0.5, 0.51, 0.9, 0.99, 1.0]


def test_quantile_search(skewed, monkeypatch):
    monkeypatch.setattr(quantiles, "LISTED_VALUES", 5)
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    wanted = F.array(*map(F.lit, PROBABILITIES))
    direct = skewed.agg(*[F.percentile(c, wanted).alias(c) for c in ("v", "w")]).first()
    searched = exact_quantiles(skewed, ["v", "w"], PROBABILITIES)
    for name in ("v", "w"):
        assert searched[name] == pytest.approx(direct[name], abs=1e-12)


def test_quantiles_with_infinities(frame, monkeypatch):
    """The same answers whether values are listed at once or searched."""
    inf = math.inf
    values = [-inf, -inf, *map(float, range(40)), inf, None, math.nan]
    df = frame("v double, w double", [(v, inf) for v in values])
    for listed in (10_000, 3):
        monkeypatch.setattr(quantiles, "LISTED_VALUES", listed)
        monkeypatch.setattr(quantiles, "ACCURACY", 20)
        found = exact_quantiles(df, ["v", "w"], [0.0, 0.5, 0.75, 1.0])
        assert found["v"] == [-inf, 19.0, 29.5, inf] and found["w"] == [inf] * 4


def test_group_quantiles(skewed):
    direct = group_quantiles(skewed, "k", "v", [0.25, 0.5])
    searched = group_quantiles(skewed, "k", "v", [0.25, 0.5], group_rows=0)
    values = lambda d: {r["k"]: (r["q0"], r["q1"]) for r in d.collect()}
    a, b = values(direct), values(searched)
    assert a.keys() == b.keys()
    for k, pair in a.items():
        assert b[k] == pytest.approx(pair, abs=1e-12)


@pytest.mark.parametrize("key", [None, "k"])
@pytest.mark.parametrize("group_rows", [0, 10**6])
def test_backward_fill_walks_each_group_once(skewed, key, group_rows, capsys):
    """A frame that ends with the group costs the square of its rows."""
    filled = fill_from_neighbours(skewed, ["v"], "i", key, forward=False, group_rows=group_rows)
    filled.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()
    whole = Window.partitionBy(*([key] if key else [])).orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    expected = skewed.withColumn("v", F.first("v", ignorenulls=True).over(whole))
    assert sorted(map(str, filled.collect())) == sorted(map(str, expected.collect()))
