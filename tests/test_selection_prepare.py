import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from columns import column
from tabloom.functions import moments
from tabloom.functions.sweep import Sweep
from tabloom.operators import prepare, selection
from tabloom.operators.scaler import Scaler, log_scaling, normalize, robust_scaling, standardize


@pytest.fixture(scope="module")
def regression(spark):
    generator = np.random.default_rng(0)
    rows = []
    for i in range(100):
        age = generator.uniform(20, 60)
        income = 1500 * age + generator.normal(0, 5000)
        target = 0.8 * age + 0.001 * income + generator.normal(0, 5)
        rows.append((i, float(age), float(income), float(generator.normal()), 1.0, float(target)))
    return spark.createDataFrame(rows, "row_id long, age double, income double, noise double, constant double, target double")


@pytest.fixture(scope="module")
def binary(spark):
    generator = np.random.default_rng(1)
    rows = []
    for i in range(200):
        strong = generator.normal()
        rows.append((i, float(strong), float(generator.normal()), int(strong + generator.normal(0, 0.3) > 0)))
    return spark.createDataFrame(rows, "row_id long, strong double, weak double, target int")


def test_variance(regression):
    found = selection.variance_threshold(regression, 0.01, exclude=["target", "row_id"])
    assert found.selected == ["age", "income", "noise"] and found.dropped == ["constant"]
    assert found.scores["constant"] == 0.0


def test_variance_undefined(frame):
    found = selection.variance_threshold(frame("a double, b double", [(1.0, 2.0)]))
    assert found.selected == [] and found.dropped == [] and found.scores == {"a": None, "b": None}


@pytest.mark.parametrize("method", ["correlation", "spearman", "mutual_info"])
def test_scores(regression, method):
    found = selection.statistical_selection(regression, "target", method, 0.05, exclude=["row_id"])
    assert set(found.selected[:2]) == {"age", "income"} and found.scores["constant"] == 0.0
    assert list(found.scores.values()) == sorted(found.scores.values(), reverse=True)
    assert "constant" in found.dropped


def test_spearman_value(frame):
    df = frame("x double, y double", [(1.0, 1.0), (2.0, 4.0), (2.0, 3.0), (9.0, 100.0), (None, 5.0), (7.0, None)])
    # Ranks 1, 2.5, 2.5, 4 against 1, 3, 2, 4.
    expected = np.corrcoef([1, 2.5, 2.5, 4], [1, 3, 2, 4])[0, 1]
    assert selection.spearman_scores(df, "y", ["x"]).first()["score"] == pytest.approx(expected, abs=1e-6)


def test_too_few_rows_score_zero(frame):
    df = frame("x double, z double, y double", [(1.0, None, 1.0), (None, None, 2.0)])
    for method in ("correlation", "spearman", "mutual_info"):
        assert selection.feature_importance(df, "y", method) == {"x": 0.0, "z": 0.0}


def test_binary_target_mutual_information(binary):
    scores = selection.feature_importance(binary, "target", "mutual_info", exclude=["row_id"])
    assert scores["strong"] > 0.3 > scores["weak"]


def _plain_r2(x, y, folds):
    scores = []
    for test in np.array_split(np.arange(len(y)), folds):
        train = np.setdiff1d(np.arange(len(y)), test)
        a = np.column_stack([np.ones(len(train)), x[train]])
        beta = np.linalg.lstsq(a, y[train], rcond=None)[0]
        residual = y[test] - np.column_stack([np.ones(len(test)), x[test]]) @ beta
        scores.append(1 - residual @ residual / ((y[test] - y[test].mean()) ** 2).sum())
    return np.mean(scores)


@pytest.mark.parametrize("limit", [16, 0])
def test_stepwise_equals_direct_fits(regression, monkeypatch, limit):
    monkeypatch.setattr(moments, "EXPRESSION_COLUMNS", limit)
    names = ["age", "income", "noise", "constant"]
    table = np.array([[r[c] for c in [*names, "target"]] for r in regression.orderBy("row_id").collect()])
    model = selection._CrossValidated(regression, "target", names, 3, None, "row_id")
    for chosen in (["age"], ["income", "noise"], ["age", "income", "constant"], names):
        at = [names.index(c) for c in chosen]
        for c in chosen[:-1]:
            model.flip(c)
        assert model.scores()[chosen[-1]] == pytest.approx(_plain_r2(table[:, at], table[:, -1], 3), abs=2e-6)
        for c in chosen[:-1]:
            model.flip(c)


def test_wide_means_equal_narrow_ones(spark, monkeypatch):
    df = spark.sql("""SELECT * FROM VALUES (1, 2.5D, CAST(1.25 AS DECIMAL(9, 2)), CAST(NULL AS DOUBLE)), (2, NULL, NULL, NULL),
        (4, double('NaN'), 2.50, NULL) AS t(a, b, c, d)""")
    narrow = moments.means(df, df.columns)
    monkeypatch.setattr(moments, "EXPRESSION_COLUMNS", 0)
    assert moments.means(df, df.columns) == pytest.approx(narrow) and narrow["b"] == 2.5 and narrow["d"] is None
    assert moments.means(df.limit(0), df.columns) == dict.fromkeys(df.columns)


def _gram(x, y):
    table = np.column_stack([np.ones(len(y)), x, y])
    return table.T @ table


def _held_error(x, y, held, at):
    """Squared error on held rows of a least-squares fit on the others."""
    a, b = (np.column_stack([np.ones(k.sum()), x[k][:, at]]) for k in (~held, held))
    rest = y[held] - b @ np.linalg.lstsq(a, y[~held], rcond=None)[0]
    return rest @ rest


def test_sweeps_equal_direct_fits_through_any_order():
    """Columns go in and out at random, among them a copy, a sum of others and a constant."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * 10.0 ** np.arange(-3, 5)
    x = np.column_stack([x, x[:, 1], x[:, 2] + x[:, 3], np.full(300, 7.0)])
    y = x[:, 2] * 30 + x[:, 6] / 1e4 + rng.normal(size=300)
    held = np.arange(300) % 3 == 0
    sweep = Sweep(_gram(x[~held], y[~held]), _gram(x[held], y[held]))
    inside = set()
    for k in rng.integers(0, x.shape[1], 200):
        inside ^= {int(k)}
        sweep.flip(int(k) + 1)
        found = sweep.errors()
        assert found[-1] == pytest.approx(_held_error(x, y, held, sorted(inside)), rel=1e-6)
        for j in range(x.shape[1]):
            assert found[j + 1] == pytest.approx(_held_error(x, y, held, sorted(inside ^ {j})), rel=1e-6)


def test_sweeps_stay_exact_over_many_flips():
    """Rounding of small pivots doesn't add up, whatever the order of the flips."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(120, 5)) * 10.0 ** np.arange(-2, 3)
        x = np.column_stack([x, x[:, 1], x[:, 2] + x[:, 3], np.full(120, 7.0)])
        y = x[:, 2] * 30 + rng.normal(size=120)
        held = np.arange(120) % 3 == 0
        sweep = Sweep(_gram(x[~held], y[~held]), _gram(x[held], y[held]))
        inside = set()
        for k in rng.integers(0, x.shape[1], 600):
            inside ^= {int(k)}
            sweep.flip(int(k) + 1)
            assert sweep.errors()[-1] == pytest.approx(_held_error(x, y, held, sorted(inside)), rel=1e-8)


def test_selection_of_five_hundred_columns(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 500))
    y = 5 * x[:, 17] + 3 * x[:, 300] + 2 * x[:, 499] + 0.1 * rng.normal(size=1500)
    columns = [f"x{i}" for i in range(500)]
    pd.DataFrame(np.column_stack([x, y]), columns=[*columns, "y"]).assign(id=range(1500)).to_parquet(tmp_path / "wide.parquet")
    df = spark.read.parquet(str(tmp_path / "wide.parquet"))
    began = time.monotonic()
    assert selection.forward_selection(df, "y", 3, key="id").selected == ["x17", "x300", "x499"]
    assert selection.backward_elimination(df, "y", 3, key="id").selected == ["x17", "x300", "x499"]
    assert sorted(selection.recursive_elimination(df, "y", 3, exclude=["id"]).selected) == ["x17", "x300", "x499"]
    assert time.monotonic() - began < 60


def test_forward_and_backward(regression):
    forward = selection.forward_selection(regression, "target", 2, order_by="row_id")
    assert forward.selected[0] in ("age", "income") and len(forward.selected) <= 2
    assert [h["r2"] for h in forward.history] == sorted(h["r2"] for h in forward.history)
    assert forward.final_r2 == forward.history[-1]["r2"]
    backward = selection.backward_elimination(regression, "target", 2, key="row_id")
    assert len(backward.selected) == 2 and len(backward.history) == 2
    assert set(backward.selected) & {"age", "income"}


def test_recursive_elimination(regression, binary):
    found = selection.recursive_elimination(regression, "target", 2, exclude=["row_id"])
    assert sorted(found.scores.values()) == [1, 1, 2, 3] and len(found.selected) == 2
    forest = RandomForestClassifier(numTrees=5, maxDepth=3, seed=1)
    trees = selection.recursive_elimination(binary, "target", 1, forest, exclude=["row_id"])
    assert trees.selected == ["strong"] and trees.scores == {"strong": 1, "weak": 2}


def test_information_value(binary, frame):
    found = selection.information_value(binary, "target", exclude=["row_id"])
    assert list(found)[0] == "strong" and found["strong"]["strength"] in ("strong", "suspicious")
    assert found["strong"]["iv"] > found["weak"]["iv"]
    with pytest.raises(ValueError, match="both classes"):
        selection.information_value(frame("x double, t int", [(1.0, 1), (2.0, 1)]), "t")
    constant = frame("k double, t int", [(1.0, 1), (1.0, 0)])
    assert selection.information_value(constant, "t")["k"] == {"iv": 0.0, "strength": "useless", "woe": {}}


def test_dispatch(regression, binary):
    for method in ("correlation", "spearman", "mutual_info", "variance_threshold", "forward", "backward", "rfe"):
        found = selection.select_features(regression, "target", method, 2, exclude=["row_id"], order_by="row_id")
        assert found.selected
    assert selection.select_features(binary, "target", "iv", 1, exclude=["row_id"]).selected == ["strong"]
    with pytest.raises(ValueError):
        selection.select_features(binary, "target", "magic")
    with pytest.raises(KeyError):
        selection.select_features(binary, "absent")


# Splits


def test_random_split_is_reproducible(binary):
    train, test = prepare.random_split(binary, "row_id", 0.3)
    ids = column(test, "row_id")
    assert ids == column(prepare.random_split(binary.repartition(7), "row_id", 0.3)[1], "row_id")
    assert not set(ids) & set(column(train, "row_id")) and train.count() + len(ids) == 200
    assert ids != column(prepare.random_split(binary, "row_id", 0.3, seed=1)[1], "row_id")


@pytest.mark.parametrize("listed", [10_000, 0])
def test_stratified_counts_are_exact(spark, monkeypatch, listed):
    monkeypatch.setattr(prepare, "LISTED_HASHES", listed)
    rows = [(i, "hot" if i % 10 < 8 else "rare" if i % 10 == 8 else None) for i in range(1000)] + [(5000, "one")]
    df = spark.createDataFrame(rows, "i int, c string")
    train, test = prepare.split(df, "i", 0.25, 3, stratify="c")
    counts = {r["c"]: r["count"] for r in test.groupBy("c").count().collect()}
    assert counts == {"hot": 200, "rare": 25, None: 25}
    assert train.count() == 751 and train.columns == ["i", "c"]


def test_folds(spark, regression):
    blocks = prepare.assign_folds(regression, 3, order_by="row_id")
    assert column(blocks, "fold") == [0] * 34 + [1] * 33 + [2] * 33
    small = prepare.assign_folds(regression.where("row_id < 2"), 5, order_by="row_id")
    assert column(small, "fold") == [0, 1]
    hashed = prepare.assign_folds(regression, 4, key="row_id")
    assert {r["fold"] for r in hashed.select("fold").distinct().collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        prepare.assign_folds(regression, 3)


def test_imputation_uses_train_only(frame):
    train = frame("row_id long, v double", [(0, 1.0), (1, 3.0), (2, None)])
    test = frame("row_id long, v double", [(0, 100.0), (1, None)])
    a, b = prepare.mean_impute(train, test, ["v"])
    assert column(a, "v") == [1.0, 3.0, 2.0] and column(b, "v") == [100.0, 2.0]
    _, leaky = prepare.mean_impute(train, test, ["v"], full_data=True)
    assert column(leaky, "v")[1] == pytest.approx(104 / 3)


def test_feature_matrix(regression):
    names = prepare.feature_columns(regression, "target", exclude=["row_id"])
    assert names == ["age", "income", "noise", "constant"]
    assert prepare.feature_matrix(regression, names).first()["features"].size == 4


# Scaler


@pytest.fixture(scope="module")
def train_test(frame):
    train = frame("row_id long, x double, y double", [(i, i + 1.0, 10.0 * (i + 1)) for i in range(5)])
    return train, frame("row_id long, x double, y double", [(0, 10.0, 100.0), (1, 20.0, 200.0)])


def test_scaler_fits_on_train_only(train_test):
    train, test = train_test
    scaler = Scaler("standard").fit(train, ["x", "y"])
    assert scaler.params["x"] == {"mean": 3.0, "std": pytest.approx(2.5**0.5)}
    assert column(scaler.transform(test), "x")[0] == pytest.approx(7 / 2.5**0.5)
    scaled, fitted = standardize(test, ["x"], train)
    assert fitted.params["x"]["mean"] == 3.0 and column(scaled, "x")[0] == pytest.approx(7 / 2.5**0.5)


@pytest.mark.parametrize("method", ["standard", "minmax", "robust", "log"])
def test_scaler_round_trip(train_test, method):
    train, test = train_test
    scaler = Scaler.from_dict(Scaler(method).fit(train, ["x", "y"]).to_dict())
    back = scaler.inverse_transform(scaler.transform(test))
    assert column(back, "x") == pytest.approx([10, 20]) and column(back, "y") == pytest.approx([100, 200])


def test_scaler_other_forms(train_test):
    train, test = train_test
    assert column(normalize(test, ["x"], train)[0], "x") == [2.25, 4.75]
    assert column(robust_scaling(test, ["x"], train)[0], "x") == [3.5, 8.5]
    assert column(log_scaling(test, ["x"])[0], "x")[0] == pytest.approx(np.log(11))
    rows = Scaler("minmax").fit(train, ["x"]).parameter_table(train).collect()
    assert [tuple(r) for r in rows] == [("x", "min", 1.0), ("x", "max", 5.0)]


def test_scaler_constant_column(frame):
    df = frame("row_id long, k double", [(0, 4.0), (1, 4.0)])
    for method in ("standard", "minmax", "robust"):
        assert column(Scaler(method).fit_transform(df, "k"), "k") == [0.0, 0.0]


def test_scaler_errors(train_test, frame):
    train, _ = train_test
    with pytest.raises(ValueError):
        Scaler("other")
    with pytest.raises(RuntimeError):
        Scaler().transform(train)
    with pytest.raises(KeyError):
        Scaler().fit(train, ["absent"])
    with pytest.raises(KeyError):
        Scaler().fit(train, ["x"]).transform(train, ["y"])
    with pytest.raises(TypeError):
        Scaler().fit(frame("c string", [("a",)]), ["c"])


def test_narrow_plan(train_test):
    train, test = train_test
    plan = Scaler().fit(train, ["x"]).transform(test.select(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
