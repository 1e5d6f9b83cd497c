import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import tails
from tabloom.operators import analysis, compare, metrics


@pytest.fixture(scope="module")
def pairs(frame):
    return frame("row_id long, t int, p int", [(i, t, p) for i, (t, p) in enumerate(zip((0, 0, 0, 1, 1, 1), (0, 1, 1, 1, 1, 1)))])


def test_binary_metrics(pairs):
    found = metrics.evaluate_classification(pairs, "t", "p")
    assert found["accuracy"] == 0.6667 and found["precision"] == 0.6 and found["recall"] == 1.0 and found["f1"] == 0.75
    assert found["confusion_matrix"] == [[1, 2], [0, 3]] and found["class_imbalance_ratio"] == 1.0
    assert found["per_class"]["0"] == {"precision": 1.0, "recall": 0.3333, "f1": 0.5, "support": 3}


def test_weighted_metrics_and_unseen_class(frame):
    df = frame("t string, p string", [("a", "a"), ("a", "b"), ("b", "b"), ("c", "d"), ("c", "c"), ("c", "c")])
    found = metrics.evaluate_classification(df, "t", "p")
    assert found["labels"] == ["a", "b", "c", "d"] and sum(map(sum, found["confusion_matrix"])) == 6
    assert found["per_class"]["d"] == {"precision": 0.0, "recall": 0.0, "f1": 0.0, "support": 0}
    weighted = (2 * 1.0 + 1 * 0.5 + 3 * 1.0) / 6
    assert found["precision"] == pytest.approx(weighted, abs=1e-4)


def test_two_classes_need_the_positive_one(frame):
    df = frame("t string, p string", [("yes", "yes"), ("no", "yes")])
    with pytest.raises(ValueError, match="positive"):
        metrics.evaluate_classification(df, "t", "p")
    assert metrics.evaluate_classification(df, "t", "p", positive="yes")["recall"] == 1.0


def test_f1_identity(frame):
    generator = np.random.default_rng(3)
    df = frame("t int, p int", [(int(a), int(b)) for a, b in generator.integers(0, 2, (200, 2))])
    row = metrics.classification_summary(metrics.confusion_counts(df, "t", "p")).first()
    assert row["f1"] == pytest.approx(2 * row["precision"] * row["recall"] / (row["precision"] + row["recall"]))


def _plain_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auc_with_ties(frame):
    generator = np.random.default_rng(4)
    y, s = generator.integers(0, 2, 300), generator.integers(0, 20, 300) / 20
    df = frame("y int, s double", [(int(a), float(b)) for a, b in zip(y, s)])
    assert metrics.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(_plain_auc(y, s))
    one = df.where("y = 1")
    assert metrics.roc_auc(one, "y", "s").first()["roc_auc"] is None
    assert "roc_auc" not in metrics.evaluate_classification(one.withColumn("p", F.lit(1)), "y", "p", score="s")


def test_auc_one_vs_rest(frame):
    generator = np.random.default_rng(5)
    y, s = generator.integers(0, 3, 200), generator.random((200, 3))
    df = frame("y int, s array<double>", [(int(a), [float(v) for v in b]) for a, b in zip(y, s)])
    expected = sum(_plain_auc((y == k).astype(int), s[:, k]) * (y == k).mean() for k in range(3))
    assert metrics.roc_auc_ovr(df, "y", "s", [0, 1, 2]).first()["roc_auc"] == pytest.approx(expected)


def test_regression_metrics(frame):
    y, p = np.array([3.0, -0.5, 2.0, 7.0, 0.0]), np.array([2.5, 0.0, 2.0, 8.0, 1.0])
    df = frame("y double, p double", [(float(a), float(b)) for a, b in zip(y, p)])
    found = metrics.evaluate_regression(df, "y", "p")
    r = y - p
    assert found["r2"] == pytest.approx(1 - (r @ r) / ((y - y.mean()) ** 2).sum(), abs=1e-4)
    assert found["mape"] == pytest.approx(np.mean(np.abs(r[:4] / y[:4])) * 100, abs=1e-4)
    assert found["residuals"]["std"] == pytest.approx(r.std(), abs=1e-4)


def test_regression_edge_cases(frame):
    constant = frame("y double, p double", [(0.0, 0.0), (0.0, 0.0)])
    found = metrics.evaluate_regression(constant, "y", "p")
    assert found["r2"] == 1.0 and found["mape"] is None
    assert metrics.evaluate_regression(frame("y double, p double", [(2.0, 1.0), (2.0, 2.0)]), "y", "p")["r2"] == 0.0


def test_wilson():
    lower, upper = metrics.wilson_interval(0.85, 200)
    assert lower < 0.85 < upper and (lower, upper) == (0.7939, 0.8929)
    wide = metrics.wilson_interval(0.85, 20)
    assert wide[1] - wide[0] > upper - lower
    assert metrics.wilson_interval(1.0, 10)[1] == 1.0 and metrics.wilson_interval(0.0, 10)[0] == 0.0


def test_tails():
    assert tails.chi2_one_tail(3.841458820694124) == pytest.approx(0.05)
    assert tails.student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.student_two_sided(-12.706204736, 1) == pytest.approx(0.05, abs=1e-7)
    assert tails.student_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


# Comparison

RUNS = [
    (1, "neural_network", {"accuracy": 0.71, "f1": 0.66, "training_time_s": 0.4}, [[70, 30], [28, 72]]),
    (2, "xgboost", {"accuracy": 0.83, "f1": 0.8, "training_time_s": 3.2}, [[85, 15], [19, 81]]),
    (3, "logistic_regression", {"accuracy": 0.79, "f1": 0.75, "training_time_s": 1.7}, [[80, 20], [22, 78]]),
]
SCHEMA = "run_id long, model_type string, metrics map<string,double>, confusion_matrix array<array<long>>"


@pytest.fixture(scope="module")
def runs(frame):
    return frame(SCHEMA, RUNS)


def order(df):
    return [r["run_id"] for r in df.orderBy("rank").collect()]


def test_ranking(runs, frame):
    assert order(compare.rank_runs(runs)) == [2, 3, 1]
    assert order(compare.rank_runs(runs, "training_time_s")) == [1, 3, 2]
    lacking = frame(SCHEMA, [(0, "x", {}, None), *RUNS])
    assert order(compare.rank_runs(lacking)) == [2, 3, 1, 0]
    ranked = compare.rank_runs(lacking)
    assert order(ranked) == [2, 3, 1, 0] and [r["rank"] for r in ranked.orderBy("rank").collect()] == [1, 2, 3, 4]


def test_compare(runs, frame):
    found = compare.compare_runs(runs)
    assert found["winner"]["run_id"] == 2 and found["winner"]["margin_over_second"] == 0.04
    assert found["winner"]["clearly_better"] and found["practically_significant"] and found["total_runs"] == 3
    (test,) = found["pairwise_significance"]
    assert (test["discordant_n01"], test["discordant_n10"]) == (0, 8) and test["statistic"] == 6.125
    assert test["p_value"] == 0.0133 and test["significant"]
    assert order(found["leaderboard"]) == [2, 3, 1]
    assert "error" in compare.compare_runs(frame(SCHEMA, []))
    assert compare.compare_runs(frame(SCHEMA, RUNS[:1]))["winner"]["run_id"] == 1


def test_best_model(runs, frame):
    found = compare.find_best_model(runs)
    assert found["best_run"]["model_type"] == "xgboost" and "xgboost reached accuracy 0.83" in found["recommendation"]
    tied = [(1, "slow", {"accuracy": 0.901, "training_time_s": 10.0}, None), (2, "fast", {"accuracy": 0.900, "training_time_s": 0.5}, None)]
    assert compare.find_best_model(frame(SCHEMA, tied))["best_run"]["model_type"] == "fast"
    unknown = [tied[0], (2, "untimed", {"accuracy": 0.9}, None)]
    assert compare.find_best_model(frame(SCHEMA, unknown))["best_run"]["model_type"] == "slow"
    assert "error" in compare.find_best_model(frame(SCHEMA, []))


def test_missing_tiebreak_loses_in_both_directions(frame):
    close = [(1, "silent", {"accuracy": 0.901}, None), (2, "telling", {"accuracy": 0.900, "f1": 0.8, "rmse": 3.0}, None)]
    for metric in ("f1", "rmse"):
        assert compare.find_best_model(frame(SCHEMA, close), tiebreak_metric=metric)["best_run"]["model_type"] == "telling"
    # Without the metric on either side the first stays.
    assert compare.find_best_model(frame(SCHEMA, close), tiebreak_metric="recall")["best_run"]["model_type"] == "silent"


def test_mcnemar():
    assert compare.mcnemar_test([[5, 0], [0, 5]], [[4, 1], [0, 6]])["p_value"] == 1.0
    found = compare.mcnemar_test([[10, 0], [0, 10]], [[5, 5], [5, 5]])
    assert found["statistic"] == 8.1 and found["discordant_n10"] == 10 and found["significant"]


def test_mcnemar_rows(frame):
    rows = [(i, i % 2, i % 2 if i < 30 else 1 - i % 2, i % 2 if i >= 25 else 1 - i % 2) for i in range(40)]
    df = frame("k int, y int, a int, b int", rows)
    found = compare.mcnemar_by_rows(df, df, "k", "y", "a", "b").first()
    assert (found["discordant_n01"], found["discordant_n10"]) == (10, 25)
    assert found["p_value"] == pytest.approx(math.erfc(math.sqrt(14**2 / 35 / 2))) and found["significant"]


def test_welch(frame):
    a, b = [0.9, 0.91, 0.92, 0.9], [0.8, 0.85, 0.82, 0.81]
    lists = compare.t_test_metrics(a, b)
    df = frame("m string, v double", [("a", v) for v in a] + [("b", v) for v in b])
    row = compare.welch_test(df, "m", "v", "a", "b").first()
    assert row["statistic"] == pytest.approx(lists["statistic"], abs=1e-4) and row["p_value"] == pytest.approx(lists["p_value"], abs=1e-4)
    assert lists["significant"] and row["significant"]
    assert not compare.t_test_metrics([0.8] * 3, [0.8] * 3)["significant"]
    flat = frame("m string, v double", [("a", 0.8), ("a", 0.8), ("b", 0.8), ("b", 0.8)])
    assert compare.welch_test(flat, "m", "v", "a", "b").first()["significant"] is False


# Error analysis


def test_confusion_analysis(pairs):
    cells = metrics.confusion_counts(pairs, "t", "p")
    found = analysis.confusion_matrix_analysis(cells)
    assert found["hardest_class"] == "0" and found["overall_error_rate"] == 0.3333
    assert found["error_rate_per_class"]["0"] == {"total": 3, "correct": 1, "errors": 2, "error_rate": 0.6667}
    assert found["most_confused_pairs"] == [{"true_class": 0, "predicted_as": 1, "count": 2, "rate_of_true_class": 0.6667}]


def test_residuals(frame):
    df = frame("k int, y double, p double", [(i, float(i), i + 1.0 + (10 if i == 7 else 0)) for i in range(20)])
    found = analysis.residual_analysis(df, "y", "p", "k", 3)
    assert found["bias"]["direction"] == "over-predicts"
    assert found["worst_predictions"][0]["k"] == 7 and len(found["worst_predictions"]) == 3
    assert found["error_percentiles"]["p50"] == 1.0 and not found["normality"]["approximately_normal"]
    exact = frame("k int, y double, p double", [(i, float(i), float(i)) for i in range(5)])
    flat = analysis.residual_analysis(exact, "y", "p", "k")
    assert flat["bias"]["direction"] == "unbiased" and flat["variance"]["heteroscedastic"] is False


def test_examples(pairs):
    wrong = analysis.error_examples(pairs, "t", "p", "row_id", n=1).collect()
    assert [r["row_id"] for r in wrong] == [1]
    largest = analysis.error_examples(pairs, "t", "p", "row_id", ["t"] and [], 2, "regression").collect()
    assert [r["abs_error"] for r in largest] == [1.0, 1.0] and [r["row_id"] for r in largest] == [1, 2]


def test_importance(spark):
    found = analysis.importance_summary({"a": 1.0, "b": 6.0, "c": 3.0}, "m")
    assert [f["feature"] for f in found["top_features"]] == ["b", "c", "a"]
    assert found["features_for_80pct"] == 2 and found["features_for_95pct"] == 3
    assert analysis.importance_summary(None)["method"] == "not_available"
    rows = analysis.importance_table(spark.range(1), {"a": 1.0, "b": 3.0}, 1).collect()
    assert [tuple(r) for r in rows] == [(1, "b", 3.0, 75.0, 75.0)]
