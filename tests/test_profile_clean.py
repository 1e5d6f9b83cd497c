import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from columns import column
from tabloom.functions import moments, sketch
from tabloom.operators import clean, encode, profile


@pytest.fixture(scope="module")
def people(frame):
    return frame(
        "row_id long, age double, income double, gender string, city string",
        [
            (0, 25.0, 50000.0, "M", "NY"),
            (1, 30.0, None, "F", "LA"),
            (2, None, 70000.0, "M", "NY"),
            (3, 45.0, 80000.0, None, "LA"),
            (4, 200.0, 90000.0, "F", "NY"),
        ],
    )


@pytest.fixture(scope="module")
def numbers(frame):
    return frame("row_id long, x double, y double", [(i, float(i + 1), 10.0 * (i + 1)) for i in range(5)])


def test_statistics(people):
    stats = profile.dataset_statistics(people)
    assert stats["shape"] == {"rows": 5, "columns": 5}
    assert stats["missing"]["age"] == 1 and stats["missing_pct"]["income"] == 20.0
    assert stats["duplicates"] == 0
    assert stats["numeric_stats"]["age"]["50%"] == 37.5 and stats["numeric_stats"]["age"]["count"] == 4
    assert stats["categorical_stats"]["gender"] == {"unique": 2, "top": "F", "freq": 2}
    assert stats["categorical_stats"]["city"]["top"] == "NY"


def test_missing_report_order(people):
    report = profile.missing_report(people).collect()
    assert [r["column"] for r in report] == ["age", "income", "gender", "row_id", "city"]
    assert [r["column"] for r in profile.top_missing(people, 2).collect()] == ["age", "income"]


def test_kinds_and_types(frame):
    df = frame("a int, b boolean, c string, d timestamp_ntz, e double", [])
    kinds = {r["kind"]: r["n_columns"] for r in profile.kind_counts(df).collect()}
    assert kinds == {"Numeric": 2, "Datetime": 1, "Categorical": 2}
    assert [r["column"] for r in profile.column_types(df).orderBy("position").collect()] == list("abcde")


def test_all_null_category(frame):
    df = frame("row_id long, c string", [(1, None), (2, None)])
    row = profile.categorical_stats(df, ["c"]).first()
    assert (row["unique"], row["top"], row["freq"]) == (0, None, 0)


def test_duplicates_count_nulls_as_equal(frame):
    df = frame("a int, b string", [(1, None), (1, None), (1, None), (2, "x")])
    assert profile.duplicate_count(df).first()[0] == 2


def test_distribution_small_samples(frame):
    df = frame("a double, b double, c double", [(1.0, 5.0, 1.0), (2.0, 5.0, None), (3.0, 5.0, None), (10.0, 5.0, None)])
    rows = {r["column"]: r for r in profile.distribution_stats(df).collect()}
    assert rows["a"]["skewness"] == pytest.approx(1.7636, abs=1e-4)
    assert (rows["b"]["skewness"], rows["b"]["kurtosis"]) == (0.0, 0.0)
    assert (rows["c"]["skewness"], rows["c"]["kurtosis"], rows["c"]["std"]) == (None, None, None)


def test_kurtosis_value(frame):
    df = frame("a double", [(v,) for v in (1.0, 2.0, 3.0, 10.0, 4.0)])
    assert profile.distribution_stats(df).first()["kurtosis"] == pytest.approx(3.152, abs=1e-3)


@pytest.mark.parametrize("block", [128, 2])
def test_correlation_pairwise_and_constant(frame, monkeypatch, block):
    monkeypatch.setattr(moments, "COLUMN_BLOCK", block)
    df = frame("a double, b double, k double", [(1.0, 2.0, 7.1), (2.0, None, 7.1), (3.0, 6.5, 7.1), (4.0, 7.0, 7.1)])
    corr = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df).collect()}
    assert len(corr) == 9
    assert corr["a", "a"] == pytest.approx(1.0)
    assert corr["a", "b"] == corr["b", "a"] == pytest.approx(49 / 6 / math.sqrt(14 / 3 * 91 / 6))
    assert corr["a", "k"] is None and corr["k", "k"] is None


@pytest.mark.parametrize("width", [16, 17, 140])
def test_correlation_has_one_rule_at_every_width(spark, width):
    """Nulls, infinite values beside nulls and beside values, and complete rows far from the column's mean."""
    random = np.random.default_rng(3)
    x = random.normal(size=(120, width))
    x[:, 1] += x[:, 0]
    x[random.random(x.shape) < 0.1] = np.nan
    x[5, 2], x[5, 3] = np.inf, np.nan
    # Where column 4 is present, column 5 lies far from its mean and hardly varies.
    x[:, 5] = np.where(np.arange(120) < 60, 1e9 + 1e-1 * np.arange(120), -1e9)
    x[:, 4] = np.where(np.arange(120) < 60, random.normal(size=120), np.nan)
    names = [f"c{i}" for i in range(width)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    corr = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df).collect()}
    assert len(corr) == width**2
    for i, j in [(0, 1), (0, 2), (2, 3), (2, 2), (3, 3), (4, 5), (5, 4), (5, 5), (0, 5), (width - 1, 1), (1, width - 1)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        if np.isinf(a).any() or np.isinf(b).any():
            assert corr[names[i], names[j]] is None
        else:
            assert corr[names[i], names[j]] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-7)


def test_drop(people):
    assert clean.handle_missing_values(people, "drop").count() == 2
    assert clean.handle_missing_values(people, "drop", ["age"]).count() == 4


def test_mean_and_median(people):
    assert column(clean.handle_missing_values(people, "mean", ["age"]), "age")[2] == 75.0
    filled = clean.handle_missing_values(people, "median")
    assert column(filled, "age")[2] == 37.5 and column(filled, "gender")[3] is None


def test_mean_turns_integers_to_doubles(frame):
    df = frame("row_id long, n int", [(1, 1), (2, 2), (3, None)])
    assert column(clean.handle_missing_values(df, "mean", ["n"]), "n") == [1.0, 2.0, 1.5]


def test_mode_smallest_on_tie(people, frame):
    assert column(clean.handle_missing_values(people, "mode", ["gender", "age"]), "gender")[3] == "F"
    empty = frame("row_id long, c string", [(1, None)])
    assert column(clean.handle_missing_values(empty, "mode", ["c"]), "c") == [None]


def test_fills_in_order(people):
    forward = clean.handle_missing_values(people, "forward_fill", order_by="row_id")
    assert column(forward, "age")[2] == 30.0 and column(forward, "gender")[3] == "M"
    backward = clean.handle_missing_values(people, "backward_fill", order_by="row_id")
    assert column(backward, "age")[2] == 45.0
    with pytest.raises(ValueError, match="order_by"):
        clean.handle_missing_values(people, "forward_fill")


def test_constant(people):
    assert column(clean.handle_missing_values(people, "constant", ["age"], 0), "age")[2] == 0.0
    assert column(clean.handle_missing_values(people, "constant", ["gender"], "?"), "gender")[3] == "?"
    with pytest.raises(ValueError):
        clean.handle_missing_values(people, "constant", ["age"])
    with pytest.raises(TypeError):
        clean.handle_missing_values(people, "constant", ["age"], "text")
    with pytest.raises(ValueError, match="Unknown strategy"):
        clean.handle_missing_values(people, "guess")


def test_outliers(people):
    found = clean.detect_outliers(people, "age", "iqr", key="row_id")
    assert found.outlier_count == 1 and [r["row_id"] for r in found.keys.collect()] == [4]
    assert found.outlier_pct == 20.0
    assert clean.detect_outliers(people, "age", "zscore").outlier_count == 0
    assert clean.outlier_summary(people, "age").first()["outlier_count"] == 1
    with pytest.raises(TypeError):
        clean.detect_outliers(people, "city")
    with pytest.raises(ValueError):
        clean.detect_outliers(people, "age", "other")


def test_remove_outliers_keeps_missing(people):
    assert column(clean.remove_outliers(people, "age"), "row_id") == [0, 1, 2, 3]


def test_single_value_has_no_outliers(frame):
    assert clean.detect_outliers(frame("x double", [(1.0,)]), "x", "zscore").outlier_count == 0


def test_label_codes(frame):
    df = frame("row_id long, c string", [(0, "b"), (1, None), (2, "a"), (3, "B")])
    assert column(encode.encode_categoricals(df, ["c"]), "c") == [2, -1, 1, 0]


def test_label_codes_without_broadcast(frame, monkeypatch):
    monkeypatch.setattr(encode, "BROADCAST_CATEGORIES", 2)
    df = frame("row_id long, c string", [(0, "b"), (1, None), (2, "a"), (3, "B"), (4, "a")])
    assert column(encode.label_encode(df, "c", "_encoded"), "c_encoded") == [2, -1, 1, 0, 1]


def test_long_categories_are_not_broadcast(frame, monkeypatch):
    monkeypatch.setattr(encode, "CATEGORY_BYTES", 3)
    df = frame("row_id long, c string", [(0, "bbbb"), (1, "aaaa")])
    assert encode.distinct_values(df, "c", 100) is None
    assert column(encode.encode_categoricals(df, ["c"]), "c") == [1, 0]


def test_one_hot(people):
    hot = encode.encode_categoricals(people, ["gender"], "onehot")
    assert hot.columns == ["row_id", "age", "income", "city", "gender_F", "gender_M"]
    assert column(hot, "gender_F") == [False, True, False, False, True]
    assert column(hot, "gender_M")[3] is False
    with pytest.raises(ValueError):
        encode.encode_categoricals(people, ["gender"], "other")
    with pytest.raises(ValueError, match="more than 1"):
        encode.one_hot_encode(people, "gender", max_categories=1)


def test_normalize(numbers):
    standard = column(clean.normalize_features(numbers, ["x"], "standard"), "x")
    assert sum(standard) == pytest.approx(0) and standard[4] == pytest.approx(1.2649, abs=1e-4)
    assert column(clean.normalize_features(numbers, ["x", "y"], "minmax"), "y") == [0, 0.25, 0.5, 0.75, 1]
    assert column(clean.normalize_features(numbers, ["x"], "robust"), "x") == [-1, -0.5, 0, 0.5, 1]


def test_normalize_without_spread(frame):
    df = frame("row_id long, k double", [(0, 3.0), (1, 3.0)])
    for method in ("standard", "minmax", "robust"):
        assert column(clean.normalize_features(df, ["k"], method), "k") == [0.0, 0.0]


def test_normalize_errors(people):
    with pytest.raises(TypeError):
        clean.normalize_features(people, ["city"])
    with pytest.raises(ValueError):
        clean.normalize_features(people, ["age"], "other")


@pytest.fixture(scope="module")
def repeated(frame):
    return frame("row_id long, a int, b string", [(0, 1, "x"), (1, 1, "x"), (2, 2, "y"), (3, 1, None), (4, 1, None)])


def test_dedup_subset(repeated):
    first = clean.remove_duplicates(repeated, ["a", "b"], "first", order_by="row_id")
    assert column(first, "row_id") == [0, 2, 3]
    assert column(clean.remove_duplicates(repeated, ["a", "b"], "last", order_by="row_id"), "row_id") == [1, 2, 4]
    assert column(clean.remove_duplicates(repeated, ["a", "b"], keep=False), "row_id") == [2]
    assert clean.count_removed(repeated, first) == 2


def test_dedup_whole_rows(repeated):
    assert clean.remove_duplicates(repeated.select("a", "b")).count() == 3
    assert clean.remove_duplicates(repeated.select("a", "b"), keep=False).count() == 1
    with pytest.raises(ValueError, match="order_by"):
        clean.remove_duplicates(repeated, ["a"])
    with pytest.raises(ValueError, match="keep"):
        clean.remove_duplicates(repeated, ["a"], "middle", order_by="row_id")


def test_dedup_cuts_groups_before_the_shuffle(repeated):
    kept = clean.remove_duplicates(repeated, ["a"], order_by="row_id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial")
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < partial


def test_equal_sketches_are_compared_whole(frame, monkeypatch):
    """With sketches that say little, rows that only look repeated are still told apart."""
    rows = [(1, None, 0.0, "x"), (1, None, -0.0, "x"), (None, 1, float("nan"), "x"), (None, 1, float("nan"), "x"), (2, 2, 1.0, None), (2, 2, 1.0, "None"), (3, 3, 1.0, "y")]
    df = frame("a int, b int, c double, d string", rows)
    expected = (profile.duplicate_count(df).first()[0], sorted(map(repr, clean.remove_duplicates(df, keep=False).collect())))
    assert expected[0] == 2 and len(expected[1]) == 3

    def same(table, columns):
        return table.withColumns({name: F.lit(0).cast("long") for name in sketch.SKETCH})

    monkeypatch.setattr(profile, "with_sketch", same)
    monkeypatch.setattr(clean, "with_sketch", same)
    assert (profile.duplicate_count(df).first()[0], sorted(map(repr, clean.remove_duplicates(df, keep=False).collect()))) == expected
