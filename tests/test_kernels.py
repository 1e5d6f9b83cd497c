import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators import kernels as K, models


def data(n=240, seed=1):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, 3))
    return x, np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + random.normal(0, 0.05, n)


def frame(spark, x, y):
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "key long, " + ", ".join(f"f{i} double" for i in range(x.shape[1])) + ", y double").repartition(3, "key")


@pytest.mark.parametrize("kind, offset", [("rbf", 0.0), ("poly", 1.0), ("sigmoid", 0.0), ("linear", 0.0)])
def test_kernel_is_exact_when_all_rows_are_landmarks(kind, offset):
    x, _ = data(80)
    phi = K.KernelMap.of(kind, 0.3, x, 3, offset)(x)
    gram = K.kernel(kind, x, x, 0.3, 3, offset)
    if kind == "sigmoid":
        # The nearest kernel without negative curvature.
        values, vectors = np.linalg.eigh(gram)
        gram = (vectors * np.maximum(values, 0)) @ vectors.T
    assert np.abs(phi @ phi.T - gram).max() < 1e-4


def test_kernel_error_falls_with_landmarks():
    x, _ = data(2000)
    gram = K.kernel("rbf", x, x, 0.3)
    errors = []
    for m in (16, 64, 256):
        phi = K.KernelMap.of("rbf", 0.3, x[:m])(x)
        errors.append(np.linalg.norm(phi @ phi.T - gram) / np.linalg.norm(gram))
    # The stated bound: under 1 % of the Gram matrix with the default number of landmarks.
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.01


def test_landmarks_are_seeded_and_different(spark):
    df = spark.range(100).select((F.col("id") % 5).cast("double").alias("a")).coalesce(1)
    first = K.landmark_rows(df, [F.col("a")], 20, 1)
    assert len(first) == 5 and np.array_equal(first, K.landmark_rows(df, [F.col("a")], 20, 1))
    assert K.landmark_rows(df.limit(0), [F.col("a")], 20, 1).shape == (0, 1)


def loss(theta, phi, y, rules):
    error = np.abs(phi @ theta[:-1] + theta[-1] - y)
    return 0.5 * (theta[:-1] ** 2).sum() + rules.penalty * np.maximum(error - rules.epsilon, 0).sum()


@pytest.mark.parametrize("rules", [K.Rules(), K.Rules(penalty=0.05, epsilon=0.5), K.Rules(penalty=20.0, epsilon=0.0)])
@pytest.mark.parametrize("local_bytes", [K.LOCAL_BYTES, 0])
def test_regression_reaches_the_least_loss(spark, rules, local_bytes):
    """No small change of the weights, and no descent from them, lowers the convex loss."""
    x, y = data(120)
    kernel = K.KernelMap.of("rbf", 0.5, x[:12])
    model = K.fit(frame(spark, x, y), [F.col(f"f{i}") for i in range(3)], F.col("y"), rules, kernel, local_bytes)
    phi, random = kernel(x), np.random.default_rng(2)
    best = loss(model.theta, phi, y, rules)
    assert model.values(x) == pytest.approx(phi @ model.theta[:-1] + model.theta[-1])
    theta, least = model.theta, best
    for k in range(4000):
        other = theta + random.normal(size=len(theta)) * 10.0 ** random.uniform(-5, -1)
        if (value := loss(other, phi, y, rules)) < least:
            theta, least = other, value
    assert best - least < 2e-3 * best


def test_one_feature_equals_search_over_slopes(spark):
    """For a fixed slope the best intercept is found among few values; a fine grid of slopes does the rest."""
    random = np.random.default_rng(5)
    x = random.normal(size=300)
    y = 1.7 * x - 0.4 + random.standard_t(2, 300) * 0.3
    rules = K.Rules(penalty=1.0, epsilon=0.1)
    model = K.fit(frame(spark, x[:, None], y), [F.col("f0")], F.col("y"), rules, K.KernelMap("linear", 1.0))

    def best(slope):
        residual = y - slope * x
        at = np.concatenate([residual - rules.epsilon, residual + rules.epsilon])
        values = np.maximum(np.abs(residual[None, :] - at[:, None]) - rules.epsilon, 0).sum(axis=1)
        return 0.5 * slope**2 + rules.penalty * values.min(), at[values.argmin()]

    slopes = np.linspace(1.5, 1.9, 4001)
    slope = slopes[np.argmin([best(s)[0] for s in slopes])]
    assert model.theta[0] == pytest.approx(slope, abs=2e-3) and model.theta[1] == pytest.approx(best(slope)[1], abs=5e-3)


def test_family_regresses_with_kernels(spark, tmp_path):
    x, y = data(400)
    df = frame(spark, x, y)
    names = ["f0", "f1", "f2"]
    for kernel, least in (("rbf", 0.9), ("linear", -0.1)):
        result = models.train_model(df, names, "y", "svm", None, {"kernel": kernel, "C": 10.0}, "regression")
        assert result.metrics["r2"] > least
    importances, method = result.model.importances()
    assert method == "coefficient_magnitude" and list(importances) == names
    loaded = models.load_model(result.model.save(str(tmp_path / "m")))
    values = [[r.prediction for r in m.transform(df).orderBy("key").collect()] for m in (loaded, result.model)]
    assert values[0] == pytest.approx(values[1])


def test_sums_in_kernel_values_are_those_in_features():
    """Only rows on a kink need their features; loss, gradient and second derivatives are the same."""
    random = np.random.default_rng(8)
    x, y, theta = random.normal(size=(200, 3)), random.normal(size=200), random.normal(size=21)
    map_ = K.KernelMap.of("rbf", 0.3, x[:20])
    values, weights = map_.values(x), np.array(map_.weights)
    for width in (1.0, 1e-3):
        found = K.objective(theta, iter([(values[:90], y[:90]), (values[90:], y[90:])]), weights, K.Rules(), width)
        expected = K.objective(theta, iter([(map_(x), y)]), None, K.Rules(), width)
        assert np.allclose(found, expected, rtol=1e-6, atol=1e-6 * np.abs(expected).max())


def test_mapped_features_are_made_in_slices(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(50, 3))
    map_ = K.KernelMap.of("rbf", 0.3, x[:20])
    monkeypatch.setattr(K, "SLICE_ROWS", 7)
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x.tolist())], ["key", "features"]).coalesce(1)
    rows = map_.apply(df).orderBy("key").collect()
    assert np.allclose([r["features"].toArray() for r in rows], map_(x))
