import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import models
from tabloom.operators.clean import handle_missing_values
from tabloom.operators.prepare import split
from tabloom.operators.scaler import Scaler
from tabloom.plans.workflow import IN_TEST, WorkflowConfig, _fitting, _marked, run_workflow
from tabloom.plans.workspace import Workspace
from tabloom.streaming.scoring import score_stream, write_stream

FEATURES = [f"f{i}" for i in range(4)]
SMALL = {
    "random_forest": {"n_estimators": 8, "max_depth": 4},
    "xgboost": {"n_estimators": 4, "max_depth": 3},
    "neural_network": {"hidden_layer_sizes": (16,), "max_iter": 200, "learning_rate_init": 0.02, "batch_size": 32},
    "logistic_regression": {"max_iter": 50},
    "svm": {"kernel": "linear"},
}


def clusters(spark, classes, rows=240, text=False):
    """Gaussian clusters, one per class."""
    generator = np.random.default_rng(classes)
    centres = generator.normal(0, 3, (classes, len(FEATURES)))
    data = []
    for i in range(rows):
        k = i % classes
        data.append((i, *map(float, centres[k] + generator.normal(0, 1, len(FEATURES))), f"class {k}" if text else k))
    kind = "string" if text else "int"
    return spark.createDataFrame(data, "key long, " + ", ".join(f"{f} double" for f in FEATURES) + f", y {kind}").coalesce(1)


@pytest.fixture(scope="module")
def binary(spark):
    return split(clusters(spark, 2), "key", 0.25, stratify="y")


@pytest.fixture(scope="module")
def many(spark):
    return split(clusters(spark, 3, text=True), "key", 0.25, stratify="y")


@pytest.fixture(scope="module")
def numeric(spark):
    generator = np.random.default_rng(9)
    x = generator.normal(0, 1, (240, len(FEATURES)))
    y = x @ np.array([3.0, -2.0, 0.5, 0.0]) + generator.normal(0, 0.1, 240)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(240)]
    df = spark.createDataFrame(rows, "key long, " + ", ".join(f"{f} double" for f in FEATURES) + ", y double").coalesce(1)
    return split(df, "key", 0.25)


@pytest.mark.parametrize("family", models.list_model_types())
def test_binary_families(binary, family):
    train, test = binary
    result = models.train_model(train, FEATURES, "y", family, test, SMALL[family])
    assert result.metrics["accuracy"] > 0.8 and result.metrics["roc_auc"] > 0.8
    assert result.training_time_s > 0 and result.to_metrics_dict()["status"] == "completed"
    row = result.model.transform(test).first()
    assert len(row["probability"]) == 2 and sum(row["probability"]) == pytest.approx(1.0)
    assert row["prediction"] in (0, 1)


@pytest.mark.parametrize("family", models.list_model_types())
def test_multiclass_families(many, family):
    train, test = many
    result = models.train_model(train, FEATURES, "y", family, test, SMALL[family])
    assert result.metrics["accuracy"] > 0.7 and result.metrics["labels"] == ["class 0", "class 1", "class 2"]
    row = result.model.transform(test).first()
    assert len(row["probability"]) == 3 and sum(row["probability"]) == pytest.approx(1.0)
    assert row["prediction"].startswith("class")


@pytest.mark.parametrize("family", models.list_model_types())
def test_regression_families(numeric, family):
    train, test = numeric
    params = SMALL[family] | {"svm": {"kernel": "linear"}, "xgboost": {"n_estimators": 30}}.get(family, {})
    result = models.train_model(train, FEATURES, "y", family, test, params, "regression")
    assert result.metrics["r2"] > (0.95 if family in ("logistic_regression", "svm") else 0.5)


def test_linear_regression_finds_the_coefficients(numeric):
    model = models.fit_model(numeric[0], FEATURES, "y", "logistic_regression", task="regression")
    importances, method = model.importances()
    assert method == "coefficient_magnitude" and importances["f0"] == pytest.approx(3.0, abs=0.1)


def test_kernels(binary):
    train, test = binary
    for kernel, gamma in (("poly", "scale"), ("rbf", "auto"), ("sigmoid", 0.01)):
        result = models.train_model(train, FEATURES, "y", "svm", test, {"kernel": kernel, "gamma": gamma, "n_components": 40})
        assert result.metrics["accuracy"] > 0.8
    with pytest.raises(ValueError, match="kernel"):
        models.fit_model(train, FEATURES, "y", "svm", {"kernel": "cosine"})


def test_factory():
    assert models.build_model("random_forest", {"n_estimators": 13}).trees == 13
    whole = models.build_model("random_forest", features=17)
    assert whole.max_depth is None and whole.drawn == 4 and whole.classes == 2
    logistic = models.build_model("logistic_regression", {"penalty": "l1", "C": 0.5}, rows=100)
    assert logistic.getElasticNetParam() == 1.0 and logistic.getRegParam() == pytest.approx(0.02)
    net = models.build_model("neural_network", {"activation": "tanh"}, classes=3)
    assert (net.hidden, net.activation, net.outputs) == ((128, 64, 32), "tanh", 3)
    assert models.build_model("neural_network", task="regression").outputs == 1
    assert models.build_model("xgboost", classes=3).outputs == 3
    assert models.build_model("xgboost", task="regression").classes == 0
    with pytest.raises(ValueError, match="Unknown model type"):
        models.build_model("magic")
    for wrong in ({"activation": "sine"}, {"learning_rate": "fast"}, {"solver": "lbfgs"}):
        with pytest.raises(ValueError, match="is none of"):
            models.build_model("neural_network", wrong)
    with pytest.raises(ValueError, match="Unknown task"):
        models.build_model("svm", task="ranking")


@pytest.mark.parametrize("labels", [(0, 1), (1, 2), (-1, 1), ("no", "yes"), (False, True)])
def test_auc_follows_the_greater_label(spark, labels):
    kind = {int: "int", str: "string", bool: "boolean"}[type(labels[0])]
    rows = [(float(i), labels[(i % 10 < 2) != (i > 60)]) for i in range(120)]
    df = spark.createDataFrame(rows, f"f double, y {kind}")
    found = models.train_model(df, ["f"], "y", "logistic_regression").metrics
    greater = [f for f, y in rows if y == labels[1]]
    lesser = [f for f, y in rows if y == labels[0]]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in greater for b in lesser])
    assert found["roc_auc"] == pytest.approx(area, abs=1e-3) and found["roc_auc"] > 0.7


def test_input_names_do_not_matter(binary):
    train, test = binary
    plain = models.train_model(train, FEATURES, "y", "logistic_regression", test).metrics
    names = dict(zip(FEATURES, ["label", "features", "prediction", "rawPrediction"]))
    renamed = [part.withColumnsRenamed(names) for part in (train, test)]
    model = models.fit_model(renamed[0], list(names.values()), "y", "logistic_regression")
    found = models.evaluate_model(model, renamed[1], "y")
    assert found == plain
    assert set(model.transform(renamed[1]).columns) == {"key", "label", "features", "rawPrediction", "y", "prediction", "probability"}


def test_importances_average_the_classes(many):
    model = models.fit_model(many[0], FEATURES, "y", "svm", SMALL["svm"])
    parts = [np.abs(m.coefficients.toArray()) for m in model.stages.stages[-1].models]
    assert len(parts) == 3
    assert list(model.importances()[0].values()) == pytest.approx(list(np.mean(parts, axis=0)))
    for family in ("xgboost", "random_forest"):
        values, method = models.fit_model(many[0], FEATURES, "y", family, SMALL[family]).importances()
        assert method == "mean_decrease_impurity" and sum(values.values()) == pytest.approx(1.0)


def test_hyperparameters_are_checked():
    for family, wrong in (
        ("xgboost", {"max_depth": None}), ("random_forest", {"max_depth": 0}), ("random_forest", {"min_samples": 4}),
        ("neural_network", {"beta": 0.1}), ("xgboost", {"n_estimatos": 5}),
    ):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            models.build_model(family, wrong)
    assert models.build_model("svm", {"max_iter": 5000}).getMaxIter() == 5000


def test_train_multiple_is_sorted(binary):
    train, test = binary
    configs = [{"type": "random_forest", "hyperparams": {"n_estimators": 1, "max_depth": 1}}, {"type": "logistic_regression"}]
    results = models.train_multiple(train, FEATURES, "y", configs, test)
    scores = [r.metrics["accuracy"] for r in results]
    assert len(results) == 2 and scores == sorted(scores, reverse=True)
    assert results[0].hyperparams.keys() >= {"random_state"}


@pytest.mark.parametrize("family", models.list_model_types())
def test_save_and_load(many, tmp_path, family):
    train, test = many
    model = models.fit_model(train, FEATURES, "y", family, SMALL[family])
    loaded = models.load_model(model.save(str(tmp_path / "model")))
    values = lambda m: [r["prediction"] for r in m.transform(test).orderBy("key").collect()]
    assert values(loaded) == values(model) and loaded.classes == model.classes
    with pytest.raises(FileNotFoundError):
        models.load_model(str(tmp_path / "absent"))
    assert models.model_save_path("m", 1, 2, "svm") == "m/project_1_run_2_svm"


def test_missing_features_and_labels(binary):
    train, test = binary
    holed = train.withColumn("f0", F.when(F.col("key") % 5 != 0, F.col("f0"))).withColumn(
        "y", F.when(F.col("key") % 7 != 0, F.col("y"))
    )
    assert models.train_model(holed, FEATURES, "y", "logistic_regression", test).metrics["accuracy"] > 0.7


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    df = clusters(spark, 2).withColumns({"constant": F.lit(1.0), "f3": F.when(F.col("key") > 20, F.col("f3"))})
    path = str(folder / "data.csv")
    df.coalesce(1).write.option("header", True).csv(path)
    parquet = str(folder / "data.parquet")
    df.write.parquet(parquet)
    return path, parquet


def config(path, **changes):
    fast = [{"type": "logistic_regression", "hyperparams": {"max_iter": 20}}, {"type": "random_forest", "hyperparams": SMALL["random_forest"]}]
    return WorkflowConfig(**({"dataset_path": path, "target_col": "y", "key": "key", "models": fast} | changes))


def test_workflow(spark, dataset, tmp_path):
    result = run_workflow(spark, config(dataset[1], run_log_path=str(tmp_path)))
    assert result.data_stats["shape"] == {"rows": 240, "columns": 7} and result.data_stats["missing"]["f3"] == 21
    assert "constant" not in result.selected_features and "key" not in result.selected_features
    assert (result.train_rows, result.test_rows) == (192, 48)
    assert result.comparison["winner"]["model_type"] == result.train_results[0].model_type
    assert list(result.timings) == [
        "load", "preprocess", "feature_engineering", "feature_selection", "split_scale", "training", "compare"
    ]
    assert "Winner" in result.report and result.train_results[0].tracking_run_id
    again = run_workflow(spark, config(dataset[1]))
    assert again.selected_features == result.selected_features
    assert [r.metrics["accuracy"] for r in again.train_results] == [r.metrics["accuracy"] for r in result.train_results]


def test_fills_come_from_training_rows(spark):
    rows = [(i, float(i % 2) if i % 4 else None, i % 2) for i in range(400)]
    table = spark.createDataFrame(rows, "key long, f double, y int")
    settings = config("memory", models=[{"type": "logistic_regression"}], profile=False)
    marked = _marked(table, "y", ["key"], settings)
    assert marked.where(IN_TEST).count() == 80
    # Test values that would move the mean of all rows.
    moved = marked.withColumn("f", F.when(F.col(IN_TEST) & F.col("f").isNotNull(), 1000.0).otherwise(F.col("f")))
    filled = handle_missing_values(moved, "mean", ["f"], fit_on=_fitting(moved, settings))
    assert filled.where("key % 4 = 0").agg(F.max("f")).first()[0] < 1.0
    settings.full_data = True
    assert handle_missing_values(moved, "mean", ["f"], fit_on=_fitting(moved, settings)).where("key % 4 = 0").agg(F.max("f")).first()[0] > 100
    assert run_workflow(spark, config("memory", models=[{"type": "logistic_regression"}]), table).test_rows == 80


def test_workflow_with_spec_and_csv(spark, dataset, tmp_path):
    source = str(tmp_path / "data.csv")
    spark.read.parquet(dataset[1]).toPandas().to_csv(source, index=False)
    spec = {"features": [{"name": "f0_sq", "source": "polynomial", "base": "f0"}, {"name": "f01", "source": "interaction", "operands": ["f0", "f1"]}]}
    result = run_workflow(spark, config(source, key=None, feature_spec=spec, missing_strategy="median", correlation_threshold=0.0))
    assert {"f0_sq", "f01"} <= set(result.selected_features) and "_row_key" not in result.selected_features


def test_workflow_regression(spark, numeric, tmp_path):
    models_ = [{"type": "logistic_regression", "hyperparams": {}}]
    table = numeric[0].unionByName(numeric[1])
    result = run_workflow(spark, config("memory", task="regression", models=models_), table)
    assert result.train_results[0].metrics["r2"] > 0.95 and result.comparison["primary_metric"] == "r2"


def test_workspace(spark, dataset, tmp_path):
    space = Workspace(spark, str(tmp_path))
    project = space.create_project("Churn", "test")["id"]
    with pytest.raises(LookupError, match="no dataset"):
        space.dataset(project)
    assert space.load_data(project, dataset[1])["rows"] == 240
    assert space.data_profile(project)["shape"]["columns"] == 7
    assert space.missing_values(project).first()["column"] == "f3"
    assert set(space.feature_stats(project)) == {"correlation_matrix", "distribution_stats"}
    with pytest.raises(ValueError, match="unknown source"):
        space.create_feature_set(project, "bad", {"features": [{"name": "x", "source": "?"}]})
    spec = {"features": [{"name": "f0_sq", "source": "polynomial", "base": "f0"}]}
    feature_set = space.create_feature_set(project, "v1", spec)["id"]
    assert space.feature_sets(project).first()["feature_count"] == 1
    shown = space.preview_feature_set(project, feature_set, 3, order_by="key")
    assert shown["engineered_columns"] == ["f0_sq"] and shown["preview"].count() == 3
    assert "f0" in space.feature_importance(project, "y")["importance_scores"]
    assert space.select_features(project, "y", "variance_threshold")["selected"]
    with pytest.raises(LookupError, match="No training runs"):
        space.comparison(project)
    configs = [{"type": "logistic_regression", "hyperparams": {"max_iter": 20}}, {"type": "random_forest", "hyperparams": SMALL["random_forest"]}]
    runs = space.train_run(project, feature_set, "y", configs, key="key", random_state=7)
    assert [r["run_id"] for r in runs] == [1, 2]
    assert space.runs(project).count() == 2
    progress = space.run_progress(project, 1)
    assert progress["status"] == "completed" and json.loads(progress["details"])["random_state"] == 7
    assert space.comparison(project)["total_runs"] == 2
    best = space.best_model(project)
    assert best["confidence_interval_95"]["lower"] <= best["best_run"]["metric_value"] <= best["confidence_interval_95"]["upper"]
    found = space.run_analysis(project, 1)
    accuracy = 1 - found["confusion_matrix_analysis"]["overall_error_rate"]
    assert accuracy == pytest.approx(runs[0]["metrics"]["accuracy"], abs=1e-3)
    assert found["n_test_samples"] == sum(map(sum, runs[0]["metrics"]["confusion_matrix"]))
    assert space.catalogue.feature_history("f0_sq").count() >= 1
    assert space.experiments(project)["total_runs"] == 2
    assert space.best_logged_run(project)["best_run"]["metrics"]["accuracy"] == runs[0]["metrics"]["accuracy"]
    assert space.projects().first()["run_count"] == 2
    with pytest.raises(LookupError):
        space.run_progress(project, 99)
    with pytest.raises(LookupError):
        space.runs(42)


def test_stream_scores_like_a_batch(spark, binary, tmp_path):
    train, test = binary
    scaler = Scaler().fit(train, FEATURES)
    model = models.fit_model(scaler.transform(train), FEATURES, "y", "logistic_regression", SMALL["logistic_regression"])
    source = str(tmp_path / "in")
    test.write.parquet(source)
    stream = spark.readStream.schema(test.schema).parquet(source)
    spec = {"features": [{"name": "f0_log", "source": "log", "base": "f0"}]}
    query = write_stream(score_stream(stream, model, spec, {"f0": 0.0}, scaler), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = score_stream(test, model, spec, {"f0": 0.0}, scaler)
    columns = ["key", "prediction", "f0_log"]
    assert streamed.count() == test.count() and streamed.select(columns).exceptAll(batch.select(columns)).count() == 0
    with pytest.raises(ValueError, match="cannot run on a stream"):
        score_stream(stream, spec={"features": [{"name": "b", "source": "binning", "base": "f0"}]})
