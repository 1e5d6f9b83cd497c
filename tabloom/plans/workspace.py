"""One class with the whole project workflow over catalogue tables: what a service would expose."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.functions.columns import as_list, col, numeric_columns, require_columns
from tabloom.operators import analysis, compare, models, profile, selection
from tabloom.operators.metrics import confusion_counts, wilson_interval
from tabloom.operators.prepare import fill_with, fit_means, split
from tabloom.operators.scaler import Scaler
from tabloom.plans.spec import build_feature_set, preview, validate_feature_definitions
from tabloom.session import durable
from tabloom.sources.catalogue import Catalogue
from tabloom.sources.readers import ingest, load_dataset
from tabloom.sources.tables import utc_now
from tabloom.sources.tracking import RunLog


class Workspace:
    """Projects with datasets, feature sets, training runs and analyses, stored under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.catalogue = Catalogue(spark, f"{self.root}/catalogue")
        self.log = RunLog(spark, f"{self.root}/tracking")

    # Projects and data

    def create_project(self, name: str, description: str | None = None) -> dict:
        return self.catalogue.create_project(name, description)

    def projects(self) -> DataFrame:
        return self.catalogue.projects()

    def load_data(self, project_id: int, source: str, **options: Any) -> dict:
        """Store a dataset for the project."""
        self._project(project_id)
        version = self.catalogue.next_id("datasets")
        stored = ingest(self.spark, source, f"{self.root}/datasets/project_{project_id}_{version}.parquet", **options)
        self.catalogue.attach_dataset(project_id, stored["dataset_path"])
        return {"project_id": project_id, **stored}

    def dataset(self, project_id: int) -> DataFrame:
        self._project(project_id)
        row = self.catalogue.latest_datasets().where(F.col("project_id") == project_id).first()
        if row is None:
            raise LookupError(f"Project {project_id} has no dataset; call load_data first.")
        return load_dataset(self.spark, row["dataset_path"])

    def data_profile(self, project_id: int) -> dict:
        return {"project_id": project_id, **profile.dataset_statistics(self.dataset(project_id))}

    def missing_values(self, project_id: int) -> DataFrame:
        return profile.missing_report(self.dataset(project_id))

    def feature_stats(self, project_id: int) -> dict[str, DataFrame]:
        df = self.dataset(project_id)
        return {
            "correlation_matrix": profile.correlation_matrix(df),
            "distribution_stats": profile.distribution_stats(df),
        }

    # Feature sets and selection

    def create_feature_set(self, project_id: int, name: str, spec: dict) -> dict:
        self._project(project_id)
        errors = validate_feature_definitions(spec)
        if errors:
            raise ValueError("; ".join(errors))
        return self.catalogue.create_feature_set(project_id, name, spec)

    def feature_sets(self, project_id: int) -> DataFrame:
        self._project(project_id)
        return self.catalogue.feature_sets(project_id)

    def preview_feature_set(self, project_id: int, feature_set_id: int, rows: int = 5, order_by=None) -> dict:
        name, spec = self._feature_set(project_id, feature_set_id)
        original, engineered, table = preview(self.dataset(project_id), spec, rows, order_by)
        return {
            "feature_set_id": feature_set_id,
            "feature_set_name": name,
            "original_columns": original,
            "engineered_columns": engineered,
            "preview": table,
        }

    def feature_importance(self, project_id: int, target: str, method: str = "correlation") -> dict:
        scores = selection.feature_importance(self.dataset(project_id), target, method)
        return {"project_id": project_id, "target": target, "method": method, "importance_scores": scores}

    def select_features(self, project_id: int, target: str, method: str = "correlation", **settings: Any) -> dict:
        found = selection.select_features(self.dataset(project_id), target, method, **settings)
        return {"project_id": project_id, **found.to_dict()}

    # Training

    def _prepared(self, project_id: int, spec: dict, target: str, key, order_by) -> tuple[DataFrame, list[str], list[str]]:
        df = self.dataset(project_id)
        keys = as_list(key)
        require_columns(df, [target, *keys])
        built = build_feature_set(df, spec, order_by)
        features = numeric_columns(built, exclude=[target, *keys])
        return built.select(*map(col, dict.fromkeys([*keys, *features, target]))), features, keys

    def train_run(
        self,
        project_id: int,
        feature_set_id: int,
        target: str,
        configs: Sequence[dict],
        key: str | Sequence[str],
        task: str = "classification",
        test_size: float = 0.2,
        random_state: int = 42,
        stratify: bool = False,
        order_by: str | Sequence[str] | None = None,
    ) -> list[dict]:
        """Train models on the project's dataset and record the runs with their split and scaler."""
        project = self._project(project_id)
        name, spec = self._feature_set(project_id, feature_set_id)
        built, features, keys = self._prepared(project_id, spec, target, key, order_by)
        table = durable(built)
        train, test = split(table, keys, test_size, random_state, target if stratify else None)
        means = fit_means(train, features)
        train, test = fill_with(train, means), fill_with(test, means)
        scaler = Scaler("standard").fit(train, features)
        results = models.train_multiple(
            scaler.transform(train), features, target, configs, scaler.transform(test), task
        )
        experiment = self.log.get_or_create_experiment(project_id, project["name"])
        first = self.catalogue.next_id("training_runs")
        rows, records = [], []
        for run_id, r in enumerate(results, first):
            r.model_path = models.model_save_path(f"{self.root}/models", project_id, run_id, r.model_type)
            r.model.save(r.model_path)
            r.tracking_run_id = self.log.log_run(r, experiment, name, project_id, run_id)
            record = r.to_metrics_dict()
            numbers = {k: float(v) for k, v in record.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
            details = record | {
                "target": target,
                "key": keys,
                "order_by": as_list(order_by),
                "test_size": test_size,
                "random_state": random_state,
                "stratify": stratify,
                "means": means,
                "scaler": scaler.to_dict(),
            }
            rows.append(
                (run_id, project_id, feature_set_id, r.model_type, "completed", numbers,
                 r.metrics.get("confusion_matrix"), json.dumps(details, default=str), utc_now())
            )
            importances, _ = r.model.importances()
            if importances:
                self.catalogue.add_feature_history(feature_set_id, importances)
            records.append({"run_id": run_id, "model_type": r.model_type, "metrics": record})
        self.catalogue.append("training_runs", rows)
        return records

    def runs(self, project_id: int) -> DataFrame:
        self._project(project_id)
        return self.catalogue.runs(project_id)

    def run_progress(self, project_id: int, run_id: int) -> dict:
        self._project(project_id)
        row = self.catalogue.run(project_id, run_id).first()
        if row is None:
            raise LookupError(f"Run {run_id} not found in project {project_id}.")
        return row.asDict(recursive=True)

    # Comparison and analysis

    def _run_table(self, project_id: int) -> DataFrame:
        self._project(project_id)
        runs = self.catalogue.read("training_runs").where(F.col("project_id") == project_id)
        if runs.isEmpty():
            raise LookupError(f"No training runs found for project {project_id}.")
        return runs.withColumnRenamed("id", "run_id")

    def comparison(self, project_id: int, metric: str = "accuracy") -> dict:
        return {"project_id": project_id, **compare.compare_runs(self._run_table(project_id), metric)}

    def best_model(self, project_id: int, metric: str = "accuracy") -> dict:
        found = compare.find_best_model(self._run_table(project_id), metric)
        best = found["best_run"]
        n = sum(map(sum, best["confusion_matrix"] or []))
        value = best["metric_value"]
        if value is not None and n and 0.0 <= value <= 1.0:
            lower, upper = wilson_interval(value, n)
            found["confidence_interval_95"] = {"lower": lower, "upper": upper}
        return {"project_id": project_id, **found}

    def run_analysis(self, project_id: int, run_id: int, n: int = 10) -> dict:
        """Score the held-out rows of a run again, with its own split, means and scaler, and analyse the errors."""
        run = self.run_progress(project_id, run_id)
        details = json.loads(run["details"])
        target, keys = details["target"], details["key"]
        model = models.load_model(details["model_path"])
        _, spec = self._feature_set(project_id, run["feature_set_id"])
        built, features, _ = self._prepared(project_id, spec, target, keys, details["order_by"] or None)
        _, test = split(
            built, keys, details["test_size"], details["random_state"], target if details["stratify"] else None
        )
        test = fill_with(test.where(col(target).isNotNull()), details["means"])
        scaled = Scaler.from_dict(details["scaler"]).transform(test, features)
        scored = durable(model.transform(scaled))
        importances, method = model.importances()
        response = {"run_id": run_id, "model_type": run["model_type"], "task": model.task, "n_test_samples": scored.count()}
        if model.task == "classification":
            cells = confusion_counts(scored, target, "prediction")
            response["confusion_matrix_analysis"] = analysis.confusion_matrix_analysis(cells)
        else:
            response["residual_analysis"] = analysis.residual_analysis(scored, target, "prediction", keys, n)
        response["error_examples"] = analysis.error_examples(scored, target, "prediction", keys, features, n, model.task)
        response["feature_importance"] = analysis.importance_summary(importances, method)
        return response

    # Experiments

    def experiments(self, project_id: int) -> dict:
        project = self._project(project_id)
        experiment = self.log.get_or_create_experiment(project_id, project["name"])
        return {"project_id": project_id, **self.log.summary(experiment)}

    def best_logged_run(self, project_id: int, metric: str = "accuracy", higher_is_better: bool | None = None) -> dict:
        project = self._project(project_id)
        experiment = self.log.get_or_create_experiment(project_id, project["name"])
        higher = metric not in compare.LOWER_IS_BETTER if higher_is_better is None else higher_is_better
        best = self.log.get_best_run(experiment, metric, higher)
        if best is None:
            raise LookupError(f"No runs logged for project {project_id}.")
        return {"project_id": project_id, "metric": metric, "best_run": best}

    # Lookups

    def _project(self, project_id: int) -> dict:
        row = self.catalogue.read("projects").where(F.col("id") == project_id).first()
        if row is None:
            raise LookupError(f"Project {project_id} not found.")
        return row.asDict()

    def _feature_set(self, project_id: int, feature_set_id: int) -> tuple[str, dict]:
        row = (
            self.catalogue.read("feature_sets")
            .where((F.col("id") == feature_set_id) & (F.col("project_id") == project_id))
            .first()
        )
        if row is None:
            raise LookupError(f"Feature set {feature_set_id} not found in project {project_id}.")
        return row["name"], json.loads(row["features_list"])
