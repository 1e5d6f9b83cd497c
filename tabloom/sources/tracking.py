"""Run log: experiments and runs with tags, parameters and metrics."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tabloom.sources.tables import TableStore, utc_now

# Results that are not logged as metrics.
SKIPPED_METRICS = {
    "confusion_matrix",
    "per_class",
    "residuals",
    "woe",
    "status",
    "hyperparams",
    "model_path",
    "tracking_run_id",
    "task",
}


def experiment_name(project_id: int, project_name: str) -> str:
    return f"project_{project_id}_{project_name.replace(' ', '_').lower()}"


def scalar_metrics(metrics: dict[str, Any], training_time_s: float) -> dict[str, float]:
    """Numbers only: nested results, booleans and skipped keys are left out."""
    kept = {
        k: float(v)
        for k, v in metrics.items()
        if k not in SKIPPED_METRICS and isinstance(v, (int, float)) and not isinstance(v, bool)
    }
    return kept | {"training_time_s": float(training_time_s)}


class RunLog(TableStore):
    """Experiment and run tables under one root."""

    SCHEMAS = {
        "experiments": "experiment_id string, name string, tags map<string,string>, created_at timestamp_ntz",
        "logged_runs": (
            "run_id string, experiment_id string, run_name string, status string, start_time timestamp_ntz, "
            "tags map<string,string>, params map<string,string>, metrics map<string,double>, artifact string"
        ),
    }

    def get_or_create_experiment(self, project_id: int, project_name: str) -> str:
        name = experiment_name(project_id, project_name)
        known = self.read("experiments").where(F.col("name") == name).select("experiment_id").first()
        if known:
            return known[0]
        experiment_id = uuid.uuid4().hex
        self.append("experiments", [(experiment_id, name, {"project_id": str(project_id)}, utc_now())])
        return experiment_id

    def get_experiment(self, experiment_id: str) -> dict | None:
        row = self.read("experiments").where(F.col("experiment_id") == experiment_id).first()
        return row.asDict(recursive=True) if row else None

    def log_run(
        self,
        result: Any,
        experiment_id: str,
        feature_set_name: str,
        project_id: int,
        catalogue_run_id: int | None = None,
    ) -> str:
        """Log a training result; returns the id of the logged run."""
        tags = {
            "project_id": str(project_id),
            "model_type": result.model_type,
            "feature_set": feature_set_name,
            "task": result.task,
        }
        if catalogue_run_id:
            tags["catalogue_run_id"] = str(catalogue_run_id)
        run_id = uuid.uuid4().hex
        self.append(
            "logged_runs",
            [
                (
                    run_id,
                    experiment_id,
                    f"{result.model_type}__{feature_set_name}",
                    "FINISHED",
                    utc_now(),
                    tags,
                    {k: str(v) for k, v in result.hyperparams.items()},
                    scalar_metrics(result.metrics, result.training_time_s),
                    result.model_path,
                )
            ],
        )
        return run_id

    def get_runs(
        self, experiment_id: str, metric: str = "accuracy", higher_is_better: bool = True, max_results: int = 100
    ) -> DataFrame:
        runs = self.read("logged_runs").where(F.col("experiment_id") == experiment_id)
        return runs_by_metric(runs, metric, higher_is_better, max_results)

    def get_best_run(self, experiment_id: str, metric: str = "accuracy", higher_is_better: bool = True) -> dict | None:
        row = self.get_runs(experiment_id, metric, higher_is_better, 1).first()
        return row.asDict(recursive=True) if row else None

    def get_run(self, run_id: str) -> dict | None:
        row = self.read("logged_runs").where(F.col("run_id") == run_id).first()
        return row.asDict(recursive=True) if row else None

    def summary(self, experiment_id: str, metric: str = "accuracy") -> dict:
        """Experiment, number of runs, the runs by metric, and the best one."""
        total = self.read("logged_runs").where(F.col("experiment_id") == experiment_id).count()
        return {
            "experiment": self.get_experiment(experiment_id),
            "total_runs": total,
            "runs": self.get_runs(experiment_id, metric),
            "best_run": self.get_best_run(experiment_id, metric),
        }


def runs_by_metric(runs: DataFrame, metric: str, higher_is_better: bool = True, max_results: int = 100) -> DataFrame:
    """Runs ordered by a metric, those without it last; a distributed top-n."""
    value = F.try_element_at("metrics", F.lit(metric))
    order = value.desc_nulls_last() if higher_is_better else value.asc_nulls_last()
    return runs.orderBy(order, "run_id").limit(max_results)
