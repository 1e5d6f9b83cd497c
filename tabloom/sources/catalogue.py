"""Project catalogue: projects, datasets, feature sets, training runs, feature history."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.sources.tables import TableStore, utc_now

# The metrics that stand for a run, first present wins.
PRIMARY_METRICS = ("accuracy", "roc_auc", "f1", "r2")


class Catalogue(TableStore):
    """Catalogue tables under one root."""

    SCHEMAS = {
        "projects": "id long, name string, description string, created_at timestamp_ntz",
        "datasets": "id long, project_id long, dataset_path string, created_at timestamp_ntz",
        "feature_sets": "id long, project_id long, name string, features_list string, created_at timestamp_ntz",
        "training_runs": (
            "id long, project_id long, feature_set_id long, model_type string, status string, "
            "metrics map<string,double>, confusion_matrix array<array<long>>, details string, created_at timestamp_ntz"
        ),
        "feature_history": "id long, feature_set_id long, feature_name string, importance_score double",
    }

    def create_project(self, name: str, description: str | None = None) -> dict:
        row = (self.next_id("projects"), name, description, utc_now())
        self.append("projects", [row])
        return dict(zip(("id", "name", "description", "created_at"), row))

    def attach_dataset(self, project_id: int, path: str) -> None:
        """The latest attachment is the project's dataset."""
        self.append("datasets", [(self.next_id("datasets"), project_id, path, utc_now())])

    def create_feature_set(self, project_id: int, name: str, spec: dict) -> dict:
        row = (self.next_id("feature_sets"), project_id, name, json.dumps(spec), utc_now())
        self.append("feature_sets", [row])
        return {
            "id": row[0],
            "project_id": project_id,
            "name": name,
            "feature_count": len(spec.get("features", [])),
            "created_at": row[4],
        }

    def add_feature_history(self, feature_set_id: int, importances: dict[str, float]) -> None:
        first = self.next_id("feature_history", len(importances))
        self.append(
            "feature_history",
            [(first + i, feature_set_id, f, float(v)) for i, (f, v) in enumerate(importances.items())],
        )

    def latest_datasets(self) -> DataFrame:
        return self.read("datasets").groupBy("project_id").agg(F.max_by("dataset_path", "id").alias("dataset_path"))

    def projects(self) -> DataFrame:
        return project_list(self.read("projects").join(self.latest_datasets(), F.col("id") == F.col("project_id"), "left").drop("project_id"), self.read("training_runs"))

    def feature_sets(self, project_id: int) -> DataFrame:
        return feature_set_list(self.read("feature_sets").where(F.col("project_id") == project_id))

    def runs(self, project_id: int) -> DataFrame:
        return run_list(self.read("training_runs").where(F.col("project_id") == project_id))

    def run(self, project_id: int, run_id: int) -> DataFrame:
        return run_detail(self.read("training_runs"), project_id, run_id)

    def feature_history(self, feature_name: str) -> DataFrame:
        return self.read("feature_history").where(F.col("feature_name") == feature_name)


def project_list(projects: DataFrame, runs: DataFrame, recent: int = 3) -> DataFrame:
    """Projects, newest first, with run count, best accuracy and the model types of the latest runs.

    Runs are aggregated per project before the join. The latest runs are cut per map task by the
    row-number filter, so a project with very many runs is no hot spot.
    """
    totals = runs.groupBy("project_id").agg(
        F.count("*").alias("run_count"),
        F.max(F.try_element_at("metrics", F.lit("accuracy"))).alias("best_accuracy"),
    )
    latest = Window.partitionBy("project_id").orderBy(F.desc("id"))
    types = (
        runs.select("project_id", "id", "model_type")
        .withColumn("_n", F.row_number().over(latest))
        .where(F.col("_n") <= recent)
        .groupBy("project_id")
        .agg(F.array_sort(F.collect_set("model_type")).alias("recent_model_types"))
    )
    joined = (
        projects.join(totals, projects["id"] == totals["project_id"], "left")
        .drop("project_id")
        .join(types, projects["id"] == types["project_id"], "left")
        .drop("project_id")
    )
    return joined.withColumns(
        {
            "run_count": F.coalesce("run_count", F.lit(0)),
            "recent_model_types": F.coalesce("recent_model_types", F.array().cast("array<string>")),
        }
    ).orderBy(F.desc("created_at"), F.desc("id"))


def feature_set_list(feature_sets: DataFrame) -> DataFrame:
    """Feature sets with the number of features in their JSON spec."""
    features = F.from_json("features_list", "features array<struct<name:string>>")["features"]
    return feature_sets.select("id", "name", F.coalesce(F.size(features), F.lit(0)).alias("feature_count"), "created_at")


def primary_metric(metrics: Column) -> tuple[Column, Column]:
    """Name and value of the first primary metric a run has."""
    name, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for m in reversed(PRIMARY_METRICS):
        found = F.try_element_at(metrics, F.lit(m))
        name, value = F.when(found.isNotNull(), F.lit(m)).otherwise(name), F.coalesce(found, value)
    return name, value


def run_list(runs: DataFrame) -> DataFrame:
    """Runs, newest first, with status and primary metric."""
    name, value = primary_metric(F.col("metrics"))
    return runs.select(
        F.col("id").alias("run_id"),
        "model_type",
        "feature_set_id",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        name.alias("primary_metric"),
        value.alias("primary_value"),
        F.try_element_at("metrics", F.lit("training_time_s")).alias("training_time_s"),
        "created_at",
    ).orderBy(F.desc("created_at"), F.desc("run_id"))


def run_detail(runs: DataFrame, project_id: int, run_id: int) -> DataFrame:
    return runs.where((F.col("project_id") == project_id) & (F.col("id") == run_id))


def accuracy_table(runs: DataFrame, metrics: Sequence[str] = ("accuracy", "f1", "roc_auc")) -> DataFrame:
    """Scores in percent and training time per run, for plotting accuracy against time."""
    return runs.select(
        "run_id",
        F.translate("model_type", "_", " ").alias("name"),
        F.coalesce(F.try_element_at("metrics", F.lit("training_time_s")), F.lit(0.0)).alias("training_time_s"),
        *[F.round(F.try_element_at("metrics", F.lit(m)) * 100, 1).alias(f"{m}_pct") for m in metrics],
    )
