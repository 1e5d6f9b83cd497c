"""The training workflow: load, fill, engineer, select, split, scale, train, compare."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.functions.columns import as_list, col, numeric_columns
from tabloom.operators.clean import handle_missing_values
from tabloom.operators.compare import compare_runs
from tabloom.operators.models import TrainResult, train_multiple
from tabloom.operators.prepare import mean_impute, split
from tabloom.operators.profile import dataset_statistics
from tabloom.operators.scaler import Scaler
from tabloom.operators.selection import statistical_selection, variance_threshold
from tabloom.plans.spec import build_feature_set
from tabloom.session import durable
from tabloom.sources.readers import load_dataset
from tabloom.sources.tracking import RunLog

RUN_SCHEMA = "run_id long, model_type string, metrics map<string,double>, confusion_matrix array<array<long>>"


def _default_models() -> list[dict]:
    return [{"type": t, "hyperparams": {}} for t in ("logistic_regression", "random_forest", "xgboost")]


@dataclass
class WorkflowConfig:
    """Settings of one workflow run. ``key`` names the columns that identify a row.

    Fills and feature selection see training rows only, unless ``full_data`` is set.
    """

    dataset_path: str
    target_col: str
    key: str | list[str] | None = None
    order_by: str | list[str] | None = None
    task: str = "classification"
    feature_spec: dict = field(default_factory=dict)
    models: list[dict] = field(default_factory=_default_models)
    missing_strategy: str = "mean"
    fill_value: int | float | str | None = None
    variance_threshold: float = 0.01
    correlation_threshold: float = 0.02
    test_size: float = 0.2
    random_state: int = 42
    profile: bool = True
    full_data: bool = False
    run_log_path: str | None = None
    project_id: int = 0
    experiment_name: str = "workflow"


@dataclass
class WorkflowResult:
    config: WorkflowConfig
    data_stats: dict
    selected_features: list[str]
    train_results: list[TrainResult]
    comparison: dict
    timings: dict[str, float]
    train_rows: int
    test_rows: int

    @property
    def report(self) -> str:
        return report(self)


def run_workflow(spark: SparkSession, config: WorkflowConfig, dataset: DataFrame | None = None) -> WorkflowResult:
    """Run all steps and return models, comparison and timings.

    Without a key one is derived from all columns, so equal rows fall on the same side of the split.
    """
    timings: dict[str, float] = {}
    clock = time.perf_counter()

    def done(step: str) -> None:
        nonlocal clock
        now = time.perf_counter()
        timings[step], clock = now - clock, now

    df = load_dataset(spark, config.dataset_path) if dataset is None else dataset
    stats = dataset_statistics(df) if config.profile else {}
    done("load")

    target, keys = config.target_col, as_list(config.key)
    if not keys:
        df = df.withColumn("_row_key", F.sha2(F.to_json(F.struct(*map(col, df.columns))), 256))
        keys = ["_row_key"]
    reserved = [target, *keys]
    df = _marked(df, target, keys, config)
    df = handle_missing_values(
        df,
        config.missing_strategy,
        numeric_columns(df, exclude=reserved),
        config.fill_value,
        order_by=config.order_by,
        fit_on=_fitting(df, config),
    )
    done("preprocess")

    if config.feature_spec.get("features"):
        df = build_feature_set(df, config.feature_spec, order_by=config.order_by)
    done("feature_engineering")

    # From here on the engineered table is read several times: write it once.
    candidates = numeric_columns(df, exclude=reserved)
    table = durable(df.select(*map(col, dict.fromkeys([*keys, *candidates, target, IN_TEST]))))
    fitting = _fitting(table, config).drop(IN_TEST)
    varying = variance_threshold(fitting, config.variance_threshold, exclude=reserved).selected
    scores = _scored(fitting, target, config, exclude=[*keys, *[c for c in candidates if c not in varying]])
    selected = scores or varying or candidates
    done("feature_selection")

    train, test = (table.where(side).drop(IN_TEST) for side in (f"not {IN_TEST}", IN_TEST))
    train, test = mean_impute(train, test, selected, config.full_data)
    scaler = Scaler("standard").fit(train, selected)
    train, test = scaler.transform(train), scaler.transform(test)
    done("split_scale")

    results = train_multiple(train, selected, target, config.models, test, config.task)
    if config.run_log_path:
        log = RunLog(spark, config.run_log_path)
        experiment = log.get_or_create_experiment(config.project_id, config.experiment_name)
        for r in results:
            r.tracking_run_id = log.log_run(r, experiment, config.experiment_name, config.project_id)
    done("training")

    primary = "accuracy" if config.task == "classification" else "r2"
    comparison = compare_runs(run_table(spark, results), primary)
    done("compare")
    return WorkflowResult(config, stats, selected, results, comparison, timings, train.count(), test.count())


IN_TEST = "_in_test"
"""True for test rows, false for training rows, null for rows without a target."""


def _marked(df: DataFrame, target: str, keys: list[str], config: WorkflowConfig) -> DataFrame:
    """All rows with their side of the split, which depends on keys and classes alone."""
    stratify = target if config.task == "classification" else None
    train, test = split(df.where(col(target).isNotNull()), keys, config.test_size, config.random_state, stratify)
    sides = [(train, F.lit(False)), (test, F.lit(True)), (df.where(col(target).isNull()), F.lit(None).cast("boolean"))]
    return reduce(DataFrame.unionByName, [rows.withColumn(IN_TEST, side) for rows, side in sides])


def _fitting(df: DataFrame, config: WorkflowConfig) -> DataFrame:
    """The rows that fitted values may come from."""
    return df if config.full_data else df.where(f"not {IN_TEST}")


def _scored(table: DataFrame, target: str, config: WorkflowConfig, exclude: list[str]) -> list[str]:
    """Columns correlated with the target; text classes are compared by their index."""
    if target not in numeric_columns(table):
        from tabloom.operators.encode import label_encode

        table = label_encode(table, target)
    return statistical_selection(
        table, target, "correlation", config.correlation_threshold, exclude=exclude
    ).selected


def run_table(spark: SparkSession, results: list[TrainResult], first_id: int = 0) -> DataFrame:
    """Training results as a run table for the comparison functions."""
    rows = []
    for i, r in enumerate(results):
        numbers = {k: float(v) for k, v in r.metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        numbers["training_time_s"] = r.training_time_s
        rows.append((first_id + i, r.model_type, numbers, r.metrics.get("confusion_matrix")))
    return spark.createDataFrame(rows, RUN_SCHEMA)


def report(result: WorkflowResult) -> str:
    """A plain-text summary."""
    primary = result.comparison["primary_metric"]
    best = result.comparison.get("winner", {})
    shape = result.data_stats.get("shape", {})
    lines = [
        f"Dataset   {result.config.dataset_path}",
        f"Target    {result.config.target_col} ({result.config.task})",
        f"Size      {shape.get('rows', '?')} rows, {shape.get('columns', '?')} columns",
        f"Split     {result.train_rows} train, {result.test_rows} test",
        f"Features  {len(result.selected_features)}: {', '.join(result.selected_features[:10])}",
        "",
        f"{'model':<22}{primary:>10}{'seconds':>10}",
    ]
    for r in result.train_results:
        lines.append(f"{r.model_type:<22}{r.metrics.get(primary) or 0:>10.4f}{r.training_time_s:>10.2f}")
    lines += ["", f"Winner    {best.get('model_type', 'none')}, margin {best.get('margin_over_second', 0):.4f}", ""]
    lines += [f"{step:<22}{seconds:>10.3f}s" for step, seconds in result.timings.items()]
    return "\n".join(lines)
