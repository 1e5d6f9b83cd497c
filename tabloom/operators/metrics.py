"""Evaluation of predictions held in a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.columns import as_list, col, number
from tabloom.functions.ordering import running_totals
from tabloom.functions.stats import sample_skewness, zero_to_null
from tabloom.functions.tails import normal_quantile

MATRIX_CLASSES = 1_000
"""Most labels of which ``evaluate_classification`` builds the full matrix; ``confusion_counts`` has no bound."""


def confusion_counts(df: DataFrame, y_true: str, y_pred: str, by: str | Sequence[str] = ()) -> DataFrame:
    """Rows ``(…by, y_true, y_pred, n)`` of the cells that occur; the only pass over the predictions."""
    return df.groupBy(*map(col, as_list(by)), col(y_true).alias("y_true"), col(y_pred).alias("y_pred")).agg(
        F.count("*").alias("n")
    )


def label_counts(cells: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Per label ``support``, ``predicted`` and ``correct``, over the union of true and predicted labels."""
    one = F.struct(
        F.col("y_true").alias("label"),
        F.col("n").alias("support"),
        F.lit(0).cast("long").alias("predicted"),
        F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0)).alias("correct"),
    )
    two = F.struct(
        F.col("y_pred").cast(cells.schema["y_true"].dataType).alias("label"),
        F.lit(0).cast("long").alias("support"),
        F.col("n").alias("predicted"),
        F.lit(0).cast("long").alias("correct"),
    )
    groups = as_list(by)
    return (
        cells.select(*groups, F.explode(F.array(one, two)).alias("e"))
        .select(*groups, "e.*")
        .groupBy(*groups, "label")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("correct").alias("correct"))
    )


def per_class_metrics(cells: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; an undefined ratio is 0."""
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    counts = label_counts(cells, by)
    return counts.select(
        *as_list(by),
        "label",
        ratio(F.col("correct"), F.col("predicted")).alias("precision"),
        ratio(F.col("correct"), F.col("support")).alias("recall"),
        ratio(2 * F.col("correct"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "correct",
    )


def _is_label(label: Column, kind: T.DataType, value) -> Column:
    return label == (F.lit(value).cast("double") if isinstance(kind, T.NumericType) else F.lit(str(value)))


def classification_summary(cells: DataFrame, positive=1, by: str | Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1, number of true classes and class-imbalance ratio.

    Two true classes are scored on the ``positive`` one; otherwise classes are weighted by support.
    """
    groups = as_list(by)
    per_class = per_class_metrics(cells, groups)
    hit = _is_label(F.col("label"), cells.schema["y_true"].dataType, positive)
    rows = F.sum("support")
    binary = F.count_if(F.col("support") > 0) == 2

    def average(name: str) -> Column:
        weighted = F.sum(F.col(name) * F.col("support")) / F.nullif(rows, F.lit(0))
        return F.when(binary, F.max(F.when(hit, F.col(name)))).otherwise(weighted).alias(name)

    smallest = F.min("support")
    return per_class.groupBy(*groups).agg(
        (F.sum("correct") / F.nullif(rows, F.lit(0))).alias("accuracy"),
        average("precision"),
        average("recall"),
        average("f1"),
        F.count_if(F.col("support") > 0).alias("n_classes"),
        rows.alias("n_rows"),
        F.round(F.max("support") / F.when(smallest > 0, smallest).otherwise(F.lit(1)), 2).alias("class_imbalance_ratio"),
    )


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """All cells over the union of labels, empty ones as 0: the square of the class count, for few classes only."""
    kind = cells.schema["y_true"].dataType
    labels = cells.select(F.explode(F.array("y_true", F.col("y_pred").cast(kind))).alias("label")).agg(
        F.array_sort(F.collect_set("label")).alias("labels")
    )
    grid = labels.select(F.explode("labels").alias("y_true"), "labels").select(
        "y_true", F.explode("labels").alias("y_pred")
    )
    known = cells.select("y_true", F.col("y_pred").cast(kind).alias("y_pred"), "n")
    return grid.join(known, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def _auc(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve from positives and negatives per score.

    Each positive counts the negatives below its score and half of those at its score; the running
    count of negatives is taken over range-sorted distinct scores.
    """
    running = running_totals(counts, "score", {"upto": "neg"}, by)
    below = F.col("pos").cast("double") * (F.col("upto") - F.col("neg") / 2.0)
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return running.groupBy(*by).agg((F.sum(below) / zero_to_null(pairs)).alias("roc_auc"), F.sum("pos").alias("pos"))


def roc_auc(df: DataFrame, y_true: str, score: str, positive=1, by: str | Sequence[str] = ()) -> DataFrame:
    """One row (per ``by`` group) with ``roc_auc``; NULL when only one class occurs."""
    hit = _is_label(col(y_true), df.schema[y_true].dataType, positive)
    groups = as_list(by)
    counts = df.where(number(score).isNotNull()).groupBy(*map(col, groups), number(score).alias("score")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )
    return _auc(counts, groups).drop("pos")


def roc_auc_ovr(df: DataFrame, y_true: str, probability: str, classes: Sequence) -> DataFrame:
    """Support-weighted mean of one-vs-rest areas; ``probability`` is an array in the order of ``classes``."""
    kind = df.schema[y_true].dataType
    truth = F.lit(None).cast("int")
    for i, c in enumerate(classes):
        truth = F.when(_is_label(col(y_true), kind, c), F.lit(i)).otherwise(truth)
    counts = (
        df.select(truth.alias("t"), F.posexplode(col(probability)).alias("class", "score"))
        .groupBy("class", "score")
        .agg(F.count_if(F.col("t") == F.col("class")).alias("pos"), F.count_if(F.col("t") != F.col("class")).alias("neg"))
    )
    per_class = _auc(counts, ["class"])
    return per_class.agg(
        F.when(
            F.count("roc_auc") == F.count("*"),
            F.sum(F.col("roc_auc") * F.col("pos")) / zero_to_null(F.sum("pos").cast("double")),
        ).alias("roc_auc")
    )


def regression_metrics(df: DataFrame, y_true: str, y_pred: str, by: str | Sequence[str] = ()) -> DataFrame:
    """R², MAE, RMSE, MAPE (rows with a non-zero truth) and residual statistics in one aggregation."""
    y, r = number(y_true), number(y_true) - number(y_pred)
    table = df.select(*map(col, as_list(by)), y.alias("y"), r.alias("r")).where("r IS NOT NULL")
    y, r = F.col("y"), F.col("r")
    spread, error = F.var_pop(y) * F.count(y), F.sum(r * r)
    return table.groupBy(*map(col, as_list(by))).agg(
        F.when(spread > 0, 1 - error / zero_to_null(spread))
        .otherwise(F.when(error == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .alias("r2"),
        F.avg(F.abs(r)).alias("mae"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
        (F.avg(F.abs(r / zero_to_null(y))) * 100).alias("mape"),
        F.avg(r).alias("residual_mean"),
        F.stddev_pop(r).alias("residual_std"),
        F.min(r).alias("residual_min"),
        F.max(r).alias("residual_max"),
        sample_skewness(r).alias("residual_skew"),
    )


def evaluate_classification(
    df: DataFrame,
    y_true: str,
    y_pred: str,
    score: str | None = None,
    probability: str | None = None,
    classes: Sequence | None = None,
    positive=1,
) -> dict:
    """All classification results as one dictionary; its size is the square of the class count."""
    cells = confusion_counts(df, y_true, y_pred)
    # Counted before anything is collected: few cells may still hold many labels.
    kind = df.schema[y_true].dataType
    labels = cells.select(F.explode(F.array("y_true", F.col("y_pred").cast(kind))).alias("label")).distinct()
    if labels.limit(MATRIX_CLASSES + 1).count() > MATRIX_CLASSES:
        raise ValueError(f"'{y_true}' and '{y_pred}' have more than {MATRIX_CLASSES} labels; use confusion_counts.")
    found = cells.collect()
    collected = df.sparkSession.createDataFrame(found, cells.schema)
    summary = classification_summary(collected, positive).first()
    if summary["n_classes"] == 2 and summary["precision"] is None:
        raise ValueError(f"The positive class {positive!r} does not occur; pass positive=.")
    metrics = {k: round(summary[k], 4) for k in ("accuracy", "precision", "recall", "f1")}
    if score is not None and summary["n_classes"] == 2:
        area = roc_auc(df, y_true, score, positive).first()["roc_auc"]
    elif probability is not None and classes is not None and summary["n_classes"] > 2:
        area = roc_auc_ovr(df, y_true, probability, classes).first()["roc_auc"]
    else:
        area = None
    if area is not None:
        metrics["roc_auc"] = round(area, 4)
    matrix = confusion_matrix(collected).orderBy("y_true", "y_pred").collect()
    labels = list(dict.fromkeys(r["y_true"] for r in matrix))
    size = len(labels)
    metrics["labels"] = labels
    metrics["confusion_matrix"] = [[r["n"] for r in matrix[i * size : (i + 1) * size]] for i in range(size)]
    metrics["per_class"] = {
        str(r["label"]): {
            "precision": round(r["precision"], 4),
            "recall": round(r["recall"], 4),
            "f1": round(r["f1"], 4),
            "support": r["support"],
        }
        for r in per_class_metrics(collected).orderBy("label").collect()
    }
    metrics["class_imbalance_ratio"] = summary["class_imbalance_ratio"]
    return metrics


def evaluate_regression(df: DataFrame, y_true: str, y_pred: str) -> dict:
    """R², MAE, RMSE, MAPE and the residual summary as one dictionary."""
    row = regression_metrics(df, y_true, y_pred).first()
    value = lambda k: None if row is None or row[k] is None else round(row[k], 4)
    return {k: value(k) for k in ("r2", "mae", "rmse", "mape")} | {
        "residuals": {k: value(f"residual_{k}") for k in ("mean", "std", "min", "max", "skew")}
    }


def evaluate_predictions(df: DataFrame, y_true: str, y_pred: str, task: str = "classification", **scores) -> dict:
    """Evaluate by task; probability columns are optional."""
    if task == "classification":
        return evaluate_classification(df, y_true, y_pred, **scores)
    return evaluate_regression(df, y_true, y_pred)


def wilson_bounds(value: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion, clamped to [0, 1]."""
    z = normal_quantile((1 + confidence) / 2)
    size = zero_to_null(n.cast("double"))
    scale = 1 + z * z / size
    centre = (value + z * z / (2 * size)) / scale
    half = z * F.sqrt(value * (1 - value) / size + z * z / (4 * size * size)) / scale
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def wilson_interval(value: float, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """The same interval for one number, rounded to four digits."""
    z = normal_quantile((1 + confidence) / 2)
    scale = 1 + z * z / n
    centre = (value + z * z / (2 * n)) / scale
    half = z * (value * (1 - value) / n + z * z / (4 * n * n)) ** 0.5 / scale
    return round(max(0.0, centre - half), 4), round(min(1.0, centre + half), 4)
