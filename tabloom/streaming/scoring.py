"""Row-wise features, a fitted scaler and a fitted model on a streaming table.

Everything fitted is a literal or a model, so the stream keeps no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators.models import TrainedModel
from tabloom.operators.prepare import fill_with
from tabloom.operators.scaler import Scaler
from tabloom.plans.spec import ROW_SOURCES, build_feature_set


def stream_features(stream: DataFrame, spec: dict) -> DataFrame:
    """Apply a spec whose features are computed from one row alone."""
    other = [f["name"] for f in spec.get("features", []) if f["source"] not in {"raw", *ROW_SOURCES}]
    if other:
        raise ValueError(f"These features need statistics or neighbours and cannot run on a stream: {other}")
    return build_feature_set(stream, spec)


def score_stream(
    stream: DataFrame,
    model: TrainedModel | None = None,
    spec: dict | None = None,
    means: dict[str, float] | None = None,
    scaler: Scaler | None = None,
) -> DataFrame:
    """Features, then training means for missing values, then scaling, then predictions."""
    table = stream_features(stream, spec) if spec else stream
    table = fill_with(table, means or {})
    table = scaler.transform(table) if scaler else table
    return model.transform(table) if model else table


def write_stream(scored: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append scored rows to Parquet; restarts continue at ``checkpoint``."""
    writer = scored.writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
