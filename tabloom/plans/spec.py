"""Feature sets from a declarative spec.

A spec is ``{"features": [{"name": …, "source": …, …}, …]}``. A feature may use columns made by
earlier ones. Features that do not depend on each other form one layer: the statistics a layer needs
(bin edges, group tables, category codes) are fitted together, its windows share one sort, and its
row-wise expressions become one projection.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.buckets import add_interval_labels
from tabloom.functions.columns import as_list, col, number
from tabloom.functions.ordering import GROUP_ROWS, over_neighbours
from tabloom.functions.stats import log1p_floor, ratio
from tabloom.operators.encode import label_encode
from tabloom.operators.features import (
    as_timestamp,
    bin_edges,
    join_group_statistics,
    power,
    product,
    time_part,
    window_aggregate,
)

# The fields each source requires besides "name" and "source".
REQUIRED_FIELDS = {
    "raw": [],
    "polynomial": ["base"],
    "interaction": ["operands"],
    "lag": ["base"],
    "rolling": ["base"],
    "encoding": ["base"],
    "time": ["base", "component"],
    "binning": ["base"],
    "statistical": ["base", "group"],
    "log": ["base"],
    "ratio": ["numerator", "denominator"],
}

ROW_SOURCES: dict[str, Callable[[DataFrame, dict], Column]] = {
    "polynomial": lambda df, f: power(f["base"], f.get("degree", 2)),
    "interaction": lambda df, f: product(f["operands"]),
    "time": lambda df, f: time_part(as_timestamp(df, f["base"]), f["component"]),
    "log": lambda df, f: log1p_floor(number(f["base"])),
    "ratio": lambda df, f: ratio(number(f["numerator"]), number(f["denominator"])),
}
"""Sources computed from one row alone; add an entry (and its required fields) for a new one."""


def _lacking(feature: dict) -> list[str]:
    """What one entry needs and doesn't have."""
    source = feature.get("source")
    if source not in REQUIRED_FIELDS:
        return [f"unknown source {source!r}, expected one of {sorted(REQUIRED_FIELDS)}"]
    return [f"{source} needs '{field}'" for field in ("name", *REQUIRED_FIELDS[source]) if field not in feature]


def validate_feature_definitions(spec: dict) -> list[str]:
    """Everything wrong with the spec itself, whatever the table; empty when it is valid."""
    entries = spec.get("features")
    if not isinstance(entries, list):
        return ["A spec holds its features as a list under 'features'."]
    mappings = [f for f in entries if isinstance(f, dict)]
    uses = Counter(f["name"] for f in mappings if "name" in f)
    problems = [f"Duplicate name {name!r}, given {n} times." for name, n in uses.items() if n > 1]
    for place, feature in enumerate(entries, 1):
        if isinstance(feature, dict):
            problems += [f"Feature {place} ({feature.get('name', 'unnamed')}): {x}." for x in _lacking(feature)]
        else:
            problems.append(f"Feature {place} is a {type(feature).__name__}, not a mapping.")
    return problems


def inputs(feature: dict) -> list[str]:
    """Columns a feature reads."""
    source = feature["source"]
    if source == "raw":
        return [feature["name"]]
    if source == "interaction":
        return list(feature["operands"])
    if source == "ratio":
        return [feature["numerator"], feature["denominator"]]
    return [feature["base"], *as_list(feature.get("group") if source == "statistical" else None)]


@dataclass
class _Layer:
    row_wise: list[dict]
    binned: list[dict]
    windowed: list[dict]
    encoded: list[dict]
    grouped: list[dict]


def _layers(features: Sequence[dict], columns: Sequence[str]) -> list[_Layer]:
    """Earliest layer for each feature such that it sees exactly what spec order would show it."""
    known = set(columns)
    written: dict[str, int] = {}
    read: dict[str, int] = {}
    placed: dict[int, list[dict]] = {}
    for f in features:
        source, name = f.get("source"), f["name"]
        if source not in REQUIRED_FIELDS:
            raise ValueError(f"Unknown feature source: '{source}'.")
        needed = inputs(f)
        for c in needed:
            if c not in known:
                raise KeyError(f"Feature '{name}' (source='{source}') references missing column '{c}'.")
        if source == "raw":
            continue
        layer = max([written.get(c, -1) + 1 for c in needed] + [read.get(name, 0), written.get(name, -1) + 1])
        for c in needed:
            read[c] = max(read.get(c, 0), layer)
        written[name] = layer
        known.add(name)
        placed.setdefault(layer, []).append(f)

    def of(members: list[dict], *sources: str) -> list[dict]:
        return [f for f in members if f["source"] in sources]

    return [
        _Layer(
            of(placed[i], *ROW_SOURCES),
            of(placed[i], "binning"),
            of(placed[i], "lag", "rolling"),
            of(placed[i], "encoding"),
            of(placed[i], "statistical"),
        )
        for i in sorted(placed)
    ]


def build_feature_set(
    df: DataFrame,
    spec: dict,
    order_by: str | Sequence[str] | None = None,
    partition_by: str | Sequence[str] | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Apply a spec; engineered columns follow the originals in spec order.

    Lag and rolling features need ``order_by``. A missing column raises KeyError naming the feature.
    """
    features = spec.get("features", [])
    result = df
    for layer in _layers(features, df.columns):
        result = _apply(result, layer, order_by, partition_by, group_rows)
    names = [f["name"] for f in features]
    new = [n for n in dict.fromkeys(names) if n not in df.columns]
    return result.select(*map(col, [*df.columns, *new]))


def _temporary(feature: dict) -> str:
    return f"_new_{feature['name']}"


def _apply(df: DataFrame, layer: _Layer, order_by, partition_by, group_rows: int) -> DataFrame:
    # All members read the columns as they were before the layer, so results go to temporary names.
    result = df
    added: dict[str, Column] = {_temporary(f): ROW_SOURCES[f["source"]](df, f) for f in layer.row_wise}
    if layer.binned:
        requests = [(f["base"], _strategy(f), f.get("bins", 10)) for f in layer.binned]
        labels = {_temporary(f): (number(f["base"]), e) for f, e in zip(layer.binned, bin_edges(df, requests))}
        result = add_interval_labels(result, labels)
    if added:
        result = result.withColumns(added)
    by_group: dict[tuple[str, ...], dict[str, tuple[str, str]]] = {}
    for f in layer.grouped:
        wanted = by_group.setdefault(tuple(as_list(f["group"])), {})
        wanted[_temporary(f)] = (f["base"], f.get("agg", "mean"))
    for groups, wanted in by_group.items():
        result = join_group_statistics(result, groups, wanted)
    for f in layer.encoded:
        if f.get("method", "label") != "label":
            raise ValueError(f"Feature '{f['name']}': encoding method '{f['method']}' is not supported, use 'label'.")
        suffix = "_spec_code"
        result = label_encode(result, f["base"], suffix=suffix).withColumnRenamed(f["base"] + suffix, _temporary(f))
    if layer.windowed:
        if not order_by:
            raise ValueError("Lag and rolling features need order_by: rows have no order of their own.")
        steps = [f.get("lag", 1) for f in layer.windowed if f["source"] == "lag"]
        sizes = [f.get("window", 7) for f in layer.windowed if f["source"] == "rolling"]
        result = over_neighbours(
            result,
            lambda w: {_temporary(f): _windowed(f, w) for f in layer.windowed},
            order_by,
            partition_by,
            before=max([0, *steps, *[n - 1 for n in sizes]]),
            after=max([0, *[-n for n in steps]]),
            group_rows=group_rows,
        )
    members = [*layer.row_wise, *layer.binned, *layer.grouped, *layer.encoded, *layer.windowed]
    names = {f["name"]: _temporary(f) for f in members}
    kept = [col(names.get(c, c)).alias(c) for c in df.columns]
    return result.select(*kept, *[col(t).alias(n) for n, t in names.items() if n not in df.columns])


def _strategy(feature: dict) -> str:
    """Any strategy but 'quantile' means equal width."""
    return "quantile" if feature.get("strategy", "uniform") == "quantile" else "uniform"


def _windowed(feature: dict, window: Any) -> Column:
    if feature["source"] == "lag":
        return F.lag(col(feature["base"]), feature.get("lag", 1)).over(window)
    return window_aggregate(feature["base"], window, feature.get("window", 7), feature.get("agg", "mean"))


def preview(
    df: DataFrame,
    spec: dict,
    rows: int = 5,
    order_by: str | Sequence[str] | None = None,
    partition_by: str | Sequence[str] | None = None,
) -> tuple[list[str], list[str], DataFrame]:
    """Original columns, engineered columns, and the first rows of the feature set."""
    built = build_feature_set(df, spec, order_by, partition_by)
    ordered = built.orderBy(*map(col, as_list(order_by))) if order_by else built
    return df.columns, [c for c in built.columns if c not in df.columns], ordered.limit(rows)
