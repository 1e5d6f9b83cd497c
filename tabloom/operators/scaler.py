"""Scaling fitted on one table and applied to others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import as_list, number, require_numeric
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.stats import log1p_floor

METHODS = ("standard", "minmax", "robust", "log")

# The names of the (centre, spread) parameters of each method in the JSON form.
PARAMETER_NAMES = {"standard": ("mean", "std"), "minmax": ("min", "max"), "robust": ("median", "iqr")}


class Scaler:
    """Fit statistics once, then transform any table (also a stream) with literal expressions."""

    def __init__(self, method: str = "standard") -> None:
        if method not in METHODS:
            raise ValueError(f"Unknown method '{method}'. Use one of {METHODS}.")
        self.method = method
        self.columns: list[str] = []
        self.params: dict[str, dict[str, float]] = {}
        self.is_fitted = False

    def fit(self, df: DataFrame, columns: str | Sequence[str]) -> "Scaler":
        """Learn the parameters of every column in one aggregation (quantiles in their own)."""
        names = as_list(columns)
        require_numeric(df, names)
        if self.method == "log":
            found = {c: {} for c in names}
        elif self.method == "robust":
            quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
            found = {c: {"median": q[1], "iqr": None if q[0] is None else q[2] - q[0]} for c, q in quartiles.items()}
        else:
            pair = (F.avg, F.stddev_samp) if self.method == "standard" else (F.min, F.max)
            row = df.agg(*[f(number(c)).alias(f"p{i}_{k}") for i, c in enumerate(names) for k, f in enumerate(pair)]).first()
            found = {
                c: {PARAMETER_NAMES[self.method][k]: row[f"p{i}_{k}"] for k in (0, 1)} for i, c in enumerate(names)
            }
        self.columns, self.params, self.is_fitted = names, found, True
        return self

    def _centre_and_spread(self, column: str) -> tuple[Column, Column]:
        p = self.params[column]
        first, second = (p[n] for n in PARAMETER_NAMES[self.method])
        spread = second
        if self.method == "minmax" and first is not None and second is not None:
            spread = second - first
        # No spread (a constant column) divides by one.
        return F.lit(first).cast("double"), F.lit(1.0 if spread == 0 else spread).cast("double")

    def _chosen(self, columns: str | Sequence[str] | None) -> list[str]:
        if not self.is_fitted:
            raise RuntimeError("The scaler is not fitted. Call fit() on training data first.")
        names = as_list(columns) or self.columns
        unknown = [c for c in names if c not in self.params]
        if unknown:
            raise KeyError(f"Columns not seen during fit: {unknown}")
        return names

    def transform(self, df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
        scaled = {}
        for c in self._chosen(columns):
            if self.method == "log":
                scaled[c] = log1p_floor(number(c))
            else:
                centre, spread = self._centre_and_spread(c)
                scaled[c] = (number(c) - centre) / spread
        return df.withColumns(scaled)

    def fit_transform(self, df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
        return self.fit(df, columns).transform(df)

    def inverse_transform(self, df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
        restored = {}
        for c in self._chosen(columns):
            if self.method == "log":
                restored[c] = F.expm1(number(c))
            else:
                centre, spread = self._centre_and_spread(c)
                restored[c] = number(c) * spread + centre
        return df.withColumns(restored)

    def to_dict(self) -> dict:
        self._chosen(None)
        return {"method": self.method, "columns": self.columns, "params": self.params}

    @classmethod
    def from_dict(cls, data: dict) -> "Scaler":
        scaler = cls(data["method"])
        scaler.columns, scaler.params, scaler.is_fitted = list(data["columns"]), dict(data["params"]), True
        return scaler

    def parameter_table(self, df: DataFrame) -> DataFrame:
        """The parameters as rows ``(column, stat, value)``."""
        rows = [(c, stat, value) for c, p in self.params.items() for stat, value in p.items()]
        return df.sparkSession.createDataFrame(rows, "column string, stat string, value double")


def _fitted(method: str, df: DataFrame, columns, train_df: DataFrame | None) -> tuple[DataFrame, Scaler]:
    scaler = Scaler(method).fit(df if train_df is None else train_df, columns)
    return scaler.transform(df), scaler


def standardize(df: DataFrame, columns, train_df: DataFrame | None = None) -> tuple[DataFrame, Scaler]:
    """Mean 0, standard deviation 1; pass ``train_df`` to fit on training rows only."""
    return _fitted("standard", df, columns, train_df)


def normalize(df: DataFrame, columns, train_df: DataFrame | None = None) -> tuple[DataFrame, Scaler]:
    """Range 0 to 1."""
    return _fitted("minmax", df, columns, train_df)


def robust_scaling(df: DataFrame, columns, train_df: DataFrame | None = None) -> tuple[DataFrame, Scaler]:
    """Centre on the median and divide by the interquartile range."""
    return _fitted("robust", df, columns, train_df)


def log_scaling(df: DataFrame, columns) -> tuple[DataFrame, Scaler]:
    """log(1 + max(x, 0)) in place; it has nothing to fit."""
    return _fitted("log", df, columns, None)
