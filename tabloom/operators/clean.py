"""Missing values, outliers, in-place scaling and duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.functions.columns import as_list, col, is_numeric, number, require_columns, require_numeric
from tabloom.functions.ordering import GROUP_ROWS, fill_from_neighbours
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.sketch import SKETCH, repeated_sketches, with_sketch

FILL_STRATEGIES = ("drop", "mean", "median", "mode", "forward_fill", "backward_fill", "constant")


def handle_missing_values(
    df: DataFrame,
    strategy: str = "mean",
    columns: Sequence[str] | None = None,
    fill_value: int | float | str | None = None,
    order_by: str | Sequence[str] | None = None,
    partition_by: str | Sequence[str] | None = None,
    group_rows: int = GROUP_ROWS,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Fill or drop missing values.

    Mean and median touch numeric columns only. Forward and backward fill need ``order_by``, and
    stay inside ``partition_by`` groups when given. Mean, median and mode are those of ``fit_on``,
    such as the training rows of ``df``; without it, of ``df``.
    """
    fitted = df if fit_on is None else fit_on
    names = as_list(columns) or df.columns
    require_columns(df, names)
    if strategy == "drop":
        return df.dropna(subset=names)
    if strategy == "mean":
        numeric = [c for c in names if is_numeric(df, c)]
        values = fitted.agg(*[F.avg(number(c)).alias(f"v{i}") for i, c in enumerate(numeric)]).first() if numeric else []
        return _fill_numbers(df, dict(zip(numeric, values)))
    if strategy == "median":
        numeric = [c for c in names if is_numeric(df, c)]
        return _fill_numbers(df, {c: q[0] for c, q in exact_quantiles(fitted, numeric, [0.5]).items()})
    if strategy == "mode":
        return _fill_literals(df, modes(fitted, names))
    if strategy in ("forward_fill", "backward_fill"):
        if not order_by:
            raise ValueError(f"strategy='{strategy}' needs order_by: rows have no order of their own.")
        return fill_from_neighbours(
            df, names, order_by, partition_by, forward=strategy == "forward_fill", group_rows=group_rows
        )
    if strategy == "constant":
        if fill_value is None:
            raise ValueError("strategy='constant' needs fill_value.")
        return _fill_literals(df, {c: fill_value for c in names})
    raise ValueError(f"Unknown strategy '{strategy}'. Use one of {FILL_STRATEGIES}.")


def _fill_numbers(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """A fractional fill turns an integer column into doubles."""
    filled = {c: F.coalesce(number(c), F.lit(float(v))) for c, v in values.items() if v is not None}
    return df.withColumns(filled) if filled else df


def _fill_literals(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    filled = {}
    for c, v in values.items():
        if v is None:
            continue
        kind = df.schema[c].dataType
        if isinstance(v, str) and isinstance(kind, T.NumericType):
            raise TypeError(f"Column '{c}' is numeric and cannot be filled with text.")
        if isinstance(v, float) and not v.is_integer() and isinstance(kind, T.IntegralType):
            kind = T.DoubleType()
        filled[c] = F.coalesce(col(c).cast(kind), F.lit(v).cast(kind))
    return df.withColumns(filled) if filled else df


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    """Most frequent non-null value per column, the smallest on a tie; None for an empty column.

    Counted per value, so no task holds all the values of a column. Columns of one type are counted together,
    so the number of passes is that of the types.
    """
    by_kind: dict[T.DataType, list[str]] = {}
    for name in as_list(columns):
        by_kind.setdefault(df.schema[name].dataType, []).append(name)
    found = {}
    for names in by_kind.values():
        cells = F.array(*[F.struct(F.lit(i).alias("i"), col(n).alias("v")) for i, n in enumerate(names)])
        counted = df.select(F.explode(cells).alias("e")).select("e.*").where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n"))
        tops = counted.groupBy("i").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v"))
        found |= {names[r["i"]]: r["v"] for r in tops.collect()}
    return {c: found.get(c) for c in as_list(columns)}


@dataclass
class Outliers:
    """Bounds and counts for one column; ``keys`` holds the key columns of the outlying rows."""

    column: str
    method: str
    lower_bound: float | None
    upper_bound: float | None
    outlier_count: int
    outlier_pct: float
    keys: DataFrame

    def to_dict(self) -> dict:
        return {
            "column": self.column,
            "method": self.method,
            "lower_bound": None if self.lower_bound is None else round(self.lower_bound, 4),
            "upper_bound": None if self.upper_bound is None else round(self.upper_bound, 4),
            "outlier_count": self.outlier_count,
            "outlier_pct": round(self.outlier_pct, 2),
        }


def outlier_bounds(df: DataFrame, column: str, method: str = "iqr") -> tuple[float | None, float | None]:
    require_numeric(df, [column])
    if method == "iqr":
        q1, q3 = exact_quantiles(df, column, [0.25, 0.75])[column]
        return (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    if method == "zscore":
        x = number(column)
        mean, std = df.agg(F.avg(x), F.stddev_samp(x)).first()
        return (None, None) if std is None else (mean - 3 * std, mean + 3 * std)
    raise ValueError(f"Unknown method '{method}'. Use 'iqr' or 'zscore'.")


def _outside(column: str, lower: float | None, upper: float | None) -> Column:
    """False, never NULL, for a missing value."""
    if lower is None or upper is None:
        return F.lit(False)
    return F.coalesce((number(column) < F.lit(lower)) | (number(column) > F.lit(upper)), F.lit(False))


def outlier_summary(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    """One row: bounds, count of outliers and their share of all rows in percent."""
    lower, upper = outlier_bounds(df, column, method)
    hit = F.count_if(_outside(column, lower, upper))
    return df.agg(
        F.lit(column).alias("column"),
        F.lit(lower).cast("double").alias("lower_bound"),
        F.lit(upper).cast("double").alias("upper_bound"),
        hit.alias("outlier_count"),
        (hit * 100.0 / F.nullif(F.count("*"), F.lit(0))).alias("outlier_pct"),
    )


def detect_outliers(df: DataFrame, column: str, method: str = "iqr", key: str | Sequence[str] = ()) -> Outliers:
    """Bounds and counts, and the keys of the outlying rows as a lazy DataFrame."""
    lower, upper = outlier_bounds(df, column, method)
    mask = _outside(column, lower, upper)
    rows, hits = df.agg(F.count("*"), F.count_if(mask)).first()
    return Outliers(
        column, method, lower, upper, hits, 100.0 * hits / rows if rows else 0.0,
        df.where(mask).select(*map(col, as_list(key) or df.columns)),
    )


def remove_outliers(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    """Drop outlying rows; rows with a missing value stay."""
    return df.where(~_outside(column, *outlier_bounds(df, column, method)))


def normalize_features(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """Scale columns in place by statistics of ``df``; a column without spread is only shifted."""
    names = as_list(columns)
    require_numeric(df, names)
    if method not in ("standard", "minmax", "robust"):
        raise ValueError(f"Unknown method '{method}'. Use 'standard', 'minmax', or 'robust'.")
    if method == "robust":
        shifts = {
            c: (q[1], None if q[0] is None else q[2] - q[0])
            for c, q in exact_quantiles(df, names, [0.25, 0.5, 0.75]).items()
        }
    else:
        aggs = []
        for i, c in enumerate(names):
            x = number(c)
            pair = (F.avg(x), F.stddev_samp(x)) if method == "standard" else (F.min(x), F.max(x) - F.min(x))
            aggs += [pair[0].alias(f"a{i}"), pair[1].alias(f"b{i}")]
        row = df.agg(*aggs).first()
        shifts = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(names)}
    scaled = {}
    for c, (shift, spread) in shifts.items():
        shift_, spread_ = F.lit(shift).cast("double"), F.lit(spread).cast("double")
        scaled[c] = number(c) - shift_ if spread == 0 else (number(c) - shift_) / spread_
    return df.withColumns(scaled)


def remove_duplicates(
    df: DataFrame,
    subset: str | Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: str | Sequence[str | Column] | None = None,
) -> DataFrame:
    """Keep the first, the last or (``keep=False``) none of the rows that agree on ``subset``.

    ``order_by`` says which row is first; whole-row duplicates need none. A group of any size is
    safe: only one row per group and map task reaches the shuffle. With ``keep=False`` rows meet by
    sketches, and only rows whose sketch repeats are grouped by their values.
    """
    names = as_list(subset) or df.columns
    require_columns(df, names)
    keys = [col(c) for c in names]
    if keep is False:
        sketched = with_sketch(df, keys)
        repeated = repeated_sketches(sketched)
        # Rows of equal sketches that differ after all are kept too.
        groups = sketched.join(repeated, SKETCH, "left_semi").groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)])
        kept = groups.agg(F.count("*").alias("_n"), F.first(F.struct(*map(col, df.columns))).alias("_row"))
        return sketched.join(repeated, SKETCH, "left_anti").select(*map(col, df.columns)).unionByName(kept.where("_n = 1").select("_row.*"))
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first', 'last' or False.")
    if set(names) == set(df.columns):
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("remove_duplicates on a subset needs order_by: rows have no order of their own.")
    given = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    order = [col(o) if isinstance(o, str) else o for o in given]
    if keep == "last":
        order = [o.desc() for o in order]
    # The filter on the row number lets Spark cut each group to one row before the shuffle.
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def count_removed(before: DataFrame, after: DataFrame) -> int:
    """Rows dropped between two versions of a table."""
    return before.count() - after.count()
