"""Feature engineering: each function returns the input with new columns added."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.buckets import add_interval_labels
from tabloom.functions.columns import as_list, col, number, numeric_columns, require_columns, require_numeric
from tabloom.functions.ordering import GROUP_ROWS, over_neighbours
from tabloom.functions.quantiles import exact_quantiles, group_quantiles
from tabloom.functions.stats import distinct_edges, log1p_floor, ratio, uniform_edges

AGGREGATES = ("mean", "std", "sum", "min", "max", "median", "count")

TIME_PARTS = (
    "day_of_week",
    "day_of_month",
    "month",
    "quarter",
    "year",
    "hour",
    "week_of_year",
    "is_month_start",
    "is_month_end",
)


def numerical_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Only the named (or all) numeric columns."""
    names = as_list(columns) or numeric_columns(df)
    require_numeric(df, names)
    return df.select(*map(col, names))


def polynomial_features(df: DataFrame, columns: str | Sequence[str], degree: int = 2) -> DataFrame:
    if degree < 2:
        raise ValueError("degree must be at least 2.")
    names = as_list(columns)
    require_columns(df, names)
    return df.withColumns({f"{c}_pow{d}": power(c, d) for c in names for d in range(2, degree + 1)})


def power(column: str, degree: int | float) -> Column:
    return F.pow(number(column), F.lit(float(degree)))


def product(columns: Sequence[str]) -> Column:
    result = number(columns[0])
    for c in columns[1:]:
        result = result * number(c)
    return result


def interaction_features(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Products of the given pairs, or of all pairs of ``columns``."""
    if columns is None and pairs is None:
        raise ValueError("Give 'columns' or 'pairs'.")
    chosen = [tuple(p) for p in pairs] if pairs else list(combinations(as_list(columns), 2))
    require_columns(df, [c for p in chosen for c in p])
    return df.withColumns({f"{a}_x_{b}": product([a, b]) for a, b in chosen})


def lag_features(
    df: DataFrame,
    column: str,
    lags: Sequence[int] | None = None,
    *,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Earlier values of a column in ``order_by`` order; a negative lag looks ahead."""
    steps = list(lags or [1, 7, 30])
    require_columns(df, [column, *as_list(order_by), *as_list(partition_by)])
    return over_neighbours(
        df,
        lambda w: {f"{column}_lag_{n}": F.lag(col(column), n).over(w) for n in steps},
        order_by,
        partition_by,
        before=max(0, *steps),
        after=max(0, *[-n for n in steps]),
        group_rows=group_rows,
    )


def window_aggregate(column: str, window, rows: int, fn: str) -> Column:
    """Aggregate over the current row and the ``rows - 1`` before it; NULLs are skipped."""
    frame = window.rowsBetween(1 - rows, 0)
    return aggregate(number(column), fn, lambda e: e.over(frame))


def aggregate(x: Column, fn: str, wrap=lambda e: e) -> Column:
    builders = {
        "mean": F.avg,
        "std": F.stddev_samp,
        "sum": F.sum,
        "min": F.min,
        "max": F.max,
        "median": lambda v: F.percentile(v, F.lit(0.5)),
        "count": F.count,
    }
    if fn not in builders:
        raise ValueError(f"Unknown aggregate '{fn}'. Use one of {AGGREGATES}.")
    return wrap(builders[fn](x))


def rolling_features(
    df: DataFrame,
    column: str,
    windows: Sequence[int] | None = None,
    agg_fns: Sequence[str] | None = None,
    *,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Aggregates over the last w rows, shorter at the start."""
    sizes, fns = list(windows or [7, 30]), list(agg_fns or ["mean", "std", "sum"])
    require_numeric(df, [column])
    return over_neighbours(
        df,
        lambda w: {f"{column}_rolling_{n}_{fn}": window_aggregate(column, w, n, fn) for n in sizes for fn in fns},
        order_by,
        partition_by,
        before=max(sizes) - 1,
        group_rows=group_rows,
    )


def domain_specific_features(df: DataFrame) -> DataFrame:
    """Customer measures; each is added when its input columns exist.

    avg_order_value = revenue / num_orders; recency_score = 1 / (1 + days_since_last_purchase);
    revenue_per_visit = revenue / visits; purchase_frequency = num_orders / customer_age_days;
    customer_lifetime_value = avg_order_value * purchase_frequency * avg_lifespan_days.
    """
    ratios = {
        "avg_order_value": ("revenue", "num_orders"),
        "revenue_per_visit": ("revenue", "visits"),
        "purchase_frequency": ("num_orders", "customer_age_days"),
    }
    added = {name: ratio(col(a), col(b)) for name, (a, b) in ratios.items() if {a, b} <= set(df.columns)}
    if "days_since_last_purchase" in df.columns:
        added["recency_score"] = ratio(F.lit(1.0), number("days_since_last_purchase") + 1)
    result = df.withColumns(added) if added else df
    factors = ["avg_order_value", "purchase_frequency", "avg_lifespan_days"]
    if set(factors) <= set(result.columns):
        result = result.withColumn("customer_lifetime_value", product(factors))
    return result


def as_timestamp(df: DataFrame, column: str) -> Column:
    """Timestamp without zone; text that is no date gives NULL."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(col(column)).cast("timestamp_ntz")
    return col(column).cast("timestamp_ntz")


def time_part(ts: Column, part: str) -> Column:
    builders = {
        "day_of_week": F.weekday,
        "day_of_month": F.dayofmonth,
        "month": F.month,
        "quarter": F.quarter,
        "year": F.year,
        "hour": F.hour,
        "week_of_year": F.weekofyear,
        "is_month_start": lambda t: F.coalesce(F.dayofmonth(t) == 1, F.lit(False)),
        "is_month_end": lambda t: F.coalesce(F.last_day(t) == F.to_date(t), F.lit(False)),
        "is_weekend": lambda t: F.coalesce(F.weekday(t) >= 5, F.lit(False)),
    }
    if part not in builders:
        raise ValueError(f"Unknown time component '{part}'. Use one of {tuple(builders)}.")
    return builders[part](ts)


def time_features(df: DataFrame, date_column: str, components: Sequence[str] | None = None) -> DataFrame:
    """Calendar parts of a date column; weeks start on Monday = 0."""
    require_columns(df, [date_column])
    parts = list(components or TIME_PARTS)
    if "day_of_week" in parts and "is_weekend" not in parts:
        parts.append("is_weekend")
    ts = as_timestamp(df, date_column)
    return df.withColumns({f"{date_column}_{p}": time_part(ts, p) for p in parts})


def bin_edges(df: DataFrame, requests: Sequence[tuple[str, str, int]]) -> list[list[float]]:
    """Edges for ``(column, strategy, bins)`` requests; one pass for all ranges, one for all quantiles."""
    for _, strategy, _ in requests:
        if strategy not in ("uniform", "quantile"):
            raise ValueError(f"Unknown strategy '{strategy}'. Use 'uniform' or 'quantile'.")
    ranged = list(dict.fromkeys(c for c, s, _ in requests if s == "uniform"))
    ranges = {}
    if ranged:
        row = df.agg(*[f(number(c)).alias(f"{f.__name__}{i}") for i, c in enumerate(ranged) for f in (F.min, F.max)]).first()
        ranges = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(ranged)}
    wanted: dict[str, list[float]] = {}
    for c, s, bins in requests:
        if s == "quantile":
            wanted.setdefault(c, []).extend(i / bins for i in range(bins + 1))
    probabilities = sorted({p for ps in wanted.values() for p in ps})
    quantiles = exact_quantiles(df, list(wanted), probabilities)
    edges = []
    for c, s, bins in requests:
        if s == "uniform":
            edges.append(uniform_edges(*ranges[c], bins))
        else:
            at = dict(zip(probabilities, quantiles[c]))
            edges.append(distinct_edges([at[i / bins] for i in range(bins + 1)]))
    return edges


def binning_features(df: DataFrame, column: str, bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """Interval index of equal-width or equal-frequency bins (repeated quantiles are merged)."""
    require_columns(df, [column])
    (edges,) = bin_edges(df, [(column, strategy, bins)])
    return add_interval_labels(df, {f"{column}_bin_{strategy}_{bins}": (number(column), edges)})


def join_group_statistics(
    df: DataFrame, group_by: str | Sequence[str], wanted: dict[str, tuple[str, str]]
) -> DataFrame:
    """Add per-group aggregates: ``wanted`` maps a new column to ``(column, aggregate)``.

    Rows are aggregated before the shuffle and the group table is joined back, so a group of any
    size is safe; the adaptive planner broadcasts the group table only when its measured size
    allows. Rows with a NULL group get NULL.
    """
    groups = as_list(group_by)
    require_columns(df, groups + [c for c, _ in wanted.values()])
    renamed = [col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    keys = [f"_g{i}" for i in range(len(groups))]
    present = df.where(_all_present(groups))
    simple = {n: (c, fn) for n, (c, fn) in wanted.items() if fn != "median"}
    table = present.groupBy(*renamed).agg(
        F.count("*").alias("_rows"),
        *[aggregate(number(c), fn).alias(f"_s_{n}") for n, (c, fn) in simple.items()],
    )
    for n, (c, fn) in wanted.items():
        if fn == "median":
            medians = group_quantiles(
                present.select(*renamed, number(c).alias("_x")), keys, "_x", [0.5]
            ).withColumnRenamed("q0", f"_s_{n}")
            table = table.join(medians, keys, "left")
    match = F.lit(True)
    for k, g in zip(keys, groups):
        match = match & (F.col(k) == col(g))
    joined = df.join(table, match, "left")
    kept = [col(c) for c in df.columns if c not in wanted]
    return joined.select(*kept, *[col(f"_s_{n}").alias(n) for n in wanted])


def _all_present(names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for n in names:
        condition = condition & col(n).isNotNull()
    return condition


def statistical_features(
    df: DataFrame, target_col: str, group_cols: str | Sequence[str], agg_fns: Sequence[str] | None = None
) -> DataFrame:
    """Aggregates of ``target_col`` per group column, on every row: ``{target}_by_{group}_{fn}``."""
    fns = list(agg_fns or ["mean", "std", "count"])
    result = df
    for g in as_list(group_cols):
        result = join_group_statistics(result, g, {f"{target_col}_by_{g}_{fn}": (target_col, fn) for fn in fns})
    return result


def ratio_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``{numerator}_per_{denominator}``, NULL for a zero denominator."""
    require_columns(df, [c for p in pairs for c in p])
    return df.withColumns({f"{n}_per_{d}": ratio(number(n), number(d)) for n, d in pairs})


def log_transform(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """``{column}_log`` = log(1 + max(x, 0))."""
    names = as_list(columns)
    require_columns(df, names)
    return df.withColumns({f"{c}_log": log1p_floor(number(c)) for c in names})
