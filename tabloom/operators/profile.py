"""Profiling of a table: shape, missing values, duplicates, per-column statistics, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.functions.columns import as_list, col, number, numeric_columns, rows_of, string_columns
from tabloom.functions.moments import pairwise_sums
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.sketch import SKETCH, repeated_sketches, with_sketch
from tabloom.functions.stats import safe_corr, sample_kurtosis, sample_skewness, zero_to_null
from tabloom.session import durable

#: A centred sum of squares below this share of the sum around the column's mean has lost half its digits.
CANCELLING = 1e-8
PAIRS_AT_ONCE = 200


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    """One row per column, in schema order."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def kind_counts(df: DataFrame) -> DataFrame:
    """Number of numeric, datetime and categorical columns; every other type counts as categorical."""
    kinds = {"Numeric": 0, "Datetime": 0, "Categorical": 0}
    for field in df.schema:
        if isinstance(field.dataType, T.NumericType):
            kinds["Numeric"] += 1
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds["Datetime"] += 1
        else:
            kinds["Categorical"] += 1
    return df.sparkSession.createDataFrame(list(kinds.items()), "kind string, n_columns int")


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column, most missing first, then in column order."""
    counted = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            F.lit(kind).alias("dtype"),
            F.col(f"m{i}").alias("missing_count"),
            F.round(F.col(f"m{i}") * 100.0 / F.nullif(F.col("_rows"), F.lit(0)), 2).alias("missing_pct"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counted.select(rows_of(*entries)).orderBy(F.desc("missing_count"), "position")


def top_missing(df: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` columns with the highest missing percentage, complete columns left out."""
    return missing_report(df).where("missing_pct > 0").orderBy(F.desc("missing_pct"), "position").limit(n)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row; NULLs are equal to each other.

    Rows meet by sketches; only those whose sketch repeats are compared as a whole. While the repeated sketches
    are few the adaptive planner broadcasts them, and rows that occur once are not shuffled.
    """
    sketched = with_sketch(df, [col(c) for c in df.columns])
    suspects = sketched.join(repeated_sketches(sketched), SKETCH, "left_semi")
    groups = suspects.groupBy(*map(col, df.columns)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long table ``(column, stat, value)`` with count, mean, std, min, 25%, 50%, 75%, max."""
    names = as_list(columns) or numeric_columns(df)
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    aggs = []
    for i, name in enumerate(names):
        x = number(name)
        aggs += [
            F.count(x).cast("double").alias(f"count{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
        ]
    entries = []
    for i, name in enumerate(names):
        values = {s: F.col(f"{s}{i}") for s in ("count", "mean", "std", "min")}
        values |= {f"{p}%": F.lit(q).cast("double") for p, q in zip((25, 50, 75), quartiles[name])}
        values["max"] = F.col(f"max{i}")
        entries += [
            F.struct(F.lit(name).alias("column"), F.lit(s).alias("stat"), v.alias("value")) for s, v in values.items()
        ]
    return df.agg(*aggs).select(rows_of(*entries))


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per string column: distinct values, most frequent value (smallest on a tie) and its count."""
    names = as_list(columns) or string_columns(df)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in names])).alias("e")
    counted = df.select(pairs).select("e.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    present = F.when(F.col("value").isNotNull(), F.col("n"))
    return counted.groupBy("column").agg(
        F.count("value").alias("unique"),
        F.min_by("value", F.when(present.isNotNull(), F.struct(-present, "value"))).alias("top"),
        F.coalesce(F.max(present), F.lit(0)).alias("freq"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long table ``(a, b, corr)`` of pairwise-complete Pearson correlations, both orders and the diagonal.

    NULL where a column is constant over the complete rows, or where one of them holds an infinite value. Sums are
    taken around the column means; the few pairs whose complete rows lie so far from these that the sums cancel are
    computed anew, around their own means.
    """
    names = as_list(columns) or numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    finite = [F.when(F.abs(number(c)) < float("inf"), number(c)) for c in names]
    # With so many expressions, one array keeps the generated code in pieces.
    row = df.agg(F.array(*(F.struct(F.avg(x).alias("m"), F.min(x).alias("low"), F.max(x).alias("high")) for x in finite)).alias("s")).first()["s"]
    centre = [s["m"] or 0.0 for s in row]
    constant = [s["low"] is None or s["low"] == s["high"] for s in row]
    sums = durable(pairwise_sums(df, names, centre))
    n = zero_to_null(F.col("n"))
    sxx, syy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    sxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    varies = F.lit(True)
    if any(constant):
        still = [i for i, same in enumerate(constant) if same]
        varies = ~F.col("i").isin(still) & ~F.col("j").isin(still)
    cancels = (sxx <= CANCELLING * F.col("sxx")) | (syy <= CANCELLING * F.col("syy"))
    judged = sums.select("i", "j", (varies & (F.col("infinite") == 0)).alias("defined"), cancels.alias("cancels"), (sxy / zero_to_null(F.sqrt(sxx) * F.sqrt(syy))).alias("corr"))
    again = [(r["i"], r["j"]) for r in judged.where("defined AND cancels").select("i", "j").toLocalIterator()]
    corr = F.when(F.col("defined"), F.col("corr"))
    if again:
        known = []
        for at in range(0, len(again), PAIRS_AT_ONCE):
            some = again[at : at + PAIRS_AT_ONCE]
            found = df.agg(F.array(*(safe_corr(number(names[i]), number(names[j])) for i, j in some)).alias("r")).first()["r"]
            known += [(i, j, r) for (i, j), r in zip(some, found)]
        judged = judged.join(df.sparkSession.createDataFrame(known, "i long, j long, exact double"), ["i", "j"], "left")
        corr = F.when(F.col("defined"), F.when(F.col("cancels"), F.col("exact")).otherwise(F.col("corr")))
    label = F.array(*map(F.lit, names))
    a, b = F.get(label, F.col("i").cast("int")), F.get(label, F.col("j").cast("int"))
    upper = judged.select(a.alias("a"), b.alias("b"), corr.alias("corr"), (F.col("i") != F.col("j")).alias("twice"))
    both = F.when(F.col("twice"), F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).otherwise(F.array(F.struct("a", "b")))
    return upper.select(F.explode(both).alias("p"), "corr").select("p.a", "p.b", "corr")


def distribution_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: mean, std, skewness, kurtosis, min, max."""
    names = as_list(columns) or numeric_columns(df)
    aggs, entries = [], []
    for i, name in enumerate(names):
        x = number(name)
        parts = {
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "skewness": sample_skewness(x),
            "kurtosis": sample_kurtosis(x),
            "min": F.min(x),
            "max": F.max(x),
        }
        aggs += [e.alias(f"{s}{i}") for s, e in parts.items()]
        entries.append(F.struct(F.lit(name).alias("column"), *[F.col(f"{s}{i}").alias(s) for s in parts]))
    return df.agg(*aggs).select(rows_of(*entries))


def dataset_statistics(df: DataFrame) -> dict:
    """The whole profile as one dictionary; its size depends on the columns only."""
    report = missing_report(df).collect()
    numeric = {}
    if numeric_columns(df):
        for r in describe_numeric(df).collect():
            numeric.setdefault(r["column"], {})[r["stat"]] = None if r["value"] is None else round(r["value"], 4)
    categorical = {}
    if string_columns(df):
        for r in categorical_stats(df).collect():
            categorical[r["column"]] = {"unique": r["unique"], "top": r["top"], "freq": r["freq"]}
    missing = {r["column"]: r for r in report}
    return {
        "shape": shape(df).first().asDict(),
        "columns": df.columns,
        "dtypes": dict(df.dtypes),
        "missing": {c: missing[c]["missing_count"] for c in df.columns},
        "missing_pct": {c: missing[c]["missing_pct"] for c in df.columns},
        "duplicates": duplicate_count(df).first()["duplicates"],
        "numeric_stats": numeric,
        "categorical_stats": categorical,
    }
