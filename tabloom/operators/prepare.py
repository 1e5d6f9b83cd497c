"""Splits, folds, imputation and the feature vector for training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import as_list, col, number, numeric_columns
from tabloom.functions.moments import means
from tabloom.functions.ordering import POSITION, number_rows

HASH_BITS = 60
CLASS_LIMIT = 1_000
LISTED_HASHES = 10_000


def key_hash(key: str | Sequence[str], seed: int) -> Column:
    """Uniform 60-bit integer from the key and the seed; the same in every run and on every engine."""
    parts = [col(k).cast("string") for k in as_list(key)]
    digest = F.md5(F.concat_ws("-", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_fraction(key: str | Sequence[str], seed: int) -> Column:
    """Uniform number in [0, 1) from the leading 32 bits of the key hash."""
    return F.shiftright(key_hash(key, seed), HASH_BITS - 32).cast("double") / F.lit(float(2**32))


def random_split(
    df: DataFrame, key: str | Sequence[str], test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by hash of the key: reproducible, no shuffle, shares are approximate."""
    in_test = hash_fraction(key, seed) < F.lit(float(test_size))
    return df.where(~in_test), df.where(in_test)


def class_thresholds(
    df: DataFrame, label: str, key: str | Sequence[str], test_size: float, seed: int
) -> list[tuple[object, int]]:
    """Per class the hash below or at which exactly ``round(test_size * n)`` of its rows lie.

    A radix descent on the hash: each round counts rows per class and 16-bit digit, at most 65,536
    counts per class however large the class is, until the digit that holds the threshold has few
    rows. Only classes, not rows, reach the driver.
    """
    rows = df.select(col(label).alias("c"), key_hash(key, seed).alias("h"))
    wanted: dict[object, int] = {}
    floor: dict[object, int] = {}
    thresholds: dict[object, int] = {}
    shift = HASH_BITS
    while True:
        width = min(16, shift)
        shift -= width
        if wanted:
            # Keep only rows that share the digits found so far; one row per class.
            table = df.sparkSession.createDataFrame(
                [(c, floor[c]) for c in wanted], f"p_c {df.schema[label].dataType.simpleString()}, p_h long"
            )
            prefix = F.shiftright("h", shift + width)
            live = rows.join(F.broadcast(table), F.col("c").eqNullSafe(F.col("p_c")) & (prefix == F.col("p_h"))).select("c", "h")
        else:
            live = rows
        counts = live.groupBy("c", F.shiftright("h", shift).alias("d")).agg(F.count("*").alias("n"))
        per_class = counts.groupBy("c").agg(
            F.array_sort(F.collect_list(F.struct("d", "n"))).alias("digits"), F.sum("n").alias("total")
        )
        if not wanted:
            sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count("*").alias("n")).limit(CLASS_LIMIT + 1).collect()}
            if len(sizes) > CLASS_LIMIT:
                raise ValueError(f"'{label}' has more than {CLASS_LIMIT} classes.")
            wanted = {c: int(test_size * n + 0.5) for c, n in sizes.items()}
            thresholds = {c: -1 for c, k in wanted.items() if k == 0}
            wanted = {c: k for c, k in wanted.items() if k > 0}
            if not wanted:
                return list(thresholds.items())
        ranks = df.sparkSession.createDataFrame(
            list(wanted.items()), f"k_c {df.schema[label].dataType.simpleString()}, k long"
        )
        # The running sum over the digits, stopping at the first digit that reaches rank k.
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("n"))
        found = per_class.join(F.broadcast(ranks), F.col("c").eqNullSafe(F.col("k_c"))).select(
            "c",
            F.aggregate(
                "digits",
                start,
                lambda acc, e: F.when(acc["before"] + acc["n"] >= F.col("k"), acc).otherwise(
                    F.struct((acc["before"] + acc["n"]).alias("before"), e["d"].alias("d"), e["n"].alias("n"))
                ),
            ).alias("hit"),
        )
        widest = 0
        for r in found.collect():
            wanted[r["c"]] -= r["hit"]["before"]
            floor[r["c"]] = r["hit"]["d"]
            widest = max(widest, r["hit"]["n"])
        if widest <= LISTED_HASHES or shift == 0:
            break
    if shift == 0:
        return [*thresholds.items(), *floor.items()]
    table = df.sparkSession.createDataFrame(
        [(c, floor[c], k) for c, k in wanted.items()],
        f"p_c {df.schema[label].dataType.simpleString()}, p_h long, k int",
    )
    # At most LISTED_HASHES rows per class are left.
    last = (
        rows.join(F.broadcast(table), F.col("c").eqNullSafe(F.col("p_c")) & (F.shiftright("h", shift) == F.col("p_h")))
        .groupBy("c")
        .agg(F.get(F.array_sort(F.collect_list("h")), F.first("k") - 1).alias("t"))
    )
    return [*thresholds.items(), *((r["c"], r["t"]) for r in last.collect())]


def stratified_split(
    df: DataFrame, label: str, key: str | Sequence[str], test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with the same share of every class: exactly ``round(test_size * n)`` each."""
    thresholds = class_thresholds(df, label, key, test_size, seed)
    table = df.sparkSession.createDataFrame(
        thresholds, f"_class {df.schema[label].dataType.simpleString()}, _limit long"
    )
    # One row per class, at most CLASS_LIMIT.
    joined = df.join(F.broadcast(table), col(label).eqNullSafe(F.col("_class")), "left")
    in_test = key_hash(key, seed) <= F.col("_limit")
    columns = [col(c) for c in df.columns]
    return joined.where(~in_test).select(*columns), joined.where(in_test).select(*columns)


def split(
    df: DataFrame,
    key: str | Sequence[str],
    test_size: float = 0.2,
    seed: int = 42,
    stratify: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    if stratify:
        return stratified_split(df, stratify, key, test_size, seed)
    return random_split(df, key, test_size, seed)


def assign_folds(
    df: DataFrame,
    folds: int,
    key: str | Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
    seed: int = 42,
    name: str = "fold",
) -> DataFrame:
    """Fold number per row: contiguous blocks in ``order_by`` order, or by hash of ``key``."""
    if order_by:
        numbered = number_rows(df, as_list(order_by))
        n, k = numbered.total, min(folds, max(numbered.total, 1))
        size, larger = divmod(n, k)
        # The first ``larger`` folds hold one row more.
        edge = larger * (size + 1)
        place = F.col(POSITION)
        fold = F.when(place < edge, F.floor(place / (size + 1))).otherwise(larger + F.floor((place - edge) / max(size, 1)))
        return numbered.rows.withColumn(name, fold.cast("int")).drop(POSITION)
    if not key:
        raise ValueError("assign_folds needs key or order_by.")
    return df.withColumn(name, (key_hash(key, seed) % folds).cast("int"))


def fit_means(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Means of the training rows; a column without values is filled with 0."""
    return {c: 0.0 if m is None else m for c, m in means(train, columns).items()}


def fill_with(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(number(c), F.lit(v)) for c, v in values.items()}) if values else df


def mean_impute(
    train: DataFrame, test: DataFrame, columns: Sequence[str], full_data: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Fill both tables with training means; ``full_data`` takes the means of both, which leaks."""
    values = fit_means(train.unionByName(test) if full_data else train, columns)
    return fill_with(train, values), fill_with(test, values)


def feature_columns(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """All numeric columns but the target."""
    return numeric_columns(df, exclude=[target, *exclude])


def feature_matrix(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Add the vector column that Spark ML estimators read."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="keep").transform(df)
