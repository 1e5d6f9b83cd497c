"""Cleaning queries."""

from pyspark.sql import functions as F

from tabloom.operators import clean, encode
from tabloom.queries import Registry, table
from tabloom.queries.profiling import HOLED, holed_events

registry = Registry()


def _filled(df):
    return df.select("event_id", F.round("value", 6).alias("value"))


@registry.add("drop_nulls", f"WITH {HOLED} SELECT * FROM holed WHERE value IS NOT NULL AND event_type IS NOT NULL")
def drop_nulls(spark, folder):
    return clean.handle_missing_values(holed_events(spark, folder), "drop")


@registry.add(
    "fill_mean",
    f"WITH {HOLED} SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM holed)), 6) AS value FROM holed",
)
def fill_mean(spark, folder):
    return _filled(clean.handle_missing_values(holed_events(spark, folder), "mean", ["value", "event_type"]))


@registry.add(
    "fill_median",
    f"WITH {HOLED} SELECT event_id, round(coalesce(value, (SELECT median(value) FROM holed)), 6) AS value FROM holed",
)
def fill_median(spark, folder):
    return _filled(clean.handle_missing_values(holed_events(spark, folder), "median", ["value"]))


@registry.add(
    "fill_mode",
    f"""WITH {HOLED}, t AS (SELECT event_type FROM holed WHERE event_type IS NOT NULL
            GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1),
        v AS (SELECT value FROM holed WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, value LIMIT 1)
        SELECT event_id, coalesce(event_type, (FROM t)) AS event_type, coalesce(value, (FROM v)) AS value FROM holed""",
)
def fill_mode(spark, folder):
    filled = clean.handle_missing_values(holed_events(spark, folder), "mode", ["event_type", "value"])
    return filled.select("event_id", "event_type", "value")


@registry.add("fill_constant", f"WITH {HOLED} SELECT event_id, coalesce(value, -1.5) AS value FROM holed")
def fill_constant(spark, folder):
    return clean.handle_missing_values(holed_events(spark, folder), "constant", ["value"], -1.5).select("event_id", "value")


def _fill_sql(fn: str, frame: str, partition: str = "") -> str:
    over = f"OVER ({partition} ORDER BY event_id ROWS BETWEEN {frame})"
    return f"""WITH {HOLED} SELECT event_id, {fn}(value IGNORE NULLS) {over} AS value,
        {fn}(event_type IGNORE NULLS) {over} AS event_type FROM holed"""


FORWARD = ("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW")
BACKWARD = ("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")


def _fill(spark, folder, strategy, partition_by=None, **options):
    filled = clean.handle_missing_values(
        holed_events(spark, folder), strategy, ["value", "event_type"], order_by="event_id", partition_by=partition_by, **options
    )
    return filled.select("event_id", "value", "event_type")


@registry.add("forward_fill", _fill_sql(*FORWARD))
def forward_fill(spark, folder):
    return _fill(spark, folder, "forward_fill")


@registry.add("backward_fill", _fill_sql(*BACKWARD))
def backward_fill(spark, folder):
    return _fill(spark, folder, "backward_fill")


@registry.add("forward_fill_by_user", _fill_sql(*FORWARD, "PARTITION BY user_id"))
def forward_fill_by_user(spark, folder):
    return _fill(spark, folder, "forward_fill", "user_id")


@registry.add("backward_fill_by_user_split", _fill_sql(*BACKWARD, "PARTITION BY user_id"))
def backward_fill_by_user_split(spark, folder):
    # group_rows=0 treats every user as too large for one task.
    return _fill(spark, folder, "backward_fill", "user_id", group_rows=0)


IQR = """b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
    SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM holed))"""
ZSCORE = "b AS (SELECT avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM holed)"


def _summary_sql(bounds: str) -> str:
    return f"""WITH {HOLED}, {bounds} SELECT 'value' AS "column", round(any_value(lo), 6) AS lower_bound,
        round(any_value(hi), 6) AS upper_bound, count(*) FILTER (value < lo OR value > hi) AS outlier_count,
        round(count(*) FILTER (value < lo OR value > hi) * 1e2 / count(*), 6) AS outlier_pct FROM holed, b"""


def _summary(spark, folder, method):
    found = clean.outlier_summary(holed_events(spark, folder), "value", method)
    return found.withColumns({c: F.round(c, 6) for c in ("lower_bound", "upper_bound", "outlier_pct")})


@registry.add("outliers_iqr", _summary_sql(IQR))
def outliers_iqr(spark, folder):
    return _summary(spark, folder, "iqr")


@registry.add("outliers_zscore", _summary_sql(ZSCORE))
def outliers_zscore(spark, folder):
    return _summary(spark, folder, "zscore")


@registry.add("outlier_keys", f"WITH {HOLED}, {IQR} SELECT event_id FROM holed, b WHERE value < lo OR value > hi")
def outlier_keys(spark, folder):
    return clean.detect_outliers(holed_events(spark, folder), "value", "iqr", key="event_id").keys


@registry.add(
    "remove_outliers",
    f"WITH {HOLED}, {IQR} SELECT event_id, value FROM holed, b WHERE value IS NULL OR value BETWEEN lo AND hi",
)
def remove_outliers(spark, folder):
    return clean.remove_outliers(holed_events(spark, folder), "value").select("event_id", "value")


@registry.add(
    "label_encode",
    f"""WITH {HOLED}, c AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS code
            FROM (SELECT DISTINCT event_type FROM holed WHERE event_type IS NOT NULL))
        SELECT event_id, coalesce(code, -1) AS event_type FROM holed LEFT JOIN c USING (event_type)""",
)
def label_encode(spark, folder):
    return encode.encode_categoricals(holed_events(spark, folder), ["event_type"]).select("event_id", "event_type")


@registry.add(
    "one_hot_encode",
    "SELECT c_custkey, "
    + ", ".join(
        f"c_mktsegment = '{s}' AS \"c_mktsegment_{s}\""
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer",
)
def one_hot_encode(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return encode.encode_categoricals(customers, ["c_mktsegment"], "onehot")


def _scale_sql(expression: str, stats: str) -> str:
    return f"""WITH s AS (SELECT {stats} FROM orders)
        SELECT o_orderkey, round({expression}, 6) AS o_totalprice FROM orders, s"""


def _normalize(spark, folder, method):
    scaled = clean.normalize_features(table(spark, folder, "orders"), ["o_totalprice"], method)
    return scaled.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@registry.add("normalize_standard", _scale_sql("(o_totalprice - a) / b", "avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS b"))
def normalize_standard(spark, folder):
    return _normalize(spark, folder, "standard")


@registry.add("normalize_minmax", _scale_sql("(o_totalprice - a) / (b - a)", "min(o_totalprice) AS a, max(o_totalprice) AS b"))
def normalize_minmax(spark, folder):
    return _normalize(spark, folder, "minmax")


@registry.add(
    "normalize_robust",
    _scale_sql(
        "(o_totalprice - m) / (b - a)",
        "median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b",
    ),
)
def normalize_robust(spark, folder):
    return _normalize(spark, folder, "robust")


def _dedup_sql(direction: str) -> str:
    return f"""SELECT event_id, user_id, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {direction}) = 1"""


def _dedup(spark, folder, keep):
    kept = clean.remove_duplicates(table(spark, folder, "events"), ["user_id", "event_type"], keep, order_by="event_id")
    return kept.select("event_id", "user_id", "event_type", "value")


@registry.add("dedup_first", _dedup_sql("ASC"))
def dedup_first(spark, folder):
    return _dedup(spark, folder, "first")


@registry.add("dedup_last", _dedup_sql("DESC"))
def dedup_last(spark, folder):
    return _dedup(spark, folder, "last")


@registry.add(
    "dedup_none",
    """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
       QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) = 1""",
)
def dedup_none(spark, folder):
    kept = clean.remove_duplicates(table(spark, folder, "orders"), ["o_custkey", "o_orderpriority"], keep=False)
    return kept.select("o_orderkey", "o_custkey", "o_orderpriority")


@registry.add("dedup_whole_rows", "SELECT DISTINCT * FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_custkey % 3 = 0)")
def dedup_whole_rows(spark, folder):
    """All columns of a table that holds a third of its rows twice."""
    orders = table(spark, folder, "orders")
    return clean.remove_duplicates(orders.unionAll(orders.where("o_custkey % 3 = 0")))
