"""Feature engineering queries."""

from pyspark.sql import functions as F

from tabloom.operators import encode, features
from tabloom.operators.scaler import Scaler, log_scaling, robust_scaling
from tabloom.plans.spec import build_feature_set, preview
from tabloom.queries import Registry, table
from tabloom.queries.profiling import HOLED, holed_events

registry = Registry()

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(LINE_KEY)


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@registry.add("numeric_passthrough", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_passthrough(spark, folder):
    return features.numerical_features(table(spark, folder, "orders"))


@registry.add(
    "polynomial",
    f"SELECT {KEYS}, round(l_discount ** 2, 6) AS l_discount_pow2, round(l_discount ** 3, 8) AS l_discount_pow3 FROM lineitem",
)
def polynomial(spark, folder):
    built = features.polynomial_features(table(spark, folder, "lineitem"), ["l_discount"], 3)
    built = rounded(rounded(built, 6, "l_discount_pow2"), 8, "l_discount_pow3")
    return built.select(*LINE_KEY, "l_discount_pow2", "l_discount_pow3")


@registry.add(
    "interaction",
    f"""SELECT {KEYS}, round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount,
        round(l_quantity * l_tax, 6) AS l_quantity_x_l_tax, round(l_discount * l_tax, 6) AS l_discount_x_l_tax FROM lineitem""",
)
def interaction(spark, folder):
    built = features.interaction_features(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    names = ["l_quantity_x_l_discount", "l_quantity_x_l_tax", "l_discount_x_l_tax"]
    return rounded(built, 6, *names).select(*LINE_KEY, *names)


@registry.add(
    "ratio",
    f"""SELECT {KEYS}, round(l_extendedprice / nullif(l_discount, 0), 4) AS l_extendedprice_per_l_discount,
        round(l_extendedprice / nullif(l_quantity, 0), 8) AS l_extendedprice_per_l_quantity FROM lineitem""",
)
def ratio(spark, folder):
    pairs = [("l_extendedprice", "l_discount"), ("l_extendedprice", "l_quantity")]
    built = features.ratio_features(table(spark, folder, "lineitem"), pairs)
    built = rounded(rounded(built, 4, "l_extendedprice_per_l_discount"), 8, "l_extendedprice_per_l_quantity")
    return built.select(*LINE_KEY, "l_extendedprice_per_l_discount", "l_extendedprice_per_l_quantity")


@registry.add("log", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS c_acctbal_log FROM customer")
def log(spark, folder):
    built = features.log_transform(table(spark, folder, "customer"), ["c_acctbal"])
    return rounded(built, 6, "c_acctbal_log").select("c_custkey", "c_acctbal_log")


DOMAIN = """domain AS (
  SELECT c_custkey, coalesce(revenue, 0) AS revenue, coalesce(num_orders, 0) AS num_orders, coalesce(visits, 0) AS visits,
         coalesce(days, 0) AS days_since_last_purchase, coalesce(age, 0) AS customer_age_days, 365 AS avg_lifespan_days
  FROM customer
  LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS revenue, count(*) AS num_orders,
                    date_diff('day', max(o_orderdate)::DATE, DATE '2003-01-01') AS days,
                    date_diff('day', min(o_orderdate)::DATE, DATE '2003-01-01') AS age
             FROM orders GROUP BY 1) o ON o_custkey = c_custkey
  LEFT JOIN (SELECT user_id, count(*) AS visits FROM events GROUP BY 1) e ON user_id = c_custkey)"""


@registry.add(
    "domain_features",
    f"""WITH {DOMAIN}, d AS (SELECT *, revenue / nullif(num_orders, 0) AS aov,
            num_orders / nullif(customer_age_days, 0)::DOUBLE AS pf FROM domain)
        SELECT c_custkey, round(aov, 6) AS avg_order_value, round(1 / (1e0 + days_since_last_purchase), 6) AS recency_score,
               round(revenue / nullif(visits, 0), 6) AS revenue_per_visit, round(pf, 6) AS purchase_frequency,
               round(aov * pf * avg_lifespan_days, 5) AS customer_lifetime_value FROM d""",
)
def domain_features(spark, folder):
    end = F.lit("2003-01-01").cast("date")
    # Orders and events are aggregated to their key before they meet the customers.
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("revenue"),
        F.count("*").alias("num_orders"),
        F.date_diff(end, F.to_date(F.max("o_orderdate"))).alias("days_since_last_purchase"),
        F.date_diff(end, F.to_date(F.min("o_orderdate"))).alias("customer_age_days"),
    )
    events = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("visits"))
    customers = table(spark, folder, "customer").select("c_custkey")
    joined = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(
        events, F.col("c_custkey") == F.col("user_id"), "left"
    )
    measured = joined.na.fill(0).withColumn("avg_lifespan_days", F.lit(365))
    built = features.domain_specific_features(measured)
    built = rounded(built, 5, "customer_lifetime_value")
    built = rounded(built, 6, "avg_order_value", "revenue_per_visit", "recency_score", "purchase_frequency")
    names = ["avg_order_value", "recency_score", "revenue_per_visit", "purchase_frequency", "customer_lifetime_value"]
    return built.select("c_custkey", *names)


def _lag_sql(partition: str = "") -> str:
    over = f"OVER ({partition} ORDER BY event_id)"
    columns = ", ".join(f"lag(value, {n}) {over} AS value_lag_{n}" for n in (1, 7, 30))
    return f"WITH {HOLED} SELECT event_id, {columns} FROM holed"


def _lag(spark, folder, partition_by=None, **options):
    built = features.lag_features(
        holed_events(spark, folder), "value", order_by="event_id", partition_by=partition_by, **options
    )
    return built.select("event_id", "value_lag_1", "value_lag_7", "value_lag_30")


@registry.add("lag", _lag_sql())
def lag(spark, folder):
    return _lag(spark, folder)


@registry.add("lag_by_user", _lag_sql("PARTITION BY user_id"))
def lag_by_user(spark, folder):
    return _lag(spark, folder, "user_id")


@registry.add("lag_by_user_split", _lag_sql("PARTITION BY user_id"))
def lag_by_user_split(spark, folder):
    # group_rows=0 treats every user as too large for one task.
    return _lag(spark, folder, "user_id", group_rows=0)


ROLLING = [(7, fn) for fn in features.AGGREGATES] + [(30, "mean"), (30, "std")]
_SQL_AGGREGATES = {
    "mean": "avg(value)",
    "std": "stddev_samp(value)",
    "sum": "sum(value)",
    "min": "min(value)",
    "max": "max(value)",
    "median": "median(value)",
    "count": "count(value)",
}


def _rolling_sql(partition: str = "") -> str:
    parts = []
    for n, fn in ROLLING:
        call = f"{_SQL_AGGREGATES[fn]} OVER ({partition} ORDER BY event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"{call if fn == 'count' else f'round({call}, 7)'} AS value_rolling_{n}_{fn}")
    return f"WITH {HOLED} SELECT event_id, {', '.join(parts)} FROM holed"


def _rolling(spark, folder, partition_by=None):
    built = features.over_neighbours(
        holed_events(spark, folder),
        lambda w: {f"value_rolling_{n}_{fn}": features.window_aggregate("value", w, n, fn) for n, fn in ROLLING},
        "event_id",
        partition_by,
        before=29,
    )
    names = [f"value_rolling_{n}_{fn}" for n, fn in ROLLING]
    return rounded(built, 7, *[n for n in names if not n.endswith("count")]).select("event_id", *names)


@registry.add("rolling", _rolling_sql())
def rolling(spark, folder):
    return _rolling(spark, folder)


@registry.add("rolling_by_user", _rolling_sql("PARTITION BY user_id"))
def rolling_by_user(spark, folder):
    return _rolling(spark, folder, "user_id")


@registry.add(
    "rolling_defaults",
    f"WITH {HOLED} SELECT event_id, "
    + ", ".join(
        f"round({_SQL_AGGREGATES[fn]} OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 7)"
        f" AS value_rolling_{n}_{fn}"
        for n in (7, 30)
        for fn in ("mean", "std", "sum")
    )
    + " FROM holed",
)
def rolling_defaults(spark, folder):
    built = features.rolling_features(holed_events(spark, folder), "value", order_by="event_id", partition_by="user_id")
    names = [f"value_rolling_{n}_{fn}" for n in (7, 30) for fn in ("mean", "std", "sum")]
    return rounded(built, 7, *names).select("event_id", *names)


@registry.add(
    "label_feature",
    """SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS o_orderpriority_encoded,
       (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS o_orderstatus_encoded FROM orders""",
)
def label_feature(spark, folder):
    built = encode.categorical_encoding(table(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus"], "label")
    return built.select("o_orderkey", "o_orderpriority_encoded", "o_orderstatus_encoded")


@registry.add(
    "one_hot_feature",
    "SELECT o_orderkey, "
    + ", ".join(
        f"(o_orderpriority = '{p}')::INTEGER AS \"o_orderpriority_{p}\""
        for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    )
    + " FROM orders",
)
def one_hot_feature(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return encode.categorical_encoding(orders, ["o_orderpriority"])


def _time_sql(ts: str) -> str:
    return f"""(isodow({ts}) - 1)::INTEGER AS {ts}_day_of_week, day({ts})::INTEGER AS {ts}_day_of_month,
        month({ts})::INTEGER AS {ts}_month, quarter({ts})::INTEGER AS {ts}_quarter, year({ts})::INTEGER AS {ts}_year,
        hour({ts})::INTEGER AS {ts}_hour, week({ts})::INTEGER AS {ts}_week_of_year, day({ts}) = 1 AS {ts}_is_month_start,
        last_day({ts}) = {ts}::DATE AS {ts}_is_month_end, isodow({ts}) >= 6 AS {ts}_is_weekend"""


def _time(df, key, ts):
    built = features.time_features(df, ts)
    return built.select(key, *[c for c in built.columns if c.startswith(f"{ts}_")])


@registry.add("time_parts", f"SELECT o_orderkey, {_time_sql('o_orderdate')} FROM orders")
def time_parts(spark, folder):
    return _time(table(spark, folder, "orders"), "o_orderkey", "o_orderdate")


@registry.add("time_parts_of_text", f"SELECT event_id, {_time_sql('ts')} FROM events")
def time_parts_of_text(spark, folder):
    events = table(spark, folder, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return _time(events, "event_id", "ts")


@registry.add(
    "bin_uniform",
    """WITH r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS step FROM orders)
       SELECT o_orderkey, len(list_filter(range(1, 10), lambda i: o_totalprice > lo + i * step))::INTEGER
              AS o_totalprice_bin_uniform_10 FROM orders, r""",
)
def bin_uniform(spark, folder):
    built = features.binning_features(table(spark, folder, "orders"), "o_totalprice")
    return built.select("o_orderkey", "o_totalprice_bin_uniform_10")


def quantile_edges(source: str, column: str, bins: int) -> str:
    """SQL list of the sorted distinct quantile edges of a column."""
    points = ", ".join(f"{i / bins}" for i in range(bins + 1))
    return f"(SELECT list_sort(list_distinct(quantile_cont({column}::DOUBLE, [{points}]))) FROM {source})"


def quantile_bin(column: str, edges: str) -> str:
    """SQL index of the right-closed interval of ``edges`` that holds a value."""
    return (
        f"CASE WHEN {column} IS NULL OR len({edges}) < 2 THEN NULL ELSE "
        f"len(list_filter({edges}[2:len({edges}) - 1], lambda e: {column} > e)) END::INTEGER"
    )


@registry.add(
    "bin_quantile",
    f"""WITH q AS (SELECT {quantile_edges('orders', 'o_totalprice', 8)} AS e)
        SELECT o_orderkey, {quantile_bin('o_totalprice', 'e')} AS o_totalprice_bin_quantile_8 FROM orders, q""",
)
def bin_quantile(spark, folder):
    built = features.binning_features(table(spark, folder, "orders"), "o_totalprice", 8, "quantile")
    return built.select("o_orderkey", "o_totalprice_bin_quantile_8")


@registry.add(
    "bin_quantile_ties",
    f"""WITH q AS (SELECT {quantile_edges('lineitem', 'l_discount', 25)} AS e)
        SELECT {KEYS}, {quantile_bin('l_discount', 'e')} AS l_discount_bin_quantile_25 FROM lineitem, q""",
)
def bin_quantile_ties(spark, folder):
    built = features.binning_features(table(spark, folder, "lineitem"), "l_discount", 25, "quantile")
    return built.select(*LINE_KEY, "l_discount_bin_quantile_25")


def _group_sql(column: str, group: str, fns) -> str:
    calls = {k: v.replace("value", column) for k, v in _SQL_AGGREGATES.items()}
    return ", ".join(
        f"{calls[fn]} OVER (PARTITION BY {group}) AS {column}_by_{group}_{fn}"
        if fn == "count"
        else f"round({calls[fn]} OVER (PARTITION BY {group}), 3) AS {column}_by_{group}_{fn}"
        for fn in fns
    )


@registry.add(
    "group_statistics",
    f"""SELECT c_custkey, {_group_sql('c_acctbal', 'c_mktsegment', features.AGGREGATES)},
        {_group_sql('c_acctbal', 'c_nationkey', features.AGGREGATES)} FROM customer""",
)
def group_statistics(spark, folder):
    groups = ["c_mktsegment", "c_nationkey"]
    built = features.statistical_features(table(spark, folder, "customer"), "c_acctbal", groups, features.AGGREGATES)
    names = [f"c_acctbal_by_{g}_{fn}" for g in groups for fn in features.AGGREGATES]
    return rounded(built, 3, *[n for n in names if not n.endswith("count")]).select("c_custkey", *names)


@registry.add(
    "group_statistics_null_group",
    f"""WITH {HOLED} SELECT event_id,
        CASE WHEN event_type IS NOT NULL THEN round(avg(value) OVER (PARTITION BY event_type), 6) END AS value_by_event_type_mean,
        CASE WHEN event_type IS NOT NULL THEN round(stddev_samp(value) OVER (PARTITION BY event_type), 6) END AS value_by_event_type_std,
        CASE WHEN event_type IS NOT NULL THEN count(value) OVER (PARTITION BY event_type) END AS value_by_event_type_count
        FROM holed""",
)
def group_statistics_null_group(spark, folder):
    built = features.statistical_features(holed_events(spark, folder), "value", "event_type")
    names = [f"value_by_event_type_{fn}" for fn in ("mean", "std", "count")]
    return rounded(built, 6, *names[:2]).select("event_id", *names)


ORDER_SPEC = {
    "features": [
        {"name": "o_totalprice", "type": "numeric", "source": "raw"},
        {"name": "price_log", "type": "numeric", "source": "log", "base": "o_totalprice"},
        {"name": "price_log_sq", "type": "numeric", "source": "polynomial", "base": "price_log"},
        {"name": "price_x_log", "type": "numeric", "source": "interaction", "operands": ["o_totalprice", "price_log"]},
        {"name": "weekday", "type": "categorical", "source": "time", "base": "o_orderdate", "component": "day_of_week"},
        {"name": "weekend", "type": "categorical", "source": "time", "base": "o_orderdate", "component": "is_weekend"},
        {"name": "month", "type": "categorical", "source": "time", "base": "o_orderdate", "component": "month"},
        {"name": "price_bin", "type": "categorical", "source": "binning", "base": "o_totalprice", "bins": 5},
        {"name": "log_bin", "type": "categorical", "source": "binning", "base": "price_log", "bins": 4, "strategy": "quantile"},
        {"name": "priority_mean", "type": "numeric", "source": "statistical", "base": "o_totalprice", "group": "o_orderpriority"},
        {"name": "price_to_mean", "type": "numeric", "source": "ratio", "numerator": "o_totalprice", "denominator": "priority_mean"},
        {"name": "priority_code", "type": "numeric", "source": "encoding", "base": "o_orderpriority"},
        {"name": "previous", "type": "numeric", "source": "lag", "base": "o_totalprice"},
        {"name": "recent_mean", "type": "numeric", "source": "rolling", "base": "o_totalprice", "window": 5, "agg": "mean"},
    ]
}


@registry.add(
    "feature_spec",
    f"""WITH a AS (SELECT *, ln(1 + greatest(o_totalprice, 0)) AS price_log,
               avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS priority_mean FROM orders),
        s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 5 AS step,
                     {quantile_edges('a', 'price_log', 4)} AS e FROM a)
        SELECT o_orderkey, o_totalprice, round(price_log, 6) AS price_log, round(price_log ** 2, 6) AS price_log_sq,
               round(o_totalprice * price_log, 4) AS price_x_log, (isodow(o_orderdate) - 1)::INTEGER AS weekday,
               isodow(o_orderdate) >= 6 AS weekend, month(o_orderdate)::INTEGER AS month,
               len(list_filter(range(1, 5), lambda i: o_totalprice > lo + i * step))::INTEGER AS price_bin,
               {quantile_bin('price_log', 'e')} AS log_bin, round(priority_mean, 4) AS priority_mean,
               round(o_totalprice / nullif(priority_mean, 0), 6) AS price_to_mean,
               (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS priority_code,
               lag(o_totalprice) OVER (ORDER BY o_orderkey) AS previous,
               round(avg(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS recent_mean
        FROM a, s""",
)
def feature_spec(spark, folder):
    built = build_feature_set(table(spark, folder, "orders"), ORDER_SPEC, order_by="o_orderkey")
    built = rounded(built, 6, "price_log", "price_log_sq", "price_to_mean")
    built = rounded(built, 4, "price_x_log", "priority_mean", "recent_mean")
    return built.select("o_orderkey", *[f["name"] for f in ORDER_SPEC["features"]])


# Scaler: fitted on one part of the orders, applied to all of them

_TRAIN = "train AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')"


def _train(orders):
    return orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))


def _scaler(spark, folder, method, inverse=False):
    orders = table(spark, folder, "orders")
    scaler = Scaler(method).fit(_train(orders), ["o_totalprice"])
    scaled = scaler.transform(orders)
    if inverse:
        scaled = scaler.inverse_transform(scaled)
    return rounded(scaled, 4 if inverse else 6, "o_totalprice").select("o_orderkey", "o_totalprice")


def _scaler_sql(expression: str, stats: str) -> str:
    return f"""WITH {_TRAIN}, s AS (SELECT {stats} FROM train)
        SELECT o_orderkey, round({expression}, 6) AS o_totalprice FROM orders, s"""


@registry.add("scaler_standard", _scaler_sql("(o_totalprice - a) / b", "avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS b"))
def scaler_standard(spark, folder):
    return _scaler(spark, folder, "standard")


@registry.add(
    "scaler_fit_transform",
    "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS o_totalprice FROM orders",
)
def scaler_fit_transform(spark, folder):
    scaled = Scaler("standard").fit_transform(table(spark, folder, "orders"), ["o_totalprice"])
    return rounded(scaled, 6, "o_totalprice").select("o_orderkey", "o_totalprice")


@registry.add(
    "feature_preview",
    """SELECT o_orderkey, o_totalprice, round(ln(o_totalprice + 1), 6) AS price_log,
        lag(o_totalprice) OVER (ORDER BY o_orderkey) AS previous FROM orders ORDER BY o_orderkey LIMIT 5""",
)
def feature_preview(spark, folder):
    """The first five rows of a feature set."""
    spec = {
        "features": [
            {"name": "price_log", "source": "log", "base": "o_totalprice"},
            {"name": "previous", "source": "lag", "base": "o_totalprice", "lag": 1},
        ]
    }
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    original, engineered, rows = preview(orders, spec, order_by="o_orderkey")
    return rounded(rows, 6, "price_log").select(*original, *engineered)


@registry.add("scaler_minmax", _scaler_sql("(o_totalprice - a) / (b - a)", "min(o_totalprice) AS a, max(o_totalprice) AS b"))
def scaler_minmax(spark, folder):
    return _scaler(spark, folder, "minmax")


@registry.add(
    "scaler_robust",
    _scaler_sql(
        "(o_totalprice - m) / (b - a)",
        "median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b",
    ),
)
def scaler_robust(spark, folder):
    orders = table(spark, folder, "orders")
    scaled, _ = robust_scaling(orders, ["o_totalprice"], _train(orders))
    return rounded(scaled, 6, "o_totalprice").select("o_orderkey", "o_totalprice")


@registry.add("scaler_log", "SELECT o_orderkey, round(ln(1 + greatest(o_totalprice, 0)), 6) AS o_totalprice FROM orders")
def scaler_log(spark, folder):
    scaled, _ = log_scaling(table(spark, folder, "orders"), ["o_totalprice"])
    return rounded(scaled, 6, "o_totalprice").select("o_orderkey", "o_totalprice")


@registry.add("scaler_inverse", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders")
def scaler_inverse(spark, folder):
    return _scaler(spark, folder, "robust", inverse=True)


@registry.add(
    "scaler_parameters",
    f"""WITH {_TRAIN} SELECT 'o_totalprice' AS "column", unnest(['mean', 'std']) AS stat,
        unnest([round(avg(o_totalprice), 4), round(stddev_samp(o_totalprice), 4)]) AS value FROM train""",
)
def scaler_parameters(spark, folder):
    orders = table(spark, folder, "orders")
    scaler = Scaler.from_dict(Scaler("standard").fit(_train(orders), ["o_totalprice"]).to_dict())
    return rounded(scaler.parameter_table(orders), 4, "value")
