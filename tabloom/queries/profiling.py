"""Profiling queries."""

from pyspark.sql import functions as F

from tabloom.operators import profile
from tabloom.queries import Registry, table

registry = Registry()

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def holed_events(spark, folder):
    """Events with values and types missing in a fixed pattern; the pattern also has a long gap."""
    gap = (F.col("event_id") % 7 == 0) | (F.col("event_id") % 1000 > 900)
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(~gap, F.col("value")).alias("value"),
    )


HOLED = """holed AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 7 <> 0 AND event_id % 1000 <= 900 THEN value END AS value
  FROM events)"""

_MISSING = f"""WITH {HOLED}, n AS (SELECT count(*) AS n FROM holed), m AS (
  SELECT 0 AS position, 'event_id' AS "column", 'bigint' AS dtype, count(*) FILTER (event_id IS NULL) AS missing_count FROM holed
  UNION ALL SELECT 1, 'ts', 'timestamp_ntz', count(*) FILTER (ts IS NULL) FROM holed
  UNION ALL SELECT 2, 'user_id', 'bigint', count(*) FILTER (user_id IS NULL) FROM holed
  UNION ALL SELECT 3, 'event_type', 'string', count(*) FILTER (event_type IS NULL) FROM holed
  UNION ALL SELECT 4, 'value', 'double', count(*) FILTER (value IS NULL) FROM holed)
SELECT position, "column", dtype, missing_count, round(missing_count * 1e2 / n, 2) AS missing_pct FROM m, n"""


@registry.add("profile_shape", 'SELECT count(*) AS "rows", 11 AS "columns" FROM lineitem')
def profile_shape(spark, folder):
    return profile.shape(table(spark, folder, "lineitem"))


@registry.add("profile_missing", _MISSING)
def profile_missing(spark, folder):
    return profile.missing_report(holed_events(spark, folder))


@registry.add("profile_top_missing", f"SELECT * FROM ({_MISSING}) WHERE missing_pct > 0 ORDER BY missing_pct DESC LIMIT 20")
def profile_top_missing(spark, folder):
    return profile.top_missing(holed_events(spark, folder))


@registry.add(
    "profile_duplicates",
    """WITH t AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_partkey % 5 = 0)
       SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicates FROM t""",
)
def profile_duplicates(spark, folder):
    """All columns of a table that holds a fifth of its rows twice."""
    lines = table(spark, folder, "lineitem")
    return profile.duplicate_count(lines.unionAll(lines.where("l_partkey % 5 = 0")))


@registry.add(
    "profile_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS stat,
            unnest([count({c})::DOUBLE, round(avg({c}), 4), round(stddev_samp({c}), 4), min({c}),
                    round(quantile_cont({c}, 0.25), 4), round(quantile_cont({c}, 0.5), 4),
                    round(quantile_cont({c}, 0.75), 4), max({c})]) AS value FROM lineitem"""
        for c in LINE_NUMBERS
    ),
)
def profile_describe(spark, folder):
    stats = profile.describe_numeric(table(spark, folder, "lineitem"), LINE_NUMBERS)
    return stats.withColumn("value", F.round("value", 4))


@registry.add(
    "profile_categorical",
    f"WITH {HOLED}, c AS ("
    " SELECT 'event_type' AS \"column\", event_type AS value, count(*) AS n FROM holed WHERE event_type IS NOT NULL GROUP BY 2)"
    ' SELECT "column", count(*) AS "unique", first(value ORDER BY n DESC, value) AS top, max(n) AS freq FROM c GROUP BY 1'
    " UNION ALL SELECT * FROM (WITH c AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1)"
    " SELECT 'o_orderpriority', count(*), first(value ORDER BY n DESC, value), max(n) FROM c)"
    " UNION ALL SELECT * FROM (WITH c AS (SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1)"
    " SELECT 'o_orderstatus', count(*), first(value ORDER BY n DESC, value), max(n) FROM c)",
)
def profile_categorical(spark, folder):
    orders = profile.categorical_stats(table(spark, folder, "orders"))
    return profile.categorical_stats(holed_events(spark, folder)).unionByName(orders)


@registry.add(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
        for a in LINE_NUMBERS
        for b in LINE_NUMBERS
    ),
)
def correlation_matrix(spark, folder):
    corr = profile.correlation_matrix(table(spark, folder, "lineitem"), LINE_NUMBERS)
    return corr.withColumn("corr", F.round("corr", 6))


@registry.add(
    "correlation_matrix_wide",
    """WITH d AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
       SELECT 'e' || x.i AS a, 'e' || y.i AS b, round(corr(x.v, y.v), 6) AS corr
       FROM d x JOIN d y USING (vec_id) GROUP BY x.i, y.i""",
)
def correlation_matrix_wide(spark, folder):
    dims = table(spark, folder, "embeddings").select(*[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    return profile.correlation_matrix(dims).withColumn("corr", F.round("corr", 6))


@registry.add(
    "distribution_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
            round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis, min({c}) AS min, max({c}) AS max
            FROM {t}"""
        for t, c in [("lineitem", "l_quantity"), ("lineitem", "l_discount"), ("lineitem", "l_tax"), ("events", "value")]
    ),
)
def distribution_stats(spark, folder):
    lines = profile.distribution_stats(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    stats = lines.unionByName(profile.distribution_stats(table(spark, folder, "events"), ["value"]))
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std", "skewness", "kurtosis")})


@registry.add(
    "column_kinds",
    """WITH k AS (SELECT CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'Numeric'
            WHEN column_type LIKE 'TIMESTAMP%' THEN 'Datetime' ELSE 'Categorical' END AS kind FROM (DESCRIBE SELECT * FROM lineitem))
        SELECT kind, (SELECT count(*) FROM k WHERE k.kind = n.kind)::INTEGER AS n_columns
        FROM (VALUES ('Numeric'), ('Datetime'), ('Categorical')) n(kind)""",
)
def column_kinds(spark, folder):
    return profile.kind_counts(table(spark, folder, "lineitem"))
