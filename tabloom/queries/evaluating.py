"""Metric, comparison and error-analysis queries on pseudo-predictions computed from the tables."""

from pyspark.sql import Window, functions as F

from tabloom.operators import analysis, compare, metrics
from tabloom.queries import Registry, table
from tabloom.queries.engineering import LINE_KEY, rounded

registry = Registry()

# Three classes: the order status, guessed right for seven orders in ten.
GUESSED = """guessed AS (
  SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus AS y_true,
         CASE WHEN (o_orderkey * 7 + o_custkey) % 10 < 7 THEN o_orderstatus
              WHEN (o_orderkey + o_custkey) % 2 = 0 THEN 'F' ELSE 'O' END AS y_pred FROM orders)"""
CELLS = "cells AS (SELECT y_true, y_pred, count(*) AS n FROM guessed GROUP BY 1, 2)"
CLASSES = """classes AS (
  SELECT label, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(c)::BIGINT AS correct FROM (
    SELECT y_true AS label, n AS s, 0 AS p, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS c FROM cells
    UNION ALL SELECT y_pred, 0, n, 0 FROM cells) GROUP BY 1)"""
SCORES = """scores AS (
  SELECT *, coalesce(correct / nullif(predicted, 0), 0) AS p, coalesce(correct / nullif(support, 0), 0) AS r,
         coalesce(2 * correct / nullif(support + predicted, 0), 0) AS f FROM classes)"""

# Two classes: whether an order is large, with a noisy score.
SCORED = """scored AS (
  SELECT o_orderkey, o_orderpriority, (o_totalprice > 250000)::INTEGER AS y_true,
         (o_totalprice / 5e5 + (o_orderkey % 17) / 17e0) / 2 AS score FROM orders)"""
BINARY = "guessed AS (SELECT y_true, (score > 0.5)::INTEGER AS y_pred FROM scored)"

# Regression: the price of a line from its quantity and part.
FITTED = """fitted AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice AS y,
         l_quantity * 2100 + (l_partkey % 100) * 10 AS p,
         l_extendedprice - (l_quantity * 2100 + (l_partkey % 100) * 10) AS r FROM lineitem)"""


def guessed(spark, folder):
    right = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 10 < 7
    other = F.when((F.col("o_orderkey") + F.col("o_custkey")) % 2 == 0, "F").otherwise("O")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        "o_totalprice",
        F.col("o_orderstatus").alias("y_true"),
        F.when(right, F.col("o_orderstatus")).otherwise(other).alias("y_pred"),
    )


def cells(spark, folder):
    return metrics.confusion_counts(guessed(spark, folder), "y_true", "y_pred")


def scored(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        (F.col("o_totalprice") > 250000).cast("int").alias("y_true"),
        ((F.col("o_totalprice") / 5e5 + (F.col("o_orderkey") % 17) / 17.0) / 2).alias("score"),
    )


def fitted(spark, folder):
    return table(spark, folder, "lineitem").select(
        *LINE_KEY,
        "l_returnflag",
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 2100 + (F.col("l_partkey") % 100) * 10).alias("p"),
    )


@registry.add(
    "confusion_matrix",
    f"""WITH {GUESSED}, {CELLS}, l AS (SELECT y_true AS v FROM cells UNION SELECT y_pred FROM cells)
        SELECT a.v AS y_true, b.v AS y_pred, coalesce(n, 0) AS n FROM l a CROSS JOIN l b
        LEFT JOIN cells ON y_true = a.v AND y_pred = b.v""",
)
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(cells(spark, folder))


@registry.add(
    "per_class_metrics",
    f"""WITH {GUESSED}, {CELLS}, {CLASSES}, {SCORES}
        SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support, correct FROM scores""",
)
def per_class_metrics(spark, folder):
    return rounded(metrics.per_class_metrics(cells(spark, folder)), 6, "precision", "recall", "f1")


_SUMMARY = "round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1"
_REST = """count(*) FILTER (support > 0) AS n_classes, sum(support)::BIGINT AS n_rows,
    round(max(support) / greatest(min(support), 1), 2) AS class_imbalance_ratio"""


@registry.add(
    "classification_metrics",
    f"""WITH {GUESSED}, {CELLS}, {CLASSES}, {SCORES}
        SELECT round(sum(correct) / sum(support), 6) AS accuracy,
        {_SUMMARY.format(**{k: f'sum({k} * support) / sum(support)' for k in 'prf'})}, {_REST} FROM scores""",
)
def classification_metrics(spark, folder):
    return rounded(metrics.classification_summary(cells(spark, folder)), 6, "accuracy", "precision", "recall", "f1")


@registry.add(
    "classification_metrics_binary",
    f"""WITH {SCORED}, {BINARY}, {CELLS}, {CLASSES}, {SCORES}
        SELECT round(sum(correct) / sum(support), 6) AS accuracy,
        {_SUMMARY.format(**{k: f'max({k}) FILTER (label = 1)' for k in 'prf'})}, {_REST} FROM scores""",
)
def classification_metrics_binary(spark, folder):
    predicted = scored(spark, folder).withColumn("y_pred", (F.col("score") > 0.5).cast("int"))
    found = metrics.classification_summary(metrics.confusion_counts(predicted, "y_true", "y_pred"))
    return rounded(found, 6, "accuracy", "precision", "recall", "f1")


def _auc_sql(by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}round((sum(CASE WHEN y_true = 1 THEN k END) - sum(y_true) * (sum(y_true) + 1) / 2e0)
          / (sum(y_true)::DOUBLE * (count(*) - sum(y_true))), 6) AS roc_auc
        FROM (SELECT *, rank() OVER ({part} ORDER BY score)
              + (count(*) OVER (PARTITION BY {keys}score) - 1) / 2e0 AS k FROM scored) {'GROUP BY ' + by if by else ''}"""


@registry.add("roc_auc", f"WITH {SCORED} {_auc_sql()}")
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(scored(spark, folder), "y_true", "score"), 6, "roc_auc")


@registry.add("roc_auc_by_group", f"WITH {SCORED} {_auc_sql('o_orderpriority')}")
def roc_auc_by_group(spark, folder):
    return rounded(metrics.roc_auc(scored(spark, folder), "y_true", "score", by="o_orderpriority"), 6, "roc_auc")


_OVR = {"F": 3, "O": 4, "P": 5}


def _ovr_part(label: str, factor: int) -> str:
    return f"""SELECT '{label}' AS c, (o_orderstatus = '{label}')::INTEGER AS y_true,
        ((o_orderkey * {factor} + o_custkey) % 101) / 101e0 + CASE WHEN o_orderstatus = '{label}' THEN 0.3e0 ELSE 0e0 END AS score
        FROM orders"""


@registry.add(
    "roc_auc_one_vs_rest",
    f"""WITH scored AS ({' UNION ALL '.join(_ovr_part(k, v) for k, v in _OVR.items())}),
        a AS ({_auc_sql('c').replace('round(', '(').replace(', 6) AS roc_auc', ') AS roc_auc')}),
        n AS (SELECT c, sum(y_true) AS pos FROM scored GROUP BY 1)
        SELECT round(sum(roc_auc * pos) / sum(pos), 6) AS roc_auc FROM a JOIN n USING (c)""",
)
def roc_auc_one_vs_rest(spark, folder):
    orders = table(spark, folder, "orders")
    parts = [
        ((F.col("o_orderkey") * v + F.col("o_custkey")) % 101) / 101.0 + F.when(F.col("o_orderstatus") == k, 0.3).otherwise(0.0)
        for k, v in _OVR.items()
    ]
    table_ = orders.select("o_orderstatus", F.array(*parts).alias("probability"))
    return rounded(metrics.roc_auc_ovr(table_, "o_orderstatus", "probability", list(_OVR)), 6, "roc_auc")


_REGRESSION = """round(1 - sum(r * r) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(r)), 4) AS mae,
    round(sqrt(avg(r * r)), 4) AS rmse, round(avg(abs(r / nullif(y, 0))) * 100, 4) AS mape, round(avg(r), 4) AS residual_mean,
    round(stddev_pop(r), 4) AS residual_std, round(min(r), 4) AS residual_min, round(max(r), 4) AS residual_max,
    round(skewness(r), 6) AS residual_skew"""
_REGRESSION_NAMES = ["mae", "rmse", "mape", "residual_mean", "residual_std", "residual_min", "residual_max"]


@registry.add("regression_metrics", f"WITH {FITTED} SELECT {_REGRESSION} FROM fitted")
def regression_metrics(spark, folder):
    found = metrics.regression_metrics(fitted(spark, folder), "y", "p")
    return rounded(rounded(found, 4, *_REGRESSION_NAMES), 6, "r2", "residual_skew")


@registry.add(
    "regression_metrics_by_group", f"WITH {FITTED} SELECT l_returnflag, {_REGRESSION} FROM fitted GROUP BY l_returnflag"
)
def regression_metrics_by_group(spark, folder):
    found = metrics.regression_metrics(fitted(spark, folder), "y", "p", by="l_returnflag")
    return rounded(rounded(found, 4, *_REGRESSION_NAMES), 6, "r2", "residual_skew")


# Error analysis

RATES = f"""{GUESSED}, {CELLS}, {CLASSES}, rates AS (
  SELECT label, support AS total, correct, support - correct AS errors,
         round(coalesce((support - correct) / nullif(support, 0), 0), 4) AS error_rate FROM classes)"""


@registry.add("class_error_rates", f"WITH {RATES} SELECT * FROM rates")
def class_error_rates(spark, folder):
    return analysis.class_error_rates(cells(spark, folder))


@registry.add(
    "error_totals",
    f"""WITH {RATES} SELECT sum(total)::BIGINT AS total_samples, sum(correct)::BIGINT AS total_correct,
        round(1 - sum(correct) / sum(total), 4) AS overall_error_rate,
        first(label ORDER BY error_rate DESC, label) AS hardest_class FROM rates""",
)
def error_totals(spark, folder):
    return analysis.error_totals(cells(spark, folder))


@registry.add(
    "confused_pairs",
    f"""WITH {GUESSED}, {CELLS} SELECT y_true AS true_class, y_pred AS predicted_as, n AS "count",
        round(n / t, 4) AS rate_of_true_class FROM (SELECT *, sum(n) OVER (PARTITION BY y_true) AS t FROM cells)
        WHERE y_true <> y_pred ORDER BY n DESC, 1, 2 LIMIT 5""",
)
def confused_pairs(spark, folder):
    return analysis.confused_pairs(cells(spark, folder))


@registry.add(
    "misclassified",
    f"""WITH {GUESSED} SELECT o_orderkey, y_true, y_pred, o_totalprice, o_orderpriority FROM guessed
        WHERE y_true <> y_pred ORDER BY o_orderkey LIMIT 10""",
)
def misclassified(spark, folder):
    features = ["o_totalprice", "o_orderpriority"]
    return analysis.misclassified(guessed(spark, folder), "y_true", "y_pred", "o_orderkey", features)


@registry.add(
    "residual_summary",
    f"""WITH {FITTED} SELECT round(avg(r), 4) AS mean_residual,
        CASE WHEN avg(r) < 0 THEN 'over-predicts' WHEN avg(r) > 0 THEN 'under-predicts' ELSE 'unbiased' END AS direction,
        round(stddev_pop(r), 4) AS std_residual, round(corr(p, abs(r)), 6) AS pred_vs_residual_corr,
        abs(corr(p, abs(r))) > 0.3 AS heteroscedastic, round(skewness(r), 6) AS skewness, round(kurtosis(r), 6) AS kurtosis,
        abs(skewness(r)) < 1 AND abs(kurtosis(r)) < 3 AS approximately_normal FROM fitted""",
)
def residual_summary(spark, folder):
    found = analysis.residual_summary(fitted(spark, folder), "y", "p")
    return rounded(
        rounded(found, 4, "mean_residual", "std_residual"), 6, "pred_vs_residual_corr", "skewness", "kurtosis"
    )


@registry.add(
    "error_percentiles",
    f"""WITH {FITTED} SELECT unnest([50, 75, 90, 95, 99]) AS percentile,
        unnest(list_transform(quantile_cont(abs(r), [0.5, 0.75, 0.9, 0.95, 0.99]), lambda q: round(q, 4))) AS abs_error FROM fitted""",
)
def error_percentiles(spark, folder):
    return rounded(analysis.error_percentiles(fitted(spark, folder), "y", "p"), 4, "abs_error")


@registry.add(
    "worst_predictions",
    f"""WITH {FITTED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, y, p, round(abs(r), 4) AS abs_error, l_returnflag
        FROM fitted ORDER BY abs(r) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10""",
)
def worst_predictions(spark, folder):
    found = analysis.worst_predictions(fitted(spark, folder), "y", "p", LINE_KEY, ["l_returnflag"])
    return rounded(found, 4, "abs_error")


# Comparison of models: one pseudo-model per market segment

RUNS = """runs AS (
  SELECT o_custkey AS run_id, c_mktsegment AS model_type, avg((o_orderstatus = 'F')::INTEGER) AS accuracy,
         avg((o_orderpriority < '3')::INTEGER) AS f1, avg(o_totalprice) AS mae, count(*)::DOUBLE AS training_time_s
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


def runs(spark, folder):
    """One run per customer, with metrics from the orders; aggregated before the join."""
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("accuracy"),
        F.avg((F.col("o_orderpriority") < "3").cast("int")).alias("f1"),
        F.avg("o_totalprice").alias("mae"),
        F.count("*").cast("double").alias("training_time_s"),
    )
    names = ["accuracy", "f1", "mae", "training_time_s"]
    return orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("run_id"),
        F.col("c_mktsegment").alias("model_type"),
        F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("metrics"),
    )


@registry.add(
    "rank_runs",
    f"""WITH {RUNS} SELECT run_id, model_type, 'accuracy' AS metric_used, round(accuracy, 6) AS metric_value,
        row_number() OVER (ORDER BY accuracy DESC, run_id)::INTEGER AS rank FROM runs""",
)
def rank_runs(spark, folder):
    ranked = compare.rank_runs(runs(spark, folder), "accuracy")
    return rounded(ranked, 6, "metric_value").select("run_id", "model_type", "metric_used", "metric_value", "rank")


@registry.add(
    "rank_runs_lower_is_better",
    f"""WITH {RUNS} SELECT run_id, 'mae' AS metric_used, row_number() OVER (ORDER BY round(mae, 4), run_id)::INTEGER AS rank FROM runs""",
)
def rank_runs_lower_is_better(spark, folder):
    shortened = runs(spark, folder).withColumn("metrics", F.transform_values("metrics", lambda k, v: F.round(v, 4)))
    return compare.rank_runs(shortened, "mae").select("run_id", "metric_used", "rank")


@registry.add(
    "winner",
    f"""WITH {RUNS}, t AS (SELECT *, lead(accuracy) OVER (ORDER BY accuracy DESC, run_id) AS second,
            row_number() OVER (ORDER BY accuracy DESC, run_id) AS k FROM runs)
        SELECT run_id, model_type, round(accuracy, 6) AS metric_value, round(accuracy - second, 4) AS margin_over_second,
               accuracy - second > 0.01 AS clearly_better FROM t WHERE k = 1""",
)
def winner(spark, folder):
    return rounded(compare.winner(runs(spark, folder)), 6, "metric_value")


@registry.add(
    "best_model",
    f"""WITH {RUNS}, t AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, run_id) AS k FROM runs QUALIFY k <= 2),
        p AS (SELECT max(accuracy) - min(accuracy) <= 0.01 AS tied FROM t)
        SELECT run_id, model_type, round(accuracy, 6) AS accuracy FROM t, p
        ORDER BY CASE WHEN tied THEN training_time_s END, k LIMIT 1""",
)
def best_model(spark, folder):
    best = compare.find_best_model(runs(spark, folder))["best_run"]
    row = (best["run_id"], best["model_type"], round(best["metric_value"], 6))
    return spark.createDataFrame([row], "run_id long, model_type string, accuracy double")


SEGMENT_PREDICTIONS = """sp AS (
  SELECT c_mktsegment AS model, o_orderkey, o_orderkey % 10 AS fold, (o_totalprice > 250000)::INTEGER AS y_true,
         (o_totalprice + (c_acctbal - 4500) * 10 > 250000)::INTEGER AS y_pred
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


def segment_predictions(spark, folder):
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("c_mktsegment").alias("model"),
        "o_orderkey",
        (F.col("o_orderkey") % 10).alias("fold"),
        (F.col("o_totalprice") > 250000).cast("int").alias("y_true"),
        (F.col("o_totalprice") + (F.col("c_acctbal") - 4500) * 10 > 250000).cast("int").alias("y_pred"),
    )


@registry.add(
    "mcnemar_totals",
    f"""WITH {SEGMENT_PREDICTIONS}, c AS (SELECT model, count(*) FILTER (y_true = y_pred) AS ok FROM sp GROUP BY 1),
        g AS (SELECT model AS model_a, lead(model) OVER (ORDER BY model) AS model_b, lead(ok) OVER (ORDER BY model) - ok AS gap
              FROM c QUALIFY model_b IS NOT NULL)
        SELECT model_a, model_b, greatest(gap, 0) AS discordant_n01, greatest(-gap, 0) AS discordant_n10,
               round(coalesce((abs(gap) - 1) ** 2 / nullif(abs(gap), 0), 0), 6) AS statistic,
               gap <> 0 AND (abs(gap) - 1) ** 2 / nullif(abs(gap), 0)::DOUBLE > 3.841458820694124 AS significant FROM g""",
)
def mcnemar_totals(spark, folder):
    counted = metrics.confusion_counts(segment_predictions(spark, folder), "y_true", "y_pred", by="model")
    cell = lambda t, p: F.coalesce(F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.col("n"))), F.lit(0))
    matrix = F.array(F.array(cell(0, 0), cell(0, 1)), F.array(cell(1, 0), cell(1, 1)))
    matrices = counted.groupBy("model").agg(matrix.alias("m"))
    # One row per model from here on; each is tested against the next.
    order = Window.orderBy("model")
    pairs = matrices.select(
        F.col("model").alias("model_a"),
        F.col("m").alias("m_a"),
        F.lead("model").over(order).alias("model_b"),
        F.lead("m").over(order).alias("m_b"),
    ).where("model_b IS NOT NULL")
    tested = compare.mcnemar_by_totals(pairs, "m_a", "m_b")
    columns = ["model_a", "model_b", "discordant_n01", "discordant_n10", "statistic", "significant"]
    return rounded(tested, 6, "statistic").select(*columns)


@registry.add(
    "mcnemar_rows",
    f"""WITH {GUESSED}, b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE y_true END AS p FROM guessed),
        n AS (SELECT count(*) FILTER (y_true <> y_pred AND y_true = p) AS n01,
                     count(*) FILTER (y_true = y_pred AND y_true <> p) AS n10 FROM guessed JOIN b USING (o_orderkey))
        SELECT n01 AS discordant_n01, n10 AS discordant_n10,
               round((abs(n01 - n10) - 1) ** 2 / nullif(n01 + n10, 0)::DOUBLE, 6) AS statistic,
               (abs(n01 - n10) - 1) ** 2 / nullif(n01 + n10, 0)::DOUBLE > 3.841458820694124 AS significant FROM n""",
)
def mcnemar_rows(spark, folder):
    a = guessed(spark, folder)
    b = a.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "P").otherwise(F.col("y_true")).alias("p"), "y_true")
    tested = compare.mcnemar_by_rows(a, b, "o_orderkey", "y_true", "y_pred", "p")
    return rounded(tested, 6, "statistic").select("discordant_n01", "discordant_n10", "statistic", "significant")


@registry.add(
    "welch_test",
    f"""WITH {SEGMENT_PREDICTIONS}, f AS (SELECT model, fold, avg((y_true = y_pred)::INTEGER) AS v FROM sp
             WHERE model IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2),
        s AS (SELECT model, count(*) AS n, avg(v) AS m, var_samp(v) / count(*) AS e FROM f GROUP BY 1)
        SELECT round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b, round(a.m - b.m, 6) AS diff,
               round((a.m - b.m) / sqrt(a.e + b.e), 4) AS statistic,
               round((a.e + b.e) ** 2 / (a.e ** 2 / (a.n - 1) + b.e ** 2 / (b.n - 1)), 4) AS freedom
        FROM s a, s b WHERE a.model = 'BUILDING' AND b.model = 'MACHINERY'""",
)
def welch_test(spark, folder):
    folds = segment_predictions(spark, folder).groupBy("model", "fold").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("v")
    )
    tested = compare.welch_test(folds, "model", "v", "BUILDING", "MACHINERY")
    return rounded(rounded(tested, 6, "mean_a", "mean_b", "diff"), 4, "statistic", "freedom").select(
        "mean_a", "mean_b", "diff", "statistic", "freedom"
    )


@registry.add(
    "wilson_interval",
    f"""WITH {SEGMENT_PREDICTIONS}, a AS (SELECT model, avg((y_true = y_pred)::INTEGER) AS p, count(*)::DOUBLE AS n,
             1.959963984540054e0 AS z FROM sp GROUP BY 1),
        i AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS c,
              z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM a)
        SELECT model, round(p, 6) AS accuracy, round(greatest(0, c - h), 6) AS lower, round(least(1, c + h), 6) AS upper FROM i""",
)
def wilson_interval(spark, folder):
    found = segment_predictions(spark, folder).groupBy("model").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"), F.count("*").alias("n")
    )
    lower, upper = metrics.wilson_bounds(F.col("accuracy"), F.col("n"))
    bounded = found.select("model", "accuracy", lower.alias("lower"), upper.alias("upper"))
    return rounded(bounded, 6, "accuracy", "lower", "upper")


@registry.add(
    "practical_significance",
    f"""WITH {RUNS} SELECT run_id, abs(accuracy - f1) > 0.01 AS practical FROM runs""",
)
def practical_significance(spark, folder):
    practical = compare.practically_significant(compare.metric_value("accuracy"), compare.metric_value("f1"))
    return runs(spark, folder).select("run_id", practical.alias("practical"))


# Tail probabilities in SQL: the error function by its series of positive terms, Student's density by Simpson's rule.
def _chi2_tail(statistic: str) -> str:
    terms = f"list_sum(list_transform(range(0, 300), lambda n: exp((2 * n + 1) * ln(sqrt(({statistic}) / 2)) - ({statistic}) / 2 - lgamma(n + 1.5e0))))"
    return f"CASE WHEN ({statistic}) = 0 THEN 1e0 WHEN ({statistic}) > 80 THEN 0e0 ELSE 1 - {terms} END"


def _student_tail(statistic: str, freedom: str) -> str:
    weight = "CASE WHEN n IN (0, 4000) THEN 1 WHEN n % 2 = 1 THEN 4 ELSE 2 END"
    density = f"exp(-({freedom} + 1) / 2 * ln(1 + (abs({statistic}) * n / 4000e0) ** 2 / {freedom}))"
    factor = f"exp(lgamma(({freedom} + 1) / 2) - lgamma({freedom} / 2)) / sqrt({freedom} * pi())"
    return f"1 - 2 * {factor} * abs({statistic}) / 12000e0 * list_sum(list_transform(range(0, 4001), lambda n: {weight} * {density}))"


@registry.add(
    "mcnemar_p_values",
    f"""WITH {GUESSED}, b AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'P' WHEN o_orderkey % 4 = 0 THEN y_true ELSE y_pred END AS p FROM guessed),
        n AS (SELECT o_orderpriority, count(*) FILTER (y_true <> y_pred AND y_true = p) AS n01,
                     count(*) FILTER (y_true = y_pred AND y_true <> p) AS n10 FROM b GROUP BY 1),
        s AS (SELECT *, (abs(n01 - n10) - 1) ** 2 / (n01 + n10)::DOUBLE AS s FROM n)
        SELECT o_orderpriority, round(s, 6) AS statistic, round({_chi2_tail("s")}, 6) AS p_value, {_chi2_tail("s")} < 0.05 AS significant FROM s""",
)
def mcnemar_p_values(spark, folder):
    """Two sets of predictions compared per order priority."""
    key, known = F.col("o_orderkey"), F.col("y_true") == F.col("y_pred")
    other = F.when(key % 5 == 0, "P").when(key % 4 == 0, F.col("y_true")).otherwise(F.col("y_pred"))
    counts = guessed(spark, folder).withColumn("p", other).groupBy("o_orderpriority").agg(
        F.count_if(~known & (F.col("y_true") == F.col("p"))).alias("n01"), F.count_if(known & (F.col("y_true") != F.col("p"))).alias("n10")
    )
    tested = counts.withColumns(compare.mcnemar_columns(F.col("n01"), F.col("n10")))
    return rounded(tested, 6, "statistic", "p_value").select("o_orderpriority", "statistic", "p_value", "significant")


@registry.add(
    "welch_p_value",
    f"""WITH {SEGMENT_PREDICTIONS}, f AS (SELECT model, fold, avg((y_true = y_pred)::INTEGER) AS v FROM sp
             WHERE model IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2),
        s AS (SELECT model, count(*) AS n, avg(v) AS m, var_samp(v) / count(*) AS e FROM f GROUP BY 1),
        t AS (SELECT (a.m - b.m) / sqrt(a.e + b.e) AS t, (a.e + b.e) ** 2 / (a.e ** 2 / (a.n - 1) + b.e ** 2 / (b.n - 1)) AS v
              FROM s a, s b WHERE a.model = 'BUILDING' AND b.model = 'MACHINERY')
        SELECT round({_student_tail("t", "v")}, 6) AS p_value, {_student_tail("t", "v")} < 0.05 AS significant FROM t""",
)
def welch_p_value(spark, folder):
    folds = segment_predictions(spark, folder).groupBy("model", "fold").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("v")
    )
    tested = compare.welch_test(folds, "model", "v", "BUILDING", "MACHINERY")
    return rounded(tested, 6, "p_value").select("p_value", "significant")


@registry.add(
    "compare_runs",
    f"""WITH {RUNS}, r AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, run_id) AS place FROM runs),
        g AS (SELECT max(accuracy) FILTER (place = 1) - max(accuracy) FILTER (place = 2) AS gap, count(*) AS n FROM r)
        SELECT run_id, model_type, round(accuracy, 6) AS metric_value, n AS total_runs, round(gap, 4) AS margin_over_second,
               gap > 0.01 AS practically_significant FROM r, g WHERE place = 1""",
)
def compare_runs(spark, folder):
    """The summary of a comparison of all runs."""
    found = compare.compare_runs(runs(spark, folder).withColumn("confusion_matrix", F.lit(None).cast("array<array<long>>")))
    best = found["winner"]
    row = (best["run_id"], best["model_type"], round(best["metric_value"], 6), found["total_runs"], best["margin_over_second"], found["practically_significant"])
    schema = "run_id long, model_type string, metric_value double, total_runs long, margin_over_second double, practically_significant boolean"
    return spark.createDataFrame([row], schema)
