"""Training queries: whole tables in, one row per fitted model out."""

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators.analysis import importance_table
from tabloom.operators.models import evaluate_model, fit_model, load_model, train_multiple
from tabloom.operators.prepare import feature_matrix, mean_impute, split
from tabloom.operators.scaler import Scaler
from tabloom.plans.workflow import WorkflowConfig, run_workflow
from tabloom.queries import Registry, table
from tabloom.queries.engineering import rounded
from tabloom.queries.selecting import TEXT_FEATURES, hash_sql, labelled_documents
from tabloom.session import checkpoint_folder, durable

registry = Registry()

DIMENSIONS = [f"e{i}" for i in range(64)]
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_suppkey"]


def _vectors(spark, folder, label="cast(e0 > 0 as int) * 2 + cast(e1 > 0 as int)"):
    """64 numeric features and the quadrant of the first two as the class."""
    dims = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(DIMENSIONS)]
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("key"), *dims)
    return vectors.withColumn("label", F.expr(label)), DIMENSIONS


def _documents(spark, folder):
    """Two classes."""
    docs = labelled_documents(spark, folder).withColumnRenamed("doc_id", "key")
    return docs.withColumnRenamed("quality", "label"), TEXT_FEATURES


def _lines(spark, folder):
    """A numeric target that depends on the first feature and on much else."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")
    lines = table(spark, folder, "lineitem").select(key, *LINE_FEATURES, (F.col("l_extendedprice") + 2000 * F.col("l_quantity")).alias("label"))
    return lines, LINE_FEATURES


def _train(spark, source, configs, task="classification"):
    """Results, the scaler that the models saw, and the two sides of the split."""
    df, features = source
    train, test = split(df, "key", 0.2, 42, "label" if task == "classification" else None)
    train, test = mean_impute(train, test, features)
    scaler = Scaler("standard").fit(train, features)
    train, test = durable(scaler.transform(train)), durable(scaler.transform(test))
    return train_multiple(train, features, "label", configs, test, task), scaler, train, test


def _checked(spark, source, configs, task="classification"):
    """Per model: rows on both sides, what predicting the commonest class (or the mean) scores on the test
    rows, and whether the model scores at least that."""
    results, _, train, test = _train(spark, source, configs, task)
    counts = [part.where("label is not null").count() for part in (train, test)]
    floor = 0.0
    if task == "classification":
        floor = test.where("label is not null").groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    rows = []
    for r in results:
        score = r.metrics["accuracy"] if task == "classification" else r.metrics["r2"]
        # Metrics come rounded to four digits.
        rows.append((r.model_type, task, *counts, round(float(floor), 6), bool(score >= round(floor, 4))))
    return spark.createDataFrame(rows, "model_type string, task string, n_train long, n_test long, baseline double, reaches_baseline boolean")


_CLASSES = {
    "vectors": "SELECT (embedding[1] > 0)::INTEGER * 2 + (embedding[2] > 0)::INTEGER AS label, " + hash_sql("vec_id") + " AS h FROM embeddings",
    "halves": "SELECT embedding[1]::DOUBLE + embedding[2]::DOUBLE > 0 AS label, " + hash_sql("vec_id") + " AS h FROM embeddings",
    "documents": "SELECT quality AS label, " + hash_sql("doc_id") + " AS h FROM documents JOIN labels USING (doc_id)",
}


def _class_sql(source, *models):
    """The stratified split has exactly the rows of the least hashes of each class on the test side."""
    return f"""WITH h AS ({_CLASSES[source]}), s AS (
          SELECT label, row_number() OVER (PARTITION BY label ORDER BY h) <= floor(0.2 * count(*) OVER (PARTITION BY label) + 0.5) AS in_test
          FROM h WHERE label IS NOT NULL),
        c AS (SELECT label, count(*) AS n FROM s WHERE in_test GROUP BY 1)
        SELECT m.model_type, 'classification' AS task, (SELECT count(*) FROM s WHERE NOT in_test) AS n_train,
          (SELECT count(*) FROM s WHERE in_test) AS n_test, (SELECT round(max(n) / sum(n)::DOUBLE, 6) FROM c) AS baseline,
          true AS reaches_baseline FROM (VALUES {", ".join(f"('{m}')" for m in models)}) AS m(model_type)"""


def _line_sql(model):
    key = "(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey)"
    return f"""WITH s AS (SELECT ({hash_sql(key)} >> 28)::DOUBLE / 4294967296 < 0.2 AS in_test FROM lineitem)
        SELECT '{model}' AS model_type, 'regression' AS task, count(*) FILTER (NOT in_test) AS n_train,
          count(*) FILTER (in_test) AS n_test, 0e0 AS baseline, true AS reaches_baseline FROM s"""


@registry.add("train_logistic_regression", _class_sql("vectors", "logistic_regression"))
def train_logistic_regression(spark, folder):
    return _checked(spark, _vectors(spark, folder), [{"type": "logistic_regression"}])


@registry.add("train_linear_regression", _line_sql("logistic_regression"))
def train_linear_regression(spark, folder):
    return _checked(spark, _lines(spark, folder), [{"type": "logistic_regression"}], "regression")


@registry.add(
    "linear_regression_line",
    """SELECT round(regr_slope(l_extendedprice, l_partkey), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_partkey), 4) AS intercept FROM lineitem""",
)
def linear_regression_line(spark, folder):
    model = fit_model(table(spark, folder, "lineitem"), ["l_partkey"], "l_extendedprice", "logistic_regression", task="regression")
    line = model.stages.stages[-1]
    row = (round(float(line.coefficients[0]), 6), round(float(line.intercept), 4))
    return spark.createDataFrame([row], "slope double, intercept double")


@registry.add(
    "linear_regression_plane",
    """WITH m AS (SELECT covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_partkey, l_partkey) AS bb,
         covar_pop(l_quantity, l_partkey) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay,
         covar_pop(l_partkey, l_extendedprice) AS b_y, avg(l_quantity) AS ma, avg(l_partkey) AS mb, avg(l_extendedprice) AS my FROM lineitem),
       c AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS a, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS b FROM m)
       SELECT round(a, 4) AS quantity, round(b, 4) AS part, round(my - a * ma - b * mb, 2) AS intercept FROM c""",
)
def linear_regression_plane(spark, folder):
    """Normal equations of two features."""
    model = fit_model(table(spark, folder, "lineitem"), ["l_quantity", "l_partkey"], "l_extendedprice", "logistic_regression", task="regression")
    plane = model.stages.stages[-1]
    row = (*(round(float(c), 4) for c in plane.coefficients), round(float(plane.intercept), 2))
    return spark.createDataFrame([row], "quantity double, part double, intercept double")


@registry.add("train_svm", _class_sql("documents", "svm"))
def train_svm(spark, folder):
    return _checked(spark, _documents(spark, folder), [{"type": "svm"}])


@registry.add("train_svm_regression", _line_sql("svm"))
def train_svm_regression(spark, folder):
    return _checked(spark, _lines(spark, folder), [{"type": "svm"}], "regression")


@registry.add("train_random_forest", _class_sql("vectors", "random_forest"))
def train_random_forest(spark, folder):
    return _checked(spark, _vectors(spark, folder), [{"type": "random_forest"}])


@registry.add("train_boosted_trees", _line_sql("xgboost"))
def train_boosted_trees(spark, folder):
    return _checked(spark, _lines(spark, folder), [{"type": "xgboost"}], "regression")


@registry.add("train_neural_network", _class_sql("vectors", "neural_network"))
def train_neural_network(spark, folder):
    return _checked(spark, _vectors(spark, folder), [{"type": "neural_network"}])


@registry.add("train_several", _class_sql("halves", "logistic_regression", "random_forest", "xgboost"))
def train_several(spark, folder):
    configs = [{"type": "logistic_regression"}, {"type": "random_forest"}, {"type": "xgboost"}]
    return _checked(spark, _vectors(spark, folder, "e0 + e1 > 0"), configs)


@registry.add(
    "feature_importance",
    """WITH s AS (SELECT abs(regr_slope(l_extendedprice, l_quantity)) AS q FROM lineitem)
       SELECT 'l_quantity' AS feature, round(q, 4) AS importance FROM s""",
)
def feature_importance(spark, folder):
    """Absolute coefficients of a line."""
    model = fit_model(table(spark, folder, "lineitem"), ["l_quantity"], "l_extendedprice", "logistic_regression", task="regression")
    return rounded(importance_table(table(spark, folder, "lineitem"), model.importances()[0]), 4, "importance").select("feature", "importance")


@registry.add("forest_importance")
def forest_importance(spark, folder):
    results, *_ = _train(spark, _lines(spark, folder), [{"type": "random_forest"}], "regression")
    return importance_table(table(spark, folder, "lineitem"), results[0].model.importances()[0])


_STUMP_FEATURES = ["l_quantity", "l_discount", "l_tax"]
# Features in single precision, as the trees see them; per cut the sums of both sides.
_CUTS = """x AS (UNPIVOT (SELECT l_extendedprice AS y, l_quantity::FLOAT::DOUBLE AS l_quantity, l_discount::FLOAT::DOUBLE AS l_discount,
        l_tax::FLOAT::DOUBLE AS l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME feature VALUE v),
      v AS (SELECT feature, v, count(*) AS n, sum(y) AS s FROM x GROUP BY 1, 2),
      c AS (SELECT feature, v, lead(v) OVER f AS above, sum(n) OVER f AS nl, sum(s) OVER f AS sl, sum(n) OVER (PARTITION BY feature) AS n,
        sum(s) OVER (PARTITION BY feature) AS s FROM v WINDOW f AS (PARTITION BY feature ORDER BY v))"""


@registry.add(
    "forest_stump",
    f"""WITH {_CUTS} SELECT feature, round((v + above) / 2, 6) AS threshold, round(sl / nl, 4) AS left_value, round((s - sl) / (n - nl), 4) AS right_value
        FROM c WHERE above IS NOT NULL ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1""",
)
def forest_stump(spark, folder):
    """One split of all rows: the cut with the least squared error over all features and values."""
    whole = {"n_estimators": 1, "max_depth": 1, "max_features": None, "bootstrap": False}
    model = fit_model(table(spark, folder, "lineitem"), _STUMP_FEATURES, "l_extendedprice", "random_forest", whole, "regression")
    return _stump(spark, model.own.whole_trees()[0], 6)


@registry.add(
    "boosted_stump",
    f"""WITH {_CUTS}, g AS (SELECT *, nl * s / n - sl AS gl FROM c WHERE above IS NOT NULL)
        SELECT feature, round(v, 6) AS threshold, round(-0.1 * gl / (nl + 1), 4) AS left_value, round(0.1 * gl / (n - nl + 1), 4) AS right_value
        FROM g ORDER BY gl * gl / (nl + 1) + gl * gl / (n - nl + 1) DESC LIMIT 1""",
)
def boosted_stump(spark, folder):
    """The first round: gradients are the errors of the mean, each row has curvature 1, leaves shrink by the penalty."""
    one = {"n_estimators": 1, "max_depth": 1, "subsample": 1.0, "colsample_bytree": 1.0}
    model = fit_model(table(spark, folder, "lineitem"), _STUMP_FEATURES, "l_extendedprice", "xgboost", one, "regression")
    return _stump(spark, model.own.rounds[0][0], 6)


def _stump(spark, tree, digits):
    left = int(tree.left[0])
    row = (_STUMP_FEATURES[int(tree.feature[0])], round(float(tree.threshold[0]), digits), round(float(tree.value[left]), 4), round(float(tree.value[left + 1]), 4))
    return spark.createDataFrame([row], "feature string, threshold double, left_value double, right_value double")


@registry.add(
    "network_without_layers",
    """SELECT round(regr_slope(y, x), 1) AS slope FROM (SELECT l_quantity / 50 AS x, 10 * l_quantity + l_discount AS y FROM lineitem)""",
)
def network_without_layers(spark, folder):
    """A network of one linear unit is a line: its slope is that of least squares."""
    lines = table(spark, folder, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (10 * F.col("l_quantity") + F.col("l_discount")).alias("y"))
    plain = {"hidden_layer_sizes": (), "alpha": 0.0, "early_stopping": False, "tol": 1e-9, "max_iter": 60, "learning_rate_init": 0.01, "n_iter_no_change": 60}
    model = fit_model(lines, ["x"], "y", "neural_network", plain, "regression").own
    return spark.createDataFrame([(round(float(model.theta[0]) * model.target[1], 1),)], "slope double")


@registry.add("batch_predictions")
def batch_predictions(spark, folder):
    df, features = _vectors(spark, folder)
    results, scaler, *_ = _train(spark, (df, features), [{"type": "logistic_regression"}])
    return results[0].model.transform(scaler.transform(df)).select("key", "prediction")


_TRAINED_LINE = f"""WITH s AS (SELECT o_orderkey, o_custkey AS x, o_totalprice AS y, ({hash_sql('o_orderkey')} >> 28)::DOUBLE / 4294967296 < 0.2 AS in_test FROM orders),
    l AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s WHERE NOT in_test)
    SELECT o_orderkey AS key, round(a + b * x, 2) AS prediction FROM s, l"""


def _order_line(spark, folder):
    """A line through the training orders, and all orders scaled as the line saw them."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", F.col("o_totalprice").alias("label"))
    results, scaler, *_ = _train(spark, (orders, ["o_custkey"]), [{"type": "logistic_regression"}], "regression")
    return results[0].model, scaler.transform(orders)


@registry.add("batch_predictions_line", _TRAINED_LINE)
def batch_predictions_line(spark, folder):
    model, orders = _order_line(spark, folder)
    return rounded(model.transform(orders).select("key", "prediction"), 2, "prediction")


@registry.add("saved_model", _TRAINED_LINE)
def saved_model(spark, folder):
    """The same from a model that was written and read again."""
    model, orders = _order_line(spark, folder)
    loaded = load_model(model.save(f"{checkpoint_folder(spark)}/model-{uuid.uuid4().hex}"))
    return rounded(loaded.transform(orders).select("key", "prediction"), 2, "prediction")


@registry.add("feature_matrix", "SELECT o_orderkey, o_custkey::DOUBLE AS first, o_totalprice AS second FROM orders")
def feature_vectors(spark, folder):
    matrix = feature_matrix(table(spark, folder, "orders"), ["o_custkey", "o_totalprice"])
    cells = vector_to_array("features")
    return matrix.select("o_orderkey", cells[0].alias("first"), cells[1].alias("second"))


@registry.add(
    "auc_of_shifted_labels",
    """WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS y, l_quantity AS x FROM lineitem WHERE l_returnflag <> 'N'),
        p AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS r FROM s),
        a AS (SELECT sum(r) FILTER (y = 2) AS rs, count(*) FILTER (y = 2) AS n2, count(*) FILTER (y = 1) AS n1 FROM p),
        u AS (SELECT (rs - n2 * (n2 + 1) / 2e0) / (n1 * n2::DOUBLE) AS auc FROM a)
        SELECT round(greatest(auc, 1 - auc), 4) AS roc_auc FROM u""",
)
def auc_of_shifted_labels(spark, folder):
    """A monotone score of one feature, labels 1 and 2: the area is that of the feature's ranks, on its better side."""
    flag = F.col("l_returnflag")
    lines = table(spark, folder, "lineitem").where(flag != "N").select("l_quantity", F.when(flag == "R", 2).otherwise(1).alias("y"))
    model = fit_model(lines, ["l_quantity"], "y", "logistic_regression", {"penalty": None})
    return spark.createDataFrame([(evaluate_model(model, lines, "y")["roc_auc"],)], "roc_auc double")


@registry.add(
    "training_workflow",
    f"""WITH s AS (SELECT row_number() OVER (PARTITION BY o_totalprice > 250000 ORDER BY {hash_sql('o_orderkey')})
          <= floor(0.2 * count(*) OVER (PARTITION BY o_totalprice > 250000) + 0.5) AS in_test, o_totalprice > 250000 AS large FROM orders),
        c AS (SELECT large, count(*) AS n FROM s WHERE in_test GROUP BY 1)
        SELECT m.model_type, (SELECT count(*) FROM s WHERE NOT in_test) AS n_train, (SELECT sum(n)::BIGINT FROM c) AS n_test,
          (SELECT round(max(n) / sum(n)::DOUBLE, 6) FROM c) AS baseline, true AS reaches_baseline
        FROM (VALUES ('logistic_regression'), ('random_forest')) AS m(model_type)""",
)
def training_workflow(spark, folder):
    config = WorkflowConfig(
        dataset_path=f"{folder}/orders.parquet",
        target_col="large",
        key="o_orderkey",
        order_by="o_orderkey",
        models=[
            {"type": "logistic_regression"},
            {"type": "random_forest"},
        ],
        feature_spec={
            "features": [
                {"name": "month", "source": "time", "base": "o_orderdate", "component": "month"},
                {"name": "priority", "source": "encoding", "base": "o_orderpriority"},
                {"name": "recent", "source": "rolling", "base": "noise", "window": 5},
            ]
        },
    )
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderdate",
        "o_orderpriority",
        (F.col("o_totalprice") > 250000).cast("int").alias("large"),
        (F.col("o_totalprice") + (key % 13) * 20000).alias("noise"),
    )
    result = run_workflow(spark, config, orders)
    rows = []
    for r in result.train_results:
        largest = max(c["support"] for c in r.metrics["per_class"].values()) / result.test_rows
        rows.append((r.model_type, result.train_rows, result.test_rows, round(largest, 6), r.metrics["accuracy"] >= round(largest, 4)))
    return spark.createDataFrame(rows, "model_type string, n_train long, n_test long, baseline double, reaches_baseline boolean")
