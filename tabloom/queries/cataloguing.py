"""Catalogue and run-log queries on tables derived from customers and orders."""

import uuid

from pyspark.sql import functions as F

from tabloom.operators.compare import matrix_total
from tabloom.session import checkpoint_folder
from tabloom.sources import catalogue, tracking
from tabloom.queries import Registry, table
from tabloom.queries.engineering import rounded
from tabloom.queries.evaluating import RUNS, runs

registry = Registry()

TRAINING_RUNS = """training_runs AS (
  SELECT o_orderkey AS id, o_custkey AS project_id, o_custkey % 10 AS feature_set_id, o_orderpriority AS model_type,
         o_orderstatus AS status, o_orderdate AS created_at,
         CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 97) / 97e0 END AS accuracy,
         CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 89) / 89e0 END AS f1, (o_orderkey % 11)::DOUBLE AS training_time_s
  FROM orders)"""


def training_runs(spark, folder):
    """One training run per order; some runs lack a metric."""
    key = F.col("o_orderkey")
    metrics = {
        "accuracy": F.when(key % 3 != 0, (key % 97) / 97.0),
        "f1": F.when(key % 5 != 0, (key % 89) / 89.0),
        "training_time_s": (key % 11).cast("double"),
    }
    entries = F.create_map(*[x for n, v in metrics.items() for x in (F.lit(n), v)])
    return table(spark, folder, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("project_id"),
        (F.col("o_custkey") % 10).alias("feature_set_id"),
        F.col("o_orderpriority").alias("model_type"),
        F.col("o_orderstatus").alias("status"),
        F.map_filter(entries, lambda k, v: v.isNotNull()).alias("metrics"),
        F.col("o_orderdate").alias("created_at"),
    )


@registry.add(
    "project_list",
    f"""WITH {TRAINING_RUNS}, t AS (SELECT project_id, count(*) AS run_count, max(accuracy) AS best FROM training_runs GROUP BY 1),
        l AS (SELECT project_id, string_agg(DISTINCT model_type, ',' ORDER BY model_type) AS kinds FROM (
              SELECT * FROM training_runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id DESC) <= 3) GROUP BY 1)
        SELECT c_custkey AS id, c_name AS name, coalesce(run_count, 0) AS run_count, round(best, 6) AS best_accuracy,
               coalesce(kinds, '') AS recent_model_types
        FROM customer LEFT JOIN t ON t.project_id = c_custkey LEFT JOIN l ON l.project_id = c_custkey""",
)
def project_list(spark, folder):
    projects = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("timestamp_ntz").alias("created_at")
    )
    found = catalogue.project_list(projects, training_runs(spark, folder))
    return rounded(found, 6, "best_accuracy").select(
        "id", "name", "run_count", "best_accuracy", F.array_join("recent_model_types", ",").alias("recent_model_types")
    )


@registry.add("feature_set_list", "SELECT p_partkey AS id, p_name AS name, (p_size % 5)::INTEGER AS feature_count FROM part")
def feature_set_list(spark, folder):
    entries = F.array_join(F.array_repeat(F.lit('{"name": "x", "source": "raw"}'), F.col("p_size") % 5), ", ")
    stored = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit('{"features": ['), entries, F.lit("]}")).alias("features_list"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    return catalogue.feature_set_list(stored).drop("created_at")


@registry.add(
    "run_list",
    f"""WITH {TRAINING_RUNS} SELECT id AS run_id, model_type, feature_set_id, status,
        CASE WHEN accuracy IS NOT NULL THEN 'accuracy' WHEN f1 IS NOT NULL THEN 'f1' END AS primary_metric,
        round(coalesce(accuracy, f1), 6) AS primary_value, training_time_s, created_at FROM training_runs""",
)
def run_list(spark, folder):
    return rounded(catalogue.run_list(training_runs(spark, folder)), 6, "primary_value")


@registry.add(
    "run_detail", f"WITH {TRAINING_RUNS} SELECT id, project_id, model_type, status FROM training_runs WHERE id = 7 AND project_id = (SELECT o_custkey FROM orders WHERE o_orderkey = 7)"
)
def run_detail(spark, folder):
    runs_ = training_runs(spark, folder)
    project = runs_.where("id = 7").first()["project_id"]
    return catalogue.run_detail(runs_, project, 7).select("id", "project_id", "model_type", "status")


@registry.add(
    "runs_by_metric",
    f"""WITH {TRAINING_RUNS} SELECT id AS run_id, round(accuracy, 6) AS accuracy FROM training_runs WHERE feature_set_id = 3
        ORDER BY training_runs.accuracy DESC NULLS LAST, id LIMIT 100""",
)
def runs_by_metric(spark, folder):
    logged = training_runs(spark, folder).withColumnRenamed("id", "run_id").where("feature_set_id = 3")
    top = tracking.runs_by_metric(logged, "accuracy")
    return top.select("run_id", F.round(F.try_element_at("metrics", F.lit("accuracy")), 6).alias("accuracy"))


@registry.add(
    "best_logged_run",
    f"""WITH {TRAINING_RUNS} SELECT id AS run_id, training_time_s FROM training_runs WHERE feature_set_id = 4
        ORDER BY training_time_s, id LIMIT 1""",
)
def best_logged_run(spark, folder):
    logged = training_runs(spark, folder).withColumnRenamed("id", "run_id").where("feature_set_id = 4")
    best = tracking.runs_by_metric(logged, "training_time_s", higher_is_better=False, max_results=1)
    return best.select("run_id", F.try_element_at("metrics", F.lit("training_time_s")).alias("training_time_s"))


@registry.add(
    "accuracy_table",
    f"""WITH {RUNS} SELECT run_id, replace(model_type, '_', ' ') AS name, training_time_s, round(accuracy * 100, 1) AS accuracy_pct,
        round(f1 * 100, 1) AS f1_pct, NULL::DOUBLE AS roc_auc_pct FROM runs""",
)
def accuracy_table(spark, folder):
    return catalogue.accuracy_table(runs(spark, folder))


@registry.add(
    "matrix_total",
    """SELECT c_mktsegment AS model, count(*) AS n_test FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def matrix_total_(spark, folder):
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    low, odd = F.col("o_totalprice") <= 250000, F.col("o_orderkey") % 2 == 1
    cells = [F.count_if(low & odd), F.count_if(low & ~odd), F.count_if(~low & odd), F.count_if(~low & ~odd)]
    matrices = joined.groupBy(F.col("c_mktsegment").alias("model")).agg(
        F.array(F.array(*cells[:2]), F.array(*cells[2:])).alias("m")
    )
    return matrices.select("model", matrix_total(F.col("m")).alias("n_test"))


def _store(spark, kind):
    """A store under a fresh folder of the shared space."""
    return kind(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}")


@registry.add(
    "stored_runs",
    f"""WITH {TRAINING_RUNS} SELECT id AS run_id, model_type, feature_set_id, status, round(coalesce(accuracy, f1), 6) AS primary_value
        FROM training_runs WHERE project_id = (SELECT min(o_custkey) FROM orders)""",
)
def stored_runs(spark, folder):
    """All runs written to a catalogue, and those of one project read from it."""
    store = _store(spark, catalogue.Catalogue)
    runs_ = training_runs(spark, folder)
    missing = {"confusion_matrix": "array<array<long>>", "details": "string"}
    store.append("training_runs", runs_.withColumns({c: F.lit(None).cast(k) for c, k in missing.items()}))
    project = runs_.agg(F.min("project_id")).first()[0]
    return rounded(store.runs(project), 6, "primary_value").select("run_id", "model_type", "feature_set_id", "status", "primary_value")


@registry.add(
    "experiment_summary",
    f"""WITH {TRAINING_RUNS}, t AS (SELECT feature_set_id, count(*) AS total_runs FROM training_runs GROUP BY 1)
        SELECT 'project_1_orders' AS experiment, t.total_runs, r.id::VARCHAR AS best_run, round(r.accuracy, 6) AS best_accuracy
        FROM training_runs r JOIN t USING (feature_set_id) WHERE feature_set_id = 3 ORDER BY r.accuracy DESC NULLS LAST, r.id::VARCHAR LIMIT 1""",
)
def experiment_summary(spark, folder):
    """All runs written to a run log, an experiment for every feature set, and the summary of one."""
    log = _store(spark, tracking.RunLog)
    experiment = log.get_or_create_experiment(1, "Orders")
    of_set = F.when(F.col("feature_set_id") == 3, experiment).otherwise(F.col("feature_set_id").cast("string"))
    tags = F.create_map(F.lit("model_type"), F.col("model_type"))
    log.append(
        "logged_runs",
        training_runs(spark, folder).select(
            F.col("id").cast("string").alias("run_id"),
            of_set.alias("experiment_id"),
            F.col("model_type").alias("run_name"),
            F.lit("FINISHED").alias("status"),
            F.col("created_at").cast("timestamp_ntz").alias("start_time"),
            tags.alias("tags"),
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("params"),
            "metrics",
            F.lit(None).cast("string").alias("artifact"),
        ),
    )
    found = log.summary(experiment)
    best = found["best_run"]
    row = (found["experiment"]["name"], found["total_runs"], best["run_id"], round(best["metrics"]["accuracy"], 6))
    return spark.createDataFrame([row], "experiment string, total_runs long, best_run string, best_accuracy double")


@registry.add(
    "feature_history",
    "SELECT p_size::BIGINT AS feature_set_id, p_retailprice AS importance_score FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)",
)
def feature_history(spark, folder):
    """Importances of features (brands) in feature sets (sizes), stored and read by feature."""
    store = _store(spark, catalogue.Catalogue)
    parts = table(spark, folder, "part")
    entries = [F.col("p_size").cast("long").alias("feature_set_id"), F.col("p_brand").alias("feature_name"), F.col("p_retailprice").alias("importance_score")]
    store.append("feature_history", parts.select(F.col("p_partkey").alias("id"), *entries))
    return store.feature_history(parts.agg(F.min("p_brand")).first()[0]).select("feature_set_id", "importance_score")
