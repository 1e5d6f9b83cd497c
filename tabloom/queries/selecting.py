"""Selection, split and fold queries."""

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabloom.operators import prepare, selection
from tabloom.operators.mutual_info import neighbour_mutual_info
from tabloom.queries import Registry, table
from tabloom.queries.engineering import quantile_bin, quantile_edges
from tabloom.queries.profiling import HOLED, holed_events

registry = Registry()

LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]

LABELLED = """labelled AS (
  SELECT doc_id, n_chars::DOUBLE AS n_chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS n_spaces,
         (length(text) - length(replace(text, 'e', '')))::DOUBLE / greatest(n_chars, 1) AS share_e,
         toxic::DOUBLE AS toxic, quality FROM documents JOIN labels USING (doc_id))"""
TEXT_FEATURES = ["n_chars", "n_spaces", "share_e", "toxic"]


def labelled_documents(spark, folder):
    """Numeric measures of the labelled documents."""
    text = F.col("text")
    # The labels are joined unhinted: the adaptive planner broadcasts them only when they are small.
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("double").alias("n_spaces"),
        (
            (F.length(text) - F.length(F.replace(text, F.lit("e"), F.lit("")))).cast("double")
            / F.greatest(F.col("n_chars"), F.lit(1))
        ).alias("share_e"),
        F.col("toxic").cast("double").alias("toxic"),
        "quality",
    )


@registry.add(
    "variance_threshold",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(var_samp({c}), 6) AS variance, var_samp({c}) >= 0.01 AS selected FROM lineitem"
        for c in LINE_FEATURES
    ),
)
def variance_threshold(spark, folder):
    found = selection.variance_threshold(table(spark, folder, "lineitem").select(*LINE_FEATURES))
    rows = [(c, found.scores[c], c in found.selected) for c in LINE_FEATURES]
    return spark.createDataFrame(rows, "feature string, variance double, selected boolean")


@registry.add(
    "pearson_scores",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS score FROM lineitem" for c in LINE_FEATURES
    ),
)
def pearson_scores(spark, folder):
    return selection.pearson_scores(table(spark, folder, "lineitem"), "l_extendedprice", LINE_FEATURES)


@registry.add(
    "pearson_scores_text",
    f"WITH {LABELLED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(coalesce(abs(corr({c}, quality)), 0), 6) AS score FROM labelled" for c in TEXT_FEATURES
    ),
)
def pearson_scores_text(spark, folder):
    return selection.pearson_scores(labelled_documents(spark, folder), "quality", TEXT_FEATURES)


_CORRELATIONS = " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS score, round(var_samp({c}), 6) AS spread FROM lineitem"
    for i, c in enumerate(LINE_FEATURES)
)


@registry.add(
    "importance_scores",
    f"SELECT row_number() OVER (ORDER BY score DESC, place) AS position, feature, score FROM ({_CORRELATIONS})",
)
def importance_scores(spark, folder):
    """All scores, best first, nothing dropped."""
    lines = table(spark, folder, "lineitem").select(*LINE_FEATURES, "l_extendedprice")
    found = selection.feature_importance(lines, "l_extendedprice")
    return spark.createDataFrame([(i + 1, c, s) for i, (c, s) in enumerate(found.items())], "position long, feature string, score double")


@registry.add(
    "selection_by_name",
    f"""SELECT 'correlation' AS method, row_number() OVER (ORDER BY score DESC, place) AS position, feature FROM ({_CORRELATIONS}) WHERE score >= 0.05
        UNION ALL SELECT 'variance_threshold', row_number() OVER (ORDER BY place), feature FROM ({_CORRELATIONS}) WHERE spread >= 0.05""",
)
def selection_by_name(spark, folder):
    lines = table(spark, folder, "lineitem").select(*LINE_FEATURES, "l_extendedprice")
    rows = []
    for method in ("correlation", "variance_threshold"):
        found = selection.select_features(lines, "l_extendedprice", method, exclude=["l_extendedprice"])
        rows += [(method, i + 1, c) for i, c in enumerate(found.selected)]
    return spark.createDataFrame(rows, "method string, position long, feature string")


def _rank(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2e0"


@registry.add(
    "spearman_scores",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(abs(corr(x, y)), 6) AS score
            FROM (SELECT {_rank(c)} AS x, {_rank('l_extendedprice')} AS y FROM lineitem)"""
        for c in LINE_FEATURES
    ),
)
def spearman_scores(spark, folder):
    return selection.spearman_scores(table(spark, folder, "lineitem"), "l_extendedprice", LINE_FEATURES)


@registry.add(
    "spearman_scores_missing",
    f"""WITH {HOLED} SELECT 'value' AS feature, round(abs(corr(x, y)), 6) AS score FROM (
        SELECT {_rank('value')} AS x, {_rank('user_id')} AS y FROM holed WHERE value IS NOT NULL)""",
)
def spearman_scores_missing(spark, folder):
    return selection.spearman_scores(holed_events(spark, folder), "user_id", ["value"])


def _edge_count(column: str, edges: str) -> str:
    return f"len(list_filter({edges}, lambda e: {column} > e))"


def _mutual_sql(column: str) -> str:
    return f"""SELECT '{column}' AS feature, round(greatest(sum(n / t * ln(n * t / (r * c))), 0), 6) AS score FROM (
        SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY bx) AS r, sum(n) OVER (PARTITION BY b_y) AS c FROM (
          SELECT bx, b_y, count(*)::DOUBLE AS n FROM (
            SELECT {_edge_count(column, 'ex')} AS bx, {_edge_count('l_extendedprice', 'ey')} AS b_y
            FROM lineitem, (SELECT {quantile_edges('lineitem', column, 10)} AS ex,
                                   {quantile_edges('lineitem', 'l_extendedprice', 10)} AS ey)) GROUP BY 1, 2))"""


@registry.add(
    "mutual_info_neighbours",
    """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1, embedding[3]::DOUBLE AS e2 FROM embeddings),
      p AS (UNPIVOT (SELECT vec_id, e0 + e1 AS y, e0, e1, e2 FROM e) ON e0, e1, e2 INTO NAME feature VALUE x),
      s AS (SELECT feature, vec_id, x / stddev_pop(x) OVER f AS x, y / stddev_pop(y) OVER f AS y FROM p WINDOW f AS (PARTITION BY feature)),
      d AS (SELECT a.feature, a.vec_id, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM s a JOIN s b ON a.feature = b.feature AND a.vec_id <> b.vec_id),
      r AS (SELECT feature, vec_id, min(greatest(dx, dy), 3)[3] AS r FROM d GROUP BY 1, 2),
      c AS (SELECT feature, vec_id, count(*) FILTER (dx < r OR (r = 0 AND dx = 0)) + 1 AS nx, count(*) FILTER (dy < r OR (r = 0 AND dy = 0)) + 1 AS ny
        FROM d JOIN r USING (feature, vec_id) GROUP BY 1, 2),
      m AS (SELECT unnest(range(1, (SELECT count(*) + 1 FROM embeddings))) AS m),
      psi AS (SELECT m, coalesce(sum(1e0 / m) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.57721566490153286e0 AS psi FROM m),
      t AS (SELECT feature, count(*) AS n, avg(px.psi + py.psi) AS axes FROM c JOIN psi px ON px.m = nx JOIN psi py ON py.m = ny GROUP BY 1)
      SELECT feature, round(greatest(pn.psi + pk.psi - axes, 0), 5) AS score FROM t JOIN psi pn ON pn.m = n JOIN psi pk ON pk.m = 3""",
)
def mutual_info_neighbours(spark, folder):
    e = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(3)]
    vectors = table(spark, folder, "embeddings").select(*e, (e[0] + e[1]).alias("y"))
    scores = neighbour_mutual_info(vectors, "y", ["e0", "e1", "e2"], jitter=0.0)
    return scores.select("feature", F.round("score", 5).alias("score"))


@registry.add("mutual_info_scores", " UNION ALL ".join(map(_mutual_sql, LINE_FEATURES)))
def mutual_info_scores(spark, folder):
    return selection.mutual_info_scores(table(spark, folder, "lineitem"), "l_extendedprice", LINE_FEATURES)


def _woe_sql(column: str) -> str:
    return f"""SELECT '{column}' AS feature, bin, sum(quality)::DOUBLE AS events, (count(*) - sum(quality))::DOUBLE AS non_events
        FROM (SELECT quality, {quantile_bin(column, 'ed')} AS bin
              FROM labelled, (SELECT {quantile_edges('labelled', column, 10)} AS ed)) GROUP BY bin"""


_WOE = f"""{LABELLED}, tot AS (SELECT sum(quality)::DOUBLE AS te, (count(*) - sum(quality))::DOUBLE AS tn FROM labelled),
    bins AS ({' UNION ALL '.join(map(_woe_sql, TEXT_FEATURES))}),
    w AS (SELECT *, events / te AS de, non_events / tn AS dn,
          CASE WHEN bin IS NOT NULL AND events > 0 AND non_events > 0 THEN ln((events / te) / (non_events / tn)) END AS woe
          FROM bins, tot)"""


@registry.add("weight_of_evidence", f"WITH {_WOE} SELECT feature, bin, events, non_events, round(woe, 6) AS woe FROM w")
def weight_of_evidence(spark, folder):
    found = selection.woe_table(labelled_documents(spark, folder), "quality", TEXT_FEATURES)
    return found.select("feature", "bin", "events", "non_events", F.round("woe", 6).alias("woe"))


_IV = f"""WITH {_WOE}, iv AS (SELECT feature, sum(coalesce((de - dn) * woe, 0)) AS v FROM w GROUP BY 1)
    SELECT feature, round(v, 4) AS iv, CASE WHEN v < 0.02 THEN 'useless' WHEN v < 0.1 THEN 'weak'
    WHEN v < 0.3 THEN 'medium' WHEN v < 0.5 THEN 'strong' ELSE 'suspicious' END AS strength FROM iv"""


@registry.add("information_value", _IV)
def information_value(spark, folder):
    return selection.information_value_scores(labelled_documents(spark, folder), "quality", TEXT_FEATURES)


@registry.add("information_value_top", f"SELECT * FROM ({_IV}) ORDER BY iv DESC, feature LIMIT 2")
def information_value_top(spark, folder):
    return selection.top_information_values(labelled_documents(spark, folder), "quality", 2, TEXT_FEATURES)


def _selected(spark, found):
    rows = [(i + 1, c) for i, c in enumerate(found.selected)]
    return spark.createDataFrame(rows, "position int, feature string")


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        *LINE_FEATURES, "l_extendedprice", F.col("l_orderkey").cast("string").alias("key")
    )


def _cv_sql(x: str) -> str:
    """Mean R² over three contiguous folds of a least-squares line fitted on the other two."""
    return f"""SELECT '{x}' AS feature, round(avg(r2), 6) AS r2 FROM (
        WITH f AS (SELECT x, y, CASE WHEN p < (n % 3) * (n // 3 + 1) THEN p // (n // 3 + 1)
                     ELSE n % 3 + (p - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold
                   FROM (SELECT ({x})::DOUBLE AS x, o_totalprice AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS p,
                                count(*) OVER () AS n FROM (SELECT *, month(o_orderdate) AS m FROM orders))),
             t AS (SELECT a.fold, regr_slope(f.y, f.x) AS s, regr_intercept(f.y, f.x) AS i
                   FROM (SELECT DISTINCT fold FROM f) a JOIN f ON f.fold <> a.fold GROUP BY a.fold)
        SELECT 1 - sum((y - s * x - i) ** 2) / (var_pop(y) * count(*)) AS r2 FROM f JOIN t USING (fold) GROUP BY fold)"""


@registry.add("stepwise_scores", " UNION ALL ".join(map(_cv_sql, ["o_custkey", "m"])))
def stepwise_scores(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.month("o_orderdate").alias("m"))
    return selection.stepwise_scores(orders, "o_totalprice", ["o_custkey", "m"], order_by="o_orderkey")


@registry.add("forward_selection")
def forward_selection(spark, folder):
    return _selected(spark, selection.forward_selection(_lines(spark, folder), "l_extendedprice", 3, key="key"))


# Mean R² over three contiguous folds of lines and planes by the normal equations of the other two folds.
_PAIR = """WITH n AS (SELECT o_custkey::DOUBLE AS a, month(o_orderdate)::DOUBLE AS b, o_totalprice AS y,
        row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders),
      f AS (SELECT a, b, y, CASE WHEN p < (n % 3) * (n // 3 + 1) THEN p // (n // 3 + 1)
              ELSE n % 3 + (p - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM n),
      t AS (SELECT g.fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
              covar_pop(a, y) AS ay, covar_pop(b, y) AS b_y
            FROM (SELECT DISTINCT fold FROM f) g JOIN f ON f.fold <> g.fold GROUP BY g.fold),
      c AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS wa, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM t),
      s AS (SELECT 1 - sum((y - my - ay / aa * (a - ma)) ** 2) / (var_pop(y) * count(*)) AS ra,
              1 - sum((y - my - b_y / bb * (b - mb)) ** 2) / (var_pop(y) * count(*)) AS rb,
              1 - sum((y - my - wa * (a - ma) - wb * (b - mb)) ** 2) / (var_pop(y) * count(*)) AS rab
            FROM f JOIN c USING (fold) GROUP BY fold),
      r AS (SELECT avg(ra) AS ra, avg(rb) AS rb, avg(rab) AS rab FROM s)"""


def _dated_orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.month("o_orderdate").alias("m"))


@registry.add(
    "forward_selection_blocks",
    f"""{_PAIR} SELECT 1::INTEGER AS position, CASE WHEN ra >= rb THEN 'o_custkey' ELSE 'm' END AS feature FROM r
        UNION ALL SELECT 2, CASE WHEN ra >= rb THEN 'm' ELSE 'o_custkey' END FROM r WHERE rab > greatest(ra, rb)""",
)
def forward_selection_blocks(spark, folder):
    return _selected(spark, selection.forward_selection(_dated_orders(spark, folder), "o_totalprice", 2, order_by="o_orderkey"))


@registry.add(
    "backward_elimination_blocks",
    f"{_PAIR} SELECT 1::INTEGER AS position, CASE WHEN ra > rb THEN 'o_custkey' ELSE 'm' END AS feature FROM r",
)
def backward_elimination_blocks(spark, folder):
    return _selected(spark, selection.backward_elimination(_dated_orders(spark, folder), "o_totalprice", 1, order_by="o_orderkey"))


@registry.add(
    "recursive_elimination_pair",
    """WITH m AS (SELECT var_pop(l_quantity) AS aa, var_pop(l_partkey) AS bb, covar_pop(l_quantity, l_partkey) AS ab,
          covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_partkey, l_extendedprice) AS b_y FROM lineitem)
        SELECT 1::INTEGER AS position, CASE WHEN abs(ay * bb - b_y * ab) >= abs(b_y * aa - ay * ab) THEN 'l_quantity' ELSE 'l_partkey' END AS feature FROM m""",
)
def recursive_elimination_pair(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_partkey", "l_extendedprice")
    return _selected(spark, selection.recursive_elimination(lines, "l_extendedprice", 1))


@registry.add("backward_elimination")
def backward_elimination(spark, folder):
    return _selected(spark, selection.backward_elimination(_lines(spark, folder), "l_extendedprice", 2, key="key"))


@registry.add("recursive_elimination")
def recursive_elimination(spark, folder):
    return _selected(spark, selection.recursive_elimination(_lines(spark, folder), "l_extendedprice", 2))


@registry.add("recursive_elimination_forest")
def recursive_elimination_forest(spark, folder):
    forest = RandomForestRegressor(seed=7)
    return _selected(spark, selection.recursive_elimination(_lines(spark, folder), "l_extendedprice", 3, forest))


def hash_sql(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5({key}::VARCHAR || '-{seed}'), 1, 15))::BIGINT"


@registry.add(
    "random_split",
    f"SELECT o_orderkey, ({hash_sql('o_orderkey')} >> 28)::DOUBLE / 4294967296 < 0.2 AS in_test FROM orders",
)
def random_split(spark, folder):
    train, test = prepare.random_split(table(spark, folder, "orders"), "o_orderkey")
    return train.select("o_orderkey", F.lit(False).alias("in_test")).unionByName(
        test.select("o_orderkey", F.lit(True).alias("in_test"))
    )


@registry.add(
    "stratified_split",
    f"""SELECT o_orderkey, o_orderstatus,
        row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql('o_orderkey')})
          <= floor(0.2 * count(*) OVER (PARTITION BY o_orderstatus) + 0.5) AS in_test FROM orders""",
)
def stratified_split(spark, folder):
    train, test = prepare.split(table(spark, folder, "orders"), "o_orderkey", stratify="o_orderstatus")
    columns = ["o_orderkey", "o_orderstatus"]
    return train.select(*columns, F.lit(False).alias("in_test")).unionByName(
        test.select(*columns, F.lit(True).alias("in_test"))
    )


@registry.add("hash_folds", f"SELECT o_orderkey, ({hash_sql('o_orderkey')} % 5)::INTEGER AS fold FROM orders")
def hash_folds(spark, folder):
    return prepare.assign_folds(table(spark, folder, "orders"), 5, key="o_orderkey").select("o_orderkey", "fold")


@registry.add(
    "block_folds",
    """SELECT event_id, (CASE WHEN p < (n % 7) * (n // 7 + 1) THEN p // (n // 7 + 1)
           ELSE n % 7 + (p - (n % 7) * (n // 7 + 1)) // (n // 7) END)::INTEGER AS fold
       FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events)""",
)
def block_folds(spark, folder):
    return prepare.assign_folds(table(spark, folder, "events"), 7, order_by="event_id").select("event_id", "fold")


@registry.add(
    "impute_from_train",
    f"""WITH {HOLED}, s AS (SELECT *, ({hash_sql('event_id')} >> 28)::DOUBLE / 4294967296 < 0.2 AS in_test FROM holed)
        SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM s WHERE NOT in_test)), 6) AS value FROM s WHERE in_test""",
)
def impute_from_train(spark, folder):
    train, test = prepare.split(holed_events(spark, folder), "event_id")
    _, test = prepare.mean_impute(train, test, ["value"])
    return test.select("event_id", F.round("value", 6).alias("value"))
