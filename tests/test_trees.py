import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import matrix
from tabloom.operators import boosting, forest, network
from tabloom.session import durable, folded

FEATURES = [f"f{i}" for i in range(3)]


def table(spark, n=600, classes=0, seed=1):
    """Features with many and with few different values, ties and a constant part; repartitioned rows."""
    random = np.random.default_rng(seed)
    x = np.stack([random.normal(size=n), random.integers(0, 5, n), random.integers(0, 300, n) / 7], axis=1)
    y = (2 * (x[:, 0] > 0) + (x[:, 1] > 2)) % classes if classes else 3 * x[:, 0] + x[:, 1] ** 2 + random.normal(0, 0.1, n)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "key long, f0 double, f1 double, f2 double, y double").repartition(3, "key")


def columns():
    return [F.col(f) for f in FEATURES]


def predictions(model, df, **more):
    scored = model.predict(df.withColumn("f", F.array(*FEATURES)), "f", "p", **more)
    return np.array([r["p"] for r in scored.orderBy("key").collect()])


def best_cut(x, y, w, classes):
    """All cuts of all features."""
    best = (-np.inf,)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left = x[:, f] <= low
            score = 0.0
            for side in (left, ~left):
                if classes:
                    score += sum(w[side & (y == k)].sum() ** 2 for k in range(classes)) / w[side].sum()
                else:
                    score += (w[side] * y[side]).sum() ** 2 / w[side].sum()
            best = max(best, (score, f, (float(low) + float(high)) / 2))
    return best


@pytest.mark.parametrize("classes", [0, 4])
def test_splits_are_the_best_of_all(classes):
    random = np.random.default_rng(3)
    for _ in range(10):
        x = np.stack([random.normal(size=40), random.integers(0, 4, 40), np.zeros(40)], axis=1).astype("f4")
        y = random.integers(0, classes, 40).astype(float) if classes else random.normal(size=40)
        w = random.integers(1, 4, 40).astype(float)
        tree, _ = forest.grow(x, y, w, forest.Rules(max_depth=1, drawn=3, classes=classes), [1])
        score, f, threshold = best_cut(x, y, w, classes)
        assert tree.feature[0] == f and tree.threshold[0] == pytest.approx(threshold)


@pytest.mark.parametrize("classes", [0, 3])
def test_unlimited_trees_learn_every_row(classes):
    random = np.random.default_rng(4)
    x = random.normal(size=(500, 4)).astype("f4")
    y = random.integers(0, classes, 500).astype(float) if classes else random.normal(size=500)
    tree, gains = forest.grow(x, y, np.ones(500), forest.Rules(drawn=2, classes=classes), [1])
    total = np.zeros((500, max(classes, 1)))
    tree.add(x, total)
    assert (total.argmax(axis=1) == y).all() if classes else np.allclose(total[:, 0], y)
    again = forest.Tree.load(tree.dump())
    other = np.zeros_like(total)
    again.add(x, other)
    assert np.array_equal(total, other) and (gains >= 0).all()


def test_limits_of_trees():
    random = np.random.default_rng(5)
    x, y = random.normal(size=(300, 3)).astype("f4"), random.normal(size=300)
    tree, _ = forest.grow(x, y, np.ones(300), forest.Rules(drawn=3, min_leaf=20), [1])
    assert np.bincount(tree.leaves(x))[tree.feature < 0].min() >= 20
    tree, _ = forest.grow(x, y, np.ones(300), forest.Rules(drawn=3, min_split=100), [1])
    sizes = np.bincount(tree.leaves(x), minlength=len(tree.left))
    assert sizes.max() < 100
    constant, _ = forest.grow(np.ones((9, 2), "f4"), y[:9], np.ones(9), forest.Rules(drawn=1), [1])
    assert len(constant.left) == 1 and constant.value[0] == pytest.approx(y[:9].mean())


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_tops_agree_with_trees_grown_in_tasks(spark, classes):
    """With cuts at every value, histograms find the splits that exact growth finds; only thresholds lie elsewhere."""
    random = np.random.default_rng(6)
    noise = random.normal(0, 1.5, 900)
    values = [(float(a), float(b), float(c), a * 0.7 - b * 0.4 + c / 9 + noise[i]) for i, (a, b, c) in enumerate(random.integers(0, 9, (900, 3)))]
    rows = [(i, a, b, c, float(np.clip(y, 0, classes - 1) // 1 if classes else y)) for i, (a, b, c, y) in enumerate(values)]
    df = spark.createDataFrame(rows, "key long, f0 double, f1 double, f2 double, y double").repartition(3, "key")
    rules = forest.Rules(trees=2, drawn=3, classes=classes, max_depth=4, bootstrap=False)
    whole = forest.fit(df, columns(), F.col("y"), rules)
    parts = forest.fit(df, columns(), F.col("y"), rules, node_bytes=100 * 28)
    assert len(whole.tops[0].left) == 1 and len(parts.tops[0].left) > 5
    assert np.allclose(predictions(whole, df), predictions(parts, df))
    assert np.allclose(whole.importances, parts.importances)


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_forest_by_broadcast_and_by_join(spark, classes, tmp_path):
    df = table(spark, classes=classes)
    model = forest.fit(df, columns(), F.col("y"), forest.Rules(trees=7, drawn=1, classes=classes), node_bytes=150 * 28)
    broadcast, joined = predictions(model, df), predictions(model, df, broadcast_bytes=0)
    assert broadcast.shape == (600, max(classes, 1)) and np.allclose(broadcast, joined)
    model.save(str(tmp_path))
    assert np.allclose(predictions(forest.Forest.load(spark, str(tmp_path)), df), broadcast)
    y = np.array([r.y for r in df.orderBy("key").collect()])
    assert (broadcast.argmax(axis=1) == y).mean() > 0.95 if classes else np.corrcoef(broadcast[:, 0], y)[0, 1] > 0.95
    assert model.importances.sum() == pytest.approx(1.0)


def test_scoring_by_groups_of_subtrees(spark, monkeypatch):
    """One group of all trees, then groups that cut trees, of which several copies share the rows."""
    df = table(spark, classes=3)
    model = forest.fit(df, columns(), F.col("y"), forest.Rules(trees=7, drawn=1, classes=3), node_bytes=150 * 28)
    whole = predictions(model, df, broadcast_bytes=0)
    monkeypatch.setattr(forest, "GROUP_BYTES", model.bytes // 10)
    monkeypatch.setattr(forest, "SCORED_BYTES", 2_000)
    monkeypatch.setattr(forest, "CHUNK_BYTES", 1)
    assert np.allclose(predictions(model, df, broadcast_bytes=0), whole)


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {b for b in manager.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}


@pytest.mark.parametrize("classes", [0, 3])
def test_lots_of_trees_shuffle_one_after_the_other(spark, classes, monkeypatch):
    """The rows of all trees, and then all subtrees, were shuffled at once, and their files stayed."""
    df = table(spark, classes=classes)
    rules = forest.Rules(trees=5, drawn=2, classes=classes)
    monkeypatch.setattr(forest, "GROUP_BYTES", 3_000)
    whole = forest.fit(df, columns(), F.col("y"), rules, node_bytes=150 * 28)
    expected = predictions(whole, df, broadcast_bytes=0)
    monkeypatch.setattr(forest, "SHUFFLED_BYTES", 1)
    made, sent = [], []
    monkeypatch.setattr(forest, "durable", lambda t: made.append(t.columns) or durable(t))
    monkeypatch.setattr(forest, "folded", lambda steps, s: folded((sent.append(1) or f for f in steps), s))
    before = shuffle_files(spark)
    cut = forest.fit(df, columns(), F.col("y"), rules, node_bytes=150 * 28)
    assert made.count(["tree", "node", "model", "bytes", "gain"]) == 5
    ends = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < ends:
        time.sleep(0.2)
    assert not left
    assert np.allclose(whole.importances, cut.importances, rtol=1e-12) and whole.bytes == cut.bytes
    assert np.array_equal(predictions(cut, df, broadcast_bytes=0), expected) and len(sent) > 2
    assert np.allclose(predictions(cut, df), expected)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_neighbours_fill_lots():
    assert forest._lots([3, 3, 3, 9, 1, 1], 6) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert forest._lots([5], 1) == [(0, 1)] and forest._lots([1] * 4, 9) == [(0, 4)]


@pytest.mark.parametrize("classes", [2, 3])
def test_nodes_of_one_class_are_closed_in_the_tops(spark, classes):
    """Their rows were sent to tasks, though nothing grows there."""
    random = np.random.default_rng(9)
    rows = [(i, float(a), float(b), float(c), float(min(a // 3, classes - 1))) for i, (a, b, c) in enumerate(random.integers(0, 9, (900, 3)))]
    df = spark.createDataFrame(rows, "key long, f0 double, f1 double, f2 double, y double").repartition(3, "key")
    model = forest.fit(df, columns(), F.col("y"), forest.Rules(trees=2, drawn=3, classes=classes, bootstrap=False), node_bytes=100 * 28)
    assert max(len(top.left) for top in model.tops) == 2 * classes - 1
    found = predictions(model, df)
    assert (found.argmax(axis=1) == [r[4] for r in rows]).all() and (found.max(axis=1) == 1).all()


@pytest.mark.parametrize("classes", [0, 2, 4])
def test_boosting_in_a_task_and_over_the_cluster(spark, classes):
    df = table(spark, n=400, classes=classes)
    rules = boosting.Rules(rounds=12, max_depth=3, eta=0.3, classes=classes)
    here = boosting.fit(df, columns(), F.col("y"), rules)
    spread = boosting.fit(df, columns(), F.col("y"), rules, local_bytes=0)
    assert np.allclose(predictions(here, df), predictions(spread, df))
    y = np.array([r.y for r in df.orderBy("key").collect()])
    found = predictions(here, df)
    assert (found.argmax(axis=1) == y).mean() > 0.95 if classes else np.corrcoef(found[:, 0], y)[0, 1] > 0.95


@pytest.mark.parametrize("classes", [0, 4])
def test_a_level_of_boosted_trees_is_one_job(spark, classes):
    """And the trees of earlier rounds are not added again: the blocks of a round are kept, not written."""
    df, context = table(spark, n=400, classes=classes), spark.sparkContext

    def jobs(rounds, group):
        context.setJobGroup(group, group)
        boosting.fit(df, columns(), F.col("y"), boosting.Rules(rounds=rounds, max_depth=3, eta=0.3, classes=classes), local_bytes=0)
        return len(context.statusTracker().getJobIdsForGroup(group))

    try:
        assert jobs(12, f"long{classes}") - jobs(1, f"short{classes}") <= 11 * 3
    finally:
        context.setJobGroup("", "")
    assert not [rdd for rdd in context._jsc.getPersistentRDDs().values()]


def test_rows_descend_as_in_whole_trees():
    random = np.random.default_rng(8)
    bins = np.asfortranarray(random.integers(0, 256, (500, 3)), np.uint8)
    tree, _ = forest.grow(bins.astype("f4"), random.normal(size=500), np.ones(500), forest.Rules(drawn=2, max_depth=5), [1])
    tree.threshold = np.floor(tree.threshold)
    rows = boosting._Rows(0, 0, bins, np.zeros(500), np.zeros((500, 1)))
    rows.begin(0, 1)
    assert np.array_equal(rows.descend(0, boosting._Walk(tree)), tree.leaves(bins))


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_gradients_and_curvatures(classes):
    random = np.random.default_rng(7)
    k = classes if classes > 2 else 1
    margin, y = random.normal(size=(6, k)), random.integers(0, max(classes, 2), 6).astype(float)

    def loss(m):
        if not classes:
            return ((m - y[:, None]) ** 2).sum() / 2
        return -np.log(boosting.shares(m, classes)[np.arange(6), y.astype(int)]).sum()

    g, h = boosting.gradients(margin, y, classes)
    for i in np.ndindex(margin.shape):
        e = np.zeros_like(margin)
        e[i] = 1e-4
        up, here, down = loss(margin + e), loss(margin), loss(margin - e)
        assert g[i] == pytest.approx((up - down) / 2e-4, abs=1e-6)
        # The softmax loss is given twice its diagonal curvature, an upper bound.
        assert h[i] == pytest.approx((up - 2 * here + down) / 1e-8 * (2 if classes > 2 else 1), abs=1e-4)


@pytest.mark.parametrize("activation", network.ACTIVATIONS)
@pytest.mark.parametrize("classes", [0, 2, 4])
def test_network_gradient_equals_differences(activation, classes):
    random = np.random.default_rng(8)
    rules = network.Rules(hidden=(5, 3), activation=activation, classes=classes, alpha=0.1)
    widths = network.sizes(4, rules)
    theta, x, y = network.first_weights(widths, rules), random.normal(size=(7, 4)), random.integers(0, max(classes, 2), 7).astype(float)
    _, gradient = network.loss_and_gradient(theta, widths, x, y, rules)
    for i in range(len(theta)):
        e = np.zeros_like(theta)
        e[i] = 1e-6
        up, down = (network.loss_and_gradient(theta + s * e, widths, x, y, rules)[0] for s in (1, -1))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-7)


@pytest.mark.parametrize("local_bytes", [network.LOCAL_BYTES, 0])
@pytest.mark.parametrize("changes", [{}, {"solver": "sgd", "rate": 0.05}, {"early_stopping": False, "activation": "tanh", "classes": 0}])
def test_networks_learn_and_stop(spark, local_bytes, changes):
    rules = network.Rules(**{"hidden": (16,), "classes": 4, "epochs": 120, "rate": 0.02, "batch": 16, **changes})
    df = table(spark, n=500, classes=rules.classes)
    scaled = df.select("key", "y", F.col("f0"), ((F.col("f1") - 2) / 1.4).alias("f1"), (F.col("f2") / 20 - 1).alias("f2"))
    model = network.fit(scaled, columns(), F.col("y"), rules, local_bytes)
    found = predictions(model, scaled)
    y = np.array([r.y for r in scaled.orderBy("key").collect()])
    assert (found.argmax(axis=1) == y).mean() > 0.85 if rules.classes else np.corrcoef(found[:, 0], y)[0, 1] > 0.95
    assert len(model.scores) <= 120


def test_packed_blocks(spark):
    df = table(spark, n=100)
    blocks = matrix.packed(df, columns(), F.col("y"), block_bytes=7 * 24)
    assert blocks.rows == 100 and blocks.table.agg(F.max("n")).first()[0] == 7
    total = matrix.summed(blocks, lambda found: sum((np.append(b.x.sum(axis=0), b.y.sum()) for b in found), np.zeros(4)), 4)
    expected = df.agg(*(F.sum(c) for c in (*FEATURES, "y"))).first()
    assert total == pytest.approx(list(expected))
    few, many = matrix.bin_edges(blocks, 16, 10**6, 1)[1:]
    assert few.tolist() == [0.0, 1.0, 2.0, 3.0] and 10 <= len(many) <= 15
    none = matrix.packed(df.limit(0), columns(), F.col("y"))
    assert none.rows == 0 and matrix.bin_edges(none, 16, 100, 1)[0].tolist() == []


@pytest.mark.parametrize("classes", [0, 3])
def test_a_shallow_forest_has_large_leaves(spark, classes):
    """One split of more rows than a task grows: exact threshold, and leaves that no task holds."""
    df = table(spark, n=600, classes=classes)
    rules = forest.Rules(trees=1, max_depth=1, drawn=3, classes=classes, bootstrap=False)
    whole = forest.fit(df, columns(), F.col("y"), rules)
    parts = forest.fit(df.select(*(F.col(f).alias(f) for f in ("key", *FEATURES, "y"))), columns(), F.col("y"), rules, node_bytes=50 * 28)
    assert len(parts.tops[0].left) == 3 and parts.subtrees.count() == 2
    assert np.allclose(predictions(whole, df), predictions(parts, df))
    assert np.allclose(predictions(whole, df), predictions(parts, df, broadcast_bytes=0))
    if not classes:
        few = df.select("key", "f1", "y")
        one = forest.Rules(trees=1, max_depth=1, drawn=1, bootstrap=False)
        a, b = (forest.fit(few, [F.col("f1")], F.col("y"), one, node_bytes=n).whole_trees()[0] for n in (1 << 20, 50 * 20))
        assert a.threshold[0] == b.threshold[0] and np.allclose(a.value[1:], b.value[1:])


def test_rows_that_nothing_separates_are_one_leaf(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0, 3.0, float(i % 5)) for i in range(300)], "key long, f0 double, f1 double, f2 double, y double")
    model = forest.fit(df, columns(), F.col("y"), forest.Rules(trees=2, drawn=2, bootstrap=False), node_bytes=50 * 28)
    assert model.subtrees.count() == 2 and np.allclose(predictions(model, df), 2.0)


def test_values_outside_the_sample_are_cut_too(spark):
    df = spark.createDataFrame([(float(i == 1234), float(i % 3), 0.0, 0.0) for i in range(3000)], "f0 double, f1 double, f2 double, y double")
    blocks = matrix.packed(df, columns(), F.col("y"), "<f4", block_bytes=1200)
    edges = matrix.bin_edges(blocks, 16, 20, 1)
    assert [e.tolist() for e in edges] == [[0.0], [0.0, 1.0], []]
    assert matrix.least_of_bins(blocks, edges, 3)[1].tolist() == [0.0, 1.0, 2.0]


def test_scoring_by_join_with_one_and_with_many_copies_of_a_subtree(spark, monkeypatch):
    df = table(spark, n=300)
    model = forest.fit(df, columns(), F.col("y"), forest.Rules(trees=3, drawn=1), node_bytes=80 * 28)
    expected = predictions(model, df)
    for rows, chunk in ((forest.SCORED_ROWS, forest.CHUNK_BYTES), (20, 1)):
        monkeypatch.setattr(forest, "SCORED_ROWS", rows)
        monkeypatch.setattr(forest, "CHUNK_BYTES", chunk)
        assert np.allclose(predictions(model, df, broadcast_bytes=0), expected)
