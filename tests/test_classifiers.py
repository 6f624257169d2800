"""Fitted values of the classifiers against plain NumPy: trees, boosting, Newton steps, calibration, stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import calibration, logistic, trees
from touchline.operators.logistic import Logistic
from touchline.operators.trees import Boosted, Forest

COLUMNS = ["a", "b", "c", "d"]


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[rng.random((n, 4)) < 0.05] = np.nan
    z = np.stack([np.nan_to_num(x[:, 0]), np.zeros(n), np.nan_to_num(x[:, 1] * 2)], 1)
    y = (z + rng.gumbel(size=z.shape)).argmax(1)
    return x, y


@pytest.fixture(scope="module")
def placed(spark):
    """Two folds: the first trains on a half, the second on all but the last rows."""
    x, y = data()
    rows = []
    for i in range(len(y)):
        for fold, end in ((1, 200), (2, 350)):
            part = "train" if i < end else "validation" if i < end + 50 else None
            if part:
                rows.append((i, fold, part, "HDA"[y[i]], float(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]]))
    return spark.createDataFrame(rows, "match_id long, fold long, part string, result string, label double, " + ", ".join(f"{c} double" for c in COLUMNS)).cache()


def test_logistic_fits_solve_their_score_equations(placed):
    x, y = data()
    fits = logistic.fit_many(placed, {"plain": Logistic(), "strong": Logistic(0.1)}, [1, 2], COLUMNS)
    assert set(fits) == {(k, n) for k in (1, 2) for n in ("plain", "strong")}
    for (fold, name), fit in fits.items():
        n = (200, 350)[fold - 1]
        assert fit.rows == n and fit.gradient <= logistic.TOLERANCE
        filled = np.where(np.isnan(x[:n]), fit.fill, x[:n])
        assert np.allclose(fit.mean, filled.mean(0)) and np.allclose(fit.scale, filled.std(0))
        p = fit.probabilities(x[:n])
        slopes = (p - (y[:n, None] == np.arange(3))).T @ fit.inputs(x[:n]) / n
        ridge = (1 / n if name == "plain" else 0.1) * fit.weights
        ridge[:, -1] = 0
        assert np.abs(slopes + ridge).max() < 1e-8
    assert np.abs(fits[1, "strong"].weights[:, :-1]).sum() < np.abs(fits[1, "plain"].weights[:, :-1]).sum()


def test_a_gini_tree_cuts_where_impurity_falls_most():
    x, y = data(120, 1)
    spec = Forest(trees=1, depth=1, least=5, seed=3)
    fill, cuts = trees.fit_borders(x)
    bins, weight = trees.to_bins(x, fill, cuts), np.ones(len(y))
    feature, cut, left, value = trees.gini_tree(bins, y, weight, spec, 0)
    drawn = np.argsort(np.random.default_rng((3, 0, 0)).random((1, 4)), 1)[0, :2]

    def worth(own):
        return sum((y[own] == c).sum() ** 2 for c in range(3)) / max(own.sum(), 1)

    tries = {(int(j), k): worth(bins[:, j] <= k) + worth(bins[:, j] > k) for j in drawn for k in range(trees.BINS - 1)
             if min((bins[:, j] <= k).sum(), (bins[:, j] > k).sum()) >= 5}
    assert np.isclose(tries[feature[0], cut[0]], max(tries.values()))
    right = bins[:, feature[0]] > cut[0]
    assert np.allclose(value[left[0]], np.bincount(y[~right], minlength=3) / (~right).sum())
    assert np.allclose(value[left[0] + 1], np.bincount(y[right], minlength=3) / right.sum())


def test_stages_equal_shorter_fits():
    x, y = data(300, 2)
    whole = trees.fit_forest(x, y, Forest(trees=12, depth=30, least=3))
    for (n, depth), p in whole.stages(x, [5, 12], [2, 6, 30]).items():
        assert np.allclose(p, trees.fit_forest(x, y, Forest(trees=n, depth=depth, least=3)).probabilities(x), atol=1e-6)
    long = trees.fit_boosted(x, y, Boosted(rounds=30, depth=3, step=0.1))
    for (n, _), p in long.stages(x, [7, 30], [3]).items():
        assert np.allclose(p, trees.fit_boosted(x, y, Boosted(rounds=n, depth=3, step=0.1)).probabilities(x), atol=1e-6)


def test_boosting_lowers_the_loss_and_keeps_leaves_large():
    x, y = data(300, 3)
    model = trees.fit_boosted(x, y, Boosted(rounds=60, depth=2, step=0.1, least=20))
    loss = [-np.log(p[np.arange(len(y)), y]).mean() for p in model.stages(x, list(range(1, 61)), [2]).values()]
    assert all(b < a + 1e-12 for a, b in zip(loss, loss[1:])) and loss[-1] < loss[0] - 0.1
    # the first tree's leaves are Newton steps of their rows
    bins = trees.to_bins(x, model.fill, model.cuts)
    p = np.bincount(y, minlength=3)[0] / len(y)
    leaf = next(iter(model.walked(bins, [2])))[0][:, 0]
    for value in np.unique(leaf):
        own = leaf == value
        assert own.sum() >= 20
        assert np.isclose(value, -0.1 * (p - (y[own] == 0)).sum() / (own.sum() * p * (1 - p)), rtol=1e-3)


def test_fits_side_by_side_equal_single_fits(spark, placed):
    x, y = data()
    specs = {"forest": Forest(trees=trees.BLOCK + 3, depth=3, least=6), "boosted": Boosted(rounds=5, depth=2, step=0.3)}
    fits = trees.fit_many(placed, specs, [1, 2], COLUMNS)
    assert set(fits) == {(k, n) for k in (1, 2) for n in specs}
    order = {i: k for k, i in enumerate(r.match_id for r in placed.where("part = 'train'").select("match_id").distinct().orderBy(
        F.xxhash64("match_id"), "match_id").collect())}
    for fold, n in ((1, 200), (2, 350)):
        own = sorted(range(n), key=order.get)  # the sample's order decides bootstrap draws
        assert np.allclose(fits[fold, "forest"].probabilities(x), trees.fit_forest(x[own], y[own], specs["forest"]).probabilities(x), atol=1e-6)
        assert np.allclose(fits[fold, "boosted"].probabilities(x), trees.fit_boosted(x[own], y[own], specs["boosted"]).probabilities(x), atol=1e-6)
    assert len(trees.training_sample(placed, COLUMNS, 50)[1]) == 50


def plain_isotonic(x, y):
    """Pool adjacent violators over distinct x, one value for each."""
    at = np.unique(x)
    value, weight = [y[x == a].mean() for a in at], [(x == a).sum() for a in at]
    blocks = [[v, w, 1] for v, w in zip(value, weight)]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] >= blocks[i + 1][0]:
            a, b = blocks[i], blocks.pop(i + 1)
            blocks[i] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
            i = max(i - 1, 0)
        else:
            i += 1
    return at, np.concatenate([[v] * n for v, _, n in blocks])


def score_rows(spark, groups=("g1", "g2", "one")):
    rng = np.random.default_rng(8)
    rows = []
    for g in groups:
        x = np.round(rng.random(150 if g != "one" else 1), 2)  # many ties
        rows += [(g, float(a), int(rng.random() < a ** 2)) for a in x]
    return rows, spark.createDataFrame(rows, "group string, x double, y int").repartition(5)


def test_isotonic_equals_plain_pooling(spark):
    rows, scores = score_rows(spark)
    blocks = calibration.fit_isotonic(scores)
    asked = spark.createDataFrame([(g, float(a)) for g in ("g1", "g2", "one") for a in np.linspace(-0.2, 1.2, 57)], "group string, at double")
    got = calibration.apply_isotonic(asked, blocks, "at", "c").collect()
    for g in ("g1", "g2", "one"):
        at, value = plain_isotonic(*(np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2)))
        own = [r for r in got if r.group == g]
        assert np.allclose([r.c for r in own], np.interp([r["at"] for r in own], at, value))


def test_sigmoid_solves_its_score_equations(spark):
    rows, scores = score_rows(spark)
    curves = {r.group: r for r in calibration.fit_sigmoid(scores.withColumn("x", F.ln(F.greatest("x", F.lit(1e-6))))).collect()}
    for g in ("g1", "g2"):
        x = np.log(np.maximum([r[1] for r in rows if r[0] == g], 1e-6))
        y = np.array([r[2] for r in rows if r[0] == g])
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        p = 1 / (1 + np.exp(-(curves[g].slope * x + curves[g].shift)))
        assert abs(((p - target) * x).mean()) < 1e-8 and abs((p - target).mean()) < 1e-8
    assert abs(curves["one"].gradient) < 1e-6


def test_cuts_of_held_cells_equal_those_of_all_cells():
    rng = np.random.default_rng(4)
    bins, y, own = rng.integers(0, trees.BINS, (500, 9)).astype(np.uint8), rng.integers(0, 3, 500), rng.integers(1, 4, 500).astype(float)
    node = rng.integers(0, 60, 500)
    drawn = np.argsort(rng.random((60, 9)), 1)[:, :3]
    share = np.bincount(node * 3 + y, own, 180).reshape(60, 3)
    rows = np.arange(500)
    (cut, worth), (cut_, worth_) = (f(bins, y, own, rows, node, drawn, share, 3) for f in (trees._dense_cuts, trees._sparse_cuts))
    fine = worth > (share ** 2).sum(1) / np.maximum(share.sum(1), 1) + 1e-9
    assert fine.sum() > 30 and (fine == (worth_ > (share ** 2).sum(1) / np.maximum(share.sum(1), 1) + 1e-9)).all()
    assert (cut[fine] == cut_[fine]).all() and (worth[fine] == worth_[fine]).all()


def test_histograms_of_pairs_equal_plain_sums():
    rng = np.random.default_rng(5)
    bins, node, g = rng.integers(0, trees.BINS, (5, 300)), rng.integers(0, 4, 300), rng.normal(size=300)
    sums, counts = trees._histograms(trees._pairs(bins), 5, node, 4, g, None)
    for m in range(4):
        for j in range(5):
            assert np.allclose(sums[m, j], np.bincount(bins[j][node == m], g[node == m], trees.BINS))
            assert (counts[m, j] == np.bincount(bins[j][node == m], minlength=trees.BINS)).all()


def test_each_fit_has_a_task_of_its_own(spark, placed):
    specs = {f"b{k}": Boosted(rounds=1, depth=1, step=0.1) for k in range(8)}
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fits", "fits")
    assert len(trees.fit_many(placed, specs, [1, 2], COLUMNS)) == 16
    stages = [before.getStageInfo(i) for j in before.getJobIdsForGroup("fits") for i in before.getJobInfo(j).stageIds]
    assert 16 in {s.numTasks for s in stages if s}


def test_logistic_steps_keep_a_curvature_while_it_serves(spark, placed, monkeypatch):
    asked = []
    plain = logistic._curvature
    monkeypatch.setattr(logistic, "_curvature", lambda *a: asked.append(a[2] is None) or plain(*a))
    fits = logistic.fit_many(placed, {"plain": Logistic()}, [2], COLUMNS)
    monkeypatch.setattr(logistic, "KEPT_SHARE", 0.0)  # every later step has its own curvature
    own = logistic.fit_many(placed, {"plain": Logistic()}, [2], COLUMNS)
    assert asked[0] is False and fits[2, "plain"].gradient <= logistic.TOLERANCE and own[2, "plain"].gradient <= logistic.TOLERANCE
    x, _ = data()
    assert np.allclose(fits[2, "plain"].probabilities(x), own[2, "plain"].probabilities(x), atol=1e-7)


def test_rows_with_several_folds_are_packed_once(spark, placed, monkeypatch):
    """Fits on rows that name the folds they train equal those on a copy a fold, of half the packed rows."""
    packed, settle = [], logistic.settle
    monkeypatch.setattr(logistic, "settle", lambda df: packed.append(settle(df)) or packed[-1])
    once = placed.where("part = 'train'").groupBy("match_id", "label", *COLUMNS).agg(F.sort_array(F.collect_list("fold")).alias("folds"))
    got, copied = (logistic.fit_many(t, {"plain": Logistic()}, [1, 2], COLUMNS) for t in (once, placed))
    assert [t.agg(F.sum("n")).first()[0] for t in packed] == [350, 550]
    x, _ = data()
    for k in (1, 2):
        assert got[k, "plain"].rows == copied[k, "plain"].rows and got[k, "plain"].gradient <= logistic.TOLERANCE
        assert np.allclose(got[k, "plain"].probabilities(x), copied[k, "plain"].probabilities(x), atol=1e-7)
    a, b = (trees.training_sample(t, COLUMNS, 100) for t in (once, placed))
    assert np.array_equal(a[0], b[0], equal_nan=True) and (a[1] == b[1]).all() and [sorted(f) for f in a[2]] == [sorted(f) for f in b[2]]


def test_calibrated_forecasts_keep_one_row_a_match(spark, placed):
    """Against plain calibration of each inner fold's forecasts; no row is copied for an inner fold."""
    from touchline.operators import learning as ml

    inner = placed.withColumn("fold", F.col("fold") + 100)
    check = placed.where("part = 'validation' and fold = 2").drop("fold", "part").withColumn("split", F.lit(1))
    models = {"logistic_regression": Logistic(0.1)}
    fitted = ml.fit_folds(inner, models, [101, 102], COLUMNS)
    made = ml.calibrated_forecasts(inner, inner.where("part = 'validation'"), check, models, [101, 102], ["match_id"], COLUMNS)
    got = {(r.method, r.match_id): [r.prob_home, r.prob_draw, r.prob_away] for r in made.collect()}
    x, y = data()
    for method in ml.METHODS:
        mean = 0
        for k, begin in ((101, 200), (102, 350)):
            own, ahead, out = fitted[k, "logistic_regression"].probabilities(x[begin:begin + 50]), fitted[k, "logistic_regression"].probabilities(x[350:400]), []
            for j in range(3):
                hit = (y[begin:begin + 50] == j).astype(int)
                if method == "isotonic":
                    out.append(np.interp(ahead[:, j], *plain_isotonic(own[:, j], hit)))
                else:
                    rows = spark.createDataFrame([("g", float(np.log(a)), int(h)) for a, h in zip(own[:, j], hit)], "group string, x double, y int")
                    r = calibration.fit_sigmoid(rows).first()
                    out.append(1 / (1 + np.exp(-(r.slope * np.log(ahead[:, j]) + r.shift))))
            c = np.maximum(np.stack(out, 1), 1e-6)
            mean = mean + c / c.sum(1, keepdims=True) / 2
        assert sum(m == method for m, _ in got) == 50
        assert np.allclose([got[method, i] for i in range(350, 400)], mean, atol=1e-6)


def test_rows_walk_alike_in_pieces_and_one_by_one(monkeypatch):
    """Each row's leaf by a plain walk; a tree that is one leaf, an odd last piece, and no row."""
    x, y = data(300, 6)
    for model in (trees.fit_forest(x, y, Forest(trees=6, depth=7, least=3)), trees.fit_boosted(x, y, Boosted(rounds=4, depth=2, step=0.1)),
                  trees.fit_forest(x[:4], y[:4], Forest(trees=2, depth=3, least=9))):
        bins = trees.to_bins(x, model.fill, model.cuts)
        for root, (cut_at_two, whole) in zip(model.first, model.walked(bins, [2, 64])):
            for i in (0, 7, 299):
                node, level, seen = int(root), 0, None
                while model.feature[node] >= 0:
                    seen = node if level == 2 else seen
                    node, level = int(model.left[node]) + int(bins[i, model.feature[node]] > model.cut[node]), level + 1
                assert (whole[i] == model.value[node]).all() and (cut_at_two[i] == model.value[node if seen is None else seen]).all()
        p = model.probabilities(x)
        monkeypatch.setattr(trees, "WALK_ROWS", 37)
        assert (model.probabilities(x) == p).all() and model.probabilities(x[:0]).shape == (0, 3)
        monkeypatch.undo()
