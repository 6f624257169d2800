"""Trees learn from every row: fits of many rows, a pass a level, against the same fits in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import tree_passes, trees
from touchline.operators.trees import Boosted, Forest

COLUMNS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    """(x, y, folds, order) of rows with missing, tied and empty inputs, and the table of them."""
    rng = np.random.default_rng(11)
    n = 700
    x = rng.normal(size=(n, 5))
    x[:, 1] = rng.integers(0, 6, n)
    x[rng.random((n, 5)) < 0.05] = np.nan
    x[:, 4] = np.nan
    z = np.stack([np.nan_to_num(x[:, 0]), np.zeros(n), np.nan_to_num(x[:, 1] - 2)], 1)
    y = (z + rng.gumbel(size=z.shape)).argmax(1)
    folds = [[k for k, end in ((1, 301), (2, 700)) if i < end] for i in range(n)]
    made = [(i, float(y[i]), folds[i], *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    table = spark.createDataFrame(made, "match_id long, label double, folds array<long>, " + ", ".join(f"{c} double" for c in COLUMNS)).repartition(3).cache()
    at = {r.match_id: r["at"] for r in table.select("match_id", F.xxhash64("match_id").alias("at")).collect()}
    return x, y, folds, at, table


@pytest.fixture
def by_passes(monkeypatch):
    for module, name, value in ((trees, "IN_TASK_ROWS", 0), (tree_passes, "STRETCH_ROWS", 100), (tree_passes, "NODES", 3), (tree_passes, "KEPT_ROUNDS", 2)):
        monkeypatch.setattr(module, name, value)


def own_rows(rows, fold):
    """The fold's rows in the order of the hash, and how many lie in each of seven stretches."""
    _, _, folds, at, _ = rows
    own = sorted((i for i in at if fold in folds[i]), key=at.get)
    return own, np.bincount([((at[i] >> 32) + (1 << 31)) * 7 >> 32 for i in own], minlength=7)


@pytest.mark.parametrize("driver_bytes", [0, tree_passes.DRIVER_BYTES])
def test_passes_grow_the_trees_of_one_task(rows, by_passes, monkeypatch, driver_bytes):
    monkeypatch.setattr(tree_passes, "DRIVER_BYTES", driver_bytes)
    x, y, _, _, table = rows
    specs = {"forest": Forest(trees=3, depth=6, least=4), "stump": Forest(trees=2, depth=1, least=6),
             "boosted": Boosted(rounds=5, depth=3, step=0.3, least=10), "short": Boosted(rounds=2, depth=1, step=0.1)}
    fits = trees.fit_many(table, specs, [1, 2], COLUMNS)
    assert set(fits) == {(k, n) for k in (1, 2) for n in specs}
    for (fold, name), fit in fits.items():
        own, sizes = own_rows(rows, fold)
        spec = specs[name]
        plain = trees.fit_forest(x[own], y[own], spec, sizes=sizes) if isinstance(spec, Forest) else trees.fit_boosted(x[own], y[own], spec)
        assert np.array_equal(fit.fill, plain.fill) and np.array_equal(fit.cuts, plain.cuts)
        assert all(np.array_equal(getattr(fit, n), getattr(plain, n)) for n in ("first", "feature", "cut", "left")), name
        assert np.allclose(fit.value, plain.value, atol=1e-9) and np.allclose(fit.probabilities(x), plain.probabilities(x), atol=1e-9)
        assert (fit.feature >= 0).sum() > (20 if name in ("forest", "boosted") else 1)


def test_borders_are_exact_quantiles_of_all_rows(rows):
    x, _, _, _, table = rows
    got = tree_passes.fold_borders(trees.training_rows(table, COLUMNS), 5)
    for fold in (1, 2):
        own, _ = own_rows(rows, fold)
        fill, cuts = trees.fit_borders(x[own])
        assert np.array_equal(got[fold][0], fill) and np.array_equal(got[fold][1], cuts)


def test_fits_see_rows_beyond_the_earlier_bound(spark, monkeypatch):
    """The last 5,000 of 25,000 matches in the order of the hash alone have the third label."""
    from pyspark.sql import Window

    table = spark.range(25_000).select(F.col("id").alias("match_id"), F.array(F.lit(1).cast("long")).alias("folds"), (F.col("id") % 7).cast("double").alias("a"),
                                       F.row_number().over(Window.orderBy(F.xxhash64("id"))).alias("r"))
    table = table.withColumn("label", F.when(F.col("r") > 20_000, 2.0).otherwise(0.0)).cache()
    for most in (trees.IN_TASK_ROWS, 0):
        monkeypatch.setattr(trees, "IN_TASK_ROWS", most)
        fits = trees.fit_many(table, {"boosted": Boosted(rounds=1, depth=1), "forest": Forest(trees=2, depth=1)}, [1], ["a"])
        assert np.allclose(np.exp(fits[1, "boosted"].prior), [0.8, 0, 0.2], atol=1e-6)
        assert np.allclose(fits[1, "forest"].probabilities(np.zeros((1, 1))), [[0.8, 0, 0.2]], atol=0.03)


def test_draws_of_stretches_are_as_many_as_rows():
    spec, sizes = Forest(trees=1), np.array([40, 0, 300, 60])
    counts = trees.draws(spec, 0, sizes)
    assert counts.sum() == 400 and counts[1] == 0
    assert [trees.bootstrap(spec, 0, k, n, counts[k], False).sum() for k, n in enumerate(sizes) if n] == [c for c in counts if c]
    assert (trees.bootstrap(spec, 0, 0, 50, 50, True) == np.bincount(np.random.default_rng((spec.seed, 0)).integers(0, 50, 50), minlength=50)).all()


def test_rows_are_led_through_blocks_of_full_length():
    rng = np.random.default_rng(2)
    bins, n = rng.integers(0, trees.BINS, (42, tree_passes.STRETCH_ROWS)).astype(np.uint8), tree_passes.STRETCH_ROWS
    levels = [(np.array([41], np.int16), np.array([9], np.uint8)), (np.array([-1, 30], np.int16), np.array([0, 20], np.uint8))]
    rows, node = tree_passes._led({"bins": bins, "n": n}, np.ones(n), levels)
    assert np.array_equal(rows, np.flatnonzero(bins[41] > 9)) and np.array_equal(node, bins[30, rows] > 20)
    place = tree_passes._stepped(bins, levels)
    assert np.array_equal(place, np.where(bins[41] > 9, 2 + (bins[30] > 20), 0))
