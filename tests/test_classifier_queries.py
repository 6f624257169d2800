"""The registered classifier queries run every model, fold and parameter of their operators."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions.probability import PROBS
from touchline.operators import learning as ml
from touchline.plans import learning, load_all
from touchline.plans.registry import QUERIES


@pytest.fixture(scope="module")
def table(spark, matches):
    rows = matches.select("match_id", "season", "match_date", "result").withColumn("season", F.when(
        F.col("season") == "2003", learning.HOLDOUT_SEASON).otherwise(F.col("season")))
    return ml.modeling_table(rows.select("*", *[F.pmod(F.xxhash64("match_id", F.lit(c)), F.lit(100)).alias(c) for c in ml.FEATURE_COLUMNS]),
                             rows.select("match_id", *[F.lit(1.0).alias(c) for c in ml.RATING_COLUMNS])).cache()


@pytest.fixture
def small(monkeypatch, table):
    """Queries over the small table; their models keep their kinds, with one tree and round."""
    load_all()
    monkeypatch.setattr(learning, "_table", lambda spark, d: (None, table))
    monkeypatch.setattr(ml, "classifiers", partial(ml.classifiers, trees=1, rounds=1))


def test_models_have_default_sizes():
    models = learning._models()
    assert models["random_forest"].trees == 350 and models["random_forest"].depth == 8 and models["boosted_trees"].rounds == 200


def test_date_folds_have_all_models(spark, small):
    rows = learning._date_folds(spark, "")[2]
    scored = {(r.model, r.folds) for r in QUERIES["m20_date_fold_cv"](spark, "").collect()}
    assert scored == {("logistic_regression", 5), ("random_forest", 5), ("boosted_trees", 5)}
    per = rows.groupBy("model", "fold").agg(F.countDistinct("match_id").alias("n"), F.count("*").alias("rows")).collect()
    assert len(per) == 15 and all(r.n == r.rows for r in per)
    assert rows.where(F.abs(F.col("prob_home") + F.col("prob_draw") + F.col("prob_away") - 1) > 1e-6).count() == 0


def test_calibration_covers_models_and_splits(spark, small, monkeypatch):
    one = ml.classifiers
    monkeypatch.setattr(ml, "classifiers", lambda *a: {k: v for k, v in one(*a).items() if k != "boosted_trees"})
    monkeypatch.setattr(learning, "DATE_SPLITS", 1)
    got = {(r.model, r.method, r.split): r.n for r in QUERIES["m28_calibration"](spark, "").collect()}
    assert len(got) == 12 and all(n > 0 for n in got.values()) and len({n for (*_, split), n in got.items() if split == "holdout"}) == 1


def test_grid_holds_all_choices():
    models, stages = learning.grid_fits(learning.parameter_grids())
    labels = [name for name in models if name not in stages] + [label for *_, named in stages.values() for label in named.values()]
    assert len(set(labels)) == len(labels) == 3 + 12 + 27 and len(models) == 3 + 2 + 9


def test_grid_scores_each_choice(spark, small, monkeypatch):
    monkeypatch.setattr(learning, "parameter_grids", lambda: {"random_forest": {"trees": [1, 3], "depth": [1, 2], "least": [3]}})
    got = QUERIES["m30_parameter_grid"](spark, "").collect()
    assert {(r.model, r.parameters) for r in got} == {("random_forest", f"trees={t},depth={k},least=3") for t in (1, 3) for k in (1, 2)}
    assert all(r.rps_std is not None and 0 < r.rps_mean < 1 for r in got)


def test_meta_learner_scores_every_later_fold(spark, monkeypatch):
    load_all()
    rng = np.random.default_rng(1)
    rows = [(i, "s", "HDA"[i % 3], k, m, *map(float, rng.dirichlet([2, 2, 2]))) for k in (1, 2, 3, 4) for i in range(k * 100, k * 100 + 30)
            for m in learning.BASE]
    frame = spark.createDataFrame(rows, "match_id long, season string, result string, fold long, model string, " + ", ".join(f"{p} double" for p in PROBS))
    monkeypatch.setattr(learning, "base_forecasts", lambda *_: frame)
    got = {(r.model, r.fold): r.n for r in QUERIES["m27_meta_learner"](spark, "").collect()}
    assert got == {(m, k): 30 for m in [*learning.BASE, "meta_learner", "simple_average"] for k in (2, 3, 4)}
    assert {r.model: r.n for r in QUERIES["m41_blend_on_holdout"](spark, "").collect()} == {
        m: 30 for m in [*learning.BASE, "meta_learner", "simple_average"]}
