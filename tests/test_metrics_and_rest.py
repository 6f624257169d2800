"""Scoring, resampling, ordering, cleaning, selection and checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions.probability import decode_odds, normalize, predicted_result
from touchline.operators import checks, metrics, resampling, selection
from touchline.operators.cleaning import clean_matches, normalize_columns
from touchline.operators.ordering import global_row_number
from touchline.operators.summaries import referee_card_factors


@pytest.fixture(scope="module")
def forecasts(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([2, 1, 2], 400)
    y = [["H", "D", "A"][i] for i in rng.integers(0, 3, 400)]
    data = [(i, m, y[i], *map(float, q)) for m, q_ in (("a", p), ("b", p[::-1])) for i, q in enumerate(q_)]
    return spark.createDataFrame(data, "match_id long, model string, result string, prob_home double, prob_draw double, prob_away double"), p, y


def test_metrics_match_numpy(forecasts):
    df, p, y = forecasts
    code = np.array([{"H": 0, "D": 1, "A": 2}[v] for v in y])
    hot = np.eye(3)[code]
    row = metrics.model_metrics(df).where("model = 'a'").first()
    assert row["log_loss"] == pytest.approx(-np.log(p[np.arange(400), code]).mean())
    assert row["rps"] == pytest.approx((((p.cumsum(1) - hot.cumsum(1))[:, :2] ** 2).sum(1) / 2).mean())
    assert row["brier_sum"] == pytest.approx(((p - hot) ** 2).sum(1).mean())
    assert row["accuracy"] == pytest.approx((p.argmax(1) == code).mean())


def test_exact_order_statistics(forecasts):
    df, p, _ = forecasts
    curve = metrics.reliability_curve(df).where("model = 'a' AND class = 'D'").orderBy("bin").collect()
    edges = np.percentile(p[:, 1], np.arange(1, 8) * 12.5)
    bins = np.searchsorted(edges, p[:, 1], side="left")
    assert [r["n"] for r in curve] == [int((bins == b).sum()) for b in range(8)]
    assert [r["mean_predicted"] for r in curve] == pytest.approx([p[bins == b, 1].mean() for b in range(8)])


def test_stable_schema_keeps_absent_models(forecasts):
    df, *_ = forecasts
    rows = {r["model"]: r for r in metrics.stable_summary(df, ["a", "b", "none"]).collect()}
    assert rows["a"]["available"] and not rows["none"]["available"] and rows["none"]["rps"] is None
    assert metrics.stable_confusion(df, ["a", "none"]).count() == 18


def test_resampling_weights_behave_like_poisson(spark):
    rows = resampling.with_poisson_weight(spark.range(1, 2001).withColumnRenamed("id", "slot").withColumn(
        "rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(200).cast("long")))))
    m = rows.agg(F.avg("w"), F.var_samp("w")).first()
    assert m[0] == pytest.approx(1, abs=0.01) and m[1] == pytest.approx(1, abs=0.02)
    totals = rows.groupBy("rep").agg(F.sum("w").alias("s")).agg(F.stddev_samp("s")).first()[0]
    assert totals == pytest.approx(2000 ** 0.5, rel=0.2)


def test_bootstrap_interval_is_close_to_theory(forecasts):
    df, p, y = forecasts
    row = resampling.bootstrap_metrics(df, samples=500).where("model = 'a'").first()
    code = np.array([{"H": 0, "D": 1, "A": 2}[v] for v in y])
    loss = -np.log(p[np.arange(400), code])
    half = 1.96 * loss.std() / 20
    assert row["log_loss_ci_low"] == pytest.approx(loss.mean() - half, abs=0.35 * half)
    assert row["log_loss_ci_high"] == pytest.approx(loss.mean() + half, abs=0.35 * half)
    same = resampling.bootstrap_differences(resampling.all_paired_losses(df.where("model = 'a'").unionByName(
        df.where("model = 'a'").withColumn("model", F.lit("c"))), "a"), ["model"], samples=50).first()
    assert same["delta_rps_ci_low"] == same["delta_rps_ci_high"] == 0


def test_global_row_number(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    found = global_row_number(df, [F.desc("v"), F.asc("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(1, 5001))
    assert [(r["v"], r["id"]) for r in found] == sorted(((i * 7919 % 1009, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))


def test_cleaning_cases(spark):
    schema = "Date string, HomeTeam string, AwayTeam string, FTHG string, FTAG string, FTR string, `BbMx>2.5` string"
    raw = spark.createDataFrame([
        ("14/08/2021", "  Man   City ", "Wolves", "3", "1", "A", "1.9"), ("15/08/21", "Leeds", "Aston Villa", "0", "0", "H", None),
        ("never", "Leeds", "Everton", "1", "0", "H", None), ("16/08/2021", "Leeds", "Everton", "x", "0", "H", None)], schema)
    named = normalize_columns(raw).withColumn("season", F.lit("2021-2022"))
    assert "bbmx_over_2_5" in named.columns
    late = spark.createDataFrame([("2022-08-14", "12:30", "1", "2")], "date string, time string, fthg string, ftag string").withColumns(
        {"team_home": F.lit("Everton"), "team_away": F.lit("Leeds"), "season": F.lit("2022-2023")})
    rows = {r["match_id"]: r for r in clean_matches([named, normalize_columns(late)], "league").collect()}
    assert set(rows) == {"20210814-manchester-city-wolverhampton-wanderers", "20210815-leeds-united-aston-villa", "20220814-everton-leeds-united"}
    first = rows["20210814-manchester-city-wolverhampton-wanderers"]
    assert (first["result"], first["competition"], first["goals_home"], first["shots_home"]) == ("H", "league", 3, None)
    assert rows["20220814-everton-leeds-united"]["datetime"].hour == 12
    with pytest.raises(ValueError):
        checks.require(checks.check_matches(clean_matches([named, named], "league").withColumn("match_date", F.col("date"))), "duplicate_keys")


def test_errors_on_impossible_probabilities(spark):
    bad = spark.sql("SELECT 0D AS prob_home, 0D AS prob_draw, 0D AS prob_away")
    with pytest.raises(Exception, match="sum to zero"):
        normalize(bad).collect()
    odds = spark.sql("SELECT 1.0D AS h, 3D AS d, 4D AS a")
    with pytest.raises(Exception, match="above 1"):
        decode_odds(odds, ("h", "d", "a")).collect()
    tie = spark.sql("SELECT 0.4D AS prob_home, 0.2D AS prob_draw, 0.4D AS prob_away").select(predicted_result()).first()[0]
    assert tie == "H"


def test_selection_rule_and_guards(spark):
    table = spark.createDataFrame([("a", 1.0, 0.5), ("b", 1.0, 0.6), ("c", 0.9, None)], "model string, cv_log_loss_mean double, cv_accuracy_mean double")
    assert selection.select_best_model(table, ["a", "b"]).first()["model"] == "b"
    with pytest.raises(ValueError):
        selection.select_best_model(table, ["a", "missing"])
    with pytest.raises(ValueError):
        selection.select_best_model(table, ["a", "c"])
    folds = "fold long, last_train_season string, validation_season string"
    now = spark.createDataFrame([(1, "2019", "2020")], folds)
    selection.guard_folds(now, now, "2021")
    with pytest.raises(ValueError, match="holdout"):
        selection.guard_folds(now, now, "2020")
    with pytest.raises(ValueError, match="other folds"):
        selection.guard_folds(spark.createDataFrame([(1, "2018", "2019")], folds), now, "2021")


def test_referee_factors(spark):
    rows = [("busy", 3, 3)] * 40 + [("rare", 0, 0)] * 5 + [("calm", 1, 1)] * 60
    train = spark.createDataFrame(rows, "referee string, yellow_cards_home int, yellow_cards_away int")
    found = {r["referee"]: r for r in referee_card_factors(train).collect()}
    league = 360 / 105
    assert found["rare"]["factor"] == 1.0 and found["rare"]["category"] == "other_referee"
    assert found["busy"]["factor"] == pytest.approx((240 + 30 * league) / 70 / league)
    blank = train.withColumn("referee", F.lit(None).cast("string"))
    assert referee_card_factors(blank).count() == 0
