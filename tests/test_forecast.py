import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from heliopanel.forecast import features as X
from heliopanel.forecast import models as M
from heliopanel.forecast import windows as W
from heliopanel.operators.evaluate import regression_metrics
from heliopanel.plans import forecast as PF
from heliopanel.sources import sinks

START = dt.datetime(2024, 1, 1)


def solar(hours, plants=("a", "b"), start=0, scale=1.0, seed=4):
    draw = random.Random(seed)
    rows = []
    for j, plant in enumerate(plants):
        for h in range(start, start + hours):
            sun = max(0.0, math.sin((h % 24 - 6) / 12 * math.pi))
            rows.append((START + dt.timedelta(hours=h), plant, round(scale * (j + 1) * (10 * sun + draw.random()), 4)))
    return rows


SCHEMA = "ts timestamp_ntz, plant string, mwh double"


@pytest.fixture(scope="module")
def run(spark):
    train = spark.createDataFrame(solar(24 * 25), SCHEMA)
    test = spark.createDataFrame(solar(24 * 6, start=24 * 25, scale=0.01, seed=9), SCHEMA)
    return train, test, PF.train_boosted(train, test, keys=["plant"], categorical=["plant"], lag_max=24, windows=(24,),
                                         rounds=4, depth=3, learning_rate=0.6)


def test_boosted_trees_repair_the_unit_and_forecast(run):
    _, _, result = run
    assert result.factor["factor"] == 100.0
    assert result.validation_metrics.first()["r2"] > 0.9
    scores = result.test_metrics.first()
    assert scores["n"] == 2 * 24 * 6 and scores["r2"] > 0.8
    assert result.predictions.count() == 2 * 24 * 6 and result.debug_sample().count() == 10


def test_saved_model_scores_like_the_original(spark, run, tmp_path):
    train, test, result = run
    sinks.save_model(result.model, str(tmp_path / "m"))
    sinks.write_run_meta(spark, result.meta, str(tmp_path / "meta"))
    loaded, meta = sinks.load_model(str(tmp_path / "m")), sinks.read_run_meta(spark, str(tmp_path / "meta"))
    assert meta["unit_factor"] == 100.0
    metrics, flagged = PF.evaluate_saved(loaded, meta, train, test)
    assert metrics.first()["r2"] > 0.9 and metrics.first()["n"] == 24 * 6
    largest = test.groupBy("ts").agg(F.sum("mwh").alias("y")).agg(F.max("y")).first()[0]
    assert abs(flagged.agg(F.max("y_true")).first()[0] - 100 * largest) < 0.01
    assert flagged.filter("is_outlier").count() == 2
    first, _ = PF.evaluate_saved(result.model, meta, train, test)
    assert first.first() == metrics.first()


def test_an_unseen_category_and_gaps_can_be_scored(spark):
    model = M.fit_model(spark.createDataFrame([(1.0, "x", 1.0), (None, "x", 3.0), (5.0, "y", 5.0), (3.0, None, 3.0)], "n double, c string, mwh double"),
                        ["n"], ["c"], M.boosted_trees(rounds=1, depth=1))
    got = model.transform(spark.createDataFrame([(None, "new"), (1.0, None)], "n double, c string")).collect()
    assert got[0]["n__in"] == 3.0 and got[1]["c__in"] == "x"
    assert list(got[0]["features"].toArray()[1:]) == [0.0, 0.0]


def test_multi_horizon_beats_persistence(spark):
    draw = random.Random(3)
    noisy = [(t, p, round(v + 8 * draw.random(), 4)) for t, p, v in solar(24 * 16)]
    df = spark.createDataFrame(noisy, SCHEMA)
    until = (START + dt.timedelta(hours=24 * 14)).isoformat()
    for mixed in (False, True):
        windows, model = PF.fit_multi_horizon(df, until=until, seq_len=48, mixed=mixed)
        assert model.n == 2 * len(range(24 * 16 - 72 + 1)) - 2 * len(range(24 * 14 - 47, 24 * 16 - 72 + 1))
        scored = W.score_steps(model, windows.between(since=until)).cache()
        assert scored.count() == 2 * 24 * len(range(24 * 14 - 47, 24 * 16 - 72 + 1))
        ours, before = (regression_metrics(scored, prediction=c).first() for c in ("y_pred", "y_before"))
        assert ours["rmse"] < before["rmse"] and ours["r2"] > 0.7
    y = [r["mwh"] for r in df.filter("plant = 'a'").orderBy("ts").collect()]
    one = scored.filter("plant = 'a' and start = 290 and h = 5").first()
    assert one["y_true"] == y[290 + 48 + 4] and one["y_before"] == y[290 + 48 + 4 - 24]


def assembled(spark, rows):
    table = X.panel_features(spark.createDataFrame(rows, SCHEMA), keys=["plant"], lag_max=3, windows=(4,)).na.drop(subset=["lag_3"])
    names = ["lag_1", "lag_2", "lag_3", "hour"]
    last_day = F.col("ts") >= F.lit(START + dt.timedelta(hours=24 * 5)).cast("timestamp_ntz")
    return Pipeline(stages=M.impute_encode(table, names, ())).fit(table).transform(table).withColumn("check", last_day).cache()


def test_search_and_ensemble(spark):
    table = assembled(spark, solar(24 * 6))
    best, trials = M.tune(table, "check", trials=5, rounds=9)
    found = trials.orderBy("error").collect()
    assert [r["rounds"] for r in found].count(1) == 2 and sorted(r["rounds"] for r in found)[2:] == [2, 4, 8]
    winner = [r for r in found if r["best"]]
    assert len(winner) == 1 and winner[0]["rounds"] == 8 and len(best.model.trees) == 8
    scored = best.transform(table.filter("check")).select(F.col("mwh").alias("y_true"), "y_pred")
    assert regression_metrics(scored).first()["rmse"] == pytest.approx(winner[0]["error"])
    models = [M.boosted_trees(rounds=2, depth=2, seed=s).fit(table) for s in (1, 2)]
    both = M.ensemble_mean(models, table).orderBy("plant", "ts").limit(5).collect()
    single = [m.transform(table).orderBy("plant", "ts").limit(5).collect() for m in models]
    for i, row in enumerate(both):
        assert row["y_pred"] == pytest.approx((single[0][i]["y_pred"] + single[1][i]["y_pred"]) / 2)


def test_train_by_year(spark):
    rows = solar(24 * 3, ("a",)) + [(t.replace(year=2025), p, v) for t, p, v in solar(24 * 3, ("a",))]
    table = X.panel_features(spark.createDataFrame(rows, SCHEMA), keys=["plant"], lag_max=2, windows=(4,))
    models = M.train_by_year(table, [2024, 2025], ["lag_1", "hour"], [], rounds=1, depth=2)
    assert sorted(models) == [2024, 2025]


def test_unit_factor_rules(spark):
    train = spark.createDataFrame([(float(v),) for v in range(1, 101)], "mwh double")
    def factor(values, lag=True):
        df = spark.createDataFrame([(v / 10.0, v / 10.0 if lag else None) for v in values], "mwh double, lag_1 double")
        return X.unit_factor(train, df)
    assert factor(range(1, 101))["factor"] == 10.0
    assert factor(range(1, 101), lag=False)["raw"] == pytest.approx(10.0)
    assert factor([0])["factor"] == 1.0


def test_scaling(spark):
    df = spark.createDataFrame(solar(48), SCHEMA)
    pdf = df.toPandas()
    z = X.zscore_per_plant(df, ["mwh"]).toPandas().sort_values(["plant", "ts"])
    grouped = pdf.sort_values(["plant", "ts"]).groupby("plant").mwh
    want = (pdf.sort_values(["plant", "ts"]).mwh - grouped.transform("mean")) / (grouped.transform("std") + 1e-6)
    np.testing.assert_allclose(z.mwh.to_numpy(), want.to_numpy(), atol=1e-9)
    scaled = X.min_max(df, df.filter("plant = 'a'"), ["mwh"]).filter("plant = 'a'").agg(F.min("mwh"), F.max("mwh")).first()
    assert tuple(scaled) == (0.0, 1.0)
    kept = X.zscore_filter(df, "mwh", 1.0).count()
    assert kept == int((abs((pdf.mwh - pdf.mwh.mean()) / pdf.mwh.std(ddof=0)) < 1).sum())
    same = spark.createDataFrame([(1.0,), (1.0,)], "mwh double")
    assert X.zscore_filter(same, "mwh").count() == 0
    clipped = X.clip_upper_quantile(df, ["mwh"], 0.5).agg(F.max("mwh")).first()[0]
    assert clipped == pytest.approx(float(np.quantile(pdf.mwh, 0.5)))


def test_validation_split(spark):
    df = spark.createDataFrame(solar(24 * 10, ("a",)), SCHEMA)
    fit, check = X.split_last_days(df)
    assert check.count() == 169 and fit.count() == 24 * 10 - 169


def test_vectors_equal_the_feature_columns(spark):
    """Lists made from narrow rows hold what the wide table has; only the narrow rows are kept."""
    rows = solar(60, ("a", "b")) + solar(3, ("c",)) + [(START + dt.timedelta(hours=70 + h), "a", None if h == 5 else float(h)) for h in range(30)] + [(START, None, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = [*PF.CALENDAR, *X.lag_names(6), *X.roll_names((4, 8))]
    late = F.col("ts") >= F.lit(START + dt.timedelta(hours=20)).cast("timestamp_ntz")
    wide = X.panel_features(df, keys=["plant"], lag_max=6, windows=(4, 8)).filter(X.history_complete_filter(6)).filter(late)
    want = {(r.plant, r.ts): (r.mwh, [None if r[c] is None else float(r[c]) for c in names]) for r in wide.collect()}
    vectors = X.PanelVectors(df, names, keys=["plant"], lag_max=6, windows=(4, 8))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        for size in ("10000", "3"):
            spark.conf.set(batch, size)
            got = {(r.plant, r.ts): (r.mwh, [None if math.isnan(v) else v for v in r.features]) for r in vectors.filter(late).collect()}
            assert got == want and len(want) == 2 * 40 + 30 - 6
    finally:
        spark.conf.set(batch, before)
    assert all(c in ("plant", "ts", "mwh", "pos", "n", "_at", "_own") or c.startswith("roll_") for c in vectors.rows.columns)
    assert vectors.filter().count() == X.panel_features(df, keys=["plant"], lag_max=6, windows=(4, 8)).filter(X.history_complete_filter(6)).count()
    vectors.rows.unpersist()


def test_search_reads_its_table_once_a_level(spark, monkeypatch):
    """The trees of all trials grow in the same passes."""
    from heliopanel.forecast import boosting as B

    calls = []
    summed = B._Binned.summed
    monkeypatch.setattr(B._Binned, "summed", lambda *a: calls.append(1) or summed(*a))
    M.tune(assembled(spark, solar(24 * 6)), "check", trials=4, local_rows=0)
    assert len(calls) <= (1 + 1 + 2) * (8 + 1)
