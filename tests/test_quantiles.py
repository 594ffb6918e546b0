import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heliopanel.operators import quantiles as Q


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(5)


def test_exact_quantile_equals_linear_interpolation(spark):
    draw = random.Random(7)
    values = [round(draw.gauss(50, 20), 2) for _ in range(3001)]
    wanted = {str(q): ("v", q) for q in (0.0, 0.01, 0.5, 0.95, 0.999, 1.0)}
    found = Q.quantiles_exact(table(spark, values), wanted)
    for name, (_, q) in wanted.items():
        assert found[name] == pytest.approx(float(np.quantile(values, q)), abs=1e-9)


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 10])
def test_small_tables(spark, rows):
    values = [float(i * i) for i in range(rows)]
    wanted = {str(q): ("v", q) for q in (0.1, 0.25, 0.5, 0.9)}
    found = Q.quantiles_exact(table(spark, values), wanted)
    for name, (_, q) in wanted.items():
        assert found[name] == pytest.approx(float(np.quantile(values, q)))


@pytest.mark.parametrize("band_rows", [100_000, 30])
def test_a_third_of_all_rows_share_one_value(spark, band_rows):
    values = [0.0] * 2000 + [float(i) for i in range(1, 2001)] + [999.0] * 2000
    wanted = {str(q): ("v", q) for q in (0.2, 1 / 3, 0.4, 0.5, 0.66, 0.7)}
    found = Q.quantiles_exact(table(spark, values), wanted, band_rows)
    for name, (_, q) in wanted.items():
        assert found[name] == pytest.approx(float(np.quantile(values, q)), abs=1e-9)


def test_null_and_nan_are_ignored_and_empty_is_none(spark):
    df = table(spark, [None, float("nan"), 1.0, 3.0]).withColumn("none", F.lit(None).cast("double"))
    found = Q.quantiles_exact(df, {"m": ("v", 0.5), "e": ("none", 0.5)})
    assert found == {"m": 2.0, "e": None}


def test_wide_brackets_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr(Q, "MARGIN", 0.1)
    draw = random.Random(3)
    values = [0.0] * 500 + [round(draw.uniform(-5, 5), 3) for _ in range(1500)]
    wanted = {str(q): ("v", q) for q in (0.05, 0.5, 0.93)}
    found = Q.quantiles_exact(table(spark, values), wanted, band_rows=20)
    for name, (_, q) in wanted.items():
        assert found[name] == pytest.approx(float(np.quantile(values, q)), abs=1e-9)


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    monkeypatch.setattr(Q, "MARGIN", 0.0)
    values = [float(i) for i in range(1001)]
    monkeypatch.setattr(Q, "SKETCH_ACCURACY", 10)
    assert Q.quantile_exact(table(spark, values), "v", 0.437) == pytest.approx(437.0)


def test_most_frequent_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "y"), ("a", "x"), ("a", None), ("b", None)], "k string, v string")
    found = {r["k"]: r["m"] for r in Q.most_frequent(df, ["k"], "v", "m").collect()}
    assert found == {"a": "x", "b": None}


def test_exact_modes(spark):
    df = spark.createDataFrame([("q", 1), ("p", 1), ("p", 2), (None, 2)], "s string, n int")
    assert Q.mode_impute_fit(df, ["s", "n"]) == {"s": "p", "n": "1"}


def test_scale_summary_skips_non_finite(spark):
    row = Q.scale_summary(table(spark, [1.0, float("inf"), 5.0, None, 3.0]), "v").first()
    assert (row["min"], row["q50"], row["max"]) == (1.0, 3.0, 5.0)


def test_many_columns_are_exact_without_a_sketch_each(spark, monkeypatch):
    """Whole batches; an aggregate function for each column took most of the time of a fit."""
    def never(*_):
        raise AssertionError("one sketch a column")

    monkeypatch.setattr(Q.F, "percentile_approx", never)
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 60, 20_000):
        x = rng.normal(size=(n, 20))
        x[:, 1], x[:, 2], x[::3, 3], x[:, 4], x[:, 5] = np.round(x[:, 1]), 7, np.nan, np.nan, np.exp(8 * x[:, 5])
        df = spark.createDataFrame(pa.table({f"c{i}": x[:, i] for i in range(20)})).repartition(5)
        wanted = {**{f"m{i}": (f"c{i}", 0.5) for i in range(20)}, "p": ("c0", 0.95), "top": ("c0", 1.0), "low": ("c5", 0.0)}
        got = Q.quantiles_exact(df, wanted)
        for name, (column, q) in wanted.items():
            values = x[:, int(column[1:])]
            values = values[~np.isnan(values)]
            assert got[name] == (pytest.approx(float(np.quantile(values, q)), rel=1e-12) if len(values) else None), (n, name)
    assert Q.quantiles_exact(df.limit(0), wanted)["p"] is None


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    monkeypatch.setattr(Q, "_bracket", lambda points, ranks, goal, margin: (5.0, 6.0) if margin < 1 else (-np.inf, np.inf))
    x = np.random.default_rng(1).normal(size=(500, 17))
    got = Q.quantiles_exact(spark.createDataFrame(pa.table({f"c{i}": x[:, i] for i in range(17)})), {f"c{i}": (f"c{i}", 0.5) for i in range(17)})
    assert got == {f"c{i}": pytest.approx(np.median(x[:, i])) for i in range(17)}
