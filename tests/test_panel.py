import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliopanel.operators import panel as W

START = dt.datetime(2024, 1, 1)


def make(seed=1):
    """Series of different lengths with gaps and nulls; one holds most rows, one key is null."""
    draw = random.Random(seed)
    rows = []
    for plant, count in (("big", 900), ("mid", 230), ("short", 180), ("tiny", 5)):
        hour = 0
        for _ in range(count):
            hour += draw.choice([1, 1, 1, 2, 40])
            value = None if draw.random() < 0.05 else round(draw.uniform(0, 50), 4)
            rows.append((plant, START + dt.timedelta(hours=hour), value))
    rows += [(None, START + dt.timedelta(hours=i), float(i)) for i in range(50)]
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = make()
    frame = pd.DataFrame(rows, columns=["plant", "ts", "y"])
    df = spark.createDataFrame(rows, "plant string, ts timestamp_ntz, y double").repartition(7)
    return df, frame[frame.plant.notna()].sort_values(["plant", "ts"]).reset_index(drop=True)


def expect(df, frame, columns, exact=True):
    got = df.filter(F.col("plant").isNotNull()).toPandas().sort_values(["plant", "ts"]).reset_index(drop=True)
    assert len(got) == len(frame)
    for c in columns:
        np.testing.assert_allclose(got[c].astype(float), frame[c].astype(float), rtol=0, atol=1e-9, err_msg=c)
    lonely = df.filter(F.col("plant").isNull()).toPandas()
    assert len(lonely) == 50
    return lonely


def test_positions(spark, data):
    df, frame = data
    frame = frame.assign(pos=frame.groupby("plant").cumcount(), n=frame.groupby("plant").y.transform("size"))
    lonely = expect(W.Panel(df, ["plant"]).rows, frame, ["pos", "n"])
    assert lonely["pos"].isna().all()


@pytest.mark.parametrize("chunk", [2048, 24, 50])
def test_lags_at_any_chunk_size(spark, data, chunk):
    df, frame = data
    steps = [1, 7, 24]
    frame = frame.assign(**{f"lag_{k}": frame.groupby("plant").y.shift(k) for k in steps})
    lonely = expect(W.add_lags(W.Panel(df, ["plant"], chunk_rows=chunk), "y", steps), frame, [f"lag_{k}" for k in steps])
    assert lonely[[f"lag_{k}" for k in steps]].isna().all().all()


@pytest.mark.parametrize("chunk", [2048, 72])
def test_rolls_of_previous_rows(spark, data, chunk):
    df, frame = data
    columns = {}
    for w in (6, 24, 72):
        shifted = frame.groupby("plant").y.shift(1)
        rolled = shifted.groupby(frame.plant).rolling(w, min_periods=int(w * 0.6))
        columns[f"roll_mean_{w}"] = rolled.mean().reset_index(level=0, drop=True)
        columns[f"roll_std_{w}"] = rolled.std().reset_index(level=0, drop=True)
    frame = frame.assign(**columns)
    lonely = expect(W.add_rolls(W.Panel(df, ["plant"], chunk_rows=chunk), "y", (6, 24, 72)), frame, list(columns))
    assert lonely[list(columns)].isna().all().all()


def test_rolls_of_a_constant_series_have_no_deviation(spark):
    rows = [("a", START + dt.timedelta(hours=i), 0.3) for i in range(60)]
    df = spark.createDataFrame(rows, "plant string, ts timestamp_ntz, y double")
    stds = {r["roll_std_24"] for r in W.add_rolls(W.Panel(df, ["plant"]), "y", (24,)).collect()}
    assert stds == {None, 0.0}


def test_inclusive_rolls(spark, data):
    df, frame = data
    rolled = {f"m{n}": frame.groupby("plant").y.rolling(n).mean().reset_index(level=0, drop=True) for n in (6, 24)}
    frame = frame.assign(**rolled)
    expect(W.add_rolls_inclusive(W.Panel(df, ["plant"], chunk_rows=30), "y", {"m6": 6, "m24": 24}), frame, ["m6", "m24"])


def test_history_complete_and_lag_array(spark, data):
    df, frame = data
    frame = frame.assign(history_complete=frame.groupby("plant").y.shift(1).groupby(frame.plant).rolling(12).count()
                         .reset_index(level=0, drop=True) == 12)
    expect(W.add_history_complete(W.Panel(df, ["plant"], chunk_rows=20), "y", 12), frame, ["history_complete"])
    arrays = W.add_lag_array(W.Panel(df, ["plant"], chunk_rows=20), "y", 12).filter("plant = 'mid'").orderBy("ts").collect()
    y = [r["y"] for r in arrays]
    assert all(r["lags"] == y[max(0, i - 12):i] for i, r in enumerate(arrays))


@pytest.mark.parametrize("threshold", ["1000", "5"])
def test_history_tail(spark, data, threshold):
    df, frame = data
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    got = W.history_tail(df, ["plant"], 168).toPandas().sort_values(["plant", "ts"])
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    want = frame.groupby("plant").tail(168)
    assert got[["plant", "ts"]].values.tolist() == want[["plant", "ts"]].values.tolist()


@pytest.mark.parametrize("step,limit", [(1, None), (5, None), (3, 10), (1, 1), (24, 4)])
def test_window_starts(spark, data, step, limit):
    df, frame = data
    want = set()
    for plant, group in frame.groupby("plant"):
        n = len(group)
        if n < 192:
            continue
        starts = np.arange(n)[: n - 192 + 1: step]
        if limit is not None and len(starts) > limit:
            starts = starts[np.linspace(0, len(starts) - 1, num=limit, dtype=int)]
        want |= {(plant, int(s)) for s in starts}
    got = W.window_starts(W.Panel(df, ["plant"]), step=step, limit=limit)
    assert {(r["plant"], r["pos"]) for r in got.collect()} == want
    windows = W.sequence_windows(W.Panel(df, ["plant"], chunk_rows=200), ["y"], "y", step=step, limit=limit)
    assert {(r["plant"], r["start"]) for r in windows.select("plant", "start").collect()} == want


def test_thinning_equals_even_spacing(spark):
    cases = [(total, limit) for total in range(2, 90, 3) for limit in (1, 2, 3, 7, 11)]
    df = spark.createDataFrame(cases, "total bigint, lim bigint").select(
        "total", "lim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1)).alias("i"))
    chosen = F.lit(False)
    for limit in (1, 2, 3, 7, 11):
        chosen = chosen | ((F.col("lim") == limit) & W.thinned(F.col("i"), F.col("total"), limit))
    got = {}
    for r in df.filter(chosen).collect():
        got.setdefault((r["total"], r["lim"]), []).append(r["i"])
    for total, limit in cases:
        want = np.linspace(0, total - 1, num=limit, dtype=int) if total > limit else np.arange(total)
        assert sorted(got[total, limit]) == sorted(set(want.tolist()))


def test_sequence_windows_hold_the_right_rows(spark, data):
    df, frame = data
    got = W.sequence_windows(W.Panel(df, ["plant"], chunk_rows=64), ["y", "ts"], "y", 30, 6, step=7).collect()
    series = {p: g.reset_index(drop=True) for p, g in frame.groupby("plant")}
    assert len(got) == sum(len(range(0, len(g) - 35, 7)) for g in series.values())
    for row in got:
        g = series[row["plant"]]
        s = row["start"]
        assert [x["ts"] for x in row["x"]] == [t.to_pydatetime() for t in g.ts[s:s + 30]]
        np.testing.assert_array_equal(np.array(row["y"], dtype=float), g.y[s + 30:s + 36].to_numpy(dtype=float))
        assert row["origin_ts"] == g.ts[s + 29].to_pydatetime()


def test_input_order_does_not_matter(spark, data):
    df, _ = data
    results = []
    for parts in (1, 13):
        panel = W.Panel(df.repartition(parts).orderBy(F.rand(parts)), ["plant"], chunk_rows=100)
        rows = W.add_rolls(panel, "y", (24,), lag_steps=(3,)).filter("plant is not null").orderBy("plant", "ts").collect()
        results.append([tuple(r) for r in rows])
    assert results[0] == results[1]


def test_no_task_receives_a_whole_long_series(spark):
    """One series with all rows is spread: no chunk exceeds its size plus the copied rows."""
    df = spark.range(20_000).select(F.lit("hot").alias("plant"),
                                    (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts"),
                                    F.col("id").cast("double").alias("y"))
    panel = W.Panel(df, ["plant"], chunk_rows=500)
    sizes = panel.chunks(before=168)[0].groupBy("_chunk").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] == 668 and sizes[1] >= 40
    bad = W.add_lags(panel, "y", [168]).filter("pos >= 168 and lag_168 <> y - 168").count()
    assert bad == 0


def test_many_lags_need_no_window_function_each(spark, data):
    """Over small Arrow batches: 24 lags and the array of them, no window of lags or lists in their plans."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        df, frame = data
        panel, steps = W.Panel(df, ["plant"], chunk_rows=30), range(1, 25)
        lagged, arrays = W.add_lags(panel, "y", steps), W.add_lag_array(panel, "y", 24)
        for found in (lagged, arrays):
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "lag(" not in plan and "collect_list" not in plan
        both = {(r["plant"], r["ts"]): r for r in lagged.collect()}
        for r in arrays.collect():
            own = both[r["plant"], r["ts"]]
            assert [own[f"lag_{k}"] for k in range(len(r["lags"]), 0, -1)] == r["lags"]
            assert all(own[f"lag_{k}"] is None for k in range(len(r["lags"]) + 1, 25))
        shifted = frame.groupby("plant").y.shift(24)
        want = {(p, t): v for p, t, v in zip(frame.plant, frame.ts, shifted)}
        assert all((v is None and np.isnan(want[key])) or v == want[key] for key, v in ((k, r["lag_24"]) for k, r in both.items() if k[0] is not None))
    finally:
        spark.conf.set(batch, before)


def test_units_of_arrays_equal_the_row_expression(spark):
    from heliopanel.functions import scale as C

    lists = [[1.00005, -2.00005, 3.0], [], None, [1.0, None], [float("nan")], [float("inf"), 1.0], [1e18]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<double>").repartition(1)
    plain = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + C.to_units(x, 4))
    assert all(r["a"] == r["b"] for r in df.select(plain.alias("a"), C.units_of_array(F.col("v"), 4).alias("b")).collect())
    wide = spark.createDataFrame([(1, 1.5, None), (2, float("nan"), -2.5), (3, None, None)], "i int, a double, b double")
    assert sorted(map(tuple, C.weighted_units(wide, ["a", "b"], 4, ["i"]).collect())) == [(1, 15_000, 1), (2, -50_000, 2), (3, 0, 0)]
