import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from heliopanel.operators import aggregates as A
from heliopanel.operators import evaluate as E
from heliopanel.operators import filters as P
from heliopanel.operators import joins as J
from heliopanel.operators import regions as R
from heliopanel.operators import reshape
from heliopanel.plans.regional import regional_report
from heliopanel.plans.training import training_table

T0 = dt.datetime(2024, 1, 1)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def distance(a, b):
    la, lo, lb, ko = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ko - lo) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("inline", [1000, 7])
@pytest.mark.parametrize("spread", ["country", "world"])
def test_nearest_station_equals_brute_force(spark, inline, spread):
    draw = random.Random(5)
    box = (33, 38.9, 124.6, 131.8) if spread == "country" else (-89.9, 89.9, -180, 180)

    def point():
        return draw.uniform(box[0], box[1]), draw.uniform(box[2], box[3])

    stations = [(i, f"s{i}", *point(), i) for i in range(60)]
    stations += [(100, "twin", *stations[3][2:4], 100), (101, "nowhere", None, None, 101)]
    sites = [(i, *point()) for i in range(150)] + [(900, None, None), (901, *stations[3][2:4]), (902, 89.99, 179.99), (903, -10.0, -179.9)]
    s = spark.createDataFrame(stations, "station bigint, station_name string, lat double, lon double, ord int")
    p = spark.createDataFrame(sites, "site int, lat double, lon double")
    got = {r["site"]: r for r in J.nearest_station(p, s, inline_stations=inline).collect()}
    assert len(got) == len(sites)
    assert got[900]["station"] is None and got[901]["station"] == 3
    for site, lat, lon in sites:
        if lat is not None:
            best = min(distance((lat, lon), st[2:4]) for st in stations if st[2] is not None)
            assert got[site]["distance"] == pytest.approx(best, abs=1e-6)


def test_nearest_station_in_crowded_cells(spark):
    """A third of the stations within metres, a third of the sites at one place, some far off, ties by file order."""
    draw = random.Random(8)
    stations = [(i, f"s{i}", 37.5 + draw.uniform(0, 1e-4), 127 + draw.uniform(0, 1e-4), i) for i in range(150)]
    stations += [(i, f"s{i}", draw.uniform(33, 39), draw.uniform(124, 132), i) for i in range(150, 400)]
    stations += [(500, "later twin", *stations[0][2:4], 500), (501, "pole", 90.0, 0.0, 501), (502, "date line", 0.0, 180.0, 502)]
    sites = [(i, 37.50003, 127.00004) for i in range(60)] + [(i, draw.uniform(33, 39), draw.uniform(124, 132)) for i in range(60, 120)]
    sites += [(200, -60.0, -50.0), (201, 89.0, 170.0), (202, 0.5, -179.9), (203, *stations[0][2:4]), (204, None, 1.0), (205, float("nan"), 1.0)]
    s = spark.createDataFrame(stations, "station bigint, station_name string, lat double, lon double, ord int").repartition(5)
    p = spark.createDataFrame(sites, "site int, lat double, lon double")
    got = {r["site"]: r for r in J.nearest_station(p, s, inline_stations=20, leaf_stations=8).collect()}
    assert len(got) == len(sites) and got[204]["station"] is got[205]["station"] is None
    assert (got[201]["station"], got[202]["station"], got[203]["station"]) == (501, 502, 0)
    for site, lat, lon in sites[:-2]:
        best = min((round(distance((lat, lon), st[2:4]), 9), st[4], st[0]) for st in stations)
        assert got[site]["station"] == best[2] and got[site]["distance"] == pytest.approx(best[0], abs=1e-6)
    assert J.nearest_station(p.limit(0), s, inline_stations=20).count() == 0


def test_dedupe_first_with_a_hot_key(spark):
    df = spark.createDataFrame([("hot", i, None if i == 0 else i) for i in range(500)] + [("b", 7, 1)], "k string, o int, v int")
    assert rows(A.dedupe_first(df.repartition(6), ["k"], ["o"]), "k") == [("b", 7, 1), ("hot", 0, None)]


def test_alias_and_location(spark):
    gen = spark.createDataFrame([("a",), ("b",), ("c",)], "plant string")
    alias = spark.createDataFrame([("a", "A")], "plant string, canonical string")
    location = spark.createDataFrame([("A", "x.csv", 2, "20", "late"), ("A", "x.csv", 1, "10", "first"), ("c", "y.csv", 1, "bad", "c")],
                                     "plant string, source_file string, row_ord int, station string, station_name string")
    got = rows(J.join_location(J.join_alias(gen, alias), location).select("plant", "canonical", "station", "station_name"), "plant")
    assert got == [("a", "A", 10, "first"), ("b", "b", None, None), ("c", "c", None, "c")]


def test_weather_is_floored_before_it_is_deduplicated(spark):
    weather = spark.createDataFrame([(1, T0, 1.0, 0), (1, T0 + dt.timedelta(minutes=30), 2.0, 1)],
                                    "station bigint, ts timestamp_ntz, temperature double, o int")
    hourly = J.hourly_weather(weather, ("o",)).drop("o")
    left = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=5), 9.0), (None, T0, 8.0)],
                                 "station bigint, ts timestamp_ntz, temperature double")
    got = rows(J.join_weather(left, hourly), F.asc_nulls_last("station"))
    assert got == [(1, T0, 9.0, 1.0), (None, T0, 8.0, None)]
    lost = spark.createDataFrame([(None, T0, 3.0)], "station bigint, ts timestamp_ntz, w double")
    assert J.join_weather(left, lost, null_safe=True).filter("w = 3.0").count() == 1


def test_training_table(spark):
    gen = spark.createDataFrame([(T0, "a", 1.25), (T0, "a", 0.5), (T0, "b", None)], "ts timestamp_ntz, plant string, mwh double")
    alias = spark.createDataFrame([], "plant string, canonical string")
    location = spark.createDataFrame([("a", 5, "s", "f", 0)], "plant string, station bigint, station_name string, source_file string, row_ord int")
    weather = spark.createDataFrame([(5, "s", T0, 1.0, None, 3.0, 4.0, "f", 0)],
                                    "station bigint, station_name string, ts timestamp_ntz, temperature double, rain double, "
                                    "sunshine double, radiation double, source_file string, row_ord int")
    table = training_table(gen, alias, location, weather)
    assert [tuple(r) for r in table.collect()] == [(T0, "a", "s", 5, 1.75, 1.0, 0.0, 3.0, 4.0),
                                                   (T0, "b", None, None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    unfilled = training_table(gen, alias, location, weather, fill=False).collect()
    assert unfilled[0]["rain"] is None and unfilled[1]["temperature"] is None


def test_geocode(spark):
    df = spark.createDataFrame([(" x ",), ("y",), ("y",), (None,)], "address string")
    cache = spark.createDataFrame([("x", 1.0, 2.0)], "address string, lat double, lon double")
    assert rows(J.unresolved_addresses(df, cache), "address") == [("y",)]
    assert J.join_geocode(df, cache).filter("lat = 1.0").count() == 1


def test_regional_report(spark):
    registry = spark.createDataFrame(
        [("g1", "서울", "강남", "10"), ("g2", "서울시", "강남", "bad"), ("g3", "경기도 광주시", "오포", "5"), (None, "제주", "한림", "2.5"),
         ("g5", None, "?", "1"), ("g6", "전북", "없음", "9"), ("g7", "전북", "강남", "1")],
        "generator string, region string, subregion string, capacity string")
    cache = spark.createDataFrame([("강남", 37.5, 127.0), ("오포", 37.3, 127.2), ("한림", 33.4, 126.2)], "address string, lat double, lon double")
    boundaries = spark.createDataFrame([("Seoul",), ("Busan",), ("Jeju",)], "name string")
    report = regional_report(registry, cache, boundaries)
    assert rows(report.regions, "region") == [("광주광역시", 1, 5.0), ("서울특별시", 2, 10.0), ("전라북도", 1, 1.0), ("제주특별자치도", 0, 2.5)]
    assert rows(report.ranking, "rank")[:3] == [(1, "서울특별시", 2, 10.0), (2, "광주광역시", 1, 5.0), (3, "전북특별자치도", 1, 1.0)]
    shade = {r["name"]: (r["plants"], r["capacity"], r["alpha"]) for r in report.boundaries.collect()}
    assert shade == {"Seoul": (2, 10.0, 1.0), "Busan": (0, 0.0, 0.3), "Jeju": (0, 2.5, 0.3)}
    sites = {(r["lat"], r["lon"]): r for r in report.sites.collect()}
    assert sites[37.5, 127.0]["plants"] == 3 and sites[37.5, 127.0]["region"] == "서울특별시"
    assert sites[37.5, 127.0]["radius"] == pytest.approx(3 ** 0.2)
    assert rows(report.unresolved, "address") == [("없음",)]


def test_row_numbers_agree_on_both_paths(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    order = [F.desc("v")]
    for limit in (100_000, 10):
        got = R.with_row_number(df, order, "n", window_rows=limit).collect()
        assert sorted((r["n"], r["v"]) for r in got) == [(i + 1, 999 - i) for i in range(1000)]


def test_canonical_order(spark):
    df = spark.createDataFrame([("제주특별자치도",), ("없음",), ("서울특별시",)], "region string")
    assert [r["region_order"] for r in R.sort_regions_canonical(df).collect()] == [0, 16, 999]


def test_metrics(spark):
    data = [(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0), (None, 1.0), (1.0, None)]
    df = spark.createDataFrame(data, "y_true double, y_pred double")
    for row in (E.regression_metrics(df).first(), E.regression_metrics(df, scale=4).first()):
        assert row["n"] == 4 and row["mae"] == pytest.approx(0.5) and row["rmse"] == pytest.approx(0.612372, abs=1e-6)
        assert row["r2"] == pytest.approx(0.948608, abs=1e-6)
    constant = spark.createDataFrame([(1.0, 2.0)], "y_true double, y_pred double")
    assert E.regression_metrics(constant).first()["r2"] is None


def test_outliers_and_weeks(spark):
    df = spark.range(1000).select((F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts"),
                                  F.col("id").cast("double").alias("y_true"), F.lit(0.0).alias("y_pred"))
    flagged = E.top_p_outliers(E.with_residual(df))
    assert tuple(E.count_outliers(flagged).first()) == (1000, 10)
    assert E.week_calendar(df, "2024-01-03").agg(F.min("ts"), F.max("ts"), F.count("*")).first()[2] == 168
    assert E.with_week_index(df).agg(F.max("week_idx")).first()[0] == 5
    assert P.filter_range(df, "ts", "2024-01-08").count() == 168
    assert E.saturation_rate(df, "y_true", 900.0).first()["rate"] == pytest.approx(0.1)


def test_small_operators(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, "x")], "k string, v int, s string")
    assert rows(P.fill_zero(df, ["v"]), "k") == [("a", 1, None), ("b", 0, "x")]
    assert P.clean_column_names(df.withColumnRenamed("v", "\ufeffv \n w")).columns == ["k", "v w", "s"]
    assert P.find_column(["Time", "Y"], ["일시", "time"]) == "Time"
    with pytest.raises(KeyError):
        P.find_column(["x"], ["y"])
    with pytest.raises(ValueError):
        P.require_nonempty(df.filter("false"), "table")
    assert P.with_constant_default(df, "e", "태양광").first()["e"] == "태양광"
    assert P.replace_values(df, "k", {"a": "z"}).filter("k = 'z'").count() == 1
    hot = reshape.one_hot_columns(df, "s", reshape.one_hot_fit(df, "s"))
    assert rows(hot.select("k", "`s=x`"), "k") == [("a", 0), ("b", 1)]
    table = reshape.category_table(df, "k")
    assert rows(table, "index") == [("a", 0), ("b", 1)]
    more = spark.createDataFrame([("b",), ("c",), (None,), ("b",)], "k string")
    assert sorted(map(tuple, reshape.one_hot_sparse(more, "k", table).collect()), key=str) == [("b", 1, 1), ("b", 1, 1), ("c", None, 0), (None, None, 0)]


def test_draws_are_exact_and_repeatable(spark):
    df = spark.range(40).withColumn("v", F.col("id") * 2)
    draws = [sorted(r.id for r in P.sample_with_replacement(d, 1000, ["id"], seed=s).collect()) for d, s in ((df, 1), (df.repartition(5), 1), (df, 2))]
    assert len(draws[0]) == 1000 and draws[0] == draws[1] != draws[2]
    counts = [draws[0].count(i) for i in range(40)]
    assert sum((c - 25) ** 2 / 25 for c in counts) < 80 and P.sample_with_replacement(df, 1000, ["id"]).columns == ["id", "v"]
    assert P.sample_with_replacement(df.filter("id < 0"), 10, ["id"]).count() == 0 and P.sample_with_replacement(df, 0, ["id"]).count() == 0


def test_detect_datetime(spark):
    df = spark.createDataFrame([("bad", "2024-01-02 03:00")], "`일시` string, datetime string")
    assert P.detect_datetime(df).first()["ts"] == dt.datetime(2024, 1, 2, 3)
    split = spark.createDataFrame([("2024-01-02", "27시")], "date string, hour string")
    assert P.detect_datetime(split).first()["ts"] == dt.datetime(2024, 1, 2, 23)
    with pytest.raises(ValueError):
        P.detect_datetime(spark.createDataFrame([("x",)], "a string"))


def test_unpivot_keeps_every_cell(spark):
    df = spark.createDataFrame([(1, 1.0, "2"), (2, None, "x")], "id int, `1시` double, `2시(kWh)` string")
    got = rows(reshape.melt_hours(df, ["id"], ["1시", "2시(kWh)"]), "id", "hour_label")
    assert got == [(1, "1시", "1.0"), (1, "2시(kWh)", "2"), (2, "1시", None), (2, "2시(kWh)", "x")]


def test_boxes_do_not_travel_with_places(spark):
    """Between two levels of the pyramid a place takes cells along, not the boxes below them."""
    rows = [(i, f"s{i}", 33 + (i * 37 % 500) / 100, 126 + (i * 53 % 350) / 100, i) for i in range(400)]
    s = spark.createDataFrame(rows, "station long, station_name string, lat double, lon double, ord long")
    p = spark.createDataFrame([(i, 30 + i / 7, 120 + i / 5) for i in range(60)], "site long, lat double, lon double")
    plan = J.nearest_station(p, s, inline_stations=20, leaf_stations=8)._jdf.queryExecution().analyzed().toString()
    assert "collect_list(_near" in plan and "collect_list(_boxes" not in plan
