import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from heliopanel.functions import geo, scale, text, timefx


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_norm(spark):
    assert apply(spark, text.norm, [" Plant-Name (A)_[b]/c. ", "발전소 명", None]) == ["plantnameabc", "발전소명", None]


def test_simplify_address(spark):
    cases = {
        "전남 가온시 나래면 다솜리 25": "전남 가온시 나래면",
        "전라남도 가온시 나래면": "전라남도 가온시 나래면",
        "경기 안산시 단원구 초지동 1": "안산시 단원구 초지동",
        "당진화력 자재창고 옥상 3층": "당진화력 자재창고 옥상",
        "  세종특별자치시  ": "세종특별자치시",
        "제주 산 1": "제주",
        "  ": "", "": "",
    }
    assert apply(spark, text.simplify_address, [*cases, None]) == [*cases.values(), None]


def test_canonical_region(spark):
    cases = {"서울": "서울특별시", " 부산 광역시": "부산광역시", "경기도 광주시": "광주광역시", "전북특별자치도": "전라북도",
             "강원도": "강원특별자치도", " 해외 ": "해외", "": ""}
    assert apply(spark, text.to_canonical, [*cases, None]) == [*cases.values(), ""]
    assert apply(spark, lambda c: text.to_canonical(c, anchored=True), ["경기도 광주시"]) == ["경기도"]


def test_region_labels(spark):
    assert apply(spark, text.strip_region_prefix_any, ["전라북도 전북특별자치도 익산시", "경기도수원시", "수원시", None]) == [
        "익산시", "수원시", "수원시", ""]
    assert apply(spark, text.normalize_subregion, ["  a \t b ", None]) == ["a b", ""]
    assert apply(spark, text.valid_region, ["서울", " nan ", "", "None", "알수없음", None]) == [
        True, False, False, False, False, False]
    assert apply(spark, text.display_region_name, ["전라북도", "경기도"]) == ["전북특별자치도", "경기도"]
    assert apply(spark, text.boundary_region_name, ["Seoul", "Dokdo"]) == ["서울특별시", "Dokdo"]


def test_extract_hour(spark):
    cases = {"1시": 1, "0-1시": 1, "23_24시": 24, "23 ~ 24": 24, "발전량 7시(kWh)": 7, "25시": None, "0시": None,
             "24-25시 3": None, "호기1": 1, "설비용량(12)": 12, "2024": None, "비고": None, "h05": 5}
    assert apply(spark, text.extract_hour, [*cases, None]) == [*cases.values(), None]


def test_units(spark):
    assert apply(spark, text.detect_unit, ["a(MWh)", "kWh", "Wh", "x", None]) == ["mwh", "kwh", "wh", None, None]
    rows = [("1500", "kwh"), ("2500000", "wh"), ("3.14159", "mwh"), ("1,234", "mwh"), (None, "kwh"), ("nan", "wh"),
            (" 7 ", "mwh"), ("0.15", "kwh"), ("5", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, u string")
    found = [r["o"] for r in df.select("i", text.convert_to_mwh(F.col("v"), F.col("u")).alias("o")).orderBy("i").collect()]
    assert found == [1.5, 2.5, 3.1416, 0.0, 0.0, 0.0, 7.0, 0.0001, 5.0]


def test_extract_plant_name(spark):
    assert apply(spark, text.extract_plant_name, ["발전량[ 여수 ]_[b].csv", "a.csv", "[].csv"]) == ["여수", None, ""]


def test_dates(spark):
    day = dt.datetime(2024, 2, 29)
    assert apply(spark, timefx.strip_digits_date, ["2024-02-29", "2024.02.29 01:00", "20240229", "20240230", "x", None]) == [
        day, day, day, None, None, None]
    assert apply(spark, timefx.parse_mixed_ts, ["2024-01-02 03:04", "2024-01-02 03:04:05", "2024/01/02 03:00", "20240102",
                                                "2024-13-01", "", None]) == [
        dt.datetime(2024, 1, 2, 3, 4), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 2),
        None, None, None]
    t = dt.datetime(2024, 3, 10, 2, 59, 59)
    assert apply(spark, timefx.floor_hour, [t, None], "timestamp_ntz") == [t.replace(minute=0, second=0), None]
    assert apply(spark, lambda c: timefx.hour_to_timestamp(F.lit("2024-01-31").cast("timestamp_ntz"), c), [1, 24], "int") == [
        dt.datetime(2024, 1, 31, 0), dt.datetime(2024, 1, 31, 23)]


def test_weeks(spark):
    day = [dt.datetime(2024, 12, 29), dt.datetime(2024, 12, 30), dt.datetime(2024, 12, 31)]
    assert apply(spark, timefx.week_start, day, "timestamp_ntz") == [
        dt.datetime(2024, 12, 24), dt.datetime(2024, 12, 24), dt.datetime(2024, 12, 31)]
    assert apply(spark, lambda c: timefx.week_end(c, "W-SUN"), day[:1], "timestamp_ntz") == [dt.datetime(2024, 12, 29)]


def test_time_functions_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        gap = dt.datetime(2024, 3, 10, 2, 30)
        assert apply(spark, timefx.floor_hour, [gap], "timestamp_ntz") == [gap.replace(minute=0)]
        assert apply(spark, timefx.strip_digits_date, ["2024-03-10"]) == [dt.datetime(2024, 3, 10)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_month_ranges(spark):
    rows = timefx.month_ranges(spark, [2023, 2024]).orderBy("year", "month").collect()
    assert len(rows) == 24
    assert rows[13]["end_text"] == "20240229" and rows[1]["end_text"] == "20230228" and rows[0]["start_text"] == "20230101"


def test_haversine(spark):
    row = spark.range(1).select(
        geo.haversine(F.lit(37.5665), F.lit(126.978), F.lit(35.1796), F.lit(129.0756)).alias("d"),
        geo.haversine(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("zero"),
        geo.haversine(F.lit(None).cast("double"), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("none")).first()
    assert row["d"] == pytest.approx(325.1, abs=0.5) and row["zero"] == 0.0 and row["none"] is None


def test_numbers(spark):
    inf, nan = float("inf"), float("nan")
    assert apply(spark, scale.null_non_finite, [1.0, inf, -inf, nan, None], "double") == [1.0, None, None, None, None]
    assert apply(spark, scale.zero_non_finite, [1.0, inf, nan, None], "double") == [1.0, 0.0, 0.0, 0.0]
    assert apply(spark, lambda c: scale.clip(c, 0.0, 5.0), [-1.0, 3.0, 9.0, None], "double") == [0.0, 3.0, 5.0, None]
    assert apply(spark, scale.log_target, [-3.0, math.e - 1, None], "double") == [0.0, pytest.approx(1.0), None]
    assert apply(spark, lambda c: scale.to_units(c, 4), [0.00005, -0.00005, 6.55, None], "double") == [1, -1, 65500, None]
    constant = F.lit(2.0)
    assert apply(spark, lambda c: scale.min_max_scale(c, constant, constant), [2.0, 3.0], "double") == [0.0, 1.0]
