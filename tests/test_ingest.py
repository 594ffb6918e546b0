import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from heliopanel.functions.text import convert_to_mwh
from heliopanel.operators.aggregates import dedupe_first
from heliopanel.plans.training import training_table_from_files
from heliopanel.sources import csv_files as C
from heliopanel.sources import json_files as JF
from heliopanel.sources import sinks


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


HOURS = [f"{h}시" for h in range(1, 25)]


def meter(name, date, values):
    return ",".join([name, date, *map(str, values)])


@pytest.fixture()
def folder(tmp_path):
    head = "발전소명,거래일자," + ",".join(HOURS)
    put(tmp_path / "meters/2024/a.csv", "\ufeff" + head + "\n" + meter("가 태양광", "2024-01-01", range(24)) + "\n"
        + meter("나 풍력", "2024-01-01", range(24)) + "\n" + meter("가 태양광", "20240230", range(24)) + "\n"
        + meter("가 태양광", "2019-01-01", range(24)) + "\n")
    put(tmp_path / "meters/b.csv", head + "\n" + meter("가 태양광", "2024.01.01", ['"1,234"', "", "nan", *([1] * 21)]) + "\n", "cp949")
    put(tmp_path / "meters/c [다 발전].csv", "일자\t호기\t" + "\t".join(f"{h-1}-{h}시(kWh)" for h in range(1, 25)) + "\t25시\n"
        + "2024/01/01\t1\t" + "\t".join(["1000"] * 24) + "\t5\n2024/01/01\t2\t" + "\t".join(["500"] * 24) + "\t5\n", "cp949")
    put(tmp_path / "meters/nohours.csv", "발전소명,일자\n가 태양광,2024-01-01\n")
    put(tmp_path / "meters/nodate.csv", "발전소명,1시\n가 태양광,3\n")
    put(tmp_path / "places/p.csv", "발전소명,소재지\n가 태양광,전남 가온시 나래면 다솜리 25\n가 태양광,서울 강남구\n다 발전,없는 주소 어딘가 3\n", "cp949")
    put(tmp_path / "places/bad.csv", "x,y\n1,2\n")
    put(tmp_path / "stations.csv", "지점,지점명,위도,경도\n10,여수,34.7,127.7\n20,서울,37.5,127.0\n30,무,,\n", "cp949")
    put(tmp_path / "kma/OBS_ASOS_TIM_1.csv", "지점,지점명,일시,기온(°C),강수량(mm),일조(hr),일사(MJ/m2)\n"
        "10,여수,2024-01-01 00:00,1.5,,0.1,0.2\n10,여수,2024-01-01 00:30:00,9,9,9,9\n10,여수,2024-01-01 01:00:00,2.5,1,,\n", "cp949")
    put(tmp_path / "kma/OBS_ASOS_TIM_2.csv", "지점,지점명,일시\n10,여수,2024-01-01 00:00\n")
    put(tmp_path / "alias.json", json.dumps({"다 발전": "모름"}, ensure_ascii=False))
    put(tmp_path / "geo.json", json.dumps({"전남 가온시 나래면": {"lat": 34.8, "lon": 127.6}, "쌍": [1.0, 2.0], "빈": [None, None]},
                                          ensure_ascii=False))
    return tmp_path


def test_file_heads(spark, folder):
    heads = {r["path"].rsplit("/", 1)[1]: r for r in C.file_heads(spark, str(folder / "meters")).collect()}
    assert len(heads) == 5
    assert heads["a.csv"]["encoding"] == "UTF-8" and heads["a.csv"]["header"].startswith("발전소명")
    assert heads["b.csv"]["encoding"] == C.KOREAN and heads["b.csv"]["delimiter"] == ","
    tabbed = next(r for name, r in heads.items() if name.startswith("c"))
    assert tabbed["delimiter"] == "\t" and "호기" in tabbed["header"]


def test_unreadable_files_are_rejected(spark, tmp_path):
    put(tmp_path / "m/ok.csv", "발전소명,일자,1시\n가 태양광,2024-01-01,3\n")
    put(tmp_path / "m/long.csv", "일자\t" + "x" * 5000 + "\t1시\r\n2024-01-01\t1\t2\r\n")
    put(tmp_path / "m/empty#1%20.csv", "")
    (tmp_path / "m/other.csv").write_bytes(b"a,b\n\xff\xfe\x80,1\n")
    heads = {r["path"].rsplit("/", 1)[1]: r for r in C.file_heads(spark, str(tmp_path / "m")).collect()}
    assert heads["ok.csv"]["reason"] is None and heads["long.csv"]["header"].endswith("1시") and heads["long.csv"]["delimiter"] == "\t"
    rows, rejects = C.read_generation(spark, str(tmp_path / "m"))
    assert rows.count() == 2
    assert {(r["path"].rsplit("/", 1)[1], r["reason"]) for r in rejects.collect()} == {("empty#1%20.csv", "empty file"), ("other.csv", "neither UTF-8 nor cp949")}
    with pytest.raises(ValueError):
        C.read_csv_safe(spark, str(tmp_path / "m"), pattern="empty*.csv")


def test_generation(spark, folder):
    rows, rejects = C.read_generation(spark, str(folder / "meters"), [2024])
    assert {(r["path"].rsplit("/", 1)[1], r["reason"]) for r in rejects.collect()} == {
        ("nohours.csv", "no hour column"), ("nodate.csv", "no date column")}
    by_plant = {r["plant"]: r["n"] for r in rows.groupBy("plant").agg(F.count("*").alias("n")).collect()}
    assert by_plant == {"가 태양광": 48, "다 발전": 48}
    first = rows.filter("plant = '다 발전'").groupBy("ts").agg(F.sum("mwh").alias("m")).orderBy("ts").collect()
    assert first[0]["ts"] == dt.datetime(2024, 1, 1) and first[-1]["ts"] == dt.datetime(2024, 1, 1, 23)
    assert {r["m"] for r in first} == {1.5}
    odd = rows.filter("plant = '가 태양광' and hour(ts) = 0").agg(F.sum("mwh")).first()[0]
    assert odd == 0.0


def test_whole_training_table_from_files(spark, folder):
    table, rejects = training_table_from_files(
        spark, str(folder / "meters"), str(folder / "places"), str(folder / "stations.csv"), str(folder / "kma"),
        str(folder / "alias.json"), str(folder / "geo.json"), [2024])
    rows = table.collect()
    assert len(rows) == 48 and rejects.count() == 4
    first, second = rows[0], rows[1]
    assert (first["plant"], first["station"], first["station_name"]) == ("가 태양광", 10, "여수")
    assert (first["temperature"], first["rain"], second["temperature"], second["radiation"]) == (1.5, 0.0, 2.5, 0.0)
    assert rows[-1]["plant"] == "다 발전" and rows[-1]["station"] is None
    out = str(folder / "out.csv")
    sinks.write_training_csv(table, out)
    back = C.read_training_csv(spark, out)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert spark.read.option("header", True).csv(out).first()["합산발전량(MWh)"].count(".") == 1
    sinks.write_training_parquet(table, str(folder / "pq"))
    assert spark.read.parquet(str(folder / "pq")).filter("year = 2024").count() == 48


def test_listing(spark, folder):
    assert C.list_input_files(spark, str(folder / "meters")).count() == 5
    assert C.list_weather_files(spark, str(folder / "kma")).count() == 2


def test_json_lookups(spark, folder):
    geo = {r["address"]: (r["lat"], r["lon"]) for r in JF.read_geocode_cache(spark, str(folder / "geo.json")).collect()}
    assert geo == {"전남 가온시 나래면": (34.8, 127.6), "쌍": (1.0, 2.0), "빈": (None, None)}
    assert JF.read_alias_map(spark, str(folder / "missing.json")).count() == 0
    assert JF.read_geocode_cache(spark, str(folder / "missing.json")).columns == ["address", "lat", "lon"]
    put(folder / "loc.json", json.dumps([{"plant": "a", "station": 3}, {"plant": "b"}]))
    assert JF.read_json_records(spark, str(folder / "loc.json"), "plant string, station bigint").count() == 2
    assert JF.read_json_records(spark, str(folder / "none.json"), "plant string").count() == 0
    put(folder / "b.json", json.dumps({"type": "x", "features": [{"properties": {"name": "Seoul"}}, {"properties": {"name": "Jeju"}}]}))
    assert [r["name"] for r in JF.read_boundaries(spark, str(folder / "b.json")).collect()] == ["Seoul", "Jeju"]


def test_registry(spark, folder):
    put(folder / "reg.csv", "발전기명 ,광역지역,세부지역,설비용량\ng,서울,강남,1.5\n", "cp949")
    assert tuple(C.read_registry(spark, str(folder / "reg.csv")).first()) == ("g", "서울", "강남", "1.5")


def test_geocode_cache_upsert(spark, folder):
    path = str(folder / "cache")
    sinks.seed_geocode_cache(spark, str(folder / "geo.json"), path)
    new = spark.createDataFrame([("쌍", 9.0, 9.0), ("새", 3.0, 4.0)], "address string, lat double, lon double")
    sinks.write_geocode_cache(spark, path, new)
    got = {r["address"]: r["lat"] for r in spark.read.parquet(path).collect()}
    assert got == {"전남 가온시 나래면": 34.8, "쌍": 1.0, "빈": None, "새": 3.0}


def test_run_meta_and_json(spark, folder):
    meta = {"lags": 168, "열": ["가"], "metrics": {"MAE": 1.5}}
    sinks.write_run_meta(spark, meta, str(folder / "meta"))
    assert sinks.read_run_meta(spark, str(folder / "meta")) == meta
    sinks.write_json_records(spark.createDataFrame([("가",)], "a string"), str(folder / "j"))
    assert spark.read.json(str(folder / "j")).first()["a"] == "가"


def test_transcode(spark, folder):
    path = folder / "raw/발전량_2024_03.csv"
    path.parent.mkdir()
    path.write_bytes("이름,값\n가".encode("cp949") + b"\xff,1\n")
    (path.parent / "다른_2024_03.csv").write_bytes("나,2\n".encode("cp949"))
    sinks.transcode_files(spark, str(folder / "raw"), str(folder / "utf8"))
    got = spark.read.text(str(folder / "utf8"))
    assert {(r["value"], r["year"], r["month"], r["file"]) for r in got.collect()} == {
        ("이름,값", 2024, 3, "발전량_2024_03.csv"), ("가,1", 2024, 3, "발전량_2024_03.csv"), ("나,2", 2024, 3, "다른_2024_03.csv")}


def test_cells_that_are_no_finite_number_count_as_zero(spark):
    cells = ["inf", "-Infinity", "NaN", "1e300", "-1e300", "x", None, "2500"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, raw string")
    got = rows.select("i", convert_to_mwh(F.col("raw"), F.lit("kwh")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [0.0] * 7 + [2.5]


def test_new_cache_rows_are_one_per_address(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "address string, lat double, lon double"
    sinks.write_geocode_cache(spark, path, spark.createDataFrame([("a", 2.0, 1.0), ("a", 1.0, 9.0), ("b", None, None), ("b", 3.0, 4.0), (None, 1.0, 1.0)], schema))
    sinks.write_geocode_cache(spark, path, spark.createDataFrame([("a", 0.0, 0.0), ("c", None, None), ("c", None, None)], schema))
    assert sorted(map(str, map(tuple, spark.read.parquet(path).collect()))) == ["('a', 1.0, 9.0)", "('b', 3.0, 4.0)", "('c', None, None)"]


def test_location_files_count_in_order_of_their_full_path(spark, tmp_path):
    for name, address in (("b/a.csv", "later"), ("a/z.csv", "first")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"발전소명,위치\n가,{address}\n", "utf-8")
    rows, _ = C.read_locations(spark, str(tmp_path))
    first = dedupe_first(rows, ["plant"], ["row_ord"]).first()
    assert first["address"] == "first"


def test_forecast_tables_may_name_their_columns_otherwise(spark, tmp_path):
    put(tmp_path / "t.csv", "DateTime,Plant,target\n2024-01-01 05:00,a,1.5\n")
    row = C.read_training_csv(spark, str(tmp_path / "t.csv")).first()
    assert (row["plant"], row["mwh"], row["station"], row["ts"].hour) == ("a", 1.5, None, 5)
