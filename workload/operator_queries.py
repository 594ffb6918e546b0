"""Queries for single operators and for the file readers, each with its check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopanel import constants as K
from heliopanel.forecast import features as X
from heliopanel.functions import geo
from heliopanel.functions import text as T
from heliopanel.functions import timefx as TX
from heliopanel.operators import aggregates as A
from heliopanel.operators import evaluate as E
from heliopanel.operators import filters as P
from heliopanel.operators import joins as J
from heliopanel.operators import quantiles as Q
from heliopanel.operators import regions as R
from heliopanel.plans.training import locate_plants
from heliopanel.session import shared_folder
from heliopanel.sources import csv_files as C
from workload import standins as S
from workload.panel_queries import persistence
from workload.relational import _DISTANCE_SQL, big, canonical_sql, query, rounded
from workload.standins import HOUR_LABELS, SQL

_HOURS = {"1시": 1, "발전량 7시(kWh)": 7, "12-13시": 13, "23_24시": 24}


# --- readers ----------------------------------------------------------------------------

_FILE_ROWS = " UNION ALL ".join(
    f"""SELECT CASE WHEN suppkey % 2 = 0 THEN CAST(suppkey AS VARCHAR) || '태양광' ELSE '미상' END AS plant,
    day + to_hours({hour - 1}) AS ts, "{label}" / 1000.0::DOUBLE AS v FROM wide""" for label, hour in _HOURS.items())


@query(f"""
SELECT plant, ts, CAST(sum(CAST(round(v * 10000.0::DOUBLE) AS BIGINT)) AS DOUBLE) / 10000.0::DOUBLE AS mwh
FROM ({_FILE_ROWS}) GROUP BY plant, ts""", "wide")
def read_meter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written as cp949 comma files and UTF-8 tab files of another layout, read back together."""
    C.allow_korean_charset(spark)
    folder = shared_folder(spark)
    table = S.read(spark, sf_dir, "lineitem")
    key = F.col("l_suppkey")
    cells = [S.text(c).alias(label) for label, c in HOUR_LABELS.items()]
    named = table.filter(key % 2 == 0).select(
        F.concat(S.text(key), F.lit("태양광")).alias("발전소명"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("일자"), *cells)
    plain = table.filter(key % 2 != 0).select(
        S.text("l_linenumber").alias("호기"), *cells, F.date_format("l_shipdate", "yyyyMMdd").alias("거래일자"))
    named.write.option("header", True).option("encoding", C.KOREAN).csv(f"{folder}/named")
    plain.write.option("header", True).option("sep", "\t").csv(f"{folder}/plain")
    rows, _ = C.read_generation(spark, folder)
    # The unit number column 호기 carries no hour, so both layouts give four readings per row.
    return A.sum_by_plant_hour(rows)


@query("""
SELECT event_id, CAST(user_id % 5 AS BIGINT) AS station, 'S' || CAST(user_id % 5 AS VARCHAR) AS station_name,
       date_trunc('minute', ts) AS ts, value AS temperature, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS rain
FROM events""")
def read_weather_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a cp949 weather file set with gaps, read back; the event number rides in a measure."""
    C.allow_korean_charset(spark)
    folder = shared_folder(spark)
    events = S.read(spark, sf_dir, "events")
    rain = F.when(F.col("event_id") % 4 != 0, S.text("value"))
    events.select(
        S.text(F.col("user_id") % 5).alias("지점"), F.concat(F.lit("S"), S.text(F.col("user_id") % 5)).alias("지점명"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("일시"), S.text("value").alias("기온(°C)"), rain.alias("강수량(mm)"),
        F.lit("x").alias("일조(hr)"), S.text("event_id").alias("일사(MJ/m2)"),
    ).write.option("header", True).option("encoding", C.KOREAN).csv(f"{folder}/parts")
    table = C.read_csv_safe(spark, f"{folder}/parts")
    typed = C.weather_columns(table)
    return typed.select(F.col("radiation").cast("bigint").alias("event_id"), "station", "station_name", "ts", "temperature", "rain")


# --- joins ------------------------------------------------------------------------------

@query("""
SELECT g.plant, g.ts, g.mwh, coalesce(n.n_name, g.plant) AS canonical
FROM gen g LEFT JOIN nation n ON g.plant = 'P' || CAST(n.n_nationkey * 2 AS VARCHAR)""", "gen")
def join_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.join_alias(S.generation(spark, sf_dir), S.alias(spark, sf_dir))


@query("""
, loc AS (
    SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'NATION_' || CAST((s_suppkey // 2) % 25 AS VARCHAR)
                ELSE 'P' || CAST(s_suppkey % 64 AS VARCHAR) END AS plant,
           s_suppkey % 7 AS station, 'S' || CAST(s_suppkey % 7 AS VARCHAR) AS station_name,
           row_number() OVER (PARTITION BY CASE WHEN s_suppkey % 2 = 0 THEN 'NATION_' || CAST((s_suppkey // 2) % 25 AS VARCHAR)
                ELSE 'P' || CAST(s_suppkey % 64 AS VARCHAR) END ORDER BY s_suppkey) AS rn
    FROM supplier)
SELECT g.plant, count(*) AS hours, l.station, l.station_name
FROM gen g LEFT JOIN nation n ON g.plant = 'P' || CAST(n.n_nationkey * 2 AS VARCHAR)
LEFT JOIN loc l ON l.rn = 1 AND l.plant = coalesce(n.n_name, g.plant) GROUP BY ALL""", "gen")
def join_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = J.join_location(J.join_alias(S.generation(spark, sf_dir), S.alias(spark, sf_dir)),
                             S.location(spark, sf_dir), order=("ord",))
    return placed.groupBy("plant", "station", "station_name").agg(F.count("*").alias("hours"))


@query("""
WITH wx AS (
    SELECT user_id % 5 AS station, date_trunc('hour', ts) AS ts, value, event_id,
           row_number() OVER (PARTITION BY user_id % 5, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events)
SELECT e.event_id, CAST(nullif(e.user_id % 7, 6) AS BIGINT) AS station, date_trunc('hour', e.ts) AS ts, w.value AS radiation
FROM events e LEFT JOIN wx w ON w.rn = 1 AND w.station = nullif(e.user_id % 7, 6) AND w.ts = date_trunc('hour', e.ts)""")
def join_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the first weather row of its station and hour; some stations are null or unknown."""
    k = F.col("user_id") % 7
    left = S.read(spark, sf_dir, "events").select("event_id", F.when(k != 6, k).cast("bigint").alias("station"), "ts")
    hourly = J.hourly_weather(S.weather(spark, sf_dir), ("seen", "event_id")).select("station", "ts", "radiation")
    return J.join_weather(left, hourly)


_SIMPLE = """simple AS (
    SELECT site, address, array_to_string(CASE WHEN len(k) > 0 THEN k[1:3] ELSE w[1:3] END, ' ') AS simple FROM (
        SELECT *, CASE WHEN regexp_matches(w[1], '^(PROVINCES)')
            THEN list_concat([w[1]], list_filter(w[2:], lambda x: regexp_matches(x, '(ENDINGS)$')))
            ELSE list_filter(w, lambda x: regexp_matches(x, '(ENDINGS)$')) END AS k
        FROM (SELECT site, address, string_split_regex(trim(address), '\\s+') AS w FROM addr)))"""
SQL["simple"] = _SIMPLE.replace("PROVINCES", "|".join(K.PROVINCES_LONG + K.PROVINCES_SHORT)).replace(
    "ENDINGS", "|".join(K.DISTRICT_ENDINGS))


@query(f"""
, points AS (SELECT a.site, a.simple AS address, g.lat, g.lon FROM simple a LEFT JOIN geocode g ON g.address = a.simple),
near AS (
    SELECT s.site, t.station, t.station_name,
           row_number() OVER (PARTITION BY s.site ORDER BY round({_DISTANCE_SQL}, 9), t.ord) AS rn
    FROM points s, stations t WHERE s.lat IS NOT NULL)
SELECT p.site, p.address, p.lat, p.lon, n.station, n.station_name
FROM points p LEFT JOIN near n ON n.site = p.site AND n.rn = 1""", "addr", "simple", "geocode", "stations")
def locate_plant_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses simplified, looked up, and given their nearest station once per distinct address."""
    places = S.supplier_addresses(spark, sf_dir).withColumn("address", T.simplify_address(F.col("address")))
    located = locate_plants(places, S.geocode(spark, sf_dir), S.stations(spark, sf_dir))
    return located.select("site", "address", "lat", "lon", "station", "station_name")


@query(f"""
SELECT s.site, t.station, round({_DISTANCE_SQL}, 6) AS distance
FROM sites s JOIN stations t ON t.station = s.site % 25""", "sites", "stations")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = S.sites(spark, sf_dir).withColumn("station", (F.col("site") % 25).cast("bigint"))
    stations = S.stations(spark, sf_dir).select("station", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    distance = geo.haversine(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    return sites.join(stations, "station").select("site", "station", rounded(distance, 6).alias("distance"))


@query("SELECT DISTINCT plant FROM gen", "gen")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_values(S.generation_rows(spark, sf_dir), "plant")


# --- filters and projections ------------------------------------------------------------

@query("SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber, l_shipdate AS day FROM lineitem "
       "WHERE year(l_shipdate) IN (1996, 1998) AND l_shipdate >= TIMESTAMP '1996-03-01'")
def filter_years_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"),
                                                    big("l_linenumber").alias("linenumber"), F.col("l_shipdate").alias("day"))
    return P.filter_since(P.filter_years(rows, "day", [1996, 1998]), "day", "1996-03-01")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE contains(c_mktsegment, 'BUI') AND c_acctbal >= 0")
def filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null names never match."""
    rows = S.read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return P.filter_contains(rows, "c_mktsegment", "BUI")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE c_mktsegment END AS segment, "
       "'태양광' AS energy_source FROM customer")
def replace_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.select_rename(S.read(spark, sf_dir, "customer"), {"c_custkey": "c_custkey", "c_mktsegment": "segment"})
    return P.with_constant_default(P.replace_values(rows, "segment", {"BUILDING": "b", "MACHINERY": "m"}),
                                   "energy_source", K.SOLAR)


@query("""
SELECT event_id, CASE WHEN value < 5 THEN 0 ELSE value END AS measure,
       CASE WHEN value < 5 THEN NULL ELSE event_type END AS name FROM events WHERE event_type <> 'error'""")
def fill_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures are filled, text is not; rows that lack a needed column leave."""
    value, kind = F.col("value"), F.col("event_type")
    rows = S.read(spark, sf_dir, "events").select(
        "event_id", F.when(value >= 5, value).alias("measure"), F.when(value >= 5, kind).alias("name"),
        F.when(kind != "error", F.lit(1)).alias("needed"))
    return P.fill_zero(P.filter_not_null(rows, ["needed"]), ["measure"]).drop("needed")


@query(f"SELECT generator, {canonical_sql('region_raw')} AS region FROM registry WHERE capacity >= 0", "registry")
def filter_nonempty_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("capacity").cast("double") >= 0, F.col("region"))
    rows = S.registry(spark, sf_dir).select("generator", T.to_canonical(raw).alias("region"))
    return P.filter_nonempty_region(rows)


# --- aggregates -------------------------------------------------------------------------

@query("SELECT max(ts) AS max_ts FROM gen", "gen")
def max_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.max_time(S.generation(spark, sf_dir))


@query("SELECT plant, round(avg(mwh), 6) AS mean, round(stddev_samp(mwh), 6) AS std FROM gen GROUP BY plant", "gen")
def mean_std_by_plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = A.mean_std_by_plant(S.generation(spark, sf_dir), ["mwh"])
    return table.select("plant", rounded("mean_mwh", 6).alias("mean"), rounded("std_mwh", 6).alias("std"))


_SHARES = [0.05, 0.5, 0.95, 0.999, 1.0]


@query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(l_extendedprice, {q}), 6) AS value FROM lineitem"
                          for q in _SHARES))
def quantile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliopanel.session import literal_rows

    found = Q.quantiles_exact(S.read(spark, sf_dir, "lineitem"), {str(q): ("l_extendedprice", q) for q in _SHARES})
    rows = [(q, found[str(q)]) for q in _SHARES]
    return literal_rows(spark, rows, "q double, value double").withColumn("value", rounded("value", 6))


@query("""
SELECT l_suppkey AS suppkey, l_returnflag AS flag FROM (
    SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS rn
    FROM lineitem GROUP BY 1, 2) WHERE rn = 1""")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("f"))
    return Q.most_frequent(rows, ["suppkey"], "f", "flag")


@query("""
SELECT plant, count(*) AS n, CAST(sum(abs(yu - pu)) AS DOUBLE) / count(*) / 10000.0::DOUBLE AS mae,
       round(sqrt(CAST(sum((yu - pu)::HUGEINT * (yu - pu)) AS DOUBLE) / count(*)) / 10000.0::DOUBLE, 9) AS rmse
FROM persist WHERE pu IS NOT NULL GROUP BY plant""", "gen", "panel", "persist")
def metrics_by_plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = persistence(spark, sf_dir).na.drop(subset=["y_pred"])
    table = E.regression_metrics(rows, by=["plant"], scale=K.MWH_SCALE)
    return table.select("plant", "n", "mae", rounded("rmse").alias("rmse"))


@query("""
, c AS (SELECT region, plants, capacity FROM stats)
SELECT region, plants, capacity, row_number() OVER (ORDER BY plants DESC, region) - 1 AS place FROM c""", "registry", "std", "stats")
def sort_by_count_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = P.sort_by_count_desc(R.region_stats(S.located_registry(spark, sf_dir)), "plants", "region")
    ranked = R.with_row_number(ordered, [F.desc("plants"), F.asc("region")], "n")
    return ranked.select("region", "plants", "capacity", (big("n") - 1).alias("place"))


@query("""
SELECT plant, ts, round(mwh * 24, 6) AS mwh FROM gen""", "gen")
def apply_unit_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.apply_unit_factor(S.generation(spark, sf_dir), ["mwh"], 24.0).withColumn("mwh", rounded("mwh", 6))


@query("""
SELECT plant, ts, round(mwh, 6) AS y_true, round(coalesce(y_pred, 0), 6) AS y_pred, round(mwh - coalesce(y_pred, 0), 6) AS resid,
       round(abs(mwh - coalesce(y_pred, 0)), 6) AS abs_err
FROM (SELECT plant, ts, y_true AS mwh, y_pred FROM persist)""", "gen", "panel", "persist")
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.with_residual(P.zero_non_finite_columns(persistence(spark, sf_dir), ["y_pred"]))
    return rows.select("plant", "ts", *[rounded(c, 6).alias(c) for c in ("y_true", "y_pred", "resid", "abs_err")])


@query("""
SELECT plant, date_trunc('week', ts) AS week, count(*) AS hours,
       CAST(sum(CAST(round(mwh * 10000.0::DOUBLE) AS BIGINT)) AS DOUBLE) / 10000.0::DOUBLE AS mwh
FROM gen GROUP BY 1, 2""", "gen")
def weekly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that end on Sunday, as a second anchor of the same calendar function."""
    from heliopanel.functions.scale import exact_sum

    week = TX.week_start(F.col("ts"), "W-SUN").alias("week")
    return S.generation(spark, sf_dir).groupBy("plant", week).agg(
        F.count("*").alias("hours"), exact_sum(F.col("mwh"), K.MWH_SCALE).alias("mwh"))
