"""Queries on ingest, text, joins, regions and evaluation, each with its check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopanel import constants as K
from heliopanel.functions import text as T
from heliopanel.functions import timefx as TX
from heliopanel.operators import aggregates as A
from heliopanel.operators import evaluate as E
from heliopanel.operators import filters as P
from heliopanel.operators import joins as J
from heliopanel.operators import regions as R
from heliopanel.operators.reshape import melt_hours
from heliopanel.plans.training import training_table
from heliopanel.sources.csv_files import meter_rows, read_headers
from workload import standins as S
from workload.standins import ADDRESSES, HOUR_LABELS, SQL, sql_list

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    """Register a query under its function name, with check SQL over the named derivations."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            tables = ",\n".join(SQL[n] for n in needs)
            ORACLE[function.__name__] = (f"WITH {tables}\n" if tables else "") + sql
        return function
    return register


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def rounded(c: Column | str, places: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# --- training table ---------------------------------------------------------------------

@query("""
, hourly AS (
    SELECT 'P' || CAST(user_id AS VARCHAR) AS plant, date_trunc('hour', ts) AS ts,
           CAST(sum(CAST(round(value * 10000.0::DOUBLE) AS BIGINT)) AS DOUBLE) / 10000.0::DOUBLE AS mwh
    FROM events GROUP BY 1, 2),
alias AS (SELECT 'P' || CAST(n_nationkey * 2 AS VARCHAR) AS plant, n_name AS canonical FROM nation),
loc AS (
    SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'NATION_' || CAST((s_suppkey // 2) % 25 AS VARCHAR)
                ELSE 'P' || CAST(s_suppkey % 64 AS VARCHAR) END AS plant,
           s_suppkey % 7 AS station, 'S' || CAST(s_suppkey % 7 AS VARCHAR) AS station_name, s_suppkey AS ord
    FROM supplier),
loc1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plant ORDER BY ord) AS rn FROM loc) WHERE rn = 1),
wx AS (
    SELECT user_id % 5 AS station, date_trunc('hour', ts) AS hour,
           CAST(json_extract(props, '$.k') AS INTEGER) AS k, value,
           row_number() OVER (PARTITION BY user_id % 5, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn
    FROM events)
SELECT h.ts, h.plant, l.station_name, l.station, h.mwh,
       coalesce(CAST(w.k AS DOUBLE), 0) AS temperature, coalesce(CAST(w.k % 7 AS DOUBLE), 0) AS rain,
       coalesce(CAST(w.k % 11 AS DOUBLE), 0) AS sunshine, coalesce(w.value, 0) AS radiation
FROM hourly h
LEFT JOIN alias a ON a.plant = h.plant
LEFT JOIN loc1 l ON l.plant = coalesce(a.canonical, h.plant)
LEFT JOIN (SELECT * FROM wx WHERE rn = 1) w ON w.station = l.station AND w.hour = h.ts
""".replace(", hourly AS", "WITH hourly AS", 1))
def training_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_table(S.events_generation(spark, sf_dir), S.alias(spark, sf_dir), S.location(spark, sf_dir),
                          S.weather(spark, sf_dir), ("ord",), ("seen", "event_id"))


QUERIES["training_table"] = QUERIES.pop("training_table_query")
ORACLE["training_table"] = ORACLE.pop("training_table_query")


# --- reshape and ingest -----------------------------------------------------------------

@query(" UNION ALL ".join(
    f"SELECT orderkey, linenumber, day, '{label}' AS hour_label, CAST(\"{label}\" AS DOUBLE) AS value FROM wide"
    for label in HOUR_LABELS), "wide")
def melt_wide_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = melt_hours(S.wide_meter(spark, sf_dir), ["orderkey", "linenumber", "day"], list(HOUR_LABELS))
    return long.select("orderkey", "linenumber", "day", "hour_label", F.col("raw").cast("double").alias("value"))


_METER_SQL = " UNION ALL ".join(
    f"SELECT plant, day + to_hours({hour - 1}) AS ts, \"{label}\" / 1000.0::DOUBLE AS v FROM named"
    for label, hour in (("1시", 1), ("발전량 7시(kWh)", 7), ("12-13시", 13), ("23_24시", 24)))


@query(f"""
, named AS (
    SELECT CASE WHEN flag = 'A' THEN '(군산)영암F1태양광'
                ELSE CAST(suppkey AS VARCHAR) || '태양광' END AS plant, *
    FROM wide WHERE year(day) IN (1996, 1997, 1998) AND flag <> 'N')
SELECT plant, ts, CAST(sum(CAST(round(v * 10000.0::DOUBLE) AS BIGINT)) AS DOUBLE) / 10000.0::DOUBLE AS mwh
FROM ({_METER_SQL}) GROUP BY plant, ts""", "wide")
def meter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole meter path on text columns: header roles, name and year filter, unpivot, units, sum."""
    key, flag = F.col("l_suppkey"), F.col("l_returnflag")
    name = (F.when(flag == "A", F.lit("영암에프원태양광b")).when(flag == "N", F.concat(S.text(key), F.lit("풍력")))
            .otherwise(F.concat(S.text(key), F.lit("태양광 "))))
    table = S.read(spark, sf_dir, "lineitem").select(
        name.alias("발전소"), F.date_format("l_shipdate", "yyyy/MM/dd").alias("거래일자"),
        *[S.text(c).alias(label) for label, c in HOUR_LABELS.items()], F.lit("x.csv").alias("source_file"))
    header = read_headers(spark, [[c for c in table.columns if c != "source_file"]])[0]
    return A.sum_by_plant_hour(meter_rows(table, header, [1996, 1997, 1998]))


@query("""
SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber, l_returnflag AS unit_flag,
       CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 0
            ELSE round(l_extendedprice / (CASE l_returnflag WHEN 'A' THEN 1000000.0 WHEN 'R' THEN 1000.0 ELSE 1.0 END)::DOUBLE
                       * 10000.0::DOUBLE) / 10000.0::DOUBLE END AS mwh
FROM lineitem""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    unit = F.when(flag == "A", F.lit("wh")).when(flag == "R", F.lit("kwh")).otherwise(F.lit("mwh"))
    raw = F.when((flag == "N") & (F.col("l_linenumber") == 7), F.lit("1,234")).otherwise(S.text("l_extendedprice"))
    return S.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), big("l_linenumber").alias("linenumber"), flag.alias("unit_flag"),
        T.convert_to_mwh(raw, unit).alias("mwh"))


@query("""
SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month,
       date_trunc('month', l_shipdate)::DATE AS first_day, last_day(l_shipdate) AS last_day,
       strftime(date_trunc('month', l_shipdate), '%Y%m%d') AS start_text,
       strftime(last_day(l_shipdate), '%Y%m%d') AS end_text,
       count(*) AS readings
FROM lineitem GROUP BY ALL""")
def month_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = S.read(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"),
                                                     F.month("l_shipdate").alias("month")).agg(F.count("*").alias("readings"))
    ranges = days.select("year").distinct().select("year", F.inline(TX.month_range_array(F.col("year"))))
    return ranges.join(days, ["year", "month"]).select(
        big("year").alias("year"), big("month").alias("month"), "first_day", "last_day", "start_text", "end_text",
        "readings")


_LABEL_SQL = """CASE l_linenumber
    WHEN 1 THEN CAST(q AS VARCHAR) || '시' WHEN 2 THEN CAST(q - 1 AS VARCHAR) || '-' || CAST(q AS VARCHAR) || '시'
    WHEN 3 THEN CAST(q - 1 AS VARCHAR) || ' _ ' || CAST(q AS VARCHAR) WHEN 4 THEN '발전량 ' || CAST(q AS VARCHAR) || ' 시(kWh)'
    WHEN 5 THEN '호기' || CAST(q AS VARCHAR) WHEN 6 THEN '설비용량(' || CAST(q * 100 AS VARCHAR) || ')' ELSE '비고' END"""


@query(rf"""
, labelled AS (SELECT {_LABEL_SQL} AS label, l_linenumber AS kind, q
               FROM (SELECT l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem))
SELECT label, CASE WHEN h BETWEEN 1 AND 24 THEN h END AS hour, count(*) AS readings FROM (
    SELECT label, CAST(CASE
        WHEN regexp_matches(label, '\d{{1,2}}\s*[-~_]\s*\d{{1,2}}') THEN nullif(regexp_extract(label, '\d{{1,2}}\s*[-~_]\s*(\d{{1,2}})', 1), '')
        WHEN regexp_matches(label, '\d{{1,2}}\s*시') THEN nullif(regexp_extract(label, '(\d{{1,2}})\s*시', 1), '')
        WHEN regexp_matches(label, '(^|\D)\d{{1,2}}($|\D)') THEN nullif(regexp_extract(label, '(^|\D)(\d{{1,2}})($|\D)', 2), '')
        END AS BIGINT) AS h FROM labelled) GROUP BY 1, 2""".replace(", labelled AS", "WITH labelled AS", 1))
def extract_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    kind = F.col("l_linenumber")
    label = (F.when(kind == 1, F.concat(S.text(q), F.lit("시")))
             .when(kind == 2, F.concat(S.text(q - 1), F.lit("-"), S.text(q), F.lit("시")))
             .when(kind == 3, F.concat(S.text(q - 1), F.lit(" _ "), S.text(q)))
             .when(kind == 4, F.concat(F.lit("발전량 "), S.text(q), F.lit(" 시(kWh)")))
             .when(kind == 5, F.concat(F.lit("호기"), S.text(q)))
             .when(kind == 6, F.concat(F.lit("설비용량("), S.text(q * 100), F.lit(")")))
             .otherwise(F.lit("비고")))
    counted = S.read(spark, sf_dir, "lineitem").groupBy(label.alias("label")).agg(F.count("*").alias("readings"))
    return counted.select("label", big(T.extract_hour(F.col("label"))).alias("hour"), "readings")


@query("""
SELECT s_suppkey AS site, CASE WHEN s_suppkey % 3 = 0 THEN '미상' ELSE s_name END AS plant FROM supplier""")
def plant_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    name = F.when(key % 3 == 0, F.concat(F.col("s_name"), F.lit(".csv"))).otherwise(
        F.concat(F.lit("발전량["), F.col("s_name"), F.lit(" ]_[b].csv")))
    return S.read(spark, sf_dir, "supplier").select(
        key.alias("site"), F.coalesce(T.extract_plant_name(name), F.lit(K.UNKNOWN_PLANT)).alias("plant"))


@query("""
SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END AS day FROM lineitem""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, day = F.col("l_linenumber"), F.col("l_shipdate")
    text = (F.when(kind == 7, F.lit("20240230")).when(kind == 6, F.date_format(day, "yyyy-MM-dd 00:00"))
            .when(kind % 3 == 0, F.date_format(day, "yyyyMMdd")).when(kind % 3 == 1, F.date_format(day, "yyyy.MM.dd"))
            .otherwise(F.date_format(day, "yyyy/MM/dd")))
    return S.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), big(kind).alias("linenumber"), TX.strip_digits_date(text).alias("day"))


@query("""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN date_trunc('second', ts)
                      ELSE date_trunc('minute', ts) END AS ts,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS hour
FROM events""")
def parse_mixed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = (F.when(i % 11 == 0, F.lit("2024-13-01 00:00")).when(i % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .when(i % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm")))
    parsed = TX.parse_mixed_ts(text)
    return S.read(spark, sf_dir, "events").select("event_id", parsed.alias("ts"), TX.floor_hour(parsed).alias("hour"))


@query("""
SELECT event_id, date_trunc('day', ts) + to_hours(CAST(least(hour(ts) + event_id % 3, 23) AS INTEGER)) AS ts FROM events""")
def detect_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No candidate column parses, so date and hour columns are combined."""
    table = S.read(spark, sf_dir, "events").select(
        "event_id", F.lit("n/a").alias("일시"), F.date_format("ts", "yyyy-MM-dd").alias("일자"),
        F.concat(S.text(F.hour("ts") + F.col("event_id") % 3), F.lit("시")).alias("시간"))
    return P.detect_datetime(table).select("event_id", "ts")


@query("SELECT 'lineitem.parquet' AS source_file, count(*) AS readings FROM lineitem")
def source_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = P.with_source_file(S.read(spark, sf_dir, "lineitem"))
    return tagged.groupBy("source_file").agg(F.count("*").alias("readings"))


# --- text -------------------------------------------------------------------------------

_PROVINCE = "^(" + "|".join(K.PROVINCES_LONG + K.PROVINCES_SHORT) + ")"
_DISTRICT = "(" + "|".join(K.DISTRICT_ENDINGS) + ")$"


@query(f"""
, words AS (SELECT site, address, string_split_regex(trim(address), '\\s+') AS w FROM addr),
kept AS (
    SELECT *, CASE WHEN regexp_matches(w[1], '{_PROVINCE}')
                   THEN list_concat([w[1]], list_filter(w[2:], lambda x: regexp_matches(x, '{_DISTRICT}')))
                   ELSE list_filter(w, lambda x: regexp_matches(x, '{_DISTRICT}')) END AS k FROM words)
SELECT site, address, array_to_string(CASE WHEN len(k) > 0 THEN k[1:3] ELSE w[1:3] END, ' ') AS simple FROM kept""", "addr")
def simplify_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.supplier_addresses(spark, sf_dir).withColumn("simple", T.simplify_address(F.col("address")))


def canonical_sql(raw: str, anchored: bool = False) -> str:
    start = "^" if anchored else ""
    cases = " ".join(f"WHEN regexp_matches(regexp_replace({raw}, '\\s+', '', 'g'), '{start}({p})') THEN '{name}'"
                     for name, p in K.REGION_PATTERNS.items())
    return f"CASE WHEN {raw} IS NULL THEN '' {cases} ELSE trim({raw}) END"


def display_sql(c: str) -> str:
    return f"CASE WHEN {c} = '전라북도' THEN '전북특별자치도' ELSE {c} END"


@query(f"""
SELECT generator, region_raw, region, anchored, {display_sql('region')} AS display FROM (
    SELECT generator, region_raw, {canonical_sql('region_raw')} AS region,
           {canonical_sql('region_raw', True)} AS anchored FROM registry)""", "registry")
def canonical_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("region")
    region = T.to_canonical(raw)
    return S.registry(spark, sf_dir).select(
        "generator", raw.alias("region_raw"), region.alias("region"),
        T.to_canonical(raw, anchored=True).alias("anchored"), T.display_region_name(region).alias("display"))


@query("""
, texts AS (
    SELECT generator, CASE WHEN c_custkey % 5 = 0 THEN NULL
        ELSE '  ' || region_raw || '   ' || subregion || ' ' || region_raw END AS raw FROM registry)
SELECT generator, coalesce(regexp_replace(trim(raw), '\\s+', ' ', 'g'), '') AS collapsed,
       coalesce(regexp_replace(trim(raw), '^(\\s*(PREFIXES))+\\s*', ''), '') AS stripped,
       lower(regexp_replace(trim(raw), '[\\s\\-_/()\\[\\].]+', '', 'g')) AS plain
FROM texts""".replace("PREFIXES", "|".join(sorted(K.REGION_PREFIXES, key=lambda r: (-len(r), r)))), "registry")
def subregion_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("  "), "region", F.lit("   "), "subregion", F.lit(" "), "region"))
    return S.registry(spark, sf_dir).select(
        "generator", T.normalize_subregion(raw).alias("collapsed"), T.strip_region_prefix_any(raw).alias("stripped"),
        T.norm(raw).alias("plain"))


@query("""
SELECT generator, CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS valid
FROM registry""", "registry")
def valid_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    label = F.when(k == 1, F.lit(" nan ")).when(k == 2, F.lit("알수없음")).when(k == 3, F.col("region"))
    return S.registry(spark, sf_dir).select("generator", T.valid_region(label).alias("valid"))


@query("""SELECT 'P' || CAST(user_id AS VARCHAR) AS plant, count(*) AS readings,
       printf('%.4f', CAST(sum(CAST(round(value * 10000.0::DOUBLE) AS BIGINT)) AS DOUBLE) / 10000.0::DOUBLE) AS mwh_text,
       strftime(date_trunc('hour', max(ts)), '%Y-%m-%d %H:%M:%S') AS last_text
FROM events GROUP BY 1""")
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliopanel.functions.scale import exact_sum

    return (S.read(spark, sf_dir, "events").groupBy(F.concat(F.lit("P"), S.text("user_id")).alias("plant"))
            .agg(F.count("*").alias("readings"), exact_sum(F.col("value"), K.MWH_SCALE).alias("v"), F.max("ts").alias("t"))
            .select("plant", "readings", T.format_fixed4(F.col("v")).alias("mwh_text"),
                    TX.format_ts(TX.floor_hour(F.col("t"))).alias("last_text")))


# --- joins and geography ----------------------------------------------------------------

@query("SELECT a.site, a.address, g.lat, g.lon FROM addr a LEFT JOIN geocode g ON trim(a.address) = g.address",
       "addr", "geocode")
def geocode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.join_geocode(S.supplier_addresses(spark, sf_dir), S.geocode(spark, sf_dir))


@query("SELECT DISTINCT trim(address) AS address FROM addr WHERE trim(address) NOT IN (SELECT address FROM geocode)",
       "addr", "geocode")
def unresolved_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unresolved_addresses(S.supplier_addresses(spark, sf_dir), S.geocode(spark, sf_dir))


_DISTANCE_SQL = """2 * 6371.0::DOUBLE * asin(sqrt(least(1.0,
    sin((radians(t.lat) - radians(s.lat)) / 2) * sin((radians(t.lat) - radians(s.lat)) / 2)
    + cos(radians(s.lat)) * cos(radians(t.lat))
      * sin((radians(t.lon) - radians(s.lon)) / 2) * sin((radians(t.lon) - radians(s.lon)) / 2))))"""


@query(f"""
SELECT site, station, station_name, round(distance, 6) AS distance FROM (
    SELECT s.site, t.station, t.station_name, {_DISTANCE_SQL} AS distance,
           row_number() OVER (PARTITION BY s.site ORDER BY round({_DISTANCE_SQL}, 9), t.ord) AS rn
    FROM sites s, stations t) WHERE rn = 1""", "sites", "stations")
def nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = J.nearest_station(S.sites(spark, sf_dir), S.stations(spark, sf_dir))
    return near.select("site", "station", "station_name", rounded("distance", 6).alias("distance"))


@query(f"""
WITH sites AS (SELECT p_partkey AS site, -20 + (p_partkey * 7919 % 100003) / 1000.0::DOUBLE AS lat, 60 + (p_partkey * 104729 % 100019) / 800.0::DOUBLE AS lon FROM part),
stations AS (
    SELECT c_custkey AS station, c_name AS station_name, c_custkey AS ord,
           33 + (c_custkey * 48611 % 99991) / 16666.0::DOUBLE AS lat, 124 + (c_custkey * 15485863 % 99989) / 12498.0::DOUBLE AS lon FROM customer)
SELECT s.site, arg_min(t.station, {_DISTANCE_SQL}) AS station, round(min({_DISTANCE_SQL}), 6) AS distance
FROM sites s, stations t GROUP BY 1""")
def nearest_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of all customers as stations, for parts in and far around the country."""
    part, customer = F.col("p_partkey"), F.col("c_custkey")
    sites = S.read(spark, sf_dir, "part").select(part.alias("site"), (F.lit(-20) + (part * 7919 % 100003) / 1000.0).alias("lat"),
                                                 (F.lit(60) + (part * 104729 % 100019) / 800.0).alias("lon"))
    stations = S.read(spark, sf_dir, "customer").select(
        customer.alias("station"), F.col("c_name").alias("station_name"), customer.alias("ord"),
        (F.lit(33) + (customer * 48611 % 99991) / 16666.0).alias("lat"), (F.lit(124) + (customer * 15485863 % 99989) / 12498.0).alias("lon"))
    return J.nearest_station(sites, stations).select("site", "station", rounded("distance", 6).alias("distance"))


@query("""
SELECT k, event_type, event_id, ts, value FROM (
    SELECT user_id % 97 AS k, *, row_number() OVER (PARTITION BY user_id % 97, event_type ORDER BY ts, event_id) AS rn
    FROM events) WHERE rn = 1""")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("k"), "event_type", "event_id", "ts", "value")
    return A.dedupe_first(rows, ["k", "event_type"], ["ts", "event_id"])


@query("SELECT DISTINCT plant, ts, mwh FROM gen", "gen")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen = S.generation(spark, sf_dir)
    return A.dedupe_exact(A.union_all([gen, gen]), ["plant", "ts", "mwh"])


@query("""
SELECT origin, count(*) AS readings, min(ts) AS first_ts, max(ts) AS last_ts FROM (
    SELECT CASE WHEN ts < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS origin, ts FROM gen) GROUP BY 1""", "gen")
def union_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen = S.generation(spark, sf_dir)
    cut = F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz")
    stacked = A.union_train_test({"train": gen.filter(cut).withColumn("extra", F.lit(1)), "test": gen.filter(~cut)})
    return stacked.groupBy("origin").agg(F.count("*").alias("readings"), F.min("ts").alias("first_ts"),
                                         F.max("ts").alias("last_ts"))


# --- regions ----------------------------------------------------------------------------

_STD = f"""std AS (
    SELECT generator, {canonical_sql('region_raw')} AS region, subregion, capacity,
           33 + (c_custkey % 40) / 8.0::DOUBLE AS lat, 126 + (c_custkey % 15) / 8.0::DOUBLE AS lon FROM registry)"""
SQL["std"] = _STD
_CAPACITY = "CAST(sum(CAST(round(capacity * 10000.0::DOUBLE) AS BIGINT)) AS DOUBLE) / 10000.0::DOUBLE"
SQL["stats"] = f"stats AS (SELECT region, count(generator) AS plants, {_CAPACITY} AS capacity FROM std GROUP BY region)"
_ORDER = "CASE region " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(K.CANONICAL_REGIONS)) + " ELSE 999 END"


@query(f"SELECT region, plants, capacity, CAST({_ORDER} AS BIGINT) AS region_order FROM stats", "registry", "std", "stats")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = R.region_stats(S.located_registry(spark, sf_dir))
    return R.sort_regions_canonical(stats).withColumn("region_order", big("region_order"))


_MODE = """(SELECT {c} FROM (SELECT {c}, count(*) AS c FROM std x WHERE x.lat = s.lat AND x.lon = s.lon
    GROUP BY {c}) ORDER BY c DESC, {c} LIMIT 1)"""
SQL["modes"] = """modes AS (
    SELECT lat, lon, max(CASE WHEN rr = 1 THEN v END) FILTER (WHERE kind = 'r') AS region,
           max(CASE WHEN rr = 1 THEN v END) FILTER (WHERE kind = 's') AS subregion
    FROM (SELECT lat, lon, kind, v, row_number() OVER (PARTITION BY lat, lon, kind ORDER BY count(*) DESC, v) AS rr
          FROM (SELECT lat, lon, 'r' AS kind, region AS v FROM std UNION ALL SELECT lat, lon, 's', subregion FROM std)
          GROUP BY lat, lon, kind, v) GROUP BY lat, lon)"""


@query(f"""
SELECT t.lat, t.lon, t.plants, t.capacity, m.region, m.subregion, round(pow(t.plants, 0.2), 9) AS radius
FROM (SELECT lat, lon, count(generator) AS plants, {_CAPACITY} AS capacity FROM std GROUP BY lat, lon) t
JOIN modes m USING (lat, lon)""", "registry", "std", "modes")
def site_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = R.markers(R.site_stats(S.located_registry(spark, sf_dir)))
    return sites.withColumn("radius", rounded("radius"))


@query(f"""
SELECT row_number() OVER (ORDER BY plants DESC, region) AS rank, {display_sql('region')} AS region, plants, capacity
FROM stats""", "registry", "std", "stats")
def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.rank_table(R.region_stats(S.located_registry(spark, sf_dir)))
    return ranked.withColumn("rank", big("rank"))


_KOREAN = "CASE name " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in K.BOUNDARY_NAMES.items()) + " ELSE name END"


@query(f"""
, joined AS (
    SELECT b.name, {_KOREAN.replace('name', 'b.name')} AS region, coalesce(s.plants, 0) AS plants,
           coalesce(s.capacity, 0) AS capacity
    FROM boundaries b LEFT JOIN stats s ON s.region = {_KOREAN.replace('name', 'b.name')})
SELECT name, region, plants, capacity,
       round(0.3::DOUBLE + 0.7::DOUBLE * (plants / max(plants) OVER ())::DOUBLE, 9) AS alpha FROM joined""",
       "registry", "std", "stats", "boundaries")
def choropleth(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = R.region_stats(S.located_registry(spark, sf_dir))
    shaded = R.choropleth(J.join_region_stats(S.boundaries(spark, sf_dir), stats))
    return shaded.select("name", "region", "plants", "capacity", rounded("alpha").alias("alpha"))


# --- calendar ---------------------------------------------------------------------------

@query("""
SELECT plant, ts, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS dayofweek,
       CAST(month(ts) AS BIGINT) AS month, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend,
       round(sin(hour(ts) * 2 * pi() / 24), 9) AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 9) AS hour_cos,
       round(sin(month(ts) * 2 * pi() / 12), 9) AS month_sin, round(cos(month(ts) * 2 * pi() / 12), 9) AS month_cos
FROM gen""", "gen")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = TX.time_features(F.col("ts"))
    return S.generation(spark, sf_dir).select("plant", "ts", *[
        (rounded(c) if name.endswith(("sin", "cos")) else big(c)).alias(name) for name, c in columns.items()])


@query("""
SELECT plant, ts, round(sin(hour(ts) * 2 * pi() / 24), 9) AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 9) AS hour_cos,
       round(sin(dayofyear(ts) * 2 * pi() / 365.25::DOUBLE), 9) AS doy_sin,
       round(cos(dayofyear(ts) * 2 * pi() / 365.25::DOUBLE), 9) AS doy_cos
FROM gen""", "gen")
def doy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.generation(spark, sf_dir).select("plant", "ts", *[
        rounded(c).alias(name) for name, c in TX.doy_features(F.col("ts")).items()])


@query("""
SELECT plant, ts, mwh, date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 1 DAY AS week_start,
       date_trunc('week', ts - INTERVAL 1 DAY) + INTERVAL 7 DAY AS week_end
FROM gen WHERE date_trunc('week', ts - INTERVAL 1 DAY) = date_trunc('week', TIMESTAMP '1998-06-15' - INTERVAL 1 DAY)""", "gen")
def week_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = E.week_calendar(S.generation(spark, sf_dir), "1998-06-15")
    return week.select("plant", "ts", "mwh", TX.week_start(F.col("ts")).alias("week_start"),
                       TX.week_end(F.col("ts")).alias("week_end"))


@query("""SELECT plant, ts, mwh FROM gen WHERE ts >= TIMESTAMP '1998-06-15' AND ts < TIMESTAMP '1998-06-22'""", "gen")
def week_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filter_range(S.generation(spark, sf_dir), "ts", "1998-06-15", 7).select("plant", "ts", "mwh")


@query("""
SELECT CAST(date_diff('day', (SELECT min(ts) FROM gen)::DATE, ts::DATE) // 7 AS BIGINT) AS week_idx,
       count(*) AS readings, min(ts) AS first_ts, max(ts) AS last_ts FROM gen GROUP BY 1""", "gen")
def week_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (E.with_week_index(S.kept_generation(spark, sf_dir)).groupBy(big("week_idx").alias("week_idx"))
            .agg(F.count("*").alias("readings"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
