"""The given tables in the roles of the solar inputs.

Each function reads whole tables. `SQL` holds the same derivations as common table
expressions, for the check queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopanel.functions.text import convert_to_mwh
from heliopanel.functions.timefx import hour_to_timestamp
from heliopanel.operators.aggregates import sum_by_plant_hour

ADDRESSES = [
    "전남 가온시 나래면 다솜리 25", "전라남도 가온시 나래면", "경기도 광주시 오포읍 1", "경기 안산시 단원구 12",
    "서울특별시 강남구 역삼동 1-1", "제주 서귀포시 안덕면 화순리", "부산광역시 사하구", "당진화력 자재창고 옥상 3층",
    "강원도 동해시 구호동 9", "세종특별자치시", "인천 옹진군 영흥면 외리", "산업단지 2로",
]
REGIONS = [
    "서울", "서울시", "서울특별시", "부산광역시", " 부산 광역시 ", "대구", "인천 광역시", "광주", "경기도 광주시",
    "대전시", "울산", "세종", "경기", "강원도", "강원특별자치도", "충북", "충청남도", "전북특별자치도", "전라북도",
    "전남", "경북", "경상남도", "제주", "해외", "제주특별자치도",
]
HOUR_LABELS = {"1시": "l_quantity", "12-13시": "l_extendedprice", "23_24시": "l_discount", "발전량 7시(kWh)": "l_tax"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def generation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meter readings: one per line item, plant by supplier, several readings per plant-hour."""
    return read(spark, sf_dir, "lineitem").select(
        hour_to_timestamp(F.col("l_shipdate"), F.col("l_linenumber") + 1).alias("ts"),
        F.concat(F.lit("P"), text("l_suppkey")).alias("plant"),
        convert_to_mwh(F.col("l_extendedprice"), F.lit("kwh")).alias("mwh"))


def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_by_plant_hour(generation_rows(spark, sf_dir))


def kept_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for plans that read it more than once, so that the raw rows are reduced once."""
    return generation(spark, sf_dir).persist()


def events_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that share their hours with the weather rows."""
    return read(spark, sf_dir, "events").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("P"), text("user_id")).alias("plant"), F.col("value").alias("mwh"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("station"), F.concat(F.lit("S"), text(F.col("user_id") % 5)).alias("station_name"),
        "ts", k.cast("double").alias("temperature"), (k % 7).cast("double").alias("rain"),
        (k % 11).cast("double").alias("sunshine"), F.col("value").alias("radiation"),
        F.col("ts").alias("seen"), "event_id")


def alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(
        F.concat(F.lit("P"), text(F.col("n_nationkey") * 2)).alias("plant"), F.col("n_name").alias("canonical"))


def location(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.when(key % 2 == 0, F.concat(F.lit("NATION_"), text(F.floor(key / 2) % 25)))
        .otherwise(F.concat(F.lit("P"), text(key % 64))).alias("plant"),
        (key % 7).alias("station"), F.concat(F.lit("S"), text(key % 7)).alias("station_name"), key.alias("ord"))


def address_of(key: Column) -> Column:
    return F.concat(pick(ADDRESSES, key % len(ADDRESSES)), F.when(key % 3 == 0, F.lit(" ")).otherwise(F.lit("")))


def supplier_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"),
                                                  address_of(F.col("s_suppkey")).alias("address"))


def geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache that knows every second address."""
    index = (F.col("n_nationkey") * 2) % len(ADDRESSES)
    return (read(spark, sf_dir, "nation").select(index.alias("i")).distinct()
            .select(pick(ADDRESSES, F.col("i")).alias("address"), (33 + F.col("i") * 0.25).alias("lat"),
                    (126 + F.col("i") * 0.125).alias("lon")))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        key.alias("site"), (33 + (key * 37 % 500) / 100.0).alias("lat"), (126 + (key * 53 % 350) / 100.0).alias("lon"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        key.cast("bigint").alias("station"), F.col("n_name").alias("station_name"),
        (33 + (key * 11 % 50) / 10.0).alias("lat"), (126 + (key * 7 % 35) / 10.0).alias("lon"), key.alias("ord"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("generator"), pick(REGIONS, F.col("c_nationkey")).alias("region"),
        F.col("c_mktsegment").alias("subregion"), text("c_acctbal").alias("capacity"), "c_custkey", "c_nationkey")


def located_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised registry with coordinates; many generators share a site."""
    from heliopanel.operators.regions import standardise_registry

    return (standardise_registry(registry(spark, sf_dir))
            .withColumn("lat", 33 + (F.col("c_custkey") % 40) / 8.0)
            .withColumn("lon", 126 + (F.col("c_custkey") % 15) / 8.0))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliopanel.constants import BOUNDARY_NAMES

    names = [*BOUNDARY_NAMES, "Dokdo"]
    return read(spark, sf_dir, "nation").select(pick(names, F.col("n_nationkey") % len(names)).alias("name")).distinct()


def wide_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("bigint").alias("linenumber"),
        F.col("l_shipdate").alias("day"), *[F.col(c).alias(label) for label, c in HOUR_LABELS.items()])


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _names() -> list[str]:
    from heliopanel.constants import BOUNDARY_NAMES

    return [*BOUNDARY_NAMES, "Dokdo"]


N = len(ADDRESSES)
SQL = {
    "gen": """gen AS (
        SELECT 'P' || CAST(l_suppkey AS VARCHAR) AS plant, l_shipdate + to_hours(l_linenumber) AS ts,
               CAST(sum(CAST(round(l_extendedprice / 1000.0::DOUBLE * 10000.0::DOUBLE) AS BIGINT)) AS DOUBLE)
                   / 10000.0::DOUBLE AS mwh
        FROM lineitem GROUP BY 1, 2)""",
    "panel": """panel AS (
        SELECT plant, ts, mwh, CAST(round(mwh * 10000.0::DOUBLE) AS BIGINT) AS u,
               row_number() OVER (PARTITION BY plant ORDER BY ts) - 1 AS pos,
               count(*) OVER (PARTITION BY plant) AS n
        FROM gen)""",
    "addr": f"""addr AS (
        SELECT s_suppkey AS site,
               {sql_list(ADDRESSES)}[CAST(s_suppkey % {N} AS INTEGER) + 1]
               || CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE '' END AS address
        FROM supplier)""",
    "geocode": f"""geocode AS (
        SELECT {sql_list(ADDRESSES)}[CAST(i AS INTEGER) + 1] AS address,
               33 + i * 0.25::DOUBLE AS lat, 126 + i * 0.125::DOUBLE AS lon
        FROM (SELECT DISTINCT (n_nationkey * 2) % {N} AS i FROM nation))""",
    "sites": """sites AS (
        SELECT s_suppkey AS site, 33 + (s_suppkey * 37 % 500) / 100.0::DOUBLE AS lat,
               126 + (s_suppkey * 53 % 350) / 100.0::DOUBLE AS lon FROM supplier)""",
    "stations": """stations AS (
        SELECT CAST(n_nationkey AS BIGINT) AS station, n_name AS station_name,
               33 + (n_nationkey * 11 % 50) / 10.0::DOUBLE AS lat,
               126 + (n_nationkey * 7 % 35) / 10.0::DOUBLE AS lon, n_nationkey AS ord FROM nation)""",
    "registry": f"""registry AS (
        SELECT c_name AS generator, {sql_list(REGIONS)}[c_nationkey + 1] AS region_raw,
               c_mktsegment AS subregion, c_acctbal AS capacity, c_custkey, c_nationkey FROM customer)""",
    "boundaries": f"""boundaries AS (
        SELECT DISTINCT {sql_list(_names())}[n_nationkey % {len(_names())} + 1] AS name FROM nation)""",
    "wide": """wide AS (
        SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber, l_shipdate AS day,
               l_suppkey AS suppkey, l_returnflag AS flag, """ + ", ".join(f'{c} AS "{label}"' for label, c in HOUR_LABELS.items()) + """
        FROM lineitem)""",
}
