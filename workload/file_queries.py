"""Readers and sinks: the given tables written to files of each kind and read back, each with its check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopanel.operators import filters as P
from heliopanel.session import shared_folder
from heliopanel.sources import csv_files as C
from heliopanel.sources import json_files as JF
from heliopanel.sources import sinks
from workload import standins as S
from workload.relational import big, query


def _write_object(entries: DataFrame, path: str) -> None:
    """Rows (name, cell as JSON text) as one JSON object, as alias maps and caches are stored."""
    cell = F.concat(F.lit('"'), F.col("name"), F.lit('":'), F.col("cell"))
    entries.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(cell), ","), F.lit("}")).alias("value")).coalesce(1).write.text(path)


@query("SELECT n_name AS plant, 'N' || CAST(n_regionkey AS VARCHAR) AS canonical FROM nation")
def read_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    cell = F.concat(F.lit('"N'), S.text("n_regionkey"), F.lit('"'))
    _write_object(S.read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), cell.alias("cell")), folder)
    return JF.read_alias_map(spark, folder)


@query("""
SELECT s_name AS address, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS lat,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey AS DOUBLE) END AS lon FROM supplier""")
def read_geocode_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as pairs, as objects, and as pairs of nulls."""
    folder = shared_folder(spark)
    kind, lat, lon = F.col("s_suppkey") % 5, F.col("s_acctbal"), F.col("s_suppkey").cast("double")
    cell = (F.when(kind == 0, "[null, null]").when(kind < 3, F.to_json(F.array(lat, lon)))
            .otherwise(F.to_json(F.struct(lat.alias("lat"), lon.alias("lon")))))
    _write_object(S.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), cell.alias("cell")), folder)
    return JF.read_geocode_cache(spark, folder)


@query("""
SELECT c_name AS address, min(CAST(c_custkey AS DOUBLE)) AS lat, 1.0::DOUBLE AS lon FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1
UNION ALL SELECT c_name, CAST(c_custkey AS DOUBLE), 2.0::DOUBLE FROM customer WHERE c_custkey % 2 = 1""")
def write_geocode_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers first, each twice; then all of them with another longitude: known ones keep their entry."""
    folder = shared_folder(spark)
    table = S.read(spark, sf_dir, "customer").select(F.col("c_name").alias("address"), F.col("c_custkey").cast("double").alias("lat"), "c_custkey")
    even = table.filter("c_custkey % 2 = 0").select("address", "lat", F.lit(1.0).alias("lon"))
    sinks.write_geocode_cache(spark, folder, even.unionByName(even.withColumn("lat", F.col("lat") + 1)))
    sinks.write_geocode_cache(spark, folder, table.select("address", "lat", F.lit(2.0).alias("lon")))
    return spark.read.parquet(folder)


@query("SELECT s_suppkey AS station, s_name AS station_name, s_acctbal AS lat, CAST(s_nationkey AS DOUBLE) AS lon FROM supplier WHERE s_suppkey % 7 <> 0")
def read_station_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations as a cp949 file set; those without coordinates are left out."""
    C.allow_korean_charset(spark)
    folder = shared_folder(spark)
    lat = F.when(F.col("s_suppkey") % 7 != 0, S.text("s_acctbal"))
    S.read(spark, sf_dir, "supplier").select(
        S.text("s_suppkey").alias("지점"), F.col("s_name").alias("지점명"), lat.alias("위도"), S.text("s_nationkey").alias("경도")
    ).write.option("header", True).option("encoding", C.KOREAN).csv(folder)
    return C.read_station_meta(spark, folder).select("station", "station_name", "lat", "lon")


@query("SELECT c_name AS generator, c_mktsegment AS region, CAST(c_nationkey AS VARCHAR) AS subregion, CAST(c_custkey AS VARCHAR) AS capacity FROM customer")
def read_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header names carry blanks."""
    folder = shared_folder(spark)
    S.read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("발전기명 "), F.col("c_mktsegment").alias(" 광역지역"), S.text("c_nationkey").alias("세부지역"), S.text("c_custkey").alias("설비용량")
    ).write.option("header", True).csv(folder)
    return C.read_registry(spark, folder)


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    orders = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    sinks.write_json_records(orders, folder)
    return spark.read.schema("id bigint, status string, price double").json(folder)


@query("""
SELECT plant, ts, CAST(u AS DOUBLE) / 10000.0::DOUBLE AS mwh FROM panel""", "gen", "panel")
def training_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training table under its published names, read back by name."""
    folder = shared_folder(spark)
    table = S.kept_generation(spark, sf_dir).select("ts", "plant", F.lit("s").alias("station_name"), F.lit(1).cast("bigint").alias("station"), "mwh",
                                                    *[F.lit(0.0).alias(c) for c in ("temperature", "rain", "sunshine", "radiation")])
    sinks.write_training_csv(table, folder)
    return C.read_training_csv(spark, folder).select("plant", "ts", "mwh")


@query("SELECT year(ts) AS year, count(*) AS n FROM gen GROUP BY 1", "gen")
def training_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training table by year; the counts come from the partitions read back."""
    folder = shared_folder(spark)
    sinks.write_training_parquet(S.kept_generation(spark, sf_dir), folder)
    return spark.read.parquet(folder).groupBy(big("year").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def clean_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(" id\t"), F.col("s_name").alias("﻿name "))
    return P.clean_column_names(named).select("id", "name")


BUCKET = 1000  # rows of a derived file


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def read_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of up to a thousand customers, one file each."""
    folder = shared_folder(spark)
    rows = S.read(spark, sf_dir, "customer").select(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("r"),
                                                    F.floor(F.col("c_custkey") / BUCKET).alias("bucket"))
    rows.groupBy("bucket").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("bucket").text(folder)
    return JF.read_json_records(spark, folder, "id bigint, name string").select("id", "name")


@query("SELECT s_name AS name FROM supplier")
def read_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON files of up to a thousand features each."""
    folder = shared_folder(spark)
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("s_name").alias("name")).alias("properties"))
    rows = S.read(spark, sf_dir, "supplier").select(feature.alias("f"), F.floor(F.col("s_suppkey") / BUCKET).alias("bucket"))
    whole = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features")))
    rows.groupBy("bucket").agg(whole.alias("value")).write.partitionBy("bucket").text(folder)
    return JF.read_boundaries(spark, folder)


@query("SELECT DISTINCT CAST(o_orderkey // 5000 AS BIGINT) AS bucket, true AS has_content FROM orders")
def list_input_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the files found below a folder, none of them empty."""
    folder = shared_folder(spark)
    orders = S.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_orderkey") / 5000).alias("bucket"))
    orders.write.partitionBy("bucket").csv(folder)
    found = C.list_input_files(spark, folder)
    return found.groupBy(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("bigint").alias("bucket")).agg(F.bool_and(F.col("length") > 0).alias("has_content"))


@query("SELECT '발전량 ' || s_name AS value FROM supplier")
def transcode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as cp949 and brought to UTF-8."""
    C.allow_korean_charset(spark)
    raw, folder = shared_folder(spark), shared_folder(spark)
    lines = S.read(spark, sf_dir, "supplier").select(F.encode(F.concat(F.lit("발전량 "), F.col("s_name")), C.KOREAN).cast("string").alias("value"))
    lines.write.text(raw)
    sinks.transcode_files(spark, raw, folder, pattern="*.txt")
    return spark.read.text(folder).select("value")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0")
def require_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.require_nonempty(S.read(spark, sf_dir, "customer").where("c_acctbal > 0"), "customers").select(F.col("c_custkey").alias("id"))
