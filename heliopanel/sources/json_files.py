"""JSON lookups: alias map, geocode cache, location records, boundaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopanel import schemas


def _json_object(spark: SparkSession, path: str, value_type: str) -> DataFrame | None:
    """Entries (key, value) of a JSON object file, None when the file does not exist."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    entries = F.from_json("value", f"map<string,{value_type}>")
    return text.select(F.explode(entries))


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_alias_map(spark: SparkSession, path: str) -> DataFrame:
    """plant and canonical name; empty when the file is missing."""
    entries = _json_object(spark, path, "string")
    if entries is None:
        return _empty(spark, schemas.ALIAS)
    return entries.select(F.col("key").alias("plant"), F.col("value").alias("canonical"))


def read_geocode_cache(spark: SparkSession, path: str) -> DataFrame:
    """address, lat, lon from {"lat":, "lon":} or [lat, lon] entries; empty when missing."""
    entries = _json_object(spark, path, "string")
    if entries is None:
        return _empty(spark, schemas.GEOCODE)
    pair = F.from_json("value", "array<double>")
    point = F.from_json("value", "lat double, lon double")
    is_pair = F.col("value").startswith("[")

    def pick(i: int, name: str) -> Column:
        return F.when(is_pair, F.try_element_at(pair, F.lit(i))).otherwise(point[name]).alias(name)

    return entries.select(F.col("key").alias("address"), pick(1, "lat"), pick(2, "lon"))


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON array or lines as a table; an empty table of the same columns when missing."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return _empty(spark, schema)
        raise


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Names of the features of a GeoJSON file."""
    schema = "features array<struct<properties: struct<name: string>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path)
    return features.select(F.explode("features").alias("f")).select(F.col("f.properties.name").alias("name"))
