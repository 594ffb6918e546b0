"""Training table: generation, plant alias, station and weather in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliopanel.operators.aggregates import sum_by_plant_hour
from heliopanel.operators.filters import fill_zero, sort_by
from heliopanel.operators.joins import (hourly_weather, join_alias, join_geocode, join_location, join_weather,
                                        nearest_station)
from heliopanel.sources.csv_files import read_generation, read_locations, read_station_meta, read_weather
from heliopanel.sources.json_files import read_alias_map, read_geocode_cache

MEASURES = ["mwh", "temperature", "rain", "sunshine", "radiation"]
COLUMNS = ["ts", "plant", "station_name", "station", *MEASURES]


def locate_plants(locations: DataFrame, geocode: DataFrame, stations: DataFrame) -> DataFrame:
    """Location rows with coordinates and nearest station.

    Distances are computed once per distinct address, not once per row.
    """
    addresses = join_geocode(locations.select("address").na.drop().distinct(), geocode)
    nearest = nearest_station(addresses, stations, key="address").drop("distance")
    return locations.join(nearest, "address", "left")


def training_table(generation: DataFrame, alias: DataFrame, location: DataFrame, weather: DataFrame,
                   location_order: tuple[str, ...] = ("row_ord",),
                   weather_order: tuple[str, ...] = ("row_ord",),
                   fill: bool = True, ordered: bool = True) -> DataFrame:
    """Plant-hour energy with station and weather, missing measures 0 unless `fill` is off.

    The raw rows are reduced to plant-hours before any join.
    """
    hourly = sum_by_plant_hour(generation)
    placed = join_location(join_alias(hourly, alias), location, "canonical", location_order)
    observed = hourly_weather(weather, weather_order).select(
        "station", "ts", "temperature", "rain", "sunshine", "radiation")
    table = join_weather(placed, observed).select(COLUMNS)
    if fill:
        table = fill_zero(table, MEASURES)
    return sort_by(table, "plant", "ts") if ordered else table


def training_table_from_files(spark: SparkSession, meters: str, locations: str, stations: str, weather: str,
                              alias_json: str, geocode_json: str,
                              years: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The training table of a set of input folders, and the rejected files with a reason."""
    generation, bad_meters = read_generation(spark, meters, years)
    places, bad_places = read_locations(spark, locations)
    observed, bad_weather = read_weather(spark, weather)
    located = locate_plants(places, read_geocode_cache(spark, geocode_json), read_station_meta(spark, stations))
    table = training_table(generation, read_alias_map(spark, alias_json), located, observed)
    return table, bad_meters.unionByName(bad_places).unionByName(bad_weather)
