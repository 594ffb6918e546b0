"""Lookups and joins.

No join carries a broadcast hint: Catalyst and AQE broadcast a side after checking its
size, and fall back to a shuffled join with skew splitting beyond the threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliopanel.functions.geo import haversine, unit_vector
from heliopanel.functions.text import boundary_region_name, strip
from heliopanel.functions.timefx import floor_hour
from heliopanel.operators.aggregates import dedupe_first
from heliopanel.session import durable

INLINE_STATIONS = 1_000
LEAF_STATIONS = 256
#: Bits of a cell's coordinates that one step down the pyramid adds, and the finest cells (about 3 m).
STEP_BITS, MOST_BITS = 2, 22
#: Distances on the unit sphere are compared with this slack, far above their rounding errors.
SLACK = 1e-9


def join_alias(df: DataFrame, alias: DataFrame, plant: str = "plant", name: str = "canonical") -> DataFrame:
    """Canonical plant name from alias(plant, canonical), the own name when there is none."""
    side = alias.select(F.col("plant").alias("_alias"), F.col("canonical").alias("_canonical"))
    return (df.join(side, F.col(plant) == F.col("_alias"), "left")
            .withColumn(name, F.coalesce("_canonical", plant)).drop("_alias", "_canonical"))


def join_location(df: DataFrame, location: DataFrame, on: str = "canonical",
                  order: tuple[str, ...] = ("row_ord",)) -> DataFrame:
    """Station of each plant; the first location row of a plant counts, files in order of their full path."""
    narrow = location.select("plant", "station", "station_name", *order)
    first = dedupe_first(narrow, ["plant"], list(order)).select(
        F.col("plant").alias("_plant"), F.col("station").try_cast("bigint").alias("station"), "station_name")
    return df.join(first, F.col(on) == F.col("_plant"), "left").drop("_plant")


def hourly_weather(weather: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Weather floored to the hour, then the first row per station and hour."""
    return dedupe_first(weather.withColumn("ts", floor_hour(F.col("ts"))), ["station", "ts"], list(order))


def join_weather(df: DataFrame, weather: DataFrame, null_safe: bool = False) -> DataFrame:
    """Left join on station and hour; weather columns that clash get the suffix _wx.

    `weather` has one row per station and hour. `null_safe` lets null stations meet.
    """
    side = weather.select(*[
        F.col(c).alias(f"{c}_wx" if c in df.columns or c in ("station", "ts") else c) for c in weather.columns
    ])
    left = df.withColumn("ts", floor_hour(F.col("ts")))
    same = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)
    condition = same(left["station"], side["station_wx"]) & same(left["ts"], side["ts_wx"])
    return left.join(side, condition, "left").drop("station_wx", "ts_wx")


def join_geocode(df: DataFrame, cache: DataFrame, address: str = "address") -> DataFrame:
    """Coordinates from cache(address, lat, lon) by trimmed address; unknown stays null."""
    side = cache.select(F.col("address").alias("_key"), "lat", "lon")
    return df.join(side, strip(F.col(address)) == F.col("_key"), "left").drop("_key")


def unresolved_addresses(df: DataFrame, cache: DataFrame, address: str = "address") -> DataFrame:
    """Distinct non-null addresses the cache does not know."""
    wanted = df.select(strip(F.col(address)).alias("address")).na.drop().distinct()
    return wanted.join(cache.select("address"), "address", "left_anti")


def join_region_stats(boundaries: DataFrame, stats: DataFrame) -> DataFrame:
    """Every boundary with its region's statistics; a region without plants counts 0."""
    named = boundaries.withColumn("region", boundary_region_name(F.col("name")))
    return (named.join(stats, "region", "left")
            .withColumn("plants", F.coalesce("plants", F.lit(0).cast("long")))
            .withColumn("capacity", F.coalesce("capacity", F.lit(0.0))))


def _nearest_of(stations: Column) -> Column:
    """Closest element of an array of stations, the earlier one on ties."""
    ranked = F.transform(stations, lambda s: F.struct(
        haversine(F.col("lat"), F.col("lon"), s["lat"], s["lon"]).alias("distance"),
        s["ord"].alias("ord"), s["station"].alias("station"), s["station_name"].alias("station_name")))
    return F.array_min(ranked)


def nearest_station(sites: DataFrame, stations: DataFrame, key: str = "site",
                    inline_stations: int = INLINE_STATIONS, leaf_stations: int = LEAF_STATIONS) -> DataFrame:
    """Nearest station of each site: adds station, station_name and distance.

    `sites` needs `key`, lat and lon; `stations` needs station, station_name, lat, lon and
    ord (file order, which decides ties). Sites without coordinates get nulls.

    A short station list, its size checked, is one array that every site scans on its own
    without a shuffle. A longer one becomes a pyramid of cells, which each distinct place
    descends; only cells that can hold its nearest station go on to the next level.
    """
    stations = stations.select("station", "station_name", "lat", "lon", "ord").na.drop(subset=["lat", "lon"])
    entry = F.struct("lat", "lon", "ord", "station", "station_name")
    if stations.count() <= inline_stations:
        everything = stations.agg(F.collect_list(entry).alias("all")).scalar()
        best = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), _nearest_of(F.col("_all")))
        return (sites.withColumn("_all", everything).withColumn("_best", best)
                .select(*sites.columns, "_best.station", "_best.station_name", "_best.distance"))

    first = stations.groupBy("lat", "lon").agg(F.min(F.struct("ord", "station", "station_name")).alias("s")).select("lat", "lon", "s.*")
    places = sites.select("lat", "lon").na.drop().distinct()
    found = _nearest_in_pyramid(places, durable(first), entry, inline_stations, leaf_stations)
    return (sites.join(found, ["lat", "lon"], "left")
            .select(*sites.columns, "best.station", "best.station_name", "best.distance"))


def _cell(bits: int) -> Column:
    """Cell of a point of the unit sphere in a cube cut 2^bits times each way, as one number."""
    side = 1 << bits
    x, y, z = (F.least(F.floor((F.col(c) + 1) * (side / 2)), F.lit(side - 1)).cast("long") for c in ("x", "y", "z"))
    return (x * side + y) * side + z if bits <= 20 else F.xxhash64(x, y, z)


def _boxes(cells: DataFrame, cell: str, *by: str) -> DataFrame:
    """Smallest box around the points of each cell."""
    return cells.groupBy(cell, *by).agg(F.struct(F.col(cell).alias("cell"), *[
        f(c).alias(f"{n}{c}") for c in ("x", "y", "z") for n, f in (("min_", F.min), ("max_", F.max))]).alias("box"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, although lambdas inside refer to it."""
    return F.transform(F.array(value), use)[0]


def _near_boxes(boxes: Column) -> Column:
    """Of an array of boxes the least distance within which (x, y, z) is sure of a station, `reach`, and the `cells` not
    farther than that, each with its `least` distance."""

    def square(gaps: list[Column]) -> Column:
        return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])

    bounds = F.transform(boxes, lambda b: F.struct(
        b["cell"].alias("cell"),
        F.sqrt(square([F.greatest(b[f"min_{c}"] - F.col(c), F.col(c) - b[f"max_{c}"], F.lit(0.0)) for c in ("x", "y", "z")])).alias("least"),
        F.sqrt(square([F.greatest(F.col(c) - b[f"min_{c}"], b[f"max_{c}"] - F.col(c)) for c in ("x", "y", "z")])).alias("most")))
    return _let(bounds, lambda found: _let(
        F.aggregate(found, F.lit(4.0), lambda least, b: F.least(least, b["most"])),
        lambda reach: F.struct(reach.alias("reach"), F.transform(F.filter(found, lambda b: b["least"] <= reach + SLACK), lambda b: F.struct(
            b["cell"].alias("cell"), b["least"].alias("least"))).alias("cells"))))


def _nearest_in_pyramid(places: DataFrame, stations: DataFrame, entry: Column, most_top: int, most_leaf: int) -> DataFrame:
    """(lat, lon, best) of each place, exact.

    Points lie on the unit sphere, where the straight distance grows with the one along the
    ground and neither poles nor the date line are special. Of each cell the box around its
    stations is known: no station is nearer than the box, and one is at most as far as its
    farthest corner. A place keeps the cells nearer than the least such corner.

    The coarsest level with few cells is one array; finer ones, until no leaf has more than
    `most_leaf` stations, come by joins on the cell above, each with an array of at most 64 boxes.
    """
    stations = unit_vector(stations)

    def cells(bits: int) -> int:
        return stations.select(_cell(bits)).distinct().count()

    top = STEP_BITS
    while top + STEP_BITS <= MOST_BITS and cells(top + STEP_BITS) <= most_top:
        top += STEP_BITS
    leaf = top
    while leaf < MOST_BITS and stations.groupBy(_cell(leaf).alias("cell")).count().agg(F.max("count")).first()[0] > most_leaf:
        leaf += STEP_BITS

    coarse = _boxes(stations.withColumn("cell", _cell(top)), "cell").agg(F.collect_list("box").alias("boxes")).scalar()
    place = ["lat", "lon", "x", "y", "z"]
    open_cells = unit_vector(places).withColumn("_boxes", coarse).select(*place, F.explode(_near_boxes(F.col("_boxes"))["cells"]["cell"]).alias("cell"))
    for bits in range(top + STEP_BITS, leaf + 1, STEP_BITS):
        below = (_boxes(stations.select("x", "y", "z", _cell(bits - STEP_BITS).alias("above"), _cell(bits).alias("below")), "below", "above")
                 .groupBy(F.col("above").alias("cell")).agg(F.collect_list("box").alias("_boxes")))
        # Each open cell first leaves what it can by itself, so that no boxes travel; then the least reach of all counts.
        near = open_cells.join(below, "cell").select(*place, _near_boxes(F.col("_boxes")).alias("_near"))
        near = near.groupBy(*place).agg(F.min("_near.reach").alias("_reach"), F.flatten(F.collect_list("_near.cells")).alias("_cells"))
        open_cells = near.select(*place, "_reach", F.inline("_cells")).where(F.col("least") <= F.col("_reach") + SLACK).select(*place, "cell")
    packed = stations.groupBy(_cell(leaf).alias("cell")).agg(F.collect_list(entry).alias("_stations"))
    return (open_cells.join(packed, "cell").select("lat", "lon", _nearest_of(F.col("_stations")).alias("_near"))
            .groupBy("lat", "lon").agg(F.min("_near").alias("best")))
