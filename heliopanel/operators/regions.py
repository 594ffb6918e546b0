"""Generator registry: regional and site statistics, ranks and map attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliopanel import constants as K
from heliopanel.functions.scale import choropleth_alpha, marker_radius
from heliopanel.functions.text import to_canonical, display_region_name, strip, to_numeric_coerce
from heliopanel.operators.quantiles import most_frequent
from heliopanel.session import durable

WINDOW_ROWS = 100_000


def standardise_registry(registry: DataFrame, anchored: bool = False) -> DataFrame:
    """Registry with canonical region, trimmed subregion, address and numeric capacity."""
    return (registry
            .withColumn("capacity", F.coalesce(to_numeric_coerce(F.col("capacity").cast("string")), F.lit(0.0)))
            .withColumn("region", to_canonical(F.col("region"), anchored))
            .withColumn("subregion", strip(F.col("subregion")))
            .withColumn("address", F.col("subregion"))
            .filter(F.col("region") != ""))


def total_capacity() -> Column:
    """Sum in decimals of ten places, equal under any partitioning; what is not finite counts as missing."""
    return F.sum(F.col("capacity").try_cast("decimal(28,10)")).cast("double")


def region_stats(df: DataFrame) -> DataFrame:
    """Number of named generators and total capacity per region."""
    return df.groupBy("region").agg(F.count("generator").alias("plants"),
                                    total_capacity().alias("capacity"))


def site_stats(df: DataFrame) -> DataFrame:
    """The same per coordinate pair, with its most frequent region and subregion."""
    site = ["lat", "lon"]
    totals = df.groupBy(*site).agg(F.count("generator").alias("plants"),
                                   total_capacity().alias("capacity"))
    return (totals.join(most_frequent(df, site, "region", "region"), site, "left")
            .join(most_frequent(df, site, "subregion", "subregion"), site, "left"))


def with_row_number(df: DataFrame, order: list[Column], name: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Number the rows 1..n in the given order.

    A table of checked small size uses one window. A larger one is sorted by range, and each
    row gets its place in its partition plus the sizes of the partitions before it.
    """
    if df.limit(window_rows + 1).count() <= window_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    placed = durable(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    place = F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    # One row per partition of the sort.
    sizes = (placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))
             .select("_part", before.alias("_before")))
    return (placed.withColumn("_part", part).join(sizes, "_part")
            .withColumn(name, F.col("_before") + place + 1).drop("_part", "_before", "_id"))


def rank_table(stats: DataFrame) -> DataFrame:
    """Regions by number of plants, largest first, with rank and display name."""
    order = [F.desc("plants"), F.asc("region")]
    return with_row_number(stats, order, "rank").select(
        F.col("rank"), display_region_name(F.col("region")).alias("region"), "plants", "capacity")


def canonical_order(region: Column) -> Column:
    """Place of a region in the canonical list, 999 when it is not listed."""
    place = F.array_position(F.array(*[F.lit(r) for r in K.CANONICAL_REGIONS]), region)
    return F.coalesce(F.when(place > 0, place - 1), F.lit(999)).cast("int")


def sort_regions_canonical(df: DataFrame) -> DataFrame:
    return df.withColumn("region_order", canonical_order(F.col("region"))).orderBy("region_order", "region")


def choropleth(region_rows: DataFrame) -> DataFrame:
    """Add alpha from each region's share of the largest count."""
    largest = region_rows.agg(F.max("plants")).scalar()
    return region_rows.withColumn("alpha", choropleth_alpha(F.col("plants"), largest))


def markers(sites: DataFrame) -> DataFrame:
    return sites.withColumn("radius", marker_radius(F.col("plants")))
