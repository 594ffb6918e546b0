"""Regional report: the tables behind the map, the ranking and the markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from heliopanel.operators.joins import join_geocode, join_region_stats, unresolved_addresses
from heliopanel.operators.regions import (choropleth, markers, rank_table, region_stats, site_stats,
                                          standardise_registry)


@dataclass
class RegionalReport:
    regions: DataFrame
    ranking: DataFrame
    boundaries: DataFrame
    sites: DataFrame
    unresolved: DataFrame


def regional_report(registry: DataFrame, geocode: DataFrame, boundaries: DataFrame,
                    anchored: bool = False) -> RegionalReport:
    """Statistics of all generators whose address has coordinates, and the addresses that lack them."""
    standard = standardise_registry(registry, anchored)
    located = join_geocode(standard, geocode).na.drop(subset=["lat", "lon"])
    regions = region_stats(located)
    return RegionalReport(
        regions=regions,
        ranking=rank_table(regions),
        boundaries=choropleth(join_region_stats(boundaries, regions)),
        sites=markers(site_stats(located)),
        unresolved=unresolved_addresses(standard, geocode),
    )
