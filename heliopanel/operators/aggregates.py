"""Groupings. All of them combine rows before the shuffle, so hot keys stay cheap."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliopanel.constants import MWH_SCALE
from heliopanel.functions.scale import exact_sum


def sum_by_plant_hour(df: DataFrame, scale: int = MWH_SCALE) -> DataFrame:
    """Energy per plant and hour over all units; all-null groups give 0."""
    return df.groupBy("plant", "ts").agg(F.coalesce(exact_sum(F.col("mwh"), scale), F.lit(0.0)).alias("mwh"))


def sum_by_time(df: DataFrame, ts: str = "ts", truth: str = "y_true", prediction: str = "y_pred",
                scale: int | None = None) -> DataFrame:
    """Truth and prediction summed over all plants per time; exact when a scale is given."""
    def total(c: str) -> Column:
        return F.sum(c) if scale is None else exact_sum(F.col(c), scale)

    return df.groupBy(ts).agg(total(truth).alias(truth), total(prediction).alias(prediction))


def dedupe_exact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(columns))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order, as an aggregate instead of a sorted window."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).na.drop().distinct()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_train_test(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack tables on their common columns and mark where each row came from.

    `origin` is the given name, `origin_ord` its place, for use as a tie-break.
    """
    tables = list(parts.values())
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return union_all([t.select(*common, F.lit(name).alias("origin"), F.lit(i).alias("origin_ord"))
                      for i, (name, t) in enumerate(parts.items())])


def max_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(F.max(ts).alias("max_ts"))


def min_max_fit(df: DataFrame, columns: Sequence[str]) -> Column:
    """Struct of min/max per column as a scalar subquery, to be used in any expression."""
    bounds = [a(c).alias(f"{name}_{c}") for c in columns for name, a in (("min", F.min), ("max", F.max))]
    return df.agg(F.struct(*bounds).alias("fit")).scalar()


def mean_std_by_plant(df: DataFrame, columns: Sequence[str], plant: str = "plant") -> DataFrame:
    """Mean and sample deviation of each column per plant."""
    stats = []
    for c in columns:
        stats += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    return df.groupBy(plant).agg(*stats)


def mean_popstd_global(df: DataFrame, column: str) -> Column:
    """Struct (mean, std) with the population deviation, as a scalar subquery."""
    return df.agg(F.struct(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std")).alias("fit")).scalar()
