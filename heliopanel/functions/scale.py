"""Numeric functions: exact units, repairs, transforms and their inverses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def to_units(c: Column, scale: int) -> Column:
    """Whole units of 10**-scale as a long, halves away from zero; null for what is not finite or beyond a long.

    Sums of units do not depend on row order.
    """
    units = c * F.lit(float(10 ** scale))
    return F.when(F.abs(units) < F.lit(9.2e18), (units + F.when(units < 0, -0.5).otherwise(0.5)).cast("long"))


def _units(values: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """`to_units` of doubles, 0 where it is null; and where it is not."""
    units = values.cast(pa.float64()).to_numpy(zero_copy_only=False) * float(10 ** scale)
    known = np.abs(units) < 9.2e18  # false for NaN, which stands for null here
    units = np.where(known, units, 0.0)
    return np.trunc(units + np.where(units < 0, -0.5, 0.5)).astype(np.int64), known


def units_of_array(values: Column, scale: int) -> Column:
    """Sum of the whole units of an array of doubles, null if one of them has none; whole batches at a time."""
    @F.arrow_udf("bigint")
    def total(lists: pa.Array) -> pa.Array:
        units, known = _units(lists.flatten(), scale)
        ends = np.concatenate([[0], np.where(lists.is_valid(), lists.value_lengths().fill_null(0), 0).cumsum()]).astype(np.int64)
        sums, seen = (np.concatenate([[0], x.cumsum()]) for x in (units, ~known))
        return pa.array(sums[ends[1:]] - sums[ends[:-1]], mask=(seen[ends[1:]] > seen[ends[:-1]]) | ~lists.is_valid().to_numpy(zero_copy_only=False))

    return total(values)


def weighted_units(df: DataFrame, columns: list[str], scale: int, keep: list[str]) -> DataFrame:
    """`keep`, `weighted`: the units of the k-th column times k, added up, and `present`: how many of the columns are not null."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("_cells").flatten()
            units = _units(cells, scale)[0].reshape(batch.num_rows, -1)
            present = cells.is_valid().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(units @ np.arange(1, len(columns) + 1)), pa.array(present)], [*keep, "weighted", "present"])

    rows = df.select(*keep, F.array(*columns).alias("_cells"))
    return rows.mapInArrow(add, StructType([*(rows.schema[c] for c in keep), StructField("weighted", LongType()), StructField("present", LongType())]))


def from_units(units: Column, scale: int) -> Column:
    return units.cast("double") / F.lit(float(10 ** scale))


def exact_sum(c: Column, scale: int) -> Column:
    """Sum of values that carry at most `scale` decimals, equal under any partitioning."""
    return from_units(F.sum(to_units(c, scale)), scale)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def null_non_finite(c: Column) -> Column:
    value = c.cast("double")
    return F.when(is_finite(value), value)


def zero_non_finite(c: Column) -> Column:
    return F.coalesce(null_non_finite(c), F.lit(0.0))


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def log_target(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def inverse_log_target(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.expm1(c), F.lit(0.0)))


def standardize(c: Column, mean: Column, std: Column, epsilon: float = 1e-6) -> Column:
    return (c - mean) / (std + F.lit(epsilon))


def min_max_scale(c: Column, low: Column, high: Column) -> Column:
    """(x - min) / (max - min); a constant column maps to 0 at its value."""
    width = high - low
    return (c - low) / F.when(width == 0, F.lit(1.0)).otherwise(width)


def choropleth_alpha(count: Column, largest: Column) -> Column:
    return F.lit(0.3) + F.lit(0.7) * F.coalesce(F.try_divide(count, largest), F.lit(0.0))


def marker_radius(count: Column) -> Column:
    return F.pow(count.cast("double"), F.lit(0.2))
