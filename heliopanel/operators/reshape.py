"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliopanel.functions.timefx import add_hours


def melt_hours(df: DataFrame, ids: Sequence[str], hour_columns: Sequence[str],
               label: str = "hour_label", value: str = "raw") -> DataFrame:
    """One row per hour column; values are text, so that columns of any type can mix."""
    wide = df.select(*[F.col(f"`{c}`") for c in ids],
                     *[F.col(f"`{c}`").cast("string").alias(c) for c in hour_columns])
    return wide.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in hour_columns],
                        label, value)


def predictions_to_long(df: DataFrame, origin: str = "origin_ts", truth: str = "y",
                        prediction: str = "y_hat", keep: Sequence[str] = ()) -> DataFrame:
    """Arrays per window to one row per horizon; `time` is the origin plus h hours."""
    pairs = F.arrays_zip(F.col(truth).alias("t"), F.col(prediction).alias("p"))
    long = df.select(*keep, origin, F.posexplode(pairs).alias("_i", "_pair"))
    h = F.col("_i") + 1
    return long.select(*keep, add_hours(F.col(origin), h).alias("time"), h.alias("h"),
                       F.col("_pair.t").alias("y_true"), F.col("_pair.p").alias("y_pred"))


def one_hot_fit(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values of a training column that is to become one column a value.

    The values end up in the schema, so they go to the driver; a column of many values takes `category_table`.
    """
    return sorted(r[0] for r in df.select(F.col(column).cast("string")).na.drop().distinct().collect())


def one_hot_columns(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """0/1 columns named column=value; unseen values and null are 0 everywhere."""
    text = F.col(column).cast("string")
    return df.select("*", *[F.coalesce((text == v).cast("int"), F.lit(0)).alias(f"{column}={v}")
                            for v in categories])


def category_table(df: DataFrame, column: str) -> DataFrame:
    """(value, index): the distinct values of a training column in text order, numbered from 0, for any number of values."""
    from heliopanel.operators.regions import with_row_number

    values = df.select(F.col(column).cast("string").alias("value")).na.drop().distinct()
    return with_row_number(values, [F.asc("value")], "_number").select("value", (F.col("_number") - 1).alias("index"))


def one_hot_sparse(df: DataFrame, column: str, categories: DataFrame) -> DataFrame:
    """Adds column_index and column_value, the place of the 1 in the one-hot vector; unseen values and null have none and 0."""
    known = categories.select(F.col("value").alias("_value"), F.col("index").alias(f"{column}_index"))
    joined = df.join(known, F.col(column).cast("string") == F.col("_value"), "left").drop("_value")
    return joined.withColumn(f"{column}_value", F.col(f"{column}_index").isNotNull().cast("int"))
