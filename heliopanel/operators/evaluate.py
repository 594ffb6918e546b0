"""Errors, outliers and weekly slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliopanel.functions.scale import to_units
from heliopanel.functions.timefx import at_midnight, week_index, week_start
from heliopanel.operators.quantiles import quantile_exact


def metric_columns(truth: str = "y_true", prediction: str = "y_pred") -> list[Column]:
    """MAE, RMSE and R2 as aggregates over double columns."""
    error = F.col(truth) - F.col(prediction)
    both = F.when(error.isNotNull(), F.col(truth))
    return [
        F.count(error).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(both) * F.count(error))).alias("r2"),
    ]


def exact_metric_columns(truth: str, prediction: str, scale: int) -> list[Column]:
    """The same for values with at most `scale` decimals, independent of the row order."""
    y = to_units(F.col(truth), scale).cast("decimal(18,0)")
    e = (to_units(F.col(truth), scale) - to_units(F.col(prediction), scale)).cast("decimal(18,0)")
    y = F.when(e.isNotNull(), y)
    n = F.count(e)
    squares = F.sum(e * e).cast("double")
    unit = F.lit(float(10 ** scale))
    spread = F.sum(y * y).cast("double") - F.sum(y).cast("double") * F.sum(y).cast("double") / n
    return [
        n.alias("n"),
        (F.sum(F.abs(e)).cast("double") / n / unit).alias("mae"),
        (F.sqrt(squares / n) / unit).alias("rmse"),
        (1 - F.try_divide(squares, spread)).alias("r2"),
    ]


def regression_metrics(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred",
                       by: Sequence[str] = (), scale: int | None = None) -> DataFrame:
    """n, MAE, RMSE and R2, overall or per group."""
    columns = metric_columns(truth, prediction) if scale is None else exact_metric_columns(truth, prediction, scale)
    return df.groupBy(*by).agg(*columns)


def rmse_by_horizon(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred",
                    scale: int | None = None) -> DataFrame:
    """RMSE of each forecast step h."""
    return regression_metrics(df, truth, prediction, ["h"], scale).select("h", "n", "rmse")


def with_residual(df: DataFrame, truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    residual = F.col(truth) - F.col(prediction)
    return df.withColumns({"resid": residual, "abs_err": F.abs(residual)})


def top_p_outliers(df: DataFrame, p: float = 0.01, error: str = "abs_err") -> DataFrame:
    """Flag rows whose absolute error reaches the exact (1 - p) quantile."""
    threshold = quantile_exact(df, error, 1.0 - p)
    limit = F.lit(threshold).cast("double")
    return df.withColumns({"threshold": limit, "is_outlier": F.col(error) >= limit})


def count_outliers(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("is_outlier")).alias("outliers"))


def saturation_rate(df: DataFrame, column: str, limit: float | Column) -> DataFrame:
    """Share of rows at or above a limit."""
    bound = limit if isinstance(limit, Column) else F.lit(limit)
    return df.agg(F.count(column).alias("n"), F.avg((F.col(column) >= bound).cast("int")).alias("rate"))


def week_calendar(df: DataFrame, day: str, ts: str = "ts", anchor: str = "W-MON") -> DataFrame:
    """Rows of the anchored week that contains a day."""
    chosen = week_start(F.lit(day).cast("timestamp_ntz"), anchor)
    return df.filter(week_start(F.col(ts), anchor) == chosen)


def with_week_index(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add week_idx: whole weeks since the first day of the table."""
    first = df.agg(F.min(ts)).scalar()
    return df.withColumn("week_idx", week_index(F.col(ts), at_midnight(first)))
