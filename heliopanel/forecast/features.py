"""Feature tables for the forecasts: stitching, unit repair, splits, imputation, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliopanel import constants as K
from heliopanel.functions.scale import clip, log_target, min_max_scale, standardize, zero_non_finite
from heliopanel.functions.timefx import time_features
from heliopanel.operators.aggregates import mean_popstd_global, mean_std_by_plant, min_max_fit, union_train_test
from heliopanel.operators.panel import Panel, add_rolls, lag_vectors
from heliopanel.operators.quantiles import median_impute_fit, mode_impute_fit, quantiles_exact

KEYS = ["plant", "station_name", "station"]


def add_time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(time_features(F.col(ts)))


def lag_names(lag_max: int = K.LAG_MAX) -> list[str]:
    return [f"lag_{k}" for k in range(1, lag_max + 1)]


def roll_names(windows: Sequence[int] = K.ROLL_WINDOWS) -> list[str]:
    return [f"roll_{kind}_{w}" for kind in ("mean", "std") for w in windows]


def panel_features(df: DataFrame, target: str = "mwh", keys: Sequence[str] = KEYS,
                   tiebreak: Sequence[str] = (), lag_max: int = K.LAG_MAX,
                   windows: Sequence[int] = K.ROLL_WINDOWS) -> DataFrame:
    """Calendar features, lags and rolling statistics in one pass over the series."""
    panel = Panel(add_time_features(df), keys, tiebreak=tiebreak)
    return add_rolls(panel, target, windows, lag_steps=range(1, lag_max + 1)).drop("pos", "n")


class PanelVectors:
    """The features of `panel_features` as one list for each row that has all its lags, made anew for each use.

    Only the rows in series order with their rolling statistics are kept, some 100 bytes each where a feature list has 1,500.
    `filter` is applied before the lists are made.
    """

    def __init__(self, df: DataFrame, names: Sequence[str], target: str = "mwh", keys: Sequence[str] = KEYS, tiebreak: Sequence[str] = (),
                 lag_max: int = K.LAG_MAX, windows: Sequence[int] = K.ROLL_WINDOWS, features: str = "features"):
        self.names, self.target, self.features, self.columns, self.lag_max = list(names), target, features, df.columns, lag_max
        self.rows = add_rolls(Panel(df, keys, tiebreak=tiebreak), target, windows, lag_steps=range(1, lag_max + 1), ordered=True)[0].persist()

    def filter(self, condition: Column | None = None) -> DataFrame:
        wanted = F.lit(True) if condition is None else condition
        return lag_vectors(add_time_features(self.rows), self.columns, self.target, self.names, self.features, wanted)

    def times(self) -> DataFrame:
        """Times of the rows with enough rows before them."""
        return self.rows.where(F.col("_own") & (F.col("pos") >= self.lag_max)).select("ts")


def stitched_features(train: DataFrame, test: DataFrame, target: str = "mwh", keys: Sequence[str] = KEYS,
                      lag_max: int = K.LAG_MAX, windows: Sequence[int] = K.ROLL_WINDOWS) -> DataFrame:
    """Features over train followed by test, so that test rows see the train history.

    `origin` tells the two apart afterwards.
    """
    stacked = union_train_test({"train": train, "test": test})
    return panel_features(stacked, target, keys, ("origin_ord",), lag_max, windows).drop("origin_ord")


def split_by_origin(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (df.filter(F.col("origin") == "train").drop("origin"),
            df.filter(F.col("origin") == "test").drop("origin"))


def history_complete_filter(lag_max: int = K.LAG_MAX) -> Column:
    """All lag columns are present."""
    complete = F.lit(True)
    for name in lag_names(lag_max):
        complete = complete & F.col(name).isNotNull()
    return complete


def with_validation_flag(df: DataFrame, days: int = K.VALIDATION_DAYS, ts: str = "ts",
                         name: str = "is_validation") -> DataFrame:
    """True for the last days of the table."""
    cutoff = df.agg(F.max(ts)).scalar() - F.make_dt_interval(F.lit(days))
    return df.withColumn(name, F.col(ts) >= cutoff)


def split_last_days(df: DataFrame, days: int = K.VALIDATION_DAYS, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    flagged = with_validation_flag(df, days, ts)
    return (flagged.filter(~F.col("is_validation")).drop("is_validation"),
            flagged.filter(F.col("is_validation")).drop("is_validation"))


def unit_factor(train: DataFrame, test: DataFrame, target: str = "mwh", lag: str = "lag_1") -> dict[str, float | None]:
    """Factor between the units of train and test: its raw estimate and the nearest known factor."""
    a = quantiles_exact(train, {"p95": (target, 0.95), "max": (target, 1.0)})
    b = quantiles_exact(test, {"p95": (lag, 0.95), "max": (lag, 1.0), "target_max": (target, 1.0)})

    def ratio(top: float | None, bottom: float | None) -> list[float]:
        return [top / bottom] if top is not None and bottom is not None and bottom > 0 else []

    ratios = sorted(ratio(a["p95"], b["p95"]) + ratio(a["max"], b["max"])) or ratio(a["max"], b["target_max"])
    raw = sum(ratios) / len(ratios) if ratios else 1.0
    chosen = min(K.UNIT_FACTORS, key=lambda f: (abs(f - raw), f))
    return {"train_p95": a["p95"], "train_max": a["max"], "test_p95": b["p95"], "test_max": b["max"],
            "raw": raw, "factor": float(chosen)}


def apply_unit_factor(df: DataFrame, columns: Sequence[str], factor: float) -> DataFrame:
    if factor == 1.0:
        return df
    return df.withColumns({c: F.col(c) * F.lit(factor) for c in columns})


def imputation(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, float | str]:
    """Exact median of each numeric and most frequent value of each categorical column."""
    fills: dict[str, float | str | None] = {**median_impute_fit(df, list(numeric)), **mode_impute_fit(df, list(categorical))}
    return {c: v for c, v in fills.items() if v is not None}


def impute(df: DataFrame, fills: dict[str, float | str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def clip_upper_quantile(df: DataFrame, columns: Sequence[str], q: float = 0.999) -> DataFrame:
    """Non-finite values to 0, then every column clipped to 0..its exact q quantile."""
    finite = df.withColumns({c: zero_non_finite(F.col(c)) for c in columns})
    tops = quantiles_exact(finite, {c: (c, q) for c in columns})
    return finite.withColumns({c: clip(F.col(c), 0.0, F.lit(tops[c]).cast("double")) for c in columns})


def zscore_filter(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Keep rows whose distance from the mean is below `limit` population deviations."""
    fit = mean_popstd_global(df, column)
    z = F.try_divide(F.col(column) - fit.getField("mean"), fit.getField("std"))
    return df.filter(F.abs(z) < limit)


def zscore_per_plant(df: DataFrame, columns: Sequence[str], plant: str = "plant") -> DataFrame:
    """Standardize columns within each plant.

    Moments are aggregated (combined before the shuffle) and joined back, so no plant's rows
    have to meet in one task.
    """
    moments = mean_std_by_plant(df, columns, plant).withColumnRenamed(plant, "_plant")
    joined = df.join(moments, F.col(plant) == F.col("_plant"), "left")
    scaled = {c: standardize(F.col(c), F.col(f"mean_{c}"), F.col(f"std_{c}")) for c in columns}
    return joined.withColumns(scaled).select(df.columns)


def min_max(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale columns to the range they have in the training table."""
    fit = min_max_fit(train, columns)
    return df.withColumns({
        c: min_max_scale(F.col(c), fit.getField(f"min_{c}"), fit.getField(f"max_{c}")) for c in columns
    })


def with_log_target(df: DataFrame, target: str = "mwh", name: str = "log_y") -> DataFrame:
    return df.withColumn(name, log_target(F.col(target)))
