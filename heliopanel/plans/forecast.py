"""Train, score and evaluate: boosted trees on panel features and direct multi-step forecasts.

Predictions of a boosted run flag the rows whose lags are all there as `complete`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliopanel import constants as K
from heliopanel.forecast import features as X
from heliopanel.forecast import models as M
from heliopanel.forecast.windows import StepModel, Windows, fit_mixed_loss, fit_steps
from heliopanel.operators.aggregates import union_train_test
from heliopanel.operators.evaluate import regression_metrics
from heliopanel.operators.filters import first_rows
from heliopanel.operators.panel import Panel, add_lags, history_tail

CALENDAR = ["hour", "dayofweek", "month", "is_weekend", "hour_sin", "hour_cos", "month_sin", "month_cos"]


@dataclass
class BoostedRun:
    model: PipelineModel
    factor: dict
    validation_metrics: DataFrame
    test_metrics: DataFrame
    predictions: DataFrame
    meta: dict

    def debug_sample(self) -> DataFrame:
        return first_rows(self.predictions, ["ts", "plant"])


def feature_columns(lag_max: int, windows: Sequence[int], exogenous: Sequence[str]) -> list[str]:
    return [*exogenous, *CALENDAR, *X.lag_names(lag_max), *X.roll_names(windows)]


def train_boosted(train: DataFrame, test: DataFrame, target: str = "mwh", keys: Sequence[str] = X.KEYS,
                  exogenous: Sequence[str] = (), categorical: Sequence[str] = ("plant",),
                  lag_max: int = K.LAG_MAX, windows: Sequence[int] = K.ROLL_WINDOWS,
                  validation_days: int = K.VALIDATION_DAYS, **tree_options) -> BoostedRun:
    """Boosted trees on lags and rolling statistics.

    The unit of test is repaired first, from test's own lags, so that truth, lags and rolling
    statistics of test rows are on one scale even where they reach back into train. Then test
    rows see the train history, the last days of train validate, and gaps are filled from the
    remaining train rows.
    """
    own_lag = add_lags(Panel(test, keys), target, [1]).select(target, "lag_1").persist()
    factor = X.unit_factor(train, own_lag, target)
    own_lag.unpersist()
    test = X.apply_unit_factor(test, [target], factor["factor"])
    table = X.stitched_features(train, test, target, keys, lag_max, windows).cache()
    train_rows, test_rows = X.split_by_origin(table)
    # The cutoff comes from all train rows, then rows without full history leave.
    fit_rows, check_rows = X.split_last_days(train_rows, validation_days)
    complete = X.history_complete_filter(lag_max)
    fit_rows, check_rows = fit_rows.filter(complete), check_rows.filter(complete)
    numeric = [c for c in feature_columns(lag_max, windows, exogenous) if c not in categorical]
    model = M.fit_model(fit_rows, numeric, categorical, M.boosted_trees(target, **tree_options))
    keep = ["ts", *keys, F.col(target).alias("y_true")]
    checked = M.predict(model, check_rows, keep)
    scored = M.predict(model, test_rows, [*keep, complete.alias("complete")])
    scored = scored.select("ts", *keys, "y_true", "y_pred", "complete")
    meta = {"target": target, "keys": list(keys), "lags": lag_max, "roll_windows": list(windows),
            "validation_days": validation_days, "numeric": numeric, "categorical": list(categorical),
            "unit_factor": factor["factor"], "options": {k: str(v) for k, v in tree_options.items()}}
    return BoostedRun(model, factor, regression_metrics(checked),
                      regression_metrics(scored.filter("complete")), scored, meta)


def evaluate_saved(model: PipelineModel, meta: dict, train: DataFrame, test: DataFrame,
                   since: str = "2024-01-01", p: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Score a table with a saved model: metrics and flagged outliers of the totals over plants.

    The model is fitted in the unit of train. The evaluated table is brought to it, as it was before
    the fit, and the last rows of each train series are stitched in front as they are.
    """
    target, keys = meta["target"], meta["keys"]
    tail = history_tail(train, keys, meta["lags"])
    test = X.apply_unit_factor(test, [target], float(meta["unit_factor"]))
    stacked = union_train_test({"train": tail, "test": test})
    rows = X.panel_features(stacked, target, keys, ("origin_ord",), meta["lags"], meta["roll_windows"])
    rows = rows.filter(F.col("origin") == "test")
    scored = M.predict(model, rows, ["ts", *keys, F.col(target).alias("y_true")])
    return M.evaluate_scored(scored, since, p)


def fit_multi_horizon(df: DataFrame, target: str = "mwh", keys: Sequence[str] = ("plant",), until: str | None = None,
                      seq_len: int = K.SEQ_LEN, horizon: int = K.HORIZON, mixed: bool = False) -> tuple[Windows, StepModel]:
    """All windows of every series, and one model a step over the flattened history of those before `until`.

    `mixed` minimises 0.7 weighted RMSE + 0.3 Huber loss with the peak steps weighted, else squares.
    """
    windows = Windows.of(df, target, keys, seq_len, horizon).stored()
    fit = windows.between(until=until)
    return windows, fit_mixed_loss(fit)[0] if mixed else fit_steps(fit)
