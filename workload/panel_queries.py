"""Queries on series features, scaling and evaluation, each with its check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopanel import constants as K
from heliopanel.constants import SAMPLED_WINDOWS
from heliopanel.forecast import features as X
from heliopanel.functions import scale as C
from heliopanel.operators import aggregates as A
from heliopanel.operators import evaluate as E
from heliopanel.operators import filters as P
from heliopanel.operators import panel as W
from heliopanel.operators import quantiles as Q
from heliopanel.operators import reshape
from heliopanel.session import literal_rows
from workload import standins as S
from workload.relational import big, query, rounded
from workload.standins import SQL

SCALE = K.MWH_SCALE


def panel(spark: SparkSession, sf_dir: str) -> W.Panel:
    return W.Panel(S.kept_generation(spark, sf_dir), ["plant"])


# --- lags and rolling statistics --------------------------------------------------------

_LAGS = ", ".join(f"lag(u, {k}) OVER w AS lag_{k}" for k in range(1, 169))
_LAG_SUM = " + ".join(f"coalesce(lag_{k} * {k}, 0)" for k in range(1, 169))
_LAG_COUNT = " + ".join(f"(lag_{k} IS NOT NULL)::INT" for k in range(1, 169))


@query(f"""
SELECT plant, ts, lag_1 / 10000.0::DOUBLE AS lag_1, lag_24 / 10000.0::DOUBLE AS lag_24,
       lag_168 / 10000.0::DOUBLE AS lag_168, CAST({_LAG_SUM} AS BIGINT) AS weighted, CAST({_LAG_COUNT} AS BIGINT) AS present
FROM (SELECT plant, ts, {_LAGS} FROM panel WINDOW w AS (PARTITION BY plant ORDER BY ts))""", "gen", "panel")
def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 168 lag columns, checked through a weighted sum of every one of them."""
    table = W.add_lags(panel(spark, sf_dir), "mwh")
    names = [f"lag_{k}" for k in range(1, 169)]
    return C.weighted_units(table, names, SCALE, ["plant", "ts", "lag_1", "lag_24", "lag_168"])


@query("""
SELECT plant, ts, least(pos, 168) AS present, CAST(coalesce(sum(u) OVER w, 0) AS BIGINT) AS total_units,
       lag(mwh, 1) OVER (PARTITION BY plant ORDER BY ts) AS latest
FROM panel WINDOW w AS (PARTITION BY plant ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)""", "gen", "panel")
def lag_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = W.add_lag_array(panel(spark, sf_dir), "mwh")
    return table.select("plant", "ts", big(F.size("lags")).alias("present"), C.units_of_array(F.col("lags"), SCALE).alias("total_units"),
                        F.try_element_at("lags", F.lit(-1)).alias("latest"))


def _rolls_sql() -> str:
    columns = []
    for w in K.ROLL_WINDOWS:
        least = int(w * K.ROLL_MIN_FRACTION)
        n, s, q = f"count(u) OVER w{w}", f"sum(u) OVER w{w}", f"sum(u::HUGEINT * u) OVER w{w}"
        columns += [
            f"CASE WHEN {n} >= {least} THEN CAST({s} AS DOUBLE) / CAST({n} * 10000 AS DOUBLE) END AS roll_mean_{w}",
            f"CASE WHEN {n} >= {least} THEN round(sqrt(CAST({n} * ({q}) - ({s}) * ({s}) AS DOUBLE)"
            f" / CAST({n} * ({n} - 1) AS DOUBLE)) / 10000.0::DOUBLE, 9) END AS roll_std_{w}",
        ]
    frames = ", ".join(f"w{w} AS (PARTITION BY plant ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
                       for w in K.ROLL_WINDOWS)
    return f"SELECT plant, ts, {', '.join(columns)} FROM panel WINDOW {frames}"


@query(_rolls_sql(), "gen", "panel")
def rolls_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = W.add_rolls(panel(spark, sf_dir), "mwh")
    return table.select("plant", "ts", *[f"roll_mean_{w}" for w in K.ROLL_WINDOWS],
                        *[rounded(f"roll_std_{w}").alias(f"roll_std_{w}") for w in K.ROLL_WINDOWS])


@query("""
SELECT plant, ts, lag(mwh, 24) OVER w AS lag_24, lag(mwh, 168) OVER w AS lag_168,
       """ + ", ".join(f"CASE WHEN pos >= {n - 1} THEN CAST(sum(u) OVER (PARTITION BY plant ORDER BY ts ROWS BETWEEN {n - 1}"
                       f" PRECEDING AND CURRENT ROW) AS DOUBLE) / {n}0000.0::DOUBLE END AS {name}"
                       for name, n in (("lag_24_mean", 24), ("roll_mean_6", 6), ("roll_mean_12", 12))) + """
FROM panel WINDOW w AS (PARTITION BY plant ORDER BY ts)""", "gen", "panel")
def rolls_incl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.add_rolls_inclusive(panel(spark, sf_dir), "mwh", lag_steps=(24, 168)).drop("mwh", "pos", "n")


@query("SELECT plant, ts, pos >= 168 AS history_complete FROM panel", "gen", "panel")
def history_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.add_history_complete(panel(spark, sf_dir), "mwh").select("plant", "ts", "history_complete")


@query("SELECT plant, ts, mwh FROM panel WHERE pos >= n - 168", "gen", "panel")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.history_tail(S.generation(spark, sf_dir), ["plant"])


@query("SELECT plant, ts, pos, n FROM panel", "gen", "panel")
def series_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).rows.select("plant", "ts", big("pos").alias("pos"), big("n").alias("n"))


@query("""
, possible AS (SELECT plant, ts, pos, pos // 3 AS i, (n - 192) // 3 + 1 AS m FROM panel WHERE pos % 3 = 0 AND pos <= n - 192),
spaced AS (
    SELECT plant, m, CASE WHEN k = 49 THEN m - 1 ELSE CAST(floor(k * ((m - 1) / 49.0::DOUBLE)) AS BIGINT) END AS i
    FROM (SELECT DISTINCT plant, m FROM possible WHERE m > 50), range(50) r(k))
SELECT plant, ts, pos FROM possible p WHERE m <= 50 OR EXISTS (SELECT 1 FROM spaced s WHERE s.plant = p.plant AND s.i = p.i)
""", "gen", "panel")
def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.window_starts(panel(spark, sf_dir), step=3, limit=50).select("plant", "ts", big("pos").alias("pos"))


def _windows_sql(step: int) -> str:
    return f"""
SELECT * FROM (
    SELECT plant, pos AS start, lead(ts, 167) OVER w AS origin_ts,
           CAST(sum(u) OVER (w ROWS BETWEEN CURRENT ROW AND 167 FOLLOWING) AS BIGINT) AS x_units,
           CAST(sum(u) OVER (w ROWS BETWEEN 168 FOLLOWING AND 191 FOLLOWING) AS BIGINT) AS y_units,
           lead(mwh, 168) OVER w AS y_first, lead(mwh, 191) OVER w AS y_last,
           168 AS x_size, 24 AS y_size, n
    FROM panel WINDOW w AS (PARTITION BY plant ORDER BY ts))
WHERE start % {step} = 0 AND start <= n - 192""".replace("SELECT * FROM", "SELECT * EXCLUDE (n) FROM", 1)


def _window_summary(windows: DataFrame) -> DataFrame:
    return windows.select(
        "plant", big("start").alias("start"), "origin_ts",
        C.units_of_array(F.col("x.mwh"), SCALE).alias("x_units"), C.units_of_array(F.col("y"), SCALE).alias("y_units"),
        F.element_at("y", 1).alias("y_first"), F.element_at("y", -1).alias("y_last"),
        F.size("x").alias("x_size"), F.size("y").alias("y_size"))


@query(_windows_sql(1), "gen", "panel")
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_summary(W.sequence_windows(panel(spark, sf_dir), ["mwh"], "mwh"))


@query(_windows_sql(24), "gen", "panel")
def strided_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_summary(W.strided_windows(panel(spark, sf_dir), ["mwh"], "mwh"))


# --- scaling ----------------------------------------------------------------------------

@query("""
, raw AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice - 20000 END AS v FROM lineitem)
SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber,
       round(least(greatest(v, 0), (SELECT quantile_cont(v, 0.999) FROM raw)), 6) AS clipped FROM raw
""".replace(", raw AS", "WITH raw AS", 1))
def clip_q999(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") == 7, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") - 20000)
    rows = S.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), big("l_linenumber").alias("linenumber"), value.alias("clipped"))
    return X.clip_upper_quantile(rows, ["clipped"]).withColumn("clipped", rounded("clipped", 6))


@query("""
, raw AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT count(*) AS n, count(v) AS finite, CAST(sum(CAST(round(v * 10000.0::DOUBLE) AS BIGINT)) AS DOUBLE) / 10000.0::DOUBLE AS total
FROM raw""".replace(", raw AS", "WITH raw AS", 1))
def null_non_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 26 == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    rows = S.read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 13 == 0, bad).otherwise(F.col("value")).alias("v"))
    fixed = P.null_non_finite_columns(rows, ["v"])
    return fixed.agg(F.count("*").alias("n"), F.count("v").alias("finite"), C.exact_sum(F.col("v"), SCALE).alias("total"))


@query("""
SELECT plant, ts, mwh FROM gen, (SELECT avg(mwh) AS m, stddev_pop(mwh) AS s FROM gen)
WHERE abs((mwh - m) / s) < 3""", "gen")
def zscore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.zscore_filter(S.kept_generation(spark, sf_dir), "mwh", 3.0)


@query("""
SELECT plant, ts, round((mwh - avg(mwh) OVER w) / (stddev_samp(mwh) OVER w + 1e-6::DOUBLE), 6) AS z
FROM gen WINDOW w AS (PARTITION BY plant)""", "gen")
def zscore_plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = X.zscore_per_plant(S.kept_generation(spark, sf_dir), ["mwh"])
    return scaled.select("plant", "ts", rounded("mwh", 6).alias("z"))


@query("""
SELECT plant, ts, round((mwh - lo) / (hi - lo), 9) AS scaled
FROM gen, (SELECT min(mwh) AS lo, max(mwh) AS hi FROM gen WHERE ts < TIMESTAMP '2000-01-01')""", "gen")
def min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen = S.kept_generation(spark, sf_dir)
    train = gen.filter(F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return X.min_max(gen, train, ["mwh"]).select("plant", "ts", rounded("mwh").alias("scaled"))


@query("""
SELECT plant, ts, round(ln(1 + greatest(mwh - 30, 0)), 9) AS log_y, round(greatest(mwh - 30, 0), 6) AS back FROM gen""", "gen")
def log_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = X.with_log_target(S.generation(spark, sf_dir).withColumn("mwh", F.col("mwh") - 30))
    return logged.select("plant", "ts", rounded("log_y").alias("log_y"),
                         rounded(C.inverse_log_target(F.col("log_y")), 6).alias("back"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(
    f"CAST(c_custkey % 10 <> 0 AND c_mktsegment = '{s}' AS INTEGER) AS \"segment={s}\"" for s in _SEGMENTS) + " FROM customer")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories come from the table; values changed afterwards are unseen and give zeros."""
    rows = S.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    categories = reshape.one_hot_fit(rows, "segment")
    unseen = rows.withColumn("segment", F.when(F.col("c_custkey") % 10 == 0, F.lit("OTHER")).otherwise(F.col("segment")))
    return reshape.one_hot_columns(unseen, "segment", categories).drop("segment")


@query("""
WITH known AS (
    SELECT value, row_number() OVER (ORDER BY value) - 1 AS index
    FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS value FROM lineitem WHERE l_returnflag <> 'R'))
SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS line, index AS orderkey_index, CAST(index IS NOT NULL AS INTEGER) AS orderkey_value
FROM lineitem LEFT JOIN known ON value = CAST(l_orderkey AS VARCHAR)""")
def one_hot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of more than 10,000 values (from sf0.01 on) as index and value; orders with returned lines only are unseen."""
    rows = S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), big("l_linenumber").alias("line"), "l_returnflag")
    categories = reshape.category_table(rows.filter("l_returnflag <> 'R'"), "orderkey")
    return reshape.one_hot_sparse(rows, "orderkey", categories).select("orderkey", "line", big("orderkey_index").alias("orderkey_index"), "orderkey_value")


@query("SELECT min(mwh) AS min, round(quantile_cont(mwh, 0.5), 6) AS q50, max(mwh) AS max FROM gen", "gen")
def scale_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.scale_summary(S.kept_generation(spark, sf_dir), "mwh").withColumn("q50", rounded("q50", 6))


@query("""
, stacked AS (
    SELECT plant, ts, ts >= TIMESTAMP '2000-01-01' AS test,
           CASE WHEN ts >= TIMESTAMP '2000-01-01' THEN mwh / 10000.0::DOUBLE ELSE mwh END AS y FROM gen),
lagged AS (SELECT *, lag(y) OVER (PARTITION BY plant ORDER BY ts) AS lag_1 FROM stacked),
s AS (
    SELECT quantile_cont(y, 0.95) FILTER (WHERE NOT test) AS train_p95, max(y) FILTER (WHERE NOT test) AS train_max,
           quantile_cont(lag_1, 0.95) FILTER (WHERE test) AS test_p95, max(lag_1) FILTER (WHERE test) AS test_max
    FROM lagged)
SELECT round(train_p95, 6) AS train_p95, round(train_max, 6) AS train_max, round(test_p95, 6) AS test_p95,
       round(test_max, 6) AS test_max, round((train_p95 / test_p95 + train_max / test_max) / 2, 4) AS raw,
       (SELECT f FROM (VALUES (1), (10), (24), (100), (1000), (10000)) v(f)
        ORDER BY abs(f - (train_p95 / test_p95 + train_max / test_max) / 2), f LIMIT 1)::DOUBLE AS factor
FROM s""", "gen")
def unit_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows in a unit 10000 times smaller; the first test lag of a plant is still a train value."""
    gen = S.kept_generation(spark, sf_dir)
    cut = F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz")
    stacked = A.union_train_test({"train": gen.filter(cut),
                                   "test": gen.filter(~cut).withColumn("mwh", F.col("mwh") / 10000.0)})
    lagged = W.add_lags(W.Panel(stacked, ["plant"], tiebreak=["origin_ord"]), "mwh", [1]).persist()
    train, test = X.split_by_origin(lagged)
    found = X.unit_factor(train, test)
    names = ["train_p95", "train_max", "test_p95", "test_max", "raw", "factor"]
    row = literal_rows(spark, [tuple(found[n] for n in names)], ", ".join(f"{n} double" for n in names))
    return row.select(*[rounded(n, 4 if n == "raw" else 6).alias(n) for n in names])


@query("""
, raw AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
                 CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type FROM events)
SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM raw)), 6) AS value,
       coalesce(event_type, (SELECT event_type FROM raw WHERE event_type IS NOT NULL
                             GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type
FROM raw""".replace(", raw AS", "WITH raw AS", 1))
def impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = S.read(spark, sf_dir, "events").select(
        "event_id", F.when(i % 7 != 0, F.col("value")).alias("value"),
        F.when(i % 5 != 0, F.col("event_type")).alias("event_type"))
    filled = X.impute(rows, X.imputation(rows, ["value"], ["event_type"]))
    return filled.withColumn("value", rounded("value", 6))


@query("SELECT plant, ts, mwh, ts >= (SELECT max(ts) FROM gen) - INTERVAL 7 DAY AS is_validation FROM gen", "gen")
def split_last_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_validation_flag(S.kept_generation(spark, sf_dir))


# --- evaluation against persistence -----------------------------------------------------

SQL["persist"] = """persist AS (
    SELECT plant, ts, mwh AS y_true, u AS yu, lag(mwh, 24) OVER w AS y_pred, lag(u, 24) OVER w AS pu
    FROM panel WINDOW w AS (PARTITION BY plant ORDER BY ts))"""


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = W.add_lags(panel(spark, sf_dir), "mwh", [24])
    return table.select("plant", "ts", F.col("mwh").alias("y_true"), F.col("lag_24").alias("y_pred"))


@query("""
SELECT count(*) AS n, CAST(sum(abs(yu - pu)) AS DOUBLE) / count(*) / 10000.0::DOUBLE AS mae,
       round(sqrt(CAST(sum((yu - pu)::HUGEINT * (yu - pu)) AS DOUBLE) / count(*)) / 10000.0::DOUBLE, 9) AS rmse,
       round(1 - CAST(sum((yu - pu)::HUGEINT * (yu - pu)) AS DOUBLE)
             / (CAST(sum(yu::HUGEINT * yu) AS DOUBLE) - CAST(sum(yu) AS DOUBLE) * CAST(sum(yu) AS DOUBLE) / count(*)), 9) AS r2
FROM persist WHERE pu IS NOT NULL""", "gen", "panel", "persist")
def persistence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = E.regression_metrics(persistence(spark, sf_dir), scale=SCALE)
    return table.withColumns({"rmse": rounded("rmse"), "r2": rounded("r2")})


@query("""
SELECT ts, CAST(sum(yu) AS DOUBLE) / 10000.0::DOUBLE AS y_true, CAST(sum(pu) AS DOUBLE) / 10000.0::DOUBLE AS y_pred
FROM persist WHERE pu IS NOT NULL GROUP BY ts""", "gen", "panel", "persist")
def sum_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sum_by_time(persistence(spark, sf_dir).na.drop(subset=["y_pred"]), scale=SCALE)


SQL["steps"] = """steps AS (
    SELECT plant, pos, origin_ts + to_hours(CAST(h AS INTEGER)) AS time, h, m[24 + h] AS y_true, us[24 + h] AS yu, m[h] AS y_pred, us[h] AS pu
    FROM (SELECT plant, pos, origin_ts, m, us, unnest(range(1, 25)) AS h
          FROM (SELECT plant, pos, n, lead(ts, 167) OVER (PARTITION BY plant ORDER BY ts) AS origin_ts,
                       list(mwh) OVER ahead AS m, list(u) OVER ahead AS us
                FROM panel WINDOW ahead AS (PARTITION BY plant ORDER BY ts ROWS BETWEEN 144 FOLLOWING AND 191 FOLLOWING))
          WHERE pos % 24 = 0 AND pos <= n - 192))"""


def horizon_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence of the last day over the next 24 rows of every strided window."""
    windows = W.strided_windows(panel(spark, sf_dir), ["mwh"], "mwh")
    last_day = F.transform(F.slice("x", 145, 24), lambda r: r["mwh"])
    return reshape.predictions_to_long(windows.withColumn("y_hat", last_day), keep=("plant", "start"))


@query("SELECT plant, pos AS start, time, CAST(h AS BIGINT) AS h, y_true, y_pred FROM steps", "gen", "panel", "steps")
def predictions_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return horizon_steps(spark, sf_dir).withColumns({"h": big("h"), "start": big("start")})


@query("""
SELECT CAST(h AS BIGINT) AS h, count(*) AS n,
       round(sqrt(CAST(sum((yu - pu)::HUGEINT * (yu - pu)) AS DOUBLE) / count(*)) / 10000.0::DOUBLE, 9) AS rmse
FROM steps GROUP BY h""", "gen", "panel", "steps")
def rmse_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = E.rmse_by_horizon(horizon_steps(spark, sf_dir), scale=SCALE)
    return table.select(big("h").alias("h"), "n", rounded("rmse").alias("rmse"))


SQL["errors"] = """errors AS (
    SELECT plant, ts, y_true, y_pred, y_true - y_pred AS resid, abs(y_true - y_pred) AS abs_err FROM persist
    WHERE y_pred IS NOT NULL),
limits AS (SELECT quantile_cont(abs_err, 0.99) AS threshold FROM errors)"""


@query("""
SELECT plant, ts, round(resid, 6) AS resid, round(threshold, 6) AS threshold, abs_err >= threshold AS is_outlier
FROM errors, limits""", "gen", "panel", "persist", "errors")
def outliers_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = E.with_residual(persistence(spark, sf_dir).na.drop(subset=["y_pred"])).persist()
    return E.top_p_outliers(errors).select("plant", "ts", rounded("resid", 6).alias("resid"),
                                           rounded("threshold", 6).alias("threshold"), "is_outlier")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE abs_err >= threshold) AS outliers FROM errors, limits""",
       "gen", "panel", "persist", "errors")
def count_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = E.with_residual(persistence(spark, sf_dir).na.drop(subset=["y_pred"])).persist()
    return E.count_outliers(E.top_p_outliers(errors))


@query("""
SELECT count(y_pred) AS n, round(avg(CASE WHEN ln(1 + y_pred) >= ln(1 + 80.0::DOUBLE) THEN 1.0 ELSE 0.0 END), 9) AS rate
FROM persist WHERE y_pred IS NOT NULL""", "gen", "panel", "persist")
def saturation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = persistence(spark, sf_dir).select(C.log_target(F.col("y_pred")).alias("p")).na.drop()
    return E.saturation_rate(logged, "p", F.log1p(F.lit(80.0))).withColumn("rate", rounded("rate"))


@query("""SELECT ts, y_true, y_pred FROM (
    SELECT ts, CAST(sum(yu) AS DOUBLE) / 10000.0::DOUBLE AS y_true, CAST(sum(pu) AS DOUBLE) / 10000.0::DOUBLE AS y_pred
    FROM persist WHERE pu IS NOT NULL GROUP BY ts) ORDER BY ts LIMIT 10""", "gen", "panel", "persist")
def debug_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = A.sum_by_time(persistence(spark, sf_dir).na.drop(subset=["y_pred"]), scale=SCALE)
    return P.first_rows(totals, ["ts"], 10)


@query(f"""
, starts AS (SELECT plant, ts, pos, row_number() OVER (ORDER BY plant, ts) AS number, count(*) OVER () AS total FROM panel WHERE pos <= n - 192),
draws AS (
    SELECT CAST('0x' || substr(md5(CAST(k AS VARCHAR) || ':42'), 1, 15) AS BIGINT) % (SELECT any_value(total) FROM starts) + 1 AS number, count(*) AS times
    FROM range({SAMPLED_WINDOWS}) t(k) GROUP BY 1)
SELECT plant, pos AS start, times FROM starts JOIN draws USING (number)""", "gen", "panel")
def sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the wanted number of window starts drawn with replacement, and how often each was."""
    starts = W.window_starts(panel(spark, sf_dir)).select("plant", "ts", big("pos").alias("start"))
    return P.sample_with_replacement(starts, SAMPLED_WINDOWS, ["plant", "ts"]).groupBy("plant", "start").agg(F.count("*").alias("times"))


