"""Time functions. All time stamps are TIMESTAMP_NTZ; none depends on the session zone."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEEKDAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]


def at_midnight(c: Column) -> Column:
    return c.cast("date").cast("timestamp_ntz")


def add_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"), F.lit(0), F.lit(0))


def floor_hour(ts: Column) -> Column:
    return add_hours(at_midnight(ts), F.hour(ts))


def hour_to_timestamp(day: Column, hour: Column) -> Column:
    """Start of the hour that ends at `hour` (1..24): hour 24 is 23:00 of the same day."""
    return add_hours(at_midnight(day), hour - 1)


def strip_digits_date(c: Column) -> Column:
    """Date from text with any separators (first eight digits), null when invalid."""
    digits = F.substring(F.regexp_replace(c.cast("string"), "[^0-9]", ""), 1, 8)
    return F.try_to_date(digits, "yyyyMMdd").cast("timestamp_ntz")


def parse_mixed_ts(c: Column) -> Column:
    """Time stamp with or without seconds, in the usual separators; null when invalid."""
    text = F.trim(c.cast("string"))
    unified = F.regexp_replace(text, r"^(\d{4})[./](\d{1,2})[./](\d{1,2})", "$1-$2-$3")
    compact = F.regexp_replace(unified, r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3")
    return compact.try_cast("timestamp_ntz")


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2 * pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def time_features(ts: Column) -> dict[str, Column]:
    """Hour, weekday (Monday 0), month, weekend flag and their cyclic forms."""
    hour, weekday, month = F.hour(ts), F.weekday(ts), F.month(ts)
    hour_sin, hour_cos = cyclic(hour, 24)
    month_sin, month_cos = cyclic(month, 12)
    return {
        "hour": hour,
        "dayofweek": weekday,
        "month": month,
        "is_weekend": (weekday >= 5).cast("int"),
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "month_sin": month_sin,
        "month_cos": month_cos,
    }


def doy_features(ts: Column) -> dict[str, Column]:
    hour_sin, hour_cos = cyclic(F.hour(ts), 24)
    doy_sin, doy_cos = cyclic(F.dayofyear(ts), 365.25)
    return {"hour_sin": hour_sin, "hour_cos": hour_cos, "doy_sin": doy_sin, "doy_cos": doy_cos}


def week_start(ts: Column, anchor: str = "W-MON") -> Column:
    """First day of the week that ends on the anchor day ("W-MON" runs Tuesday to Monday)."""
    last = WEEKDAYS.index(anchor.removeprefix("W-"))
    days_in = F.pmod(F.weekday(ts) - F.lit(last + 1), F.lit(7))
    return F.date_sub(ts.cast("date"), days_in).cast("timestamp_ntz")


def week_end(ts: Column, anchor: str = "W-MON") -> Column:
    return F.date_add(week_start(ts, anchor).cast("date"), 6).cast("timestamp_ntz")


def week_index(ts: Column, first: Column) -> Column:
    """Whole weeks since the day of `first`."""
    return F.floor(F.datediff(ts.cast("date"), first.cast("date")) / 7).cast("int")


def month_ranges(spark: SparkSession, years: list[int]) -> DataFrame:
    """First and last day of every month of the years, also as yyyyMMdd text."""
    year = spark.range(1).select(F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
    return year.select("year", F.inline(month_range_array(F.col("year"))))


def month_range_array(year: Column) -> Column:
    """The twelve (month, first day, last day) of a year as an array of structs."""
    firsts = F.sequence(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(1)),
                        F.expr("INTERVAL 1 MONTH"))
    return F.transform(firsts, lambda d: F.struct(
        F.month(d).alias("month"),
        d.alias("first_day"),
        F.last_day(d).alias("last_day"),
        F.date_format(d, "yyyyMMdd").alias("start_text"),
        F.date_format(F.last_day(d), "yyyyMMdd").alias("end_text"),
    ))
