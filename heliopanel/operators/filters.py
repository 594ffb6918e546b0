"""Projections, filters and repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliopanel import constants as K
from heliopanel.functions.scale import null_non_finite, zero_non_finite
from heliopanel.functions.timefx import add_hours, at_midnight, parse_mixed_ts


def select_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Project to the columns {old: new} in the given order."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def with_constant_default(df: DataFrame, column: str, value: str) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def decoded_path(c: Column) -> Column:
    """Path or file name as it is on disk; the metadata columns give it URL-encoded."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Base name of the file a row came from, with brackets and blanks decoded."""
    return df.withColumn(name, decoded_path(F.col("_metadata.file_name")))


def clean_column_names(df: DataFrame) -> DataFrame:
    """Drop byte order marks and collapse white space in the column names."""
    return df.toDF(*[" ".join(c.replace("\ufeff", "").split()) for c in df.columns])


def filter_contains(df: DataFrame, column: str, word: str = K.SOLAR) -> DataFrame:
    return df.filter(F.col(column).contains(word))


def filter_years(df: DataFrame, ts: str, years: Sequence[int]) -> DataFrame:
    return df.filter(F.year(ts).isin(list(years)))


def filter_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def filter_nonempty_region(df: DataFrame, column: str = "region") -> DataFrame:
    return df.filter(F.col(column) != "")


def filter_since(df: DataFrame, ts: str, start: str) -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))


def filter_range(df: DataFrame, ts: str, start: str, days: int = 7) -> DataFrame:
    """start <= ts < start + days, from midnight."""
    first = at_midnight(F.lit(start).cast("timestamp_ntz"))
    return df.filter((F.col(ts) >= first) & (F.col(ts) < add_hours(first, F.lit(24 * days))))


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null measures become 0; text columns are left alone."""
    return df.na.fill(0, subset=list(columns))


def null_non_finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: null_non_finite(F.col(c)) for c in columns})


def zero_non_finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: zero_non_finite(F.col(c)) for c in columns})


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    """Fail early when an input has no rows."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df


def sort_by(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending order with nulls last."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in columns])


def sort_by_count_desc(df: DataFrame, count: str, name: str) -> DataFrame:
    """Largest count first, ties by name."""
    return df.orderBy(F.desc_nulls_last(count), F.asc_nulls_last(name))


def first_rows(df: DataFrame, order: Sequence[str], rows: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def replace_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replace exact values of a text column."""
    return df.replace(mapping, subset=[column])


def sample_with_replacement(df: DataFrame, rows: int, order: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly `rows` rows drawn with replacement; the same ones for the same table, order and seed.

    Draw k takes the row whose number in the order is a hash of k and the seed, so a draw needs no other: draws of one
    row are counted before the shuffle, and rows and draws meet by number. Rows that are equal in the order
    are numbered in any way. An empty table gives no rows.
    """
    from heliopanel.operators.regions import with_row_number

    total = df.count()
    if total == 0:
        return df
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary"))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % total + 1
    draws = df.sparkSession.range(rows).groupBy(number.alias("_number")).agg(F.count("*").cast("int").alias("_times"))
    numbered = with_row_number(df, [F.asc(c) for c in order], "_number")
    drawn = numbered.join(draws, "_number").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return drawn.select(*df.columns)


def find_column(columns: Sequence[str], candidates: Sequence[str]) -> str:
    """First candidate present, exactly or else ignoring case."""
    lowered = {c.lower(): c for c in columns}
    for choice in (lambda c: c if c in columns else None, lambda c: lowered.get(c.lower())):
        for candidate in candidates:
            if (found := choice(candidate)) is not None:
                return found
    raise KeyError(f"none of {list(candidates)} in {list(columns)}")


def detect_datetime(df: DataFrame, name: str = "ts") -> DataFrame:
    """Add the time column: the first candidate that parses at all, else date plus hour.

    One aggregate looks at all candidates together.
    """
    present = [c for c in K.DATETIME_CANDIDATES if c in df.columns]
    if present:
        parses = df.agg(*[
            F.max(parse_mixed_ts(F.col(f"`{c}`")).isNotNull()).alias(f"ok{i}") for i, c in enumerate(present)
        ]).first()
        for i, c in enumerate(present):
            if parses[f"ok{i}"]:
                return df.withColumn(name, parse_mixed_ts(F.col(f"`{c}`")))
    day = next((c for c in K.DATE_CANDIDATES if c in df.columns), None)
    hour = next((c for c in K.HOUR_CANDIDATES if c in df.columns), None)
    if day is None or hour is None:
        raise ValueError("no time column")
    return df.withColumn(name, date_plus_hour(F.col(f"`{day}`"), F.col(f"`{hour}`")))


def date_plus_hour(day: Column, hour: Column) -> Column:
    """Date text plus the first one or two digits of the hour text, kept within 0..23."""
    number = F.regexp_extract(hour.cast("string"), r"(\d{1,2})", 1).try_cast("int")
    return add_hours(at_midnight(parse_mixed_ts(day)), F.least(F.greatest(number, F.lit(0)), F.lit(23)))
