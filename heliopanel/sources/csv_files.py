"""Delimited files with unknown encoding, delimiter and header.

The first bytes of each file give its delimiter and header, one distributed pass over the raw lines its encoding (UTF-8
when every line is valid UTF-8, else cp949). Files that agree on all three
form a group, and a group is read with a single multi-path scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopanel import constants as K
from heliopanel import schemas
from heliopanel.functions import text as T
from heliopanel.functions.timefx import hour_to_timestamp, parse_mixed_ts, strip_digits_date
from heliopanel.operators.aggregates import union_all
from heliopanel.operators.filters import clean_column_names, decoded_path, find_column, with_constant_default, with_source_file
from heliopanel.operators.reshape import melt_hours
from heliopanel.session import literal_rows

SNIFF_BYTES = 2048
KOREAN = "MS949"


@dataclass(frozen=True)
class HeaderGroup:
    """Files that share encoding, delimiter and header line."""

    encoding: str
    delimiter: str
    paths: tuple[str, ...]


def allow_korean_charset(spark: SparkSession) -> None:
    """Let this session decode cp949; bad bytes become U+FFFD instead of an error."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def list_input_files(spark: SparkSession, folder: str, pattern: str = "*.csv",
                     recursive: bool = True) -> DataFrame:
    """path and length of the matching files, in path order; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
            .option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path"))


def list_weather_files(spark: SparkSession, folder: str) -> DataFrame:
    return list_input_files(spark, folder, "OBS_ASOS_TIM_*.csv", recursive=False)


def _byte_count(text: Column, byte: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(byte), F.lit("")))


def sniff_delimiter(head: Column) -> Column:
    """Comma when the first bytes hold at least as many commas as tabs, else tab."""
    start = F.substring(head.cast("binary"), 1, SNIFF_BYTES).cast("string")
    return F.when(_byte_count(start, ",") >= _byte_count(start, "\t"), F.lit(",")).otherwise(F.lit("\t"))


def _opened(path: str):
    """A file for reading by offset; paths are decoded ones."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[len("file:"):].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/"))
    return system.open_input_file(inner)


def _head_of(path: str) -> bytes:
    """The first SNIFF_BYTES of a file, and the rest of its first line."""
    with _opened(path) as file:
        data = file.read(SNIFF_BYTES)
        while b"\n" not in data and b"\r" not in data and (more := file.read(SNIFF_BYTES)):
            data += more
    return data


def _read_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [_head_of(path) for path in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], ["path", "head"])


def _heads(files: DataFrame) -> DataFrame:
    """path and head of each file with content, by byte range; through Spark where pyarrow does not know the file system."""
    named = files.select(decoded_path(F.col("_metadata.file_path")).alias("path"), "content")
    first = named.select("path").first()
    try:
        if first:
            _opened(first[0]).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return named.select("path", F.substring("content", 1, 32 * SNIFF_BYTES).alias("head"))
    return named.select("path").mapInArrow(_read_heads, "path string, head binary")


def empty_files(files: DataFrame) -> list[str]:
    """Paths of the listed files without content, which no scan returns."""
    full = {r[0] for r in files.select(decoded_path(F.col("_metadata.file_path"))).collect()}  # file names only
    # The listing writes local paths with three slashes, the metadata column with one.
    return sorted({re.sub("^file:/+", "file:/", unquote(path)) for path in files.inputFiles()} - full)


def file_heads(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = True) -> DataFrame:
    """path, encoding, delimiter and header line of each file, and the reason why a file cannot be read.

    Delimiter and header come from the first bytes alone. The encoding needs every line: one scan, of which only two
    flags a file are shuffled.
    """
    allow_korean_charset(spark)
    source = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern)
    files = source.format("binaryFile").load(folder)
    empty = literal_rows(spark, [(path, b"") for path in empty_files(files)], "path string, head binary")
    heads = _heads(files).unionByName(empty)
    value = F.col("value")
    utf8 = F.is_valid_utf8(value)
    korean = F.when(utf8, True).otherwise(~F.decode(value.cast("binary"), KOREAN).contains("\ufffd"))
    encodings = (source.text(folder).select(decoded_path(F.col("_metadata.file_path")).alias("path"), "value")
                 .groupBy("path").agg(F.bool_and(utf8).alias("utf8"), F.bool_and(korean).alias("korean")))
    text = F.col("head").cast("string")
    first = F.substring_index(F.substring_index(text, "\n", 1), "\r", 1)
    header = F.when(F.col("utf8"), first).otherwise(F.decode(first.cast("binary"), KOREAN))
    reason = F.when(F.col("utf8").isNull(), "empty file").when(~F.col("utf8") & ~F.col("korean"), "neither UTF-8 nor cp949")
    return (heads.join(encodings, "path", "left")
            .select("path", F.when(F.col("utf8"), F.lit("UTF-8")).otherwise(F.lit(KOREAN)).alias("encoding"),
                    sniff_delimiter(text).alias("delimiter"),
                    F.replace(header, F.lit("\ufeff"), F.lit("")).alias("header"), reason.alias("reason")))


def header_groups(heads: DataFrame) -> list[HeaderGroup]:
    """Groups of files that can be read; only file metadata reaches the driver, as in any file listing."""
    grouped = (heads.where("reason is null").groupBy("encoding", "delimiter", "header")
               .agg(F.array_sort(F.collect_list("path")).alias("paths"))
               .orderBy(F.element_at("paths", 1)))
    return [HeaderGroup(r["encoding"], r["delimiter"], tuple(r["paths"])) for r in grouped.collect()]


def _literal_path(path: str) -> str:
    """Path whose brackets and other pattern characters stand for themselves."""
    return re.sub(r"([\[\]{}*?])", r"\\\1", path)


def read_group(spark: SparkSession, group: HeaderGroup, delimiter: str | None = None) -> DataFrame:
    """All columns as text, plus source_file and row_ord (order by full path, then in the file)."""
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("sep", delimiter or group.delimiter).option("encoding", group.encoding)
          .csv([_literal_path(p) for p in group.paths]))
    names = df.columns
    order = F.struct(decoded_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
    return with_source_file(df.withColumn("row_ord", order)).select(*[f"`{n}`" for n in names],
                                                                    "source_file", "row_ord")


def read_csv_safe(spark: SparkSession, path: str, delimiter: str | None = None, pattern: str = "*.csv",
                  recursive: bool = True) -> DataFrame:
    """Text columns of one or more files, encoding and delimiter found per file.

    Byte order marks are dropped. Columns that only some files have are null in the others. Empty files and files in
    another encoding are left out; `file_heads` names them.
    """
    groups = header_groups(file_heads(spark, path, pattern, recursive))
    if not groups:
        raise ValueError(f"no file of {path} can be read")
    frames = [read_group(spark, g, delimiter) for g in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv_flex(spark: SparkSession, path: str) -> DataFrame:
    """The same with a fixed comma."""
    return read_csv_safe(spark, path, delimiter=",")


read_csv_auto = read_csv_flex


@dataclass(frozen=True)
class Header:
    """What the column names of one group say: hour columns by hour, their unit, column roles."""

    columns: tuple[str, ...]
    hours: tuple[tuple[str, int], ...]
    unit: str | None
    roles: dict[str, str | None]

    def assign_unit(self) -> str:
        """The unit an hour column names, else MWh for files with plant names and kWh without."""
        return self.unit or ("mwh" if self.roles["meter_name"] else "kwh")


def _contains_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def read_headers(spark: SparkSession, tables: list[list[str]]) -> list[Header]:
    """Roles, hours and unit of the column names of several tables, with one small query."""
    names = [(g, i, name) for g, columns in enumerate(tables) for i, name in enumerate(columns)]
    name = F.col("name")
    plain = T.norm(name)
    tests = {
        "plant": _contains_any(plain, K.PLANT_TOKENS),
        "location": _contains_any(plain, K.LOCATION_TOKENS),
        "source": _contains_any(plain, K.SOURCE_TOKENS),
        "meter_name": _contains_any(name, K.METER_NAME_TOKENS),
        "meter_date": _contains_any(name, K.METER_DATE_TOKENS),
        "meter_unit_no": _contains_any(name, K.METER_UNIT_NO_TOKENS),
    }
    rows = (literal_rows(spark, names, "g int, i int, name string")
            .select("g", "i", "name", T.extract_hour(name).alias("hour"), T.detect_unit(name).alias("unit"),
                    *[t.alias(k) for k, t in tests.items()])
            .orderBy("g", "i").collect())
    headers = []
    for g, columns in enumerate(tables):
        mine = [r for r in rows if r["g"] == g]
        hours = sorted((r for r in mine if r["hour"] is not None), key=lambda r: (r["hour"], r["i"]))
        headers.append(Header(
            tuple(columns),
            tuple((r["name"], r["hour"]) for r in hours),
            next((r["unit"] for r in hours if r["unit"]), None),
            {k: next((r["name"] for r in mine if r[k]), None) for k in tests},
        ))
    return headers


def meter_rows(df: DataFrame, header: Header, years: list[int] | None = None) -> DataFrame:
    """One wide meter table (text columns and source_file) to rows of ts, plant, mwh.

    Years and plant names are filtered before the unpivot, which multiplies rows by 24.
    """
    day = strip_digits_date(F.col(f"`{header.roles['meter_date']}`"))
    if header.roles["meter_name"]:
        plant = T.strip(F.col(f"`{header.roles['meter_name']}`"))
    else:
        plant = F.coalesce(T.extract_plant_name(F.col("source_file")), F.lit(K.UNKNOWN_PLANT))
    labels = [f"{hour}:{i}" for i, (_, hour) in enumerate(header.hours)]
    wide = df.select(day.alias("day"), plant.alias("plant"),
                     *[F.col(f"`{c}`").alias(label) for label, (c, _) in zip(labels, header.hours)])
    if header.roles["meter_name"]:
        wide = wide.filter(F.col("plant").contains(K.SOLAR))
    wide = wide.filter(F.col("day").isNotNull() if years is None else F.year("day").isin(years))
    long = melt_hours(wide, ["day", "plant"], labels)
    hour = F.substring_index("hour_label", ":", 1).cast("int")
    return long.replace(K.PLANT_CORRECTIONS, subset=["plant"]).select(
        hour_to_timestamp(F.col("day"), hour).alias("ts"), "plant",
        T.convert_to_mwh(F.col("raw"), F.lit(header.assign_unit())).alias("mwh"))


def harmonise_columns(df: DataFrame, roles: dict[str, str | None], keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to {canonical name: column found}; roles without a column are left out."""
    found = [F.col(f"`{column}`").alias(role) for role, column in roles.items() if column is not None]
    return df.select(*found, *keep)


def location_rows(df: DataFrame, header: Header) -> DataFrame:
    """One location table to plant, energy_source, address, source_file, row_ord."""
    roles = {"plant": header.roles["plant"], "energy_source": header.roles["source"],
             "address": header.roles["location"]}
    rows = harmonise_columns(df, roles, ("source_file", "row_ord"))
    rows = with_constant_default(rows, "energy_source", K.SOLAR)
    return rows.withColumn("address", T.simplify_address(F.col("address"))).select(
        "plant", "energy_source", "address", "source_file", "row_ord")


def _rejects(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return literal_rows(spark, rows, schemas.REJECTS)


def _read_harmonised(spark: SparkSession, folder: str, needs: dict[str, str], convert) -> tuple[DataFrame | None, DataFrame]:
    heads = file_heads(spark, folder).persist()
    groups = header_groups(heads)
    unread = [tuple(r) for r in heads.where("reason is not null").select("path", "reason").orderBy("path").collect()]
    heads.unpersist()
    tables = [read_group(spark, g) for g in groups]
    headers = read_headers(spark, [[c for c in t.columns if c not in ("source_file", "row_ord")] for t in tables])
    frames, bad = [], unread
    for group, table, header in zip(groups, tables, headers):
        reason = next((why for role, why in needs.items()
                       if not (header.hours if role == "hours" else header.roles[role])), None)
        if reason:
            bad += [(path, reason) for path in group.paths]
        else:
            frames.append(convert(table, header))
    return (union_all(frames) if frames else None), _rejects(spark, bad)


def read_generation(spark: SparkSession, folder: str, years: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Meter files below a folder as (ts, plant, mwh) rows, and the rejected files."""
    rows, rejects = _read_harmonised(
        spark, folder, {"hours": "no hour column", "meter_date": "no date column"},
        lambda table, header: meter_rows(table, header, years))
    if rows is None:
        raise ValueError(f"no usable meter file in {folder}")
    return rows, rejects


def read_locations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Plant location files below a folder, and the rejected files."""
    rows, rejects = _read_harmonised(
        spark, folder, {"plant": "no plant column", "location": "no location column"}, location_rows)
    if rows is None:
        raise ValueError(f"no usable location file in {folder}")
    return rows, rejects


def read_station_meta(spark: SparkSession, path: str) -> DataFrame:
    """Stations with coordinates; ord is the order in the file."""
    df = read_csv_safe(spark, path)
    typed = {"station": lambda c: c.try_cast("bigint"), "lat": T.to_numeric_coerce, "lon": T.to_numeric_coerce}
    return df.select(*[typed.get(new, lambda c: c)(F.col(old)).alias(new) for old, new in K.STATION_COLUMNS.items()],
                     F.col("row_ord").alias("ord")).na.drop(subset=["lat", "lon"])


def _typed(c: Column, name: str) -> Column:
    """Text column of a published table under its canonical name and type."""
    if name == "ts":
        return parse_mixed_ts(c).alias(name)
    if name == "station":
        return c.try_cast("bigint").alias(name)
    if name in ("plant", "station_name"):
        return c.alias(name)
    return T.to_numeric_coerce(c).alias(name)


def weather_columns(table: DataFrame) -> DataFrame:
    """Weather text columns to canonical names and types, with source_file and row_ord."""
    return table.select(*[_typed(F.col(f"`{old}`"), new) for old, new in K.WEATHER_COLUMNS.items()],
                        "source_file", "row_ord")


def read_weather(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Hourly weather files of a folder, and the rejected files."""
    groups = header_groups(file_heads(spark, folder, "OBS_ASOS_TIM_*.csv", recursive=False))
    frames, bad = [], []
    for group in groups:
        table = read_group(spark, group)
        if not set(K.WEATHER_COLUMNS) <= set(table.columns):
            bad += [(path, "missing weather column") for path in group.paths]
            continue
        frames.append(weather_columns(table))
    if not frames:
        raise ValueError(f"no usable weather file in {folder}")
    return union_all(frames), _rejects(spark, bad)


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """A published training table back under its canonical column names and types.

    Time, plant and target may go by any of their candidate names; other columns that are missing are null.
    """
    df = read_csv_flex(spark, path)
    named = {"ts": K.TIME_COLUMN_CANDIDATES, "plant": K.PLANT_COLUMN_CANDIDATES, "mwh": K.TARGET_COLUMN_CANDIDATES}
    found = {new: find_column(df.columns, named[new]) if new in named else old for new, old in K.TRAINING_COLUMNS.items()}
    return df.select(*[_typed(F.col(f"`{old}`") if old in df.columns else F.lit(None).cast("string"), new) for new, old in found.items()])


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Generator registry exported as CSV, under canonical names."""
    df = clean_column_names(read_csv_safe(spark, path))
    return df.select(*[(F.lit("0") if new == "capacity" and old not in df.columns else F.col(f"`{old}`")).alias(new)
                       for old, new in K.REGISTRY_COLUMNS.items()])
