"""Line dedup by overlapping three-line windows, with built-in expressions only.

Every line is hashed, every three consecutive lines make a window with two 64-bit hashes. Windows are
grouped over all documents, combined before the shuffle, so a window of any frequency costs one row per
task. The first occurrence, by identifier (null last), text hash and position, stays. The lines that later
occurrences cover, within a document or across documents, are merged into runs, and the runs are cut out.

Lines end at line feeds and are compared as they are. Windows of blank lines only are left alone, and so
are texts of fewer than three lines. Null texts count as empty. Rows with the same identifier and text are
one document: all of them get its result. A text may become empty; no row is dropped. Columns of the input
named like an output column (other than the text itself) are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliopanel.llm.common import col, fresh, without

WINDOW = 3


def _windows(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, key, pos, a, b): hashes of the windows of each document."""
    def hashed(seed: int) -> Column:
        return F.transform("lines", lambda line: F.when(F.trim(line) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), line)))

    lines = (df.select(col(id_col).alias("id"), F.xxhash64(col(text)).alias("key"), F.split(col(text), "\n", -1).alias("lines"))
             .where(F.size("lines") >= WINDOW).select("id", "key", hashed(1).alias("x"), hashed(2).alias("y")))

    def window(i: Column) -> Column:
        x, y = ([F.get(F.col(c), i + k) for k in range(WINDOW)] for c in ("x", "y"))
        blank = (x[0] == 0) & (x[1] == 0) & (x[2] == 0)
        return F.when(~blank, F.struct(i.alias("pos"), F.xxhash64(*x).alias("a"), F.xxhash64(*y).alias("b")))

    exploded = lines.select("id", "key", F.explode(F.transform(F.sequence(F.lit(0), F.size("x") - WINDOW), window)).alias("w"))
    return exploded.where("w IS NOT NULL").select("id", "key", "w.pos", "w.a", "w.b")


def covered_runs(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, key, runs array<struct<low, high>>): runs of lines that later occurrences cover, from 0, in order."""
    windows = _windows(df, text, id_col)
    place = F.struct(F.col("id").isNull().alias("absent"), "id", "key", "pos")
    repeated = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("a", "b", "first")
    later = windows.join(repeated, ["a", "b"]).where(place != F.col("first")).select("id", "key", "pos")
    in_order = Window.partitionBy("id", "key").orderBy("pos")
    before = F.lag("pos").over(in_order)
    runs = (later.withColumn("opens", F.coalesce((F.col("pos") > before + WINDOW).cast("int"), F.lit(1)))
            .withColumn("run", F.sum("opens").over(in_order))
            .groupBy("id", "key", "run").agg(F.min("pos").alias("low"), (F.max("pos") + WINDOW - 1).alias("high")))
    return runs.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("runs"))


def line_dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All rows, the text without repeated windows, with n_lines and n_removed."""
    df = without(df, *[c for c in ("n_lines", "n_removed") if c not in (text, id_col)])
    key, id_, key_, runs_, lines = fresh(df, "key", "id", "text_key", "runs", "lines")
    runs = covered_runs(df, text, id_col).select(F.col("id").alias(id_), F.col("key").alias(key_), F.col("runs").alias(runs_))
    rows = df.withColumn(key, F.xxhash64(col(text)))
    joined = rows.join(runs, col(id_col).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(key_)), "left").withColumn(
        lines, F.split(F.coalesce(col(text), F.lit("")), "\n", -1))
    n = F.size(lines)

    def between(k: Column) -> Column:
        low = F.coalesce(F.get(F.col(runs_), k - 1)["high"] + 1, F.lit(0))
        return F.slice(F.col(lines), low + 1, F.coalesce(F.get(F.col(runs_), k)["low"], n) - low)

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs_)), between))
    removed = F.aggregate(runs_, F.lit(0), lambda s, r: s + r["high"] - r["low"] + 1)
    cut = F.col(runs_).isNotNull()
    return joined.select(*[F.when(cut, F.array_join(pieces, "\n")).otherwise(col(c)).alias(c) if c == text else col(c) for c in df.columns],
                         n.alias("n_lines"), F.coalesce(removed, F.lit(0)).alias("n_removed"))
