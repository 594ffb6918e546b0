"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopanel.session import shared_folder as shared_path

#: The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
#: Narrow rows that are worth a task of their own.
TASK_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that an operator's own output columns replace."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def squeezed(text: Column) -> Column:
    """The text without any white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts the lineage and survives lost executors.

    `rows` is about the number of rows of a narrow table, where it is known: a small one is written by few tasks, a
    large one by as many as without it.
    """
    path = shared_path(df.sparkSession)
    (df if rows is None else df.coalesce(rows // TASK_ROWS + 1)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
