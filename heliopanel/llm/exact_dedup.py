"""Exact duplicates by content sort, with built-in expressions only.

Rows are range-partitioned by splitters that Spark samples from the start of the text without white
space, with a hash and a salt as further sort keys; each partition is sorted externally on the whole
text, so equal texts are neighbours, and a row opens a group where its whole text differs from its
neighbour's.

A text with more copies than an average partition holds rows is hot. There are at most as many hot
texts as partitions, so their list may be broadcast. The copies of a hot text are salted over several
ranges; each range keeps one best row, and these few rows are compared once more.

Null texts count as empty. All empty texts are equal. Of equal texts the row with the most code points
in its original text stays, then the smallest identifier (null last); of repeated rows that agree in
both, exactly one stays. Columns of the input named like an output column are replaced by it. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliopanel.llm.common import col, fresh, shuffle_partitions, squeezed, stored, without

OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", prefix_chars: int = 32) -> DataFrame:
    """All rows of `df` with keep_id, group_size, kept and text_sha256."""
    df = without(df, *OUTPUT)
    names = df.columns
    length, key, prefix, salts, part, norm, rank, best, size, copies = fresh(
        df, "length", "key", "prefix", "salts", "part", "norm", "rank", "best", "size", "copies")
    spark = df.sparkSession
    keyed = (df.withColumn(norm, squeezed(col(text)))
             .withColumn(key, F.xxhash64(norm))
             .withColumn(prefix, F.substring(norm, 1, prefix_chars))
             .withColumn(length, F.length(F.coalesce(col(text), F.lit(""))))
             .drop(norm))

    # At most `partitions` texts can have more than total / partitions copies.
    partitions = shuffle_partitions(spark)
    limit = max(1, df.count() // partitions)
    hot = stored(keyed.groupBy(key).agg(F.count("*").alias(copies)).where(F.col(copies) > limit)
                 .select(key, F.ceil(F.col(copies) / limit).cast("int").alias(salts)).coalesce(1))

    placed = (keyed.join(F.broadcast(hot), key, "left")
              .withColumn(part, F.when(F.col(salts).isNull(), 0).otherwise(F.pmod(F.xxhash64(col(id_col)), F.col(salts)))))
    ranged = placed.repartitionByRange(prefix, key, part).withColumn(norm, squeezed(col(text)))
    order = [F.col(length).desc(), col(id_col).asc_nulls_last()]
    group = Window.partitionBy(prefix, key, part, salts, norm).orderBy(*order)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (ranged.withColumn(rank, F.row_number().over(group))
            .withColumn(best, F.first(col(id_col)).over(whole))
            .withColumn(size, F.count("*").over(whole))
            .withColumn("text_sha256", F.sha2(F.col(norm).cast("binary"), 256)))

    keep, total, kept = F.col(best), F.col(size), F.col(rank) == 1
    if not hot.isEmpty():
        first, all_best, all_size = fresh(df, "first", "all_best", "all_size")
        salted = Window.partitionBy(key, "text_sha256").orderBy(F.col(length).desc(), F.col(best).asc_nulls_last(), F.col(part))
        every = salted.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        merged = stored(runs.where(F.col(salts).isNotNull() & (F.col(rank) == 1))
                        .select(key, part, length, best, size, "text_sha256")
                        .select(F.col(key), F.col(part), F.col("text_sha256"),
                                (F.row_number().over(salted) == 1).alias(first),
                                F.first(best).over(every).alias(all_best), F.sum(size).over(every).alias(all_size)))
        # One row per salt of a hot text: at most twice as many as partitions.
        runs = runs.join(F.broadcast(merged), [key, part, "text_sha256"], "left")
        unsalted = F.col(salts).isNull()
        keep = F.when(unsalted, keep).otherwise(F.col(all_best))
        total = F.when(unsalted, total).otherwise(F.col(all_size))
        kept = kept & (unsalted | F.col(first))
    return runs.select(*[col(c) for c in names], keep.alias("keep_id"), total.cast("long").alias("group_size"),
                       kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of the input."""
    if any(c in df.columns for c in OUTPUT):
        packed = df.select(F.struct("*").alias("row"), col(text).alias("text"), col(id_col).alias("doc_id"))
        return exact_dedup(packed).where("kept").select("row.*")
    return exact_dedup(df, text, id_col).where("kept").select(*[col(c) for c in df.columns])
