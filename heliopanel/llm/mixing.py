"""Mixing sources to target weights by Sainte-Laguë apportionment, with built-in expressions only.

Sizes are word counts. Every source has a target number of words: its weight's share of all words, but
at most `most_repeats` times its own size; what is cut off is shared again by weight. Targets are paid
out in equal blocks of `block_words` words. Blocks go to the sources, and then to the shards of each
source, by highest quotients size / (2 seats + 1), so every shard has a whole number of blocks. A shard
lays its documents end to end in a seeded order as a ring; from a seeded block on it takes as many words
as its blocks hold, going round again where it is to repeat. So a document is taken a whole number of
times, but for the documents at the two ends. Where whole documents are asked for, what is taken of these
is rounded over the whole source, so it is missed by one document at most, however long the documents are.

Shards are ranges of a seeded hash of the identifier, about `shard_words` words each and 65,536 more
than there are sources at most, so a source of any size is spread. What is kept per source and per shard is bounded by these
numbers; one task orders the sources, one narrow row each.

Null and empty texts have size 0 and are never taken. Sources sort by code point, null last. Repeated
rows count each for itself. Input columns named like an output column are replaced by it. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliopanel.llm.common import col, fresh, n_words, stored, without

OUTPUT = ("size", "source_size", "target", "taken")
FINE = 16_384
MOST_SHARDS = 65_536
#: Tables up to this many rows are broadcast; longer ones are joined by shuffling.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def apportion(df: DataFrame, group: list[str], votes: str, seats: str, tie: Column) -> DataFrame:
    """Add `_won`: of the group's `seats`, those that go to the row by the highest quotients.

    Rounding votes / (all votes / seats) misses the total by at most half the rows of the group, so
    only quotients near that rounding have to be ranked: about six for each row.
    """
    whole = Window.partitionBy(*group)
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(F.lit(0.0))
    near = (df.withColumn("_all", F.sum(votes).over(whole)).withColumn("_rows", F.count("*").over(whole))
            .withColumn("_id", F.row_number().over(whole.orderBy(tie)))
            .withColumn("_base", F.floor(share * F.col(seats) + 0.5))
            .withColumn("_reach", F.ceil(share * F.col("_rows")) + 1)
            .withColumn("_low", F.greatest(F.lit(0), F.col("_base") - F.col("_reach")))
            .withColumn("_open", F.col(seats) - F.sum("_low").over(whole)))
    quotients = (near.where(F.col(votes) > 0)
                 .withColumn("_seat", F.explode(F.sequence(F.col("_low"), F.col("_base") + F.col("_reach"))))
                 .withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") + 1))
                 .withColumn("_place", F.row_number().over(whole.orderBy(F.desc("_quotient"), "_id"))))
    won = quotients.where(F.col("_place") <= F.col("_open")).groupBy(*group, "_id").agg(F.count("*").alias("_extra"))
    same = F.col("n._id").eqNullSafe(F.col("w._id"))
    for g in group:
        same = same & F.col(f"n.{g}").eqNullSafe(F.col(f"w.{g}"))
    return (near.alias("n").join(won.alias("w"), same, "left")
            .select(*[F.col(f"n.{c}") for c in df.columns],
                    F.when(F.col(f"n.{votes}") > 0, F.col("n._low") + F.coalesce("w._extra", F.lit(0)))
                    .otherwise(F.lit(0)).cast("long").alias("_won")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most_repeats: int) -> DataFrame:
    """From (source, words): one row per source with its weight and target, capped sources first filled."""
    one = F.lit(0)
    ranked = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        ((F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy(one)
    before = everything.orderBy(F.col("words") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("words") * most_repeats
    level = ((F.sum("words").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    levels = (ranked.withColumn("_level", level.cast("double"))
              .withColumn("_place", F.count("*").over(before)))
    # Sources are met in the order in which a rising level reaches their caps.
    free = F.when(cap >= F.col("weight") * F.col("_level"), F.struct("_place", "_level"))
    target = F.least(cap.cast("double"), F.col("weight") * F.coalesce(F.min(free).over(everything)["_level"], F.lit(float("inf"))))
    return levels.select("source", "words", "weight", target.alias("target"))


def with_sizes(df: DataFrame, text: str, id_col: str, seed: int) -> tuple[DataFrame, list[str]]:
    """`df` with its word counts and seeded hashes, and the names of these and of the columns that `laid_out` adds."""
    inner = fresh(df, "size", "fine", "shard", "order", "tie", "start")
    size, fine, _, order, _, _ = inner
    return (df.withColumn(size, n_words(col(text))).withColumn(order, F.xxhash64(F.lit(seed), col(id_col)))
            .withColumn(fine, F.pmod(F.xxhash64(F.lit(seed + 1), col(id_col)), F.lit(FINE)).cast("int"))), inner


def shard_quotas(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3),
                 most_repeats: int = 3, block_words: int = 16, shard_words: int = 65_536, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets and shards, and the words each shard owes."""
    sized, (size, fine, *_) = with_sizes(df, text, id_col, seed)
    by_range = stored(sized.groupBy(col(source).alias("source"), F.col(fine).alias("fine")).agg(F.sum(size).alias("words")))
    targets = stored(source_targets(by_range.groupBy("source").agg(F.sum("words").alias("words")), weights, most_repeats))
    all_words = targets.agg(F.sum("words")).first()[0] or 0

    per_shard = max(shard_words, -(-all_words // MOST_SHARDS))
    sources = (apportion(targets.withColumn("_blocks", F.lit(round(all_words / block_words))).withColumn("_one", F.lit(0)), ["_one"],
                         "target", "_blocks", F.col("source").asc_nulls_last())
               .select("source", F.col("words").alias("source_size"), "target", F.col("_won").alias("blocks"),
                       F.least(F.greatest(F.ceil(F.col("words") / per_shard), F.lit(1)), F.lit(FINE)).cast("int").alias("shards")))
    sources = small(stored(sources))

    in_shards = (by_range.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
                 .groupBy("source", F.floor(F.col("fine") * F.col("shards") / FINE).cast("int").alias("shard"))
                 .agg(F.sum("words").alias("shard_words"), F.first("blocks").alias("blocks")))
    quotas = (apportion(in_shards, ["source"], "shard_words", "blocks", F.col("shard"))
              .select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_words",
                      F.least(F.col("_won") * block_words, F.col("shard_words") * most_repeats).alias("quota"),
                      (F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"),
                              F.greatest(F.ceil(F.col("shard_words") / block_words), F.lit(1))) * block_words).alias("from")))
    return sources, small(stored(quotas))


def laid_out(df: DataFrame, sources: DataFrame, quotas: DataFrame, text: str, source: str, id_col: str, seed: int,
             place: tuple[str, str] | None = None) -> DataFrame:
    """All rows of `df` with the output columns, and with the row's shard and start in it, where `place` names them."""
    names = df.columns
    sized, (size, fine, shard, order, tie, start) = with_sizes(df, text, id_col, seed)
    # Columns of the two lookup tables get a prefix that no input column starts with.
    p = fresh(df, "m")[0]
    while any(c.lower().startswith(p) for c in df.columns):
        p = "_" + p
    known = sources.select(*[F.col(c).alias(p + c) for c in ("source", "source_size", "target", "shards")])
    owed = quotas.select(*[F.col(c).alias(p + c) for c in ("q_source", "q_shard", "shard_words", "quota", "from")])
    in_order = Window.partitionBy(col(source), shard).orderBy(order, col(id_col), size, tie)
    laid = (sized.join(known, col(source).eqNullSafe(F.col(p + "source")))
            .withColumn(shard, F.floor(F.col(fine) * F.col(p + "shards") / FINE).cast("int")).withColumn(tie, F.xxhash64(col(text)))
            .withColumn(start, F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size))
            .join(owed, col(source).eqNullSafe(F.col(p + "q_source")) & (F.col(shard) == F.col(p + "q_shard"))))
    ring, quota, at = F.col(p + "shard_words"), F.col(p + "quota"), F.col(p + "from")
    rest, begin, end = quota % ring, F.col(start), F.col(start) + F.col(size)

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, high) - F.greatest(begin, low))

    taken = F.when(ring > 0, F.floor(quota / ring) * F.col(size) + overlap(at, F.least(at + rest, ring)) + overlap(F.lit(0), at + rest - ring)).otherwise(0)
    where = [F.col(c).alias(name) for c, name in zip((shard, start), place or ())]
    return laid.select(*[col(c) for c in names], F.col(size).alias("size"), F.col(p + "source_size").alias("source_size"),
                       F.col(p + "target").alias("target"), taken.cast("long").alias("taken"), *where)


def mix(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3),
        most_repeats: int = 3, block_words: int = 16, shard_words: int = 65_536, seed: int = 17) -> DataFrame:
    """All rows of `df` with size, source_size, target (both of the row's source) and taken."""
    df = without(df, *OUTPUT)
    sources, quotas = shard_quotas(df, text, source, id_col, weights, most_repeats, block_words, shard_words, seed)
    return laid_out(df, sources, quotas, text, source, id_col, seed)


def rounded_ends(laid: DataFrame) -> DataFrame:
    """(source, shard, start, extra) of the documents taken in part: extra is 1 where the part counts as a whole copy.

    The parts are added up over the source, by size, and a document whose part brings the sum past the next
    half gets the copy. By size, as then the words miss those taken by the source's longest document at most.
    A shard has two such documents at most, so a source has 2 * FINE.
    """
    size = F.nullif(F.col("size"), F.lit(0))
    part = (F.col("taken") % size) / size
    in_order = Window.partitionBy("source").orderBy("size", "shard", "start")
    sums = (laid.where(part > 0).select("source", "shard", "start", "size", part.alias("part"))
            .withColumn("sum", F.floor(F.sum("part").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 0.5)))
    return sums.select("source", "shard", "start", (F.col("sum") - F.coalesce(F.lag("sum").over(in_order), F.lit(0))).alias("extra"))


def mixed_documents(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 17, **settings) -> DataFrame:
    """The mix as rows: a document appears as often as its words were taken, parts rounded over the whole source."""
    packed = df.select(F.struct("*").alias("row"), col(text).alias("text"), col(source).alias("source"), col(id_col).alias("doc_id"))
    sources, quotas = shard_quotas(packed, seed=seed, **settings)
    names, place = ("text", "source", "doc_id"), ("shard", "start")
    # The start tells documents with words of a shard apart, also repeated rows.
    ends = small(stored(rounded_ends(laid_out(packed.select(*names), sources, quotas, *names, seed, place)))).alias("e")
    laid = laid_out(packed, sources, quotas, *names, seed, place).where("taken > 0").alias("d")
    same = F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.shard") == F.col("e.shard")) & (F.col("d.start") == F.col("e.start"))
    copies = F.floor(F.col("d.taken") / F.nullif(F.col("d.size"), F.lit(0))) + F.coalesce("e.extra", F.lit(0))
    return (laid.join(ends, same, "left").select("d.row", copies.cast("int").alias("copies")).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"))
