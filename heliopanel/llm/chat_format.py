"""Chat formatting with Spark expressions only.

Each conversation becomes one string. Its turns are collected as structs and sorted; adjacent turns of
one role are merged into one block, their texts separated by a mark, so the turns can be read back:

    <|im_start|>role NEWLINE text [<|im_sep|>text ...]<|im_end|> NEWLINE

Inside texts and roles a backslash becomes two, and `<|` becomes `<\\|`, so no text can open a mark; in
roles a line break also gets a backslash. Dropping the backslash of every escaped pair restores them.

`loss_runs` is the loss mask: lengths in code points, in turn outside and under the mask, which together
make up the string. Each assistant text lies under the mask, marks and role lines do not.

The string of a conversation is one value, so a conversation has to fit into one row (2 GB). Turns with
a null text or role count as empty ones. Turns sort by number (null first), then role and text, so ties
and repeated rows have a defined order. Rows without a conv_id form one conversation. Other columns are
not used. An empty table gives an empty result. Time grows with the turns of a conversation, not with their square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliopanel.llm.common import col

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, although lambdas inside refer to it."""
    return F.transform(F.array(value), use)[0]


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_runs array<bigint>), one row per conversation."""
    rows = df.select(col(conv).alias("conv_id"), F.struct(
        col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    # The optimizer may put the expression of a column wherever it is named, inside lambdas too: what
    # lambdas look up is bound first.
    def starts(t: Column) -> Column:
        """Positions at which a block of one role starts; each block runs up to the next start."""
        return F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1)["role"] != F.get(t, F.greatest(i - 2, F.lit(0)))["role"]))

    def blocks(t: Column) -> Column:
        return _let(starts(t), lambda s: F.transform(s, lambda i, k: F.slice(t, i, F.coalesce(F.get(s, k + 1), F.size(t) + 1) - i)))

    written = F.transform(_let(F.col("turns"), blocks), lambda b: F.struct(
        b[0]["role"].alias("role"),
        F.concat(F.lit(START), F.replace(escape(b[0]["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n")).alias("head"),
        F.transform(b, lambda t: escape(t["text"])).alias("texts")))

    def long(c: Column) -> Column:
        return F.length(c).cast("long")

    closed, none = F.lit(len(END)).cast("long"), F.lit(0).cast("long")

    def runs(b: Column, j: Column) -> Column:
        """Assistant blocks alternate head, text, separator, text, ...; of other blocks nothing is learned from. The end of a block counts to the next run."""
        before = F.when(j > 0, closed).otherwise(none)
        learned = F.transform(b["texts"], lambda t, k: F.array(F.when(k == 0, before + long(b["head"])).otherwise(F.lit(len(SEPARATOR)).cast("long")), long(t)))
        passed = F.array(before + long(F.concat(b["head"], F.array_join(b["texts"], SEPARATOR))), none)
        return F.when(b["role"] == LOSS_ROLE, F.flatten(learned)).otherwise(passed)

    out = _let(written, lambda bs: F.struct(
        F.array_join(F.transform(bs, lambda b: F.concat(b["head"], F.array_join(b["texts"], SEPARATOR), F.lit(END))), "").alias("formatted"),
        F.concat(F.flatten(F.transform(bs, runs)), F.array(closed)).alias("loss_runs")))
    return turns.select("conv_id", out.alias("out")).select("conv_id", "out.formatted", "out.loss_runs")


def read_pieces(formatted: Column) -> Column:
    """Array of (skip, n, role, raw) of a formatted string: each text as written, its length, and the code points from the one before to it."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b, i: i > 0)
    role = r"(?s)^((?:[^\\\n]++|\\.)*+)\n"

    def pieces(b: Column, j: Column) -> Column:
        def texts(name: Column) -> Column:
            head = F.length(name) + 1
            body = F.substring(b, head + 1, F.length(b) - head - len(END))
            first = F.lit(len(START)) + head + F.when(j > 0, len(END)).otherwise(0)
            return _let(F.struct(unescape(name).alias("role"), first.alias("first")), lambda of: F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t, k: F.struct(
                F.when(k == 0, of["first"]).otherwise(len(SEPARATOR)).cast("long").alias("skip"), F.length(t).cast("long").alias("n"),
                of["role"].alias("role"), t.alias("raw"))))

        return _let(F.regexp_extract(b, role, 1), texts)

    return F.flatten(F.transform(blocks, pieces))


def turns_with_loss(chats: DataFrame) -> DataFrame:
    """(conv_id, k, role, text, learned, formatted_chars), one row per turn read back; `learned` where the text lies under the mask.

    Running sums over the pieces of the string and over the runs of the mask give their places; a
    text is learned from when a run of its length starts where it does. Slices out of the whole
    string, one for each turn, would be quadratic.
    """
    pairs = F.sequence(F.lit(0), F.greatest(F.floor((F.size("loss_runs") - 2) / 2).cast("int"), F.lit(0)))
    runs = _let(F.col("loss_runs"), lambda all_runs: F.transform(pairs, lambda i: F.struct(
        F.coalesce(F.get(all_runs, 2 * i), F.lit(0).cast("long")).alias("skip"), F.coalesce(F.get(all_runs, 2 * i + 1), F.lit(0).cast("long")).alias("n"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("raw"))))
    length = F.length("formatted").cast("long").alias("formatted_chars")
    pieces = (chats.select("conv_id", length, F.array(read_pieces(F.col("formatted")), runs).alias("both"))
              .select("conv_id", "formatted_chars", F.posexplode("both").alias("kind", "rows"))
              .select("conv_id", "formatted_chars", "kind", F.posexplode("rows").alias("k", "r"))
              .select("conv_id", "formatted_chars", "kind", "k", "r.*").repartition("conv_id"))
    order = Window.partitionBy("conv_id", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("at", F.sum(F.col("skip") + F.col("n")).over(order) - F.col("n"))
    learned = F.max("kind").over(Window.partitionBy("conv_id", "at", "n")) == 1
    return (placed.withColumn("learned", learned & (F.col("n") > 0)).where("kind = 0")
            .select("conv_id", "k", "role", unescape(F.col("raw")).alias("text"), "learned", "formatted_chars"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted strings."""
    read = (turns_with_loss(chats).groupBy("conv_id", "formatted_chars")
            .agg(F.array_sort(F.collect_list(F.struct("k", "role", "text", "learned"))).alias("turns")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    return (read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), loss.alias("loss"), "formatted_chars")
            .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"))
