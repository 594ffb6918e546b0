"""Row-position features over many series: lags, rolling statistics, tails and windows.

A series is the rows that share the key columns, in time order. Features count rows, not
hours. One series may hold a large share of all rows, so no task ever receives a whole
series: rows get their position in the series from month counts, and every frame is
evaluated on chunks of consecutive positions that carry a copy of the neighbouring rows
the frame can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from heliopanel.constants import HORIZON, LAG_MAX, MWH_SCALE, ROLL_MIN_FRACTION, SEQ_LEN
from heliopanel.functions.scale import to_units

CHUNK_ROWS = 2048
NULL_KEY_PARTS = 4096
#: More lag columns than this come from one list a row; a window function each costs far more.
WINDOW_LAGS = 16

Feature = Callable[[WindowSpec], Column]


class Panel:
    """Rows with `pos` (0-based position in their series) and `n` (rows of the series).

    The order is `ts`, then `tiebreak`. Rows with a null in a key belong to no series: their
    position is null and each forms a chunk of its own, so its features see no other row.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], ts: str = "ts",
                 tiebreak: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS):
        self.keys = list(keys)
        self.ts = ts
        self.order = [ts, *tiebreak]
        self.chunk_rows = chunk_rows
        self.rows = self._locate(df)

    def _spread(self) -> Column:
        """Parts for the rows without a series, by content."""
        return -1 - F.pmod(F.xxhash64(*self.order), F.lit(NULL_KEY_PARTS)).cast("int")

    def _locate(self, df: DataFrame) -> DataFrame:
        has_key = F.lit(True)
        for key in self.keys:
            has_key = has_key & F.col(key).isNotNull()
        month = F.coalesce(F.year(self.ts) * 12 + F.month(self.ts), F.lit(2**31 - 1))
        located = df.withColumn("_month", F.when(has_key, month).otherwise(self._spread()))
        by_time = [F.asc_nulls_last(c) for c in self.order]
        local = F.row_number().over(Window.partitionBy(*self.keys, "_month").orderBy(*by_time))
        series = Window.partitionBy(*self.keys)
        earlier = series.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
        # One row per series and month: small, and combined before its shuffle.
        months = (located.filter(has_key).groupBy(*self.keys, "_month").agg(F.count("*").alias("_c"))
                  .select(*self.keys, "_month",
                          F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
                          F.sum("_c").over(series).alias("n")))
        return (located.withColumn("_local", local)
                .join(months, [*self.keys, "_month"], "left")
                .withColumn("pos", F.col("_before") + F.col("_local") - 1)
                .drop("_month", "_local", "_before"))

    def chunks(self, before: int = 0, after: int = 0) -> tuple[DataFrame, int]:
        """Rows with `_chunk` and `_home`, plus copies for the chunks whose frames reach them."""
        size = max(self.chunk_rows, before, after)
        alone = -1 - F.monotonically_increasing_id()
        home = F.coalesce(F.floor(F.col("pos") / size).cast("long"), alone)
        offset = F.col("pos") % size
        parts = [F.col("_home")]
        if before:
            parts.append(F.when(offset >= size - before, F.col("_home") + 1))
        if after:
            parts.append(F.when((offset < after) & (F.col("_home") > 0), F.col("_home") - 1))
        placed = self.rows.withColumn("_home", home)
        if len(parts) == 1:
            return placed.withColumn("_chunk", F.col("_home")), size
        return placed.withColumn("_chunk", F.explode(F.array_compact(F.array(*parts)))), size

    def with_features(self, features: dict[str, Feature], before: int = 0, after: int = 0,
                      prepare: dict[str, Column] | None = None,
                      derive: dict[str, Feature] | None = None,
                      lagged: tuple[str, Sequence[int]] | None = None, ordered: bool = False) -> DataFrame | tuple[DataFrame, list[str]]:
        """Add one column per feature.

        `prepare` columns are computed per row first, `features` over the chunk window,
        and `derive` over the same window from the features, without another shuffle.
        `before` and `after` are the farthest rows any frame reaches. Columns whose name
        starts with "_" are dropped at the end. `lagged` is a column and the steps it lags by,
        as lag_k; a long list of them does not go through window functions. With `ordered` the
        lags are left to the caller, who gets what `in_order` gives.
        """
        target, steps = lagged or ("", ())
        if len(steps) <= WINDOW_LAGS:
            features, steps = {**lags(target, steps), **features}, ()
        chunked, _ = self.chunks(before, after)
        window = Window.partitionBy(*self.keys, "_chunk").orderBy("pos")
        base = chunked.columns
        frame = chunked.select("*", *[c.alias(name) for name, c in (prepare or {}).items()])
        frame = frame.select("*", *[f(window).alias(name) for name, f in features.items()])
        if derive:
            frame = frame.select("*", *[f(window).alias(name) for name, f in derive.items()])
        added = [name for name in [*(prepare or {}), *features, *(derive or {})]
                 if not name.startswith("_")]
        kept = [c for c in base if c not in ("_home", "_chunk")]
        if steps or ordered:
            rows, narrow = self.in_order(frame.select(*kept, *added, "_chunk", "_home"))
            if ordered:
                return rows, narrow
            found = _look_back(rows, narrow, target, max(steps), "_lags")  # one list travels much faster than its columns
            return found.select(*kept, *[F.try_element_at("_lags", F.lit(-k)).alias(c) for c, k in zip(lag_columns(steps), steps)], *added)
        return (frame.filter(F.col("_chunk") == F.col("_home"))
                .select(*kept, *added))

    def in_order(self, chunked: DataFrame) -> tuple[DataFrame, list[str]]:
        """Chunks side by side in order, with `_at` and `_own` as `_look_back` reads them; and the columns to keep."""
        window = Window.partitionBy(*self.keys, "_chunk").orderBy("pos")
        kept = [c for c in chunked.columns if c not in ("_home", "_chunk")]
        placed = chunked.select("*", (F.row_number().over(window) - 1).alias("_at"), (F.col("_chunk") == F.col("_home")).alias("_own"))
        return placed.sortWithinPartitions(*self.keys, "_chunk", "pos").drop("_home", "_chunk"), kept  # as the window has left them


def lag_columns(steps: Sequence[int]) -> list[str]:
    return [f"lag_{k}" for k in steps]


def lags(target: str, steps: Sequence[int]) -> dict[str, Feature]:
    """lag_k: the value k rows earlier."""
    return {name: (lambda w, k=k: F.lag(target, k).over(w)) for name, k in zip(lag_columns(steps), steps)}


def _look_back(rows: DataFrame, kept: Sequence[str], target: str, length: int, name: str) -> DataFrame:
    """The rows marked `_own` with the up to `length` earlier values of their chunk as one list, most recent last.

    Chunks come whole and in order, `_at` is a row's place in its chunk. A task holds one batch and the values before it.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(target) if tail is None else pa.concat_arrays([tail, batch.column(target)])
            own = np.flatnonzero(batch.column("_own").to_numpy(zero_copy_only=False).astype(bool))
            sizes = np.minimum(batch.column("_at").to_numpy(zero_copy_only=False)[own], length)
            ends = np.concatenate([[0], sizes.cumsum()])
            first = len(values) - batch.num_rows + own - sizes
            index = np.arange(ends[-1]) + np.repeat(first - ends[:-1], sizes)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(index)))
            mine = batch.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in kept), lists], [*kept, name])
            tail = values[max(0, len(values) - length):]

    return rows.mapInArrow(cut, StructType([*(rows.schema[c] for c in kept), StructField(name, ArrayType(rows.schema[target].dataType))]))


def lag_vectors(rows: DataFrame, kept: Sequence[str], target: str, names: Sequence[str], name: str, wanted: Column) -> DataFrame:
    """`kept` and one list of the columns `names`, lag_k among them, of the wanted rows marked `_own` whose lags are all there.

    Chunks come whole and in order as for `_look_back`; lists are made of wanted rows only. Other missing values are NaN.
    """
    places = {int(c[4:]): i for i, c in enumerate(names) if c.startswith("lag_")}
    length, others = max(places, default=0), [(i, c) for i, c in enumerate(names) if not c.startswith("lag_")]
    order = np.array([places[k] for k in sorted(places)], np.int64)
    back = np.array([length - k for k in sorted(places)], np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros(0), np.zeros(0, bool)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column("_target")
            values = np.concatenate([tail[0], column.to_numpy(zero_copy_only=False).astype(np.float64)])
            gone = np.concatenate([tail[1], column.is_null().to_numpy(zero_copy_only=False)])
            tail = values[max(0, len(values) - length):], gone[max(0, len(gone) - length):]
            chosen = batch.column("_own").to_numpy(zero_copy_only=False).astype(bool) & (batch.column("_at").to_numpy(zero_copy_only=False) >= length)
            own = np.flatnonzero(chosen)
            at = own + len(values) - n
            missing = np.concatenate([[0], gone.cumsum()])
            if length:
                own = own[np.stack([~gone[at - k] for k in places]).all(axis=0) if len(places) < length else missing[at] == missing[at - length]]
            if not len(own):
                continue
            out = np.empty((len(own), len(names)))
            if length:
                out[:, order] = np.lib.stride_tricks.sliding_window_view(values, length)[own + len(values) - n - length][:, back]
            mine = batch.take(pa.array(own))
            for i, c in others:
                out[:, i] = mine.column(f"_in_{c}").to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * np.int32(len(names))), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in kept), lists], [*kept, name])

    inputs = rows.select(*kept, F.col(target).cast("double").alias("_target"), *[F.col(c).cast("double").alias(f"_in_{c}") for _, c in others],
                         "_at", (F.col("_own") & F.coalesce(wanted, F.lit(False))).alias("_own"))
    return inputs.mapInArrow(cut, StructType([*(rows.schema[c] for c in kept), StructField(name, ArrayType(DoubleType()))]))


def add_lags(panel: Panel, target: str, steps: Sequence[int] = range(1, LAG_MAX + 1)) -> DataFrame:
    return panel.with_features({}, before=max(steps), lagged=(target, steps))


def add_lag_array(panel: Panel, target: str, length: int = LAG_MAX, name: str = "lags") -> DataFrame:
    """The previous `length` values, most recent last, nulls kept, as one array column."""
    rows, kept = panel.in_order(panel.chunks(before=length)[0])
    return _look_back(rows, kept, target, length, name)


class _Running:
    """Running count, sum and sum of squares of whole units, and their differences over n rows.

    A frame of n rows is a difference of two running totals, so its cost does not depend on
    n. The totals are integers, so the difference is exact.
    """

    def __init__(self, target: str, scale: int, inclusive: bool, squares: bool):
        self.scale = scale
        self.squares = squares
        last = 0 if inclusive else -1
        units = to_units(F.col(target), scale)
        self.prepare = {"_u": units}
        if squares:
            self.prepare["_uu"] = units.cast("decimal(19,0)") * units.cast("decimal(19,0)")
        total = {"_tc": F.count("_u"), "_ts": F.sum("_u")}
        if squares:
            total["_tq"] = F.sum("_uu")
        self.features = {
            name: (lambda w, a=a: F.coalesce(a.over(w.rowsBetween(Window.unboundedPreceding, last)), F.lit(0)))
            for name, a in total.items()
        }

    @staticmethod
    def _over(name: str, rows: int, w: WindowSpec) -> Column:
        return F.col(name) - F.coalesce(F.lag(name, rows).over(w), F.lit(0))

    def count(self, rows: int, w: WindowSpec) -> Column:
        return self._over("_tc", rows, w)

    def mean(self, rows: int, least: int, w: WindowSpec) -> Column:
        n = self.count(rows, w)
        total = self._over("_ts", rows, w)
        return F.when(n >= least, total.cast("double") / (n * F.lit(10 ** self.scale)).cast("double"))

    def std(self, rows: int, least: int, w: WindowSpec) -> Column:
        n = self.count(rows, w)
        total = self._over("_ts", rows, w).cast("decimal(19,0)")
        squares = self._over("_tq", rows, w)
        spread = (n.cast("decimal(10,0)") * squares.cast("decimal(27,0)")
                  - total * total).cast("double")
        variance = spread / (n * (n - 1)).cast("double")
        return F.when((n >= least) & (n > 1), F.sqrt(variance) / F.lit(float(10 ** self.scale)))


def add_rolls(panel: Panel, target: str, windows: Sequence[int] = (24, 72, 168),
              min_fraction: float = ROLL_MIN_FRACTION, scale: int = MWH_SCALE,
              lag_steps: Sequence[int] = (), ordered: bool = False) -> DataFrame | tuple[DataFrame, list[str]]:
    """Mean and sample deviation of the previous w rows, null below int(fraction * w) values.

    The current row never enters its own statistics. `lag_steps` adds lag columns in the
    same pass.
    """
    run = _Running(target, scale, inclusive=False, squares=True)
    derive: dict[str, Feature] = {}
    for w_rows in windows:
        least = int(w_rows * min_fraction)
        derive[f"roll_mean_{w_rows}"] = lambda w, r=w_rows, m=least: run.mean(r, m, w)
        derive[f"roll_std_{w_rows}"] = lambda w, r=w_rows, m=least: run.std(r, m, w)
    reach = max([*windows, *lag_steps])
    return panel.with_features(run.features, before=reach, prepare=run.prepare, derive=derive, lagged=(target, () if ordered else lag_steps), ordered=ordered)


def add_rolls_inclusive(panel: Panel, target: str, windows: dict[str, int] | None = None,
                        lag_steps: Sequence[int] = (), scale: int = MWH_SCALE) -> DataFrame:
    """Means over the current and the n-1 previous rows, null unless all n are present."""
    windows = windows or {"lag_24_mean": 24, "roll_mean_6": 6, "roll_mean_12": 12}
    run = _Running(target, scale, inclusive=True, squares=False)
    derive = {name: (lambda w, r=rows: run.mean(r, r, w)) for name, rows in windows.items()}
    reach = max([*windows.values(), *lag_steps])
    return panel.with_features(run.features, before=reach, prepare=run.prepare, derive=derive, lagged=(target, lag_steps))


def add_history_complete(panel: Panel, target: str, rows: int = LAG_MAX,
                         name: str = "history_complete") -> DataFrame:
    """True when all of the previous `rows` values are present."""
    run = _Running(target, MWH_SCALE, inclusive=False, squares=False)
    marked = panel.with_features(run.features, before=rows, prepare=run.prepare,
                                 derive={name: lambda w: run.count(rows, w) == rows})
    return marked.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def history_tail(df: DataFrame, keys: Sequence[str], rows: int = LAG_MAX, ts: str = "ts",
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Last rows of each series; rows with a null key are dropped.

    Spark limits each series before the shuffle, so a long series moves `rows` rows per task.
    Tails too long for that limit are cut by position.
    """
    df = df.na.drop(subset=list(keys))
    if rows > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        located = Panel(df, keys, ts, tiebreak).rows
        return located.filter(F.col("pos") >= F.col("n") - rows).drop("pos", "n")
    latest = [F.desc_nulls_first(c) for c in (ts, *tiebreak)]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest)))
    return ranked.filter(F.col("_rank") <= rows).drop("_rank")


def thinned(index: Column, total: Column, limit: int) -> Column:
    """True for the `limit` indexes that truncated even spacing over 0..total-1 selects."""
    step = (total - 1).cast("double") / F.lit(float(max(1, limit - 1)))
    near = F.round(index / F.when(step > 0, step)).cast("long")
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        k = near + shift
        selected = F.when(k == limit - 1, total - 1).otherwise(F.floor(k.cast("double") * step))
        hit = hit | (k.between(0, limit - 1) & (selected == index))
    return (total <= limit) | F.coalesce(hit if limit > 1 else index == 0, F.lit(False))


def _start_filter(pos: Column, n: Column, length: int, step: int, limit: int | None) -> Column:
    last = n - length
    chosen = (pos % step == 0) & (pos <= last)
    if limit is not None:
        total = F.floor(last / step) + 1
        chosen = chosen & thinned(F.floor(pos / step), total, limit)
    return chosen


def window_starts(panel: Panel, seq_len: int = SEQ_LEN, horizon: int = HORIZON, step: int = 1,
                  limit: int | None = None) -> DataFrame:
    """Rows at which a full window of history and horizon starts."""
    return panel.rows.filter(_start_filter(F.col("pos"), F.col("n"), seq_len + horizon, step, limit))


def window_chunks(panel: Panel, features: Sequence[str], target: str, length: int) -> tuple[DataFrame, int]:
    """Keys, `_chunk`, n and `_rows`: the rows of each chunk and those that its windows of `length` rows reach, in order."""
    chunked, size = panel.chunks(after=length - 1)
    cell = F.struct(F.col("pos").alias("pos"), F.col(panel.ts).alias("ts"),
                    F.struct(*[F.col(c) for c in features]).alias("x"), F.col(target).alias("y"))
    grouped = (chunked.filter(F.col("pos").isNotNull())
               .groupBy(*panel.keys, "_chunk")
               .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(cell)).alias("_rows")))
    return grouped, size


def sequence_windows(panel: Panel, features: Sequence[str], target: str, seq_len: int = SEQ_LEN,
                     horizon: int = HORIZON, step: int = 1, limit: int | None = None) -> DataFrame:
    """One row per start: `x` (seq_len feature structs), `y` (the next `horizon` targets).

    `origin_ts` is the time of the last history row. Each chunk becomes one array of at most
    chunk size + window rows; windows are slices of it, made only for the kept starts.
    """
    length = seq_len + horizon
    grouped, size = window_chunks(panel, features, target, length)
    first = F.col("_chunk") * size
    first_start = F.ceil(first / step) * step
    last_start = F.least(first + size - 1, F.col("n") - length)
    starts = (grouped.filter(first_start <= last_start)
              .withColumn("start", F.explode(F.sequence(first_start, last_start, F.lit(step).cast("long")))))
    if limit is not None:
        starts = starts.filter(_start_filter(F.col("start"), F.col("n"), length, step, limit))
    at = (F.col("start") - first + 1).cast("int")
    history = F.slice("_rows", at, F.lit(seq_len))
    future = F.slice("_rows", at + seq_len, F.lit(horizon))
    return starts.select(
        *panel.keys, "start",
        F.element_at("_rows", at + seq_len - 1).getField("ts").alias("origin_ts"),
        history.getField("x").alias("x"),
        future.getField("y").alias("y"),
    )


def strided_windows(panel: Panel, features: Sequence[str], target: str, seq_len: int = SEQ_LEN,
                    horizon: int = HORIZON) -> DataFrame:
    """Forecast origins every `horizon` rows."""
    return sequence_windows(panel, features, target, seq_len, horizon, step=horizon)
