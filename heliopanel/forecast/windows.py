"""Direct forecasts of all steps from flattened histories, fitted from cross-products.

A window is `seq_len` values and the `horizon` values behind them. Windows overlap, so their cross-products are
lagged products of the series: a task takes chunks of consecutive rows and gets the product of window places i and j, for
all windows of a run, as a difference of two running totals of v[p] v[p + j - i]; no window is ever laid out.
Values are whole units of 10^-4 on the log scale, so these sums are exact. They are added with one aggregate, and
the driver solves seq_len + 3 unknowns for each step.

Missing history counts as 0; a window with a missing target does not fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType, TimestampNTZType

from heliopanel import constants as K
from heliopanel.functions.scale import log_target, to_units
from heliopanel.operators.panel import Panel, window_chunks
from heliopanel.session import literal_rows, shared_folder

LOG_SCALE = 4
UNIT = 10.0 ** LOG_SCALE
EXTRAS = ("one", "hour_sin", "hour_cos")


@dataclass
class Windows:
    """Chunks of the series of a table, and which windows are meant: origins from `since` on and before `until` (microseconds)."""

    chunks: DataFrame
    keys: list[str]
    size: int
    seq_len: int
    horizon: int
    since: int | None = None
    until: int | None = None

    def __getstate__(self) -> dict:
        """Tasks get the shape of the windows, not the table."""
        return {**vars(self), "chunks": None}

    @staticmethod
    def of(df: DataFrame, target: str = "mwh", keys: Sequence[str] = ("plant",), seq_len: int = K.SEQ_LEN, horizon: int = K.HORIZON,
           tiebreak: Sequence[str] = ()) -> Windows:
        grouped, size = window_chunks(Panel(df, keys, tiebreak=tiebreak), [target], target, seq_len + horizon)
        logged = F.transform("_rows", lambda r: F.coalesce(to_units(log_target(r["y"]), LOG_SCALE), F.lit(-1)))
        chunks = grouped.select(F.struct(*keys).alias("key"), (F.col("_chunk") * size).alias("first"), "n", logged.alias("v"),
                                F.transform("_rows", lambda r: F.unix_micros(r["ts"].cast("timestamp"))).alias("at"), F.transform("_rows", lambda r: r["y"]).alias("y"))
        return Windows(chunks, list(keys), size, seq_len, horizon)

    def stored(self) -> Windows:
        """With the chunks written to the shared folder, for several passes."""
        path = shared_folder(self.chunks.sparkSession)
        self.chunks.write.parquet(path)
        return replace(self, chunks=self.chunks.sparkSession.read.schema(self.chunks.schema).parquet(path))

    def between(self, since: str | None = None, until: str | None = None) -> Windows:
        micros = [None if day is None else int(np.datetime64(day, "us").astype(np.int64)) for day in (since, until)]
        return replace(self, since=micros[0], until=micros[1])

    @property
    def length(self) -> int:
        return self.seq_len + self.horizon

    def starts(self, first: int, n: int, at: np.ndarray) -> np.ndarray:
        """Offsets in the chunk at which a window starts."""
        starts = np.arange(max(0, min(self.size, n - self.length - first + 1)))
        origin = at[starts + self.seq_len - 1]
        keep = np.ones(len(starts), bool)
        if self.since is not None:
            keep &= origin >= self.since
        if self.until is not None:
            keep &= origin < self.until
        return starts[keep]

    def each(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Batch, row, starts, log units, origin times of the starts, missing flags of every chunk with windows."""
        for batch in batches:
            for i in range(batch.num_rows):
                first, n = (batch.column(c)[i].as_py() for c in ("first", "n"))
                v, at = (batch.column(c)[i].values.to_numpy() for c in ("v", "at"))
                starts = self.starts(first, n, at)
                if len(starts):
                    yield batch, i, starts, np.maximum(v, 0), at[starts + self.seq_len - 1], v < 0


def runs(starts: np.ndarray, missing: np.ndarray, seq_len: int, horizon: int) -> Iterator[tuple[int, int]]:
    """Longest ranges of consecutive starts whose targets are all there."""
    gone = np.concatenate([[0], missing.cumsum()])
    good = starts[gone[starts + seq_len + horizon] == gone[starts + seq_len]]
    for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1):
        if len(run):
            yield int(run[0]), int(run[-1]) + 1


def extras_of(origin: np.ndarray) -> np.ndarray:
    angle = (origin // 3_600_000_000 % 24) * (2 * np.pi / 24)
    return np.column_stack([np.ones(len(origin)), np.sin(angle), np.cos(angle)])


def lagged_products(u: np.ndarray, m: int, length: int) -> np.ndarray:
    """Sums over m consecutive windows of the product of places i <= j, exact for whole numbers."""
    out = np.zeros((length, length), np.int64)
    out[0] = np.correlate(u[:m + length - 1], u[:m], "valid")
    # One place on in both, the sum gains the product behind the last window and loses the first.
    change = np.outer(u[m:m + length - 1], u[m:m + length - 1]) - np.outer(u[:length - 1], u[:length - 1])
    for i in range(1, length):
        out[i, i:] = out[i - 1, i - 1:-1] + change[i - 1, i - 1:]
    return out


def cross_products(windows: Windows) -> DataFrame:
    """(i, j, units, loose): for places i <= j of a window the exact sum of products of log units; places from `length` on are
    the extras, whose products are in `loose`."""
    length = windows.length

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, loose, bound = np.zeros((length, length), np.int64), np.zeros((length + 3, 3)), 0
        for _, _, starts, v, origin, missing in windows.each(batches):
            place = {int(s): k for k, s in enumerate(starts)}
            for low, high in runs(starts, missing, windows.seq_len, windows.horizon):
                u, m = v[low:high + length - 1], high - low
                most = m * (int(u.max()) ** 2 + 1)
                if bound + most >= 1 << 62:
                    yield rows(exact, loose)
                    exact[:], loose[:], bound = 0, 0, 0
                bound += most
                exact += lagged_products(u, m, length)
                extra = extras_of(origin[place[low]:place[low] + m])
                for e in range(3):
                    loose[:length, e] += np.correlate(u.astype(np.float64), extra[:, e], "valid")
                loose[length:] += extra.T @ extra
        yield rows(exact, loose)

    def rows(exact: np.ndarray, loose: np.ndarray) -> pa.RecordBatch:
        i, j = np.triu_indices(length)
        a, b = (x.ravel() for x in np.indices(loose.shape))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, a]), pa.int32()), pa.array(np.concatenate([j, b + length]), pa.int32()),
                                           pa.array(np.concatenate([exact[i, j], np.zeros(loose.size, np.int64)])), pa.array(np.concatenate([np.zeros(len(i)), loose.ravel()]))],
                                          ["i", "j", "units", "loose"])

    parts = windows.chunks.mapInArrow(add, "i int, j int, units long, loose double")
    return parts.groupBy("i", "j").agg(F.sum(F.col("units").cast("decimal(38,0)")).alias("units"), F.sum("loose").alias("loose"))


@dataclass
class StepModel:
    """Coefficients [seq_len values on the log scale, then extras; step], and the sums they come from."""

    coefficients: np.ndarray
    gram: np.ndarray
    moments: np.ndarray
    n: int


def solved(gram: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """Least squares from sums, each unknown scaled to one first."""
    size = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    return np.linalg.lstsq(gram / np.outer(size, size), moments / size[:, None], rcond=1e-13)[0] / size[:, None]


def fit_steps(windows: Windows) -> StepModel:
    """One least-squares model for each step from all windows."""
    length, n_seq = windows.length, windows.seq_len
    cells = cross_products(windows).collect()  # (length + 3) ** 2 numbers at most
    whole = np.zeros((length + 3, length + 3))
    for i, j, units, loose in cells:
        whole[i, j] = int(units) / UNIT ** 2 if j < length else loose / (UNIT if i < length else 1.0)
    whole = np.triu(whole) + np.triu(whole, 1).T
    order = [*range(n_seq), *range(length, length + 3)]
    gram, moments = whole[np.ix_(order, order)], whole[np.ix_(order, range(n_seq, length))]
    return StepModel(solved(gram, moments), gram, moments, int(whole[length, length]))


def _designs(windows: Windows, v: np.ndarray, starts: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """One row a window: values on the log scale and extras; a chunk of them at a time."""
    view = np.lib.stride_tricks.sliding_window_view(v, windows.seq_len)[starts]
    return np.hstack([view / UNIT, extras_of(origin)])


def score_steps(model: StepModel, windows: Windows) -> DataFrame:
    """Keys, start, origin_ts, h, y_true, y_pred and y_before (one horizon earlier: persistence) of all windows and steps."""
    coefficients, n_seq, horizon = model.coefficients, windows.seq_len, windows.horizon
    schema = StructType([windows.chunks.schema["key"], StructField("start", LongType()), StructField("origin_ts", TimestampNTZType()),
                         *(StructField(c, ArrayType(DoubleType())) for c in ("y", "p", "d"))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, starts, v, origin, _ in windows.each(batches):
            p = np.maximum(np.expm1(_designs(windows, v, starts, origin) @ coefficients), 0.0)
            y = batch.column("y")[i].values
            future = (starts[:, None] + n_seq + np.arange(horizon)).ravel()
            before = future - min(horizon, n_seq)
            ends = pa.array(np.arange(len(starts) + 1) * horizon, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(np.full(len(starts), i))), pa.array(starts + batch.column("first")[i].as_py()), pa.array(origin, pa.timestamp("us")),
                                              pa.ListArray.from_arrays(ends, y.take(pa.array(future))), pa.ListArray.from_arrays(ends, pa.array(p.ravel())),
                                              pa.ListArray.from_arrays(ends, y.take(pa.array(before)))],
                                             ["key", "start", "origin_ts", "y", "p", "d"])

    steps = windows.chunks.mapInArrow(score, schema).select("key.*", "start", "origin_ts", F.posexplode(F.arrays_zip("y", "p", "d")).alias("i", "c"))
    return steps.select(*windows.keys, "start", "origin_ts", (F.col("i") + 1).alias("h"), F.col("c.y").alias("y_true"), F.col("c.p").alias("y_pred"),
                        F.col("c.d").alias("y_before"))


def peak_weights(horizon: int, peak: tuple[int, int] = K.PEAK_HORIZONS, weight: float = K.PEAK_WEIGHT) -> np.ndarray:
    place = np.arange(horizon)
    return np.where((place >= peak[0]) & (place < peak[1]), weight, 1.0)


def _mixed_pass(windows: Windows, coefficients: np.ndarray, weights: np.ndarray, delta: float) -> tuple[float, float, int, np.ndarray]:
    """Weighted squares, Huber losses and number of all errors; and by step the sums (1 - delta / |e|) z [z, y] of errors beyond delta."""
    width = len(coefficients)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beyond = np.zeros((windows.horizon, width, width + 1))
        squares, hubers, count = 0.0, 0.0, 0
        for _, _, starts, v, origin, missing in windows.each(batches):
            gone = np.concatenate([[0], missing.cumsum()])
            good = gone[starts + windows.length] == gone[starts + windows.seq_len]
            if not good.any():
                continue
            starts, origin = starts[good], origin[good]
            z = _designs(windows, v, starts, origin)
            y = v[starts[:, None] + windows.seq_len + np.arange(windows.horizon)] / UNIT
            e = z @ coefficients - y
            size = np.abs(e)
            squares += float((e * e).sum(axis=0) @ weights)
            hubers += float(np.where(size < delta, e * e / (2 * delta), size - delta / 2).sum())
            count += e.size
            for h in range(windows.horizon):
                far = np.flatnonzero(size[:, h] > delta)
                if len(far):
                    scaled = z[far] * (1 - delta / size[far, h])[:, None]
                    beyond[h] += scaled.T @ np.column_stack([z[far], y[far, h]])
        flat = np.vstack([beyond.reshape(-1, width + 1), np.array([[squares, hubers, count] + [0.0] * (width - 2)])])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(list(flat), pa.list_(pa.float64()))], ["place", "cells"])

    parts = windows.chunks.mapInArrow(step, "place int, cells array<double>")
    found = parts.groupBy("place").agg(Summarizer.sum(array_to_vector("cells")).alias("v")).select("place", vector_to_array("v").alias("v")).collect()
    flat = np.zeros((windows.horizon * width + 1, width + 1))
    for place, cells in found:
        flat[place] = cells
    return flat[-1, 0], flat[-1, 1], int(flat[-1, 2]), flat[:-1].reshape(windows.horizon, width, width + 1)


def fit_mixed_loss(windows: Windows, share: float = 0.7, delta: float = 1.0, weights: np.ndarray | None = None, rounds: int = 50,
                   tolerance: float = 1e-9) -> tuple[StepModel, list[float]]:
    """Minimises share * sqrt(mean(weight e^2)) + (1 - share) * mean(Huber(e)) over all windows and steps.

    Reweighted least squares: each round bounds both terms by squares that touch them at the current errors. Errors
    within delta keep the weight of the sums already there, so a round only adds up those beyond. Returns the
    model and the loss before each round and at the end.
    """
    model = fit_steps(windows)
    weights = peak_weights(windows.horizon) if weights is None else weights
    losses: list[float] = []
    for _ in range(rounds):
        squares, hubers, count, beyond = _mixed_pass(windows, model.coefficients, weights, delta)
        if not count:
            break
        root = max(np.sqrt(squares / count), 1e-12)
        losses.append(share * root + (1 - share) * hubers / count)
        if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * losses[-1]:
            break
        steps = []
        for h, weight in enumerate(weights):
            whole = share * weight / root + (1 - share) / delta
            rest = (1 - share) / delta * beyond[h]
            steps.append(solved(whole * model.gram - rest[:, :-1], whole * model.moments[:, h:h + 1] - rest[:, -1:])[:, 0])
        model = StepModel(np.column_stack(steps), model.gram, model.moments, model.n)
    return model, losses


def first_histories(windows: Windows, n: int) -> np.ndarray:
    """Log values of the first n windows by keys and start."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, starts, v, _, _ in windows.each(batches):
            starts = starts[:n]
            view = np.lib.stride_tricks.sliding_window_view(v, windows.seq_len)[starts] / UNIT
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(np.full(len(starts), i))), pa.array(starts + batch.column("first")[i].as_py()),
                                              pa.array(list(view), pa.list_(pa.float64()))], ["key", "start", "x"])

    schema = StructType([windows.chunks.schema["key"], StructField("start", LongType()), StructField("x", ArrayType(DoubleType()))])
    rows = windows.chunks.mapInArrow(take, schema).orderBy("key", "start").limit(n).collect()
    return np.array([r.x for r in rows], np.float64).reshape(len(rows), windows.seq_len)


def step_contributions(model: StepModel, windows: Windows, background: np.ndarray) -> DataFrame:
    """(h, step, contribution): mean absolute contribution of each time step of the history to each forecast step.

    A coefficient times the distance of a value from its background mean is the exact contribution; the mean over windows of
    the absolute distance is one number a time step, added up chunk by chunk.
    """
    middle = background.mean(axis=0)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(windows.seq_len), 0
        for _, _, starts, v, _, _ in windows.each(batches):
            view = np.lib.stride_tricks.sliding_window_view(v, windows.seq_len)[starts]
            total += np.abs(view / UNIT - middle).sum(axis=0)
            n += len(starts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(windows.seq_len), pa.int32()), pa.array(total), pa.array(np.full(windows.seq_len, n))], ["i", "s", "n"])

    sums = windows.chunks.mapInArrow(step, "i int, s double, n long").groupBy("i").agg((F.try_divide(F.sum("s"), F.sum("n"))).alias("mean"))
    slopes = literal_rows(windows.chunks.sparkSession, [(i, h + 1, float(abs(model.coefficients[i, h]))) for i in range(windows.seq_len) for h in range(windows.horizon)],
                          "i int, h int, slope double")
    return sums.join(slopes, "i").select("h", (F.col("i") - windows.seq_len).alias("step"), (F.col("slope") * F.col("mean")).alias("contribution"))
