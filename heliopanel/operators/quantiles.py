"""Exact quantiles, medians and modes whose memory stays bounded at any row count."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BAND_ROWS = 100_000
SKETCH_ACCURACY = 10_000
MARGIN = 4.0 / SKETCH_ACCURACY
#: More columns than this are read as one array a row; an aggregate function for each costs far more.
WIDE = 16
POINTS = 1025
MERGED = 16
#: Ranks searched on either side of one, as a share of all, in a first, second and last try.
MARGINS = (8.0 / POINTS, 64.0 / POINTS, 1.0)
KEPT_VALUES = 1 << 20


def doubles_of(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _thinned(points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """POINTS values of each row of `points` at even ranks, each of the same weight."""
    order = points.argsort(axis=1)
    points, weights = np.take_along_axis(points, order, 1), np.take_along_axis(weights, order, 1)
    ranks = weights.cumsum(axis=1)
    total = ranks[:, -1:]
    even = total * (np.arange(POINTS) + 0.5) / POINTS
    at = np.stack([np.searchsorted(r, e) for r, e in zip(ranks, even)]).clip(max=points.shape[1] - 1)
    return np.take_along_axis(points, at, 1), np.broadcast_to(total / POINTS, at.shape)


class RankSketch:
    """POINTS values at even ranks of each column, over any number of batches; NaN does not count."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, x: np.ndarray) -> None:
        """Rows of a batch, [row, column]."""
        x = np.sort(np.ascontiguousarray(x.T), axis=1)  # NaN comes last
        total = x.shape[1] - np.isnan(x).sum(axis=1)[:, None]
        at = (np.ceil(total * (np.arange(POINTS) + 0.5) / POINTS) - 1).astype(np.int64).clip(0)
        self.parts.append((np.take_along_axis(x, at, 1), np.broadcast_to(total / POINTS, at.shape)))
        if len(self.parts) == MERGED:
            self.parts = [self.points()]

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        return self.parts[0] if len(self.parts) == 1 else _thinned(*(np.hstack(x) for x in zip(*self.parts)))


def _value(column: str) -> Column:
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


@dataclass
class _Rank:
    """One wanted order statistic and the closed interval that is searched for it.

    `below` counts the values under `low`; `inside` bounds the values strictly between.
    """

    column: str
    rank: int
    low: float
    high: float
    inside: float
    below: int | None = None
    margin: float = MARGIN
    value: float | None = None


def quantiles_exact(df: DataFrame, wanted: dict[str, tuple[str, float]],
                    band_rows: int = BAND_ROWS) -> dict[str, float | None]:
    """Linearly interpolated quantiles {name: (column, q)}; null and NaN are ignored.

    The built-in exact aggregate buffers every distinct value of the table. Here a sketch
    brackets each wanted rank and a second pass counts the values inside the brackets, so a
    result takes two passes over all columns together. Brackets that would still hold more
    than `band_rows` values are narrowed first, and a bracket that missed its rank is widened.
    """
    if not wanted:
        return {}
    names = list(wanted)
    columns = sorted({column for column, _ in wanted.values()})
    if len(columns) > WIDE:
        return _quantiles_of_many(df, wanted, columns)
    counts = [F.count(_value(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    brackets = [F.percentile_approx(_value(wanted[name][0]), _around(wanted[name][1], MARGIN),
                                    SKETCH_ACCURACY).alias(f"s{i}") for i, name in enumerate(names)]
    first = df.agg(*counts, *brackets).first()
    rows = {c: first[f"n{i}"] for i, c in enumerate(columns)}

    ranks: dict[tuple[str, int], _Rank] = {}
    for i, name in enumerate(names):
        column, q = wanted[name]
        if rows[column]:
            low, high = first[f"s{i}"]
            for k in _neighbours(q, rows[column]):
                ranks[column, k] = _Rank(column, k, low, high, rows[column] * 4 * MARGIN)
    _select(df, rows, list(ranks.values()), band_rows)

    result: dict[str, float | None] = {}
    for name, (column, q) in wanted.items():
        if not rows[column]:
            result[name] = None
            continue
        position = q * (rows[column] - 1)
        lower, upper = _neighbours(q, rows[column])
        low, high = ranks[column, lower].value, ranks[column, upper].value
        result[name] = low if lower == upper else (upper - position) * low + (position - lower) * high
    return result


def _bracket(points: np.ndarray, ranks: np.ndarray, goal: float, margin: float) -> tuple[float, float]:
    """Values that should enclose rank `goal` and the next one; all of them for a margin of one."""
    if margin >= 1:
        return -math.inf, math.inf
    reach = margin * ranks[-1] + 2
    low, high = np.searchsorted(ranks, [goal - reach, goal + reach])
    return (float(points[low - 1]) if low else -math.inf), (float(points[high]) if high < len(points) else math.inf)


def _quantiles_of_many(df: DataFrame, wanted: dict[str, tuple[str, float]], columns: list[str]) -> dict[str, float | None]:
    """`quantiles_exact` by whole Arrow batches: one pass brackets all ranks, a second counts what is below a bracket and
    reads the values inside, a small share of all. A bracket that missed its rank is widened."""
    cells = df.select(F.array(*[_value(c) for c in columns]).alias("v"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = RankSketch(), np.zeros(len(columns), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = doubles_of(batch.column(0)).reshape(batch.num_rows, -1)
                found.add(x)
                n += (~np.isnan(x)).sum(axis=0)
        if found.parts:
            points, weights = found.points()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(columns)), pa.int32()), pa.array(list(points), pa.list_(pa.float64())), pa.array(weights[:, 0]), pa.array(n)], ["c", "points", "w", "n"])

    shares = {c: sorted({q for column, q in wanted.values() if column == c}) for c in columns}

    def enclose(group: pa.Table) -> pa.Table:
        c, n = group.column("c")[0].as_py(), int(group.column("n").to_numpy().sum())
        points = np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in group.column("points")])
        weights = np.repeat(group.column("w").to_numpy(), POINTS)
        known = ~np.isnan(points)
        points, weights = points[known], weights[known]
        order = points.argsort(kind="stable")
        points, ranks = points[order], weights[order].cumsum()
        found = [(c, q, n, *(x for m in MARGINS for x in _bracket(points, ranks, q * (n - 1), m))) for q in shares[columns[c]] if n]
        names = ["c", "q", "n", "low0", "high0", "low1", "high1", "low2", "high2"]
        return pa.table({k: pa.array([row[i] for row in found], pa.int32() if k == "c" else pa.int64() if k == "n" else pa.float64()) for i, k in enumerate(names)})

    first = (cells.mapInArrow(sketch, "c int, points array<double>, w double, n long").groupBy("c")
             .applyInArrow(enclose, "c int, q double, n long, low0 double, high0 double, low1 double, high1 double, low2 double, high2 double").collect())
    values: dict[tuple[int, float], list[float]] = {}
    for i in range(len(MARGINS)):
        pending = [(r.c, r.q, r.n, r[f"low{i}"], r[f"high{i}"]) for r in first if (r.c, r.q) not in values]
        if pending:
            values |= _inside(cells, pending)
    result: dict[str, float | None] = {}
    rows = {(r.c, r.q): r.n for r in first}
    for name, (column, q) in wanted.items():
        key = columns.index(column), q
        result[name] = None
        if key in rows:
            position = q * (rows[key] - 1)
            lower, upper = _neighbours(q, rows[key])
            low, high = values[key]
            result[name] = low if lower == upper else (upper - position) * low + (position - lower) * high
    return result


def _inside(cells: DataFrame, pending: list[tuple[int, float, int, float, float]]) -> dict[tuple[int, float], list[float]]:
    """The two values about the rank of each (column, share, number, low, high) that its bracket holds."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, inside, kept = np.zeros(len(pending), np.int64), [[] for _ in pending], 0

        def rows() -> pa.RecordBatch:
            found = [np.unique(np.concatenate(v), return_counts=True) if v else (np.zeros(0), np.zeros(0, np.int64)) for v in inside]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(pending)), pa.int32()), pa.array(below), pa.array([v for v, _ in found], pa.list_(pa.float64())),
                                               pa.array([n for _, n in found], pa.list_(pa.int64()))], ["i", "below", "v", "n"])

        for batch in batches:
            if batch.num_rows:
                columns = np.ascontiguousarray(doubles_of(batch.column(0)).reshape(batch.num_rows, -1).T)
                for i, (c, _, _, low, high) in enumerate(pending):
                    x = columns[c]
                    below[i] += np.count_nonzero(x < low)
                    if len(own := x[(x >= low) & (x <= high)]):
                        inside[i].append(own)
                        kept += len(own)
                if kept > KEPT_VALUES:
                    yield rows()
                    below[:], inside, kept = 0, [[] for _ in pending], 0
        yield rows()

    def pick(group: pa.Table) -> pa.Table:
        i = group.column("i")[0].as_py()
        _, q, n, _, _ = pending[i]
        below = int(group.column("below").to_numpy().sum())
        v, counts = (np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in group.column(c)]) for c in ("v", "n"))
        order = v.argsort()
        upto = below + counts[order].cumsum()
        goals = np.array(_neighbours(q, n))
        held = len(v) > 0 and below <= goals[0] and goals[1] < upto[-1]
        pair = v[order][np.searchsorted(upto, goals, side="right")].tolist() if held else None
        return pa.table({"i": pa.array([i], pa.int32()), "pair": pa.array([pair], pa.list_(pa.float64()))})

    found = cells.mapInArrow(read, "i int, below long, v array<double>, n array<long>").groupBy("i").applyInArrow(pick, "i int, pair array<double>").collect()
    return {pending[r.i][:2]: r.pair for r in found if r.pair is not None}


def _around(share: float, margin: float) -> list[float]:
    return [max(0.0, share - margin), min(1.0, share + margin)]


def _neighbours(q: float, rows: int) -> tuple[int, int]:
    position = q * (rows - 1)
    return math.floor(position), math.ceil(position)


def _select(df: DataFrame, rows: dict[str, int], ranks: list[_Rank], band_rows: int) -> None:
    """Find the value of every rank, narrowing or widening brackets until each one is settled."""
    while pending := [r for r in ranks if r.value is None]:
        wide = [r for r in pending if r.inside > band_rows]
        if wide:
            _narrow(df, wide)
            continue
        missed = _read_brackets(df, pending)
        if missed:
            for r in missed:
                r.margin = min(1.0, r.margin * 8)
            again = df.agg(*[
                F.percentile_approx(_value(r.column), _around(r.rank / max(1, rows[r.column] - 1), r.margin),
                                    SKETCH_ACCURACY).alias(f"s{i}") for i, r in enumerate(missed)]).first()
            for i, r in enumerate(missed):
                r.low, r.high = again[f"s{i}"]
                r.inside, r.below = rows[r.column] * 4 * r.margin, None


def _narrow(df: DataFrame, wide: list[_Rank]) -> None:
    """Count each bracket exactly and sketch a shorter one inside it, in one pass."""
    aggregates = []
    for i, r in enumerate(wide):
        v = _value(r.column)
        aggregates += [F.count_if(v < r.low).alias(f"b{i}"), F.count_if(v == r.low).alias(f"l{i}"),
                       F.count_if((v > r.low) & (v < r.high)).alias(f"m{i}"),
                       F.count_if((v == r.high) & (v > r.low)).alias(f"h{i}")]
    seen = df.agg(*aggregates).first()
    sketched = []
    for i, r in enumerate(wide):
        r.below = seen[f"b{i}"]
        offset = r.rank - r.below
        at_low, middle, at_high = seen[f"l{i}"], seen[f"m{i}"], seen[f"h{i}"]
        r.inside = middle
        if offset < 0 or offset >= at_low + middle + at_high:
            r.inside = 0.0  # not bracketed: reading the bracket reports the miss
            r.low, r.high = math.inf, -math.inf
        elif offset < at_low:
            r.value = r.low
        elif offset >= at_low + middle:
            r.value = r.high
        elif middle > 0:
            sketched.append((r, (offset - at_low) / max(1, middle - 1)))
    if not sketched:
        return
    inner = [F.when((_value(r.column) > r.low) & (_value(r.column) < r.high), _value(r.column)) for r, _ in sketched]
    bounds = df.agg(*[F.percentile_approx(v, _around(share, _inner(r)), SKETCH_ACCURACY).alias(f"s{i}")
                      for i, (v, (r, share)) in enumerate(zip(inner, sketched))]).first()
    for i, (r, _) in enumerate(sketched):
        r.low, r.high = bounds[f"s{i}"]
        r.inside *= 4 * _inner(r)


def _inner(r: _Rank) -> float:
    """Margin inside a bracket: short enough to make progress."""
    return min(r.margin, 0.2)


def _read_brackets(df: DataFrame, pending: list[_Rank]) -> list[_Rank]:
    """Settle the ranks whose brackets are short; returns those whose bracket missed.

    Values under a bracket share one counter, values above it are dropped, and both happen
    before the shuffle.
    """
    brackets: dict[tuple[str, float, float], list[_Rank]] = {}
    for r in pending:
        brackets.setdefault((r.column, r.low, r.high), []).append(r)
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), _value(c).alias("v"), F.lit(low).alias("low"), F.lit(high).alias("high"))
        for i, (c, low, high) in enumerate(brackets)
    ])
    cells = F.transform(F.filter(cells, lambda x: x["v"] <= x["high"]),
                        lambda x: F.struct(x["i"].alias("i"), F.when(x["v"] >= x["low"], x["v"]).alias("v")))
    goals = F.array(*[F.array(*[F.lit(r.rank) for r in ranks]) for ranks in brackets.values()])
    counted = df.select(F.inline(cells)).groupBy("i", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("i").orderBy(F.asc_nulls_first("v")))
    found = (counted.select("i", "v", upto.alias("upto"))
             .select("i", "v", "upto", F.explode(F.element_at(goals, F.col("i") + 1)).alias("goal"))
             .filter(F.col("upto") > F.col("goal"))
             .groupBy("i", "goal").agg(F.min_by("v", "upto").alias("v")).collect())
    values = {(row["i"], row["goal"]): row["v"] for row in found}
    for i, ranks in enumerate(brackets.values()):
        for r in ranks:
            r.value = values.get((i, r.rank))
    return [r for r in pending if r.value is None]


def quantile_exact(df: DataFrame, column: str, q: float) -> float | None:
    return quantiles_exact(df, {"q": (column, q)})["q"]


def median_impute_fit(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return quantiles_exact(df, {c: (c, 0.5) for c in columns})


def most_frequent(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Most frequent non-null value per key, the smallest value on ties.

    Counting value by value first keeps hot keys cheap: they are combined before the shuffle.
    """
    counted = df.groupBy(*keys, column).agg(F.count("*").alias("_c"))
    order = F.when(F.col(column).isNotNull(), F.struct(-F.col("_c"), F.col(column)))
    return counted.groupBy(*keys).agg(F.min_by(F.col(column), order).alias(name))


def mode_impute_fit(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent text value of each column, the smallest on ties."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v"))
                      for i, c in enumerate(columns)])
    counted = (df.select(F.inline(cells)).filter(F.col("v").isNotNull())
               .groupBy("i", "v").agg(F.count("*").alias("c")))
    best = counted.groupBy("i").agg(F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("v"))
    found = {row["i"]: row["v"] for row in best.collect()}
    return {c: found.get(i) for i, c in enumerate(columns)}


def scale_summary(df: DataFrame, column: str) -> DataFrame:
    """Minimum, median and maximum of the finite values, one row."""
    from heliopanel.functions.scale import null_non_finite

    finite = df.select(null_non_finite(F.col(column)).alias("v"))
    median = quantile_exact(finite, "v", 0.5)
    return finite.agg(F.min("v").alias("min"), F.lit(median).cast("double").alias("q50"),
                      F.max("v").alias("max"))
