"""Connected components: of a table of links, and of the links that one task has found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliopanel.llm.common import TASK_ROWS, stored

#: Links that a task contracts at once.
LINKS = 1 << 20


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row number that each row reaches over the pairs."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, root[i], low)
        np.minimum.at(after, root[j], low)
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    return root


def contracted(links: DataFrame, most: int = LINKS) -> DataFrame:
    """(u, v) with v < u: what a task's links (u, v) connect, as one link of each node to the smallest that it reaches.

    A task holds about `most` of them at once and returns no more than it has read.
    """

    def forest(pairs: list[np.ndarray]) -> np.ndarray:
        nodes, place = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
        root = roots(len(nodes), *place.reshape(2, -1))
        inner = np.flatnonzero(root != np.arange(len(nodes)))
        return np.stack([nodes[inner], nodes[root[inner]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [np.zeros((2, 0), np.int64)], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in ("u", "v")]))
            n += batch.num_rows
            if n > most:
                held = [forest(held)]
                n = held[0].shape[1]
                if n > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])
                    held, n = [np.zeros((2, 0), np.int64)], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(held)], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def spread(links: DataFrame, rows: int | None) -> DataFrame:
    """All links (u, v) of a u in one task; few tasks for few links."""
    dealt = links.repartition("u")
    return dealt if rows is None else dealt.coalesce(rows // TASK_ROWS + 1)


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component), component the smallest node; nodes without links do not appear.

    Each round hands every link from a node to the smallest that this one is linked to (large star), then brings the
    links of a node into one task, which contracts all it has (small star and more), until each component is one
    star. One sum by node tells whether it is, and is the result. The links never leave the cluster; rounds grow with
    the logarithm of the longest chain. A round's result is written to the shared folder. `rows` is about the number
    of links, where it is known.
    """
    linked = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    edges = stored(contracted(spread(linked, rows)))
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.col("v").alias("to"))))
    while True:
        found = edges.select(ends.alias("e")).groupBy("e.node").agg(F.min("e.to").alias("component"), F.max("e.to").alias("most"))
        rows = edges.count()
        if not found.where("component < most").coalesce(rows // TASK_ROWS + 1).count():
            return found.select("node", "component")
        jumped = edges.join(found.select(F.col("node").alias("v"), "component"), "v").select("u", F.col("component").alias("v"))
        edges = stored(contracted(spread(jumped, rows)))
