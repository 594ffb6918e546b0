"""Near duplicates among embeddings, by int8 tiles with error bounds.

Vectors are compared within equal labels. Equal vectors are first reduced to one with a count, so large
groups of copies cost nothing. A label's vectors are dealt over blocks of about `block` vectors, so a label
of any size is spread; each pair of blocks is one task. In it every vector x, scaled to length one, is
s * q + e with q of int8. The product of two vectors differs from s s' (q . q') by at most
|sq| |e'| + |e| |s'q'| + |e| |e'|; where the product plus this bound reaches the threshold, and only there,
the cosine is computed in double precision. A task returns, for each of its vectors, its number of links and the
smallest vector that it reaches inside the task: no more rows than it has read, however many links there
are. Comparing all pairs of a label is what the contract asks for; it grows with the square of a label's distinct vectors.

Vectors that are null, zero, hold null or non-finite components, or have no label or no identifier link
with nothing. Vectors of different lengths do not link. Repeated rows are further vectors; rows that share
an identifier belong to one component. An empty table gives an empty result. Columns of the input named
like an output column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliopanel.llm.common import col, fresh, stored, without
from heliopanel.llm.graph import components, roots

OUTPUT = ("n_links", "component_id", "kept")
STRIP = 256
EXACT_PAIRS = 65_536


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, length of the quantised vector, length of the error, for rows of length one."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs: between x and y, or inside x (i < j) where y is None."""
    lengths_x = np.linalg.norm(x, axis=1)
    qx, sx, ax, ex = quantised(x / lengths_x[:, None])
    inside = y is None
    y = x if inside else y
    lengths_y = lengths_x if inside else np.linalg.norm(y, axis=1)
    qy, sy, ay, ey = (qx, sx, ax, ex) if inside else quantised(y / lengths_y[:, None])
    # Products of int8 values add up to less than 2 ** 24 for up to 1,000 components, so float32 holds them exactly.
    kind = np.float32 if x.shape[1] <= 1000 else np.float64
    right = qy.astype(kind).T
    left_out, right_out = [], []
    for low in range(0, len(x), STRIP):
        high = min(low + STRIP, len(x))
        product = (qx[low:high].astype(kind) @ right).astype(np.float64)
        bound = np.outer(ax[low:high], ey) + np.outer(ex[low:high], ay + ey)
        i, j = np.nonzero(product * sx[low:high, None] * sy + bound >= threshold - 1e-9)
        i += low
        if inside:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), EXACT_PAIRS):
            a, b = i[k:k + EXACT_PAIRS], j[k:k + EXACT_PAIRS]
            cosine = np.einsum("ij,ij->i", x[a], y[b]) / (lengths_x[a] * lengths_y[b])
            left_out.append(a[cosine >= threshold])
            right_out.append(b[cosine >= threshold])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left_out]), np.concatenate([none, *right_out])


def embedding_links(vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    """From (label, dims, node, copies, vector): rows (node, links, root) of each tile."""
    sizes = vectors.groupBy("label", "dims").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = vectors.join(sizes, ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dims", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "vector")

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("node", kind="stable")
        x = np.array(tile["vector"].tolist(), np.float64)
        own, copies = tile["own"].to_numpy(), tile["copies"].to_numpy()
        first, second = np.flatnonzero(own == tile["i"].iloc[0]), np.flatnonzero(own == tile["j"].iloc[0])
        if tile["i"].iloc[0] == tile["j"].iloc[0]:
            i, j = tile_links(x, None, threshold)
        elif len(first) and len(second):
            i, j = tile_links(x[first], x[second], threshold)
            i, j = first[i], second[j]
        else:
            i = j = np.zeros(0, np.int64)
        links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        node = tile["node"].to_numpy()
        out = pd.DataFrame({"node": node, "links": links.astype(np.int64), "root": node[roots(len(x), i, j)]})
        return out[out["links"] > 0]

    return tiles.groupBy("label", "dims", "i", "j").applyInPandas(compare, "node long, links long, root long")


def embedding_dedup(df: DataFrame, vector: str = "embedding", label: str = "label", id_col: str = "vec_id",
                    threshold: float = 0.93, block: int = 2048) -> DataFrame:
    """All rows with n_links, component_id (smallest identifier reachable) and kept."""
    df = without(df, *OUTPUT)
    names = df.columns
    key, group, key_, group_, component_, links_ = fresh(df, "key", "group", "vector", "label", "component", "links")
    x = col(vector)
    fit = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    usable = F.coalesce(fit, F.lit(False)) & col(label).isNotNull() & col(id_col).isNotNull()
    keyed = df.withColumn(key, F.when(usable, x)).withColumn(group, F.when(usable, col(label)))
    classes = stored(keyed.where(F.col(key).isNotNull())
                     .groupBy(F.col(group).alias("label"), F.col(key).alias("vector"))
                     .agg(F.min(col(id_col)).cast("long").alias("node"), F.count("*").alias("copies"))
                     .withColumn("dims", F.size("vector")))
    found = stored(embedding_links(classes, threshold, block))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    about = (classes.join(links, "node", "left").join(joined, "node", "left")
             .select(F.col("label").alias(group_), F.col("vector").alias(key_), F.coalesce("component", "node").alias(component_),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias(links_)))
    rows = keyed.join(about, (F.col(group) == F.col(group_)) & (F.col(key) == F.col(key_)), "left")
    component = F.coalesce(F.col(component_), col(id_col))
    return rows.select(*[col(c) for c in names], F.coalesce(F.col(links_), F.lit(0)).cast("long").alias("n_links"),
                       component.alias("component_id"), F.coalesce(col(id_col) == component, F.lit(True)).alias("kept"))
