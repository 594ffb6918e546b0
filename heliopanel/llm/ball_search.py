"""Ranked lexical search by exact inner products, pruned by sparse ball trees.

A document's score for an item is an inner product: the item has a weight w for each of its terms, the document a
saturated frequency for each of its terms. Items are the stated queries and go through the documents in
blocks of bounded size; a block's terms are the only coordinates that can count, so of each document only those
are kept, next to its length. One pass counts; number of documents, total length and document frequencies are Spark
aggregates of all documents.

Documents are dealt by range of their two heaviest terms, so that like ones meet, whatever their number, and
each task builds ball trees over blocks of them. Coordinates are scaled by the square root of w. A node has the
centroid of its documents and, for each group of coordinates, their largest distance from it, so no document below
the node scores more than q . centroid + sum over groups of |q_group| radius_group (Cauchy-Schwarz in every group;
all in doubles, rounded up by more than their error). Nodes are visited in falling order of that bound until it is
below the item's k-th best score so far in the task; leaves are scored in whole numbers. Tasks hand on at most k
documents an item, ties by identifier, and a window over those ends the search.

Null texts have no terms and count for nothing; texts of any length are read in pieces. Repeated rows are further
documents and take ranks of their own; null identifiers rank behind equal scores. Items are ranked one by one,
also if they share an identifier; null or empty items, and items without a term in any document, give no rows. Empty tables give
an empty result. Other columns of either table do not matter.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliopanel.llm.common import col, shuffle_partitions, stored

ITEMS, ITEM_BYTES = 256, 96 << 10
PIECE = 4 << 20
#: Documents, cells and numbers in the centres of one tree.
BLOCK_DOCS, BLOCK_CELLS, CENTRES = 8192, 4 << 20, 16 << 20
LEAF = 16
# Bytes of terms stay (A-Z as a-z), all others separate.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
FOUND = "query int, item_id long, doc_id long, score long"
NO_ID = np.iinfo(np.int64).max


def term_counts(text: bytes | None) -> Counter:
    """Terms of a UTF-8 text and their numbers."""
    counts: Counter = Counter()
    low = 0
    while text is not None and low < len(text):
        high = low + PIECE
        while high < len(text) and TABLE[text[high]] != 32:
            high += 1
        counts.update(text[low:high].translate(TABLE).split())
        low = high
    return counts


def saturated(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), m = 50 + (50 length n) div total, for cells with their document's length."""
    if int(length.max(initial=0)) * n * 50 < 1 << 62:
        m = 50 + (50 * n * length) // total
    else:
        m = np.array([50 + (50 * n * int(v)) // total for v in length], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Cells:
    """Documents as rows of a sparse matrix."""

    def __init__(self, doc: np.ndarray, start: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.doc, self.start, self.term, self.value = doc, start, term, value

    def ordered(self, order: np.ndarray) -> Cells:
        sizes = np.diff(self.start)[order]
        start = np.concatenate([[0], np.cumsum(sizes)])
        cells = np.repeat(self.start[order] - start[:-1], sizes) + np.arange(start[-1])
        return Cells(self.doc[order], start, self.term[cells], self.value[cells])


class BallTree:
    """Balls over one block. `scale` is the factor of each coordinate, `group` the group of each coordinate.

    Nodes are ranges of the rows, which are put in order of the tree; `child` holds the numbers of a node's
    two children, 0 for a leaf.
    """

    def __init__(self, cells: Cells, scale: np.ndarray, group: np.ndarray, n_groups: int):
        self.dims, self.n_groups, self.group = len(scale), n_groups, group
        n = len(cells.doc)
        order = np.arange(n)
        point = cells.value * scale[cells.term]
        self.low, self.high, self.child, queue = [0], [n], [(0, 0)], [0]
        sizes = np.diff(cells.start)
        while queue:
            node = queue.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            rows = order[low:high]
            at = np.repeat(cells.start[rows], sizes[rows]) + _within(sizes[rows])
            begin = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            along, middle = self._direction(cells.term[at], point[at], begin)
            if along is None:
                continue  # all equal
            side = along > middle
            if not len(rows) / 16 <= side.sum() <= len(rows) * 15 / 16:
                side = np.argsort(np.argsort(along, kind="stable"), kind="stable") >= len(rows) // 2
            order[low:high] = np.concatenate([rows[~side], rows[side]])
            cut = high - int(side.sum())
            self.child[node] = (len(self.low), len(self.low) + 1)
            queue += self.child[node]
            self.low += [low, cut]
            self.high += [cut, high]
            self.child += [(0, 0), (0, 0)]
        self.cells = cells.ordered(order)
        self._measure(self.cells.value * scale[self.cells.term])

    def _direction(self, term: np.ndarray, point: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray | None, float]:
        """Position of each document along the line through two far ones, and the middle between these."""
        def row(i: int) -> np.ndarray:
            out = np.zeros(self.dims)
            end = begin[i + 1] if i + 1 < len(begin) else len(term)
            out[term[begin[i]:end]] = point[begin[i]:end]
            return out

        norms = np.add.reduceat(point * point, begin)
        mean = np.bincount(term, point, self.dims) / len(begin)
        first = row(int((norms - 2 * np.add.reduceat(point * mean[term], begin)).argmax()))
        apart = norms - 2 * np.add.reduceat(point * first[term], begin) + first @ first
        if apart.max() <= 1e-9 * norms.max():
            return None, 0.0
        second = row(int(apart.argmax()))
        line = second - first
        return np.add.reduceat(point * line[term], begin), (second @ second - first @ first) / 2

    def _measure(self, point: np.ndarray) -> None:
        cells, n = self.cells, len(self.low)
        self.centre = np.zeros((n, self.dims))
        self.radius = np.zeros((n, self.n_groups))
        sizes = np.diff(cells.start)
        for node in range(n):
            low, high = self.low[node], self.high[node]
            term, values = cells.term[cells.start[low]:cells.start[high]], point[cells.start[low]:cells.start[high]]
            centre = np.bincount(term, values, self.dims) / (high - low)
            own = np.repeat(np.arange(high - low), sizes[low:high]) * self.n_groups + self.group[term]
            whole = np.bincount(self.group, centre * centre, self.n_groups)
            inside = np.bincount(own, (values - centre[term]) ** 2 - centre[term] ** 2, (high - low) * self.n_groups)
            square = whole + inside.reshape(high - low, self.n_groups).max(axis=0)
            self.centre[node] = centre
            self.radius[node] = np.sqrt(np.maximum(square, 0) + 1e-12 * whole)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No document below node i scores more for query j than [i, j]."""
        lengths = np.sqrt(np.stack([np.bincount(self.group, q * q, self.n_groups) for q in queries]))
        return (self.centre @ queries.T + self.radius @ lengths.T) * (1 + 1e-9) + 1e-3

    def scores(self, node: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.low[node], self.high[node]
        at = slice(self.cells.start[low], self.cells.start[high])
        products = self.cells.value[at] * weights[self.cells.term[at]]
        return self.cells.doc[low:high], np.add.reduceat(products, self.cells.start[low:high] - self.cells.start[low])


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)


class Best:
    """The k best documents of one query so far."""

    def __init__(self, k: int):
        self.k, self.doc, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.score) == self.k

    def add(self, doc: np.ndarray, score: np.ndarray) -> None:
        good = score > 0
        if self.full():
            good &= score >= self.score[-1]
        if good.any():
            doc, score = np.append(self.doc, doc[good]), np.append(self.score, score[good])
            order = np.lexsort((doc, -score))[:self.k]
            self.doc, self.score = doc[order], score[order]


def search(tree: BallTree, queries: np.ndarray, weights: list[np.ndarray], best: list[Best]) -> int:
    """Best-first through one tree for every query; returns the number of leaves that were scored."""
    bounds, leaves = tree.bounds(queries), 0
    for j, found in enumerate(best):
        bound = bounds[:, j].tolist()
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if found.full() and -most < found.score[-1]:
                break
            one, two = tree.child[node]
            if one:
                for child in (one, two):
                    if not found.full() or bound[child] >= found.score[-1]:
                        heapq.heappush(heap, (-bound[child], child))
            else:
                found.add(*tree.scores(node, weights[j]))
                leaves += 1
    return leaves


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, ids, tfs): length of every document with terms, and its counts of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most ITEM_BYTES of terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = term_counts(text.as_py())
                if counts:
                    own = sorted((known[t], c) for t, c in counts.items() if t in known)
                    for out, value in zip(rows, (doc, counts.total(), [t for t, _ in own], [c for _, c in own])):
                        out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                                              pa.array(rows[2], pa.list_(pa.int32())), pa.array(rows[3], pa.list_(pa.int64()))], ["doc", "n", "ids", "tfs"])

    return docs.mapInArrow(count, "doc long, n long, ids array<int>, tfs array<long>")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _search_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in items for t in terms))}
    counted = stored(_counted(docs, vocabulary))
    n, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in counted.select(F.explode("ids").alias("t")).groupBy("t").count().collect()}  # one row a term of the block
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    # A term belongs to the group of the first item that has it.
    group = np.zeros(len(vocabulary), np.int64)
    for j, (_, terms) in reversed(list(enumerate(items))):
        group[[vocabulary[t] for t in terms]] = j
    shared = spark.sparkContext.broadcast((weight, group, [(key, [vocabulary[t] for t in terms]) for key, terms in items]))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value[0]
        for batch in batches:
            sizes = np.diff(batch.column("ids").offsets.to_numpy())
            ids, tfs = _flat(batch, "ids"), _flat(batch, "tfs")
            values = saturated(tfs, np.repeat(batch.column("n").to_numpy(), sizes), n, total)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((-values * weight[ids], row))
            start = np.cumsum(sizes) - sizes
            heavy = ids[order]
            second = heavy[start + np.minimum(1, sizes - 1)]
            offsets = pa.array(np.append(start, len(ids)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(heavy[start], pa.int32()), pa.array(second, pa.int32()), batch.column("doc"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                                              pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))], ["heavy", "second", "doc", "ids", "vals"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Cells]:
        parts, docs_held, cells_held = [], 0, 0
        most = max(LEAF, min(BLOCK_DOCS, CENTRES // len(weight) * LEAF // 4))
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                part = batch.slice(low, most)
                size = len(part.column("ids").flatten())
                if parts and (docs_held + part.num_rows > most or cells_held + size > BLOCK_CELLS):
                    yield joined(parts)
                    parts, docs_held, cells_held = [], 0, 0
                parts.append(part)
                docs_held, cells_held = docs_held + part.num_rows, cells_held + size
        if parts:
            yield joined(parts)

    def joined(parts: list[pa.RecordBatch]) -> Cells:
        sizes = np.concatenate([np.diff(p.column("ids").offsets.to_numpy()) for p in parts])
        doc = np.concatenate([p.column("doc").fill_null(NO_ID).to_numpy() for p in parts])
        return Cells(doc, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([_flat(p, "ids") for p in parts]), np.concatenate([_flat(p, "vals") for p in parts]).astype(np.int64))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, group, queries = shared.value
        scale = np.sqrt(weight)
        dense, whole = np.zeros((len(queries), len(weight))), []
        for j, (_, ids) in enumerate(queries):
            dense[j, ids] = scale[ids]
            whole.append(np.zeros(len(weight), np.int64))
            whole[j][ids] = weight[ids]
        best = [Best(k) for _ in queries]
        for cells in blocks(batches):
            search(BallTree(cells, scale, group, len(queries)), dense, whole, best)
        for low in range(0, len(queries), 64):
            part = range(low, min(low + 64, len(queries)))
            sizes = [len(best[j].doc) for j in part]
            doc = np.concatenate([best[j].doc for j in part])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(part), sizes), pa.int32()), pa.array([queries[j][0] for j, size in zip(part, sizes) for _ in range(size)], pa.int64()),
                pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(np.concatenate([best[j].score for j in part]), pa.int64())], ["query", "item_id", "doc_id", "score"])

    rows = counted.where(F.size("ids") > 0).mapInArrow(placed, "heavy int, second int, doc long, ids array<int>, vals array<int>")
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "heavy", "second", F.xxhash64("doc")).sortWithinPartitions("heavy", "second", "doc")
    found = dealt.mapInArrow(ranked, FOUND)
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    block, held = [], 0
    for key, text in items.toLocalIterator():
        terms = list(term_counts(text.encode() if text is not None else None))
        if not terms:
            continue
        block.append((key, terms))
        held += sum(map(len, terms))
        if len(block) == ITEMS or held >= ITEM_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def lexical_search(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text",
                   item_id: str = "item_id", k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, identifiers being whole numbers."""
    documents = docs.select(col(id_col).cast("long").alias("doc"), col(text).cast("binary").alias("text"))
    queries = items.select(col(item_id).cast("long"), col(item_text).cast("string")).orderBy(col(item_id), col(item_text))
    found = [_search_block(documents, block, k) for block in _item_blocks(queries)]
    empty = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else empty
