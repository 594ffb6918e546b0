"""Document quality by a linear-chain conditional random field over lines.

A text is a chain of its lines. A line is seen through shares of letters, capitals, digits, sentence marks
and other signs, its length, word lengths, repeated words and repeated lines, and through the same of the
lines before and after it. The field labels each line good or bad; its forward-backward marginals,
weighted by line length, make up the document's score from 0 (bad) to 1 (good).

Training takes at most `per_class` documents of each label, those with the smallest seeded hash of their
identifier; every line of a document carries the document's label. Only their line features go to the
driver. Everything else covers all lines of all texts.

Null texts count as empty; an empty text is one empty line and gets a score. Repeated rows get equal
scores. A table without labels of both kinds gives the score 0.5 everywhere. Columns of the input named
like an output column are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from heliopanel.llm.common import col, without

OUTPUT = ("score", "n_lines", "n_good_lines")
PASS_CHARS = 1_000_000
LOWER, UPPER, DIGIT, SPACE, SENTENCE, SIGN = range(6)
PRIME = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
OWN = 14


@dataclass
class Field:
    """Weights of the field: features to good minus bad, transitions, starts; and the features' scaling."""

    weights: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


@lru_cache(maxsize=1)
def kinds_of_code_points() -> np.ndarray:
    names = {"Lu": UPPER, "Lt": UPPER, "Zs": SPACE, "Cc": SPACE}

    def kind(c: str) -> int:
        category = unicodedata.category(c)
        return names.get(category, LOWER if category[0] in "LM" else DIGIT if category[0] == "N" else SIGN)

    found = np.fromiter((kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)
    found[[ord(c) for c in ".,;:?'\"-"]] = SENTENCE
    return found


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts: features, lengths; and the number of lines of each text."""
    joined = "".join([t + "\n" for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(codes)
    ends = np.flatnonzero(codes == 10)  # every line ends with one, the last of each text with ours
    starts = np.append(0, ends[:-1] + 1)
    lines = len(ends)
    length = ends - starts
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    per_text = np.diff(np.searchsorted(ends, text_ends, side="right"), prepend=0)
    text_of = np.repeat(np.arange(len(texts)), per_text)

    kinds = kinds_of_code_points()[codes]
    line_of = np.repeat(np.arange(lines), length + 1)
    shares = np.bincount(line_of * 6 + kinds, minlength=lines * 6).reshape(lines, 6).astype(np.float64)
    shares[:, SPACE] -= 1  # the line's end
    chars = np.maximum(length, 1)

    # Words with a hash each, by differences of one running sum.
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, PRIME)]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, INVERSE)]))
    running = np.concatenate([[np.uint64(0)], np.cumsum(codes.astype(np.uint64) * power)])
    inside = kinds != SPACE
    edge = np.diff(inside.astype(np.int8), prepend=0)
    first = np.flatnonzero(edge == 1)
    after = np.flatnonzero(edge == -1)
    hashes = (running[after] - running[first]) * inverse[first]
    word_line = line_of[first]
    words = np.bincount(word_line, minlength=lines)

    def repeats(back: int) -> np.ndarray:
        same = (hashes[back:] == hashes[:-back]) & (word_line[back:] == word_line[:-back])
        return np.bincount(word_line[back:][same], minlength=lines) / np.maximum(words, 1)

    line_hash = (running[ends] - running[starts]) * inverse[starts]
    order = np.lexsort((line_hash, text_of))
    opens = np.ones(lines, bool)
    opens[1:] = (line_hash[order][1:] != line_hash[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
    group = np.cumsum(opens) - 1
    copies = np.empty(lines)
    copies[order] = np.bincount(group)[group]
    doubled = np.bincount(line_of[1:][codes[1:] == codes[:-1]], minlength=lines)
    capital_first = np.bincount(word_line, kinds[first] == UPPER, minlength=lines) / np.maximum(words, 1)
    marked = np.bincount(word_line, kinds[after - 1] == SIGN, minlength=lines) / np.maximum(words, 1)

    own = np.column_stack([
        shares[:, [LOWER, UPPER, DIGIT, SENTENCE, SIGN]] / chars[:, None], np.log1p(length), (length == 0),
        np.log1p(chars / np.maximum(words, 1)), repeats(1), repeats(2), (copies > 1) & (length > 0), doubled / chars, capital_first, marked])
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    behind[:-1] = own[1:]
    firsts = np.cumsum(per_text) - per_text
    before[firsts] = 0
    behind[firsts + per_text - 1] = 0
    return np.column_stack([own, before, behind, np.ones(lines)]), length, per_text


def marginals(scores: np.ndarray, per_text: np.ndarray, field: Field, pairs: bool = False):
    """P(good) of each line, by forward-backward over all texts side by side; with `pairs` also summed transitions."""
    order = np.argsort(-per_text, kind="stable")
    size = per_text[order]
    first = (np.cumsum(per_text) - per_text)[order]
    emit = np.exp(np.column_stack([-scores / 2, scores / 2]).clip(-30, 30))
    move = np.exp(field.transitions)
    ahead = np.empty_like(emit)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    for t, n in enumerate(active):
        at = first[:n] + t
        now = emit[at] * (np.exp(field.starts) if t == 0 else ahead[at - 1] @ move)
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    back = np.ones_like(emit)
    for t in range(len(active) - 2, -1, -1):
        at = first[:active[t + 1]] + t
        now = (emit[at + 1] * back[at + 1]) @ move.T
        back[at] = now / now.sum(axis=1, keepdims=True)
    both = ahead * back
    both /= both.sum(axis=1, keepdims=True)
    if not pairs:
        return both[:, 1]
    inner = np.ones(len(emit), bool)
    inner[np.cumsum(per_text) - per_text] = False
    to = np.flatnonzero(inner)
    joint = ahead[to - 1][:, :, None] * move * (emit[to] * back[to])[:, None, :]
    return both[:, 1], (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit(features: np.ndarray, per_text: np.ndarray, good: np.ndarray, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> Field:
    """Field by gradient ascent (Adam) on the likelihood of the documents' labels, documents weighted alike."""
    n = features.shape[1]
    mean, spread = features.mean(axis=0), features.std(axis=0)
    mean[-1], spread[-1] = 0, 1
    spread[spread < 1e-9] = 1
    x = (features - mean) / spread
    y = np.repeat(good, per_text).astype(float)
    weight = np.repeat(1 / per_text, per_text)
    firsts = np.cumsum(per_text) - per_text
    values, m, v = np.zeros(n + 3), np.zeros(n + 3), np.zeros(n + 3)
    moves = np.maximum(per_text - 1, 0)
    seen = np.array([(moves * (1 - good)).sum(), (moves * good).sum()], float)
    for step in range(1, rounds + 1):
        field = Field(values[:n], np.diag(values[n:n + 2]), np.array([0, values[n + 2]]), mean, spread)
        p, pairs = marginals(x @ values[:n], per_text, field, pairs=True)
        slope = np.concatenate([((y - p) * weight) @ x / len(per_text), (seen - np.diag(pairs)) / max(len(y), 1),
                                [(good - p[firsts]).mean()]]) - ridge * values
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope ** 2
        values = values + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        values[n:n + 2] = values[n:n + 2].clip(-2, 2)
    return Field(values[:n], np.diag(values[n:n + 2]), np.array([0, values[n + 2]]), mean, spread)


def passes(texts: list[str]) -> Iterator[list[str]]:
    run, chars = [], 0
    for text in texts:
        if run and chars + len(text) > PASS_CHARS:
            yield run
            run, chars = [], 0
        run.append(text)
        chars += len(text) + 1
    if run:
        yield run


def training_split(id_col: Column) -> Column:
    """True for rows held out of training."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality",
          per_class: int = 3000, seed: int = 29) -> Field | None:
    """Fit on at most `per_class` labelled, not held out documents of each label; None without both labels."""
    known = labels.select(col(id_col).alias("id"), col(label).cast("int").alias("good")).where(
        F.col("id").isNotNull() & F.col("good").isin(0, 1) & ~training_split(F.col("id"))).dropDuplicates(["id"])
    chosen = [known.where(F.col("good") == g).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(per_class) for g in (0, 1)]
    sample = documents.select(col(id_col).alias("id"), col(text).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, goods = batch.column("id").to_pylist(), batch.column("good").to_pylist()
            done = 0
            for run in passes([t or "" for t in batch.column("text").to_pylist()]):
                rows, _, per_text = line_features(run)
                cuts = np.concatenate([[0], np.cumsum(per_text)])
                values = [rows[a:b].astype(np.float32).ravel() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[done:done + len(run)], batch.schema.field("id").type), pa.array(
                    goods[done:done + len(run)], pa.int32()), pa.array(values, pa.list_(pa.float32()))], names=["id", "good", "features"])
                done += len(run)

    schema = StructType([sample.schema["id"], StructField("good", IntegerType()), StructField("features", ArrayType(FloatType()))])
    found = sample.mapInArrow(features, schema).toPandas().sort_values("id", kind="stable")
    if found["good"].nunique() < 2:
        return None
    rows = [np.asarray(f, np.float64).reshape(-1, 3 * OWN + 1) for f in found["features"]]
    return fit(np.concatenate(rows), np.array([len(r) for r in rows]), found["good"].to_numpy(float))


def score(df: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """All rows with score, n_lines and n_good_lines."""
    df = without(df, *OUTPUT)
    schema = StructType([*df.schema.fields, StructField("score", DoubleType()), StructField("n_lines", IntegerType()),
                         StructField("n_good_lines", IntegerType())])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for texts in passes([t or "" for t in batch.column(place).to_pylist()]):
                features, length, per_text = line_features(texts)
                if field is None:
                    good = np.full(len(length), 0.5)
                else:
                    good = marginals(((features - field.mean) / field.spread) @ field.weights, per_text, field)
                firsts = np.cumsum(per_text) - per_text
                weight = length + 1.0
                parts.append((np.add.reduceat(weight * good, firsts) / np.add.reduceat(weight, firsts), per_text,
                              np.add.reduceat((good >= 0.5).astype(int), firsts)))
            if parts:
                values = [np.concatenate(p) for p in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values[0].clip(0, 1), pa.float64()), pa.array(values[1], pa.int32()),
                                                  pa.array(values[2], pa.int32())], names=[*batch.schema.names, *OUTPUT])

    return df.mapInArrow(run, schema)


def good_documents(df: DataFrame, field: Field | None, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows whose score is at least `least`, with the columns of the input."""
    if not {c.lower() for c in df.columns} & set(OUTPUT):
        return score(df, field, text).where(F.col("score") >= least).select(*[col(c) for c in df.columns])
    packed = df.select(F.struct("*").alias("row"), col(text).alias("text"))
    return score(packed, field).where(F.col("score") >= least).select("row.*")
