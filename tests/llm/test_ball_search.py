"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from heliopanel.llm import ball_search as B

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    counted = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for key, text in items:
        scored = []
        for doc, c in counted:
            m = 50 + (50 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(key, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    vocabulary = [w + x for w in ("a", "Be", "çö", "漢", "q9", "zz", "İ", "K") for x in ("", "n", "st", "0", "ß", "É", "ou", "ing")]
    usual = [v for i, v in enumerate(vocabulary) for _ in range(1 + 60 // (i + 1))]
    docs = [(i, draw.choice([" ", ", ", "\n", "_", "-"]).join(draw.choices(usual, k=draw.choice([0, 1, 5, 40, 300])))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(70)] + [(2000, None), (2001, ""), (2002, "!!! __ \x00"), (3, docs[3][1]), (None, docs[5][1])]
    items = [(j, " ".join(draw.choices(usual, k=12))) for j in range(9)] + [(20, None), (21, ""), (22, "unheard of"), (23, docs[7][1]), (24, docs[5][1]), (None, "an BE"), (1, "çöst")]
    return docs, items


def run(spark, docs, items, **options):
    found = B.lexical_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("seed,k", [(1, 50), (2, 3)])
def test_search_equals_brute_force(spark, seed, k):
    docs, items = corpus(seed, 400)
    assert run(spark, docs, items, k=k) == brute(docs, items, k)


def test_small_blocks_and_pieces(spark, monkeypatch):
    docs, items = corpus(4, 120)
    for name, value in (("ITEMS", 3), ("PIECE", 5)):
        monkeypatch.setattr(B, name, value)
    assert run(spark, docs, items) == brute(docs, items)
    assert B.term_counts("Ab_c déF 12".encode()) == {b"ab": 1, b"c": 1, "déf".encode(): 1, b"12": 1}


def test_bounds_hold_and_prune(monkeypatch):
    monkeypatch.setattr(B, "LEAF", 4)
    rng = np.random.default_rng(0)
    dims, n = 60, 500
    rows = [np.sort(rng.choice(dims // 4, rng.integers(1, 9), False) + dims // 4 * (i % 4)) for i in range(n)]
    cells = B.Cells(np.arange(n), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), rng.integers(1, 10 ** 6, sum(map(len, rows))))
    weights, group = rng.integers(0, 9000, dims), np.arange(dims) % 7
    tree = B.BallTree(cells, np.sqrt(weights), group, 7)
    assert sorted(tree.cells.doc) == list(range(n))
    queries = np.zeros((20, dims))
    whole = []
    for j in range(20):
        q = np.zeros(dims, np.int64)
        ids = rng.choice(dims // 4, 5, False) + dims // 4 * (j % 4)
        q[ids] = weights[ids]
        queries[j, ids] = np.sqrt(weights[ids])
        whole.append(q)
    bounds = tree.bounds(queries)
    for j, q in enumerate(whole):
        for node in range(len(tree.low)):
            assert tree.scores(node, q)[1].max() <= bounds[node, j]
    best = [B.Best(5) for _ in whole]
    leaves = B.search(tree, queries, whole, best)
    assert leaves < 0.6 * 20 * sum(1 for c in tree.child if not c[0])
    for q, b in zip(whole, best):
        dense = np.zeros((n, dims), np.int64)
        for i in range(n):
            at = slice(cells.start[i], cells.start[i + 1])
            dense[i, cells.term[at]] = cells.value[at]
        scores = dense @ q
        order = np.lexsort((np.arange(n), -scores))[:5]
        assert b.score.tolist() == scores[order].tolist() and b.doc.tolist() == order.tolist()


def test_empty_tables_and_other_columns(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []
    docs = spark.createDataFrame([(7, "an apple", 1, "x")], "doc_id long, text string, n int, ids string")
    items = spark.createDataFrame([(1, "apple", 2, "y")], "item_id long, text string, rank int, doc_id string")
    assert [tuple(r)[:3] for r in B.lexical_search(docs, items).collect()] == [(1, 1, 7)]


def test_long_sums_stay_exact():
    tf, length = np.array([3, 10 ** 6]), np.array([10 ** 9, 10 ** 12])
    n, total = 10 ** 7, 10 ** 14
    want = [(10 ** 9 * int(t)) // (1000 * int(t) + 20 * (50 + (50 * n * int(v)) // total)) for t, v in zip(tf, length)]
    assert B.saturated(tf, length, n, total).tolist() == want
