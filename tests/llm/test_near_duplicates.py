"""Near duplicates of embeddings and texts against brute force."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliopanel.llm import graph
from heliopanel.llm import minhash_dedup as M
from heliopanel.llm.embedding_dedup import embedding_dedup, quantised
from heliopanel.llm.graph import components


def closed(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 700)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = closed(700, pairs)
    assert all(got.get(i, i) == want[i] for i in range(700))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_rounds(spark, monkeypatch):
    """Bucket heads with their members, chains, repeated and reversed links and loops: few tables are written, small ones by few tasks."""
    rng = np.random.default_rng(3)
    pairs = [(int(h), int(m)) for h, m in zip(rng.integers(0, 40, 900), rng.integers(0, 900, 900))]
    pairs += [(i + 1, i) for i in range(1000, 1300)] + [(i, 1900) for i in range(1400, 1900)] + pairs[:50] + [(1950, 1950)]
    want = closed(2000, pairs)
    files, store = [], graph.stored

    def counted(df, *rows):
        out = store(df, *rows)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(graph, "stored", counted)
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    try:
        for key, value in zip(keys, ("false", "24")):
            spark.conf.set(key, value)
        links = spark.createDataFrame([*pairs, (None, 3)], "a long, b long").repartition(6)
        found = components(links)
        got = {r.node: r.component for r in found.collect()}
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)
    assert got == {i: want[i] for i in {i for p in pairs if p[0] != p[1] for i in p}}
    assert len(files) <= 2 and files[-1] == 1


@pytest.mark.parametrize("share", [8, 64])
def test_components_of_many_small_tasks(spark, monkeypatch, share):
    """Tasks that hold few links at once, and more rounds for them."""
    monkeypatch.setattr(graph, "TASK_ROWS", share)
    whole = graph.contracted
    monkeypatch.setattr(graph, "contracted", lambda links: whole(links, share))
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 500, (400, 2))] + [(i, i + 1) for i in range(600, 800)] + [(i, 1200) for i in range(900, 1200)]
    want = closed(1201, pairs)
    for rows in (None, len(pairs)):
        got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), rows=rows).collect()}
        assert all(got.get(i, i) == want[i] for i in range(1201))


def test_error_bound_holds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, a, e = quantised(x)
    got = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(got - x @ x.T) <= np.outer(a, e) + np.outer(e, a) + np.outer(e, e) + 1e-12).all()


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows, vectors = [], []
    for i in range(300):
        v = (base[i % 40] + rng.normal(size=8) * 0.12 * (i % 4)).astype(np.float32) if i % 5 else base[3].astype(np.float32)
        rows.append((i, [float(c) for c in v], i % 2 if i % 11 else None))
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [None] + [1.0] * 7, 1), (303, [float("nan")] + [1.0] * 7, 1), (304, [], 1),
             (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [float("inf")] * 8, 0)]
    n = len(rows)
    pairs, links = [], collections.Counter()

    def usable(r):
        v = r[1]
        return bool(v) and r[2] is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)

    for i in range(n):
        for j in range(i + 1, n):
            a, b = rows[i], rows[j]
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    pairs.append((i, j))
                    links[i] += 1
                    links[j] += 1
    want = closed(n, pairs)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("component", F.lit(1)).withColumn("links", F.lit("x"))
    for block in (16, 2048):
        out = embedding_dedup(df, block=block).collect()
        assert len(out) == n
        for r in out:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert embedding_dedup(df.limit(0)).count() == 0


def shingles(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1 if w else 0, len(w) - 4)))


def brute(texts):
    sets = [shingles(t) for t in texts]
    df = collections.Counter()
    for s in sets:
        df.update(s.keys())
    n = len(texts)
    weighted = [{k: c * (0.5 + 0.5 * math.log((n + 1) / (df[k] + 1)) / math.log(n + 2)) for k, c in s.items()} for s in sets]
    pairs = []
    for i in range(n):
        for j in range(i + 1, n):
            x, y = weighted[i], weighted[j]
            common = sum(min(v, y[k]) for k, v in x.items() if k in y)
            if common and common / (sum(x.values()) + sum(y.values()) - common) >= 0.8:
                pairs.append((i, j))
    return closed(n, pairs)


def edited(rng, words, n):
    words = list(words)
    for at in rng.integers(0, len(words), n):
        words[at] = f"e{rng.integers(0, 1_000_000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    found = []
    for g in range(12):
        words = [f"w{rng.integers(0, 5000)}" for _ in range(150)]
        found += [edited(rng, words, k) for k in (0, 0, 1, 2, 3, 5, 9, 14)]
    hot = [f"h{rng.integers(0, 5000)}" for _ in range(120)]
    found += [edited(rng, hot, int(k)) for k in rng.integers(0, 7, 60)]
    found += ["", None, " \n", "one two", "One two", "one two three", "x y z " * 3000, "x y z " * 3001, "lone text of six different words here"]
    return found


def test_minhash_matches_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "c", i) for i, t in enumerate(texts)], "doc_id long, text string, component string, weight long").repartition(5)
    want = brute(texts)
    out = {r.doc_id: (r.component_id, r.kept) for r in M.minhash_dedup(df).collect()}
    assert out == {i: (c, c == i) for i, c in enumerate(want)}
    stay = M.drop_near_duplicates(df)
    assert stay.columns == df.columns and {r.doc_id for r in stay.collect()} == {i for i, c in enumerate(want) if c == i}


def test_minhash_edges(spark):
    schema = "doc_id long, text string"
    same = "one two three four five six seven"
    df = spark.createDataFrame([(None, same), (5, same), (4, same), (4, same), (None, None), (7, None)], schema)
    out = sorted(map(tuple, M.minhash_dedup(df).collect()), key=str)
    assert [r[2] for r in out if r[0] == 5] == [4] and [r[2] for r in out if r[0] == 7] == [7]
    assert sorted((r.doc_id for r in M.drop_near_duplicates(df).collect()), key=str) == [4, 7, None, None]
    assert M.minhash_dedup(df.limit(0)).count() == 0
    assert M.drop_near_duplicates(df.limit(0)).count() == 0
    assert M.minhash_dedup(spark.createDataFrame([(1, None), (2, "")], schema)).count() == 2


def test_tile_pairs_counts_repeated_shingles():
    idf = np.ones(M.SLOTS, np.float32)
    a = (np.array([1, 2, 3], np.uint64), np.array([5, 1, 1], np.float32))
    b = (np.array([1, 2, 3], np.uint64), np.array([5, 1, 2], np.float32))
    c = (np.array([1, 2, 3], np.uint64), np.array([1, 1, 1], np.float32))
    i, j = M.tile_pairs([a, b, c], idf, np.arange(3), np.arange(3), np.arange(3), 0.8)
    assert set(zip(i.tolist(), j.tolist())) == {(0, 1), (1, 0)}


def test_unlike_texts_of_any_length_share_no_samples():
    rng = np.random.default_rng(6)
    for n in (50, 5_000, 100_000):
        sets = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(3)]
        drawn = [M.samples(s, np.ones(n, np.float32)) for s in sets]
        assert max((drawn[a] == drawn[b]).sum() for a, b in ((0, 1), (0, 2), (1, 2))) < 5


def test_samples_agree_as_often_as_weighted_sets_do():
    rng = np.random.default_rng(7)
    for n in (60, 600, 20_000):
        shares, want = [], []
        for _ in range(30):
            hashes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            weights = rng.choice([0.5, 0.7, 1, 2, 6], n).astype(np.float32)
            other = np.where(rng.random(n) < 0.15, rng.choice([0.5, 1, 3], n), weights).astype(np.float32)
            shares.append((M.samples(hashes, weights) == M.samples(hashes, other)).mean())
            want.append(np.minimum(weights, other).sum() / np.maximum(weights, other).sum())
        # 3,000 draws, four standard deviations
        assert abs(np.mean(shares) - np.mean(want)) < 4 * 0.5 / np.sqrt(3_000)


def test_weights_do_not_depend_on_the_number_of_shingles():
    rng = np.random.default_rng(8)
    frequent = np.arange(0, M.SLOTS, 64)
    for documents in (13_000_000, 1_300_000_000):
        slots = rng.poisson(documents * 400 / M.SLOTS, M.SLOTS)
        slots[frequent] += documents // 100
        weights = M.slot_weights(slots, documents)
        rare = np.delete(weights, frequent)
        assert np.abs(rare - 1).max() < 0.01
        assert np.abs(weights[frequent] - (0.5 + 0.5 * math.log(100) / math.log(1002))).max() < 0.01


def test_rows_of_one_identifier(spark):
    first, second = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(9, first, 1), (9, second, 1), (9, second, 2), (11, "u v w x y z a b c", 1)]
    out = [M.drop_near_duplicates(spark.createDataFrame(rows[::step], "doc_id long, text string, extra int")).collect() for step in (1, -1)]
    assert sorted(out[0]) == sorted(out[1]) and sorted((r.doc_id, r.text) for r in out[0]) == [(9, first), (9, second), (11, rows[3][1])]
