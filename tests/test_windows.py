"""Window regression from cross-products against laid-out windows."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from heliopanel.forecast import windows as W
from heliopanel.operators import panel as P

START = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, plant string, mwh double"
SEQ, HOR = 12, 4


def series(hours=150, plants=("a", "b"), gaps=(), seed=1):
    draw = random.Random(seed)
    rows = []
    for j, plant in enumerate(plants):
        for h in range(hours):
            sun = max(0.0, math.sin((h % 24 - 6) / 12 * math.pi))
            value = None if (plant, h) in gaps else round((j + 1) * (5 * sun + draw.expovariate(1.0)), 4)
            rows.append((START + dt.timedelta(hours=h), plant, value))
    return rows


def laid_out(rows, until=None, since=None):
    """Units of every window [seq + horizon], origins and truth, window by window."""
    units, origins, truth, keys = [], [], [], []
    for plant in sorted({r[1] for r in rows}):
        own = sorted(r for r in rows if r[1] == plant)
        u = [-1 if r[2] is None else int(math.floor(math.log1p(max(r[2], 0.0)) * 10_000 + 0.5)) for r in own]
        for s in range(len(own) - SEQ - HOR + 1):
            origin = own[s + SEQ - 1][0]
            if (until and origin >= until) or (since and origin < since):
                continue
            units.append(u[s:s + SEQ + HOR])
            origins.append(origin)
            truth.append([r[2] for r in own[s + SEQ:s + SEQ + HOR]])
            keys.append((plant, s))
    return np.array(units, np.int64).reshape(-1, SEQ + HOR), origins, truth, keys


def design(units, origins):
    angle = np.array([o.hour for o in origins]) * 2 * np.pi / 24
    return np.column_stack([np.maximum(units[:, :SEQ], 0) / 1e4, np.ones(len(units)), np.sin(angle), np.cos(angle)])


@pytest.fixture(params=[(), (("a", 40), ("a", 41), ("b", 100), ("b", 149))])
def case(spark, request, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_ROWS", 37)
    rows = series(gaps=set(request.param))
    rows += [(START, None, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    windows = W.Windows.of(df, seq_len=SEQ, horizon=HOR)
    return [r for r in rows if r[1]], windows


def test_cross_products_are_exact(case):
    rows, windows = case
    cut = START + dt.timedelta(hours=100)
    units, origins, _, _ = laid_out(rows, until=cut)
    good = (units[:, SEQ:] >= 0).all(axis=1)
    laid = np.maximum(units[good], 0)
    got = W.cross_products(windows.between(until=cut.isoformat())).collect()
    want = laid.T @ laid
    exact = {(r.i, r.j): int(r.units) for r in got if r.j < SEQ + HOR}
    assert exact == {(i, j): int(want[i, j]) for i in range(SEQ + HOR) for j in range(i, SEQ + HOR)}
    extra = W.extras_of(np.array([np.datetime64(o, "us").astype(np.int64) for o, g in zip(origins, good) if g]))
    loose = np.zeros((SEQ + HOR + 3, 3))
    for r in got:
        if r.j >= SEQ + HOR:
            loose[r.i, r.j - SEQ - HOR] = r.loose
    np.testing.assert_allclose(loose[:SEQ + HOR], laid.T @ extra, rtol=1e-9, atol=1e-4)
    np.testing.assert_allclose(loose[SEQ + HOR:], extra.T @ extra, rtol=1e-9, atol=1e-9)


def test_coefficients_equal_least_squares(case):
    rows, windows = case
    units, origins, _, _ = laid_out(rows)
    good = (units[:, SEQ:] >= 0).all(axis=1)
    model = W.fit_steps(windows)
    want = np.linalg.lstsq(design(units, origins)[good], units[good][:, SEQ:] / 1e4, rcond=None)[0]
    np.testing.assert_allclose(model.coefficients, want, atol=1e-7)
    assert model.n == good.sum()


def test_scores_equal_the_product_of_windows(case):
    rows, windows = case
    since = START + dt.timedelta(hours=60)
    model = W.fit_steps(windows)
    units, origins, truth, keys = laid_out(rows, since=since)
    want = np.maximum(np.expm1(design(units, origins) @ model.coefficients), 0)
    got = {(r.plant, r.start, r.h): r for r in W.score_steps(model, windows.between(since=since.isoformat())).collect()}
    assert len(got) == len(keys) * HOR
    for w, (plant, start) in enumerate(keys):
        for h in range(HOR):
            r = got[plant, start, h + 1]
            assert r.y_true == truth[w][h] and r.y_pred == pytest.approx(want[w, h], abs=1e-9) and r.origin_ts == origins[w]


def test_mixed_loss_is_at_its_minimum(case):
    rows, windows = case
    units, origins, _, _ = laid_out(rows)
    good = (units[:, SEQ:] >= 0).all(axis=1)
    z, y = design(units, origins)[good], units[good][:, SEQ:] / 1e4
    weights, delta = W.peak_weights(HOR, (1, 3)), 0.3

    def loss(b):
        e = z @ b - y
        size = np.abs(e)
        return 0.7 * np.sqrt((e * e * weights).mean()) + 0.3 * np.where(size < delta, e * e / (2 * delta), size - delta / 2).mean()

    model, losses = W.fit_mixed_loss(windows, delta=delta, weights=weights, rounds=200, tolerance=1e-13)
    assert all(a >= b - 1e-12 for a, b in zip(losses, losses[1:])) and losses[-1] == pytest.approx(loss(model.coefficients), rel=1e-6)
    e = z @ model.coefficients - y
    slope = (0.7 * e * weights / np.sqrt((e * e * weights).mean()) + 0.3 * np.clip(e / delta, -1, 1)) / e.size
    assert np.abs(z.T @ slope).max() < 1e-5
    draw = np.random.default_rng(0)
    assert all(loss(model.coefficients + 1e-3 * draw.normal(size=model.coefficients.shape)) > losses[-1] for _ in range(20))
    assert loss(W.fit_steps(windows).coefficients) > losses[-1]


def test_contributions_by_time_step(case):
    rows, windows = case
    units, _, _, _ = laid_out(rows)
    history = np.maximum(units[:, :SEQ], 0) / 1e4
    model = W.fit_steps(windows)
    got = {(r.h, r.step): r.contribution for r in W.step_contributions(model, windows, history[:20]).collect()}
    want = np.abs(history - history[:20].mean(axis=0)).mean(axis=0)[:, None] * np.abs(model.coefficients[:SEQ])
    assert len(got) == SEQ * HOR
    for i in range(SEQ):
        for h in range(HOR):
            assert got[h + 1, i - SEQ] == pytest.approx(want[i, h], rel=1e-9)


def test_tables_without_windows(spark):
    windows = W.Windows.of(spark.createDataFrame(series(hours=10), SCHEMA), seq_len=SEQ, horizon=HOR)
    model = W.fit_steps(windows)
    assert model.n == 0 and not model.coefficients.any()
    assert W.score_steps(model, windows).count() == 0 and W.fit_mixed_loss(windows)[1] == []


def test_large_values_are_added_in_parts(spark, monkeypatch):
    rows = [(START + dt.timedelta(hours=h), "a", 1e300) for h in range(SEQ + HOR + 5)]
    got = W.cross_products(W.Windows.of(spark.createDataFrame(rows, SCHEMA), seq_len=SEQ, horizon=HOR)).where("i = 0 and j = 0").first()
    assert int(got.units) == 6 * int(math.floor(math.log1p(1e300) * 10_000 + 0.5)) ** 2
