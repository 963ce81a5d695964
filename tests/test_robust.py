"""Robust estimation against planted inliers and against every hypothesis held against every point."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistrack.functions import kernels, robust


def views(n, bad, seed, noise=0.3):
    """Matches of two turned cameras, the last ``bad`` of them wrong, and points with images of the first."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-5, 5, (n, 3)) - [0, 0, 25]
    a, c, s = 800.0, np.cos(0.3), np.sin(0.3)
    r = np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]])
    cam = x @ r.T + np.array([4.0, 0.5, 3.0])
    one, two = -a * x[:, :2] / x[:, 2:], -a * cam[:, :2] / cam[:, 2:]
    one, two = one + rng.normal(0, noise, one.shape), two + rng.normal(0, noise, two.shape)
    two[n - bad :] = rng.uniform(-400, 400, (bad, 2))
    return x, one, two


@pytest.mark.parametrize("n,bad", [(60, 0), (200, 60), (300, 180), (40, 10)])
def test_fundamental_finds_the_planted_inliers(n, bad):
    _, a, b = views(n, bad, n)
    f, own = robust.fundamental_of(a, b, 5)
    assert own[: n - bad].mean() > 0.97 and own[n - bad :].sum() <= 0.15 * bad
    full, all_ = robust.fundamental_of(a, b, 5, tested=False)
    # the sequential test spares work and loses no inlier that the full evaluation finds
    assert own.sum() >= 0.99 * all_.sum()
    rest = robust.epipolar_errors(f[None], *(np.hstack([p, np.ones((n, 1))]) for p in (a, b)))[0]
    assert (own == (rest < 4.0)).all() and abs(np.linalg.det(f)) < 1e-9


def test_projection_finds_the_planted_inliers():
    x, a, _ = views(150, 0, 9)
    a[100:] = np.random.default_rng(1).uniform(-400, 400, (50, 2))
    p, own = robust.projection_of(a, x, 3)
    assert own[:100].all() and own[100:].mean() < 0.1
    assert (robust.projection_of(a, x, 3, tested=False)[1] == own).mean() > 0.98


def test_bad_hypotheses_see_few_points():
    seen = []
    n, good = 2000, np.zeros(2000, bool)
    good[: 1200] = True

    def errors(models, at):
        seen.append(len(models) * len(at))
        return np.where(models[:, None] > 0, ~good[at][None], (at[None] % 29 > 0)) * 10.0

    order = np.random.default_rng(0).permutation(n)
    models = np.array([0.0] * 95 + [1.0])
    alive, fits = robust.survivors(models, errors, n, order, 4.0, 0.5)
    assert alive.tolist() == [95] and (fits[0] == good).all() and sum(seen) < 0.1 * 96 * n


def test_samples_differ_and_results_repeat():
    rng = np.random.default_rng(3)
    for n, size in ((8, 8), (9, 8), (40, 8), (33, 8), (5000, 6)):
        s = robust.picks(rng, n, size, 200)
        assert s.shape == (200, size) and all(len(set(r)) == size for r in s.tolist()) and s.min() >= 0 and s.max() < n
    _, a, b = views(100, 30, 2)
    one, two = (robust.fundamental_of(a, b, 7) for _ in range(2))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()
    assert robust.fundamental_of(a[:20], b[:20], 7)[0] is None  # fewer than 27
    assert robust.fundamental_of(np.zeros((40, 2)), np.ones((40, 2)), 7)[1].shape == (40,)  # all in one place


def test_rounds_end_by_the_share_of_inliers():
    _, a, b = views(400, 0, 4)
    began = time.perf_counter()
    for seed in range(50):
        robust.fundamental_of(a, b, seed)
    assert time.perf_counter() - began < 5


def test_pairs_in_a_table(spark):
    rows = []
    for i, bad in enumerate((0, 20, 55)):
        _, a, b = views(60, bad, 20 + i)
        rows += [(1, 2 + i, *map(float, (*p, *q))) for p, q in zip(a, b, strict=True)]
    rows += [(1, 2, float("nan"), 0.0, 0.0, 0.0), (1, 2, None, 0.0, 0.0, 0.0), (8, 9, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a long, b long, xa double, ya double, xb double, yb double")
    for n in (1, 5):
        got = {(r.a, r.b): r.inliers for r in kernels.estimate_fundamental(df.repartition(n)).collect()}
        assert set(got) == {(1, 2), (1, 3)} and got[1, 2] == 60 and 40 <= got[1, 3] <= 44


def bent(f, seed, n=300):
    """Points and their images by a camera far to the side whose distortion no straight camera follows."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 90, (n, 3)) - [0, 0, 150]
    at = np.array([280.0, 210.0, 3.0])
    return x, kernels.project(np.repeat(np.eye(3)[None], n, 0), np.repeat(-at[None], n, 0), f, -0.01, 0.001, x)


def test_hopeless_samples_are_not_solved(monkeypatch):
    """Of 4096 hypotheses few are decomposed where no camera fits; inliers and draws are those of the search without a screen."""
    solved, whole = [], robust.projections
    monkeypatch.setattr(robust, "projections", lambda xy, x: (solved.append(len(xy)), whole(xy, x))[1])
    for f, seed in ((900.0, 1), (20_000.0, 2), (60_000.0, 3), (300_000.0, 4)):
        x, xy = bent(f, seed)
        for wrong in (0, 60):
            xy = xy.copy()
            xy[:wrong] += 300
            h = np.hstack([x, np.ones((len(x), 1))])
            call = lambda screen: robust.consensus(len(x), 6, lambda s: robust.projections(xy[s], x[s]), lambda m, at: robust.projection_errors(m, xy[at], h[at]), lambda own: robust.projections(xy[own][None], x[own][None])[0], 7, 4096, 4.0, True, screen)  # noqa: E731, B023
            _, want, drawn = call(None)
            solved.clear()
            _, got, n = call(robust.Screen(xy, x, 4.0))
            assert (got == want).all() and n == drawn
            assert f < 60_000 or sum(solved) < 0.1 * 4096 == 0.1 * n


def test_hopeless_images_are_told_and_no_others(monkeypatch):
    for seed in range(20):
        x, a, _ = views(120, 0, 100 + seed, noise=1.0)
        a[60:] = np.random.default_rng(seed).uniform(-400, 400, (60, 2))  # half of the points fit
        best = int(robust.projection_of(a, x, seed)[1].sum())
        assert best >= 55 and not robust.hopeless(a, x, best, seed, 4.0)
        assert robust.hopeless(np.random.default_rng(seed).uniform(-4e4, 4e4, (120, 2)), x, 60, seed, 4.0)
        assert not robust.hopeless(a[:9], x[:9], 12, seed, 4.0) and not robust.hopeless(np.zeros((40, 2)), np.zeros((40, 3)), 20, seed, 4.0)
    drawn, few = [], np.random.default_rng(0).uniform(-4e4, 4e4, (24, 2))  # a share of 1/1500 would take 60,000 samples
    monkeypatch.setattr(robust, "picks", lambda rng, n, size, count: drawn.append(count))
    assert not robust.hopeless(few, x[:24], 12, 1, 4.0) and not drawn
    monkeypatch.undo()
    x, xy = bent(300_000.0, 5)
    assert kernels.register(xy, x, 5) is None and robust.hopeless(xy, x, 150, 5, 4.0)


def test_few_bytes_are_many_tasks(spark):
    """A dozen images of little data are not joined into one task."""
    rows = []
    for v in range(12):
        x, a, _ = views(40, 0, v)
        rows += [(v, *map(float, (*p, *q))) for p, q in zip(a, x, strict=True)]
    df = spark.createDataFrame(rows, "view long, x double, y double, px double, py double, pz double")
    got = kernels.register_images(df).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 12 and len({r.task for r in got}) == len({r.task for r in df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "view").withColumn("task", F.spark_partition_id()).collect()})
