"""Tiled search, mergeable states and searches in rounds against plain versions; matches along lines of cameras."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistrack.functions import geometry, kernels
from vistrack.operators import guided, matching, search
from vistrack.plans import reconstruct

KEYS = "image long, key long, v array<double>"


def rows(n, image, dim=4, seed=0, base=0):
    """Few values, so that distances tie."""
    rng = np.random.default_rng(seed)
    return [(image, base + i, [float(x) for x in rng.integers(0, 3, dim)]) for i in range(n)]


def plain_two(left, right):
    out = {}
    for _, ka, p in left:
        d = sorted((sum((x - y) ** 2 for x, y in zip(p, q)), kb) for _, kb, q in right)
        out[ka] = (d[0][1], d[0][0], d[1][0] if len(d) > 1 else None, len(d))
    return out


def test_two_smallest(spark):
    rng = random.Random(2)
    cand = [(rng.randint(0, 3), rng.randint(0, 9), rng.randint(0, 30), rng.choice([None, 0.0, 1.0, 2.5, 2.5, 7.0])) for _ in range(800)] + [(9, 9, 1, 3.0), (9, 8, 1, None)]
    want = {}
    for a, k, i, d in cand:
        if d is not None:
            want.setdefault((a, k), []).append((d, i))
    want = {g: (s[0][1], s[0][0], s[1][0] if len(s) > 1 else None, len(s)) for g, v in want.items() if (s := sorted(v))}
    df = spark.createDataFrame(cand, "a long, k long, kb long, d double")
    for n in (1, 7):
        got = {(r.a, r.k): (r.kb, r.d1, r.d2, r.n) for r in search.two_smallest(df.repartition(n), "a", "k").collect()}
        assert got == want
    assert search.two_smallest(df.limit(0), "a", "k").count() == 0
    plan = search.two_smallest(df, "a", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Aggregate") < plan.index("MapInArrow")


@pytest.mark.parametrize("tile", [3, 16, 1000])
def test_tiles_do_not_matter(spark, tile):
    a, b = rows(40, 1, seed=1), rows(37, 2, seed=2, base=100)
    keys = spark.createDataFrame([*a, *b, (2, 999, None), *rows(1, 3, seed=3, base=500)], KEYS)
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 2), (7, 2)], "a long, b long")
    got = search.nearest_two_tiled(pairs, keys, keys, both=True, tile=tile).collect()
    assert {r.ka: (r.kb, r.d1, r.d2, r.n) for r in got if (r.a, r.b) == (1, 2)} == plain_two(a, b)
    assert {r.ka: (r.kb, r.d1, r.d2, r.n) for r in got if (r.a, r.b) == (2, 1)} == plain_two(b, a)
    assert {r.d2 for r in got if (r.a, r.b) == (2, 3)} == {None} and len(got) == 40 + 37 + 37 + 1
    only = [(1, 2, x[1], y[1]) for x in a for y in b if (x[1] * 7 + y[1]) % 5 == 0]
    got = search.nearest_two_tiled(pairs, keys, keys, only=spark.createDataFrame([*only, *only, (1, 2, 3, 4)], "a long, b long, ka long, kb long"), tile=tile).collect()
    for r in got:
        assert (r.kb, r.d1, r.d2, r.n) == plain_two([a[r.ka]], [y for y in b if (1, 2, r.ka, y[1]) in set(only)])[r.ka]
    assert len(got) == len({o[2] for o in only})


def test_image_of_many_keys(spark):
    """A skewed image is cut into tiles; no task holds more than two of them."""
    rng = np.random.default_rng(5)
    big, small = rng.normal(size=(100_000, 8)), rng.normal(size=(300, 8))
    keys = spark.createDataFrame([(1, i, v) for i, v in enumerate(big.tolist())] + [(2, i, v) for i, v in enumerate(small.tolist())], KEYS)
    got = search.nearest_two_tiled(spark.createDataFrame([(2, 1)], "a long, b long"), keys, keys, tile=4096).orderBy("ka").collect()
    for r, q in zip(got, small, strict=True):
        d = ((big - q) ** 2).sum(1)
        assert r.kb == d.argmin() and np.allclose([r.d1, r.d2], np.sort(d)[:2], rtol=1e-12) and r.n == 100_000
    parts = spark.createDataFrame([(1, 100_000), (2, 300)], "image long, n long")
    assert {tuple(r) for r in search.tiles(parts, 4096).collect()} == {(1, 25), (2, 1)}


def test_rounds_search_only_what_is_open(spark):
    """Later partitions meet only keys that have no match yet."""
    a, b = rows(60, 1, dim=6, seed=7), rows(45, 2, dim=6, seed=8, base=200)
    keys, pairs = spark.createDataFrame(a + b, KEYS), spark.createDataFrame([(1, 2)], "a long, b long")
    found, frontiers = search.partitioned_nearest(keys, pairs, 3, 0.8, tile=10)
    want, open_, left = {}, [60], [x[1] for x in a]
    for part in range(3):
        seen = [y for i, y in enumerate(b) if min(i * 3 // 45, 2) <= part]
        for k in list(left):
            kb, d1, d2, _ = plain_two([a[k]], seen)[k]
            if d2 is not None and d1 <= 0.8 * 0.8 * d2:
                want[k] = (kb, part)
                left.remove(k)
        open_.append(len(left))
    assert {r.ka: (r.kb, r.part) for r in found.collect()} == want and want
    assert [f.count() for f in frontiers] == open_[: len(frontiers)] and open_[0] > open_[1]


def test_cap_on_both_sides(spark):
    """Neighbors beyond the cap do not compete: (1) position 9 spoils the match of position 0 in a full search only."""
    keys = spark.createDataFrame([(1, 0, [0.0])] + [(2, i, [x]) for i, x in enumerate([1.0, 10.0, *[50.0 + i for i in range(7)], -0.995, 70.0])], KEYS)
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [tuple(r) for r in search.smallest_caps(keys, pairs, 0.95, 5, 1).collect()] == [(1, 2, 5, 1)]
    assert matching.ratio_test(search.nearest_two_tiled(pairs, keys, keys), 0.95).count() == 0
    assert search.smallest_caps(keys, pairs, 0.95, 5, 2).count() == 0


def test_prefix_rounds(spark):
    """A pair below the gate is given up, one in between is searched once more, one with enough is done."""
    far = lambda image, n: [(image, i, [1000.0 * i + image * 1e-3 * (i % 7)]) for i in range(n)]
    none = [(4, i, [5e6 + i]) for i in range(40)]
    keys = spark.createDataFrame(far(1, 40) + far(2, 50) + none, KEYS)
    pairs = spark.createDataFrame([(1, 2), (4, 2)], "a long, b long")
    got = lambda enough: search.prefix_rounds(keys, pairs, 0.6, least=8, small=2, skip=4, enough=enough).collect()
    assert {(r.a, r.b, r.round) for r in got(8)} == {(1, 2, 1)} and len(got(8)) == 8
    assert {(r.a, r.b, r.round) for r in got(10)} == set()
    wide = search.prefix_rounds(keys, pairs, 0.6, least=4, small=2, skip=4, enough=6).collect()
    assert {(r.ka, r.kb, r.round) for r in wide} == {(i, i, 2) for i in range(8)}


def turned(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def test_fundamental_of_cameras(spark):
    """The column form against that of projection matrices, on turned cameras, in both kinds of coordinates."""
    rng, cams = np.random.default_rng(3), []
    for _ in range(6):
        cams.append((float(rng.uniform(300, 900)), turned(rng), rng.normal(size=3) * 5))
    same = (cams[0][0] * 2, cams[0][1], cams[0][2])
    pairs = [(x, y) for x in cams for y in cams if x is not y] + [(cams[0], same)]
    df = spark.createDataFrame([(i, x[0], x[1].ravel().tolist(), x[2].tolist(), y[0], y[1].ravel().tolist(), y[2].tolist()) for i, (x, y) in enumerate(pairs)], "i long, f1 double, r1 array<double>, t1 array<double>, f2 double, r2 array<double>, t2 array<double>")
    one, two = ("f1", "r1", "t1"), ("f2", "r2", "t2")
    got = [r.f for r in geometry.fundamental(df, one, two).orderBy("i").collect()]
    pixels = [r.f for r in geometry.fundamental(df, one, two, (640.0, 480.0)).orderBy("i").collect()]
    shift = np.array([[1, 0, -320.0], [0, -1, 240.0], [0, 0, 1]])
    for f, fp, (x, y) in zip(got[:-1], pixels, pairs, strict=False):
        p1, p2 = (np.diag([-c[0], -c[0], 1.0]) @ np.hstack([c[1], c[2][:, None]]) for c in (x, y))
        want = kernels.fundamental(p1, p2)
        f = np.array(f).reshape(3, 3)
        assert min(np.abs(f - want).max(), np.abs(f + want).max()) < 1e-9 and abs(np.linalg.norm(f) - 1) < 1e-12
        fp, wp = np.array(fp).reshape(3, 3), shift.T @ want @ shift
        wp /= np.linalg.norm(wp)
        assert min(np.abs(fp - wp).max(), np.abs(fp + wp).max()) < 1e-9
    assert got[-1] is None  # the same place
    assert geometry.fundamental(df.withColumn("t2", F.lit(None).cast("array<double>")), one, two).where("f IS NOT NULL").count() == 0


def scene(seed=4, views=5, points=150):
    """Turned cameras around points, pixels of all points in all views, descriptors that differ by point."""
    rng = np.random.default_rng(seed)
    x, cams, keys = rng.uniform(-4, 4, (points, 3)), [], []
    v = rng.normal(size=(points, 8))
    for i in range(views):
        a = 0.25 * (i - 2)
        r = np.array([[np.cos(a), 0, -np.sin(a)], [0, 1, 0], [np.sin(a), 0, np.cos(a)]])
        t, f = np.array([0.3 * i, -0.2 * i, -20.0]), 800.0 + 10 * i
        cam = x @ r.T + t
        xy = -f * cam[:, :2] / cam[:, 2:]
        cams.append((i, f, 0.0, 0.0, r.ravel().tolist(), t.tolist()))
        keys += [(i, 1000 * i + k, float(px + 512), float(384 - py), (v[k] + 0.01 * rng.normal(size=8)).tolist()) for k, (px, py) in enumerate(xy.tolist())]
    return x, cams, keys


def test_guided_match_against_brute_force(spark):
    _, cams, keys = scene(views=3, points=60)
    df, cameras = spark.createDataFrame(keys, "image long, key long, x double, y double, v array<double>"), spark.createDataFrame(cams, "view long, f double, k1 double, k2 double, r array<double>, t array<double>")
    pairs = reconstruct.with_fundamental(spark.createDataFrame([(0, 1), (1, 2), (0, 9)], "a long, b long"), cameras, (1024.0, 768.0))
    mats = {(r.a, r.b): np.array(r.f).reshape(3, 3) for r in pairs.collect()}
    got = {(r.a, r.b, r.ka): (r.kb, r.d1, r.d2) for r in guided.guided_match(df, pairs, 1024, 768, 6.0, 0.9, border=16).collect()}
    want = {}
    dist = lambda l, k: abs(l[0] * k[2] + l[1] * k[3] + l[2]) / np.hypot(l[0], l[1])
    for (a, b), f in mats.items():
        for k in (k for k in keys if k[0] == a):
            line = f @ [k[2], k[3], 1]
            near = sorted((sum((p - q) ** 2 for p, q in zip(k[4], m[4])), m[1], m) for m in keys if m[0] == b and 16 <= m[2] <= 1008 and 16 <= m[3] <= 752 and dist(line, m) < 6.0)
            if len(near) > 1 and near[0][0] <= 0.81 * near[1][0] and dist(f.T @ [near[0][2][2], near[0][2][3], 1], k) < 6.0:
                want[a, b, k[1]] = (near[0][1], near[0][0], near[1][0])
    assert set(mats) == {(0, 1), (1, 2)} and set(got) == set(want) and len(want) > 30
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1:], want[k][1:]) for k in want)


def test_candidates_with_many_others(spark):
    """Padded candidates go through the same states; strict asks for less than the ratio."""
    keys = spark.createDataFrame([(1, 1, [0.0]), *[(2, i, [float(i)]) for i in range(3, 30)]], KEYS)
    some = spark.createDataFrame([(1, 1, 2, 3), (1, 1, 2, 5)], "a long, ka long, b long, kb long")
    more = guided.padded(some, keys, 12, 1)
    got = guided.match_candidates(keys, more, 0.6, least=10).collect()
    full = [kb for _, _, _, kb in map(tuple, more.collect())]
    assert [(r.ka, r.kb) for r in got] == ([(1, 3)] if 9.0 <= 0.36 * sorted(k * k for k in full)[1] else [])
    assert guided.match_candidates(keys, some, 0.6, least=2).count() == 1  # 9 <= 0.36 * 25
    assert guided.match_candidates(keys, some, 0.6, least=2, strict=True).count() == 0 and guided.match_candidates(keys, some, 0.6, least=3).count() == 0


def test_densify_from_cameras_and_keys(spark):
    """From a model and raw keys to new points: pairs, matrices, guided matches, tracks, triangulation."""
    x, cams, keys = scene()
    cameras = spark.createDataFrame(cams, "view long, f double, k1 double, k2 double, r array<double>, t array<double>")
    df = spark.createDataFrame(keys, "image long, key long, x double, y double, v array<double>")
    model = spark.createDataFrame([(v, p) for v in range(5) for p in range(30)], "view long, point long")
    matches, tracks, points = reconstruct.densify_views(model, df, cameras, 1024, 768, near=3)
    assert matches.count() > 400
    members = {}
    for r in tracks.collect():
        members.setdefault(r.track, set()).add(r.key % 1000)
    assert all(len(m) == 1 for m in members.values()) and len(members) > 120
    got = {r.track: (r.x, r.y, r.z) for r in points.collect()}
    assert set(got) == set(members)
    assert all(np.abs(np.array(got[t]) - x[next(iter(m))]).max() < 1e-4 for t, m in members.items())
