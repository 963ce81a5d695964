"""Band joins, guided matches and the operators around them against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vistrack.functions import geometry, kernels, strings
from vistrack.operators import guided, matching, tracks


def test_band_join_on_lines_of_all_slopes(spark):
    rng = random.Random(1)
    w, h, cell, step, band = 640, 480, 64, 30, 4.0
    keys = [(1, i, rng.uniform(cell, w - cell), rng.uniform(cell, h - cell)) for i in range(1500)]
    lines = [(0, 1, 1.0, 0.0, -300.0), (1, 1, 0.0, 1.0, -200.0), (2, 1, 1.0, 0.05, -512.0), (3, 1, 1.0, -1.0, 0.0), (4, 1, 0.0, 0.0, 1.0), (5, 1, 1.0, 1.0, 5000.0)]
    lines += [(i, 1, math.cos(a := rng.uniform(0, math.pi)), math.sin(a), -(math.cos(a) * rng.uniform(0, w) + math.sin(a) * rng.uniform(0, h))) for i in range(6, 90)]
    lined = spark.createDataFrame(lines, "q long, target_view long, la double, lb double, lc double")
    gridded = guided.grid(spark.createDataFrame(keys, "view long, key long, x double, y double"), cell, w, h)
    got = {(r.q, r.t_key) for r in guided.band_candidates(lined, gridded, cell, step, w, h, band, ["q"], ["key", "x", "y"]).collect()}
    want = {(q, k) for q, _, a, b, c in lines if a or b for _, k, x, y in keys if abs(a * x + b * y + c) / math.hypot(a, b) < band}
    assert got == want and len({q for q, _ in want}) > 60
    fine = guided.grid(spark.createDataFrame(keys, "view long, key long, x double, y double"), 16, w, h, border=cell)
    got = {(r.q, r.t_key) for r in guided.band_candidates(lined, fine, 16, 4, w, h, band, ["q"], ["key", "x", "y"]).collect()}
    assert got == want
    with pytest.raises(ValueError):
        guided.band_candidates(lined, gridded, 16, 16, w, h, band, ["q"], ["key", "x", "y"])


def test_clip_line(spark):
    rows = [(1.0, 0.0, -5.0), (0.0, 1.0, -3.0), (1.0, 1.0, -4.0), (1.0, 0.0, 5.0), (0.0, 0.0, 1.0), (1.0, -1.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [r.e for r in df.select(geometry.clip_line(F.col("a"), F.col("b"), F.col("c"), 10.0, 8.0).alias("e")).collect()]
    ends = [None if e is None else {(round(e.x0, 9), round(e.y0, 9)), (round(e.x1, 9), round(e.y1, 9))} for e in got]
    assert ends == [{(5, 0), (5, 8)}, {(0, 3), (10, 3)}, {(0, 4), (4, 0)}, None, None, {(0, 0), (8, 8)}]


def test_padding_is_the_same_in_every_run(spark):
    keys = spark.createDataFrame([(2, k) for k in range(30)], "image long, key long")
    cand = spark.createDataFrame([(1, 7, 2, 3), (1, 7, 2, 4), (1, 8, 2, 5)], "a long, ka long, b long, kb long")
    runs = [sorted(map(tuple, guided.padded(cand.repartition(n), keys.repartition(n), 6, 1).collect())) for n in (1, 4)]
    assert runs[0] == runs[1] and len(runs[0]) == len(set(runs[0])) == 12 and {(1, 7, 2, 3), (1, 8, 2, 5)} <= set(runs[0])


def test_first_group_clusters(spark):
    rows = [(1, 0, 0, 0, 0, 0), (1, 1, 10, 0, 0, 0), (1, 2, 1, 1, 0, 0), (1, 3, 9, 0, 1, 0), (1, 4, 50, 0, 0, 0), (2, 0, 1, 0, 0, 0)]
    df = spark.createDataFrame(rows, "view long, seq long, x1 long, y1 long, x2 long, y2 long")
    got = {(r.view, r.seq): r.cluster for r in guided.first_group_clusters(df, "view", ["x1", "y1", "x2", "y2"]).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 0): 1}


def test_to_image_undoes_to_norm(spark):
    df = spark.createDataFrame([(3.5, 700.0, 1023, 767)], "x double, y double, w int, h int")
    nx, ny = geometry.to_norm(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    r = df.select(*geometry.to_image(nx, ny, F.col("w"), F.col("h"))).head()
    assert tuple(r) == (3.5, 700.0)


def test_lines_meet_and_rectangles_have_four_edges(spark):
    one = spark.range(1)
    lit = lambda *v: tuple(map(F.lit, v))
    r = one.select(geometry.line_line(lit(1.0, 0.0, -2.0), lit(0.0, 1.0, -3.0)).alias("p"), geometry.line_line(lit(1.0, 1.0, 0.0), lit(2.0, 2.0, 1.0)).alias("none")).head()
    assert (r.p.x, r.p.y, r.none) == (2.0, 3.0, None)
    assert geometry.rectangle_edges(4.0, 2.0) == [(1.0, 0.0, 0.0), (1.0, 0.0, -4.0), (0.0, 1.0, 0.0), (0.0, 1.0, -2.0)]
    assert geometry.rectangle_edges(4.0, 2.0, centered=True)[0] == (1.0, 0.0, 2.0)


def test_fisheye_keeps_the_center_and_the_direction(spark):
    r = spark.range(1).select(*geometry.fisheye(F.lit(100.0), F.lit(50.0), 100.0, 50.0, 40.0, 120.0, 300.0), *geometry.fisheye(F.lit(120.0), F.lit(50.0), 100.0, 50.0, 40.0, 120.0, 300.0)).head()
    assert tuple(r[:2]) == (0.0, 0.0) and abs(r[2] - 300.0 * math.tan(math.radians(30.0))) < 1e-9 and r[3] == 0.0


def test_verify_camera():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.uniform(-10, 10, (60, 3)) - [0, 0, 60]
    r, t, f = np.eye(3), np.array([1.0, 2.0, -3.0]), 700.0
    xy = kernels.project(np.repeat(r[None], 60, 0), np.repeat(t[None], 60, 0), f, 0.0, 0.0, x)
    turn = np.diag([1.0, -1.0, -1.0])
    p = np.diag([f, f, 1.0]) @ np.hstack([turn @ r, (turn @ t)[:, None]])
    got = kernels.verify_camera(3.0 * p, xy, x)
    assert got and abs(got["f"] - f) < 1e-6 and got["inliers"] == 60 and np.allclose(got["t"], t)
    wrong = xy.copy()
    wrong[:20] += 100
    assert kernels.verify_camera(p, wrong, x)["inliers"] == 40 and kernels.verify_camera(p, xy[:8], x[:8]) is None
    wrong[:40] += 100
    assert kernels.verify_camera(p, wrong, x) is None
    assert kernels.verify_camera(np.diag([1.0, 2.0, 1.0]) @ p, xy, x) is None


def test_blocks_of_words_give_the_same_neighbors(spark):
    rng = random.Random(3)
    vec = lambda: [rng.random() for _ in range(8)]
    keys = spark.createDataFrame([(i % 3, i, vec()) for i in range(40)], "image long, key long, v array<double>")
    centers = spark.createDataFrame([(i, vec()) for i in range(25)], "word long, v array<double>")
    rows = [sorted(map(tuple, matching.visual_words(keys, centers, 8, 4, b).collect())) for b in (1000, 4)]
    assert rows[0] == rows[1] and len(rows[0]) == 160


def test_needs_cover_and_shards(spark, tmp_path):
    from vistrack.operators import model
    from vistrack.sources import formats

    assert model.needs_cover(spark.range(11), 10) and not model.needs_cover(spark.range(10), 10)
    formats.write_shards(spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "shard long, a long, b long"), str(tmp_path / "s"), "a", "b")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "s")).collect()) == ["1 2", "3 4"]


def test_options(spark):
    df = spark.createDataFrame([("--a=b=c",), ("-x",), ("plain",), (None,)], "s string")
    n, v = strings.option_value(F.col("s"))
    got = [tuple(r) for r in df.select(n, v, strings.unknown_option(n, ["a"])).collect()]
    assert got == [("a", "b=c", False), ("x", None, True), (None, None, True), (None, None, True)]


def test_loop_of_initial_matches_and_tracks(spark, small):
    """Initial matches over whole prefixes are those of the plain search; tracks of them have two views or more."""
    from vistrack import roles
    from vistrack.operators import pairs
    from vistrack.plans import reconstruct

    keys, images = roles.keys(spark, small), roles.images(spark, small)
    got = {tuple(r) for r in reconstruct.initial_matches(keys, images, 100, 0.95, 1).collect()}
    near = matching.nearest_two(matching.candidates(keys, pairs.all_pairs(images), 64))
    want = {tuple(r) for r in matching.unique_target(matching.ratio_test(near, 0.95)).select("a", "b", "ka", "kb").collect()}
    assert got == want and got
    merged = tracks.merged_tracks(tracks.match_components(spark.createDataFrame(sorted(got), "a long, b long, ka long, kb long")))
    assert merged.groupBy("component").count().where("count < 2").count() == 0


def test_densify_and_localize_find_the_synthetic_scene(spark, small):
    """Tracks of consecutive views give the true points, and the points the true cameras."""
    from vistrack import catalog
    from vistrack.plans import reconstruct

    pt, cams, obs = catalog.synthetic(spark, small)
    seen = {}
    for r in obs.where("track < 40").collect():
        seen.setdefault(r.track, []).append(r.view)
    matches = [(a, t, b, t) for t, v in seen.items() for a, b in zip(sorted(v), sorted(v)[1:])]
    coords = obs.select("view", F.col("track").alias("key"), "x", "y")
    found = reconstruct.densify(spark.createDataFrame(matches, "a long, ka long, b long, kb long"), coords, cams).collect()
    true = sorted((r.px, r.py, r.pz) for r in pt.where("point < 40").collect())
    assert len(found) == len(seen) and all(max(abs(x - y) for x, y in zip(p, q)) < 1e-3 for p, q in zip(sorted((round(r.x, 4) + 0.0, round(r.y, 4) + 0.0, round(r.z, 4)) for r in found), true))
    corr = obs.withColumnRenamed("track", "point").join(pt, "point").where("view < 2 OR point < 8").select("view", "x", "y", "px", "py", "pz")
    got = reconstruct.localize(corr).collect()
    assert sorted(r.view for r in got) == [0, 1] and all(abs(r.f - 500 - r.view) < 1e-2 for r in got)
