from vistrack.sources import formats


def test_pose_file(spark, tmp_path):
    p, k, r, c = ([float(i + s) for i in range(n)] for s, n in ((0, 12), (20, 9), (30, 9), (40, 3)))
    lines = ["2", "5 7", "6 9"] + [" ".join(map(str, x)) for x in (p[:4], p[4:8], p[8:], k[:3], k[3:6], k[6:], r[:3], r[3:6], r[6:], c)]
    (tmp_path / "0003-cam-par.txt").write_text("\n".join(lines) + "\n")
    got = formats.pose_files(spark, str(tmp_path)).head()
    assert [(x.key, x.point) for x in got.corr] == [(5, 7), (6, 9)] and (got.p, got.k, got.r, got.c) == (p, k, r, c)


def test_cameras_and_correspondences_round_trip(spark, tmp_path):
    cams = [(3, 500.5, -0.01, 0.002, [float(i) for i in range(9)], [1.0, 2.0, -3.5], True), (12, 1.0, 0.0, 0.0, [0.0] * 9, [0.0] * 3, False)]
    df = spark.createDataFrame(cams, "view long, f double, k1 double, k2 double, r array<double>, t array<double>, valid boolean")
    formats.write_cameras(df, str(tmp_path / "out"))
    text = next((tmp_path / "out" / "view=3").glob("*.txt")).read_text()
    assert len(text.strip().split("\n")) == 5 and not (tmp_path / "out" / "view=12").exists()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0003-cam-bdl.txt").write_text(text)
    got = formats.camera_files(spark, str(tmp_path / "in")).head()
    assert (got.view, got.f, got.k1, got.k2, got.r, got.t) == cams[0][:6]
    rows = [(1, 3, 4, 10.5, -2.25), (2, 3, 9, 0.0, 7.0)]
    formats.write_correspondences(spark.createDataFrame(rows, "point long, view long, key long, x double, y double"), str(tmp_path / "corr"))
    assert sorted(map(tuple, formats.correspondence_files(spark, str(tmp_path / "corr")).collect())) == rows


def test_point_matches(spark, tmp_path):
    rows = [(8, 1, 2, 3.0, 4.0, 5.0, 6.0, 7.0)]
    formats.write_point_matches(spark.createDataFrame(rows, "query long, key long, point long, x double, y double, px double, py double, pz double"), str(tmp_path / "m"))
    assert next((tmp_path / "m" / "query=8").glob("*.txt")).read_text() == "1 2 3.000000 4.000000\n5.000000 6.000000 7.000000\n"


def test_vocabulary_assignments_and_logs(spark, tmp_path):
    (tmp_path / "centers.txt").write_text("1 2 3\n\n4 5 6\n7 8 9\n")
    assert [(r.word, r.v) for r in formats.vocabulary(spark, str(tmp_path / "centers.txt")).orderBy("word").collect()] == [(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0]), (2, [7.0, 8.0, 9.0])]
    (tmp_path / "words.txt").write_text("0 1 2\n0 2 1\n")
    assert sorted(map(tuple, formats.assignments(spark, str(tmp_path / "words.txt")).collect())) == [(0, 1, 2), (0, 2, 1)]
    (tmp_path / "run.log").write_text("pair 3 took 1.5 s\nnothing\nv2 -4e2\n")
    assert [r.numbers for r in formats.log_lines(spark, str(tmp_path / "run.log")).collect()] == [[3.0, 1.5], [], [-400.0]]
