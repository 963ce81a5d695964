import gzip
import struct

from pyspark.sql import functions as F

from vistrack.sources import formats
from vistrack.sources import images as jpegs


def test_lists(spark, tmp_path):
    (tmp_path / "names").write_text("a/b.jpg\nc.jpg 1 650.5\n")
    (tmp_path / "dims").write_text("640 480\n1023 767\n")
    got = formats.images(spark, str(tmp_path / "names"), str(tmp_path / "dims")).orderBy("image_id").collect()
    assert [(r.image_id, r.width, r.height) for r in got] == [(0, 640, 480), (1, 1023, 767)]
    d = formats.image_descriptors(spark, str(tmp_path / "names")).orderBy("image_id").collect()
    assert [(r.fisheye, r.init_focal) for r in d] == [(False, None), (True, 650.5)]
    (tmp_path / "n").write_text("12\n")
    counts = formats.counts_for(formats.images(spark, str(tmp_path / "names"), str(tmp_path / "dims")), formats.feature_counts(spark, str(tmp_path / "n")))
    assert sorted((r.image_id, r.n) for r in counts.collect()) == [(0, 12), (1, -1)]


def test_key_files(spark, tmp_path):
    text = "2 128\n" + "".join(f"{10.5 + k} {20.25 + k} 1.5 0.5\n" + "".join(" ".join(str((i + k) % 256) for i in range(a, b)) + "\n" for a, b in ((0, 20), (20, 40), (40, 60), (60, 80), (80, 100), (100, 120), (120, 128))) for k in range(2))
    (tmp_path / "k").mkdir()
    (tmp_path / "k/a.key").write_text(text)
    (tmp_path / "k/b.key.gz").write_bytes(gzip.compress(text.encode()))
    got = formats.key_files(spark, str(tmp_path / "k")).orderBy("path", "key").collect()
    assert len(got) == 4 and (got[0].x, got[0].y) == (20.25, 10.5) and bytes(got[3].desc) == bytes((i + 1) % 256 for i in range(128))
    assert [r.n for r in formats.key_files(spark, str(tmp_path / "k"), header_only=True).collect()] == [2, 2]


def test_matches_and_tracks(spark, tmp_path):
    (tmp_path / "m").write_text("0 1 2.5 3 4 5 6 7.25\n")
    assert tuple(formats.matches(spark, str(tmp_path / "m")).first()) == (0, 1, 2.5, 3.0, 4, 5, 6.0, 7.25)
    rows = [(0, 1, 5, 6), (0, 1, 7, 8), (0, 2, 1, 1)]
    formats.write_match_blocks(spark.createDataFrame(rows, "a int, b int, ka int, kb int"), str(tmp_path / "blocks"))
    assert sorted(map(tuple, formats.match_blocks(spark, str(tmp_path / "blocks/*.txt")).collect())) == rows
    t = spark.createDataFrame([([{"view": 1, "key": 2, "x": 0.5, "y": 1.5}, {"view": 3, "key": 4, "x": 2.0, "y": 3.0}], [1.0, 2.0, 3.5])], "obs array<struct<view:int,key:int,x:double,y:double>>, pos array<double>")
    formats.write_tracks(t, str(tmp_path / "t"))
    back = formats.tracks(spark, str(tmp_path / "t"), xyz=True).first()
    assert back == t.first()
    formats.write_lines(spark.createDataFrame([(1, 2, [0.5] * 9)], "a int, b int, f array<double>"), str(tmp_path / "p"), "a", "b", "f")
    assert formats.pairs_with_f(spark, str(tmp_path / "p")).first().f == [0.5] * 9
    (tmp_path / "map").write_text("1 5 x.jpg\n2 -1 notfound\n")
    assert [tuple(r) for r in formats.id_map(spark, str(tmp_path / "map")).orderBy("src").collect()] == [(1, 5, "x.jpg"), (2, None, None)]
    (tmp_path / "mat").write_text("0 2\n2 0\n")
    assert sorted(map(tuple, formats.matrix(spark, str(tmp_path / "mat")).collect())) == [(0, 1, 2), (1, 0, 2)]


def test_model_round_trip(spark, tmp_path):
    zero = "0 0 0\n" * 5
    (tmp_path / "m.out").write_text("# v0.3\n2 2\n500.5 0.1 0.01\n1 0 0\n0 1 0\n0 0 1\n0 0 -5\n" + zero + "1 2 3\n255 0 51\n2 0 7 1.5 2.5 1 8 3.5 4.5\n4 5 6\n1 2 3\n0\n")
    cams, points, obs = formats.model(spark, str(tmp_path / "m.out"))
    c = cams.orderBy("view").collect()
    assert c[0].f == 500.5 and c[0].t == [0, 0, -5] and c[1].valid is False and c[1].f is None
    assert points.orderBy("point").first().rgb == [1.0, 0.0, 0.2]
    assert sorted((r.point, r.view, r.key, r.x) for r in obs.collect()) == [(0, 0, 7, 1.5), (0, 1, 8, 3.5)]
    formats.write_model(cams, points, obs, str(tmp_path / "out"))
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out").glob("part-*")))
    (tmp_path / "again.out").write_text(text)
    again = formats.model(spark, str(tmp_path / "again.out"))
    assert [sorted(map(str, a.collect())) for a in (cams, points, obs)] == [sorted(map(str, a.collect())) for a in again]


def test_model_in_blocks(spark, tmp_path):
    """A model of 20,000 points is read by many tasks, sections apart, and a written folder comes back as it is."""
    n, out = 20_000, ["# v", "3 20000"]
    for c in range(3):
        out += [f"{500 + c} 0.1 0.01", "1 0 0", "0 1 0", "0 0 1", f"0 0 -{c}"] if c != 1 else ["0 0 0"] * 5
    for p in range(n):
        out += [f"{p} {p + 0.5} -1", f"{p % 256} 0 51", "0" if p % 7 == 0 else f"2 0 {p} 1.5 2.5 2 {p + 1} 3.5 {p}.25"]
    (tmp_path / "m.out").write_text("\n".join(out) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cams, points, obs = formats.model(spark, str(tmp_path / "m.out"))
        assert obs.rdd.getNumPartitions() > 8
        plan = obs._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
        want = formats.free_model(spark, str(tmp_path / "m.out"))
        for got, free in zip((cams, points, obs), want, strict=True):
            assert sorted(map(str, got.collect())) == sorted(map(str, free.select(got.columns).collect()))
        assert obs.count() == 2 * (n - len(range(0, n, 7)))
        formats.write_model(cams, points, obs, str(tmp_path / "out"))
        assert len(list((tmp_path / "out").glob("part-*"))) > 1
        again = formats.model(spark, str(tmp_path / "out"))
        assert [sorted(map(str, a.collect())) for a in (cams, points, obs)] == [sorted(map(str, a.collect())) for a in again]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_models_without_lines_of_their_own(spark, tmp_path):
    (tmp_path / "f.out").write_text("1 1 500 0 0 1 0 0 0 1 0 0 0 1 0 0 -5\n1 2 3 255 0\n0 1 0 7 1.5 2.5")
    cams, points, obs = formats.model(spark, str(tmp_path / "f.out"))
    assert cams.first().f == 500.0 and points.first().n_vis == 1 and obs.first().x == 1.5
    (tmp_path / "empty.out").write_text("0 0\n")
    assert [d.count() for d in formats.model(spark, str(tmp_path / "empty.out"))] == [0, 0, 0]


def test_jpeg_headers(spark, tmp_path):
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0x0112, 3, 1, 6) + struct.pack("<HHII", 0x920A, 5, 1, 38) + struct.pack("<I", 0) + struct.pack("<II", 355, 10)
    seg = b"Exif\0\0" + tiff
    data = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(seg) + 2) + seg + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 480, 640, 0) + b"\xff\xd9"
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.jpg").write_bytes(data)
    (tmp_path / "j/b.jpg").write_bytes(b"no image")
    got = jpegs.read(spark, str(tmp_path / "j")).orderBy(F.col("path")).collect()
    assert (got[0].width, got[0].height, got[0].orientation, got[0].focal) == (640, 480, 6, 35.5) and got[1].width is None
