"""EXIF headers, whole and broken; file names of long ids; the weighted quota."""

import struct

from pyspark.sql import functions as F

from vistrack.functions import strings
from vistrack.operators import pairs
from vistrack.sources import images


def rationals(*v):
    return b"".join(struct.pack("<II", int(round(x * 1000)), 1000) for x in v)


def segment(loop=False):
    """Main directory at 8 (model, EXIF and GPS pointers), EXIF at 100 (focal, plane, pixels), GPS at 200, values at 300."""
    entry = lambda tag, kind, n, value: struct.pack("<HHII", tag, kind, n, value)
    dirs = {8: [entry(0x0110, 2, 6, 300), entry(0x8769, 4, 1, 8 if loop else 100), entry(0x8825, 4, 1, 200)], 100: [entry(0x920A, 5, 1, 310), entry(0xA20E, 5, 1, 320), entry(0xA210, 3, 1, 2), entry(0xA002, 4, 1, 4000)],
            200: [entry(1, 2, 2, ord("S")), entry(2, 5, 3, 330), entry(3, 2, 2, ord("E")), entry(4, 5, 3, 360)]}
    out = bytearray(400)
    out[:8] = b"II*\0" + struct.pack("<I", 8)
    for at, rows in dirs.items():
        body = struct.pack("<H", len(rows)) + b"".join(rows)
        out[at : at + len(body)] = body
    out[300:306], out[310:318], out[320:328] = b"X-100\0", rationals(23.5), rationals(4000)
    out[330:354], out[360:384] = rationals(33, 30, 36), rationals(151, 12, 0)
    return b"\xff\xd8\xff\xe1\x01\x98Exif\0\0" + bytes(out)


def test_fields():
    e = images.exif(segment())
    assert (e["model"], e["focal"], e["pixels_x"]) == ("X-100", 23.5, 4000)
    assert abs(images.sensor_width(e) - 25.4) < 1e-9
    lat, lon = images.position(e)
    assert abs(lat + 33.51) < 1e-9 and abs(lon - 151.2) < 1e-9


def test_broken_segments_end():
    """A directory that points to itself is read once; a segment cut anywhere gives what is whole."""
    assert images.exif(segment(loop=True))["model"] == "X-100"
    whole = segment()
    for n in range(0, len(whole), 3):
        e = images.exif(whole[:n])
        assert set(e) <= set(images.exif(whole)) and images.position(e) in ((None, None), images.position(images.exif(whole))) or n > 330
    assert images.exif(b"") == images.exif(b"Exif\0\0") == {} and images.sensor_width({}) is None and images.position({"lat": [1.0, None, 2.0]}) == (None, None)


def test_table_of_images(spark, tmp_path):
    frame = b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 480, 640) + b"\x03"
    data = segment()
    (tmp_path / "a.jpg").write_bytes(data[:4] + struct.pack(">H", len(data) - 4) + data[6:] + frame + b"\0" * 16)
    (tmp_path / "b.jpg").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[1]: r for r in images.read(spark, str(tmp_path)).collect()}
    a, b = got["a.jpg"], got["b.jpg"]
    assert (a.width, a.height, a.focal, a.model) == (640, 480, 23.5, "X-100") and abs(a.sensor - 25.4) < 1e-9 and abs(a.lat + 33.51) < 1e-9
    assert (b.width, b.focal, b.lat, b.model) == (None, None, None, None)


def test_long_ids_keep_their_digits(spark):
    got = spark.createDataFrame([(7,), (12345,), (1234567,)], "n long").select(strings.pad4(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == ["0007", "12345", "1234567"]


def test_quota_gives_heavier_sources_more(spark):
    """View 0 has sources 1 (30 common points) and 2 (10): of four places 1 gives three, 2 one; taken views are passed over."""
    covis = [(0, 1, 30), (0, 2, 10)] + [(1, v, 100 - v) for v in (10, 11, 12, 13, 14)] + [(1, 0, 30), (2, 0, 10), (2, 10, 50), (2, 20, 40), (2, 21, 30)]
    df = spark.createDataFrame(covis, "v1 long, v2 long, n long")
    got = [r.view for r in pairs.two_hop_quota(df, 2, 6).where("v1 = 0").orderBy("rn").collect()]
    assert got == [1, 2, 10, 11, 12, 20]
    more = [r.view for r in pairs.two_hop_quota(df, 2, 30).where("v1 = 0").orderBy("rn").collect()]
    assert sorted(more) == [1, 2, 10, 11, 12, 13, 14, 20, 21]
    assert pairs.two_hop_quota(df.limit(0), 2, 6).count() == 0
