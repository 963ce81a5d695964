"""Sizes and EXIF fields from the header bytes of JPEG files."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the first frame header."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return None
    while at + 9 <= len(data):
        if data[at] != 255:
            return None
        marker = data[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 0x01:
            at += 1 if marker == 0xFF else 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return w, h
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


#: Fixed values of the EXIF standard: tag numbers, and those of the GPS directory.
TAGS = {0x0112: "orientation", 0x010F: "make", 0x0110: "model", 0x920A: "focal", 0xA405: "focal35", 0xA20E: "plane_x_res", 0xA210: "plane_unit", 0xA002: "pixels_x"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt"}
EXIF_DIRECTORY, GPS_DIRECTORY = 0x8769, 0x8825
#: Millimetres of the units of plane_x_res (inch, centimetre).
UNIT_MM = {2: 25.4, 3: 10.0}


def _value(tiff: bytes, e: str, p: int):
    """The value of the directory entry at p; None if it is not there or of a kind not read."""
    _, kind, n, value = struct.unpack_from(e + "HHII", tiff, p)
    if kind == 1:
        return tiff[p + 8]
    if kind == 3:
        return struct.unpack_from(e + "H", tiff, p + 8)[0]
    if kind == 4:
        return value
    if kind == 2:
        raw = tiff[p + 8 : p + 8 + min(n, 4)] if n <= 4 else tiff[value : value + n]
        return raw.split(b"\0")[0].decode("latin-1").strip()
    if kind == 5 and 0 < n <= 3 and value + 8 * n <= len(tiff):
        parts = [a / b if b else None for a, b in struct.iter_unpack(e + "II", tiff[value : value + 8 * n])]
        return parts[0] if n == 1 else parts
    return None


def exif(data: bytes) -> dict:
    """The fields of TAGS and GPS_TAGS that an EXIF segment holds. Directories are read once each, however they
    point to each other; entries that lie outside the segment are passed over."""
    i = data.find(b"Exif\0\0")
    tiff = data[i + 6 :] if i >= 0 else b""
    if len(tiff) < 8:
        return {}
    e = "<" if tiff[:2] == b"II" else ">"
    out, seen, todo = {}, set(), [(struct.unpack_from(e + "I", tiff, 4)[0], TAGS)]
    while todo:
        at, names = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for p in range(at + 2, at + 2 + 12 * struct.unpack_from(e + "H", tiff, at)[0], 12):
            if p + 12 > len(tiff):
                break
            tag = struct.unpack_from(e + "H", tiff, p)[0]
            if names is TAGS and tag in (EXIF_DIRECTORY, GPS_DIRECTORY):
                todo.append((struct.unpack_from(e + "I", tiff, p + 8)[0], TAGS if tag == EXIF_DIRECTORY else GPS_TAGS))
            elif tag in names and (value := _value(tiff, e, p)) is not None:
                out[names[tag]] = value
    return out


def position(e: dict) -> tuple[float | None, float | None]:
    """Degrees north and east of exif fields, None where one is missing."""
    out = []
    for name, back in (("lat", "S"), ("lon", "W")):
        parts = e.get(name)
        whole = isinstance(parts, list) and len(parts) == 3 and None not in parts
        out.append((-1 if e.get(f"{name}_ref") == back else 1) * (parts[0] + parts[1] / 60 + parts[2] / 3600) if whole else None)
    return tuple(out)


def sensor_width(e: dict) -> float | None:
    """Width of the sensor in millimetres, from the pixels and their number in a unit of the focal plane."""
    pixels, per, unit = e.get("pixels_x"), e.get("plane_x_res"), UNIT_MM.get(e.get("plane_unit", 2))
    return pixels / per * unit if isinstance(pixels, int) and isinstance(per, float) and per > 0 and unit else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, focal, orientation, make, model, sensor, lat, lon) of image files: focal length and
    sensor width in millimetres, degrees; null where a file does not say."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for c in b.column(1):
                size, e = jpeg_size(c.as_py()) or (None, None), exif(c.as_py()[: 1 << 18])
                own = lambda name, kind: v if isinstance(v := e.get(name), kind) else None  # noqa: B023, E731
                rows.append((*size, own("focal", float), own("orientation", int), own("make", str), own("model", str), sensor_width(e), *position(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), t) for x, t in zip(cols, kinds, strict=True))], names=["path", "width", "height", "focal", "orientation", "make", "model", "sensor", "lat", "lon"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, width int, height int, focal double, orientation int, make string, model string, sensor double, lat double, lon double")
