"""Media columns: AVI files of lossless motion-JPEG frames, their index, frames and shots.

A payload is cut into frames of 24 x 24 grey samples of eight bits. Each frame is a JPEG of the
lossless process (SOF3, left predictor, a code table of its own), so bytes come back exactly; frames
stand in the movi list of a RIFF AVI file with an idx1 index. Reading back parses the RIFF chunks,
follows the index, decodes every frame (all are intra frames) and compares grey histograms of
neighbors: a cut is where the difference exceeds the mean of the shot's latest differences by a
multiple of their deviation. Shots become timed clip rows.

Frames of many rows are coded side by side with numpy, in chunks of bounded size. The media column is
written as a table into the shared folder and read back before anything is decoded from it.

Edge cases: null and empty texts are one frame of padding; repeated rows give equal media; null ids are
kept; an empty table gives no rows; media that is null or no AVI file has no frames and no clips. A cell of
a table holds less than 2 GB, so sizes stay far below the 32 bits of a RIFF size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrack.session import stored

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: Frames coded at once.
CHUNK = 6144
#: Rows taken up at once; bytes of a row group of stored media.
SLICE, ROW_GROUP = 1000, 4 << 20
#: Code table: number of codes of each length 1..16, and the categories (bits of a difference, 8 at most)
#: from the most to the least frequent in text of single bytes.
DC_BITS = (0, 2, 2, 2, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = (7, 4, 3, 0, 5, 2, 1, 6, 8)
#: Shots: grey bins, latest differences looked at, deviations above their mean, least difference.
BINS, WINDOW, DEVIATIONS, LEAST = 16, 12, 3.0, 0.15


def codes(bits=DC_BITS, values=DC_VALUES) -> list[tuple[int, int, int]]:
    """(category, code, length) in canonical order."""
    out, code, k = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((values[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def tables(bits=DC_BITS, values=DC_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: difference and bits used (0: no code)."""
    diff, used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
    for cat, code, length in codes(bits, values):
        if length + cat > 16:
            continue
        for extra in range(1 << cat):
            d = extra if cat and extra >> (cat - 1) else extra - (1 << cat) + 1 if cat else 0
            at = ((code << cat) | extra) << (16 - length - cat)
            diff[at : at + (1 << (16 - length - cat))] = d
            used[at : at + (1 << (16 - length - cat))] = length + cat
    return diff, used


HEAD = (
    b"\xff\xd8\xff\xc4" + struct.pack(">HB", 19 + len(DC_VALUES), 0) + bytes(DC_BITS) + bytes(DC_VALUES)
    + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of n x 576 samples."""
    x = samples.reshape(-1, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d = d.reshape(-1, FRAME)
    value, length = np.zeros(512, np.uint64), np.zeros(512, np.int64)
    by = {c: (code, n) for c, code, n in codes()}
    for v in range(-255, 256):
        cat = abs(v).bit_length()
        value[v + 255] = (by[cat][0] << cat) | (v if v > 0 else v + (1 << cat) - 1 if cat else 0)
        length[v + 255] = by[cat][1] + cat
    d = d + 255
    val, n = value[d], length[d]
    while val.shape[1] > FRAME // 4:  # four samples take at most 56 bits
        val, n = (val[:, ::2] << n[:, 1::2].astype(np.uint64)) | val[:, 1::2], n[:, ::2] + n[:, 1::2]
    total = n.sum(1)
    size = (total + 7) // 8
    first = np.concatenate([[0], np.cumsum(size)])
    at = (first[:-1, None] * 8 + np.cumsum(n, 1) - n).ravel()
    val, n = val.ravel(), n.ravel()
    val = val << (64 - n - (at & 7)).astype(np.uint64)
    out = np.zeros(first[-1] + 8, np.uint8)
    base = at >> 3
    for k in range(8):  # within a pass all places differ, as four samples take at least eight bits
        out[base + k] |= ((val >> np.uint64(56 - 8 * k)) & np.uint64(255)).astype(np.uint8)
    out[first[1:] - 1] |= ((1 << (size * 8 - total)) - 1).astype(np.uint8)
    out = out[: first[-1]]
    ff = out == 255
    moved = np.arange(len(out)) + np.cumsum(ff) - ff
    wide = np.zeros(len(out) + int(ff.sum()), np.uint8)
    wide[moved] = out
    ends = np.concatenate([[0], (first[1:] + np.cumsum(ff)[first[1:] - 1])]).tolist()
    raw = wide.tobytes()
    return [HEAD + raw[a:b] + b"\xff\xd9" for a, b in zip(ends, ends[1:], strict=False)]


def parse_jpeg(frame: bytes) -> tuple[int, tuple, tuple]:
    """Start of the entropy-coded data, code table and (height, width) of a lossless grey frame."""
    at, table, shape = 2, None, None
    while True:
        if frame[at] != 255:
            raise ValueError("no JPEG marker")
        marker, (size,) = frame[at + 1], struct.unpack_from(">H", frame, at + 2)
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC4:
            table = (tuple(body[1:17]), tuple(body[17 : 17 + sum(body[1:17])]))
        elif marker == 0xC3:
            shape = struct.unpack(">HH", body[1:5])
        at += 2 + size
        if marker == 0xDA:
            return at, table, shape


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """n x 576 samples of JPEG files with one common header."""
    if not frames:
        return np.zeros((0, FRAME), np.uint8)
    start, table, shape = parse_jpeg(frames[0])
    head = frames[0][:start]
    if shape != (SIDE, SIDE) or not all(f.startswith(head) and f.endswith(b"\xff\xd9") for f in frames):
        raise ValueError("frames differ in form")
    raw = np.frombuffer(b"".join([f[start:-2] for f in frames]), np.uint8)
    ends = np.cumsum([len(f) - start - 2 for f in frames])
    stuffed = np.zeros(len(raw), bool)
    stuffed[1:] = (raw[1:] == 0) & (raw[:-1] == 255)
    lost = np.cumsum(stuffed)
    data = np.concatenate([raw[~stuffed], np.zeros(4, np.uint8)]).astype(np.uint32)
    first = np.concatenate([[0], ends[:-1] - lost[ends[:-1] - 1]])
    words = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    diff, used = tables(*table)
    p, d = first * 8, np.empty((FRAME, len(frames)), np.int32)
    for k in range(FRAME):  # all frames step by step side by side
        w = (words[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF
        d[k] = diff[w]
        p = p + used[w]
    x = d.T.reshape(-1, SIDE, SIDE).copy()
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1) + 128
    return np.cumsum(x, axis=2).astype(np.uint8).reshape(-1, FRAME)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes]) -> bytes:
    n, most = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", FRAME * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    at, index = 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    movi = b"movi" + b"".join([b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1) for f in frames])
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", movi) + chunk(b"idx1", b"".join(index)))


def frames_of(media: bytes | None) -> list[bytes]:
    """Frames by the index of an AVI file; none if it is no such file."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        return []
    at, movi, index = 12, None, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None:
        return []
    return [media[movi + o + 8 : movi + o + 8 + n] for name, _, o, n in struct.iter_unpack("<4sIII", index) if name[2:] == b"dc"]


def cuts_of(samples: np.ndarray) -> list[int]:
    """First frames of the shots, 0 among them."""
    n = len(samples)
    hist = np.bincount((np.arange(n)[:, None] * BINS + samples // (256 // BINS)).ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = (np.abs(np.diff(hist, axis=0)).sum(1) / (2 * FRAME)).tolist()
    cuts, recent = [0], []
    for i, d in enumerate(diff, 1):
        mean = sum(recent) / len(recent) if recent else 0.0
        sd = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > LEAST and len(recent) >= 2 and d > mean + DEVIATIONS * sd:
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[1 - WINDOW :], d]
    return cuts


def shots_of(samples: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot."""
    if not len(samples):
        return []
    cuts = cuts_of(samples)
    return list(zip(cuts, [*cuts[1:], len(samples)], strict=True))


def feature_of(samples: np.ndarray) -> str:
    """Frames, first frames of the shots, most frequent grey bin of each shot."""
    shots = shots_of(samples)
    tops = [int(np.bincount(samples[i:j].ravel() // (256 // BINS), minlength=BINS).argmax()) for i, j in shots]
    return f"frames={len(samples)};shots={','.join(str(i) for i, _ in shots)};grey={','.join(map(str, tops))}"


def _payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (FRAME - len(raw) if not raw else -len(raw) % FRAME), len(raw)


def _groups(sizes: list[int]):
    """Runs of rows with at most CHUNK frames together (or one row)."""
    a = n = 0
    for i, s in enumerate(sizes):
        if n and n + s > CHUNK:
            yield a, i
            a, n = i, 0
        n += s
    if sizes:
        yield a, len(sizes)


def _batched(frames, function):
    for i in range(0, len(frames), CHUNK):
        yield function(frames[i : i + CHUNK])


def encoded(batches, id_col: str):
    """Batches of (id, text) as batches of (id, n_bytes, media) of about CHUNK frames."""
    import pyarrow as pa

    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            b = whole.slice(start, SLICE)
            loads = [_payload(t.as_py()) for t in b.column(1)]
            for i, j in _groups([len(p) // FRAME for p, _ in loads]):
                part = loads[i:j]
                samples = np.frombuffer(b"".join([p for p, _ in part]), np.uint8).reshape(-1, FRAME)
                frames = [f for x in _batched(samples, encode_frames) for f in x]
                at, out = 0, []
                for p, _ in part:
                    out.append(avi(frames[at : at + len(p) // FRAME]))
                    at += len(p) // FRAME
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([n for _, n in part], pa.int64()), pa.array(out, pa.binary())], names=[id_col, "n_bytes", "media"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media): the text's payload as an AVI file in a binary column."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(id_col, F.col(text_col).cast("string").alias("t")).mapInArrow(lambda batches: encoded(batches, id_col), schema)


def _decoded(batch, media_col: str):
    """(row, media, samples) of each row of a batch."""
    column = batch.column(batch.schema.get_field_index(media_col))
    frames = [frames_of(m.as_py()) for m in column]
    for i, j in _groups([len(f) for f in frames]):
        flat = [x for f in frames[i:j] for x in f]
        parts = list(_batched(flat, decode_frames))
        samples = np.concatenate(parts) if parts else np.zeros((0, FRAME), np.uint8)
        at = 0
        for k in range(i, j):
            n = len(frames[k])
            yield k, samples[at : at + n]
            at += n


def decode(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Rows (id, n_bytes, payload, media, feature): what the stored frames hold and how they look.

    feature: frames, first frames of the shots, then the most frequent grey bin of each shot.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k, samples in _decoded(b, media_col):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([samples.tobytes()], pa.binary()), b.column(2).slice(k, 1), pa.array([feature_of(samples)])], names=names)

    names = [id_col, "n_bytes", "payload", "media", "feature"]
    schema = T.StructType([media.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("media", T.BinaryType()), T.StructField("feature", T.StringType())])
    return media.select(id_col, "n_bytes", F.col(media_col).alias("media")).mapInArrow(run, schema)


def put(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media column as a table in the shared folder: rows (id, n_bytes, media), read back from there.
    Row groups are small, so that neither side holds more than a few megabytes of media at once."""
    return stored(encode(docs, id_col, text_col), "media", **{"parquet.block.size": ROW_GROUP, "parquet.page.size": ROW_GROUP, "parquet.enable.dictionary": "false"})


def digest(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per row of a media table: sizes and digests of the payload decoded from the media, and its feature."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                rows, own = [], b.column(2)
                for k, samples in _decoded(b, "media"):
                    raw, m = samples.tobytes(), own[k].as_py() or b""
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(samples)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], names=names)

    long, text = T.LongType(), T.StringType()
    schema = T.StructType([media.schema[id_col], *(T.StructField(n, t) for n, t in (("n_bytes", long), ("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text)))])
    names = schema.names
    return media.select(id_col, "n_bytes", F.col(media_col).alias("media")).mapInArrow(run, schema)


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Rows (id, clip, first_frame, n_frames, start_s, end_s), one a shot."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at, rows = [], []
            for k, samples in _decoded(b, "media"):
                for c, (i, j) in enumerate(shots_of(samples)):
                    at.append(k)
                    rows.append((c, i, j - i, i / FPS, j / FPS))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], names=schema.names)

    schema = T.StructType([media.schema[id_col], *(T.StructField(n, t) for n, t in (("clip", T.IntegerType()), ("first_frame", T.IntegerType()), ("n_frames", T.IntegerType()), ("start_s", T.DoubleType()), ("end_s", T.DoubleType())))])
    return media.select(id_col, F.col(media_col).alias("media")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(put(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
