"""The rows of op9 and op10 against plain versions, column by column."""

import hashlib
import struct
import zlib

import numpy as np

from vistrack.llm import media, pieces


def test_pieces_query_equals_the_library(spark, small):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.model_path())
    got = {r.doc_id: r for r in pieces.query(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = sp.encode(d.text or "")
        r = got[d.doc_id]
        assert (r.n_chars, r.n_ids, r.ids_crc32) == (len(d.text or ""), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha1 == hashlib.sha1((d.text or "").replace(pieces.BLANK, " ").encode()).hexdigest()


def plain_frame(samples):
    """A lossless frame, sample by sample, as a string of bits."""
    table, code, k = {}, 0, 0
    for length, n in enumerate(media.DC_BITS, 1):
        for _ in range(n):
            table[media.DC_VALUES[k]] = f"{code:0{length}b}"
            code, k = code + 1, k + 1
        code *= 2
    bits = ""
    for i, x in enumerate(samples):
        row, col = divmod(i, 24)
        before = 128 if i == 0 else samples[i - 24] if col == 0 else samples[i - 1]
        d = x - before
        cat = abs(d).bit_length()
        bits += table[cat] + (f"{d if d > 0 else d + (1 << cat) - 1:0{cat}b}" if cat else "")
    bits += "1" * (-len(bits) % 8)
    data = b"".join(bytes([b]) + (b"\0" if b == 255 else b"") for b in int(bits, 2).to_bytes(len(bits) // 8, "big"))
    head = b"\xff\xd8\xff\xc4" + struct.pack(">HB", 19 + len(media.DC_VALUES), 0) + bytes(media.DC_BITS) + bytes(media.DC_VALUES)
    head += b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, 24, 24, 1, 1, 0x11, 0) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
    return head + data + b"\xff\xd9"


def plain_feature(frames):
    """Shots by differences of histograms, one frame after another."""
    hists = [[sum(x // 16 == b for x in f) for b in range(16)] for f in frames]
    cuts, recent = [0], []
    for i in range(1, len(frames)):
        d = sum(abs(a - b) for a, b in zip(hists[i - 1], hists[i])) / 1152
        mean = sum(recent) / len(recent) if recent else 0.0
        sd = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > 0.15 and len(recent) >= 2 and d > mean + 3 * sd:
            cuts.append(i)
            recent = []
        else:
            recent = [*recent, d][-12:]
    tops = []
    for a, b in zip(cuts, [*cuts[1:], len(frames)]):
        total = [sum(h[k] for h in hists[a:b]) for k in range(16)]
        tops.append(total.index(max(total)))
    return f"frames={len(frames)};shots={','.join(map(str, cuts))};grey={','.join(map(str, tops))}"


def test_media_query_equals_a_plain_writer(spark, small):
    got = {r.doc_id: r for r in media.query(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    short = sorted(docs, key=lambda d: len(d.text or ""))[:120:3] + sorted(docs, key=lambda d: len(d.text or ""))[-2:]
    for d in short:
        raw = (d.text or "").encode()
        n, raw = len(raw), raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        frames = [raw[i : i + 576] for i in range(0, len(raw), 576)]
        film = media.avi([plain_frame(f) for f in frames])
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(film), hashlib.sha256(film).hexdigest(), plain_feature(frames))


def test_film_has_the_chunks_of_its_format():
    """RIFF sizes, index entries and the frames they point at, read by hand."""
    frames = [plain_frame(bytes([i] * 576)) for i in (0, 7, 255)]
    film = media.avi(frames)
    assert film[:4] == b"RIFF" and struct.unpack_from("<I", film, 4)[0] == len(film) - 8 and film[8:12] == b"AVI "
    at = film.index(b"idx1")
    entries = list(struct.iter_unpack("<4sIII", film[at + 8 : at + 8 + struct.unpack_from("<I", film, at + 4)[0]]))
    movi = film.index(b"movi")
    assert [film[movi + o + 8 : movi + o + 8 + n] for _, _, o, n in entries] == frames


def test_odd_rows_of_both(spark, odd_docs, no_docs):
    assert pieces.digest(odd_docs).count() == 9 and pieces.digest(no_docs).count() == 0
    rows = media.digest(media.put(odd_docs)).collect()
    assert len(rows) == 9 and {r.payload_bytes for r in rows if r.n_bytes == 0} == {576} and media.digest(media.put(no_docs)).count() == 0
    assert len({r.media_sha256 for r in rows if r.doc_id in (2, 3)}) == 1
