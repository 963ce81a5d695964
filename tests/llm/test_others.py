import hashlib
import random
import zlib

import numpy as np
from rows import plain

from vistrack.llm import licenses, lm, media, pieces, warc


# ---- language models


def test_lm_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 2000)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = {r.doc_id: r for r in lm.query(spark, small).collect()}
    rows = docs.collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5}
    words = {r.doc_id: lm.WORD.findall((r.text or "").lower()) for r in rows}
    count = {}
    for w in words.values():
        for x in w:
            count[x] = count.get(x, 0) + 1
    top = sorted(count, key=lambda w: (-count[w], w))
    if len(top) > lm.VOCABULARY:
        top = [w for w in top[: lm.VOCABULARY] if count[w] > count[top[lm.VOCABULARY]]]
    vocabulary = {w: i for i, w in enumerate(top)}
    ids = {d: np.array([vocabulary.get(x, lm.VOCABULARY) for x in w], dtype=np.int64) for d, w in words.items()}
    models = []
    for own in (good, set(ids)):
        uni, big, starts = np.zeros(lm.VOCABULARY + 2, np.int64), np.zeros(lm.BUCKETS, np.int32), 0
        for d, v in ids.items():
            if d in own and len(v):
                starts += 1
                for x in v:
                    uni[x] += 1
                for c in lm.cells(v):
                    big[c] += 1
        models.append(lm.Model(uni, big, starts))
    for d, v in list(ids.items())[::7]:
        if len(v):
            a, b = (m.loss(v, lm.cells(v)).mean() for m in models)
            assert abs(got[d].score - (a - b)) < 1e-9 and got[d].n_tokens == len(v)


def test_lm_tells_good_from_bad_held_out(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    r = lm.query(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0 AND score IS NOT NULL").toPandas()
    a, b = r[r.quality == 0].score.to_numpy(), r[r.quality == 1].score.to_numpy()
    assert len(a) and (a[:, None] > b).mean() > 0.8


def test_lm_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for docs, n in ((odd_docs, 9), (no_docs, 0)):
        marked = lm.with_target(docs, none)
        rows = lm.score(docs, lm.train(marked, "_target")).collect()
        assert len(rows) == n and all((r.score is None) == (r.n_tokens == 0) for r in rows)


# ---- pieces


def test_pieces_equal_the_model_and_round_trip(spark, small):
    from sentencepiece import SentencePieceProcessor

    sp, codec = SentencePieceProcessor(model_file=pieces.model_path()), pieces.Codec(pieces.model_path())
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for t in [*texts, "", " ", "  a  b\n\n\tc   ", "日本語 текст 👍🏽 x", "a" * 3000, " " * 40 + "x", "=====----====" * 9, "²½ x².y"]:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t) and codec.decode(ids) == t


def test_streaming_window_is_bounded():
    codec = pieces.Codec(pieces.model_path())
    rng = random.Random(1)
    s = "▁" + "".join(rng.choice("abcdefghij") for _ in range(4000))
    stream, out, widest = pieces.Streaming(codec.v), [], 0
    for i in range(0, len(s), 3):
        out += stream.feed(s[i : i + 3])
        widest = max(widest, len(stream.tail))
    out += stream.end()
    assert "".join(out) == s and out == codec.v.short(s) and widest <= 3 * codec.v.max_piece


def test_neighbors_equal_merging():
    v = pieces.Vocabulary(pieces.model_path())
    rng, known = random.Random(2), [*v.halves]
    for _ in range(5000):
        a, b = rng.choice(known), rng.choice(known)
        assert v.neighbors(a, b) == (v.merge(a + b) == [a, b])


def test_pieces_odd_rows(spark, odd_docs, no_docs):
    rows = pieces.decode(pieces.encode(odd_docs)).collect()
    assert sorted(r.text for r in rows) == sorted(r.text or "" for r in odd_docs.collect())
    assert pieces.encode(no_docs).count() == 0


# ---- media


def test_media_round_trip(spark, odd_docs, no_docs, small):
    rows = media.decode(media.encode(odd_docs)).collect()
    texts = sorted((r.text or "").encode() for r in odd_docs.collect())
    assert sorted(bytes(r.payload[: r.n_bytes]) for r in rows) == texts
    assert all(len(r.payload) % 576 == 0 and set(r.payload[r.n_bytes :]) <= {255} and len(r.payload) > 0 for r in rows)
    assert media.encode(no_docs).count() == 0 and media.clips(media.encode(no_docs)).count() == 0
    q = {r.doc_id: r for r in media.query(spark, small).collect()}
    for d in spark.read.parquet(f"{small}/documents.parquet").collect()[::9]:
        raw = d.text.encode()
        raw += b"\xff" * (-len(raw) % 576 if raw else 576)
        r = q[d.doc_id]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))


def test_frames_of_any_samples():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 256, (50, 576)), np.full((2, 576), 255), np.zeros((2, 576)), np.tile([0, 255], 288)[None]]).astype(np.uint8)
    frames = media.encode_frames(x)
    assert (media.decode_frames(frames) == x).all()
    assert media.frames_of(media.avi(frames)) == frames and media.frames_of(b"RIFFxxxxJUNK") == [] and media.frames_of(None) == []


def test_shots(spark):
    dark, light = np.full((6, 576), 20, np.uint8), np.full((5, 576), 200, np.uint8)
    film = media.avi(media.encode_frames(np.concatenate([dark, light, dark])))
    got = media.clips(spark.createDataFrame([(1, bytearray(film)), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.clip, r.first_frame, r.n_frames, r.end_s) for r in got] == [(0, 0, 6, 0.24), (1, 6, 5, 0.44), (2, 11, 6, 0.68)]


# ---- archives


def test_warc_equals_sql(spark, small, duck):
    assert plain(warc.query(spark, small).toPandas()) == plain(duck.sql(warc.SQL).df())


def test_warc_copies_and_odd_rows(spark, no_docs):
    long = "x" * 1200 + "\r\n\r\nWARC/1.1 é"
    rows = [(1, "http://A.example.org/x?q=1#f", long), (9, "https://b.a.example.org:80/", long), (4, None, long), (2, "http://c.org/", "short"), (3, "http://c.org/", "short"), (5, "http://c.org/", None), (None, "http://c.org/ a", long), (9, "http://z.org", long), (6, "", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    digest = hashlib.sha1(long.encode()).hexdigest()
    assert [r.record_type for r in by[9]] == ["response"] * 2 and all(bytes(r.payload).decode() == long for r in by[9])
    for i in (1, 4, None):
        assert (by[i][0].record_type, by[i][0].refers_to, by[i][0].payload_digest, by[i][0].payload_bytes) == ("revisit", 9, digest, len(long.encode()))
    assert {by[i][0].record_type for i in (2, 3, 5, 6)} == {"response"} and by[5][0].payload_bytes == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_files_are_gzip_and_members_open_at_their_ranges(spark, tmp_path):
    import glob
    import gzip

    pages = spark.createDataFrame([(i, f"http://h{i % 5}.org/{i}", "<p>" + "é x" * (i % 900)) for i in range(300)], "page_id long, url string, html string")
    path = warc.archive(pages)
    found = warc.captures(spark, path).collect()
    assert len(found) == 300 and len({(r.file, r.offset) for r in found}) == 300
    for name in glob.glob(path.replace("file://", "") + "/*.txt"):
        raw = open(name, "rb").read()
        text = gzip.decompress(raw)
        own = sorted((r.offset, r.length) for r in found if r.file.endswith(name))
        assert b"".join(gzip.decompress(raw[o : o + n]) for o, n in own) == text and text.count(b"WARC/1.1") == len(own)
        with warc.opened("file://" + name) as f:
            assert list(warc.at_ranges(f, own)) == [raw[o : o + n] for o, n in own]
    # bytes that look like a separator inside a member do not end it
    fake = warc.member(b"a" * 50)
    stored = fake[:10] + b"\x01" + (len(warc.EMPTY)).to_bytes(2, "little") + (0xFFFF - len(warc.EMPTY)).to_bytes(2, "little") + warc.EMPTY
    import zlib as z

    stored += z.crc32(warc.EMPTY).to_bytes(4, "little") + len(warc.EMPTY).to_bytes(4, "little")
    assert [x[2] for x in warc.members(fake + warc.EMPTY + stored + warc.EMPTY + fake)] == [b"a" * 50, warc.EMPTY, b"a" * 50]


def test_whole_file_reads_give_the_same_rows(spark, small, monkeypatch):
    want = plain(warc.query(spark, small).toPandas())
    monkeypatch.setattr(warc, "opened", lambda path: None)
    for limit in (warc.RANGES, 0):
        monkeypatch.setattr(warc, "RANGES", limit)
        assert plain(warc.query(spark, small).toPandas()) == want


def test_rows_without_id_share_a_key(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD", 50)
    monkeypatch.setattr(warc, "BLOCK", 8)
    pages = spark.createDataFrame([(None, "http://a.org", f"p{i}") for i in range(400)] + [(i, "http://b.org", "q") for i in range(100)], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert len(got) == 500 and {bytes(r.payload).decode() for r in got if r.page_id is None} == {f"p{i}" for i in range(400)}


def test_lookup_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    rows = [("f", i, 1, 7 if i < 40 else i, f"http://h{i % 3}.org/{i if i >= 40 else 0}", "response", "d") for i in range(120)]
    found = spark.createDataFrame(rows, warc.CAPTURE)
    blocks = warc.index(found)
    from pyspark.sql import functions as F

    keys = found.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    got = warc.lookup(blocks, keys.union(spark.createDataFrame([("zz)/ 1",)], "key string"))).collect()
    assert sorted(r.offset for r in got) == list(range(120))


# ---- licences


def test_licences(spark, odd_docs, no_docs):
    texts = ["xx yy zz\nReleased under the MIT License.\nfoo", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.", "my driving license is lost", "", None, "permission to copy is not granted here by anyone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = licenses.train(spark, docs)
    got = {r.doc_id: r.families for r in licenses.scan(docs, m).collect()}
    assert got == {0: "MIT", 1: "CC-BY-NC", 2: "Apache-2.0,GPL-3.0", 3: "", 4: "", 5: "", 6: ""}
    assert licenses.scan(odd_docs, m).where("families = '' AND family = 'unknown'").count() == 9
    assert licenses.scan(no_docs, licenses.train(spark, no_docs)).count() == 0
