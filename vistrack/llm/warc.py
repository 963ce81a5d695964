"""WARC archives with a two-level capture index.

Writing. Every row becomes one WARC/1.1 record, built with SQL functions and compressed as a gzip member
of its own. Members are written by the text source, with an empty gzip member as line separator, so files
are valid gzip files, committed like any other output, and lie wherever Spark writes; a file holds at
most FILE_RECORDS records, fewer if records are long. Of records with equal payloads of at least 1000
bytes the one with the largest id is the response, the others are revisits without payload.

Index. Archives are read as binary files and cut into members. Captures are sorted by reversed-host URL
key (and id, then place), range-partitioned into shards of about SHARD captures and packed into
compressed blocks of BLOCK lines; the sparse directory has the first key of each block. A lookup finds the shard by binary
search on the shards' first keys, the block by binary search on the shard's directory, the line by
binary search in the block, and then reads the byte range of the record: tasks open the files at the
ranges. In a store that only Spark's readers open, they read the files whole (binaryFile), but inflate the
members at the ranges only.

Edge cases: null html is an empty payload; null urls sort first under an empty host; a null id is the
smallest; captures that share a key (null ids of one url) may fill many shards; rows repeated with the
winning id are all responses; repeated rows give records of their
own; extra columns are ignored; an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistrack.session import join_checked, shared_dir, stored

LEAST_REVISIT = 1000
#: Records of a file at most; bytes of uncompressed records of a file at most (or one record).
FILE_RECORDS, FILE_BYTES = 2000, 1 << 30
#: Captures of a block; captures of a shard, about.
BLOCK, SHARD = 256, 1 << 16
#: Where files are read whole: ranges travel by broadcast up to this many captures, else by a shuffle join.
RANGES = 200_000
#: Ranges of a file at most so many bytes apart are read at once, up to READ bytes.
GAP, READ = 1 << 16, 4 << 20
#: The separator of members: a gzip member of no bytes.
EMPTY = bytes.fromhex("1f8b080000000000000303000000000000000000")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def surt(url: Column) -> Column:
    """Reversed-host key: com,example,www)/path?query, host in lower case, scheme and fragment gone."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[\x00-\x20]|#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?:]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, r"^[^/?]*", ""))


def capture_key(url: Column, page_id: Column) -> Column:
    return F.concat(surt(url), F.lit(" "), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("")))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)], F.lit(">"))


def write(pages: DataFrame, path: str) -> None:
    """One record per row of pages (page_id, url, html) under path."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.select("*", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").cast("long").alias("n"))
    twice = p.where(F.col("n") >= LEAST_REVISIT).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    longest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    per_file = max(1, min(FILE_RECORDS, FILE_BYTES // (longest + 4096)))
    p = join_checked(p, stored(twice, "warc-copies"), "sha", "left")
    revisit = (F.col("n") >= LEAST_REVISIT) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", _urn(F.col("page_id"), F.col("url"), F.col("sha"))), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha")), line("X-Payload-Length", F.col("n").cast("string")), F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("X-Refers-To-Page", F.col("keeper").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 256):
                yield pa.RecordBatch.from_arrays([pa.array([member(x.as_py()) for x in b.column(0).slice(i, 256)], pa.binary())], names=["value"])

    members = p.select(F.concat(record, F.lit("\r\n\r\n")).cast("binary").alias("r")).mapInArrow(packed, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", per_file).text(path)


def member(record: bytes) -> bytes:
    """A gzip member; its header names neither time nor file."""
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def members(raw: bytes):
    """(offset, length, record) of each member that is not empty. A member ends at a separator; bytes that
    only look like one do not end it."""
    at = 0
    while at < len(raw):
        end = raw.find(EMPTY, at + 1)
        while True:
            stop = len(raw) if end < 0 else end
            d = zlib.decompressobj(31)
            record = d.decompress(raw[at:stop])
            if d.eof and not d.unused_data:
                break
            if end < 0:
                raise ValueError(f"no whole gzip member at {at}")
            end = raw.find(EMPTY, end + 1)
        yield at, stop - at, record
        at = stop + len(EMPTY)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    if not record.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    stop = record.index(b"\r\n\r\n")
    headers = {}
    for h in record[:stop].split(b"\r\n")[1:]:
        name, _, value = h.partition(b":")
        headers[name.decode().lower()] = value.strip().decode()
    body = stop + 4
    return headers, record[body : body + int(headers["content-length"])]


def files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")


def opened(path: str):
    """A file that can be read at any place, or None where only Spark's readers open it."""
    from pyarrow import fs

    try:
        store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        return store.open_input_file(name)
    except (OSError, ValueError, NotImplementedError):
        return None


CAPTURE = "file string, offset long, length long, page_id long, url string, type string, digest string"


def captures(spark, path: str) -> DataFrame:
    """One row per record found in the archives."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                found = ((at, n, parse(record)[0]) for at, n, record in members(content.as_py()))
                rows = [(name.as_py(), at, n, int(h["x-page-id"]) if "x-page-id" in h else None, h.get("warc-target-uri", ""), h["warc-type"], h.get("warc-payload-digest", "")) for at, n, h in found]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=shape)

    import pyarrow as pa

    shape = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("digest", pa.string())])
    names = shape.names
    return files(spark, path).mapInArrow(run, CAPTURE)


def index(found: DataFrame) -> DataFrame:
    """Blocks (shard, block, first_key, n, data) of the captures; the directory is all but data."""
    lines = found.select(capture_key(F.col("url"), F.col("page_id")).alias("key"), F.concat_ws("\t", "file", F.col("offset").cast("string"), F.col("length").cast("string")).alias("rest"))
    lines = stored(lines, "warc-captures")
    shards = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // SHARD))
    lines = lines.repartitionByRange(shards, "key", "rest").sortWithinPartitions("key", "rest")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, n, keys, rests = TaskContext.get().partitionId(), 0, [], []

        def block():
            data = zlib.compress("\n".join(f"{k}\t{r}" for k, r in zip(keys, rests, strict=True)).encode(), 6)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([n], pa.int32()), "first_key": [keys[0]], "n": pa.array([len(keys)], pa.int32()), "data": [data]})

        for b in batches:
            for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(k), rests.append(r)
                if len(keys) == BLOCK:
                    yield block()
                    n, keys, rests = n + 1, [], []
        if keys:
            yield block()

    return stored(lines.mapInArrow(run, "shard int, block int, first_key string, n int, data binary"), "warc-index")


def lookup(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (key, file, offset, length) of all captures with one of the distinct keys (column key).

    A key that was captured several times may run over several blocks and shards: the search starts at
    the last block whose first key is smaller and goes on while keys are equal.
    """
    spark = blocks.sparkSession
    firsts = [(r["shard"], r["k"]) for r in blocks.groupBy("shard").agg(F.min("first_key").alias("k")).orderBy("k", "shard").collect()]
    # one entry a shard: their number is that of the range partitions, not of captures
    starts = spark.sparkContext.broadcast(([k for _, k in firsts], [s for s, _ in firsts]))

    def route(batches):
        import pyarrow as pa

        firsts, shards = starts.value
        for b in batches:
            at, shard = [], []
            for i, k in enumerate(b.column(0).to_pylist()):
                lo, hi = max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k)
                for j in range(lo, hi):
                    at.append(i), shard.append(shards[j])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(shard, pa.int32())], names=["key", "shard"])

    def search(wanted, own):
        import pyarrow as pa

        order = sorted(range(own.num_rows), key=lambda i: own["block"][i].as_py())
        firsts = [own["first_key"][i].as_py() for i in order]
        out, opened = [], {}
        for k in sorted(wanted["key"].to_pylist()):
            lo, hi = max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k)
            opened = {j: v for j, v in opened.items() if j >= lo}
            for j in range(lo, hi):
                if j not in opened:
                    text = [x.split("\t") for x in zlib.decompress(own["data"][order[j]].as_py()).decode().split("\n")]
                    opened[j] = ([x[0] for x in text], text)
                names, text = opened[j]
                out += text[bisect.bisect_left(names, k) : bisect.bisect_right(names, k)]
        return pa.table({"key": pa.array([x[0] for x in out], pa.string()), "file": pa.array([x[1] for x in out], pa.string()), "offset": pa.array([int(x[2]) for x in out], pa.int64()), "length": pa.array([int(x[3]) for x in out], pa.int64())})

    routed = keys.select("key").distinct().mapInArrow(route, "key string, shard int")
    return routed.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInArrow(search, "key string, file string, offset long, length long")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_row(record: bytes, with_payload: bool) -> tuple:
    """What RECORD holds of one record."""
    h, block = parse(record)
    payload, size, digest = None, int(h["x-payload-length"]), h["warc-payload-digest"].partition(":")[2]
    if h["warc-type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return (int(h["x-page-id"]) if "x-page-id" in h else None, h.get("warc-target-uri", ""), h["warc-type"], size, digest, int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None, payload if with_payload else None)


def at_ranges(file, ranges: list[tuple[int, int]]):
    """The bytes at each (offset, length), neighbors read at once."""
    ranges, i = sorted(ranges), 0
    while i < len(ranges):
        start, stop, j = ranges[i][0], sum(ranges[i]), i + 1
        while j < len(ranges) and ranges[j][0] <= stop + GAP and sum(ranges[j]) - start <= READ:
            stop, j = max(stop, sum(ranges[j])), j + 1
        raw = file.read_at(stop - start, start)
        for offset, length in ranges[i:j]:
            yield raw[offset - start : offset - start + length]
        i = j


def read(spark, path: str, ranges: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the ranges (file, offset, length): a revisit has the length and digest of the
    payload it stands for and no payload. Only ranges are shuffled where files open at any place."""
    import pyarrow as pa

    names, kinds = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    ranges = stored(ranges, "warc-ranges")
    per_file = ranges.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))  # at most FILE_RECORDS each

    def batches_of(records):
        rows, size = [], 0
        for r in records:
            rows.append(record_row(zlib.decompress(r, 31), with_payload))
            size += len(rows[-1][6] or b"")
            if len(rows) == 500 or size > READ:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def seek(batches):
        for b in batches:
            for name, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with opened(name) as file:
                    yield from batches_of(at_ranges(file, [(r["offset"], r["length"]) for r in wanted]))

    def whole(batches):
        for b in batches:
            for content, wanted in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = content.as_py()
                yield from batches_of(raw[r["offset"] : r["offset"] + r["length"]] for r in wanted)

    some = ranges.select("file").head()
    if some and (file := opened(some[0])):
        file.close()
        return per_file.mapInArrow(seek, RECORD)
    joined = join_checked(files(spark, path), per_file, "path", "inner", rows=ranges.count(), limit=RANGES)
    return joined.select("content", "ranges").mapInArrow(whole, RECORD)


def archive(pages: DataFrame) -> str:
    """Write pages to a new archive folder in the shared folder; its path."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return path


def round_trip(pages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Archive pages, index the archive, look every page's key up and read its record by range."""
    spark = pages.sparkSession
    path = archive(pages)
    blocks = index(captures(spark, path))
    keys = pages.select(capture_key(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", ""), F.col("page_id").cast("long")).alias("key"))
    return read(spark, path, lookup(blocks, keys), with_payload)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return round_trip(pages, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
                  strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
