"""Fill-in-middle transformation over an index of distinct texts.

Equal texts are cut at different places but have the same units, so units are found once a text. Rows are grouped by
the SHA-256 of their texts, and a group's texts are compared with each other (a set of one, else an error). Of each
text the ends of its units are kept as an Elias-Fano list: a code point count of U and n units take about
2 + log2(U / n) bits a unit. The index is joined back to the documents, and each document selects its two seeded
boundaries from the list: the k-th end is found by counting ones, without reading the text or the other ends.

A text is shuffled once: lists and documents (id and key only) come to the groups where these are built. A group of more than PER_ENTRY documents has an entry for each PER_ENTRY of them (by a hash of the document's
columns), so copies that hold a third of all rows are many tasks' work. Rows equal in all columns share an entry.

Edge cases: null and empty texts have no units and stay plain; a text that contains a marker stays plain; a null id
counts as an empty number in the seed; rows that repeat are transformed alike; an empty table gives no rows. Texts
are read whole. Columns of type map take no part in the hash; other columns are not carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistrack.session import join_checked, stored

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed; per cent of texts that are transformed, and of these that put the suffix first.
SEED, RATE, SPM = 42, 50, 80
#: Documents that one entry of the index serves.
PER_ENTRY = 1024


def unit_ends(text: str):
    """Ends of the units, in code points, as an increasing array. A unit is white space and the word behind it; white
    space at the end is a unit of its own."""
    import numpy as np

    at = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(at):
        return np.zeros(0, np.int64)
    word = (at != 0x20) & ((at < 0x09) | (at > 0x0D))
    ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    return ends if word[-1] else np.append(ends, len(at))


def low_bits(n: int, top: int) -> int:
    """Bits of each value that are kept as they are; the rest is counted out in ones."""
    return max(0, (top // n).bit_length() - 1) if n else 0


def elias_fano(ends) -> bytes:
    """An increasing list: low bits packed, then for the i-th value a one at its high part plus i."""
    import numpy as np

    n = len(ends)
    if not n:
        return b""
    low = low_bits(n, int(ends[-1]))
    lows = np.packbits((ends[:, None] >> np.arange(low)) & 1 != 0, bitorder="little").tobytes()
    high = np.zeros((int(ends[-1]) >> low) + n, bool)
    high[(ends >> low) + np.arange(n)] = True
    return lows + np.packbits(high, bitorder="little").tobytes()


def select(listed: bytes, n: int, top: int, k: int) -> int:
    """The k-th value (from 1) of a list of n values, of which the last is top; zero for k = 0."""
    import numpy as np

    if not k:
        return 0
    low = low_bits(n, top)
    start = (n * low + 7) // 8
    ones = np.bitwise_count(np.frombuffer(listed, np.uint8, offset=start)).cumsum()
    at = int(np.searchsorted(ones, k))
    byte, rest = listed[start + at], k - (int(ones[at - 1]) if at else 0)
    for _ in range(rest - 1):
        byte &= byte - 1
    high = 8 * at + (byte & -byte).bit_length() - 1 - (k - 1)
    first = (k - 1) * low
    kept = int.from_bytes(listed[first // 8 : (first + low + 7) // 8], "little") >> first % 8 & (1 << low) - 1
    return high << low | kept


def _selected(ends, n, top, lo, hi):
    """struct(lo, hi): two ends of each list."""
    import pyarrow as pa

    got = [[select(e.as_py(), *(int(x.as_py()) for x in (m, t, k))) for e, m, t, k in zip(ends, n, top, ks, strict=True)] for ks in (lo, hi)]
    return pa.StructArray.from_arrays([pa.array(g, pa.int64()) for g in got], names=["lo", "hi"])


def distinct_texts(docs: DataFrame, text_col: str, entry: Column, large: DataFrame) -> DataFrame:
    """(key, entry, text): the distinct texts, one row for each entry of a text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(text_key(text).alias("key"), entry.alias("h"), text.alias("text"))
    rows = join_checked(rows, large, "key", "left").select("key", _entry().alias("entry"), "text")
    groups = rows.groupBy("key", "entry").agg(F.collect_set("text").alias("same"))
    one = F.when(F.size("same") == 1, F.get("same", F.lit(0))).otherwise(F.raise_error(F.lit("different texts share a digest")).cast("string"))
    return groups.select("key", "entry", one.alias("text"))


def boundaries(texts: DataFrame) -> DataFrame:
    """(key, entry, n, top, ends): number of units, end of the last one and the list of all ends of each text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, top, listed = [], [], []
            for t in b.column(2):
                ends = unit_ends(t.as_py())
                n.append(len(ends))
                top.append(int(ends[-1]) if len(ends) else 0)
                listed.append(elias_fano(ends))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(n, pa.int64()), pa.array(top, pa.int64()), pa.array(listed, pa.binary())], names=["key", "entry", "n", "top", "ends"])

    return texts.select("key", "entry", "text").mapInArrow(run, "key string, entry long, n long, top long, ends binary")


def text_key(text: Column) -> Column:
    """SHA-256; plainly not null, so that no side of a join gets a filter of its own and the shuffle of the texts
    serves both."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def _entry() -> Column:
    return F.coalesce(F.pmod("h", F.coalesce("entries", F.lit(1))), F.lit(0).cast("long"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, per_entry: int = PER_ENTRY) -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output): n units, the form (plain, psm or spm), the code points
    of prefix and middle (null if plain) and the text in that form."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text_col and "map<" not in f.dataType.simpleString()]
    own = F.xxhash64(*hashed)
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("id"), text_key(text).alias("key"), own.alias("h")), "fim-rows")
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > per_entry)
    large = stored(large.select("key", F.ceil(F.col("n") / per_entry).cast("int").alias("entries")), "fim-large")
    rows = join_checked(rows, large, "key", "left").select("id", "key", _entry().alias("entry"))
    texts = distinct_texts(docs, text_col, own, large)
    # the lists come from the shuffled texts; only they and the ids move to join the texts where these are
    both = texts.join(boundaries(texts), ["key", "entry"]).join(rows, ["key", "entry"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    part = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")
    cut = both.withColumn("digest", digest).select("id", "text", "n", "top", "ends", *(part(i).alias(f"h{i + 1}") for i in range(4)))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    ends = F.arrow_udf(_selected, "struct<lo:long,hi:long>")
    cut = cut.select("id", "text", "n", form.alias("form"), ends("ends", "n", "top", F.least(a, b), F.greatest(a, b)).alias("at"))
    lo, hi = F.col("at.lo").cast("int"), F.col("at.hi").cast("int")
    prefix, middle, suffix = F.substr("text", F.lit(1), lo), F.substr("text", lo + 1, hi - lo), F.substr("text", hi + 1)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cutting = F.col("form") != "plain"
    return cut.select(F.col("id").alias(id_col), "n", "form", F.when(cutting, F.col("at.lo")).alias("prefix_chars"), F.when(cutting, F.col("at.hi") - F.col("at.lo")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output, from the output and its form alone."""
    p = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(p, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def query(spark, sf_dir: str) -> DataFrame:
    got = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM p"""
