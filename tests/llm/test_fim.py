"""Fill-in-middle against a plain version; Elias-Fano lists against the lists themselves."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from vistrack.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    text, d = text or "", sha(f"42:{'' if doc_id is None else doc_id}")
    units, h = UNIT.findall(text), [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def result(df):
    back = fim.restored(F.col("output"), F.col("form"))
    got = df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(back, 256)).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_lists_hold_all_ends():
    rng = random.Random(3)
    for n, top in ((0, 0), (1, 1), (1, 5000), (7, 7), (200, 1000), (3000, 3000), (900, 70_000), (2, 1 << 40)):
        ends = np.array(sorted({*rng.sample(range(1, top), n - 1), top}) if n else [], np.int64)
        listed = fim.elias_fano(ends)
        assert [fim.select(listed, n, top, k) for k in range(n + 1)] == [0, *ends.tolist()]
        if n:
            assert len(listed) <= n * (2 + max(0, np.log2(top / n))) / 8 + 2


def test_units():
    for text in ("", " ", "a", " a", "a ", "\ta\n\nb \x0b", "é  x 👍🏽  ", "\x1c\x1f \x85"):
        ends = np.cumsum([len(u) for u in UNIT.findall(text)]).tolist()
        assert fim.unit_ends(text).tolist() == ends


def test_odd_rows(spark, odd_docs):
    more = [(i, t, "x", 1, "w", "uid") for i, t in enumerate(["<P>a b c", "x <S", "> <M y", "a<P b>c d e", " lead and trail \n", "<<P <S> x", "one two <S\n"] * 8, 100)]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema))
    assert result(fim.fill_in_middle(docs)) == sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=repr)


def test_many_copies_have_entries_of_their_own(spark):
    """Copies beyond PER_ENTRY are dealt to several entries; each is cut by its own seed."""
    text = "the same words again and again\n in every copy "
    docs = spark.createDataFrame([(i, text if i % 3 else f"{text}{i}", i) for i in range(600)], "doc_id long, text string, entry int")
    got = result(fim.fill_in_middle(docs, per_entry=50))
    assert got == sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=repr)
    large = spark.createDataFrame([(sha(text), 8)], "key string, entries int")
    listed = fim.distinct_texts(docs, "text", F.xxhash64("doc_id"), large)
    assert listed.where(F.col("text") == text).count() == 8 and listed.count() == 208


def test_empty_table_and_all_forms(spark, no_docs, small):
    assert result(fim.fill_in_middle(no_docs)) == []
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = result(fim.fill_in_middle(docs))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert got == sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=repr)
