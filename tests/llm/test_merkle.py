"""The Merkle manifest against a plain version with hashlib."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vistrack.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def climb(nodes):
    """Top of the nodes and the siblings of each of them, level by level."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 8 * 8 : a // 8 * 8 + 8]
            steps[i].append((run[: a % 8], run[a % 8 + 1 :]))
        nodes, at = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [a // 8 for a in at]
    return nodes[0], steps


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, upper = climb([tops[g][0] for g in names]) if names else (None, [])
    out = []
    for g, above in zip(names, upper, strict=True):
        for (_, _, leaf, r), own in zip(sorted(groups[g], key=lambda x: x[:3]), tops[g][1], strict=True):
            steps, bad = own + above, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text) if bad and r.text else r.text
            acc = leaf_of(r, text)
            for left, right in steps:
                acc = h(*left, acc, *right)
            proof = h(*(x for left, right in steps for x in left + right))
            out.append((r.doc_id, leaf, tops[g][0], root, proof, acc, acc == root))
    return sorted(out, key=repr)


def result(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.query(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in got.collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, place int, n int, grp string, node string"


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9}, {None: 1, "de": 8, "en": 64, "fr": 65, "é": 2, "z": 513}, {f"g{i}": i % 3 + 1 for i in range(70)}])
def test_against_hashlib(spark, tmp_path, sizes):
    rows, i = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 4001, f"Text {i} Ünï" if i % 5 else None, g, "s" if i % 4 else None, i, 1, 2, "x", "y"))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = result(spark, docs.repartition(5), tmp_path)
    assert got == plain(docs.collect()) and len(got) == len(rows)


def test_odd_rows(spark, odd_docs, tmp_path):
    """Nulls, empty and long texts, repeated rows, shared ids."""
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") > 3, "en")).withColumn("n_chars", F.length("text"))
    docs = docs.union(docs.limit(3))
    got = result(spark, docs, tmp_path)
    assert got == plain(docs.collect()) and len(got) == docs.count()


def test_empty_table(spark, tmp_path):
    assert result(spark, spark.createDataFrame([], SCHEMA), tmp_path) == []


def test_any_change_is_seen(spark, small):
    """A proof folds to the root only from its own leaf."""
    got = merkle.manifest(spark.read.parquet(f"{small}/documents.parquet"))
    other = got.select(F.col("folded") == F.col("root"), merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root"), merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root"), F.coalesce("claimed", "leaf") == F.col("leaf")).collect()
    assert all(not r[1] and r[2] and r[0] == r[3] for r in other)
