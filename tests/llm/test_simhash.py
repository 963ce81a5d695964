import random

import xxhash

from vistrack.llm import simhash


def brute_fp(text):
    """Fingerprint bit by bit."""
    words, w = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, w = words + ([w] if w else []), ""
        else:
            w += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    ids = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 3 and ids[i] != ids[j]:
                    ids[i] = ids[j] = min(ids[i], ids[j])
                    changed = True
    return ids


def test_fingerprints_and_components(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in simhash.query(spark, small).collect()}
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fp(r.text) for r in rows]
    assert [got[r.doc_id].fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    want = [rows[i].doc_id for i in components(fps)]
    assert [got[r.doc_id].component_id for r in rows] == want


def test_links_are_all_pairs_within_three_bits(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base:
        for _ in range(8):
            x = b
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {frozenset(((r.a) % 2**64, (r.b) % 2**64)) for r in simhash.links(df).collect()}
    order = sorted(fps)
    want = {frozenset((a, b)) for i, a in enumerate(order) for b in order[i + 1 :] if bin(a ^ b).count("1") <= 3}
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 9
    zero = {r.doc_id: r.component_id for r in rows if r.fp == 0}
    assert zero == {2: 2, 3: 2, 6: 2}
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 7, 8]
    assert simhash.near_duplicates(no_docs).count() == 0
