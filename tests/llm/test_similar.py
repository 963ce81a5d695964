"""Removal of near duplicates by five-word similarity, against brute force."""

import random

from vistrack.llm import simhash


def jaccard(a, b, n=5):
    def grams(t):
        w = simhash.WORD.findall((t or "").translate(simhash.LOWER))
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(words, share, rng, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


def test_similar_texts_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(80, 400))
        texts += [" ".join(edited(base, s, rng, vocabulary)) for s in (0, 0.004, 0.01, 0.015, 0.08)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r["node"]: r["root"] for r in simhash.similar_classes(docs).collect()}
    keys = [r[0] for r in docs.orderBy("doc_id").select(simhash.text_key(docs.text)).collect()]
    pairs = [(i, j, jaccard(texts[i], texts[j])) for i in range(len(texts)) for j in range(i) if i // 5 == j // 5]
    near = [(i, j) for i, j, s in pairs if s >= 0.8]
    assert len(near) > 60
    found = sum(keys[i] in roots and roots[keys[i]] == roots.get(keys[j]) for i, j in near)
    assert found >= 0.9 * len(near)
    # nothing is joined but by links of 0.8 or more
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in near:
        parent[find(i)] = find(j)
    for i, j, _ in pairs:
        if keys[i] in roots and roots[keys[i]] == roots.get(keys[j]):
            assert find(i) == find(j)


def test_large_bucket_in_blocks(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    base = rng.choices(vocabulary, k=200)
    docs = spark.createDataFrame([(i, " ".join(edited(base, 0.01, rng, vocabulary))) for i in range(90)], "doc_id long, text string")
    rows = simhash.wide_fingerprints(docs.withColumn("key", simhash.text_key(docs.text)), ["key"], "text").distinct()
    whole, parts = (simhash.connected_components(simhash.peak_links(rows, block=b)).collect() for b in (1000, 8))
    assert {tuple(r) for r in whole} == {tuple(r) for r in parts} and len(whole) > 60
    assert simhash.peak_links(rows, block=1000).count() < 90 * simhash.TABLES


def test_links_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    base = rng.choices(vocabulary, k=120)
    docs = spark.createDataFrame([(i, " ".join(edited(base, 0.03, rng, vocabulary))) for i in range(150)], "doc_id long, text string")
    rows = simhash.wide_fingerprints(docs.withColumn("key", simhash.text_key(docs.text)), ["key"], "text").distinct()
    links = [sorted(map(tuple, simhash.peak_links(simhash.stored(r, "rows")).collect())) for r in (rows, rows.repartition(5, "fp1"), rows.orderBy("fp2"))]
    assert links[0] == links[1] == links[2] and links[0]


def test_rows_not_ids_are_removed(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, "x"), (7, a, "y"), (5, b, "x"), (3, b, "z"), (None, "c c c c c c", "n"), (None, "c c c c c c", "n"), (9, None, "e"), (8, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    for n in (1, 7):
        got = simhash.drop_near_duplicates(docs.repartition(n)).collect()
        assert sorted((r.doc_id or 0, r.text, r._key) for r in got) == [(0, "c c c c c c", "n"), (3, b, "z"), (5, a, "x"), (8, "", "f")]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_odd_rows(spark, odd_docs):
    got = simhash.drop_near_duplicates(odd_docs)
    assert got.columns == odd_docs.columns
    # one of the two equal rows and one of the three wordless texts stay
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 2, 5, 7, 8]


def groups_of_edits(seed, groups=12, size=40):
    """Texts of groups in which similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    out = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(100, 300))
        out += [(g, " ".join(edited(base, rng.choice([0.008, 0.015, 0.02, 0.03]), rng, vocabulary))) for _ in range(size)]
    return out


def test_no_link_of_a_group_is_split(spark):
    """A pair below 0.8 in a forest does not part those that others at 0.8 or more join."""
    texts = groups_of_edits(3)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    roots = {r["node"]: r["root"] for r in simhash.similar_classes(docs).collect()}
    keys = [r[0] for r in docs.orderBy("doc_id").select(simhash.text_key(docs.text)).collect()]
    wide = {r.key: r for r in simhash.wide_fingerprints(docs.withColumn("key", simhash.text_key(docs.text)), ["key"], "text").collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i][0] == texts[j][0] and jaccard(texts[i][1], texts[j][1]) >= 0.8]
    split = [(wide[keys[i]], wide[keys[j]]) for i, j in links if roots.get(keys[i], keys[i]) != roots.get(keys[j], keys[j])]
    bits = lambda a, b: sum(((a[f"fp{k}"] ^ b[f"fp{k}"]) & (1 << 64) - 1).bit_count() for k in range(simhash.WORDS))
    # the search may miss a pair, but of what it finds nothing is lost
    assert not [1 for a, b in split if set(a.peaks) & set(b.peaks) and bits(a, b) <= simhash.WIDE_DISTANCE]
    assert len(links) > 800 and len(split) <= 0.02 * len(links)


def test_parts_of_large_buckets_are_bounded(spark):
    """A bucket of 20,000 members: each part holds a block and the leaders; all members hang together."""
    listed = spark.range(20_000).selectExpr("id * 7919 AS key", "id AS label", "id AS fp0", "id AS fp1", "id AS fp2", "id AS fp3", "5L AS peak", "20000L AS size")
    parts = simhash.dealt_buckets(listed, 1024).groupBy("i").count().collect()
    assert len(parts) == 20 and max(r["count"] for r in parts) < 1300
    near = listed.selectExpr("key", "1L << cast(label % 60 AS int) AS fp0", "label % 16 AS fp1", "0L AS fp2", "0L AS fp3", "array(5L) AS peaks")
    got = simhash.peak_links(near)
    assert got.count() < 21_000 + 20 * 64 and simhash.connected_components(got).select("root").distinct().count() == 1


def test_large_buckets_lose_no_pair_of_the_second_search(spark):
    """Buckets of far more members than a block: every pair of different components within the distance comes out."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    base = rng.choices(vocabulary, k=150)
    docs = spark.createDataFrame([(i, " ".join(edited(base, 0.02, rng, vocabulary))) for i in range(120)], "doc_id long, text string")
    wide = simhash.stored(simhash.wide_fingerprints(docs.withColumn("key", simhash.text_key(docs.text)), ["key"], "text").distinct(), "rows")
    rows = sorted(wide.collect(), key=lambda r: r.key)
    bits = lambda a, b: sum(((a[f"fp{k}"] ^ b[f"fp{k}"]) & (1 << 64) - 1).bit_count() for k in range(simhash.WORDS))
    near = {(a.key, b.key) for i, a in enumerate(rows) for b in rows[i + 1 :] if set(a.peaks) & set(b.peaks) and bits(a, b) <= simhash.WIDE_DISTANCE}
    half = {r.key: rows[0].key for r in rows[:60]}  # a large component beside single texts
    for label in ({}, half):
        labels = spark.createDataFrame(list(label.items()), "node long, root long")
        got = [tuple(r) for r in simhash.peak_links(wide, labels, block=8).collect()]
        want = {(a, b) for a, b in near if label.get(a, a) != label.get(b, b)}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_parts_of_the_second_search_are_bounded(spark):
    """10,000 members of which 9,000 hang together: no part above two blocks, rows by members and others."""
    listed = spark.range(10_000).selectExpr("id AS key", "CASE WHEN id < 9000 THEN 0L ELSE id END AS label", "5L AS peak", "10000L AS size", "9000L AS most", "0L AS hub")
    parts = [r["count"] for r in simhash.dealt_grid(listed, 512).groupBy("i").count().collect()]
    assert len(parts) == 40 and max(parts) < 1150 and sum(parts) <= 10_000 * 2 + 1000 * 20


def test_marks_never_hide_a_similar_pair(spark):
    rng = random.Random(10)
    sets = [(set(x), set(y)) for n in (0, 1, 5, 200, 5000) for s in (0, 0.1, 0.3) for x in [[rng.randrange(-(2**62), 2**62) for _ in range(n)]] for y in [[v if rng.random() >= s else rng.randrange(2**62) for v in x]]]
    import numpy as np
    from pyspark.sql import functions as F

    marks = lambda v: simhash.marks_of(np.array(sorted(v), np.int64)).tolist()
    rows = spark.createDataFrame([(len(x), marks(x), len(y), marks(y), len(x & y)) for x, y in sets], "na int, ma array<long>, nb int, mb array<long>, c int")
    got = rows.withColumn("most", simhash.most_common(*map(F.col, ("na", "ma", "nb", "mb")))).collect()
    assert all(r.c <= r.most <= min(r.na, r.nb) for r in got) and any(r.most < 0.8 * r.na for r in got)


def test_pairs_of_a_template_below_the_similarity_are_no_rows(spark):
    """300 copies of a text, each with edits of its own: nearly all pairs are near by their bits and below 0.8."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    base = rng.choices(vocabulary, k=150)
    texts = [" ".join(rng.choice(vocabulary) if k in own else w for k, w in enumerate(base)) for _ in range(300) for own in [set(rng.sample(range(150), rng.choice([1, 3, 3, 3, 4])))]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wide = simhash.stored(simhash.wide_fingerprints(docs.withColumn("key", simhash.text_key(docs.text)), ["key"], "text").distinct(), "rows")
    text = {r.key: r.text for r in docs.select(simhash.text_key(docs.text).alias("key"), "text").collect()}
    labels = spark.createDataFrame([], "node long, root long")
    whole = {tuple(r) for r in simhash.peak_links(wide, labels, block=64).collect()}
    for block in (64, 1024):
        got = [tuple(r) for r in simhash.peak_links(wide, labels, block=block, similarity=0.8).collect()]
        links = {p for p in whole if jaccard(text[p[0]], text[p[1]]) >= 0.8}
        assert len(got) == len(set(got)) and links <= set(got) <= whole and len(links) > 1000
        assert len(whole) > 20_000 and len(set(got) - links) < 0.05 * len(whole)


def test_folded_marks_never_hide_a_similar_pair():
    import numpy as np

    rng = np.random.default_rng(13)
    for n in (0, 1, 120, 128, 130, 250, 260, 5000, 30_000):
        base = rng.integers(-(2**62), 2**62, n)
        sets = [np.unique(np.concatenate([base[k:], rng.integers(-(2**62), 2**62, k + e)])) for k in (0, n // 20, n // 5) for e in (0, n // 30)]
        sizes, marks = np.array([len(s) for s in sets]), [simhash.marks_of(s, simhash.mark_words(len(s))) for s in sets]
        a, b = (i.ravel() for i in np.meshgrid(range(6), range(6)))
        told = simhash.likely_pairs(sizes, marks, 0.8)(a, b)
        for i, j, ok in zip(a, b, told, strict=True):
            common = len(np.intersect1d(sets[i], sets[j]))
            similar = common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)
            assert ok or not similar
    assert {simhash.mark_words(n) for n in (0, 127, 128, 256, 10**6)} == {16, 32, 64, 512}
