import random
import zlib

import numpy as np

from vistrack.llm import packing


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit_one_by_one(lengths, capacity):
    rooms = []
    for s in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


def exact_bins(lengths, capacity):
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            rooms[k] -= lengths[i]
            go(i + 1, rooms)
            rooms[k] += lengths[i]
        go(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


def test_best_fit_equals_one_piece_after_another():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 60))]
        count = {s: lengths.count(s) for s in lengths}
        got = packing.best_fit(count, 64)
        assert sum(t for _, t in got) == best_fit_one_by_one(lengths, 64)
        assert {s: sum(p.get(s, 0) * t for p, t in got) for s in count} == count


def bins_by_subsets(lengths, capacity):
    """Fewest bins, over all sets of pieces: (bins, room used in the last) for each set, as small as can be."""
    n = len(lengths)
    best = [(0, capacity)] + [(n + 1, 0)] * ((1 << n) - 1)
    for done in range(1 << n):
        bins, used = best[done]
        for i, s in enumerate(lengths):
            if not done >> i & 1:
                new = (bins, used + s) if used + s <= capacity else (bins + 1, s)
                best[done | 1 << i] = min(best[done | 1 << i], new)
    return best[-1][0]


def check_reduction(lengths, capacity):
    count = {s: lengths.count(s) for s in lengths}
    fixed, rest = packing.reduce_instance(count, capacity)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert sum(t for _, t in fixed) + bins_by_subsets(left, capacity) == bins_by_subsets(lengths, capacity), (lengths, capacity)
    both = {s: sum(p.get(s, 0) * t for p, t in fixed) + rest.get(s, 0) for s in count}
    assert both == count and all(sum(s * n for s, n in p.items()) <= capacity for p, _ in fixed)


def test_reduction_keeps_the_optimum():
    assert bins_by_subsets([14, 5, 9, 3, 2, 2, 2, 3], 20) == exact_bins([14, 5, 9, 3, 2, 2, 2, 3], 20) == 2
    check_reduction([2, 2, 2, 3, 3, 5, 9, 14], 20)
    check_reduction([12, 11, 9, 7, 6, 6, 4, 3, 2], 20)
    rng = random.Random(2)
    for _ in range(4000):
        capacity = rng.choice((12, 20, 30, 50))
        top = rng.choice((capacity, capacity // 2, 2 * capacity // 3))
        check_reduction([rng.randrange(1, top + 1) for _ in range(rng.randrange(1, 9))], capacity)


def test_reduction_of_many_equal_pieces():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 4))]
        check_reduction([rng.choice(sizes) for _ in range(rng.randrange(1, 10))], 20)


def test_query(spark, small):
    from tokenizers import Tokenizer

    rows = packing.query(spark, small).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [1]
        for i in range(0, len(ids), 4096):
            part = ids[i : i + 4096]
            want[d.doc_id, i // 4096] = (i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    n = check_places(rows, 4096)
    least = -(-sum(r.length for r in rows) // 4096)
    assert least <= n <= max(least + 1, 1.02 * least)


def test_hard_words():
    from tokenizers import Tokenizer

    t, hf = packing.WordTokenizer(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for s in ("", " ", "İ.x Straße's don't I'LL 3.14,a b<|endoftext|>c naïve… é. ΣΑΣ. ﬁn word*** 'quoted', à́!", "ßÄÖ éà ŸŁ ſt ĳ ŉx ª º µm", "a\n\n b\t\tc <|endoftext|>", "日本語。 текст, 한국어"):
        for _ in range(2):
            assert np.frombuffer(t.encode(s), "<u4").tolist() == hf.encode(s, add_special_tokens=False).ids


def test_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs, capacity=64).collect()
    check_places(rows, 64)
    assert {r.doc_id for r in rows} == {1, 2, 3, None, 5, 6, 7, 8}
    assert sum(r.piece == 0 for r in rows) == 9 and all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(no_docs).count() == 0


def test_equal_rows_without_id_are_dealt_out(spark, monkeypatch):
    """A third of the rows: one text, no id. No salt holds more than its share."""
    docs = spark.createDataFrame([(None, "one two three")] * 3000 + [(i, "a b " * (i % 50)) for i in range(6000)], "doc_id long, text string")
    found = packing.stored(packing.pieces(docs, with_ids=False), "pieces")
    rows = packing.place(found).collect()
    check_places(rows, 4096)
    assert len(rows) == 9000
    from pyspark.sql import functions as F

    salts = found.select("length", F.pmod(F.xxhash64(F.struct("_metadata.file_name", "_metadata.row_index")), F.lit(packing.SALTS)).alias("s")).groupBy("length", "s").count()
    assert salts.agg(F.max("count")).head()[0] < 3 * 3000 / packing.SALTS
