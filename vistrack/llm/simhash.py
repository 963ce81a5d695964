"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A fingerprint has 64 bits. Its embedding holds the bit count of each of 32 segments of two bits, so
every coordinate is 0, 1 or 2 and one long packs all of them. One differing bit moves one coordinate
by at most one: the Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. For a pair at Hamming distance <= 3 the two halves of the embedding (16 coordinates
each) have Manhattan distances that sum to at most 3, so one half is at distance 0 or 1. The grid
has one cell per half-embedding; each fingerprint is listed in its two cells and looks into these
cells and the cells one step up, of which the equi-join finds every pair within distance 1 once.
Candidates are verified by the exact Hamming distance inside the join.

Only distinct fingerprints are joined; copies stay classes of one fingerprint. Linked fingerprints
become components by star contraction (vistrack.plans.components).

Removal by similarity (drop_near_duplicates) is about five-word shingles and a Jaccard similarity of
0.8. Fingerprints at three bits cannot find that (texts of similarity 0.8 to 0.85 differ in 9 of 64
bits on the average), so further candidates come from the sums behind the bits: texts whose sums, seen along
random directions, peak at the same ones share a bucket, of which a spanning forest of near pairs is
kept. All candidates are verified by their sets of shingles.

Edge cases: null and wordless texts have fingerprint zero, which links like any other. A null id is
kept in its row; it never becomes a component_id unless all ids of the component are null. Rows
repeated in the input are repeated in the output. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrack.plans.components import connected_components
from vistrack.session import cut, join_checked, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEED = 42
SHINGLE = 3
#: Shingle hashes held at once, whatever a text's length.
CHUNK = 1 << 16
MAX_DISTANCE = 3
#: Near duplicates by similarity: words of a shingle, least Jaccard similarity, words of 64 bits of the wide fingerprint.
WIDE_SHINGLE, SIMILARITY, WORDS = 5, 0.8, 4
#: Keys of a text, peaks of a key, directions a peak is chosen from; differing bits of 256 looked at.
TABLES, PEAKS, SPAN, WIDE_DISTANCE = 24, 3, 64, 64
#: Members of a bucket compared at once; in the first search, members of a large bucket that every part has.
BLOCK, LEADERS = 1024, 32
#: Words of 64 bits in which a set of shingles marks its members.
MARKS = 16
#: Marks that grow with the set: bits for each member at least, and words at most.
SPARSE, MOST_MARKS = 8, 512


def fingerprint(text: str | None) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included; zero without words."""
    import numpy as np
    import xxhash

    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    n = max(1, len(words) - SHINGLE + 1)
    for i in range(0, n, CHUNK):
        part = words[i : i + CHUNK + SHINGLE - 1]
        if len(words) < SHINGLE:
            hashes = [digest(" ".join(words), SEED)]
        else:
            hashes = [digest(s, SEED) for s in map(" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False))]
        h = np.array(hashes, dtype=np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp long) of whole texts."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [fingerprint(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def embedding(half):
    """Packed bit counts (0..2) of the 16 two-bit segments of 32 bits."""
    return half.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))


def links(fps: DataFrame) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints at 1 to 3 differing bits; fps has one row per fp."""
    fp = F.col("fp")
    halves = fps.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), embedding(fp.bitwiseAND(F.lit(0xFFFFFFFF))).alias("cell")),
        F.struct(F.lit(1).alias("half"), embedding(F.shiftrightunsigned(fp, 32)).alias("cell")))).alias("h")).select("fp", "h.*")
    up = [F.when(F.shiftright("cell", 2 * i).bitwiseAND(F.lit(3)) < 2, F.col("cell") + F.lit(1 << 2 * i)) for i in range(16)]
    probe = halves.select(F.col("fp").alias("a"), "half", F.col("cell").alias("own"), F.explode(F.filter(F.array(F.col("cell"), *up), lambda c: c.isNotNull())).alias("cell"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE) & ((F.col("own") != F.col("c")) | (F.col("a") < F.col("b")))
    index = halves.select(F.col("fp").alias("b"), F.col("half").alias("g"), F.col("cell").alias("c"))
    return probe.join(index, (F.col("half") == F.col("g")) & (F.col("cell") == F.col("c")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fp (long), component_id (the smallest id reachable)."""
    rows = stored(fingerprints(docs, id_col, text_col), "simhash")
    nodes = stored(rows.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp")))
    linked = cut(roots.withColumnRenamed("node", "fp").join(nodes, "fp"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    component = linked.join(least, "root").select("fp", F.col("component_id").alias("linked_id"))
    classes = nodes.join(component, "fp", "left").select("fp", F.coalesce("linked_id", "rep").alias("component_id"))
    # stored, so that both sides of the join are plain exchanges, of which a hot fingerprint's can be split
    return rows.join(stored(classes, "simhash-classes"), "fp")


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _mixed(h, k: int):
    """A further hash of 64 bits for each of h."""
    import numpy as np

    z = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def shingle_hashes(text: str | None, n: int):
    """XXH64 of the shingles of n words, repeats included; none without words."""
    import numpy as np
    import xxhash

    words, digest = WORD.findall((text or "").translate(LOWER)), xxhash.xxh64_intdigest
    if 0 < len(words) < n:
        return np.array([digest(" ".join(words), SEED)], np.uint64)
    out = [digest(s, SEED) for s in map(" ".join, zip(*(words[k:] for k in range(n)), strict=False))]
    return np.array(out, np.uint64)


def wide_sums(hashes):
    """Of 4 x 64 bits of each shingle's hash: how many more shingles have a bit set than not."""
    import numpy as np

    total = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), CHUNK // WORDS):
        h = hashes[i : i + CHUNK // WORDS]
        bits = np.stack([h, *(_mixed(h, k) for k in range(1, WORDS))], 1).astype(">u8").view(np.uint8)
        total += 2 * np.unpackbits(bits, axis=1).sum(0, dtype=np.int64) - len(h)
    return total


def wide_fingerprints(docs: DataFrame, own: list[str], text_col: str, n: int = WIDE_SHINGLE) -> DataFrame:
    """The columns named by own, fp0 to fp3 (the wide fingerprint), n and m (size and marks of the set of shingles) and
    peaks: TABLES keys of a text. A key has the number of its table and, for each of PEAKS sets of SPAN directions,
    which direction the sums of the bits point to most, and with which sign. Directions come from Hadamard transforms
    after random flips."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        width = 64 * WORDS
        flips = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (TABLES * PEAKS * SPAN // width, width))

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                hashes = [shingle_hashes(t.as_py(), n) for t in b.column(len(own))]
                sums = np.stack([wide_sums(h) for h in hashes])
                sets = [np.unique(h) for h in hashes]
                marks = [marks_of(h, mark_words(len(h))) for h in sets]
                marks = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, marks)]), pa.int32()), pa.array(np.concatenate(marks)))
                fps = np.packbits(sums > 0, axis=1).view(">u8").astype(np.int64)
                z = sums[:, None, :].astype(np.float32) * flips
                for k in range(width.bit_length() - 1):  # Hadamard transforms: each a turn of all directions
                    pair = z.reshape(len(sums), -1, 2, 1 << k)
                    z = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2)
                z = z.reshape(len(sums), TABLES * PEAKS, SPAN)
                top = np.abs(z).argmax(2)
                place = (2 * top + (np.take_along_axis(z, top[:, :, None], 2)[:, :, 0] > 0)).reshape(len(sums), TABLES, PEAKS)
                keys = np.broadcast_to(np.arange(TABLES, dtype=np.int64), place.shape[:2]).copy()
                for k in range(PEAKS):
                    keys = keys * (2 * SPAN) + place[:, :, k]
                peaks = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * TABLES), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *(pa.array(fps[:, k]) for k in range(WORDS)), pa.array(map(len, sets), pa.int64()), marks, peaks], names=schema.names)

    longs = T.ArrayType(T.LongType())
    added = [*(T.StructField(f"fp{k}", T.LongType()) for k in range(WORDS)), T.StructField("n", T.LongType()), T.StructField("m", longs), T.StructField("peaks", longs)]
    schema = T.StructType([*(docs.schema[c] for c in own), *added])
    return docs.select(*own, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def _forest(a, b, d):
    """Edges of a minimum spanning forest of the edges (a, b) of lengths d, by rounds of nearest neighbors."""
    import numpy as np

    order = np.argsort(d, kind="stable")
    a, b, out = a[order], b[order], []
    root = {int(x): int(x) for x in np.unique(np.concatenate([a, b]))}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    names = np.array(sorted(root))
    while len(a):
        label = np.array([find(int(x)) for x in names])
        la, lb = label[np.searchsorted(names, a)], label[np.searchsorted(names, b)]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        for i in np.unique(np.unique(np.concatenate([la, lb]), return_index=True)[1] % max(1, len(a))).tolist():
            x, y = find(int(a[i])), find(int(b[i]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(a[i]), int(b[i])))
    return out


def _thin(n):
    """About LEADERS of n members, by a hash of the key."""
    return F.pmod(F.xxhash64(F.lit(7), "key"), F.greatest(F.lit(1), F.floor(n / LEADERS)).cast("long")) == 0


def dealt_buckets(listed: DataFrame, block: int) -> DataFrame:
    """Rows with i, the part of its bucket (peak) that each is compared in. A bucket whose ``size`` is within
    ``block`` (or null) is one part. Others have a part for each block of members, by a hash, and about
    LEADERS of all members are in every part: rows grow with the members, however large a bucket is."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(0), "key"), blocks).cast("int")
    places = F.when(F.col("size").isNull() | (F.col("size") <= block), F.array(F.lit(0))).when(_thin(F.col("size")), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(mine))
    return listed.withColumn("i", F.explode(places)).drop("size")


def dealt_grid(listed: DataFrame, block: int) -> DataFrame:
    """Rows with i, all the parts of its bucket (peak) that each is compared in, so that any two members of different
    labels meet. ``size`` and ``most`` are the members of the bucket and of its largest label, ``hub``. Of such a pair one is
    not of the hub: blocks of all members meet blocks of those others, two blocks a part at most. Rows grow as
    size x others / block, which is the size for a bucket that hangs together but for a block."""
    across, down = F.ceil(F.col("size") / block).cast("int"), F.ceil((F.col("size") - F.col("most")) / block).cast("int")
    x, y = F.pmod(F.xxhash64(F.lit(1), "key"), F.col("_across")).cast("int"), F.pmod(F.xxhash64(F.lit(2), "key"), F.col("_down")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("_down") - 1), lambda k: F.col("_x") * F.col("_down") + k)
    asks = F.transform(F.sequence(F.lit(0), F.col("_across") - 1), lambda k: k * F.col("_down") + F.col("_y"))
    places = F.when(F.col("label") == F.col("hub"), met).otherwise(F.array_union(met, asks))
    placed = listed.withColumns({"_across": across, "_down": down}).withColumns({"_x": x, "_y": y}).withColumn("i", F.explode(places))
    return placed.drop("size", "most", "hub", "_across", "_down", "_x", "_y")


def likely_pairs(sizes, marks, similarity: float):
    """A function of pairs of rows (first, second) that tells which may have this Jaccard similarity, by the sizes of
    their sets and their marks (of mark_words words). The wider marks of a pair are folded to the width of the others."""
    import numpy as np

    words, levels = np.array([len(m) for m in marks]), {}

    def level(w: int):
        """Marks of all rows that have so many words or more, folded to w."""
        if w not in levels:
            levels[w] = np.zeros((len(marks), w), np.int64)
            for v in np.unique(words[words >= w]):
                rows = np.flatnonzero(words == v)
                levels[w][rows] = np.bitwise_or.reduce(np.stack([marks[i] for i in rows]).reshape(len(rows), -1, w), 1)
        return levels[w]

    def likely(first, second):
        na, nb, narrow = sizes[first], sizes[second], np.minimum(words[first], words[second])
        ok = np.minimum(na, nb) >= similarity * np.maximum(na, nb)
        for w in np.unique(narrow[ok]).tolist():
            for at in np.array_split(own := np.flatnonzero(ok & (narrow == w)), -(-len(own) * w // (BLOCK * BLOCK))):
                x, y = level(w)[first[at]], level(w)[second[at]]
                alone = lambda p, q: np.bitwise_count((p & ~q).view(np.uint64)).sum(1, dtype=np.int64)
                most = np.minimum(na[at] - alone(x, y), nb[at] - alone(y, x))
                ok[at] = most >= similarity * (na[at] + nb[at] - most)
        return ok

    return likely


def peak_links(classes: DataFrame, labels: DataFrame | None = None, distance: int = WIDE_DISTANCE, block: int = BLOCK, similarity: float | None = None) -> DataFrame:
    """Pairs (a, b) of classes (column key) that share a key of peaks and differ in at most ``distance``
    bits of the wide fingerprint.

    Without labels: a minimum spanning forest of such pairs, of large buckets of each part (dealt_buckets): a template of any
    number of copies costs a task about one block, and the parts hang together by their leaders. That is a short way and may
    leave some apart. With labels (node, root) of what is joined so far: all such pairs of different labels, whatever
    the size of a bucket (dealt_grid); what one label has in a bucket hangs together and needs no pairs. With a similarity
    (labels only; classes have n and m too): those of them that may reach it by sizes and marks, told where they meet, so
    that the pairs of a template whose copies are all below it never become rows.
    """
    fps = [f"fp{k}" for k in range(WORDS)]
    listed = classes.select("key", *fps, F.explode("peaks").alias("peak"))
    if labels is None:
        large = cut(listed.groupBy("peak").agg(F.count("*").alias("size")).where(F.col("size") > block))
        listed = join_checked(listed.withColumn("label", F.col("key")), large, "peak", "left")
    else:
        listed = listed.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("root", "key"))
        per = listed.groupBy("peak", "label").agg(F.count("*").alias("n"))
        hub = F.max(F.struct("n", "label"))
        mixed = per.groupBy("peak").agg(F.count("*").alias("m"), F.sum("n").alias("size"), hub["n"].alias("most"), hub["label"].alias("hub")).where("m > 1").drop("m")
        listed = listed.join(stored(mixed, "simhash-mixed"), "peak")
    forest = labels is None
    columns = ["key", "label", *fps, "peak"]
    dealt = dealt_buckets(listed.select(*columns, "size"), block) if forest else dealt_grid(listed.select(*columns, "size", "most", "hub"), block)
    dealt = dealt.select(*columns, "i")
    if similarity is not None:  # joined last: the marks are wider than the rest of a row
        dealt = dealt.join(classes.select("key", "n", "m"), "key").select(*columns, "i", "n", "m")
    one = slice(WORDS + 2, WORDS + 4)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def near(x, marks):
            """Rows (first, second, distance) of the near pairs of x, which holds whole groups."""
            group, fp, label = x[:, one], x[:, 2 : WORDS + 2].view(np.uint64), x[:, 1]
            left, step, hits = np.arange(len(x)), 0, []
            likely = likely_pairs(x[:, -1], marks, similarity) if similarity is not None else None
            while len(left):
                step += 1
                left = left[left + step < len(x)]
                left = left[(group[left] == group[left + step]).all(1)]
                pairs = left[label[left] != label[left + step]]
                d = np.bitwise_count(fp[pairs] ^ fp[pairs + step]).sum(1).astype(np.int32)
                ok = d <= distance
                if likely:
                    ok[ok] = likely(pairs[ok], pairs[ok] + step)
                hits.append(np.stack([pairs[ok], pairs[ok] + step, d[ok]], 1).astype(np.int32))
            return np.concatenate(hits) if hits else np.zeros((0, 3), np.int32)

        def found(x, marks):
            hits, key = near(x, marks), x[:, 0]
            if not len(hits):
                pairs = hits[:, :2]
            elif forest:
                hits = hits[np.argsort(hits[:, 0], kind="stable")]
                group = x[:, one]
                starts = np.concatenate([[True], (group[1:] != group[:-1]).any(1)]).cumsum()[hits[:, 0]]
                pairs = np.array([e for part in np.split(hits, np.flatnonzero(np.diff(starts)) + 1) for e in _forest(*part.T)], int).reshape(-1, 2)
            else:
                pairs = hits[:, :2]
            a, b = key[pairs[:, 0]], key[pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def pieces(x):
            """Bounds of runs of whole groups of about ``block`` rows; a group is never longer than two blocks."""
            ends = np.flatnonzero(np.append((x[1:, one] != x[:-1, one]).any(1), True)) + 1
            at = 0
            while at < len(x):
                stop = int(ends[min(len(ends) - 1, np.searchsorted(ends, at + block))])
                yield at, stop
                at = stop

        rest, marks = None, []
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns if not pa.types.is_list(c.type)], 1)
            if similarity is not None:
                m = b.column(b.num_columns - 1)
                marks += np.split(m.flatten().to_numpy(zero_copy_only=False), np.cumsum(m.value_lengths().to_numpy())[:-1]) if len(m) else []
            x = x if rest is None else np.concatenate([rest, x])
            if not len(x):
                continue
            last = len(x) - int((x[:, one] == x[-1, one]).all(1).sum())  # the last run may go on
            for at, stop in pieces(x[:last]):
                yield found(x[at:stop], marks[at:stop])
            rest, marks = x[last:], marks[last:]
        if rest is not None:
            yield found(rest, marks)

    # in the order of the keys, so that equal distances are decided alike in every run
    together = dealt.repartition("peak", "i").sortWithinPartitions("peak", "i", "key")
    return together.mapInArrow(run, "a long, b long").distinct()


def mark_words(n: int) -> int:
    """Words for the marks of a set of n: a power of two, so that wider marks fold to narrower ones."""
    return min(MOST_MARKS, max(MARKS, 1 << (n * SPARSE // 64).bit_length()))


def marks_of(hashes, words: int = MARKS):
    """Words of 64 bits: the bit of each hash is set."""
    import numpy as np

    bits = np.zeros(64 * words, np.uint8)
    bits[hashes.view(np.uint64) % np.uint64(64 * words)] = 1
    return np.packbits(bits).view(np.int64)


def most_common(na, ma, nb, mb):
    """Members that two sets share at most, from their sizes and marks: a mark of one only stands for a member of one only."""
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)
    return F.least(na - alone(ma, mb), nb - alone(mb, ma))


def verified(edges: DataFrame, texts: DataFrame, similarity: float, n: int) -> DataFrame:
    """The edges (a, b) of texts (key, text) whose sets of shingles have at least this Jaccard similarity.
    Sets meet only where their sizes and marks leave that open, so a candidate costs little."""
    edges = stored(edges, "simhash-candidates")
    wanted = stored(edges.select(F.col("a").alias("key")).union(edges.select("b")).distinct(), "simhash-involved")
    one = join_checked(texts, wanted, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                own = [np.unique(shingle_hashes(t.as_py(), n)).view(np.int64) for t in b.column(1)]
                ends = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
                marks = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * MARKS), pa.array(np.concatenate([marks_of(h) for h in own])))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, own), pa.int32()), marks, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own)))], names=["key", "n", "m", "s"])

    sets = stored(one.mapInArrow(run, "key long, n int, m array<long>, s array<long>"), "simhash-shingles")
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("m").alias(f"m{c}"))
    most = most_common(F.col("na"), F.col("ma"), F.col("nb"), F.col("mb"))
    likely = edges.join(side("a"), "a").join(side("b"), "b").withColumn("most", most).where(F.col("most") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("most")))
    edges = stored(likely.select("a", "b"), "simhash-likely")
    both = edges.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.where((union == 0) | (common >= F.lit(similarity) * union)).select("a", "b")


def similar_classes(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, n: int = WIDE_SHINGLE) -> DataFrame:
    """Rows (node, root) of the texts that are similar to a different one: node is text_key(text), root the
    least key of the component. Candidates come from the grid range-join of the fingerprints (links) and
    from the peaks of the same sums; each is verified by the Jaccard similarity of the sets of shingles.

    A forest of near pairs may hold one that is not similar enough where another way round would be. So what the
    verified pairs leave apart is looked at once more: all near pairs of different components that sizes and marks of the
    sets do not rule out, so that nothing of what shares a bucket is lost."""
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    classes = stored(wide_fingerprints(texts, ["key"], "text", n).distinct(), "simhash-wide")
    nodes = classes.select(F.col("fp0").alias("fp"), "key")
    near = links(nodes.select("fp").distinct())
    rep = stored(nodes.groupBy("fp").agg(F.min("key").alias("rep")), "simhash-nodes")
    grid = near.join(rep.select(F.col("fp").alias("a"), F.col("rep").alias("ka")), "a").join(rep.select(F.col("fp").alias("b"), F.col("rep").alias("kb")), "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    equal = nodes.join(rep, "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    tried = stored(grid.union(equal).union(peak_links(classes)).distinct(), "simhash-tried")
    edges = stored(verified(tried, texts, similarity, n), "simhash-edges")
    roots = connected_components(edges)
    more = stored(peak_links(classes, roots, similarity=similarity).join(tried, ["a", "b"], "left_anti"), "simhash-more")
    joined = stored(verified(more, texts, similarity, n), "simhash-joined")
    return connected_components(edges.union(joined)) if joined.head(1) else roots


def text_key(text):
    """63 bits that tell texts apart; null is empty. With m texts any two share a key with a probability below m * m / 2**64."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 63) - 1))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, n: int = WIDE_SHINGLE) -> DataFrame:
    """One row of each component of similar texts stays: that of the smallest id (null ids last), of
    equal ids that of the least hash of the whole row. Which row stays depends on its values alone. Columns
    are unchanged; columns of type map do not take part in the hash."""
    own = list(docs.columns)
    fresh = lambda c: c if c not in own else fresh(c + "_")
    kc, rc = fresh("_key"), fresh("_row")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.withColumn(kc, text_key(F.col(f"`{text_col}`"))).withColumn(rc, F.struct(F.xxhash64(*hashed).alias("x"), F.xxhash64(F.lit(1), *hashed).alias("y")))
    order = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(rc).alias("row"))
    best = stored(rows.groupBy(F.col(kc).alias("key"), order.alias("o")).agg(F.count("*").alias("n")), "simhash-rows")
    roots = similar_classes(docs, text_col, similarity, n).withColumnRenamed("node", "key")
    best = stored(best.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "simhash-roots")
    # stored, so that a large group's side of the join can be split
    stays = stored(best.groupBy("root").agg(F.min("o").alias("stays")), "simhash-stays")
    told = stored(best.join(stays, "root").withColumn("stay", F.col("o") == F.col("stays")).where("n > 1 OR NOT stay").select(F.col("o")["row"].alias(rc), "stay").distinct(), "simhash-gone")
    gone, twice = told.where("NOT stay").select(rc), told.where("stay").select(rc)
    kept = join_checked(rows, gone, rc, "left_anti")
    if not twice.head(1):
        return kept.select(*[f"`{c}`" for c in own])
    again = join_checked(kept, twice, rc, "left_semi").dropDuplicates([rc])
    return join_checked(kept, twice, rc, "left_anti").unionByName(again).select(*[f"`{c}`" for c in own])


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")
