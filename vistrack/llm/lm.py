"""Cross-entropy difference of matched n-gram models.

Target model: the labelled good texts (labels.quality = 1, training folds). Background model: the
whole corpus. Both are interpolated bigram models with the same weights over one shared vocabulary,
all words of the corpus. A text's score is the mean over its tokens of target loss minus background
loss, in nats: lower is closer to the target.

Nothing gathered from the corpus has a fixed size: words and (previous, word) pairs are counted in
tables that grow with the input, by ranges of keys, and looked up for the distinct words and pairs of
chunks of texts. A chunk holds about CHUNK tokens, numbered by its own word list, and is stored once. Keys are hashes of
63 bits: with n distinct keys two of them coincide with a probability below n * n / 2**64. If
VOCABULARY is a number, only so many of the most frequent words are kept and the others are one
unknown word.

Edge cases: null and empty texts have no tokens, loss and score null; without any target text
the target model is the uniform one; ids may be null or repeated; words and pairs that the training
texts lack count zero; an empty table gives no rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrack.session import cut, join_checked, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of the shared vocabulary at most (None: all); weights of bigram, unigram and uniform.
VOCABULARY, MIX = None, (0.7, 0.25, 0.05)
#: Cells of the plain model below, one for each pair of a small VOCABULARY.
BUCKETS = 1 << 22
#: Tokens of a chunk, about.
CHUNK = 1 << 21
#: Ranges of keys at least; one more for every 2^21 tokens.
RANGES = 32
#: Labels are looked up by broadcast up to this many target ids, else by a shuffle join.
TARGETS = 2_000_000
#: No words: the place before a text's first word, and the unknown word.
BOUNDARY, UNKNOWN = "", " "


def cells(ids: np.ndarray) -> np.ndarray:
    """Cell of each (previous word, word) of the plain model; the first word follows number VOCABULARY + 1."""
    assert (VOCABULARY + 2) ** 2 <= BUCKETS
    return np.concatenate([[VOCABULARY + 1], ids[:-1]]).astype(np.int64) * (VOCABULARY + 2) + ids


class Model:
    """Plain bigram model of a small VOCABULARY: words (unknown and boundary last) and bigram cells."""

    def __init__(self, uni: np.ndarray, big: np.ndarray, starts: int):
        before = uni.astype(float)
        before[VOCABULARY + 1] = starts
        self.before = np.maximum(before, 1)
        self.uni = uni / max(1, uni.sum())
        self.big = big

    def loss(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        prev = np.concatenate([[VOCABULARY + 1], ids[:-1]])
        p = MIX[0] * np.minimum(1.0, self.big[at] / self.before[prev]) + MIX[1] * self.uni[ids] + MIX[2] / (VOCABULARY + 1)
        return -np.log(p)


class Models(NamedTuple):
    """Both models as stored chunks of the training texts: their number of tokens and texts (target,
    corpus), and the words kept if there is a limit."""

    parts: DataFrame
    tokens: tuple[int, int]
    starts: tuple[int, int]
    kept: frozenset[str] | None


def vocabulary_of(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """The most frequent words of all texts, VOCABULARY at most; of equally frequent words all or none."""

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

        for b in batches:
            for t in b.column(0):
                seen.update(WORD.findall((t.as_py() or "").lower()))
            if len(seen) > 400_000:  # bounded memory; the shuffle adds the parts
                yield out()
                seen.clear()
        yield out()

    counts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "w string, n long")
    counts = stored(counts.groupBy("w").agg(F.sum("n").alias("n")), "vocabulary")
    # the cut comes from the counts of counts, so only words above it reach the driver
    total, least = 0, None
    for r in sorted(counts.groupBy("n").count().collect(), key=lambda r: -r["n"]):
        total += r["count"]
        if total > VOCABULARY:
            least = r["n"]
            break
    top = counts.where(F.col("n") > least) if least else counts
    return {r["w"]: i for i, r in enumerate(sorted(top.collect(), key=lambda r: (-r["n"], r["w"])))}


def chunks(docs: DataFrame, id_col: str, text_col: str, is_target: str | None, kept: frozenset[str] | None) -> DataFrame:
    """Rows (chunk, ids, lengths, targets, tokens, words), stored: the texts of a chunk as numbers of its
    words, and the hash of each word; number 0 is the boundary."""
    known = docs.sparkSession.sparkContext.broadcast(kept) if kept is not None else None  # bounded by VOCABULARY
    size = CHUNK
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("lengths", "targets", "tokens", "words")),
                           *(T.StructField(c, T.LongType()) for c in ("tokens_a", "tokens_c", "starts_a", "starts_c"))])

    def run(batches):
        import pyarrow as pa
        import xxhash
        from collections import defaultdict
        from pyspark import TaskContext

        base, seq, digest = TaskContext.get().partitionId() << 32, 0, xxhash.xxh3_64_intdigest

        def fresh():
            words = defaultdict()
            words.default_factory = words.__len__
            words[BOUNDARY]
            return words, [], [], [], []

        words, ids, lengths, targets, tokens = fresh()

        def out():
            n, y = np.array(lengths, np.int32), np.array(targets, bool)
            hashes = np.array([digest(w) for w in words], np.uint64)
            sums = [int(n[y].sum()), int(n.sum()), int((n[y] > 0).sum()), int((n > 0).sum())]
            flat = np.concatenate([np.zeros(0, np.int32), *tokens])
            one = [pa.array([base + seq], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(ids)), *(pa.array([x.tobytes()], pa.binary()) for x in (n, y, flat, hashes))]
            return pa.RecordBatch.from_arrays([*one, *(pa.array([s], pa.int64()) for s in sums)], names=schema.fieldNames())

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids.append(part.column(0))
                targets += part.column(2).to_pylist()
                for t in part.column(1):
                    own = WORD.findall((t.as_py() or "").lower())
                    if known is not None:
                        own = [w if w in known.value else UNKNOWN for w in own]
                    lengths.append(len(own))
                    tokens.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
                if sum(lengths[-256:]) and sum(lengths) >= size:
                    yield out()
                    seq += 1
                    words, ids, lengths, targets, tokens = fresh()
        if ids:
            yield out()

    y = F.coalesce(F.col(is_target), F.lit(False)) if is_target else F.lit(False)
    return stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), y.alias("y")).mapInArrow(run, schema), "lm-chunks")


def keys_of(lengths: bytes, tokens: bytes, words: bytes):
    """For one chunk: keys of its words, then of its pairs; the pair of each token; previous and own word
    of each pair. Keys of words are even, those of pairs odd."""
    n, ids, h = np.frombuffer(lengths, np.int32), np.frombuffer(tokens, np.int32).astype(np.int64), np.frombuffer(words, np.uint64)
    prev = np.concatenate([[0], ids])[: len(ids)]
    prev[(np.cumsum(n) - n)[n > 0]] = 0
    pairs, of = np.unique(prev << 32 | ids, return_inverse=True)
    p, w = pairs >> 32, pairs & 0xFFFFFFFF
    k = (h[p] ^ h[p] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + h[w] * np.uint64(0xC2B2AE3D27D4EB4F)
    k = (k ^ k >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    k = (k ^ k >> np.uint64(30)) | np.uint64(1)
    return np.concatenate([h & ~np.uint64(1), k]), of, p, w


def planes(x: np.ndarray) -> bytes:
    """Numbers of 64 bits as eight byte planes, which compress where numbers are small."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def plain(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def train(docs: DataFrame, is_target: str, text_col: str = "text", id_col: str | None = None) -> Models:
    """Target and background model; is_target names a boolean column of docs."""
    kept = frozenset(vocabulary_of(docs, text_col)) if VOCABULARY else None
    parts = chunks(docs if id_col else docs.withColumn("_none", F.lit(0)), id_col or "_none", text_col, is_target, kept)
    s = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens_a", "tokens_c", "starts_a", "starts_c")]).head()
    return Models(parts, (s[0], s[1]), (s[2], s[3]), kept)


def looked_up(counted: DataFrame, asked: DataFrame | None, ranges: int) -> DataFrame:
    """Rows (chunk, range, a, c, words), stored: counts of the keys of each chunk of asked (None: of
    counted itself), in the order of the keys, by ranges of keys. Each range has one row of chunk -1
    with the number of its distinct words. A key comes once from each chunk, however common it is."""

    def listed(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                keys, of, p, w = keys_of(r["lengths"], r["tokens"], r["words"])
                n, y = np.frombuffer(r["lengths"], np.int32), np.frombuffer(r["targets"], bool)
                per = np.bincount(of, minlength=len(p)), np.bincount(of, np.repeat(y, n), len(p))
                c, a = (np.concatenate([np.bincount(w, x, len(keys) - len(p)), x]).astype(np.uint64) for x in per)
                order = np.argsort(keys)
                keys, a, c = keys[order], a[order], c[order]
                ends = np.searchsorted((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
                for g in range(ranges):
                    s = slice(ends[g], ends[g + 1])
                    if ends[g] < ends[g + 1]:
                        blobs = [planes(np.diff(keys[s], prepend=np.uint64(0))), *((planes(a[s]), planes(c[s])) if r["counts"] else (None, None))]
                        yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int64()), pa.array([g], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs), pa.array([r["asks"]], pa.bool_())], names=["chunk", "range", "keys", "a", "c", "asks"])

    def answer(rows):
        import pyarrow as pa

        rows = rows.to_pylist()
        keys = [np.cumsum(plain(r["keys"]), dtype=np.uint64) for r in rows]
        known, of = np.unique(np.concatenate(keys), return_inverse=True)
        a, c = np.zeros(len(known), np.uint64), np.zeros(len(known), np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        at = [of[e - len(k) : e] for k, e in zip(keys, ends, strict=True)]
        for r, i in zip(rows, at, strict=True):
            if r["a"] is not None:
                a[i] += plain(r["a"])
                c[i] += plain(r["c"])
        out = [(-1, rows[0]["range"], None, None, int(((known & np.uint64(1) == 0) & (c > 0)).sum()))]
        out += [(r["chunk"], r["range"], planes(a[i]), planes(c[i]), None) for r, i in zip(rows, at, strict=True) if r["asks"]]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["chunk", "range", "a", "c", "words"])

    fields = "chunk", "lengths", "targets", "tokens", "words"
    rows = counted.select(*fields, F.lit(True).alias("counts"), F.lit(asked is None).alias("asks"))
    if asked is not None:
        rows = rows.union(asked.select(*fields, F.lit(False), F.lit(True)))
    packed = rows.mapInArrow(listed, "chunk long, range int, keys binary, a binary, c binary, asks boolean")
    return stored(packed.groupBy("range").applyInArrow(answer, "chunk long, range int, a binary, c binary, words long"), "lm-counts")


def score(docs: DataFrame | None, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, target_loss, background_loss (mean nats a token), score (their difference).
    Without docs: of the rows of training, which then had an id_col."""
    asked = None if docs is None else chunks(docs, id_col, text_col, None, models.kept)
    parts = models.parts if docs is None else asked
    tokens, starts = models.tokens, models.starts
    found = looked_up(models.parts, asked, RANGES + (tokens[1] >> 21))
    n_words = VOCABULARY or found.where("chunk = -1").agg(F.sum("words")).head()[0] or 0
    uniform = MIX[2] / (n_words + 1)
    schema = T.StructType([T.StructField(id_col, parts.schema["ids"].dataType.elementType), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score"))])

    def run(chunk, rows):
        import pyarrow as pa

        ids = chunk.column("ids").combine_chunks()
        lengths, flat, words = (chunk.column(c)[0].as_py() for c in ("lengths", "tokens", "words"))
        keys, of, p, w = keys_of(lengths, flat, words)
        n, order, first = np.frombuffer(lengths, np.int32), np.argsort(keys), len(keys) - len(p)
        rows = sorted(rows.to_pylist(), key=lambda r: r["range"])
        some = n > 0
        means = []
        for m, c in enumerate(("a", "c")):
            x = np.empty(len(keys))
            x[order] = np.concatenate([plain(r[c]) for r in rows])
            before = np.maximum(x[:first], 1)
            before[0] = max(1, starts[m])
            loss = -np.log(MIX[0] * np.minimum(1.0, x[first:] / before[p]) + MIX[1] * x[w] / max(1, tokens[m]) + uniform)
            mean = np.full(len(n), np.nan)
            if some.any():
                mean[some] = np.add.reduceat(loss[of], (np.cumsum(n) - n)[some]) / n[some]
            means.append(mean)
        values = [pa.array(v, pa.float64(), mask=~some) for v in (*means, means[0] - means[1])]
        return pa.Table.from_arrays([ids.flatten(), pa.array(n, pa.int64()), *values], names=schema.fieldNames())

    own = parts.select("chunk", "ids", "lengths", "tokens", "words")
    return own.groupBy("chunk").cogroup(found.where("chunk >= 0").select("chunk", "range", "a", "c").groupBy("chunk")).applyInArrow(run, schema)


def with_target(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with the boolean column _target: labelled good and not in the held-out fold."""
    good = labels.where((F.col("quality") == 1) & (F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) != 0))
    ids = cut(good.select(id_col, F.lit(True).alias("_target")).distinct())
    return join_checked(docs, ids, id_col, "left", limit=TARGETS)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = with_target(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(None, train(marked, "_target", id_col="doc_id"))
