"""Best-fit packing after Martello-Toth dominance reduction.

Texts are tokenised, cut only where they exceed the capacity, and their pieces packed into sequences
of at most ``capacity`` tokens. Which pieces share a sequence depends on lengths alone, so the
instance is a histogram of at most ``capacity`` lengths, whatever the number of pieces; it is all the
driver ever sees. On it the Martello-Toth procedure fixes, from the longest length down, small sets
that dominate every other set with that length:

* nothing fits beside it: it stays alone;
* a partner fills it exactly, or no two pieces fit beside it: the longest piece that fits goes with it;
* no three pieces fit beside it, and the longest piece that fits is at least as long as every pair
  that fits: same.

What remains is packed best-fit, longest first, whole runs of equal bins at a time. The result is a
list of patterns (lengths with counts, times); its size is bounded by the capacity, not the corpus.
Pieces find their place by their rank among pieces of equal length: lengths are salted, ranks are
taken inside (length, salt) and shifted by the histogram's running counts, so a length that a third
of all pieces share is still dealt to many tasks.

Edge cases: null text counts as empty (its only token is the end token); repeated rows and null ids
are packed as rows of their own; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import bisect
import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrack.session import stored
from vistrack.worker import kept

CAPACITY = 4096
END = 1
SALTS = 64
#: Distinct words whose ids a worker remembers; beyond it starts anew.
CACHE = 600_000
#: ASCII signs that are neither letters, digits nor white space, without the apostrophe.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts. The tokenizer drops white space and never looks across it, so ids are
    remembered by the stretches between blanks and line ends. It also never joins letters with other
    signs and knows lower case only: letters followed by ASCII marks (the apostrophe apart, which has
    rules of its own) are put together from the letters' ids and the marks' ids."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.cache = cache
        self.tok, self.seen, self.parts = Tokenizer.from_file(path), {"": b""}, {"": b""}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet
        self.alphabet = {c: c for c in shown} | {c: 256 + i for i, c in enumerate(c for c in range(256) if c not in set(shown))}

    def split(self, word: str) -> tuple[str, str] | None:
        letters = word.rstrip(MARKS)
        if not letters.isalpha() or "\u0130" in letters:
            return None
        return (letters.lower() if letters.isascii() else letters), word[len(letters) :]

    def learn(self, words: list[str]) -> None:
        import numpy as np

        cut = [(w, self.split(w) or (w, "")) for w in words]
        new = list({p for _, pair in cut for p in pair}.difference(self.parts))
        # Latin letters are in normal form and one pre-token: they go straight to the model, as bytes
        model, alphabet, rest = self.tok.model.tokenize, self.alphabet, []
        for p in new:
            if p.isascii() and p.isalpha():
                self.parts[p] = np.array([t.id for t in model(p.lower())], "<u4").tobytes()
            elif p.isalpha() and max(p) < "\u0180" and "\u0130" not in p:
                self.parts[p] = np.array([t.id for t in model(p.lower().encode().decode("latin-1").translate(alphabet))], "<u4").tobytes()
            else:
                rest.append(p)
        for i in range(0, len(rest), 2048):
            part = rest[i : i + 2048]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.parts[w] = np.array(e.ids, "<u4").tobytes()
        for w, (x, y) in cut:
            self.seen[w] = self.parts[x] + self.parts[y]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(self.seen) + len(self.parts) > self.cache:
            self.seen, self.parts = {"": b""}, {"": b""}
        words = text.replace("\n", " ").split(" ")
        new = set(words).difference(self.seen)
        if new:
            self.learn(list(new))
        return b"".join(map(self.seen.__getitem__, words))


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True, cache: int = CACHE) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids binary]) of whole texts."""
    path, step = path or tokenizer_path(), 4 * capacity

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok, end = kept(f"tokenizer {path} {cache}", lambda: WordTokenizer(path, cache)), END.to_bytes(4, "little")
        for b in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(b.column(1)):
                all_ids = tok.encode(text.as_py() or "") + end
                for j, i in enumerate(range(0, len(all_ids), step)):
                    part = all_ids[i : i + step]
                    rows.append(k), piece.append(j), start.append(i // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part)), ids.append(part if with_ids else None)
            cols = [b.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + ([pa.array(ids, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())] + ([T.StructField("ids", T.BinaryType())] if with_ids else []))
    names = schema.names
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def reduce_instance(count: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Dominating sets fixed for good, as (pattern, times), and the lengths that remain with their counts."""
    left, fixed = dict(count), []
    sizes = sorted(s for s, n in left.items() if n)

    def longest(limit: int, but: int | None = None) -> int | None:
        """Longest remaining length within limit, one piece of ``but`` set aside."""
        i = bisect.bisect_right(sizes, limit) - 1
        while i >= 0 and left[sizes[i]] - (sizes[i] == but) <= 0:
            i -= 1
        return sizes[i] if i >= 0 else None

    def smallest(k: int, but: int) -> float:
        """Sum of the k smallest remaining pieces, without end if there are not so many."""
        got = []
        for s in sizes:
            got += [s] * max(0, min(k - len(got), left[s] - (s == but)))
            if len(got) == k:
                return sum(got)
        return math.inf

    def best_pair(limit: int, but: int) -> int:
        """Largest sum of two remaining pieces within limit, or 0."""
        i, j, best = 0, bisect.bisect_right(sizes, limit) - 1, 0
        while i <= j:
            a, b = sizes[i], sizes[j]
            free = lambda s: left[s] - (s == but)
            if free(a) <= 0:
                i += 1
            elif free(b) <= 0 or a + b > limit or i == j and free(a) < 2:
                j -= 1
            else:
                best = max(best, a + b)
                i += 1
        return best

    for s in sorted(sizes, reverse=True):
        while left[s]:
            room = capacity - s
            mate = longest(room, s)
            if mate is None:
                fixed.append(({s: 1}, left[s]))
                left[s] = 0
                continue
            if not (mate == room or smallest(2, s) > room or smallest(3, s) > room and mate >= best_pair(room, s)):
                break
            # fewer pieces make neither fewer sums fit nor pairs longer: the set dominates until a length runs out
            n = left[s] // 2 if mate == s else min(left[s], left[mate])
            fixed.append(({s: 2} if mate == s else {s: 1, mate: 1}, n))
            left[s] -= n
            left[mate] -= n
        sizes = [x for x in sizes if left[x]]
    return fixed, {s: n for s, n in left.items() if n}


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over equal bins at a time: the same bins as placing one piece after another."""
    by_room: dict[int, list] = {}
    rooms: list[int] = []  # sorted, those with bins

    def put(pattern: dict[int, int], times: int, room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((pattern, times))

    def take(room: int) -> tuple[dict[int, int], int]:
        got = by_room[room].pop()
        if not by_room[room]:
            del by_room[room]
            rooms.pop(bisect.bisect_left(rooms, room))
        return got

    for s in sorted(count, reverse=True):
        n = count[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            room = rooms[i] if i < len(rooms) else None
            pattern, times = take(room) if room is not None else ({}, n)
            room = capacity if room is None else room
            each = min(room // s, n)
            full = min(times, n // each)
            put(pattern | {s: each}, full, room - each * s)
            if times > full and pattern:
                put(pattern, times - full, room)
            n -= full * each
    return [x for r in by_room.values() for x in r]


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """All sequences as (pattern, times)."""
    fixed, rest = reduce_instance(count, capacity)
    return fixed + best_fit(rest, capacity)


def _slots(patterns) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, pieces a sequence, first sequence, offset), by rising rank."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for s, each in pattern.items():
            out.setdefault(s, []).append((used.get(s, 0), each, sequence, offset))
            used[s] = used.get(s, 0) + each * times
            offset += s * each
        sequence += times
    return out


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (column length) that are read from stored files. Salts and
    ranks come from a row's place in its file, so that equal rows are dealt out like all others."""
    spark = found.sparkSession
    at = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r"))
    salted = found.withColumn("_at", at).withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(SALTS)).cast("int"))
    table = salted.groupBy("length", "_salt").count().collect()  # at most capacity x SALTS rows
    count: dict[int, int] = {}
    shift: dict[tuple[int, int], int] = {}
    for r in sorted(table, key=lambda r: (r["length"], r["_salt"])):
        shift[r["length"], r["_salt"]] = count.get(r["length"], 0)
        count[r["length"]] = count.get(r["length"], 0) + r["count"]
    known = spark.sparkContext.broadcast((_slots(plan(count, capacity)), shift))
    ranked = salted.selectExpr("*", "row_number() OVER (PARTITION BY length, _salt ORDER BY _at) - 1 AS _rank")
    out = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = found.columns

    def run(batches):
        import pyarrow as pa

        slots, shift = known.value
        starts = {s: [x[0] for x in v] for s, v in slots.items()}
        for b in batches:
            seq, off = [], []
            for s, salt, rank in zip(b.column("length").to_pylist(), b.column("_salt").to_pylist(), b.column("_rank").to_pylist(), strict=True):
                rank += shift[s, salt]
                first, each, at, offset = slots[s][bisect.bisect_right(starts[s], rank) - 1]
                q, r = divmod(rank - first, each)
                seq.append(at + q), off.append(offset + r * s)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, out)


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True, cache: int = CACHE) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    with_ids carries the token ids themselves (little-endian unsigned 32-bit), at four bytes a token. cache:
    words whose ids a worker remembers; fewer take more time and less memory.
    """
    found = stored(pieces(docs, path, id_col, text_col, capacity, with_ids, cache), "pieces")
    return place(found, capacity).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


