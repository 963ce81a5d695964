"""SentencePiece encoding and decoding as a streaming Viterbi search.

For a byte-pair model the pieces of every prefix of a text are unique, and a sequence of pieces is
the model's own encoding exactly if each two neighbors are (merging their joined text gives these two
back). So a lattice over character boundaries needs one surviving backpointer a boundary: the one
piece that ends there and goes with the piece before it. Only the last ``max_piece`` boundaries can
still be pointed at; as soon as all their paths run through one boundary, everything before it is
committed and dropped. The window is bounded by the longest piece, whatever the text's length.

White space becomes U+2581 and no piece goes on from another character into U+2581, so all paths
converge before each word: words are encoded one by one and remembered (at most CACHE of them).
Characters that are in no piece become byte pieces.

decode(encode(text)) gives the text back, but for U+2581 itself: the model has no other sign for a blank, so
that character comes back as one, as it does from the library.

Edge cases: null and empty texts have no ids; any other text starts with the dummy blank; repeated
rows and null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrack.worker import kept

CACHE = 250_000
#: Rows worked on at once.
SLICE = 500
#: Pairs of neighboring pieces whose check is remembered.
PAIRS = 200_000
BLANK = "▁"
#: A stretch starts with all the blanks before it.
STRETCH = re.compile(r" +[^ ]*|[^ ]+")
RUNS = re.compile("( *[A-Za-zÀ-ÖØ-öø-ɏ]+| *[^ A-Za-zÀ-ÖØ-öø-ɏ]+| +)")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, their order of merging and the byte pieces of a SentencePiece byte-pair model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.piece, self.rank, self.byte, self.text = {}, {}, {}, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                self.piece[p], self.rank[p] = i, -sp.get_score(i)
                self.text.append(p.replace(BLANK, " ").encode())
        self.max_piece = max(map(len, self.piece))
        assert not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.piece)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.inside = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        self.halves: dict[str, tuple[str, str]] = {}
        # pieces that merging can reach, by their characters from the last to the first: [piece or None, longer ones]
        self.ends: dict = {}
        for p in self.piece:
            if len(p) > 1:
                parts = self.merge(p, 2)
                if len(parts) != 2 or parts[0] + parts[1] not in self.rank:
                    continue
                self.halves[p] = (parts[0], parts[1])
            node, own = self.ends, None
            for c in reversed(p):
                own = node.setdefault(c, [None, {}])
                node = own[1]
            own[0] = p
        # runs of Latin letters and runs of other characters can be told apart if no piece holds both
        self.runs = RUNS if all(len(RUNS.findall(p.replace(BLANK, " "))) == 1 for p in self.piece) else STRETCH

    def merge(self, s: str, stop: int = 1) -> list[str]:
        """The model's merging on a short string, down to ``stop`` parts at least."""
        parts, rank = list(s), self.rank
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbors(self, a: str, b: str) -> bool:
        """Whether merging the joined text of two pieces gives these two back.

        It does unless some merge across the boundary comes before the merges that built the pieces:
        both are taken apart along the boundary, the later merge first.
        """
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        key, limit, halves, rank = (a, b), float("inf"), self.halves, self.rank
        ok = None
        while ok is None:
            across = rank.get(a + b)
            if across is not None and across < limit:
                ok = False
                break
            x, y = halves.get(a), halves.get(b)
            if x is None and y is None:
                ok = True
            elif y is None or x is not None and rank[a] > rank[b]:
                limit, a = rank[a], x[1]
            else:
                limit, b = rank[b] + 0.5, y[0]
        self.pairs[key] = ok
        return ok

    def last(self, s: str, i: int, back: list[int]) -> int:
        """Length of the one piece that can end at boundary i, from those before it; -1 if none can."""
        node, j = self.ends, i
        pairs = self.pairs
        while j > 0:
            j -= 1
            found = node.get(s[j])
            if found is None:
                break
            p, node = found
            if p is None or back[j] < 0:
                continue
            if not j:
                return i
            a = s[j - back[j] : j]
            ok = pairs.get((a, p))
            if self.neighbors(a, p) if ok is None else ok:
                return i - j
        # a character in no piece stands alone
        return 1 if s[i - 1] not in self.piece and (i == 1 or back[i - 1] > 0) else -1

    def short(self, s: str) -> list[str]:
        """Pieces of a string that fits into the window: last() at each boundary, written out."""
        known, ends, pairs, neighbors = self.piece, self.ends, self.pairs, self.neighbors
        piece: list = [None]  # the surviving piece that ends at each boundary
        for i in range(1, len(s) + 1):
            node, j, own = ends, i, None
            while j:
                j -= 1
                found = node.get(s[j])
                if found is None:
                    break
                p, node = found
                if p is not None:
                    if not j:
                        own = p
                        break
                    a = piece[j]
                    if a is not None:
                        ok = pairs.get((a, p))
                        if neighbors(a, p) if ok is None else ok:
                            own = p
                            break
            if own is None and s[i - 1] not in known and (i == 1 or piece[i - 1] is not None):
                own = s[i - 1]
            piece.append(own)
        i, out = len(s), []
        while i:
            out.append(piece[i])
            i -= len(piece[i])
        return out[::-1]


class Streaming:
    """Encoder for one text given in parts of any size; ids come out as soon as they are certain."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.tail, self.back = vocabulary, "", [0]
        #: back[i]: length of the piece that ends at boundary i of the window; tail: its characters.

    def feed(self, part: str) -> list[str]:
        """Pieces committed by these characters."""
        out: list[str] = []
        for c in part:
            self.tail += c
            self.back.append(self.v.last(self.tail, len(self.tail), self.back))
            if len(self.tail) > 2 * self.v.max_piece:
                out += self.commit()
        return out

    def path(self, end: int) -> list[int]:
        at, cuts = end, [end]
        while at > 0:
            at -= self.back[at]
            cuts.append(at)
        return cuts[::-1]

    def commit(self) -> list[str]:
        """Drop what lies before the last boundary that every surviving path runs through."""
        end = len(self.tail)
        common = None
        for i in range(end - self.v.max_piece + 1, end + 1):
            if self.back[i] >= 0:
                own = set(self.path(i))
                common = own if common is None else common & own
        at = max(common)
        if not at or self.back[at] < 0:
            return []
        cuts = self.path(at)
        out = [self.tail[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        # the boundary keeps its last piece, as its right neighbor must go with it
        keep = cuts[-2]
        self.tail, self.back = self.tail[keep:], [0] + self.back[keep + 1 :]
        self.back[1 : at - keep] = [-1] * (at - keep - 1)
        return out[:-1]

    def end(self) -> list[str]:
        cuts = self.path(len(self.tail))
        out = [self.tail[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.tail, self.back = "", [0]
        return out


class Codec:
    def __init__(self, path: str):
        self.v, self.seen, self.short = Vocabulary(path), {}, {}

    def _ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.v.piece.get(p)
            out += [i] if i is not None else [self.v.byte[b] for b in p.encode()]
        return out

    def _word(self, word: str) -> bytes:
        """Ids of a stretch between blanks. Where no piece holds two neighboring characters all paths
        converge, so the parts between such places are encoded and remembered apart."""
        if len(self.short) > CACHE:
            self.short.clear()
        inside, at, out = self.v.inside, 0, []
        for i in range(1, len(word) + 1):
            if i < len(word) and word[i - 1 : i + 1] in inside:
                continue
            part, at = word[at:i], i
            x = self.short.get(part)
            if x is None:
                if len(part) > 2 * self.v.max_piece:
                    s = Streaming(self.v)
                    found = s.feed(part) + s.end()
                else:  # the window holds all of it
                    found = self.v.short(part)
                x = np.array(self._ids(found), "<u4").tobytes()
                if len(part) < 4:
                    self.short[part] = x
            out.append(x)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        runs = self.v.runs.findall(" " + text.replace(BLANK, " "))
        for w in set(runs).difference(seen):
            seen[w] = self._word(w.replace(" ", BLANK))
        out = b"".join(map(seen.__getitem__, runs))
        self.seen = {k: x for k, x in seen.items() if len(k) < 256} if max(map(len, runs)) > 255 else seen
        return out

    def decode(self, ids: bytes) -> str:
        text = self.v.text
        return b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:].decode("utf-8", "replace")


def encoded(batches, path: str, id_col: str):
    """Batches of (id, text) as batches of (id, n_chars, ids), a few hundred rows each."""
    import pyarrow as pa

    codec = kept(f"pieces {path}", lambda: Codec(path))
    for whole in batches:
        for i in range(0, whole.num_rows, SLICE):
            b = whole.slice(i, SLICE)
            texts = [t.as_py() or "" for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.encode(t) for t in texts], pa.binary())], names=[id_col, "n_chars", "ids"])


def decoded(batches, path: str):
    """Batches with a column ids, and the decoded text behind their columns."""
    import pyarrow as pa

    codec = kept(f"pieces {path}", lambda: Codec(path))
    for whole in batches:
        for i in range(0, whole.num_rows, SLICE):
            b = whole.slice(i, SLICE)
            ids = b.column(b.schema.get_field_index("ids"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([codec.decode(x.as_py() or b"") for x in ids], pa.string())], names=[*b.schema.names, "text"])


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, ids (little-endian unsigned 32-bit)."""
    path = path or model_path()
    schema = T.StructType([docs.schema[id_col], T.StructField("n_chars", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(id_col, F.col(text_col).cast("string").alias("t")).mapInArrow(lambda batches: encoded(batches, path, id_col), schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The encoded rows with the decoded text."""
    path = path or model_path()
    return rows.mapInArrow(lambda batches: decoded(batches, path), T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))


def digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, n_ids, ids_crc32 and the SHA-1 of the text decoded from the ids. Both ways
    run in one worker, so that neither ids nor texts travel between processes."""
    path = path or model_path()

    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        for b in decoded(encoded(batches, path, id_col), path):
            ids = [x.as_py() for x in b.column(2)]
            sums = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), sums, pa.array([hashlib.sha1(t.as_py().encode()).hexdigest() for t in b.column(3)])], names=[id_col, "n_chars", "n_ids", "ids_crc32", "decoded_sha1"])

    long = T.LongType()
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, long) for n in ("n_chars", "n_ids", "ids_crc32")), T.StructField("decoded_sha1", T.StringType())])
    return docs.select(id_col, F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
