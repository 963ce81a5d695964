"""Descriptor search by tiles, with a mergeable two-smallest state and frontiers that shrink round by round.

The state of a search is (d1, id, d2, n): the nearest target, its distance, the second distance, the number of targets
met. States of parts of
the targets merge into that of the whole, so each task reduces what it sees to states before anything is shuffled;
no distance is sorted by the plan or sent whole. A search of images cuts both into blocks of about BLOCK keys: a task
holds few blocks, whatever the size of an image. Matrix products find what may be among
the two nearest, and these few distances are computed anew in the order of the dimensions, so results are exact
and do not depend on the blocks; equal distances fall to the smallest id.

Searches that stop early go in rounds: each round joins only what is unresolved with the next part of the targets,
and leaves a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistrack.session import stored

#: Keys of a tile, keys of a block (about: keys are dealt by hash), keys of a tile that meet a block at once, candidates
#: reduced at once in a task.
TILE, BLOCK, STEP, ROWS = 1024, 8192, 256, 1 << 18
#: One of so many keys in a band, or fewer: their distances are computed without a product.
SPARSE = 20
TWO = "a long, b long, ka long, kb long, d1 double, d2 double, n long"


def merged_two(states: DataFrame, *by: str, id_col: str = "kb") -> DataFrame:
    """One state (by, id, d1, d2, n) from the states of parts. The number of states of a group is that of the tasks
    or tiles that met it."""
    best = F.sort_array(F.collect_list(F.struct("d1", id_col, "d2")))
    two = states.groupBy(*by).agg(best.alias("s"), F.sum("n").alias("n"))
    d2 = F.least(F.get("s", F.lit(0))["d2"], F.get("s", F.lit(1))["d1"])
    return two.select(*by, F.get("s", F.lit(0))[id_col].alias(id_col), F.get("s", F.lit(0))["d1"].alias("d1"), d2.alias("d2"), "n")


def two_smallest(cand: DataFrame, *by: str, id_col: str = "kb", d: str = "d") -> DataFrame:
    """(by, id, d1, d2, n) of candidates (by, id, d), all but d whole numbers; d2 is null for a single candidate.
    A repeated id counts again; null distances do not count. Tasks reduce ROWS candidates at a time to states."""
    names = [*by, id_col, "d1", "d2", "n"]

    def reduce(rows):
        import numpy as np
        import pyarrow as pa

        cols = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in rows]) for i in range(len(names) - 2)]
        order = np.lexsort((cols[-2], cols[-1], *reversed(cols[:-2])))
        cols = [c[order] for c in cols]
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:-2]], axis=0) if by else False
        at = np.flatnonzero(new)
        second = np.minimum(at + 1, len(order) - 1)
        none = (second == at) | new[second]
        size = np.diff(np.append(at, len(order)))
        return pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in cols), pa.array(cols[-1][second], mask=none), pa.array(size)], names=names)

    def run(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= ROWS:
                yield reduce(held)
                held, n = [], 0
        if held:
            yield reduce(held)

    schema = ", ".join([*(f"{c} long" for c in (*by, id_col)), "d1 double", "d2 double", "n long"])
    known = cand.select(*(F.col(c).cast("long").alias(c) for c in (*by, id_col)), F.col(d).cast("double").alias("d")).where("d IS NOT NULL")
    return merged_two(known.mapInArrow(run, schema), *by, id_col=id_col)


def tiles(counts: DataFrame, tile: int = TILE) -> DataFrame:
    """(image, tiles) from counts (image, n)."""
    return counts.select("image", F.greatest(F.lit(1), F.ceil(F.col("n") / tile)).cast("int").alias("tiles"))


def _tile(key: str, of: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(of)).cast("int")


def nearest_two_tiled(pairs: DataFrame, left: DataFrame, right: DataFrame, both: bool = False, only: DataFrame | None = None, queries: DataFrame | None = None, band: float | None = None, tile: int = TILE, block: int | None = None) -> DataFrame:
    """(a, b, ka, kb, d1, d2, n): of each key of image a of each pair (a, b) the nearest key of image b.

    left and right are tables (image, key, v) of the keys that take part; keys without descriptor do not. both:
    also the states of the keys of b in image a, as rows (b, a, kb, ka, d1, d2, n), from the same distances. only:
    candidates (a, b, ka, kb), all others are left out. queries: (a, b, ka), the keys of a pair that are looked for.
    band: pairs have a matrix f and keys have x, y; only keys within that distance of the line f (x, y, 1) count.

    Images are cut into blocks of about ``block`` keys (never less than a tile). A task holds one block of an image a
    and blocks of its partners with about as many keys, one more at most: a key of a is sent once for so many keys of
    partners, one of b once for each block of its partners. Descriptors travel in the type they have. tile: keys of a
    that numpy takes at once; it decides nothing about what is sent.
    """
    block = max(tile, block or BLOCK)
    p = pairs.select("a", "b", *(["f"] if band is not None else [])).dropDuplicates(["a", "b"])
    xy = [F.col(c).cast("double").alias(c) for c in ("x", "y")] if band is not None else []
    kind = "array<float>" if all(k.schema["v"].dataType.simpleString() == "array<float>" for k in (left, right)) else "array<double>"
    sides = [k.where("v IS NOT NULL").select("image", "key", F.col("v").cast(kind).alias("v"), *xy) for k in (left, right)]
    counts = [stored(k.groupBy("image").agg(F.count("*").alias("n")), "search-counts") for k in (sides[:1] if left is right else sides)]
    counts = [counts[0], counts[-1]]
    # images within a block have one state a key, which needs no merging
    whole = (counts[0].union(counts[1]).agg(F.max("n")).first()[0] or 0) <= block
    na, nb = (tiles(c, block) for c in counts)
    per = nb.join(counts[1], "image").select(F.col("image").alias("b"), F.col("tiles").alias("nb"), (F.col("n") / F.col("tiles")).alias("size"))
    p = p.join(na.select(F.col("image").alias("a"), F.col("tiles").alias("na")), "a").join(per, "b")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    so_far = F.sum("size").over(Window.partitionBy("a").orderBy("b", "tb").rowsBetween(Window.unboundedPreceding, -1))
    items = p.select("*", every("nb", "tb")).withColumn("g", F.floor(F.coalesce(so_far, F.lit(0.0)) / block).cast("int"))
    items = stored(items.select("a", "b", "na", "nb", "tb", "g", *(["f"] if xy else [])), "search-items")
    placed = lambda k, n: k.join(n, "image").withColumn("t", _tile("key", "tiles"))
    own = placed(sides[0], na).select(F.col("image").alias("a"), F.col("t").alias("ta"), F.col("key").alias("ka"), F.col("v").alias("va"), *[c for c in ("x", "y") if xy])
    if queries is not None:
        own = own.join(queries.select("a", "ka").distinct(), ["a", "ka"], "left_semi")
    null = lambda c, k: F.lit(None).cast(k).alias(c)
    more = [c for c in ("x", "y") if xy]
    la = items.select("a", "g").distinct().join(own, "a").select("a", "g", "ta", null("b", "long"), "ka", null("kb", "long"), "va", *more)
    # rows without a descriptor tell which keys of a, or which candidates, count for a partner
    marks = [null("va", kind), *(null(c, "double") for c in more)]
    if queries is not None:
        asked = queries.select("a", "b", "ka").distinct().join(items.select("a", "b", "na", "g").distinct(), ["a", "b"])
        la = la.union(asked.select("a", "g", _tile("ka", "na"), "b", "ka", null("kb", "long"), *marks))
    if only is not None:
        given = only.select("a", "b", "ka", "kb").distinct().join(p.select("a", "b", "na", "nb"), ["a", "b"]).withColumn("tb", _tile("kb", "nb"))
        given = given.join(items.select("a", "b", "tb", "g"), ["a", "b", "tb"])
        la = la.union(given.select("a", "g", _tile("ka", "na"), "b", "ka", "kb", *marks))
    other = placed(sides[1], nb).select(F.col("image").alias("b"), F.col("t").alias("tb"), F.col("key").alias("kb"), F.col("v").alias("vb"), *[F.col(c).alias(f"{c}b") for c in more])
    spread = items.select("a", "g", "b", "tb", every("na", "ta2"))
    lb = spread.join(other, ["b", "tb"]).select(F.col("a").alias("a2"), F.col("g").alias("g2"), "ta2", "b", "kb", "vb", *([*(f"{c}b" for c in more), null("f", "array<double>")] if xy else []))
    if xy:  # the matrix of a pair, once for each task
        lb = lb.union(items.select("a", "g", "b", "na", "f").dropDuplicates(["a", "b", "g"]).select("a", "g", every("na", "ta2"), "b", null("kb", "long"), null("vb", kind), null("xb", "double"), null("yb", "double"), F.col("f").cast("array<double>")))
    marked, lined, asked_for, step = only is not None, band is not None, queries is not None, min(tile, STEP)

    def match(x, y):
        import numpy as np
        import pyarrow as pa

        names, kinds = ["a", "b", "ka", "kb", "d1", "d2", "n"], [*[pa.int64()] * 4, pa.float64(), pa.float64(), pa.int64()]
        own, keys = x.filter(x["va"].is_valid()), y.filter(y["vb"].is_valid())
        if not own.num_rows or not keys.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        a = own["a"][0].as_py()

        def columns(t, by, *more):
            """Columns of t as arrays, in the order of ``by``; descriptors as rows."""
            order = np.lexsort([t[c].to_numpy() for c in reversed(by)])
            flat = {c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for c in more if c[0] == "v"}
            return {c: (flat[c] if c in flat else t[c].to_numpy())[order] for c in (*by, *more)}

        def pick(t, b, c):
            return t[c][slice(*np.searchsorted(t["b"], [b, b + 1]))]

        own, keys = columns(own, ["ka"], "va", *(("x", "y") if lined else ())), columns(keys, ["b", "kb"], "vb", *(("xb", "yb") if lined else ()))
        ka, p, at_a = own["ka"], own["va"].astype(float), [own[c] for c in ("x", "y") if lined]
        told = x.filter(x["b"].is_valid())
        asked_keys, told = (columns(told.filter(some), ["b", "ka"], *more) for some, more in ((told["kb"].is_null(), ()), (told["kb"].is_valid(), ("kb",))))
        matrices = dict(zip(*(y.filter(y["f"].is_valid())[c].to_pylist() for c in ("b", "f")), strict=True)) if lined else {}
        states = []
        for b in np.unique(keys["b"]).tolist():
            kb, q, at_b = pick(keys, b, "kb"), pick(keys, b, "vb").astype(float), [pick(keys, b, c) for c in ("xb", "yb") if lined]
            k, v, place = ka, p, at_a
            if asked_for:
                looked = np.isin(ka, pick(asked_keys, b, "ka"))
                k, v, place = ka[looked], p[looked], [c[looked] for c in at_a]
                if not len(k):
                    continue
            if lined:
                states.append(_search(a, b, k, v, kb, q, step, _bands(matrices[b], place, at_b, band)))
            elif marked:
                ma, mb = pick(told, b, "ka"), pick(told, b, "kb")
                mi, mj = np.searchsorted(k, ma), np.searchsorted(kb, mb)
                sound = (mi < len(k)) & (mj < len(kb))
                mi, mj, ma, mb = mi[sound], mj[sound], ma[sound], mb[sound]
                sound = (k[mi] == ma) & (kb[mj] == mb)
                mi, mj = mi[sound], mj[sound]
                states.append(_states(a, b, k, kb, mi, mj, _exact(v, q, mi, mj)))
            else:
                states.append(_search(a, b, k, v, kb, q, step))
                if both:
                    states.append(_search(b, a, kb, q, k, v, step))
        if not states:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        cols = [np.concatenate(c) for c in zip(*states, strict=True)]
        return pa.Table.from_arrays([pa.array(c, k, mask=np.isinf(c) if n == "d2" else None) for c, k, n in zip(cols, kinds, names, strict=True)], names=names)

    found = la.groupBy("a", "g", "ta").cogroup(lb.groupBy("a2", "g2", "ta2")).applyInArrow(match, TWO)
    return found if whole else merged_two(found, "a", "b", "ka")


def _exact(p, q, i, j):
    """Squared distances of rows i of p and j of q, summed in the order of the dimensions."""
    import numpy as np

    total = np.zeros(len(i))
    for k in range(p.shape[1]):
        d = p[i, k] - q[j, k]
        total += d * d
    return total


def _states(a, b, ka, kb, i, j, d, n=None):
    """Columns a, b, ka, kb, d1, d2 (infinite if none), n from the pairs (i, j) of rows at distances d; n: the number of
    targets of each row, where the pairs are not all that was met. Rows of the same key have one state."""
    import numpy as np

    order = np.lexsort((kb[j], d, ka[i]))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.append(True, ka[i[1:]] != ka[i[:-1]])) if len(i) else np.zeros(0, int)
    size = np.diff(np.append(first, len(i)))
    d2 = np.where(size > 1, d[np.minimum(first + 1, max(0, len(i) - 1))], np.inf) if len(i) else np.zeros(0)
    count = size
    if n is not None and len(i):
        own = np.unique(i)  # sorted like the keys
        count = np.add.reduceat(n[own], np.flatnonzero(np.append(True, ka[own[1:]] != ka[own[:-1]])))
    return np.full(len(first), a), np.full(len(first), b), ka[i[first]], kb[j[first]], d[first], d2, count


def _bands(f, at_a, at_b, band):
    """A function of a slice of keys: which keys at_b lie within the band of their lines f (x, y, 1), as (keys, targets)."""
    import numpy as np

    l0, l1, l2 = (f[3 * r] * at_a[0] + f[3 * r + 1] * at_a[1] + f[3 * r + 2] for r in range(3))
    length = np.sqrt(l0 * l0 + l1 * l1)

    def inside(own):
        d = l0[own, None] * at_b[0]
        d += l1[own, None] * at_b[1]
        d += l2[own, None]
        with np.errstate(all="ignore"):
            np.abs(d, out=d)
            d /= length[own, None]
            return (d < band) & (length[own, None] > 0)

    return inside


def _search(a, b, ka, p, kb, q, rows: int = STEP, inside=None):
    """States of all rows of p among the rows of q, or of those that inside(slice) allows; ka is sorted."""
    import numpy as np

    out, q2 = [], (q * q).sum(1)
    finite = np.isfinite(q2)
    most = q2[finite].max(initial=1e-300)
    odd = not (finite.all() and np.isfinite(p).all())
    # a step ends where a key does, so that rows of the same key are met together
    ends = np.flatnonzero(np.append(ka[1:] != ka[:-1], True)) + 1
    at = 0
    while at < len(p):
        stop = int(ends[min(len(ends) - 1, np.searchsorted(ends, at + rows))])
        x, n = p[at:stop], np.full(stop - at, len(q))
        if inside is not None:
            allowed = inside(slice(at, stop))
            n = allowed.sum(1)
            if n.sum() * SPARSE <= allowed.size:  # fewer distances than a product is worth
                i, j = np.nonzero(allowed)
                out.append(_states(a, b, ka, kb, i + at, j, _exact(p, q, i + at, j)))
                at = stop
                continue
        x2 = (x * x).sum(1)
        d = x @ q.T
        d *= -2
        d += x2[:, None]
        d += q2
        if odd:
            d[~np.isfinite(d)] = np.inf
        if inside is not None:
            d[~allowed] = np.inf
        every = np.arange(len(x))
        top = d.argmin(1)
        least = d[every, top]
        d[every, top] = np.inf
        second = d.min(1) if len(q) > 1 else least
        d[every, top] = least
        second = np.where(np.isinf(second), least, second)
        # rounding of the product is far below this share of the squared lengths
        with np.errstate(invalid="ignore"):
            i, j = np.nonzero((d <= (second + 1e-11 * (x2 + most))[:, None]) & (d < np.inf))
        out.append(_states(a, b, ka, kb, i + at, j, _exact(p, q, i + at, j), np.concatenate([np.zeros(at, int), n])))
        at = stop
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def partitioned_nearest(keys: DataFrame, pairs: DataFrame, parts: int, ratio: float, tile: int = TILE) -> tuple[DataFrame, list[DataFrame]]:
    """Matches (a, b, ka, kb, part) and the frontiers: search the scale partitions of the reference image b in
    order with a running nearest and second; a key stops at the first partition after which the ratio test
    holds. Each round searches one partition for the keys that have no match yet, and no others."""
    from vistrack.operators.matching import ratio_test, scale_rank

    k = scale_rank(keys).select("image", "key", "v", F.least(F.expr(f"pos * {parts} div n"), F.lit(parts - 1)).alias("part"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("kb", "long"), ("d1", "double"), ("d2", "double"), ("n", "long"))]
    left = stored(pairs.select("a", "b").join(keys.where("v IS NOT NULL").select(F.col("image").alias("a"), F.col("key").alias("ka")), "a").select("a", "b", "ka", *none), "search-open")
    out, frontiers = None, [left]
    for part in range(parts):
        near = nearest_two_tiled(left.select("a", "b"), keys, k.where(F.col("part") == part), queries=left, tile=tile)
        state = merged_two(near.unionByName(left.where("kb IS NOT NULL")), "a", "b", "ka")
        state = stored(state.unionByName(left.where("kb IS NULL").join(near, ["a", "b", "ka"], "left_anti")), "search-state")
        hit = ratio_test(state, ratio).select("a", "b", "ka", "kb", F.lit(part).alias("part"))
        out = hit if out is None else out.union(hit)
        left = stored(state.join(hit, ["a", "b", "ka"], "left_anti"), "search-open")
        frontiers.append(left)
        if not left.head(1):
            break
    return out, frontiers


def smallest_caps(keys: DataFrame, pairs: DataFrame, ratio: float, first: int, least: int = 16, tile: int = TILE) -> DataFrame:
    """(a, b, cap, n): the first of the caps first, 2 first, 4 first ... with which a pair has at least ``least``
    matches among the first cap keys of either image; n matches. Keys beyond the cap do not compete. A round
    searches only pairs that no smaller cap resolved; a pair whose keys are all searched is given up."""
    from vistrack.operators.matching import ratio_test, scale_rank

    k = stored(scale_rank(keys).select("image", "key", "v", "pos", "n"), "search-ranked")
    most = k.groupBy("image").agg(F.max("n").alias("n"))
    sized = pairs.select("a", "b").distinct().join(most.select(F.col("image").alias("a"), F.col("n").alias("na")), "a").join(most.select(F.col("image").alias("b"), F.col("n").alias("nb")), "b")
    left = stored(sized.select("a", "b", F.greatest("na", "nb").alias("size")), "search-open")
    out, cap = None, first
    while True:
        some = k.where(F.col("pos") < cap)
        n = ratio_test(nearest_two_tiled(left, some, some, tile=tile), ratio).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        n = stored(n.select("a", "b", F.lit(cap).cast("long").alias("cap"), "n"), "search-caps")
        out = n if out is None else out.union(n)
        left = stored(left.where(F.col("size") > cap).join(n, ["a", "b"], "left_anti"), "search-open")
        if not left.head(1):
            return out
        cap *= 2


def prefix_rounds(keys: DataFrame, pairs: DataFrame, ratio: float, least: int = 1000, small: int = 100, skip: int = 4, enough: int = 200, tile: int = TILE) -> DataFrame:
    """Matches (a, b, ka, kb, round) of pairs whose image a has no more keys than b: first the largest tenth of a's
    keys in the largest fifth of b's (at least ``least`` keys, all where the share is below ``small``). Pairs with
    fewer than ``skip`` matches are given up, those with ``enough`` are done; the others are searched once more,
    twice as many keys of a in a fifth of b's, and kept if that gives ``enough``."""
    from vistrack.operators.matching import ratio_test, scale_rank

    k = stored(scale_rank(keys).select("image", "key", "v", "pos", "n"), "search-ranked")
    n = F.col("n")
    size = lambda share: F.when(n / share < small, n).otherwise(F.greatest(F.floor(n / share), F.lit(least)))
    tenth, fifth = size(10), size(5)

    def searched(some, own, other, number):
        got = ratio_test(nearest_two_tiled(some, k.where(F.col("pos") < own), k.where(F.col("pos") < other), tile=tile), ratio)
        return stored(got.select("a", "b", "ka", "kb", F.lit(number).alias("round")), "search-prefix")

    one = searched(pairs, tenth, fifth, 1)
    counts = one.groupBy("a", "b").agg(F.count("*").alias("m"))
    done, again = counts.where(F.col("m") >= enough), counts.where((F.col("m") >= skip) & (F.col("m") < enough))
    two = searched(stored(again.select("a", "b"), "search-open"), F.least(2 * tenth, F.greatest(fifth, tenth)), fifth, 2)
    kept = two.groupBy("a", "b").agg(F.count("*").alias("m")).where(F.col("m") >= enough)
    return one.join(done.select("a", "b"), ["a", "b"], "left_semi").union(two.join(kept.select("a", "b"), ["a", "b"], "left_semi"))
