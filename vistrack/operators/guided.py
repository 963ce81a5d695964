"""Guided matching along epipolar lines: overlapping grids turn the band join into an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistrack.functions.geometry import clip_line, epipolar_line, line_distance
from vistrack.session import stored

#: Lines, and keys, of a task of band_counts; lines that meet its keys at once.
BLOCK, ROWS = 8192, 256


def lattice_cells(x: Column, y: Column, cell: int) -> list[tuple[Column, Column, Column]]:
    """(cx, cy, squared distance to the cell center) in four grids shifted by half a cell."""
    out = []
    for ox, oy in ((0.0, 0.0), (cell / 2, 0.0), (0.0, cell / 2), (cell / 2, cell / 2)):
        cx, cy = F.floor((x - ox) / cell), F.floor((y - oy) / cell)
        dx, dy = x - (cx * cell + ox + cell / 2), y - (cy * cell + oy + cell / 2)
        out.append((cx, cy, dx * dx + dy * dy))
    return out


def grid(keys: DataFrame, cell: int, width: int, height: int, x: str = "x", y: str = "y", border: int | None = None) -> DataFrame:
    """keys with (g, cx, cy) once in each grid; keys nearer to the border than ``border`` (one cell) are left out."""
    border = cell if border is None else border
    inside = F.col(x).between(border, width - border) & F.col(y).between(border, height - border)
    cells = F.array(*[F.struct(F.lit(g).alias("g"), cx.alias("cx"), cy.alias("cy")) for g, (cx, cy, _) in enumerate(lattice_cells(F.col(x), F.col(y), cell))])
    return keys.where(inside).withColumn("_c", F.explode(cells)).select(*keys.columns, "_c.g", "_c.cx", "_c.cy")


def nearest_cell(x: Column, y: Column, cell: int) -> tuple[Column, Column, Column]:
    """(g, cx, cy) of the cell whose center is nearest; ties by grid. The grids are shifted along each
    axis apart, so the nearest center is that of the nearer shift on each axis."""
    at = lambda v, o: F.floor((v - o) / cell)
    far = lambda v, o: F.abs(v - (at(v, o) * cell + o + cell / 2))
    gx, gy = (F.when(far(v, cell / 2) < far(v, 0.0), 1).otherwise(0) for v in (x, y))
    shifted = lambda v, g: at(v, g * (cell / 2))
    return gx + 2 * gy, shifted(x, gx), shifted(y, gy)


def cells_of(x: Column, y: Column, cell: int) -> Column:
    """All four cells of a point as an array of struct(g, cx, cy)."""
    return F.array(*[F.struct(F.lit(g).alias("g"), cx.alias("cx"), cy.alias("cy")) for g, (cx, cy, _) in enumerate(lattice_cells(x, y, cell))])


def buckets(gridded: DataFrame, *by: str, key: str | None = None) -> DataFrame:
    """Number of keys of each cell, and the first of them by the column ``key``, if one is named."""
    first = [F.min(key).alias("first")] if key else []
    return gridded.groupBy(*by, "g", "cx", "cy").agg(F.count("*").alias("n"), *first)


def fullest(counted: DataFrame, *by: str) -> DataFrame:
    """The largest number of keys in a cell."""
    return counted.groupBy(*by).agg(F.max("n").alias("most"))


def lines(queries: DataFrame, f: list[float] | Column, x: str = "x", y: str = "y") -> DataFrame:
    """queries with the coefficients (la, lb, lc) of their epipolar lines."""
    a, b, c = epipolar_line(f, F.col(x).cast("double"), F.col(y).cast("double"))
    return queries.select("*", a.alias("la"), b.alias("lb"), c.alias("lc"))


def band_candidates(lined: DataFrame, gridded: DataFrame, cell: int, step: int, width: int, height: int, band: float, query: list[str], target: list[str]) -> DataFrame:
    """(query columns, target columns, dist): all keys of view ``target_view`` within ``band`` of the line.

    The line is clipped to the image and sampled along its length at most ``step`` apart, its ends among the
    samples. A key's way to its nearest sample is at most the hypotenuse of step / 2 and band. A sample is
    within a quarter of a cell of the center of its nearest cell, so that cell holds all keys up to a quarter of
    a cell away; the four cells of a sample together hold those up to half a cell away. The sample looks
    into the one or the four, as the way demands; beyond that an error is raised. Keys are taken to be
    further than band from the border, as grid() leaves them.
    """
    way = ((step / 2) ** 2 + band**2) ** 0.5
    if way > cell / 2:
        raise ValueError(f"cells of {cell} with samples {step} apart do not cover a band of {band}")
    # the explode of one value keeps the plan from writing the clipped line out at each of its uses
    s = lined.withColumn("_e", F.explode(F.array(clip_line(F.col("la"), F.col("lb"), F.col("lc"), width, height)))).where("_e IS NOT NULL")
    length = F.sqrt((F.col("_e.x1") - F.col("_e.x0")) ** 2 + (F.col("_e.y1") - F.col("_e.y0")) ** 2)
    n = F.greatest(F.lit(1), F.ceil(length / step)).cast("int")
    s = s.select("*", n.alias("_n"), F.explode(F.sequence(F.lit(0), n)).alias("_i"))
    at = lambda a, b: F.col(f"_e.{a}") + (F.col(f"_e.{b}") - F.col(f"_e.{a}")) * F.col("_i") / F.col("_n")
    if way <= cell / 4:
        g, cx, cy = nearest_cell(at("x0", "x1"), at("y0", "y1"), cell)
        cells = s.select(*query, "target_view", "la", "lb", "lc", g.alias("g"), cx.alias("cx"), cy.alias("cy")).distinct()
    else:
        cells = s.select(*query, "target_view", "la", "lb", "lc", F.explode(cells_of(at("x0", "x1"), at("y0", "y1"), cell)).alias("_c")).select(*query, "target_view", "la", "lb", "lc", "_c.g", "_c.cx", "_c.cy").distinct()
    keys = gridded.select(F.col("view").alias("target_view"), "g", "cx", "cy", *[F.col(c).alias(f"t_{c}") for c in target])
    hit = cells.join(keys, ["target_view", "g", "cx", "cy"]).withColumn("dist", line_distance(F.col("la"), F.col("lb"), F.col("lc"), F.col("t_x"), F.col("t_y")))
    return hit.where(F.col("dist") < band).select(*query, "target_view", *[f"t_{c}" for c in target], "dist").distinct()


def band_counts(lined: DataFrame, keys: DataFrame, band: float, query: list[str], target: list[str], block: int = BLOCK) -> DataFrame:
    """(query columns, n, first, nearest): of the different keys (target columns, all numbers, x and y among them) of view
    ``target_view`` within ``band`` of one of the lines of a query, their number, the least first target column and
    the least distance. The query columns are whole numbers. Queries without such a key drop out.

    Lines meet keys in whole arrays: a task holds about ``block`` lines of a view, all of a query among them, and
    about ``block`` keys, whatever their number in the view, and makes one row a query.
    """
    lines_ = lined.where("la IS NOT NULL AND lb IS NOT NULL AND lc IS NOT NULL").select("target_view", *query, "la", "lb", "lc").distinct()
    keys = keys.select(F.col("view").alias("target_view"), *[F.col(c).alias(f"t_{c}") for c in target]).distinct()
    parts = lambda df, name: df.groupBy("target_view").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias(name))
    n = stored(parts(lines_, "nl").join(parts(keys, "nk"), "target_view"), "band-parts")
    every = lambda c, name: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(name)
    dealt = lambda c, of: F.pmod(F.xxhash64(*c), F.col(of)).cast("int")
    own = lines_.join(n, "target_view").select("target_view", dealt(query, "nl").alias("i"), every("nk", "j"), *query, "la", "lb", "lc")
    other = keys.join(n, "target_view").select("target_view", every("nl", "i"), dealt([f"t_{c}" for c in target], "nk").alias("j"), *[f"t_{c}" for c in target])
    kinds = {f.name: f.dataType.simpleString() for f in keys.schema.fields}
    schema = ", ".join([*(f"`{c}` {lines_.schema[c].dataType.simpleString()}" for c in query), "n long", f"first {kinds[f't_{target[0]}']}", "nearest double"])

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        asked = [left[c].to_numpy() for c in query]
        order = np.lexsort(asked[::-1])
        asked = [c[order] for c in asked]
        la, lb, lc = (left[c].to_numpy()[order] for c in ("la", "lb", "lc"))
        first, x, y = (right[f"t_{c}"].to_numpy() for c in (target[0], "x", "y"))
        by = np.argsort(first, kind="stable")
        first, x, y = first[by], x[by], y[by]
        starts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in asked], axis=0))) if len(la) else np.zeros(0, int)
        ends, out, at = np.append(starts[1:], len(la)), [], 0
        while at < len(starts):
            stop = min(len(starts), max(at + 1, int(np.searchsorted(ends, starts[at] + ROWS, "right"))))
            some = slice(int(starts[at]), int(ends[stop - 1]))
            length = np.sqrt(la[some] * la[some] + lb[some] * lb[some])
            d = la[some, None] * x
            d += lb[some, None] * y
            d += lc[some, None]
            with np.errstate(all="ignore"):
                np.abs(d, out=d)
                d /= length[:, None]
                d[~(d < band)] = np.inf
            d = np.minimum.reduceat(d, starts[at:stop] - starts[at], axis=0)
            inside = np.isfinite(d)
            hit = inside.any(1)
            own = starts[at:stop][hit]
            out.append([*(c[own] for c in asked), inside[hit].sum(1), first[inside[hit].argmax(1)], d[hit].min(1)])
            at = stop
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [c[:0] for c in (*asked, starts, first, la)]
        return pa.Table.from_arrays([pa.array(c) for c in cols], names=[*query, "n", "first", "nearest"])

    found = own.groupBy("target_view", "i", "j").cogroup(other.groupBy("target_view", "i", "j")).applyInArrow(run, schema)
    return found.groupBy(*query).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min("nearest").alias("nearest"))


def padded(candidates: DataFrame, keys: DataFrame, least: int, seed: int = 0) -> DataFrame:
    """candidates (a, ka, b, kb) of queries that have some but fewer than ``least``, filled up with further keys
    (image, key) of the target image in the order of a seeded hash: the same ones in every run."""
    some = candidates.groupBy("a", "ka", "b").agg(F.count("*").alias("n")).where(F.col("n") < least)
    more = some.join(keys.select(F.col("image").alias("b"), F.col("key").alias("kb")), "b").join(candidates.select("a", "ka", "b", "kb"), ["a", "ka", "b", "kb"], "left_anti")
    w = Window.partitionBy("a", "ka", "b").orderBy(F.xxhash64(F.lit(seed), "a", "b", "ka", "kb"), "kb")
    more = more.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= least - F.col("n"))
    return candidates.select("a", "ka", "b", "kb").union(more.select("a", "ka", "b", "kb"))


def pack4(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Four numbers of 16 bits as one long."""
    out = F.lit(0).cast("long")
    for v in (a, b, c, d):
        out = F.shiftleft(out, 16).bitwiseOR(v.cast("long").bitwiseAND(F.lit(0xFFFF)))
    return out


def unpack4(p: Column) -> list[Column]:
    """Signed values of pack4."""
    return [(F.shiftrightunsigned(p, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.lit(0x8000)) - 0x8000) for i in range(4)]


def line_clusters(rows: DataFrame, by: str, ends: list[str], gap: int = 2) -> DataFrame:
    """Gaps and islands: a row starts a cluster unless each of its four line ends is within less than
    ``gap`` of the row before it in packed order. cluster counts from 1 in each group of ``by``."""
    w = Window.partitionBy(by).orderBy(*ends)
    near = None
    for e in ends:
        ok = F.abs(F.col(e) - F.lag(e).over(w)) < gap
        near = ok if near is None else near & ok
    flagged = rows.withColumn("new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    return flagged.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def anchor_clusters(rows: DataFrame, by: str, ends: list[str], limit: int = 4) -> DataFrame:
    """The sequential rule: a row joins the current group while both its ends are within a city-block
    distance of ``limit`` of the group's first line. An ordered fold; a group is one image pair."""

    def run(pdf):
        pdf = pdf.sort_values(ends)
        anchor, n, out = None, 0, []
        for r in pdf[ends].itertuples(index=False):
            if anchor is None or abs(r[0] - anchor[0]) + abs(r[1] - anchor[1]) >= limit or abs(r[2] - anchor[2]) + abs(r[3] - anchor[3]) >= limit:
                anchor, n = r, n + 1
            out.append(n)
        return pdf.assign(cluster=out)

    from pyspark.sql import types as T

    return rows.groupBy(by).applyInPandas(run, T.StructType([*rows.schema.fields, T.StructField("cluster", T.LongType())]))


def first_group_clusters(rows: DataFrame, by: str, ends: list[str], limit: int = 4) -> DataFrame:
    """Like anchor_clusters, but a row joins the first of all groups so far whose first line is near enough, in
    the order of the column ``seq``. An ordered fold; a group is one image pair."""

    def run(pdf):
        pdf, anchors, out = pdf.sort_values("seq"), [], []
        for r in pdf[ends].itertuples(index=False):
            n = next((i for i, a in enumerate(anchors) if abs(r[0] - a[0]) + abs(r[1] - a[1]) < limit and abs(r[2] - a[2]) + abs(r[3] - a[3]) < limit), len(anchors))
            if n == len(anchors):
                anchors.append(r)
            out.append(n + 1)
        return pdf.assign(cluster=out)

    from pyspark.sql import types as T

    return rows.groupBy(by).applyInPandas(run, T.StructType([*rows.schema.fields, T.StructField("cluster", T.LongType())]))


def guided_match(keys: DataFrame, pairs: DataFrame, width: int, height: int, band: float, ratio: float = 0.6, least: int = 2, reverse: bool = True, border: int = 16, strict: bool = False) -> DataFrame:
    """(a, b, ka, kb, d1, d2): matches of keys (image, key, x, y, v) of image pairs (a, b, f).

    f is the fundamental matrix of the pair (nine numbers, row by row, in the keys' coordinates); a pair without one
    has no matches. Candidates of a key are the keys of b, further than ``border`` from the border, in the band of
    its epipolar line. The nearest by descriptor is a match if it passes the ratio test among at least ``least``
    candidates and (reverse) the key in turn is within the band of the epipolar line of the match.

    Lines meet the keys of b block by block, in whole arrays: of a pair's candidates no row is ever made. Sorted cells
    would leave about a tenth of the distances, at a hundred times the price of each (``band_candidates``).
    """
    from vistrack.operators.matching import ratio_test
    from vistrack.operators.search import nearest_two_tiled

    known = pairs.where("f IS NOT NULL").select("a", "b", "f").dropDuplicates(["a", "b"])
    inside = F.col("x").between(border, width - border) & F.col("y").between(border, height - border)
    best = ratio_test(nearest_two_tiled(known, keys, keys.where(inside), band=band), ratio, strict).where(F.col("n") >= least)
    if reverse:
        side = lambda image, key, x, y: keys.select(F.col("image").alias(image), F.col("key").alias(key), F.col("x").cast("double").alias(x), F.col("y").cast("double").alias(y))
        placed = best.join(known, ["a", "b"]).join(side("a", "ka", "xa", "ya"), ["a", "ka"]).join(side("b", "kb", "xb", "yb"), ["b", "kb"])
        back = epipolar_line(F.col("f"), F.col("xb"), F.col("yb"), transposed=True)
        best = placed.where(line_distance(*back, F.col("xa"), F.col("ya")) < band)
    return best.select("a", "b", "ka", "kb", "d1", "d2")


def match_candidates(keys: DataFrame, candidates: DataFrame, ratio: float = 0.6, least: int = 2, strict: bool = False) -> DataFrame:
    """(a, b, ka, kb, d1, d2): the ratio test among given candidates (a, ka, b, kb), such as ``padded`` makes of those
    of ``band_candidates``, of at least ``least``. With strict, a ratio of 0.6 and least = 10 this is the rule of
    searches on graphics cards."""
    from vistrack.operators.matching import ratio_test
    from vistrack.operators.search import nearest_two_tiled

    given = stored(candidates.select("a", "ka", "b", "kb").distinct(), "guided-candidates")
    return ratio_test(nearest_two_tiled(given, keys, keys, only=given), ratio, strict).where(F.col("n") >= least).drop("n")
