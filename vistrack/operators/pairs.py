"""Which views belong together: covisibility, candidate pairs, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistrack.plans.ranking import global_rank
from vistrack.session import parts_for

#: Observations for each task that counts pairs.
TASK_ROWS = 500_000


def view_ranges(known: DataFrame, tasks: int) -> tuple[Column, int, bool]:
    """(g, their number, whether views are ints): groups of views near in number with about equal rows. Equal steps of
    numbers are counted and put together in order; a step with more rows than a task should have is dealt by hash."""
    dtype = dict(known.dtypes)["view"]
    number = F.col("view").cast("long") if dtype in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("view")
    lo, hi, rows = known.agg(F.min(number), F.max(number), F.count("*")).first()
    if not rows:
        return F.lit(0), 1, False
    shift = next(s for s in range(64) if (hi >> s) - (lo >> s) < 16 * tasks)
    step = F.shiftright(number, shift) - F.lit(lo >> shift).cast("long")
    first, dealt, groups, held = [0] * (16 * tasks), [1] * (16 * tasks), 0, 0
    for at, n in sorted(known.groupBy(step.alias("at")).count().collect()):
        own = -(-n * tasks // rows)
        if held and (own > 1 or (held + n) * tasks > rows):
            groups, held = groups + 1, 0
        first[at], dealt[at], held = groups, own, held + n
        groups, held = (groups + own, 0) if own > 1 else (groups, held)
    of = lambda numbers: F.get(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>"), step.cast("int"))
    return (of(first) + F.pmod(F.xxhash64("view"), of(dealt)).cast("int")).cast("int"), groups + 1, dtype != "string" and -(2**31) <= lo and hi < 2**31


def covisibility(obs: DataFrame, diagonal: bool = False, least: int = 1) -> DataFrame:
    """(v1, v2, n): shared points of two views as a bag join, in both directions.

    Repeated (view, point) rows are counted once and multiplied, which gives the bag join's number
    from fewer rows. Each unordered pair is counted once and mirrored after the aggregation.

    Views are grouped by ranges of their numbers, a group a task. The views of a point are listed by group, and the list is
    sent once to each group that it meets, from there on; there all pairs of a view of the group and one behind it are
    counted. So a pair costs at most an entry of a list, and much less where the views of a point are near in number; it
    is met in one task only. Groups get more with the rows, so that none has to hold more pairs.
    """
    known = obs.where("view IS NOT NULL AND point IS NOT NULL")
    dtype = dict(obs.dtypes)["view"]
    tasks = parts_for(obs.sparkSession, known.count(), TASK_ROWS)
    group, groups, ints = view_ranges(known, tasks)
    one = known.repartition(tasks, "point").groupBy("point", "view").agg(F.count("*").alias("c"))
    view = F.col("view").cast("int") if ints else F.col("view")
    lists = one.groupBy("point").agg(F.sort_array(F.collect_list(F.struct(group.alias("g"), view.alias("w"), F.col("c").alias("k")))).alias("l"))
    g = lambda i: F.get("l", i).getField("g")
    starts = lists.select("l", F.exists("l", lambda e: e.getField("k") > 1).alias("many"), F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: (i == 0) | (g(i) != g(i - 1))).alias("s"))
    each = starts.select("l", "many", "s", F.posexplode("s").alias("i", "at"))
    each = each.select("l", "many", "at", F.coalesce(F.get("s", F.col("i") + 1), F.size("l")).alias("end")).where(F.size("l") - F.col("at") > (0 if diagonal else 1))
    behind = lambda c: F.slice(F.col("l").getField(c), F.col("at") + 1, F.size("l"))
    sent = each.select(g(F.col("at")).alias("g"), behind("w").alias("w"), F.when(F.col("many"), behind("k")).alias("k"), (F.col("end") - F.col("at")).alias("own"))
    dealt = sent.repartitionById(groups, "g")
    met = dealt.select("g", "w", "k", "own", F.posexplode("w").alias("i", "v1")).where("i < own").select("g", "k", "i", "v1", F.posexplode("w").alias("j", "v2"))
    met = met.where(F.col("j") >= F.col("i") if diagonal else F.col("j") > F.col("i"))
    half = met.groupBy("g", "v1", "v2").agg(F.sum(F.coalesce(F.get("k", F.col("i")) * F.get("k", F.col("j")), F.lit(1).cast("long"))).alias("n")).where(F.col("n") >= least)
    half = half.select(F.col("v1").cast(dtype).alias("v1"), F.col("v2").cast(dtype).alias("v2"), "n")
    both = F.when(F.col("v1") == F.col("v2"), F.array(F.struct("v1", "v2"))).otherwise(F.array(F.struct("v1", "v2"), F.struct(F.col("v2").alias("v1"), F.col("v1").alias("v2"))))
    return half.select(F.explode(both).alias("p"), "n").select("p.v1", "p.v2", "n")


def top_neighbors(covis: DataFrame, n: int, least: int = 4) -> DataFrame:
    """The n most covisible views of each view, ties by ascending id."""
    w = Window.partitionBy("v1").orderBy(F.desc("n"), "v2")
    return covis.where(F.col("n") >= least).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def candidate_views(covis: DataFrame, n: int, least: int = 4, floor: int = 20) -> DataFrame:
    """Acceptance rule of candidate lists: the first n if there are n, all if at least ``floor``, else none."""
    t = covis.where(F.col("n") >= least)
    size = F.count("*").over(Window.partitionBy("v1"))
    rn = F.row_number().over(Window.partitionBy("v1").orderBy(F.desc("n"), "v2"))
    t = t.withColumn("size", size).withColumn("rn", rn)
    return t.where((F.col("rn") <= n) & ((F.col("size") >= n) | (F.col("size") >= floor))).select("v1", "v2", "n", "rn")


def unique_pairs(neighbors: DataFrame) -> DataFrame:
    return neighbors.select(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b")).distinct()


def two_hop(covis: DataFrame, n: int, least: int = 4) -> DataFrame:
    """Neighbors and neighbors of neighbors, filled to n: first the direct ones, then round-robin over
    the direct neighbors in rank order, each giving its next best not yet taken view."""
    hop1 = top_neighbors(covis, n, least).select("v1", "v2", F.col("rn").alias("r1"))
    hop2 = top_neighbors(covis, n, least).select(F.col("v1").alias("v2"), F.col("v2").alias("v3"), F.col("rn").alias("r2"))
    far = hop1.join(hop2, "v2").where("v1 <> v3").join(hop1.select("v1", F.col("v2").alias("v3")), ["v1", "v3"], "left_anti")
    first = Window.partitionBy("v1", "v3").orderBy("r2", "r1")
    far = far.withColumn("k", F.row_number().over(first)).where("k = 1").select("v1", "v3", "r2", "r1")
    both = hop1.select("v1", F.col("v2").alias("view"), F.lit(1).alias("level"), F.lit(0).alias("x"), F.col("r1").alias("y")).union(far.select("v1", F.col("v3").alias("view"), F.lit(2).alias("level"), F.col("r2").alias("x"), F.col("r1").alias("y")))
    w = Window.partitionBy("v1").orderBy("level", "x", "y", "view")
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("v1", "view", "level", "rn")


def two_hop_quota(covis: DataFrame, direct: int, n: int, least: int = 4) -> DataFrame:
    """(v1, view, rn): the ``direct`` best neighbors of each view, filled up to n with their neighbors by weight.

    Sources are the direct neighbors in their order, weighted by the points they share with v1. In turn each gives
    the next views of its own list (by common points) that are neither v1 nor taken, as many as its share of what is
    still to be filled, rounded up; rounds go on until nothing is left to fill or to give. Shares are exact. Of each
    list the first n + 1 views suffice, as no more than n are taken, so a group has at most direct x (n + 1) rows.
    """
    hop1 = top_neighbors(covis, direct, least).select("v1", "v2", "n", F.col("rn").alias("r1"))
    hop2 = top_neighbors(covis, n + 1, least).select(F.col("v1").alias("v2"), F.col("v2").alias("v3"), F.col("rn").alias("r2"))

    def fill(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: (r["r1"], r["r2"] or 0))
        v1, weight, lists = rows[0]["v1"], {}, {}
        for r in rows:
            weight[r["v2"]] = r["n"]
            lists.setdefault(r["v2"], []).extend([r["v3"]] if r["v3"] is not None else [])
        out, at, total = list(weight), dict.fromkeys(weight, 0), sum(weight.values())
        left = n - len(out)
        while left > 0 and any(at[s] < len(lists[s]) for s in weight):
            for s in weight:
                share = -(-weight[s] * left // total)
                while share > 0 and at[s] < len(lists[s]):
                    view = lists[s][at[s]]
                    at[s] += 1
                    if view != v1 and view not in out:
                        out.append(view)
                        share, left = share - 1, left - 1
        return pa.table({"v1": pa.array([v1] * len(out), pa.int64()), "view": pa.array(out, pa.int64()), "rn": pa.array(range(1, len(out) + 1), pa.int64())})

    rows = hop1.join(hop2, "v2", "left").select(*[F.col(c).cast("long").alias(c) for c in ("v1", "v2", "n", "r1", "v3", "r2")])
    return rows.groupBy("v1").applyInArrow(fill, "v1 long, view long, rn long")


def all_pairs(images: DataFrame) -> DataFrame:
    """All i < j, the side with fewer features first (ties: lower id first). The image table is the
    small side of the model: one row an image, so the theta join is broadcast."""
    a, b = images.select(F.col("image").alias("i"), F.col("n").alias("ni")), images.select(F.col("image").alias("j"), F.col("n").alias("nj"))
    p = a.join(b, F.col("i") < F.col("j"))
    swap = F.col("nj") < F.col("ni")
    return p.select(F.when(swap, F.col("j")).otherwise(F.col("i")).alias("a"), F.when(swap, F.col("i")).otherwise(F.col("j")).alias("b"))


def shard_ceil(pairs: DataFrame, shards: int, *order: str) -> DataFrame:
    """Contiguous shards of ceil(n / shards) rows."""
    ranked, n = global_rank(pairs, *order)
    size = max(1, -(-n // shards))
    return ranked.withColumn("shard", F.expr(f"(rn - 1) div {size}"))


def shard_floor(pairs: DataFrame, shards: int, *order: str) -> DataFrame:
    """Contiguous shards of floor(n / shards) rows, the last with the rest."""
    ranked, n = global_rank(pairs, *order)
    size = max(1, n // shards)
    return ranked.withColumn("shard", F.expr(f"least((rn - 1) div {size}, {shards - 1})"))


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose left has one right and whose right then has one left."""
    good = pairs.groupBy(left).agg(F.count_distinct(right).alias("_n")).where("_n = 1").select(left)
    p = pairs.distinct().join(good, left, "left_semi")
    good = p.groupBy(right).agg(F.count_distinct(left).alias("_n")).where("_n = 1").select(right)
    return p.join(good, right, "left_semi").select(left, right)
