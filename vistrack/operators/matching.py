"""Nearest-neighbor matching of keypoint descriptors inside image pairs.

Distances are exact squared L2 in double precision. ``nearest_two`` takes candidates that a join has found, with
their distances; whole images are searched by tiles (vistrack.operators.search).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistrack.operators.search import two_smallest

RATIO = 0.6


def squared(a: str, b: str, dim: int) -> Column:
    total = None
    for i in range(dim):
        d = F.get(F.col(a), F.lit(i)).cast("double") - F.get(F.col(b), F.lit(i)).cast("double")
        total = d * d if total is None else total + d * d
    return total


def candidates(keys: DataFrame, pairs: DataFrame, dim: int) -> DataFrame:
    """(a, b, ka, kb, d) of all keys of two images, squared distance."""
    left = keys.select(F.col("image").alias("a"), F.col("key").alias("ka"), F.col("v").alias("va"))
    right = keys.select(F.col("image").alias("b"), F.col("key").alias("kb"), F.col("v").alias("vb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ka", "kb", squared("va", "vb", dim).alias("d"))


def nearest_two(cand: DataFrame) -> DataFrame:
    """(a, b, ka, kb, d1, d2): nearest key, its distance and the second distance; ties by key. Ids are whole numbers."""
    return two_smallest(cand, "a", "b", "ka")


def ratio_test(two: DataFrame, ratio: float = RATIO, strict: bool = False) -> DataFrame:
    """Keep a match if d1 <= ratio^2 * d2 (strict: <); a key without a second neighbor has no match."""
    bound = F.lit(ratio * ratio) * F.col("d2")
    return two.where(F.col("d2").isNotNull() & ((F.col("d1") < bound) if strict else (F.col("d1") <= bound)))


def mutual(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Matches that both directions agree on; backward has the images swapped."""
    back = backward.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("kb").alias("ka"), F.col("ka").alias("kb"))
    return forward.select("a", "b", "ka", "kb").join(back, ["a", "b", "ka", "kb"], "left_semi")


def unique_target(matches: DataFrame) -> DataFrame:
    """The first query (in key order) keeps a target."""
    w = Window.partitionBy("a", "b", "kb").orderBy("ka")
    return matches.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def enough(matches: DataFrame, least: int = 16) -> DataFrame:
    """Matches of pairs with at least ``least`` of them."""
    n = matches.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return matches.join(n, ["a", "b"])


def scale_rank(keys: DataFrame) -> DataFrame:
    """Adds pos (0-based order of a key in its image, keys being sorted by scale) and n."""
    w = Window.partitionBy("image")
    return keys.withColumn("pos", F.row_number().over(w.orderBy("key")) - 1).withColumn("n", F.count("*").over(w))


def prefix(keys: DataFrame, percent: int, small: int = 0) -> DataFrame:
    """The first percent of an image's keys; all of them below ``small`` keys."""
    k = scale_rank(keys)
    return k.where((F.col("pos") < F.expr(f"n * {percent} div 100")) | (F.col("n") < small))


def two_batches(first: DataFrame, second: DataFrame, gate: int = 4) -> DataFrame:
    """Matches of the first batch, and of the second where the first found at least ``gate``."""
    ok = first.groupBy("a", "b").count().where(F.col("count") >= gate).select("a", "b")
    return first.union(second.join(ok, ["a", "b"], "left_semi"))


def rank_edges(matches: DataFrame) -> DataFrame:
    """(src, dst, n) in both directions."""
    n = matches.groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n").union(n.select(F.col("b").alias("src"), F.col("a").alias("dst"), "n"))


#: Centers of a vocabulary that keys meet at once; a larger one is met block by block.
WORDS = 20_000


def visual_words(keys: DataFrame, centers: DataFrame, dim: int, k: int = 1, block: int | None = None) -> DataFrame:
    """(image, key, rank, word, d): the k nearest centers (word, v), ties by word.

    Every key meets every center, by nature. Centers are counted and broadcast in blocks of at most about
    ``block``; of each block only a key's k nearest go on.
    """
    block = block or WORDS
    c, blocks = centers.select("word", F.col("v").alias("vc")), max(1, -(-centers.count() // block))
    w = Window.partitionBy("image", "key").orderBy("d", "word")
    best = None
    for i in range(blocks):
        part = c.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == i) if blocks > 1 else c
        near = keys.join(F.broadcast(part), F.lit(True)).select("image", "key", "word", squared("v", "vc", dim).alias("d"))
        # the nearest k before any shuffle: the plan limits groups ahead of the window
        near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        best = near if best is None else best.union(near)
    if blocks > 1:
        best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("image", "key", "rank", "word", "d")


def parent_words(assigned: DataFrame, parents: DataFrame) -> DataFrame:
    """Assigned words with their parent at a level of the vocabulary tree (parents: word, parent)."""
    return assigned.join(parents, "word", "left")


def batch_size(n: Column, other_side: bool = False, least: int = 200) -> Column:
    """Keys of an image that a prefix match takes: a tenth (a fifth of the reference side), but at least
    ``least`` where there are so many, else all."""
    return F.least(n, F.greatest(F.floor(n / (5 if other_side else 10)), F.lit(least)))
