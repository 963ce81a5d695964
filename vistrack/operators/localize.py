"""Localising images against a model: rank lists, visible points, 3D-2D votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistrack.session import parts_for

#: Points of neighbors for each task that counts them.
SEEN_ROWS = 500_000


def top_ranked(ranks: DataFrame, n: int = 50) -> DataFrame:
    """The n best neighbors of each image, ties by descending id."""
    w = Window.partitionBy("src").orderBy(F.desc("n"), F.desc("dst"))
    return ranks.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def visible_points(ranks: DataFrame, obs: DataFrame, n: int = 50, min_obs: int = 2) -> DataFrame:
    """(src, point, n_obs): points that at least min_obs of an image's ranked neighbors see."""
    near = top_ranked(ranks, n).select("src", F.col("dst").alias("view"))
    # dealt by image before any counting: neighbors rarely lie in one task, so that partial counts would save nothing
    seen = near.join(obs, "view").select("src", "point").repartition(parts_for(obs.sparkSession, n * obs.count(), SEEN_ROWS), "src")
    return seen.groupBy("src", "point").agg(F.count("*").alias("n_obs")).where(F.col("n_obs") >= min_obs)


def vote(hits: DataFrame) -> DataFrame:
    """(query, point, key) from hits (query, point, key, d).

    A key hit more than once wins by count (ties: smallest key); if none is, the nearest hit wins.
    """
    per = hits.groupBy("query", "point", "key").agg(F.count("*").alias("n"), F.min("d").alias("d"))
    w = Window.partitionBy("query", "point")
    top = per.withColumn("top", F.max("n").over(w))
    order = w.orderBy(F.when(F.col("top") > 1, -F.col("n")).otherwise(0), F.when(F.col("top") > 1, F.lit(0.0)).otherwise(F.col("d")), "key")
    return top.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("query", "point", "key", "n", "d")


def enough_correspondences(pairs: DataFrame, least: int = 16) -> DataFrame:
    n = pairs.groupBy("query").agg(F.count("*").alias("total")).where(F.col("total") >= least)
    return pairs.join(n, "query")


def point_hits(visible: DataFrame, obs: DataFrame, descriptors: DataFrame, queries: DataFrame, ratio: float = 0.6) -> DataFrame:
    """Hits (query, point, key, d) for vote(): the descriptor of each observation (point, view, key) of a point
    that a query may see (query, point), matched to the query's keys (query, key, v) with the ratio test.
    descriptors: (view, key, v)."""
    from vistrack.operators.matching import ratio_test
    from vistrack.operators.search import nearest_two_tiled

    seen = visible.select("query", "point").distinct().join(obs.select("point", F.col("view").alias("a"), F.col("key").alias("ka")), "point")
    wanted = seen.select("a", F.col("query").alias("b"), "ka").distinct()
    # a keypoint is looked for once in a query, whatever number of points it observes
    near = nearest_two_tiled(wanted, descriptors.withColumnRenamed("view", "image"), queries.select(F.col("query").alias("image"), "key", "v"), queries=wanted)
    got = ratio_test(near, ratio).select("a", F.col("b").alias("query"), "ka", F.col("kb").alias("key"), F.col("d1").alias("d"))
    return seen.join(got, ["a", "query", "ka"]).select("query", "point", "key", "d")
