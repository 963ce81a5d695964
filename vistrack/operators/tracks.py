"""Tracks: stars, components with conflict removal, k-cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistrack.plans.components import connected_components


def pack(view: str, key: str):
    """view << 32 | key as one long; view below 2^31."""
    return F.shiftleft(F.col(view).cast("long"), 32).bitwiseOR(F.col(key).cast("long"))


def unpack(packed: str) -> tuple:
    return F.shiftright(packed, 32), F.col(packed).bitwiseAND(F.lit(0xFFFFFFFF))


def symmetric(matches: DataFrame) -> DataFrame:
    one = matches.select("a", "ka", "b", "kb")
    return one.union(one.select(F.col("b").alias("a"), F.col("kb").alias("ka"), F.col("a").alias("b"), F.col("ka").alias("kb")))


def star_tracks(matches: DataFrame) -> DataFrame:
    """One track per keypoint: itself first, then its direct matches in order."""
    s = symmetric(matches).groupBy("a", "ka").agg(F.sort_array(F.collect_set(F.struct(F.col("b").alias("view"), F.col("kb").alias("key")))).alias("others"))
    own = F.array(F.struct(F.col("a").alias("view"), F.col("ka").alias("key")))
    return s.select(F.col("a").alias("view"), F.col("ka").alias("key"), F.concat(own, "others").alias("obs"))


def match_components(matches: DataFrame) -> DataFrame:
    """(view, key, component): component is the smallest packed keypoint."""
    roots = connected_components(matches.select(pack("a", "ka").alias("a"), pack("b", "kb").alias("b")))
    view, key = unpack("node")
    return roots.select(view.alias("view"), key.alias("key"), F.col("root").alias("component"))


def merged_tracks(components: DataFrame) -> DataFrame:
    """A view that occurs twice in a component is dropped from it; tracks keep more than one view."""
    per = components.groupBy("component", "view").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    large = per.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").select("component")
    return per.join(large, "component", "left_semi").select("component", "view", "key")


def with_parents(merged: DataFrame, members: DataFrame) -> DataFrame:
    """Merged tracks (component, view, key) with the sorted ids of the tracks (members: track, view, key)
    that their keypoints come from: (component, parents)."""
    return merged.join(members, ["view", "key"]).groupBy("component").agg(F.sort_array(F.collect_set("track")).alias("parents"))


def matches_of(matches: DataFrame, image: int) -> DataFrame:
    """One image's matches (a, ka, b, kb), the image first, whichever side it was on."""
    one = matches.select("a", "ka", "b", "kb")
    swapped = one.where(F.col("b") == image).select(F.col("b").alias("a"), F.col("kb").alias("ka"), F.col("a").alias("b"), F.col("ka").alias("kb"))
    return one.where(F.col("a") == image).union(swapped)


def star_edges(tracks: DataFrame) -> DataFrame:
    """Linear-size edges of tracks (array obs of view, key): the first observation with each other one."""
    first, rest = F.get("obs", F.lit(0)), F.slice("obs", 2, F.greatest(F.size("obs") - 1, F.lit(1)))
    e = tracks.select(first.alias("f"), F.explode(rest).alias("o"))
    return e.select(F.col("f.view").alias("a"), F.col("f.key").alias("ka"), F.col("o.view").alias("b"), F.col("o.key").alias("kb"))


def latest_coordinates(*sources: DataFrame) -> DataFrame:
    """(view, key, x, y) of the last source that has the keypoint."""
    all_ = None
    for i, s in enumerate(sources):
        s = s.select("view", "key", "x", "y", F.lit(i).alias("src"))
        all_ = s if all_ is None else all_.union(s)
    return all_.groupBy("view", "key").agg(F.max_by(F.struct("x", "y"), F.struct("src", "x", "y")).alias("c")).select("view", "key", "c.x", "c.y")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new tracks (array obs) into merged tracks (component, view, key)."""
    return merged_tracks(match_components(star_edges(old.select("obs")).union(star_edges(new.select("obs")))))


def k_cover(obs: DataFrame, cameras: DataFrame, k: int) -> DataFrame:
    """Points that cover every valid view k times, greedily by (track length, id) descending: a point
    stays if it is among the first k of one of its views. Length and rank count repeated rows."""
    size = obs.groupBy("point").agg(F.count("*").alias("len"))
    per = obs.join(cameras.where("valid").select("view"), "view").join(size, "point")
    w = Window.partitionBy("view").orderBy(F.desc("len"), F.desc("point"))
    return per.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("point", "len").distinct()
