"""Stages of the multistage loop over DataFrames: initial matching, localisation, densification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrack.functions import geometry, kernels
from vistrack.operators import guided, matching, pairs, search, tracks
from vistrack.session import cut, stored


def initial_matches(keys: DataFrame, images: DataFrame, percent: int = 20, ratio: float = 0.6, least: int = 16) -> DataFrame:
    """Matches (a, b, ka, kb) of all image pairs over the prefix of the largest keys."""
    some = matching.prefix(keys, percent, small=1000)
    near = search.nearest_two_tiled(pairs.all_pairs(images), some, some)
    return matching.enough(matching.unique_target(matching.ratio_test(near, ratio)), least).select("a", "b", "ka", "kb")


def with_fundamental(pairs_: DataFrame, cameras: DataFrame, size: tuple[float, float] | None = None) -> DataFrame:
    """Pairs (a, b) with f, the fundamental matrix of their cameras (view, f, r[9], t[3]), in pixels of images of a
    size or in normalised coordinates. Pairs without two placed cameras drop out."""
    placed = cameras.where("f IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL")
    one = placed.select(F.col("view").alias("a"), F.col("f").cast("double").alias("f1"), F.col("r").alias("r1"), F.col("t").alias("t1"))
    two = placed.select(F.col("view").alias("b"), F.col("f").cast("double").alias("f2"), F.col("r").alias("r2"), F.col("t").alias("t2"))
    both = pairs_.select("a", "b").join(one, "a").join(two, "b")
    return geometry.fundamental(both, ("f1", "r1", "t1"), ("f2", "r2", "t2"), size).select("a", "b", "f")


def densify_views(observations: DataFrame, keys: DataFrame, cameras: DataFrame, width: int, height: int, near: int = 10, covisible: int = 4, band: float = 4.0, ratio: float = 0.6, least: int = 16, min_angle: float | None = kernels.MIN_ANGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of densification from a model to a new one: matches, tracks and points.

    Pairs are the ``near`` most covisible views of each view of observations (view, point) with at least ``covisible``
    common points; each gets its fundamental matrix from the cameras, keys (image, key, x, y, v; pixels) are matched
    along epipolar lines, pairs with fewer than ``least`` matches are dropped, matches are merged to tracks, tracks
    triangulated. Matches (a, ka, b, kb), tracks (track, view, key) of the points kept, points as
    ``kernels.triangulate_tracks`` gives them. Every stage is stored, so that later ones do not repeat it.
    """
    some = pairs.unique_pairs(pairs.top_neighbors(pairs.covisibility(observations, least=covisible), near))
    known = stored(with_fundamental(some, cameras, (width, height)), "densify-pairs")
    found = guided.guided_match(keys, known, width, height, band, ratio)
    matches = stored(matching.enough(found, least).select("a", "ka", "b", "kb"), "densify-matches")
    merged = stored(tracks.merged_tracks(tracks.match_components(matches)).select(F.col("component").alias("track"), "view", "key"), "densify-tracks")
    x, y = geometry.to_norm(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(width), F.lit(height))
    at = keys.select(F.col("image").alias("view"), "key", x.alias("x"), y.alias("y"))
    points = stored(kernels.triangulate_tracks(merged.join(at, ["view", "key"]), cameras, min_angle=min_angle), "densify-points")
    return matches, merged.join(points.select("track"), "track", "left_semi"), points


def densify(matches: DataFrame, coordinates: DataFrame, cameras: DataFrame, min_angle: float = kernels.MIN_ANGLE) -> DataFrame:
    """Merged tracks of matches, triangulated: one row a point that passes error, side and angle."""
    merged = cut(tracks.merged_tracks(tracks.match_components(matches)))
    obs = merged.select(F.col("component").alias("track"), "view", "key").join(coordinates, ["view", "key"])
    return kernels.triangulate_tracks(obs.select("track", "view", "x", "y"), cameras, min_angle=min_angle)


def localize(correspondences: DataFrame, least: int = 16) -> DataFrame:
    """Cameras of images with enough correspondences (view, x, y, px, py, pz)."""
    enough = correspondences.groupBy("view").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("view")
    return kernels.register_images(correspondences.join(enough, "view", "left_semi"))
