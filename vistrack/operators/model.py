"""Model maintenance: patching cameras, appending observations, remapping ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patch_cameras(cameras: DataFrame, delta: DataFrame) -> DataFrame:
    """A missing camera is replaced by the new one, else stays as it is; newly_localized marks the former."""
    d = delta.select("view", F.col("f").alias("new_f"))
    out = cameras.join(d, "view", "left")
    gain = ~F.col("valid") & F.col("new_f").isNotNull()
    return out.select("view", F.when(F.col("valid"), F.col("f")).otherwise(F.col("new_f")).alias("f"), (F.col("valid") | gain).alias("valid"), gain.alias("newly_localized"))


def append_observations(tracks: DataFrame, delta: DataFrame) -> DataFrame:
    """Tracks (point, obs array) with the grouped new observations of their points behind the old."""
    d = delta.groupBy("point").agg(F.sort_array(F.collect_list("view")).alias("more"))
    return tracks.join(d, "point", "left").select("point", F.concat("obs", F.coalesce("more", F.array().cast("array<bigint>"))).alias("obs"))


def remap_ids(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """(src, dst): dst is -1 where the mapping has no such id."""
    return ids.join(mapping, "src", "left").select("src", F.coalesce("dst", F.lit(-1)).alias("dst"))


def unlocalized(images: DataFrame, cameras: DataFrame) -> DataFrame:
    return images.select("view").join(cameras.where("valid"), "view", "left_anti")


def given_ids(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return rows.join(ids, on, "left_semi")


def splice_radial(cameras: DataFrame, other: DataFrame) -> DataFrame:
    """Radial terms of another model for cameras of this one."""
    return cameras.select("view", "f").join(other.select("view", "k1", "k2"), "view", "left")


def valid_views(obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """Observations in valid views of points that keep more than one."""
    kept = obs.join(cameras.where("valid").select("view"), "view", "left_semi")
    many = kept.groupBy("point").agg(F.count("*").alias("n")).where("n > 1").select("point")
    return kept.join(many, "point", "left_semi").select("view", "point")


def with_intrinsics(cameras: DataFrame) -> DataFrame:
    """Cameras whose focal length and radial terms are not all zero (the rule of the cover)."""
    return cameras.where((F.coalesce("f", F.lit(0.0)) != 0) | (F.coalesce("k1", F.lit(0.0)) != 0) | (F.coalesce("k2", F.lit(0.0)) != 0))


def nearby_budget(n_images: int) -> int:
    """Nearby images a view gets: a tenth of all, 20 at least."""
    return max(20, n_images // 10)


def needs_cover(points: DataFrame, limit: int = 100_000) -> bool:
    """Whether a model is dense enough to be reduced by k-cover first."""
    return points.limit(limit + 1).count() > limit
