"""Driver tables in the roles of the multi-view data model (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistrack.session import table


def observations(spark: SparkSession, d: str) -> DataFrame:
    """(view, point), a bag: lineitem rows."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("view"), F.col("l_partkey").alias("point"))


def observations_xy(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("l_partkey") * 7919 + F.col("l_linenumber") * 104729) % 1024
    y = (F.col("l_orderkey") * 31 + F.col("l_suppkey") * 17) % 768
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("view"), F.col("l_partkey").alias("point"), x.cast("long").alias("x"), y.cast("long").alias("y"))


def keys(spark: SparkSession, d: str) -> DataFrame:
    """(image, key, v): embeddings by label."""
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("image"), F.col("vec_id").alias("key"), F.col("embedding").alias("v"))


def images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("image")).agg(F.count("*").alias("n"))


def cameras(spark: SparkSession, d: str) -> DataFrame:
    """(view, f, valid); the focal length of an unlocalised camera is null."""
    v = F.col("s_suppkey")
    return table(spark, d, "supplier").select(v.alias("view"), F.when(v % 3 != 0, 500 + v).alias("f"), (v % 3 != 0).alias("valid"))


def cameras_delta(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("s_suppkey")
    return table(spark, d, "supplier").where(v % 6 == 0).select(v.alias("view"), (900 + v).alias("f"))


OBS = "obs AS (SELECT l_suppkey AS view, l_partkey AS point FROM lineitem)"
OBS_XY = "obs AS (SELECT l_suppkey AS view, l_partkey AS point, (l_partkey*7919+l_linenumber*104729)%1024 AS x, (l_orderkey*31+l_suppkey*17)%768 AS y FROM lineitem)"
KEYS = "keys AS (SELECT label::BIGINT AS image, vec_id AS key, embedding AS v FROM embeddings)"
CAMERAS = "cameras AS (SELECT s_suppkey AS view, CASE WHEN s_suppkey % 3 <> 0 THEN 500 + s_suppkey END AS f, s_suppkey % 3 <> 0 AS valid FROM supplier)"
