"""Incremental tracks over an arriving stream of matches (an extension to the batch operators).

The state of a stream is two tables that only grow: ``nodes`` (node, root) has each node once, with its root at the
time, ``merges`` (root, parent) each root that became part of another component, once. Both lie in folders by batch
and bucket of their key. A micro-batch looks up the ends of its edges in their buckets, follows merges from root to
parent, contracts its edges between current roots, and appends its new nodes and the roots it merged: what a batch
writes grows with the batch, not with the components it touches. A batch that is run again reads earlier batches only
and overwrites its own folders, so it gives the same state. The root of a component is its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistrack.operators.tracks import pack
from vistrack.plans.components import connected_components
from vistrack.session import cut

#: Buckets of the state, by the hash of the key.
BUCKETS = 64


def update_components(labels: DataFrame | None, matches: DataFrame) -> DataFrame:
    """labels (node, root) after new matches (a, ka, b, kb)."""
    edges = matches.select(pack("a", "ka").alias("a"), pack("b", "kb").alias("b"))
    if labels is None:
        return connected_components(edges)
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    touched = labels.join(ends, "node", "left_semi").select("root").distinct()
    old = labels.join(touched, "root", "left_semi").select(F.col("node").alias("a"), F.col("root").alias("b"))
    fresh = connected_components(edges.union(old))
    return labels.join(touched, "root", "left_anti").select("node", "root").union(fresh)


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _state(spark: SparkSession, path: str, what: str, key: str, other: str, before: int) -> DataFrame:
    """(key, other, bucket) of the batches before a number."""
    if not before:
        return spark.createDataFrame([], f"{key} long, {other} long, bucket int")
    read = spark.read.schema(f"{key} long, {other} long, batch int, bucket int").parquet(f"{path}/{what}")
    return read.where(F.col("batch") < before).select(key, other, "bucket")


def _looked_up(rows: DataFrame, state: DataFrame, on: str) -> DataFrame:
    """rows joined with the state on a column; only the buckets that occur are read."""
    wanted = [r["b"] for r in rows.select(_bucket(on).alias("b")).distinct().collect()]
    return rows.join(state.where(F.col("bucket").isin(wanted)).drop("bucket"), on, "left")


def current_roots(spark: SparkSession, path: str, roots: DataFrame, before: int) -> DataFrame:
    """roots (node, root) with each root replaced by that of its component now: merges are followed to their ends."""
    merges = _state(spark, path, "merges", "root", "parent", before)
    while True:
        roots = cut(_looked_up(roots.select("node", "root"), merges, "root"))
        if not roots.where("parent IS NOT NULL").head(1):
            return roots.select("node", "root")
        roots = roots.select("node", F.coalesce("parent", "root").alias("root"))


def apply_batch(spark: SparkSession, path: str, matches: DataFrame, number: int) -> None:
    """The state under path after the batch ``number`` of matches (a, ka, b, kb). Merges are written before nodes: a
    reader in between sees all old nodes in their new components."""
    edges = cut(matches.select(pack("a", "ka").alias("a"), pack("b", "kb").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = _looked_up(ends, _state(spark, path, "nodes", "node", "root", number), "node")
    known = current_roots(spark, path, found.where("root IS NOT NULL"), number) if number else found.where("root IS NOT NULL")
    own = cut(found.where("root IS NULL").select("node", F.col("node").alias("root"), F.lit(True).alias("new")).union(known.select("node", "root", F.lit(False))))
    side = lambda c: own.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    contracted = edges.join(side("a"), "a").join(side("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    roots = connected_components(contracted).withColumnRenamed("root", "to").withColumnRenamed("node", "root")
    after = cut(own.join(roots, "root", "left").withColumn("to", F.coalesce("to", "root")))
    gone = after.where("NOT new AND to <> root").select("root", F.col("to").alias("parent")).distinct()
    fresh = after.where("new").select("node", F.col("to").alias("root"))
    for what, rows, key in (("merges", gone, "root"), ("nodes", fresh, "node")):
        rows.withColumn("bucket", _bucket(key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{what}/batch={number}")


def labels_of(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """(node, root) of all nodes of the first ``batches`` batches."""
    merges = _state(spark, path, "merges", "root", "parent", batches)
    last = connected_components(merges.select("root", "parent"), "root", "parent").withColumnRenamed("root", "to").withColumnRenamed("node", "root")
    nodes = _state(spark, path, "nodes", "node", "root", batches)
    return nodes.join(last, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def track_stream(matches: DataFrame, path: str, checkpoint: str):
    """A query that keeps the components of a match stream under path (labels_of reads them)."""
    return matches.writeStream.foreachBatch(lambda batch, number: apply_batch(batch.sparkSession, path, batch, number)).option("checkpointLocation", checkpoint)
