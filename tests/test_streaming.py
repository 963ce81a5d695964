"""Components of a match stream: the state against the whole, what a batch writes, batches run again."""

import random

from pyspark.sql import functions as F

from vistrack.operators.tracks import pack
from vistrack.plans.components import connected_components
from vistrack.streaming import incremental

SCHEMA = "a long, ka long, b long, kb long"


def whole(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).select(pack("a", "ka").alias("a"), pack("b", "kb").alias("b"))
    return sorted(map(tuple, connected_components(df).select("node", "root").collect()))


def state(spark, path, n):
    return sorted(map(tuple, incremental.labels_of(spark, path, n).collect()))


def test_batches_give_the_components_of_the_whole(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "s")
    rows = [(rng.randint(1, 4), rng.randint(0, 40), rng.randint(1, 4), rng.randint(0, 40)) for _ in range(90)]
    rows += [(9, 5, 1, 0), (0, 0, 9, 5), (2, 2, 2, 2), (None, 1, 2, 2)]  # a smaller root comes late; loops and nulls do nothing
    sizes = (50, 20, 0, 24)
    at = 0
    for i, n in enumerate(sizes):
        incremental.apply_batch(spark, path, spark.createDataFrame(rows[at : at + n], SCHEMA), i)
        at += n
        assert state(spark, path, i + 1) == whole(spark, rows[:at])
    # the last batch again
    before = state(spark, path, 4)
    incremental.apply_batch(spark, path, spark.createDataFrame(rows[70:], SCHEMA), 3)
    assert state(spark, path, 4) == before


def test_a_batch_writes_its_own_size(spark, tmp_path):
    """Joining two components of 600 nodes writes one merge and no node."""
    path = str(tmp_path / "s")
    chain = [(1, i, 1, i + 1) for i in range(600)] + [(2, i, 2, i + 1) for i in range(600)]
    incremental.apply_batch(spark, path, spark.createDataFrame(chain, SCHEMA), 0)
    incremental.apply_batch(spark, path, spark.createDataFrame([(2, 77, 1, 234), (1, 5, 3, 3)], SCHEMA), 1)
    rows = lambda what: spark.read.parquet(f"{path}/{what}").where("batch = 1").count()
    assert (rows("merges"), rows("nodes")) == (1, 1)
    got = incremental.labels_of(spark, path, 2)
    assert got.count() == 1203 and got.select("root").distinct().count() == 1


def test_stream(spark, tmp_path):
    rows = [(1, i, 2, i) for i in range(20)] + [(2, i, 3, i + 1) for i in range(15)] + [(3, 1, 4, 9), (4, 9, 1, 17)]
    for i, at in enumerate(range(0, len(rows), 13)):
        spark.createDataFrame(rows[at : at + 13], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.track_stream(stream, str(tmp_path / "s"), str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None and state(spark, str(tmp_path / "s"), 3) == whole(spark, rows)
    assert incremental.labels_of(spark, str(tmp_path / "s"), 3).where(F.col("root").isNull()).count() == 0
