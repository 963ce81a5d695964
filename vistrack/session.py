"""Session helpers shared by all operators: tables, lineage cuts and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only if its counted rows are at most this many.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder on one
    machine (master local), an error on a cluster, whose executors could not read each other's files."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='vistrack-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later plans start from files that survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str, **options) -> DataFrame:
    """Write as compressed Parquet into the shared folder and read it back (a cheaper cut for wide rows)."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of the large side in a part of a dealt join, in a block that meets blocks of a side too large to broadcast, and in a run.
DEALT_ROWS, WIDE_ROWS, RUN_ROWS = 4096, 65_536, 64
#: Rows that one run makes at once: generated code keeps them all.
MET_ROWS = 262_144


def in_runs(df: DataFrame, on: str, parts: int, run: int, near: tuple = ()) -> DataFrame:
    """(on, _b, _a, _l): about even ranges _b of rows by ``on`` and ``near``; the rows of a value in a range in sorted lists of
    ``run`` rows, the first at _a. The ranges come from a sample: where they are used twice, store them."""
    rest = [c for c in df.columns if c != on and c not in near]
    ranged = df.where(F.col(on).isNotNull()).withColumn("_i", F.monotonically_increasing_id()).repartitionByRange(parts, on, *near, "_i")
    lists = ranged.withColumn("_b", F.spark_partition_id()).groupBy(on, "_b").agg(F.sort_array(F.collect_list(F.struct(*near, "_i", *rest))).alias("_l"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_l"), F.lit(run)), lambda i: F.struct(i.alias("_a"), F.slice("_l", i, run).alias("_l")))
    return lists.select(on, "_b", F.inline(runs))


def dealt_join(large: DataFrame, small: DataFrame, on: str, limit: int = BROADCAST_ROWS, near: tuple = ()) -> DataFrame:
    """Inner join on a column of few values, so that the result is far larger than the sides: the large side is dealt
    evenly in runs of rows of a value, DEALT_ROWS rows a part, and every part meets the small side, broadcast if its counted
    rows are within ``limit``. Else WIDE_ROWS rows of a value meet DEALT_ROWS of the small side in a task, so that what is
    sent grows with the result / DEALT_ROWS. A row of the small side comes with all rows of a run in the order of ``near``:
    written columns repeat and pack well, where a row of the large side would come with others all over."""
    n, m = large.count(), small.count()
    own = [c for c in small.columns if c != on]
    if m <= limit:
        most = small.where(F.col(on).isNotNull()).groupBy(on).count().agg(F.max("count")).first()[0] or 1
        parts, run = max(1, -(-n // DEALT_ROWS)), max(1, min(RUN_ROWS, MET_ROWS // most))
        met = in_runs(large, on, parts, run, near).repartitionById(parts, "_b").join(F.broadcast(small), on)
    else:
        counts = [x.groupBy(on).agg(F.count("*").alias(c)) for x, c in ((large, "_n"), (small, "_m"))]
        rows = counts[0].join(counts[1], on).agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
        left = stored(in_runs(large, on, max(1, -(-n // WIDE_ROWS)), RUN_ROWS, near).drop("_a"), "dealt-runs")
        right = stored(in_runs(small, on, -(-m // DEALT_ROWS), MET_ROWS // RUN_ROWS).select(on, F.struct("_b", "_a").alias("_c"), F.col("_l").alias("_s")), "dealt-small")
        parts, tile = parts_for(large.sparkSession, rows, WIDE_ROWS * DEALT_ROWS), [on, "_b", "_c"]
        left, right = join_checked(left, right.select(on, "_c"), on, "inner"), join_checked(right, left.select(on, "_b").distinct(), on, "inner")
        met = left.repartition(parts, *tile).join(right.repartition(parts, *tile).hint("merge"), tile).select(on, "_l", F.inline("_s")).select(on, "_l", *own)
    return met.select(on, *own, F.inline("_l")).select(on, *[c for c in large.columns if c != on], *own)


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of ``each`` rows, as many as the session has at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a narrow, already materialised right side: broadcast if its counted rows are within
    ``limit``, else a shuffle join whose skewed partitions AQE may split. Both give the same rows."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= limit else right.hint("merge"), on, how)
