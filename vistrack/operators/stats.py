"""Error and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistrack.plans.ranking import global_rank


def order_statistic(rows: DataFrame, by: str, value: str, share: float = 0.95) -> DataFrame:
    """(by, n, value): the element at the rounded position share * n (from 0) of each group, exact.

    Rows are ranked by a distributed sort, so a group need not fit into a task.
    """
    ranked, _ = global_rank(rows.where(F.col(by).isNotNull() & F.col(value).isNotNull()).select(by, value), by, value)
    spans = ranked.groupBy(by).agg(F.min("rn").alias("lo"), F.count("*").alias("n"))
    at = F.col("lo") + F.least(F.floor(F.col("n") * share + 0.5), F.col("n") - 1)
    return ranked.join(spans.withColumn("rn", at), [by, "rn"]).select(by, "n", value)


def histogram(rows: DataFrame, by: str, value: str, bins: int = 10) -> DataFrame:
    """(by, bin, n): equal-width bins from the least to the largest value of a group."""
    span = rows.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    v = rows.join(span, by)
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return v.where(F.col(value).isNotNull()).groupBy(by, b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def error_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.sqrt(F.sum(v * v) / F.count(value)), 6).alias("rms"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def run_lengths(rows: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Runs of equal values in the order of each group: (by, run, value, n); run counts from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_new", new).withColumn("run", run).groupBy(*by, "run", value).agg(F.count("*").alias("n"))


def latest_per_group(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
