"""Global row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrack.session import cut


def global_rank(df: DataFrame, *order: str, name: str = "rn") -> tuple[DataFrame, int]:
    """df with its 1-based position in the order, and the number of rows.

    Rows are range-partitioned and sorted inside partitions; only one count a partition reaches the
    driver. The order should be total; ties fall as the sort leaves them.
    """
    at = F.monotonically_increasing_id()
    ranked = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in ranked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    total, rows = 0, []
    for p, n in counts:
        rows.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(rows or [(0, 0)], "_p long, _offset long")
    out = ranked.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_offset") + place + 1)
    return out.drop("_p", "_offset", "_at"), total
