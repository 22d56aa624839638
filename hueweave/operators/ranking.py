"""Dense global numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hueweave.runtime import broadcast_if_small, materialize


def number_rows(df: DataFrame, name: str, order: list[str], last: str | None = None, lean: bool = False) -> DataFrame:
    """Add ``name``: a row's place from 0 in the global order; and ``last``, if named: whether the next row differs in the first of ``order``.

    Rows are range-partitioned by ``order``; a partition's offset is the sum of the counts before it,
    so only one row for each partition meets in one task. ``lean`` is that of ``materialize``.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, *order).withColumn("_hw_part", F.spark_partition_id()), "numbered", lean=lean)
    counts = placed.groupBy("_hw_part").agg(F.count("*").alias("_hw_n"), *([F.min(order[0]).alias("_hw_head")] if last else []))
    ahead = W.orderBy("_hw_part").rowsBetween(W.unboundedPreceding, -1)
    following = [F.lead("_hw_head").over(W.orderBy("_hw_part")).alias("_hw_next")] if last else []
    counts = counts.select(F.col("_hw_part").alias("_hw_p"), F.coalesce(F.sum("_hw_n").over(ahead), F.lit(0)).alias("_hw_ahead"), *following)
    within = W.partitionBy("_hw_part").orderBy(*order)
    rank = F.row_number().over(within)
    placed = placed.withColumn("_hw_rank", rank)
    if last:
        placed = placed.withColumn("_hw_after", F.lead(order[0]).over(within))
    rows = placed.join(broadcast_if_small(counts, n), F.col("_hw_part") == F.col("_hw_p"))
    rows = rows.withColumn(name, F.col("_hw_ahead") + F.col("_hw_rank") - 1)
    if last:
        rows = rows.withColumn(last, ~F.col(order[0]).eqNullSafe(F.coalesce("_hw_after", "_hw_next")))
    return rows.drop("_hw_part", "_hw_p", "_hw_ahead", "_hw_rank", "_hw_next", "_hw_after")
