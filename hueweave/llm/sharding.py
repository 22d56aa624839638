"""Contiguous balanced shards from global byte-size prefix sums, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hueweave.runtime import broadcast_if_small, materialize


def shard_by_bytes(docs: DataFrame, shards: int, size: Column, order: list[str], rows_per_part: int = 250_000) -> DataFrame:
    """Put rows into ``shards`` contiguous shards of nearly equal byte size.

    Rows are range-partitioned by ``order``; each partition's rows and bytes are summed, the
    prefix sums of these totals give each partition's place in the whole, and a running
    sum inside the partition gives each row's. The whole is cut at equal byte targets: a row
    belongs to the shard in which its middle byte lies, so two shards differ by less than
    twice the largest row. No task holds more than one range partition.

    Adds ``size, shard, slot`` (replacing columns so named); slots count a shard's rows from 0
    without gaps. Null order keys come first; equal rows are interchangeable; an empty table
    gives an empty table; rows that are all of size 0 go to shard 0. With fewer rows than shards some shards are empty.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / rows_per_part))
    placed = docs.drop("shard", "slot").withColumn("size", size).repartitionByRange(parts, *order)
    placed = materialize(placed.withColumn("_hw_part", F.spark_partition_id()), "shard-ranges")
    totals = placed.groupBy("_hw_part").agg(F.sum("size").alias("_hw_bytes"), F.count("*").alias("_hw_rows"))
    ahead = W.orderBy("_hw_part").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = totals.select(  # one row per range partition
        F.col("_hw_part").alias("_hw_p"),
        F.coalesce(F.sum("_hw_bytes").over(ahead), F.lit(0)).alias("_hw_bytes_ahead"),
        F.coalesce(F.sum("_hw_rows").over(ahead), F.lit(0)).alias("_hw_rows_ahead"),
        F.sum("_hw_bytes").over(everything).alias("_hw_total"),
    )
    totals = broadcast_if_small(materialize(totals, "shard-totals"), parts)
    inside = W.partitionBy("_hw_part").orderBy(*order)
    rows = placed.withColumns({"_hw_to": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)), "_hw_row": F.row_number().over(inside)})
    rows = rows.join(totals, F.col("_hw_part") == F.col("_hw_p"))
    middle = 2 * (F.col("_hw_bytes_ahead") + F.col("_hw_to")) - F.col("size")  # twice the middle byte
    target = 2 * F.greatest(F.col("_hw_total"), F.lit(1)) / F.lit(float(shards))  # twice a shard's bytes
    rows = rows.withColumns({"shard": F.when(F.col("_hw_total") > 0, F.least(F.lit(shards - 1), F.floor(middle / target))).otherwise(F.lit(0)).cast("int"), "_hw_index": F.col("_hw_rows_ahead") + F.col("_hw_row") - 1})
    rows = materialize(rows.drop("_hw_p", "_hw_to", "_hw_row", "_hw_bytes_ahead", "_hw_rows_ahead", "_hw_total", "_hw_part"), "shard-rows")
    starts = rows.groupBy("shard").agg(F.min("_hw_index").alias("_hw_start")).withColumnRenamed("shard", "_hw_shard")
    rows = rows.join(broadcast_if_small(starts, shards), F.col("shard") == F.col("_hw_shard"))
    return rows.withColumn("slot", F.col("_hw_index") - F.col("_hw_start")).drop("_hw_index", "_hw_shard", "_hw_start")
