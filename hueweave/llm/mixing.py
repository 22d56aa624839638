"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hueweave.llm.textutil import key_hash, word_count
from hueweave.runtime import broadcast_if_small, materialize


def source_targets(per_source: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of (source, source_size) rows by water filling.

    Sources by code point, null last, take the weights in turn. All targets together
    are ``share`` of all sizes; a target stops at ``most`` times its source's size and
    the excess is shared again by weight among the others. In the order of the level at
    which they fill, the full sources are a prefix, so prefix sums give the level.
    The table has one row per source.
    """
    k = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    t = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    t = t.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    t = t.withColumn("first", F.when(F.col("open"), F.struct(F.row_number().over(order).alias("r"), F.col("level").alias("level"))))
    t = t.withColumn("fill", F.min("first").over(everything)["level"])
    return t.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("fill")), F.col("cap"))).select("source", "source_size", "source_rows", "target")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    size: Column | None = None,
    seed: str = "mix",
) -> DataFrame:
    """Add to each row how often the mix takes it.

    Within a source each document is expected ``target / source_size`` times. The prefix
    sums of these expectations, shifted by one offset per source, cross as many integers
    at a document as it has copies. Documents are in the order of size class, chunk and
    size, so the copies taken are spread over sizes and the words taken come near the target.

    The prefix sums have two levels: ranks within (source, size class, chunk), and offsets
    of these groups. The number of chunks grows with the root of the source's rows, so a
    source with a third of all rows has as many groups as it needs and no task holds it.

    Adds ``size, source_size, target, copies, taken`` (replacing columns so named). Null text
    has size 0; null source is a source of its own, last in order; equal rows are
    interchangeable; a source without words has target 0 and no copies; an empty table gives
    an empty table. Offsets depend on ``seed`` and the source only, so reruns agree.
    """
    docs = docs.withColumn("size", word_count("text") if size is None else size)
    known = size is not None
    slim = docs.select("doc_id", "source", "size")
    slim = slim if known else materialize(slim, "mix-sizes")
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = materialize(source_targets(per, weights, share, most), "mix-targets")
    n_sources = targets.count()

    def grouped(rows: DataFrame) -> DataFrame:
        t = targets.select(F.col("source").alias("_hw_s"), "source_size", "target", F.floor(F.sqrt("source_rows") / 8 + 1).cast("long").alias("_hw_chunks"))
        rows = rows.drop("source_size", "target", "copies", "taken")
        rows = rows.join(broadcast_if_small(t, n_sources), F.col("source").eqNullSafe(F.col("_hw_s")), "left").drop("_hw_s")
        return rows.withColumns({"_hw_class": F.length(F.bin("size")), "_hw_chunk": key_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % F.col("_hw_chunks")})

    key = ["source", "_hw_class", "_hw_chunk"]
    totals = grouped(slim).groupBy(*key).agg(F.count("*").alias("_hw_n"))
    ahead = W.partitionBy("source").orderBy("_hw_class", "_hw_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_hw_t_{c}") for c in key], F.coalesce(F.sum("_hw_n").over(ahead), F.lit(0)).alias("_hw_ahead"))
    totals = materialize(totals, "mix-chunks")
    rank = F.row_number().over(W.partitionBy(*key).orderBy("size", "doc_id"))
    rows = grouped(docs).withColumn("_hw_rank", rank)
    match = F.col("source").eqNullSafe(F.col("_hw_t_source")) & (F.col("_hw_class") == F.col("_hw_t__hw_class")) & (F.col("_hw_chunk") == F.col("_hw_t__hw_chunk"))
    rows = rows.join(broadcast_if_small(totals, totals.count()), match, "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = key_hash(F.lit(seed), F.coalesce(F.col("source"), F.lit(""))) / F.lit(4294967296.0)
    i = (F.col("_hw_ahead") + F.col("_hw_rank")).cast("double")
    copies = F.floor(i * rate + offset) - F.floor((i - 1) * rate + offset)
    rows = rows.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop("_hw_chunks", "_hw_class", "_hw_chunk", "_hw_rank", "_hw_ahead", *(f"_hw_t_{c}" for c in key))


def emit_copies(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per copy taken, with the given columns; rows taken zero times go. Nulls in the columns stay as they are; no rows give none."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_hw_copy")).drop("_hw_copy")
