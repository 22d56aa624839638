"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.runtime import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has an edge.

    Returns ``(node, root)``; ``root`` is the least node of the component, itself
    included. Self loops and repeated edges are allowed, null ends are dropped.
    Every step is a keyed aggregate (with partial sums), written as a table of one row for each key, and a join
    of it with the edges. Both sides of that join are scans, so adaptive execution can split a hub's edges over
    tasks. Tables of earlier rounds are deleted.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("u <> v")
        .distinct()
    )
    e = materialize(e, "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "cc-low")
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "cc-low")
        to = F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(*to)).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        before, e = e, materialize(small, "cc")
        discard(before, low, large, least)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select("root", "root").distinct())
