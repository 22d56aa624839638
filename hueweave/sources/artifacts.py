"""The graph's artifacts: unitigs with ids and run ends, FASTA, color sets, metadata; and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hueweave.functions.codec import decode_sets, encode_sets
from hueweave.operators.ranking import number_rows
from hueweave.sources.packed_files import write_color_sets, write_run_ends


def number_unitigs(unitigs: DataFrame) -> DataFrame:
    """(unitig_id, cid, seq, num_kmers, run_end): ids in cid order; ``run_end`` marks the last unitig of each color set."""
    rows = number_rows(unitigs, "unitig_id", ["cid", "seq"], "run_end", lean=True)
    return rows.select("unitig_id", "cid", "seq", "num_kmers", "run_end")


def metadata(unitigs: DataFrame, sets: DataFrame, k: int, n_colors: int) -> DataFrame:
    """One row: k, num_kmers, num_colors, num_unitigs, num_color_sets."""
    u = unitigs.agg(F.coalesce(F.sum("num_kmers"), F.lit(0)).alias("num_kmers"), F.count("*").alias("num_unitigs"))
    s = sets.agg(F.count("*").alias("num_color_sets"))
    return u.join(s, F.lit(True)).select(F.lit(k).cast("long").alias("k"), "num_kmers", F.lit(n_colors).cast("long").alias("num_colors"), "num_unitigs", "num_color_sets")


def write(base: str, numbered: DataFrame, sets: DataFrame, meta: DataFrame, n_colors: int, packed: bool = False) -> None:
    """Write base.fa (``>cid`` and sequence, by cid), base.unitigs, base.color_sets (hybrid-coded) and base.metadata.

    Unitigs and color sets lie in order of their ids, so Parquet's statistics serve as offsets: reading a few ids skips the other row groups.
    With ``packed`` also base.run_ends and base.packed_color_sets, which give single sets and their unitigs without Spark.
    """
    n = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fasta = numbered.repartitionByRange(n, "cid", "seq").sortWithinPartitions("cid", "seq")
    fasta.select(F.concat(F.lit(">"), F.col("cid").cast("string"), F.lit("\n"), F.col("seq"))).write.text(f"{base}.fa")
    numbered.repartitionByRange(n, "unitig_id").sortWithinPartitions("unitig_id").write.parquet(f"{base}.unitigs")
    encode_sets(sets.repartitionByRange(n, "cid").sortWithinPartitions("cid"), n_colors).write.parquet(f"{base}.color_sets")
    if packed:
        write_run_ends(numbered, f"{base}.run_ends")
        write_color_sets(sets, n_colors, f"{base}.packed_color_sets")
    pairs = F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in meta.columns])
    meta.select(F.explode(pairs)).coalesce(1).write.text(f"{base}.metadata")


def read_metadata(spark: SparkSession, path: str) -> dict[str, int]:
    """The five integers of a metadata file; a missing key is an error."""
    rows = spark.read.text(path).where("value like '%=%'").select(F.split("value", "=").alias("x")).collect()
    got = {r["x"][0]: int(r["x"][1]) for r in rows}
    return {key: got[key] for key in ("k", "num_kmers", "num_colors", "num_unitigs", "num_color_sets")}


def read_color_sets(spark: SparkSession, base: str, cids: list[int] | None = None) -> DataFrame:
    """(color_set_id, unitig_start, num_unitigs, color_set): each set, or those of ``cids``, with its contiguous range of unitigs."""
    kept = lambda df: df if cids is None else df.where(F.col("cid").isin(cids))
    u = kept(spark.read.parquet(f"{base}.unitigs")).groupBy("cid").agg(F.min("unitig_id").alias("unitig_start"), F.count("*").alias("num_unitigs"))
    sets = decode_sets(kept(spark.read.parquet(f"{base}.color_sets")))
    return sets.join(u, "cid").select(F.col("cid").alias("color_set_id"), "unitig_start", "num_unitigs", F.col("colors").alias("color_set"))
