"""Color sets: which inputs hold each canonical k-mer, and the dictionary of distinct sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hueweave.functions.dna import acgt_runs, check_k, unpack
from hueweave.functions.packed import packed_kmers
from hueweave.operators.ranking import number_rows
from hueweave.runtime import broadcast_if_small, materialize


def runs(sequences: DataFrame, k: int) -> DataFrame:
    """(color, run) for each maximal ACGT run of at least k bases of (color, seq) rows; null sequences have none."""
    return sequences.select("color", F.explode(acgt_runs("seq")).alias("run")).where(F.length("run") >= check_k(k))


def canonical_kmers(sequences: DataFrame, k: int) -> DataFrame:
    """(color, kmer, n): the k-mers of each color in canonical form, and how often they occur."""
    found = packed_kmers(sequences, k).groupBy("color", "code").agg(F.sum("n").alias("n"))
    return found.select("color", unpack("code", k).alias("kmer"), "n")


def packed_colors(sequences: DataFrame, k: int, n_colors: int | None = None, wide: int = 1008) -> DataFrame:
    """(code, colors): the sorted distinct colors that hold each canonical k-mer, packed.

    Sets form as bit masks of 63 colors, a hash aggregate with partial sums. With ``n_colors`` given, and up to ``wide``, all masks of
    a k-mer are columns of one row; else each is a row, and the rows of a k-mer are put together afterwards. A null or negative color, or one
    of ``n_colors`` or more, is an error.
    """
    rows = packed_kmers(sequences, k, n_colors)
    bit = F.expr("shiftleft(1L, cast(color % 63 as int))")
    word = F.floor(F.col("color") / 63).cast("int")
    if n_colors is not None and n_colors <= wide:
        words = [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(max(1, -(-n_colors // 63)))]
        masks = rows.groupBy("code").agg(*words)
        sets = [_members(F.col(f"w{i}"), F.lit(63 * i)) for i in range(len(words))]
        return masks.select("code", (F.concat(*sets) if len(sets) > 1 else sets[0]).alias("colors"))
    masks = rows.groupBy("code", word.alias("word")).agg(F.bit_or(bit).alias("mask"))
    held = masks.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("held"))
    return held.select("code", F.flatten(F.transform("held", lambda x: _members(x["mask"], x["word"] * 63))).alias("colors"))


def _members(mask: Column, base: Column) -> Column:
    """The set bits of a mask, from ``base`` on, ascending."""
    on = F.filter(F.array(*[F.lit(i) for i in range(63)]), lambda i: F.getbit(mask, i) == 1)
    return F.transform(on, lambda i: (i + base).cast("int"))


def kmer_colors(sequences: DataFrame, k: int, n_colors: int | None = None) -> DataFrame:
    """(kmer, colors): ``packed_colors`` with the bases spelt out."""
    return packed_colors(sequences, k, n_colors).select(unpack("code", k).alias("kmer"), "colors")


def color_sets(kc: DataFrame) -> DataFrame:
    """(cid, colors): the distinct color sets, numbered densely from 0 in their order."""
    return number_rows(kc.select("colors").distinct(), "cid", ["colors"]).select("cid", "colors")


def encode_colors(kc: DataFrame, sets: DataFrame) -> DataFrame:
    """The k-mers with cid: color sets replaced by their ids; equality is of the sets themselves, not of hashes.

    Most k-mers share a few sets, so the dictionary is broadcast while it is small; beyond that both sides are written
    tables, whose join adaptive execution can split.
    """
    small = _light(sets.withColumnRenamed("colors", "set"), "set")
    return kc.join(small, F.col("colors") == F.col("set")).drop("colors", "set")


def _light(sets: DataFrame, colors: str, limit: int = 64 << 20) -> DataFrame:
    """The sets, broadcast if their summed bytes are under ``limit``."""
    size = sets.agg(F.coalesce(F.sum(64 + 4 * F.size(colors).cast("long")), F.lit(0))).first()[0]
    return broadcast_if_small(sets, size, limit)


def digest_colors(sequences: DataFrame, k: int, n_colors: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(k-mers (code, cid), sets (cid, colors)) for any number of colors, packed.

    A k-mer's set is first known by two 64-bit digests, exclusive ors of its colors' hashes, and its size: a hash aggregate of
    fixed width, whatever the sets' sizes. Members are put together once for each distinct set, from one k-mer that has it, and their number is checked.
    """
    pairs = materialize(packed_kmers(sequences, k, n_colors).select("code", "color").distinct(), "kmer-color-pairs")
    digest = [F.bit_xor(F.xxhash64(F.lit(seed), "color")).alias(f"d{seed}") for seed in range(2)]
    digests = materialize(pairs.groupBy("code").agg(*digest, F.count("*").alias("n")), "set-digests")
    heads = materialize(digests.groupBy("d0", "d1", "n").agg(F.min("code").alias("head")), "set-heads")
    members = pairs.join(heads, F.col("code") == F.col("head")).groupBy("d0", "d1", "n").agg(F.array_sort(F.collect_list("color")).alias("colors"))
    whole = F.when(F.size("colors") == F.col("n"), F.col("colors")).otherwise(F.raise_error(F.lit("a color set is not whole")))
    sets = materialize(number_rows(members.withColumn("colors", whole), "cid", ["colors"]), "digest-sets")
    named = sets.select("cid", *[F.col(c).alias(f"s{c}") for c in ("d0", "d1", "n")])
    on = [F.col(c) == F.col(f"s{c}") for c in ("d0", "d1", "n")]
    kmers = digests.join(broadcast_if_small(named, sets.count(), 500_000), on)  # 32 bytes a set
    return kmers.select("code", "cid"), sets.select("cid", "colors")


def regime(colors: Column, n_colors: Column | int) -> Column:
    """How the hybrid codec stores a set: sparse under a quarter of the colors, bitmap under three quarters, else its complement."""
    n, size = (F.lit(n_colors) if isinstance(n_colors, int) else n_colors), F.size(colors)
    return F.when(size < F.floor(0.25 * n), "sparse").when(size < F.floor(0.75 * n), "bitmap").otherwise("complement")


def complement(colors: Column, n_colors: int) -> Column:
    """The colors that a set lacks."""
    return F.array_except(F.sequence(F.lit(0), F.lit(n_colors - 1)), colors)
