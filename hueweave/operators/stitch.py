"""Stitching of fragments that overlap by k bases at open ends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hueweave.functions.dna import canonical, reverse_complement
from hueweave.operators.paths import rank_paths

#: The color-set id of a k-mer whose color set another fragment knows.
FOREIGN = -1

_PAIRED = str.maketrans("ACGT", "TGCA")


def open_ends(fragments: DataFrame, k: int) -> DataFrame:
    """(frag_id, side, kmer, rc): the canonical boundary k-mer of each open end; rc if it is turned."""
    ends = F.array(
        F.struct(F.lit("L").alias("side"), F.col("open_left").alias("open"), F.expr(f"left(seq, {k})").alias("x")),
        F.struct(F.lit("R").alias("side"), F.col("open_right").alias("open"), F.expr(f"right(seq, {k})").alias("x")),
    )
    e = fragments.select("frag_id", F.explode(ends).alias("e")).where("e.open")
    return e.select("frag_id", "e.side", canonical("e.x").alias("kmer"), (canonical("e.x") != F.col("e.x")).alias("rc"))


def joins(fragments: DataFrame, k: int) -> DataFrame:
    """(a, s, b, t): which open ends (fragment, side) join, each at most once.

    Two ends with one boundary k-mer fit if their sides differ and the k-mer is turned in both or neither, or if the
    sides agree and it is turned in one. So the ends of a k-mer are of two kinds, and fit across kinds: the first of
    one kind joins the first of the other, and so on in the order of fragments. Both ends of one fragment never join.
    """
    e = open_ends(fragments, k).withColumn("kind", (F.col("side") == "R") != F.col("rc"))
    e = e.withColumn("nth", F.row_number().over(W.partitionBy("kmer", "kind").orderBy("frag_id", "side")))
    one = e.where("kind").select("kmer", "nth", F.col("frag_id").alias("a"), F.col("side").alias("s"))
    two = e.where("not kind").select("kmer", "nth", F.col("frag_id").alias("b"), F.col("side").alias("t"))
    return one.join(two, ["kmer", "nth"]).where("a <> b").select("a", "s", "b", "t")


def stretches(pieces: list[dict], k: int, ring: bool = False) -> Iterator[tuple[str, int, int]]:
    """(seq, cid, num_kmers) of the color-uniform stretches of a path, whose pieces (seq, runs) overlap by k bases, in canonical form.

    The k-mer that two pieces share counts once: it belongs to the earlier piece's last run unless that is foreign. Time is
    linear in the bases and runs. A ``ring`` begins where its color set changes, or if it has one only at its least k-mer; of several
    pieces the last ends with the k-mer that the first begins with.
    """
    seq, runs = [], []
    for p in pieces:
        new = [[r["cid"], r["num_kmers"]] for r in p["runs"]]
        seq.append(p["seq"][k:] if seq else p["seq"])
        if runs:
            short = runs[-1] if runs[-1][0] == FOREIGN else new[0]
            short[1] -= 1
            if runs[-1][1] == 0:
                runs.pop()
        for cid, n in new:
            if n and runs and runs[-1][0] == cid:
                runs[-1][1] += n
            elif n:
                runs.append([cid, n])
    whole, at = "".join(seq), 0
    if ring and runs:
        if len(pieces) > 1:
            short = runs[-1] if runs[-1][0] == FOREIGN or runs[0][0] != FOREIGN else runs[0]
            short[1] -= 1
            runs = [r for r in runs if r[1]]
        n = sum(r[1] for r in runs)
        if len(runs) > 1 and runs[0][0] == runs[-1][0]:  # one stretch across the begin: begin with it
            at = n - runs[-1][1]
            runs = [[runs[0][0], runs[0][1] + runs[-1][1]], *runs[1:-1]]
        if len(runs) == 1:
            round_ = whole[:n] * (2 + -(-k // n))
            at = min(range(n), key=lambda i: min(x := round_[i : i + k], x[::-1].translate(_PAIRED)))
        whole, at = (whole[:n] * (2 + -(-k // n)))[at : at + n + k - 1], 0
    for cid, n in runs:
        x = whole[at : at + n + k - 1]
        yield min(x, x[::-1].translate(_PAIRED)), cid, n
        at += n


def stitch(fragments: DataFrame, k: int) -> DataFrame:
    """(seq, cid, num_kmers) of the color-uniform stretches of the stitched fragments, in canonical form.

    Takes (frag_id long, seq, runs array<struct<cid,num_kmers>>, open_left, open_right) and, where a fragment may close to a ring of
    its own, ``ring``, its sequence then going once round. Open ends join as ``joins``
    says, closed ends never. The shared k-mer counts once, with the color set of the fragment that knows it.
    """
    fragments = fragments.withColumn("runs", F.expr("transform(runs, r -> named_struct('cid', cast(r.cid as bigint), 'num_kmers', cast(r.num_kmers as bigint)))"))
    fragments = fragments.withColumn("ring", F.col("ring") if "ring" in fragments.columns else F.lit(False))
    pairs = joins(fragments, k)
    name = lambda n, plus: F.shiftleft(F.col(n), 1).bitwiseOR((~plus).cast("long"))
    there = F.struct(name("a", F.col("s") == "R").alias("src"), name("b", F.col("t") == "L").alias("dst"))
    back = F.struct(name("b", F.col("t") == "R").alias("src"), name("a", F.col("s") == "L").alias("dst"))
    ranked = rank_paths(pairs.select(F.explode(F.array(there, back)).alias("e")).select("e.src", "e.dst").distinct())
    plus = lambda c: F.col(c).bitwiseAND(F.lit(1).cast("long")) == 0
    ranked = ranked.where(~F.col("cyclic") | plus("root"))
    ranked = ranked.select("root", "dist", "cyclic", F.shiftrightunsigned("node", 1).alias("frag_id"), plus("node").alias("plus"))
    parts = ranked.join(fragments, "frag_id")
    piece = F.struct("dist", F.when(F.col("plus"), F.col("seq")).otherwise(reverse_complement("seq")).alias("seq"), F.when(F.col("plus"), F.col("runs")).otherwise(F.reverse("runs")).alias("runs"))
    joined = parts.groupBy("root").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.max("cyclic").alias("ring")).select("pieces", "ring")
    alone = fragments.join(ranked.select("frag_id").distinct(), "frag_id", "left_anti")
    return split_by_color(joined.union(alone.select(F.array(F.struct(F.lit(0).cast("long").alias("dist"), "seq", "runs")), "ring")), k)


def split_by_color(paths: DataFrame, k: int) -> DataFrame:
    """(seq, cid, num_kmers) of paths (pieces, in order, and whether they close to a ring), cut where the color set changes; each direction once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for pieces, ring in zip(b.column(0), b.column(1).to_pylist(), strict=True) for x in stretches(pieces.as_py(), k, ring)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate([pa.string(), pa.int64(), pa.int64()])], ["seq", "cid", "num_kmers"])

    return paths.select("pieces", "ring").mapInArrow(run, "seq string, cid long, num_kmers long").distinct()
