"""A distributed check of a graph against its sequences: every k-mer once, in its color set, on paths that neither stop early nor run on."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.functions import blobs as B
from hueweave.functions.dna import MAX_PACKED_K, check_k
from hueweave.functions.packed import CODES, packed_kmers, sliding_minimum
from hueweave.operators import buckets
from hueweave.operators.colors import _members, color_sets, encode_colors, packed_colors
from hueweave.operators.graph import junctions
from hueweave.runtime import materialize

FAULTS = ("kmer_repeated", "kmer_lost", "kmer_strange", "path_stops", "path_runs_on", "set_repeated", "set_unused")


def _inner(unitigs: DataFrame, k: int) -> DataFrame:
    """The canonical (k-1)-mers between neighbouring k-mers of each unitig, packed."""
    return _mers(unitigs.select(F.expr("substring(seq, 2, length(seq) - 2)").alias("seq")), k).select(F.col("code").alias("inner")).distinct()


def _mers(seqs: DataFrame, k: int) -> DataFrame:
    """(code): the canonical (k-1)-mers of (seq) rows, packed as junctions of k-mers are: of 32 bases, k-mers and junctions are pairs of longs."""
    found = packed_kmers(seqs.select(F.lit(0).alias("color"), "seq"), k - 1).select("code")
    return found.select(F.struct(F.lit(0).cast("long").alias("hi"), F.col("code").alias("lo")).alias("code")) if k - 1 == MAX_PACKED_K else found


class Inner:
    """The junctions inside a bucket's stretches of unitigs."""

    def __init__(self, found: buckets.Occurrences, k: int):
        last = np.zeros(len(found.of), bool)
        last[found.first + found.n - 1] = True
        self.code = B.canonical_at(found.data, found.place[~last] + 1, k - 1)[0]


def bucket_faults(parts: list[list[bytes]], k: int) -> pa.RecordBatch:
    """(what, mask, cid, n) of one bucket's super-k-mers of the sequences and of the unitigs, and of the junctions that close circles.

    ``kmer``: k-mers by true color set (0: none) and by the unitigs' id (-1: none); ``repeated``, ``stops``, ``runs_on``: faults.
    """
    truth = buckets.Kmers(parts[0], k) if parts[0] else None
    held = buckets.Occurrences(parts[1], k) if parts[1] else None
    wide = 1 if k <= MAX_PACKED_K else 2
    none = [np.zeros(0, np.uint64)] * wide
    code = [np.concatenate([a, b]) for a, b in zip(truth.code if truth else none, held.code if held else none)]
    n = len(truth.owned) if truth else 0
    own = np.concatenate([truth.owned if truth else np.zeros(0, bool), held.bits & 4 > 0 if held else np.zeros(0, bool)])
    mask, cid, times = np.zeros(len(own), np.uint64), np.full(len(own), -1), np.zeros(len(own), np.int64)
    if truth:
        mask[:n] = truth.mask
    if held:
        cid[n:], times[n:] = held.color[held.of], 1
    code, mask, cid, times = [x[own] for x in code], mask[own], cid[own], times[own]
    rows: list[tuple[str, int, int, int]] = []
    if len(mask):
        order, begins = B.grouped(code)
        mask, cid, times = np.bitwise_or.reduceat(mask[order], begins), np.maximum.reduceat(cid[order], begins), np.add.reduceat(times[order], begins)
        rows.append(("repeated", 0, -1, int((times > 1).sum())))
        order = np.lexsort((mask, cid))
        mask, cid = mask[order], cid[order]
        begins = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (cid[1:] != cid[:-1])))
        rows += [("kmer", int(m), int(c), int(x)) for m, c, x in zip(mask[begins], cid[begins], np.diff(np.append(begins, len(mask))))]
    lone = 1 if k - 1 <= MAX_PACKED_K else 2
    sides = [[np.zeros(0, np.uint64)] * lone for _ in range(3)]
    if truth:
        # the junctions of 32-base k-mers are pairs there
        sides[0] = [x[truth.glue[2]] for x in truth.junctions["code"]][-lone:]
    if held:
        sides[1] = Inner(held, k).code
    if parts[2]:
        (size,), data = B.read_blobs(parts[2], 1)
        sides[2] = B.canonical_at(data, B.starts_of(size), k - 1)[0]
    bits = np.repeat(np.array([1, 2, 4], np.uint8), [len(s[0]) for s in sides])
    if len(bits):
        order, begins = B.grouped([np.concatenate(x) for x in zip(*sides)])
        bits = np.bitwise_or.reduceat(bits[order], begins)
        rows += [("stops", 0, -1, int((bits == 1).sum())), ("runs_on", 0, -1, int((bits & 3 == 2).sum()))]
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["what", "mask", "cid", "n"])


def closing_blobs(unitigs: DataFrame, k: int) -> DataFrame:
    """(bucket, n, bases, data): the junctions at which circular unitigs may close, in the buckets of super-k-mers."""
    m, n = buckets.short_minimizer(k), int(unitigs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * buckets.FINER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = b.column(0).to_pylist()
            codes, first = CODES[np.frombuffer("".join(seqs).encode(), np.uint8)], (k - 1) * np.arange(len(seqs))
            if len(seqs):
                h = sliding_minimum(B.mer_hashes(codes, m), k - m)[first]
                bucket = ((h >> np.uint64(1)) % np.uint64(n)).astype(np.int64)
                yield buckets._batch(B.blobs(codes, first, np.full(len(seqs), k - 1), bucket, []), k)

    closing = unitigs.where(F.expr(f"left(seq, {k - 1}) = right(seq, {k - 1})")).select(F.expr(f"left(seq, {k - 1})").alias("seq"))
    return closing.mapInArrow(run, buckets.BLOBS)


def packed_faults(sequences: DataFrame, unitigs: DataFrame, sets: DataFrame, k: int, n_colors: int) -> DataFrame:
    """``graph_faults`` by buckets, of up to 63 colors: what belongs together meets there, and k-mers are counted by pairs of color sets."""
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sources = [buckets.super_kmer_blobs(sequences, k, limit=buckets.few(n_colors)), buckets.super_kmer_blobs(unitigs.select(F.col("cid").alias("color"), "seq"), k), closing_blobs(unitigs, k)]
    rows = reduce(DataFrame.union, [s.select("bucket", "data", F.lit(i).alias("source")) for i, s in enumerate(sources)])
    met = rows.repartition(n, "bucket").sortWithinPartitions("bucket")

    def make(parts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        yield bucket_faults(parts, k)

    found = buckets.each_bucket(met, make, "what string, mask long, cid long, n long", sources=3).groupBy("what", "mask", "cid").agg(F.sum("n").alias("n"))
    found = materialize(found, "found-faults", lean=True)
    named = found.where("what = 'kmer'").withColumn("true_set", F.when(F.col("mask") != 0, _members(F.col("mask"), F.lit(0))))
    named = named.join(sets.select(F.col("cid").alias("c"), "colors"), F.col("cid") == F.col("c"), "left").where("not true_set <=> colors")
    used = found.where("what = 'kmer' and cid >= 0").select(F.col("cid").alias("u")).distinct()
    unused = sets.join(used, F.col("cid") == F.col("u"), "full_outer").where("cid is null or u is null")
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    counts = [
        total(found.where("what = 'repeated'")), total(named.where("mask <> 0")), total(named.where("cid >= 0")), total(found.where("what = 'stops'")), total(found.where("what = 'runs_on'")),
        sets.groupBy("colors").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")), unused.agg(F.count("*").alias("n")),
    ]
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("fault"), "n") for name, df in zip(FAULTS, counts, strict=True)])


def graph_faults(sequences: DataFrame, unitigs: DataFrame, sets: DataFrame, k: int, n_colors: int | None = None) -> DataFrame:
    """(fault, n), a row for each of FAULTS: how often it occurs in a graph, unitigs (cid, seq) and sets (cid, colors), of (color, seq) rows.

    ``kmer_repeated``: k-mers that unitigs hold more than once; ``kmer_lost`` and ``kmer_strange``: k-mers of the sequences that
    the graph lacks with that color set, and the other way round; ``path_stops``: junctions that continue a path of one
    color set, but are inside no unitig (a circle's own closing one may); ``path_runs_on``: junctions inside unitigs that do not; ``set_repeated``, ``set_unused``:
    color sets that stand twice, and sets or ids without their counterpart. Every step is a keyed join or aggregate; with
    ``n_colors`` given, up to 63, the work of buckets (``packed_faults``).
    """
    check_k(k)
    if n_colors is not None and n_colors <= buckets.MASKED:
        return packed_faults(sequences, unitigs, sets, k, n_colors)
    truth = materialize(packed_colors(sequences, k), "true-colors")
    held = packed_kmers(unitigs.select(F.col("cid").cast("int").alias("color"), "seq"), k).groupBy("code").agg(F.sum("n").alias("n"), F.max("color").alias("cid"))
    held = materialize(held, "held-kmers")
    named = held.join(sets.select(F.col("cid").alias("c"), "colors"), F.col("cid") == F.col("c"), "left").select("code", "colors")
    nodes = materialize(encode_colors(truth, materialize(color_sets(truth), "true-sets")), "true-nodes")
    glue = materialize(junctions(nodes, k).where("n_in = 1 and n_out = 1 and in_kmer <> out_kmer and in_cid = out_cid").select("junction"), "true-junctions")
    inner = materialize(_inner(unitigs, k), "inner-junctions")
    closing = unitigs.where(F.expr(f"left(seq, {k - 1}) = right(seq, {k - 1})")).select(F.expr(f"left(seq, {k - 1})").alias("seq"))
    closing = _mers(closing, k).distinct()
    stops = glue.join(inner, F.col("junction") == F.col("inner"), "left_anti").join(closing, F.col("junction") == F.col("code"), "left_anti")
    used = unitigs.select(F.col("cid").alias("u")).distinct()
    unused = sets.join(used, F.col("cid") == F.col("u"), "full_outer").where("cid is null or u is null")
    found = [
        held.where("n > 1"), truth.exceptAll(named), named.exceptAll(truth), stops, inner.join(glue, F.col("inner") == F.col("junction"), "left_anti"),
        sets.groupBy("colors").agg(F.count("*").alias("n")).where("n > 1"), unused,
    ]
    count = lambda name, df: df.agg(F.lit(name).alias("fault"), F.count("*").alias("n"))
    return reduce(DataFrame.union, [count(name, df) for name, df in zip(FAULTS, found, strict=True)])
