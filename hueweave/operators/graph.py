"""The colored compacted graph: junctions, glue edges, unitigs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hueweave.functions.dna import MAX_PACKED_K, base_at, canonical, default_minimizer, kmer_mask, neighbours, packed_reverse_complement, reverse_complement, unpack, wide_reverse_complement
from hueweave.functions.packed import CODES, add_bucket, canonical_windows, turned_pairs
from hueweave.operators.paths import chains, parts, rank_paths, single
from hueweave.runtime import discard, materialize


class Kmers:
    """Expressions on the k-mers of a graph and on oriented nodes: packed (column ``code``; longs up to 31 bases, beyond that structs of two longs) or strings (column ``kmer``).

    A packed node has its direction in the lowest bit.
    """

    def __init__(self, nodes: DataFrame, k: int):
        self.k, self.packed = k, "code" in nodes.columns
        self.name = "code" if self.packed else "kmer"
        self.wide = self.packed and isinstance(nodes.schema["code"].dataType, StructType)
        self.kind = nodes.schema[self.name].dataType.simpleString()

    @staticmethod
    def pair(hi: Column, lo: Column) -> Column:
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    def turned(self, x: Column, k: int) -> Column:
        if self.wide:
            return wide_reverse_complement(x, k)
        return packed_reverse_complement(x, k) if self.packed else reverse_complement(x)

    def left(self, x: Column) -> Column:
        return F.shiftrightunsigned(x, 2) if self.packed else F.substring(x, 1, self.k - 1)

    def right(self, x: Column) -> Column:
        return x.bitwiseAND(F.lit(kmer_mask(self.k - 1)).cast("long")) if self.packed else F.substring(x, 2, self.k - 1)

    def same(self, x: Column, y: Column) -> Column:
        return (x["hi"] == y["hi"]) & (x["lo"] == y["lo"]) if self.wide else x == y

    def spelt(self, x: Column) -> Column:
        return unpack(x, self.k) if self.packed else x

    def oriented(self, x: Column, plus: Column) -> Column:
        if self.wide:
            return self.pair(x["hi"], F.shiftleft(x["lo"], 1).bitwiseOR((~plus).cast("long")))
        return F.shiftleft(x, 1).bitwiseOR((~plus).cast("long")) if self.packed else F.concat(x, F.when(plus, "+").otherwise("-"))

    def plus(self, node: Column) -> Column:
        return (node["lo"] if self.wide else node).bitwiseAND(F.lit(1).cast("long")) == 0 if self.packed else node.endswith("+")

    def kmer(self, node: Column) -> Column:
        if self.wide:
            return self.pair(node["hi"], F.shiftrightunsigned(node["lo"], 1))
        return F.shiftrightunsigned(node, 1) if self.packed else F.substring(node, F.lit(1), F.length(node) - 1)

    def flipped(self, node: Column) -> Column:
        """A packed node in the other direction."""
        one = F.lit(1).cast("long")
        return self.pair(node["hi"], node["lo"].bitwiseXOR(one)) if self.wide else node.bitwiseXOR(one)

    def last_base(self, x: Column, plus: Column) -> Column:
        if not self.packed:
            return F.when(plus, F.right(x, F.lit(1))).otherwise(F.translate(F.left(x, F.lit(1)), "ACGT", "TGCA"))
        return F.when(plus, base_at(x, 0)).otherwise(F.translate(base_at(x, self.k - 1), "ACGT", "TGCA"))


def ends(nodes: DataFrame, k: int) -> DataFrame:
    """(kmer, cid, side, junction, is_in): both ends of each k-mer at their canonical (k-1)-mers, packed as the k-mers are.

    The successors of an incoming end are the outgoing ends at its junction. Ends at a
    palindromic junction never continue; a palindromic k-mer has one end, as both are the same.
    """
    km = Kmers(nodes, k)
    if km.wide:
        return _wide_ends(nodes, k)
    x, j = F.col(km.name), F.col("j")
    sides = F.array(F.struct(F.lit("L").alias("side"), km.left(x).alias("j")), F.struct(F.lit("R").alias("side"), km.right(x).alias("j")))
    if k % 2 == 0:
        sides = F.when(x == km.turned(x, k), F.slice(sides, 1, 1)).otherwise(sides)
    e = nodes.select(x.alias("kmer"), "cid", F.explode(sides).alias("e")).select("kmer", "cid", "e.side", "e.j").withColumn("t", km.turned(j, k - 1))
    e = e.where("j <> t").withColumn("junction", F.least("j", "t"))
    return e.select("kmer", "cid", "side", "junction", ((F.col("side") == "R") == (j == F.col("junction"))).alias("is_in"))


def _wide_ends(nodes: DataFrame, k: int) -> DataFrame:
    """``ends`` of k-mers that take two longs, in numpy: as column expressions these grow beyond what the JVM compiles."""
    low, two = np.uint64(kmer_mask(k - 1 - MAX_PACKED_K)), np.uint64(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo = (x.view(np.uint64) for x in parts(b.column(0)))
            sides = {"L": (hi >> two, ((hi & np.uint64(3)) << np.uint64(2 * MAX_PACKED_K - 2)) | (lo >> two)), "R": (hi & low, lo)}
            for side, (jh, jl) in sides.items():
                th, tl = turned_pairs(jh, jl, k - 1)
                on = (jh != th) | (jl != tl)
                if side == "R" and k % 2 == 0:
                    kh, kl = turned_pairs(hi, lo, k)
                    on &= (kh != hi) | (kl != lo)
                own = ((jh < th) | ((jh == th) & (jl < tl)))[on]
                junction = [np.where(own, x[on], y[on]).view(np.int64) for x, y in ((jh, th), (jl, tl))]
                kept = pa.array(on)
                columns = [b.column(0).filter(kept), b.column(1).filter(kept), pa.array([side] * len(own), pa.string()), pa.StructArray.from_arrays([pa.array(x) for x in junction], ["hi", "lo"]), pa.array(own if side == "R" else ~own)]
                yield pa.RecordBatch.from_arrays(columns, ["kmer", "cid", "side", "junction", "is_in"])

    kind, cid = (nodes.schema[c].dataType.simpleString() for c in ("code", "cid"))
    return nodes.select("code", "cid").mapInArrow(run, f"kmer {kind}, cid {cid}, side string, junction {kind}, is_in boolean")


def junctions(nodes: DataFrame, k: int) -> DataFrame:
    """(junction, n_in, n_out, and kmer, right and cid of an incoming and an outgoing end).

    The ends are those of one k-mer where the degree is 1, which is where they serve; kept apart, packed columns
    stay in a hash aggregate.
    """
    km = Kmers(nodes, k)
    e = ends(nodes, k).withColumn("is_right", F.col("side") == "R")
    if km.wide:
        e = e.withColumns({"hi": F.col("kmer")["hi"], "lo": F.col("kmer")["lo"]})
    values = ("hi", "lo", "is_right", "cid") if km.wide else ("kmer", "is_right", "cid")
    kept = [F.max(F.when(on, F.col(c))).alias(f"{n}_{c}") for n, on in (("in", F.col("is_in")), ("out", ~F.col("is_in"))) for c in values]
    out = e.groupBy("junction").agg(F.count_if("is_in").alias("n_in"), F.count_if(~F.col("is_in")).alias("n_out"), *kept)
    if not km.wide:
        return out
    whole = {f"{n}_kmer": F.when(F.col(f"{n}_lo").isNotNull(), km.pair(F.col(f"{n}_hi"), F.col(f"{n}_lo"))) for n in ("in", "out")}
    return out.withColumns(whole).drop("in_hi", "in_lo", "out_hi", "out_lo")


def glue_edges(nodes: DataFrame, k: int) -> DataFrame:
    """(x, x_side, y, y_side): ends that continue each other: alone on both sides of a junction, of two k-mers with one color set."""
    return _glue(nodes, k).drop("junction", "cid")


def _glue(nodes: DataFrame, k: int) -> DataFrame:
    j = junctions(nodes, k).where("n_in = 1 and n_out = 1 and in_kmer <> out_kmer and in_cid = out_cid")
    side = lambda c: F.when(F.col(c), "R").otherwise("L")
    return j.select(F.col("in_kmer").alias("x"), side("in_is_right").alias("x_side"), F.col("out_kmer").alias("y"), side("out_is_right").alias("y_side"), "junction", F.col("in_cid").alias("cid"))


def linked_kmers(nodes: DataFrame) -> DataFrame:
    """The k-mers with at least one neighbour in the graph: a semi-join of each with its eight possible neighbours."""
    probe = nodes.select("kmer", F.explode(F.array_distinct(neighbours(F.col("kmer")))).alias("n"))
    return probe.join(nodes.select(F.col("kmer").alias("other")), F.col("n") == F.col("other"), "left_semi").select("kmer").distinct()


def oriented(glue: DataFrame, km: Kmers) -> DataFrame:
    """Successor edges (src, dst, and the glue edge's other columns) of oriented nodes, one in each direction: leaving by R or entering by L is plus."""
    leave = lambda n, s: km.oriented(F.col(n), F.col(s) == "R")
    enter = lambda n, s: km.oriented(F.col(n), F.col(s) == "L")
    there = F.struct(leave("x", "x_side").alias("src"), enter("y", "y_side").alias("dst"))
    back = F.struct(leave("y", "y_side").alias("src"), enter("x", "x_side").alias("dst"))
    others = [c for c in glue.columns if c not in ("x", "x_side", "y", "y_side")]
    return glue.select(*others, F.explode(F.array(there, back)).alias("e")).select("e.src", "e.dst", *others)


def unitigs(nodes: DataFrame, k: int, m: int | None = None, piece: int = 4096, rounds: list[int] | None = None) -> DataFrame:
    """(cid, seq, num_kmers): the maximal non-branching paths of one color set, in canonical form.

    Each path shows up in both directions and is kept once. A circular path starts at its least
    k-mer. Even k is allowed: a palindromic k-mer ends its path. ``m`` is the minimizer length by which
    neighbours meet in a task, ``rounds`` gets the edges of each round of contraction.
    """
    km = Kmers(nodes, k)
    m = m or (default_minimizer(k) if k >= 4 else 1)
    m = min(m, MAX_PACKED_K - 1) if km.wide else m
    glue = _glue(nodes, k)
    if km.packed and m < k - 1:  # most neighbours on a path share the minimizer of their junctions
        glue = add_bucket(glue.withColumnRenamed("junction", "code"), k - 1, m, (1 << 31) - 1).drop("code")
        edges = materialize(oriented(glue, km), "glue")
        paths, held = spelt_paths(edges, km, rounds)
    else:
        edges = materialize(oriented(glue.drop("junction"), km), "glue")
        paths, held = _spelt_by_node(edges, km, piece, rounds)
    ends_ = edges.select(km.kmer(F.col("src")).alias("x"))  # a k-mer with an edge has one that leaves it, in one direction or the other
    alone = nodes.join(ends_, km.same(F.col(km.name), F.col("x")), "left_anti").select("cid", km.spelt(F.col(km.name)).alias("seq"))
    out = materialize(paths.union(alone).withColumn("num_kmers", (F.length("seq") - k + 1).cast("long")), "unitig-paths")
    discard(edges, *held)
    return out


def _spelt_by_node(edges: DataFrame, km: Kmers, piece: int, rounds: list[int] | None) -> tuple[DataFrame, list[DataFrame]]:
    """(cid, seq) of the paths of edges (src, dst, cid), and the tables that this reads. Every node is ranked; bases are gathered in pieces of ``piece`` k-mers and the pieces of a path then."""
    ranked = rank_paths(edges.select("src", "dst"), rounds=rounds)
    kept = ranked.where(~F.col("cyclic") | km.plus(F.col("root")))
    kept = kept.select("root", "dist", km.kmer(F.col("node")).alias("x"), km.plus(F.col("node")).alias("plus"))
    x, first = F.col("x"), F.col("dist") == 0
    whole = F.when(F.col("plus"), km.spelt(x)).otherwise(km.spelt(km.turned(x, km.k)))
    base = F.when(first, whole).otherwise(km.last_base(x, F.col("plus")))
    spell = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda p: p["s"]), "")
    parts = kept.select("root", F.floor(F.col("dist") / piece).alias("part"), F.struct("dist", base.alias("s")).alias("p"))
    parts = parts.groupBy("root", "part").agg(spell("p").alias("s"))
    paths = parts.groupBy("root").agg(spell(F.struct("part", "s")).alias("seq"))
    paths = paths.join(edges.select(F.col("src").alias("h"), "cid"), F.col("root") == F.col("h")).select("cid", canonical("seq").alias("seq")).distinct()
    return paths, [ranked]


def spelt_paths(edges: DataFrame, km: Kmers, rounds: list[int] | None = None, per_task: int = 2_000_000) -> tuple[DataFrame, list[DataFrame]]:
    """(cid, seq) of the paths of edges (src, dst, cid, bucket) of packed nodes, and the tables that this reads.

    Edges are shuffled by bucket, and those that meet in a task (``per_task`` at a time) become chains there, spelt at once: a
    chain is one row with its bases, and its inner k-mers never travel again. Chains are ranked by their ends, and a path is
    its chains' bases in order. Of a path's two directions the one with the lesser first node is kept.
    """
    k, top = km.k, 2 * (km.k - 1 - (MAX_PACKED_K if km.wide else 0))
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // per_task))
    letters, wide = np.frombuffer(b"ACGT", np.uint8), km.wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            src, dst, named = single(whole.column(0), whole.column(1))
            cid = whole.column(2).to_numpy()
            first, last, w, behind = chains(src, dst)
            order = np.argsort(src)
            node = parts(named(behind))
            code = node[-1] >> 1
            base = np.where(node[-1] & 1, 3 - (((node[0] if wide else code) >> top) & 3), code & 3)
            upto = np.concatenate([[0], np.cumsum(w)]).astype(np.int32)
            bases = pa.StringArray.from_buffers(len(w), pa.py_buffer(upto), pa.py_buffer(letters[base].tobytes()))
            yield pa.RecordBatch.from_arrays([named(first), named(last), pa.array(w), pa.array(cid[order[np.searchsorted(src, first, sorter=order)]]), bases], ["src", "dst", "w", "cid", "bases"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= per_task:
                yield from flush()
                held = []
        if held:
            yield from flush()

    met = materialize(edges.repartition(n, "bucket").select("src", "dst", "cid").mapInArrow(run, f"src {km.kind}, dst {km.kind}, w long, cid long, bases string"), "chains")
    ranked = rank_paths(met.select("src", "dst", "w"), rounds=rounds)
    placed = met.join(ranked, F.col("src") == F.col("node"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("dist", "bases"))), lambda p: p["bases"])
    paths = placed.groupBy("root").agg(F.array_join(pieces, "").alias("bases"), F.max(F.struct("dist", "dst"))["dst"].alias("last"), F.max("cid").alias("cid"), F.max("cyclic").alias("cyclic"))
    x = km.kmer(F.col("root"))
    spelt = F.when(km.plus(F.col("root")), km.spelt(x)).otherwise(km.spelt(km.turned(x, k)))
    paths = paths.select("root", "cid", "cyclic", "last", F.concat(spelt, "bases").alias("seq"))
    whole = paths.where(~F.col("cyclic") & (F.col("root") <= km.flipped(F.col("last")))).select("cid", canonical("seq").alias("seq"))
    rings = turn_rings(paths.where("cyclic").select("cid", F.expr("left(seq, length(seq) - 1)").alias("seq")), k)
    return whole.union(rings), [met, ranked]


def turn_rings(rings: DataFrame, k: int, both: bool = True) -> DataFrame:
    """(cid, seq) of circular paths spelt once round from any k-mer, in both directions or one: one direction, from the least k-mer on, in canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cid, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hi, lo = canonical_windows(CODES[np.frombuffer(seq.encode(), np.uint8)], k)
                least = np.flatnonzero(hi == hi.min())
                at = int(least[np.argmin(lo[least])])
                n = len(lo)
                own = seq[at : at + k]
                if not both and own > own[::-1].translate(str.maketrans("ACGT", "TGCA")):  # take the other direction
                    seq, at = seq[::-1].translate(str.maketrans("ACGT", "TGCA")), len(seq) - k - at
                    own = seq[at : at + k]
                back = own[::-1].translate(str.maketrans("ACGT", "TGCA"))
                if own <= back:
                    rows.append((cid, min(x := (seq[:n] + seq[:n] + seq[:n] * -(-k // n))[at : at + n + k - 1], x[::-1].translate(str.maketrans("ACGT", "TGCA")))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["cid", "seq"])

    return rings.select("cid", "seq").mapInArrow(run, "cid long, seq string")
