"""Ranking of nodes along non-branching paths by contraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.runtime import discard, materialize


def parts(nodes: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The values of a column of nodes: one array, or one for each half of pairs of longs."""
    if isinstance(nodes, pa.ChunkedArray):
        nodes = nodes.combine_chunks()
    return [p.to_numpy(zero_copy_only=False) for p in (nodes.flatten() if pa.types.is_struct(nodes.type) else [nodes])]


def single(src: pa.ChunkedArray, dst: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """Both ends of edges as single values, and what gives such values their Arrow form back. Pairs of longs are numbered in their order."""
    a, b, kind = parts(src), parts(dst), src.type
    if len(a) == 1:
        return a[0], b[0], lambda x: pa.array(x, kind)
    both = [np.concatenate(x) for x in zip(a, b)]
    order = np.lexsort(both[::-1])
    both = [x[order] for x in both]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in both], axis=0)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    names = [x[new] for x in both]
    return at[: len(a[0])], at[len(a[0]) :], lambda x: pa.StructArray.from_arrays([pa.array(p[x]) for p in names], ["hi", "lo"])


def chains(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges contracted to their chains: (first node, last node, edges) of each, and the nodes behind the first ones, in order, chain by chain.

    Edges on a circle stay as they are, chains of one edge.
    """
    names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, t = at[: len(src)], at[len(src) :]
    pred = np.arange(len(names))
    pred[t] = s
    head = pred == np.arange(len(names))
    head[t[s == t]] = False
    dist = (~head).astype(np.int64)
    ptr = pred
    for _ in range(int(len(names)).bit_length() + 1):
        if head[ptr].all():
            break
        dist, ptr = dist + dist[ptr], ptr[ptr]
    ringed = ~head[ptr]
    ring = np.flatnonzero(ringed)
    behind = np.flatnonzero(~ringed & ~head)
    behind = behind[np.lexsort((dist[behind], ptr[behind]))]
    ends = np.flatnonzero(np.concatenate([ptr[behind[1:]] != ptr[behind[:-1]], [True]])) if len(behind) else behind
    last = behind[ends]
    order = np.concatenate([behind, ring])
    edges = np.concatenate([dist[last], np.ones(len(ring), np.int64)])
    return names[np.concatenate([ptr[last], pred[ring]])], names[np.concatenate([last, ring])], edges, names[order]


def solved(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, dist, ring) of all nodes of some whole paths and circles: a path's root is its first node, a circle's its least, and ``ring`` the circle's length (0 for paths)."""
    names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    root, dist, ring = ranked(at[: len(src)], at[len(src) :], w, len(names))
    return names, names[root], dist, ring


def ranked(s: np.ndarray, t: np.ndarray, w: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root, dist, ring) of the nodes from 0 to ``n_nodes`` - 1, as ``solved`` has them; a node without edges is its own root."""
    every = np.arange(n_nodes)
    pred, cost = every.copy(), np.zeros(n_nodes, np.int64)
    pred[t], cost[t] = s, w
    head = pred == every
    head[t[s == t]] = False  # a node that follows itself
    ptr, dist, before, left = pred.copy(), cost.copy(), -1, every
    while True:  # unsettled nodes get fewer until only circles are left
        left = left[~head[ptr[left]]]
        if (n := len(left)) in (0, before):
            break
        to = ptr[left]
        more, onto = dist[to], ptr[to]
        before, dist[left], ptr[left] = n, dist[left] + more, onto
    ring = np.zeros(n_nodes, np.int64)
    if n:
        own = left
        at = np.searchsorted(own, pred[own])  # predecessors among the circles' nodes
        least, back = np.minimum(np.arange(n), at), at
        for _ in range(n.bit_length() + 1):
            least, back = np.minimum(least, least[back]), back[back]
        first = least == np.arange(n)
        step, opened = np.where(first, 0, cost[own]), np.where(first, np.arange(n), at)
        for _ in range(n.bit_length() + 1):
            step, opened = step + step[opened], opened[opened]
        ring[own] = np.bincount(least, cost[own], n).astype(np.int64)[least]
        ptr[own], dist[own] = own[least], step
    return ptr, dist, ring


def _solve(edges: DataFrame, kind: str) -> DataFrame:
    """``solved`` of edges (src, dst, w) of counted size, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            whole = pa.Table.from_batches(held)
            src, dst, named = single(whole.column(0), whole.column(1))
            rows = solved(src, dst, whole.column(2).to_numpy())
            for i in range(0, len(rows[0]), 100_000):
                node, root, dist, ring = (r[i : i + 100_000] for r in rows)
                yield pa.RecordBatch.from_arrays([named(node), named(root), pa.array(dist), pa.array(ring)], ["node", "root", "dist", "ring"])

    return edges.select("src", "dst", "w").repartition(1).mapInArrow(run, f"node {kind}, root {kind}, dist long, ring long")


def rank_paths(edges: DataFrame, in_task: int = 3_000_000, max_rounds: int = 200, rounds: list[int] | None = None) -> DataFrame:
    """(node, root, dist, cyclic) for the nodes of ``edges`` (src, dst), where no node has two successors or predecessors.

    An edge counts 1, or what a column ``w`` says. The root is a path's first node, or the least of a circle.

    By contraction: each round every node draws a bit from its hash, and a node that draws one behind a node that draws
    nothing leaves, its edges becoming one. No two neighbours leave together, a quarter of the nodes go each round, and
    no settled node comes up again, so all rounds together shuffle about three times the edges. When ``in_task`` edges are left they are
    ranked in one task. Then rounds are undone from the last to the first: a node takes its place from the node that it left. Each round's
    state is a table in shared storage, deleted in the end; ``rounds`` gets the edges of each round.
    """
    weight = F.col("w") if "w" in edges.columns else F.lit(1).cast("long")
    kind = edges.schema["src"].dataType.simpleString()
    table = materialize(edges.select("src", "dst", weight.alias("w"), F.lit(None).cast(kind).alias("gone"), F.lit(None).cast("long").alias("more")), "path-edges")
    levels, places = [table], []
    while True:
        left = levels[-1].where("src <> dst").select("src", "dst", "w")
        n = left.count()
        if rounds is not None:
            rounds.append(n)
        if n <= in_task:
            break
        if len(levels) > max_rounds:
            raise RuntimeError("paths did not contract")
        draws = lambda c: F.xxhash64(F.lit(len(levels)), c).bitwiseAND(F.lit(1).cast("long")) == 1  # noqa: B023, E731
        left = left.select("*", draws("src").alias("a"), draws("dst").alias("b"))
        leaving = left.where("not a and b").select(F.col("src").alias("from"), F.col("dst").alias("gone"), F.col("w").alias("more"))
        moved = left.where("a").join(leaving, F.col("src") == F.col("gone"), "left")
        moved = moved.select(F.coalesce("from", "src").alias("src"), "dst", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
        ends = left.where("not a and b").select("src", F.lit(None).cast(kind).alias("dst"), "w", F.col("dst").alias("gone"), F.col("w").alias("more"))
        none = F.lit(None).cast(kind).alias("gone"), F.lit(None).cast("long").alias("more")
        levels.append(materialize(left.where("not a and not b").select("src", "dst", "w", *none).union(moved.select("src", "dst", "w", *none)).union(ends), "path-edges"))
    if len(levels) == 1:
        out = materialize(_solve(table.select("src", "dst", "w"), kind).select("node", "root", "dist", (F.col("ring") > 0).alias("cyclic")), "path-ranks")
        discard(table)
        return out
    first = table.select("src").join(table.select(F.col("dst").alias("d")), F.col("src") == F.col("d"), "left_anti")  # a path may leave no edge, but its first node stays
    places.append(materialize(first.select(F.col("src").alias("node"), F.col("src").alias("root"), F.lit(0).cast("long").alias("dist"), F.lit(0).cast("long").alias("ring")), "path-places"))
    places.append(materialize(_solve(left, kind).where("ring > 0 or node <> root"), "path-places"))
    for i in range(len(levels) - 1, -1, -1):
        places.append(levels[i].where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("root"), F.lit(0).cast("long").alias("dist"), F.col("w").alias("ring")))
        gone = levels[i].where("gone is not null").select(F.col("src").alias("at"), F.col("gone"), F.col("more"))
        if i:
            back = gone.join(_all(places), F.col("at") == F.col("node"))
            dist = F.col("dist") + F.col("more")
            places.append(materialize(back.select(F.col("gone").alias("node"), "root", F.when(F.col("ring") > 0, F.pmod(dist, "ring")).otherwise(dist).alias("dist"), "ring"), "path-places"))
    every = _all(places)
    circles = every.where("ring > 0")  # a circle's root is the least of the nodes that were left: turn to the least of all
    turn = circles.groupBy("root").agg(F.min(F.struct("node", "dist")).alias("least")).withColumnRenamed("root", "r")
    circles = circles.join(turn, F.col("root") == F.col("r")).select("node", F.col("least.node").alias("root"), F.pmod(F.col("dist") - F.col("least.dist"), "ring").alias("dist"), F.lit(True).alias("cyclic"))
    out = materialize(every.where("ring = 0").select("node", "root", "dist", F.lit(False).alias("cyclic")).union(circles), "path-ranks")
    discard(*levels, *[p for p in places if hasattr(p, "_hw_path")])
    return out


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out
