"""The whole build: sequence files to graph artifacts."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from hueweave.functions.dna import check_k
from hueweave.operators import buckets, colors, graph
from hueweave.runtime import discard, materialize
from hueweave.sources import artifacts, sequences
from hueweave.sources.packed_files import ColorSetFiles, RunEndFiles


#: Up to so many colors, sets form as masks in one row; beyond, by digests.
MASKED = 1008


@dataclass(frozen=True)
class BuildConfig:
    """What decides a build's results. Threads, memory and buckets are the cluster's settings.

    ``m``, from 2 to k, is the minimizer length by which neighbouring k-mers meet in a task; it changes time, not results,
    and unset it follows from k.
    """

    k: int = 31
    permissive: bool = False
    m: int | None = None

    def __post_init__(self) -> None:
        check_k(self.k)
        if self.m is not None and not 2 <= self.m <= self.k:
            raise ValueError("m must be from 2 to k")
        if not isinstance(self.permissive, bool):
            raise ValueError("permissive is true or false")


@dataclass(frozen=True)
class Graph:
    unitigs: DataFrame
    color_sets: DataFrame
    metadata: DataFrame
    num_colors: int
    config: BuildConfig = field(default_factory=BuildConfig)
    #: Seconds and rows of each phase, in order.
    phases: dict[str, tuple[float, int]] = field(default_factory=dict)
    #: Pieces of paths that each round of joining begins with; of more than 63 colors edges of each round of contraction.
    rounds: list[int] = field(default_factory=list)

    def _of(self, name: str) -> int:
        return self.metadata.first()[name]

    @property
    def num_kmers(self) -> int:
        return self._of("num_kmers")

    @property
    def num_unitigs(self) -> int:
        return self._of("num_unitigs")

    @property
    def num_color_sets(self) -> int:
        return self._of("num_color_sets")

    def write(self, base: str, packed: bool = False) -> None:
        artifacts.write(base, self.unitigs, self.color_sets, self.metadata, self.num_colors, packed)


def build_graph(seqs: DataFrame, n_colors: int, config: BuildConfig | None = None) -> Graph:
    """Unitigs, color sets and metadata of (color, seq) rows; each phase is a written table, timed and counted.

    Up to 63 colors the phases are the buckets' own paths, the color sets, the joined paths and the numbered ones.
    """
    config = config or BuildConfig()
    k, phases, rounds = config.k, {}, []

    def phase(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        began = time.monotonic()
        out = materialize(make(), name, lean=True)
        phases[name] = (time.monotonic() - began, out.count())
        return out

    if n_colors <= buckets.MASKED:
        local = phase("kmer-colors", lambda: buckets.local_paths(seqs, k, n_colors, config.m))
        sets = phase("color-sets", lambda: buckets.path_sets(local))
        tables = buckets.join_paths(local, k, rounds=rounds)
        joined = phase("nodes", lambda: buckets.path_texts(tables, sets, k))
        discard(*tables)
        sets = sets.select("cid", "colors")

        def number() -> DataFrame:
            out = artifacts.number_unitigs(joined)  # which writes the rows in their order
            discard(joined)
            return out

        numbered = phase("unitigs", number)
        return Graph(numbered, sets, artifacts.metadata(numbered, sets, k, n_colors), n_colors, config, phases, rounds)
    if n_colors > MASKED:
        named, sets = colors.digest_colors(seqs, k, n_colors)
        nodes = phase("nodes", lambda: named)
    else:
        kc = phase("kmer-colors", lambda: colors.packed_colors(seqs, k, n_colors))
        sets = phase("color-sets", lambda: colors.color_sets(kc))
        nodes = phase("nodes", lambda: colors.encode_colors(kc, sets))
    numbered = phase("unitigs", lambda: artifacts.number_unitigs(graph.unitigs(nodes, k, config.m, rounds=rounds)))
    return Graph(numbered, sets, artifacts.metadata(numbered, sets, k, n_colors), n_colors, config, phases, rounds)


def build(spark: SparkSession, manifest_path: str, config: BuildConfig | None = None) -> Graph:
    """The graph of the files that a manifest names."""
    config = config or BuildConfig()
    manifest = sequences.read_manifest(spark, manifest_path)
    return build_graph(sequences.read_sequences(spark, manifest, config.permissive), manifest.count(), config)


@dataclass(frozen=True)
class StoredGraph:
    """A written graph: its five counts, and its sets and unitigs by color-set id."""

    spark: SparkSession
    base: str
    k: int
    num_kmers: int
    num_colors: int
    num_unitigs: int
    num_color_sets: int

    def color_sets(self, cids: list[int] | None = None) -> DataFrame:
        """(color_set_id, unitig_start, num_unitigs, color_set), of some sets or all; only the row groups that may hold them are read, and only they are decoded."""
        return artifacts.read_color_sets(self.spark, self.base, cids)

    def unitigs(self, cids: list[int] | None = None) -> DataFrame:
        u = self.spark.read.parquet(f"{self.base}.unitigs")
        return u if cids is None else u.where(u["cid"].isin(cids))

    def packed(self) -> tuple[ColorSetFiles, RunEndFiles]:
        """Single color sets, and their unitigs' ids, read in place; for graphs written with ``packed``."""
        return ColorSetFiles(f"{self.base}.packed_color_sets"), RunEndFiles(f"{self.base}.run_ends")


def open_graph(spark: SparkSession, base: str) -> StoredGraph:
    """The graph that ``Graph.write(base)`` has written."""
    return StoredGraph(spark, base, **artifacts.read_metadata(spark, f"{base}.metadata"))
