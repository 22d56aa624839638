"""The graph by buckets: against the operators on tables of k-mers, which are tested by a naive walk, and against brute force."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hueweave.functions import blobs, packed
from hueweave.functions.dna import unpack
from hueweave.functions.packed import CODES, junction_hashes
from hueweave.operators import buckets, colors, fragments, graph, verify
from hueweave.runtime import CLEANUP, discard, materialize
from tests.test_graph import can, random_seqs, rc


def table(spark, seqs):
    return spark.createDataFrame(list(seqs), "color int, seq string").repartition(3)


def odd_seqs(k, seed):
    """Copies, a k-mer that is a whole run beside its neighbour, homopolymers, rings of many buckets, palindromes, breaks and nulls."""
    r = random.Random(seed)
    some = "".join(r.choice("ACGT") for _ in range(400))
    ring = "".join(r.choice("ACGT") for _ in range(150))
    half = "".join(r.choice("ACGT") for _ in range(k))
    lone = "".join(r.choice("ACGT") for _ in range(k))
    return [
        (0, some), (1, some[:200] + "N" + some[200:]), (2, rc(some[50:300])), (0, ring + ring[: k - 1]), (3, "A" * (3 * k)), (1, "ACNNT"), (2, None), (3, half + rc(half)), (4, some[:k]),
        (3, lone), (4, "".join(r.choice("ACGT") for _ in range(k)) + "n" + lone[1:] + "C"), (5, "AC" * (2 * k)), (62, some[350:] + some[:100]), (4, "T" * 700),
    ]


@pytest.mark.parametrize("k,m,in_task", [(21, None, 0), (5, 2, 300_000), (8, 3, 0), (31, 10, 0), (32, None, 0), (41, None, 300_000), (62, 10, 0), (63, None, 0)])
def test_unitigs_by_buckets(spark, k, m, in_task):
    for seqs in (odd_seqs(k, k), random_seqs(k)):
        rounds = []
        tigs, sets = buckets.unitigs(table(spark, seqs), k, 63, m, rounds, in_task)
        known = {r["cid"]: tuple(r["colors"]) for r in sets.collect()}
        assert [known[i] for i in range(len(known))] == sorted(known.values())
        plain = graph.unitigs(*_nodes(spark, seqs, k))
        want = sorted((r["cid"], r["seq"], r["num_kmers"]) for r in plain.collect())
        assert sorted((r["cid"], r["seq"], r["num_kmers"]) for r in tigs.collect()) == want
        assert rounds[-1] == 0


def _nodes(spark, seqs, k):
    kc = colors.packed_colors(table(spark, seqs), k, 63)
    return colors.encode_colors(kc, colors.color_sets(kc)), k


@pytest.mark.parametrize("k", [4, 8, 21, 31, 33, 63])
def test_junctions_and_edges_by_buckets(spark, k):
    seqs = odd_seqs(k, 3)
    nodes, _ = _nodes(spark, seqs, k)
    want = graph.junctions(nodes, k).select(unpack("junction", k - 1).alias("junction"), "n_in", "n_out")
    assert sorted(buckets.junction_degrees(table(spark, seqs), k).collect()) == sorted(want.collect())
    counts = want.groupBy("n_in", "n_out").count()
    assert sorted(buckets.degree_counts(table(spark, seqs), k).collect()) == sorted(counts.collect())
    glue = graph.glue_edges(nodes, k)
    glue = glue.select(unpack("x", k).alias("x"), "x_side", unpack("y", k).alias("y"), "y_side")
    assert sorted(buckets.glue_edges(table(spark, seqs), k, 63).collect()) == sorted(glue.collect())
    kmers = nodes.select(unpack("code", k).alias("kmer"))
    got = [r["kmer"] for r in buckets.linked_kmers(table(spark, seqs), k).collect()]
    assert sorted(got) == sorted(r["kmer"] for r in graph.linked_kmers(kmers).collect())


def test_set_changes(spark):
    k, seqs = 7, odd_seqs(7, 9)
    of, keyed = {}, [(c, s, i) for i, (c, s) in enumerate(seqs)]
    for c, s in seqs:
        for run in (s or "").replace("n", "N").split("N"):
            for i in range(len(run) - k + 1):
                of.setdefault(can(run[i : i + k]), set()).add(c)
    want = {}
    for c, s, key in keyed:
        for run in (s or "").replace("n", "N").split("N"):
            held = [of[can(run[i : i + k])] for i in range(len(run) - k + 1)]
            want[key] = want.get(key, 0) + sum(a != b for a, b in zip(held, held[1:]))
    rows = spark.createDataFrame(keyed, "color int, seq string, key long").repartition(3)
    got = {r["key"]: r["n"] for r in buckets.set_changes(rows, k, 63).collect()}
    assert {x: n for x, n in got.items() if n} == {x: n for x, n in want.items() if n}


def test_copies_are_put_together_in_chunks(spark, monkeypatch):
    k, seqs = 21, odd_seqs(21, 5)
    rows = spark.createDataFrame([(c, s, i) for i, (c, s) in enumerate(seqs * 3)], "color int, seq string, key long").repartition(6)
    parts = [r["data"] for r in buckets.super_kmer_blobs(rows, k, keyed=True).collect()]
    whole = buckets.Kmers(parts, k, keyed=True)
    monkeypatch.setattr(buckets, "CHUNK", 100)
    cut = buckets.Kmers(parts, k, keyed=True)
    show = lambda x: sorted(zip(*(a.tolist() for a in (*x.code, x.mask, x.left, x.right, x.owned, x.run))))
    assert show(cut) == show(whole) and len(whole.owned)
    assert (whole.masks_of([x[5:9] for x in whole.code]) == whole.mask[5:9]).all()


def test_super_kmers_travel_packed(spark):
    r = random.Random(2)
    seqs = [(i % 3, "".join(r.choices("ACGT", k=20_000))) for i in range(6)]
    held = buckets.super_kmer_blobs(table(spark, seqs), 21).selectExpr("sum(length(data)) AS n").first()["n"]
    assert held < 2.5 * 6 * 20_000  # bytes; a row (code, color) has 24 and more


@pytest.mark.parametrize("k,m", [(9, 4), (21, 10), (13, 5)])
def test_merged_counts(spark, k, m):
    seqs = [*odd_seqs(k, 8), *odd_seqs(k, 8)[:5], (None, "ACGT" * 9 + "N" + odd_seqs(k, 8)[0][1])]
    n = F.length("seq") - k + 1
    merged = fragments.merged_super_kmers(table(spark, seqs), k, m, 7).groupBy("bucket")
    want = merged.agg(F.count("*"), F.sum(n).cast("long"), F.sum(F.size("colors")).cast("long"))
    assert sorted(map(tuple, fragments.merged_counts(table(spark, seqs), k, m, 7).collect())) == sorted(map(tuple, want.collect()))


def test_super_kmers_of_whole_batches(spark, monkeypatch):
    k, m, runs = 21, 10, [s.replace("n", "N").replace("N", "") for _, s in odd_seqs(21, 1) if s]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(runs)] + [(99, None)], "run int, run_seq string").coalesce(1)
    got = [tuple(r) for r in packed.super_kmers(df, k, m, 7).sort("run", "start").collect()]
    alone = [t for i, x in enumerate(runs) for t in map(tuple, packed.super_kmers(df.where(f"run = {i}"), k, m, 7).sort("start").collect())]
    assert got == alone and {t[0] for t in got} == {i for i, x in enumerate(runs) if len(x) >= k}
    assert [(r.tolist(), bytes(t)) for r, t in packed.joined_runs(pa.array(["ACGT", None, "AC", "GGGG"]), 3, most=4)] == [([0], b"ACGT"), ([3], b"GGGG")]


@pytest.mark.parametrize("k,m", [(9, 4), (21, 10), (40, 13), (5, 5)])
def test_stretches_of_one_minimizer(spark, k, m):
    want, seqs = [], [s and s.replace("n", "N") for _, s in odd_seqs(k, 6)] + ["NNACGT\nACGT", "", "\n" + "ACGTTGCA" * 9 + "é" + "GATTACA" * 9]
    for doc, s in enumerate(seqs):
        for number, run in enumerate(re.findall("[ACGT]+", s or "")):
            least = [min(can(run[i + j : i + j + m]) for j in range(k - m + 1)) for i in range(len(run) - k + 1)]
            for i, x in enumerate(least):
                if i == 0 or x != least[i - 1]:
                    want.append([doc, number, i, x, k - 1])
                want[-1][4] += 1
    rows = spark.createDataFrame(list(enumerate(seqs)), "doc_id long, seq string").repartition(2)
    assert sorted(map(tuple, packed.minimizer_stretches(rows, k, m).collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("k", [9, 32, 41])
def test_damaged_graphs_are_found_out_by_buckets(spark, k):
    seqs = table(spark, odd_seqs(k, k))
    tigs, sets = buckets.unitigs(seqs, k, 63)
    tigs, sets = [tuple(r) for r in tigs.select("cid", "seq").collect()], sets.cache()
    long = max(tigs, key=lambda t: len(t[1]))
    rest = [t for t in tigs if t != long]
    other = next(t for t in tigs if t[0] != long[0])
    cases = {
        "": tigs, "kmer_lost": rest, "kmer_repeated": [*tigs, long], "kmer_strange": [*tigs, (long[0], "C" * k)], "path_stops": [*rest, (long[0], long[1][: 2 * k]), (long[0], long[1][k + 1 :])],
        "path_runs_on": [*[t for t in tigs if t != other], (other[0], other[1] + "T")], "set_unused": [t for t in tigs if t[0]],
    }
    for fault, rows in cases.items():
        rows = spark.createDataFrame(rows, "cid long, seq string")
        got = {x["fault"]: x["n"] for x in verify.graph_faults(seqs, rows, sets, k, 63).collect()}
        assert got == {x["fault"]: x["n"] for x in verify.graph_faults(seqs, rows, sets, k).collect()}
        assert set(got) == set(verify.FAULTS) and (got[fault] > 0 if fault else not any(got.values())), (fault, got)


def test_long_sequences_go_in_parts(spark, monkeypatch):
    r = random.Random(4)
    seq = "".join(r.choice("ACGT") for _ in range(5000))
    batch = table(spark, [(0, seq), (1, seq[100:220])]).coalesce(1).selectExpr("cast(color as long) color", "cast(seq as binary) seq").toArrow().to_batches()
    monkeypatch.setattr(buckets, "PIECE", 777)
    k, held = 21, []
    for b in batch:
        for codes, start, row, _ in buckets.pieces(b, k):
            s = blobs.cut(codes, k, 8)
            held += [(int(row[np.searchsorted(start, f, "right") - 1]), bytes(codes[f : f + n + k - 1])) for f, n in zip(s["first"].tolist(), s["n"].tolist())]
    pairs = {(r, x[i : i + k + 1]) for r, x in held for i in range(len(x) - k)}  # neighbours meet
    codes = bytes(CODES[np.frombuffer(seq.encode(), np.uint8)])
    long = {x for r, x in pairs if len([y for q, y in pairs if q == r]) > 200}
    assert long == {codes[i : i + k + 1] for i in range(5000 - k)}


def test_hashes_are_those_of_junctions():
    r = random.Random(1)
    seq = "".join(r.choice("ACGT") for _ in range(300)).encode()
    for k, m in ((21, 10), (9, 8), (33, 31)):
        codes = CODES[np.frombuffer(seq, np.uint8)]
        assert (blobs.sliding_minimum(blobs.mer_hashes(codes, m), k - m) == junction_hashes(seq, k, m)).all()


def test_colors_out_of_range_are_errors(spark):
    with pytest.raises(Exception, match="color 63 is not one of 63"):
        buckets.unitigs(table(spark, [(63, "ACGTACGTAC")]), 5, 63)
    with pytest.raises(Exception, match="color None is not one of 63"):
        buckets.unitigs(table(spark, [(None, "ACGTACGTAC")]), 5, 63)


def test_lean_tables_leave_no_shuffle_files(spark):
    tracked = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    rows = spark.range(1000).repartition(3, "id")
    before = tracked()
    lean = materialize(rows, "lean", lean=True)
    for _ in range(50):  # they go a moment later
        time.sleep(0.1 * (tracked() != before))
    assert tracked() == before and lean.count() == 1000
    assert spark.conf.get(CLEANUP) == "false"
    parts = materialize(rows.selectExpr("id", "id % 2 AS kind"), "parts", by="kind")
    discard(parts, part="kind=0")
    assert spark.read.parquet(parts._hw_path).count() == 500
