"""The graph against a naive whole-graph walk, stitching against generated fragments, and the sources and codec."""

import gzip
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hueweave.functions import codec, dna, packed
from hueweave.operators import colors, fragments, graph, verify
from hueweave.operators.paths import chains, rank_paths
from hueweave.operators.stitch import stitch, stretches
from hueweave.plans.build import BuildConfig, build, open_graph
from hueweave.sources import artifacts, sequences
from hueweave.streaming import ingest


def rc(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def can(x):
    return min(x, rc(x))


def naive(seqs, k):
    """Color of each k-mer and the unitigs, by successors looked up one at a time."""
    color = {}
    for c, s in seqs:
        run = ""
        for ch in s.upper() + "N":
            if ch in "ACGT":
                run += ch
                continue
            for i in range(len(run) - k + 1):
                color.setdefault(can(run[i : i + k]), set()).add(c)
            run = ""
    succ = lambda x: {can(x[1:] + b): x[1:] + b for b in "ACGT" if can(x[1:] + b) in color}

    def step(x):
        if x[1:] == rc(x[1:]):
            return None
        s = succ(x)
        if len(s) != 1:
            return None
        y = next(iter(s.values()))
        if len(succ(rc(y))) != 1 or can(y) == can(x) or color[can(y)] != color[can(x)]:
            return None
        return y

    seen, out = set(), []
    for x in sorted(color):
        if x in seen:
            continue
        path = [x]
        seen.add(x)
        for turn in range(2):
            while x != rc(x) or len(path) == 1:
                y = step(path[-1])
                if y is None or can(y) in seen:
                    break
                path.append(y)
                seen.add(can(y))
                if y == rc(y):
                    break
            path = [rc(z) for z in reversed(path)]
        out.append((frozenset(map(can, path)), frozenset(color[x])))
    return color, out


def random_seqs(seed):
    r = random.Random(seed)
    base = "".join(r.choice("ACGT") for _ in range(260))
    seqs = [(0, base), (1, base[40:120] + "N" + base[90:200].lower()), (2, rc(base)[10:150]), (3, "".join(r.choice("ACGT") for _ in range(80)))]
    loop = "".join(r.choice("ACGT") for _ in range(24))
    return [*seqs, (1, loop * 2 + loop[:12]), (2, "ACG"), (3, "A" * 30)]


@pytest.mark.parametrize("k,seed", [(9, 1), (31, 2), (35, 4), (5, 3)])
def test_unitigs_match_naive_walk(spark, k, seed):
    seqs = random_seqs(seed)
    color, truth = naive(seqs, k)
    df = spark.createDataFrame(seqs, "color int, seq string")
    kc = colors.kmer_colors(df, k).cache()
    wide = colors.kmer_colors(df.withColumn("color", F.col("color") * 70), k, 300)  # masks in several columns
    assert {r["kmer"]: {c // 70 for c in r["colors"]} for r in wide.collect()} == color
    assert {r["kmer"]: set(r["colors"]) for r in kc.collect()} == color
    sets = colors.color_sets(kc).cache()
    named = {r["cid"]: frozenset(r["colors"]) for r in sets.collect()}
    assert sorted(named) == list(range(len(set(map(frozenset, color.values())))))
    nodes = colors.encode_colors(kc, sets)
    if k == 9:  # k-mers as strings, as beyond 31 bases
        plain = sorted(tuple(r) for r in graph.unitigs(nodes, k).collect())
    if k <= 31:
        nodes = nodes.select(dna.pack("kmer").alias("code"), "cid")
    got = graph.unitigs(nodes, k, piece=7).collect()
    assert k != 9 or sorted(tuple(r) for r in got) == plain
    mine = sorted((sorted(can(r["seq"][i : i + k]) for i in range(r["num_kmers"])), sorted(named[r["cid"]])) for r in got)
    assert mine == sorted((sorted(a), sorted(b)) for a, b in truth)
    assert sum(r["num_kmers"] for r in got) == len(color)


@pytest.mark.parametrize("k,seed", [(32, 5), (41, 7), (63, 9)])
def test_wide_unitigs_match_naive_walk(spark, k, seed):
    r = random.Random(seed)
    half = "".join(r.choices("ACGT", k=k // 2))
    seqs = [*random_seqs(seed), (1, "".join(r.choices("ACGT", k=20)) + half + rc(half) + "".join(r.choices("ACGT", k=20)))]  # a palindrome in the middle
    for n in (k // 2, k, 2 * k, 150):
        loop = "".join(r.choices("ACGT", k=n))
        seqs.append((r.randrange(3), (loop * (2 + 2 * k // n))[: n + k - 1]))
    seqs += [(0, "T" * (k + 3)), (2, "".join(r.choices("ACGT", k=k))), (3, "".join(r.choices("ACGT", k=400))), (None, None)][:-1]
    color, truth = naive(seqs, k)
    df = spark.createDataFrame(seqs, "color int, seq string")
    kc = colors.packed_colors(df, k, 4).cache()
    sets = colors.color_sets(kc).cache()
    named = {r["cid"]: frozenset(r["colors"]) for r in sets.collect()}
    nodes = colors.encode_colors(kc, sets)
    got = sorted(tuple(r) for r in graph.unitigs(nodes, k).collect())
    mine = sorted((sorted(can(seq[i : i + k]) for i in range(n)), sorted(named[cid])) for cid, seq, n in got)
    assert mine == sorted((sorted(a), sorted(b)) for a, b in truth)
    plain = nodes.select(dna.unpack("code", k).alias("kmer"), "cid")
    assert got == sorted(tuple(r) for r in graph.unitigs(plain, k).collect())
    digested, named_sets = colors.digest_colors(df, k, 4)
    assert sorted(r["colors"] for r in named_sets.collect()) == sorted(sorted(x) for x in named.values())
    assert {tuple(r) for r in digested.select(dna.unpack("code", k), "cid").collect()} == {tuple(r) for r in plain.collect()}
    tigs = spark.createDataFrame([t[:2] for t in got], "cid long, seq string")
    assert not any(x["n"] for x in verify.graph_faults(df, tigs, sets, k).collect())
    cut = spark.createDataFrame([t[:2] for t in got[1:]], "cid long, seq string")
    assert {x["fault"]: x["n"] for x in verify.graph_faults(df, cut, sets, k).collect()}["kmer_lost"] == got[0][2]


def test_paths_of_wide_nodes(spark):
    r = random.Random(3)
    names = r.sample([(a, b) for a in (-(1 << 63), -5, 0, 7, 1 << 62) for b in range(60)], 200)
    edges = [*zip(names[:120], names[1:120]), *zip(names[120:], [*names[121:], names[120]])]
    df = spark.createDataFrame(edges, "src struct<hi: long, lo: long>, dst struct<hi: long, lo: long>")
    ring = names[120:]
    start = ring.index(min(ring))
    want = {(x, names[0], i, False) for i, x in enumerate(names[:120])} | {(x, min(ring), i, True) for i, x in enumerate([*ring[start:], *ring[:start]])}
    for in_task in (1000, 30):
        assert {(tuple(x.node), tuple(x.root), x.dist, x.cyclic) for x in rank_paths(df, in_task).collect()} == want


def test_chains_and_circles(spark):
    r = random.Random(2)
    names = r.sample(range(1, 10_000), 400)
    paths, at = [], 0
    for n in (1, 2, 3, 50, 128, 16, 7, 64, 3):
        paths.append((names[at : at + n], n in (16, 3, 64)))
        at += n
    edges = [e for p, ring in paths for e in [*zip(p, p[1:]), *([(p[-1], p[0])] if ring else [])]]
    want = set()
    for p, ring in paths:
        start = p.index(min(p)) if ring else 0
        if len(p) > 1:
            want |= {(x, p[start], i, ring) for i, x in enumerate([*p[start:], *p[:start]])}
    for share in (1.0, 0.7):
        some = [e for e in edges if r.random() < share]
        first, last, w, behind = chains(*(np.array(x) for x in zip(*some)))
        at, walked = 0, []
        for a, b, n in zip(first.tolist(), last.tolist(), w.tolist()):
            way = [a, *behind[at : at + n].tolist()]
            assert way[-1] == b and n > 0
            walked += zip(way, way[1:])
            at += n
        assert sorted(walked) == sorted(some)
    df = spark.createDataFrame(edges, "src long, dst long")
    for in_task in (500_000, 60):
        rounds = []
        got = [tuple(x) for x in rank_paths(df, in_task, rounds=rounds).collect()]
        assert set(got) == want and len(got) == len(want) and rounds[-1] <= in_task
    assert sum(rounds) < 6 * len(edges)
    named = rank_paths(df.selectExpr("lpad(src, 6, '0') AS src", "lpad(dst, 6, '0') AS dst"), 100)
    assert {(int(n), int(r), d, c) for n, r, d, c in named.collect()} == want
    loops = spark.createDataFrame([(7, 7, 1), (1, 2, 4), (2, 3, 5)], "src long, dst long, w long")
    for in_task in (0, 10):
        assert {tuple(x) for x in rank_paths(loops, in_task).collect()} == {(7, 7, 0, True), (1, 1, 0, False), (2, 1, 4, False), (3, 1, 9, False)}
    assert rank_paths(loops.where("src > 9")).collect() == []


def test_even_k_covers_every_kmer_once(spark):
    seqs = [(0, "ACGTACGTTAGCATGCAATTGGCC" * 2), (1, "GGCCAATTGCATGCTAACGTACGT")]
    kc = colors.kmer_colors(spark.createDataFrame(seqs, "color int, seq string"), 6).cache()
    got = graph.unitigs(colors.encode_colors(kc, colors.color_sets(kc)), 6).collect()
    mine = sorted(can(r["seq"][i : i + 6]) for r in got for i in range(r["num_kmers"]))
    assert mine == sorted(r["kmer"] for r in kc.collect())


def test_dna_functions(spark):
    df = spark.createDataFrame([("ACGTTGCA",), ("TTTTTTTT",), ("GATTACAG",)], "x string")
    rows = df.select("x", dna.reverse_complement("x").alias("r"), dna.canonical("x").alias("c"), dna.pack("x").alias("p"), dna.unpack(dna.pack("x"), 8).alias("u"), dna.kmers(F.col("x"), 9).alias("none"), dna.canonical_nthash(F.col("x")).alias("h"), dna.canonical_nthash(dna.reverse_complement("x")).alias("h2")).collect()
    for r in rows:
        assert r["r"] == rc(r["x"]) and r["c"] == can(r["x"]) and r["u"] == r["x"] and r["none"] == [] and r["h"] == r["h2"]
        assert r["p"] == sum("ACGT".index(ch) << 2 * (7 - i) for i, ch in enumerate(r["x"]))
    assert dna.default_minimizer(4) == 2 and dna.default_minimizer(31) == 12 and dna.default_minimizer(13) == 9
    with pytest.raises(ValueError):
        dna.check_k(64)


@pytest.mark.parametrize("k", [1, 2, 7, 31, 32, 47, 63])
def test_packed_kmers_of_a_long_sequence(k):
    r = random.Random(k)
    seq = "".join(r.choice("ACGTacgtACGTacgtN") for _ in range(700)) + "".join(r.choice("ACGT") for _ in range(300))
    want = {}
    for i in range(len(seq) - k + 1):
        x = seq[i : i + k].upper()
        if "N" not in x:
            want[can(x)] = want.get(can(x), 0) + 1
    for piece in (2_000_000, 64):
        got = {}
        for hi, lo, n in packed.counted_kmers(seq.encode(), k, piece):
            for h, x, c in zip(hi.tolist(), lo.tolist(), n.tolist()):
                word = (h << 62 | x) if k > 31 else x
                spelt = "".join("ACGT"[word >> 2 * i & 3] for i in reversed(range(k)))
                got[spelt] = got.get(spelt, 0) + c
        assert got == want


def plain_nthash(x):
    turn = lambda h, n: (h << n | h >> (64 - n)) % (1 << 64) if n else h
    out = 0
    for i, c in enumerate(x):
        out ^= turn(dna.NTHASH_SEEDS[c], len(x) - 1 - i)
    return out


@pytest.mark.parametrize("k,m", [(5, 1), (20, 10), (31, 30), (32, 12), (40, 33), (62, 14)])
def test_rolled_hashes_and_turned_pairs(k, m):
    r = random.Random(k)
    mers = ["".join(r.choices("ACGT", k=k)) for _ in range(50)] + ["A" * k, "T" * k]
    number = lambda x: int("".join(str("ACGT".index(c)) for c in x), 4)
    halves = lambda xs: [np.array([number(x) >> s & (1 << 62) - 1 for x in xs], np.uint64) for s in ((62, 0) if k > 31 else (0,))]
    want = [min(plain_nthash(y) for i in range(k - m + 1) for y in (x[i : i + m], rc(x[i : i + m]))) for x in mers]
    assert packed.least_hashes([x.view(np.int64) for x in halves(mers)], k, m).tolist() == want
    if k > 31:
        assert all((a == b).all() for a, b in zip(packed.turned_pairs(*halves(mers), k), halves([rc(x) for x in mers])))


def test_packed_column_functions(spark):
    xs = ["ACGTTGCAACC", "TTTTTTTTTTT", "GATTACAGATT"]
    df = spark.createDataFrame([(x,) for x in xs], "x string").withColumn("code", dna.pack("x"))
    for r in packed.add_minimizer(df, 11, 4).join(df, "code").collect():
        assert r["minimizer"] == min("".join(str("ACGT".index(c)) for c in can(r["x"][i : i + 4])) and int("".join(str("ACGT".index(c)) for c in can(r["x"][i : i + 4])), 4) for i in range(8))
    for r in df.select("x", dna.unpack(dna.packed_reverse_complement(F.col("code"), 11), 11).alias("r"), dna.base_at(F.col("code"), 3).alias("b")).collect():
        assert r["r"] == rc(r["x"]) and r["b"] == r["x"][-4]
    for r in packed.add_bucket(df, 11, 4, 5).join(df, "code").collect():
        least = min(plain_nthash(x) for i in range(8) for x in (r["x"][i : i + 4], rc(r["x"][i : i + 4])))
        assert r["bucket"] == (least >> 1) % 5
    signed = [r["h"] % (1 << 64) for r in df.select(dna.canonical_nthash(F.col("x")).alias("h"), "x").orderBy("x").collect()]
    assert signed == [min(plain_nthash(x), plain_nthash(rc(x))) for x in sorted(xs)]
    run = "".join(random.Random(1).choice("ACGT") for _ in range(50))
    for r in spark.createDataFrame([(run,)], "run string").select(F.explode(dna.run_pieces(F.col("run"), 9, 10)).alias("p")).select("p.*").collect():
        assert run[r["start"] : r["start"] + 18] == r["piece"]


def plain_delta(x):
    """The code of x + 1 as a string of bits, in the order they are written."""
    n = (x + 1).bit_length()
    m = n.bit_length()
    low = lambda y, bits: "".join(str(y >> i & 1) for i in range(bits))
    return "0" * (m - 1) + "1" + low(n, m - 1) + low(x + 1, n - 1)


def test_codec_matches_plain_bits_and_round_trips():
    r = random.Random(4)
    for n in (1, 4, 20, 101, 3000):
        for size in {0, 1, n // 4, n // 4 + 1, n // 2, 3 * n // 4, n - 1, n}:
            x = sorted(r.sample(range(n), max(0, min(n, size))))
            bits = plain_delta(len(x))
            if int(0.25 * n) <= len(x) < int(0.75 * n):
                bits += "".join("1" if c in x else "0" for c in range(n))
            else:
                kept = x if len(x) < int(0.25 * n) else sorted(set(range(n)) - set(x))
                bits += "".join(plain_delta(b - a - 1) for a, b in zip([-1, *kept], kept))
            code, size_in_bits = codec.encode(x, n)
            assert size_in_bits == len(bits) and "".join(f"{b:08b}"[::-1] for b in code).rstrip("0") == bits.rstrip("0")
            assert codec.decode(code, n).tolist() == x
    far = [0, 5, 2**31 - 1, 2**32 - 2]
    assert codec.decode(codec.encode(far, 2**32 - 1)[0], 2**32 - 1).tolist() == far


@pytest.mark.parametrize("k,m", [(9, 4), (31, 12), (5, 4), (40, 13)])
def test_super_kmers(spark, k, m):
    r = random.Random(k)
    runs = ["".join(r.choice("ACGT") for _ in range(n)) for n in (k - 1, k, k + 1, 300)] + ["A" * 60, None, ""]
    df = spark.createDataFrame(list(enumerate(runs)), "run int, run_seq string")
    got = packed.super_kmers(df, k, m, 7).collect()
    least = lambda x: min(plain_nthash(y) for i in range(len(x) - m + 1) for y in (x[i : i + m], rc(x[i : i + m])))
    owned, held = {}, set()
    for s in got:
        x = runs[s["run"]]
        assert x[s["start"] : s["start"] + len(s["seq"])] == s["seq"]
        n = len(s["seq"]) - k + 1
        for i in range(n):
            held.add((s["run"], s["start"] + i, s["bucket"]))
            if (i > 0 or s["owns_first"]) and (i < n - 1 or s["owns_last"]):
                owned[s["run"], s["start"] + i] = owned.get((s["run"], s["start"] + i), 0) + 1
    every = {(i, at) for i, x in enumerate(runs) if x for at in range(len(x) - k + 1)}
    assert owned == dict.fromkeys(every, 1)
    assert held == {(i, at, (least(y) >> 1) % 7) for i, at in every for y in (runs[i][at : at + k - 1], runs[i][at + 1 : at + k])}
    assert sum(s["is_begin"] for s in got) == sum(s["is_end"] for s in got) == len({i for i, _ in every})
    assert packed.super_kmers(df.limit(0), k, m, 7).count() == 0
    with pytest.raises(ValueError):
        packed.super_kmers(df, k, k, 7)


def test_files_to_artifacts(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one\nACGTACGGTTCA\nGGATTNACCAGGTTACA\n>two\r\nacgtaggcatt\r\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">x\nACGTACGGTTCAGGATT\n")
    with gzip.open(tmp_path / "c.fastq.gz", "wt") as f:
        f.write("@r1\nACGTACGGTTCAGG\n+\n@@@@IIIIIIIIII\n@r2\nTTACCAGGTTACA\n+r2\nIIIIIIIIIIIII\n")
    (tmp_path / "files.txt").write_text(f"{tmp_path}/a.fasta\n\n{tmp_path}/b.fa.gz\n{tmp_path}/c.fastq.gz\n{tmp_path}/missing.fa\n")
    m = sequences.read_manifest(spark, str(tmp_path / "files.txt"))
    with pytest.raises(FileNotFoundError):
        sequences.read_sequences(spark, m)
    got = sorted((r["color"], r["seq"].upper()) for r in sequences.read_sequences(spark, m, permissive=True).collect())
    assert got == [(0, "ACGTACGGTTCAGGATTNACCAGGTTACA"), (0, "ACGTAGGCATT"), (1, "ACGTACGGTTCAGGATT"), (2, "ACGTACGGTTCAGG"), (2, "TTACCAGGTTACA")]
    g = build(spark, str(tmp_path / "files.txt"), BuildConfig(k=7, permissive=True))
    base = str(tmp_path / "out")
    assert (g.num_colors, g.num_kmers) == (4, sum(r["num_kmers"] for r in g.unitigs.collect())) and g.num_unitigs > 0 < g.num_color_sets
    g.write(base)
    color, truth = naive([(c, s) for c, s in got], 7)
    meta = artifacts.read_metadata(spark, f"{base}.metadata")
    assert meta == {"k": 7, "num_kmers": len(color), "num_colors": 4, "num_unitigs": len(truth), "num_color_sets": len({frozenset(x) for x in color.values()})}
    sets = artifacts.read_color_sets(spark, base).collect()
    assert {frozenset(r["color_set"]) for r in sets} == {frozenset(x) for x in color.values()}
    stored = open_graph(spark, base)
    assert (stored.num_kmers, stored.k) == (g.num_kmers, 7) and g.config.k == 7
    assert stored.color_sets([1]).collect() == [r for r in sets if r["color_set_id"] == 1] and stored.color_sets().count() == len(sets)
    assert sorted(map(tuple, stored.unitigs([0]).collect())) == sorted(tuple(r) for r in g.unitigs.collect() if r["cid"] == 0)
    assert list(g.phases) == ["kmer-colors", "color-sets", "nodes", "unitigs"] and g.phases["unitigs"][1] == g.num_unitigs
    again = build(spark, str(tmp_path / "files.txt"), BuildConfig(k=7, permissive=True, m=2))
    assert sorted(map(tuple, again.unitigs.collect())) == sorted(map(tuple, g.unitigs.collect()))
    for bad in ({"k": 1}, {"k": 64}, {"k": 7, "m": 8}, {"k": 7, "m": 1}, {"permissive": "yes"}):
        with pytest.raises(ValueError):
            BuildConfig(**bad)
    spans = sorted((r["unitig_start"], r["unitig_start"] + r["num_unitigs"]) for r in sets)
    assert spans[0][0] == 0 and spans[-1][1] == len(truth) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert spark.read.parquet(f"{base}.unitigs").where("run_end").count() == len(sets)
    assert spark.read.text(f"{base}.fa").count() == 2 * len(truth)


def test_formats_and_names_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "x.seq").write_text("@r1\nACGT\n+\nIIII\n@r2\r\nGGCC\r\n+\r\n@ACG\r\n")  # FASTQ by its content
    (tmp_path / "a" / "x.seq").write_text(">r\nTTTT\n")  # a path that ends like the other
    (tmp_path / "b c+d%20.fa").write_text("\n>r\nAAAA\n")
    (tmp_path / "empty.fa").write_text("")
    names = ["x.seq", "a/x.seq", "b c+d%20.fa", "empty.fa", "x.seq"]
    (tmp_path / "files.txt").write_text("\n".join(f"{tmp_path}/{x}" for x in names))
    got = sequences.read_sequences(spark, sequences.read_manifest(spark, str(tmp_path / "files.txt"))).collect()
    assert sorted(map(tuple, got)) == [(0, "ACGT"), (0, "GGCC"), (1, "TTTT"), (2, "AAAA"), (4, "ACGT"), (4, "GGCC")]


def blocked(text):
    """Block gzip: members with their size in a field."""
    out = b""
    for i in [*range(0, len(text), 50), None]:
        part = b"" if i is None else text[i : i + 50]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + (6).to_bytes(2, "little") + b"BC" + (2).to_bytes(2, "little") + (len(body) + 25).to_bytes(2, "little") + body
        out += zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")
    return out


def test_names_and_forms_of_sequence_files(spark, tmp_path):
    fasta = lambda s: f">x {s}\n{s[:3]}\n{s[3:]}\r\n".encode()
    packed = gzip.compress(fasta("AACCGGTT")) + gzip.compress(b">second member\nGATTACA\n")
    forms = {
        "_g.fa": (fasta("ACGTAAAA"), ["ACGTAAAA"]), ".x.fa": (fasta("CCCCACGT"), ["CCCCACGT"]), "a[1].fa": (fasta("GGGGGACG"), ["GGGGGACG"]), "b*.fa": (fasta("TTTTACCC"), ["TTTTACCC"]),
        "b2.fa": (fasta("TTTTAGGG"), ["TTTTAGGG"]), "zipped": (packed, ["AACCGGTT", "GATTACA"]), "plain.gz": (fasta("ACACACAC"), ["ACACACAC"]), "a b%20+ü.fa": (fasta("TGTGTGTG"), ["TGTGTGTG"]),
        "blocks.fa": (blocked(fasta("ACGTACGTAC") * 5), ["ACGTACGTAC"] * 5), "empty": (b"", []), "trailing.gz": (gzip.compress(fasta("AAAACCCC")) + b"\0\0rest", ["AAAACCCC"]),
        "reads": (b"junk @r1\nACGT\nGG\n+r1\n@>+@\n>+\n@r2\nTTT\n+\n+++\n>r3\nAC GT\n", ["ACGTGG", "TTT", "AC GT"]), "_SUCCESS": (b"@q\nACG\n+\n@@@", ["ACG"]),
    }
    for name, (data, _) in forms.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "files.txt").write_text("\n".join(str(tmp_path / n) for n in forms))
    m = sequences.read_manifest(spark, str(tmp_path / "files.txt"))
    got = sorted(tuple(r) for r in sequences.read_sequences(spark, m).collect())
    assert got == sorted((i, s) for i, (_, seqs) in enumerate(forms.values()) for s in seqs)
    uri = spark.createDataFrame([(3, f"file://{tmp_path}/_g.fa")], "color int, path string")
    assert [tuple(r) for r in sequences.read_sequences(spark, uri).collect()] == [(3, "ACGTAAAA")]
    (tmp_path / "cut.gz").write_bytes(gzip.compress(fasta("ACGT" * 500))[:30])
    with pytest.raises(Exception, match="no end"):
        sequences.read_sequences(spark, spark.createDataFrame([(0, str(tmp_path / "cut.gz"))], "color int, path string")).collect()


@pytest.mark.parametrize("zipped", [False, True])
def test_split_files_give_each_record_once(tmp_path, zipped):
    r = random.Random(6)
    want, text = [], b""
    for i in range(60):
        s = "".join(r.choices("ACGTN", k=r.choice([0, 1, 5, 60, 700])))
        want.append(s.encode())
        text += f">{i} >not\n".encode() + b"".join(s[j : j + 20].encode() + b"\n" for j in range(0, len(s), 20))
    (tmp_path / "x").write_bytes(blocked(text) if zipped else text)
    for split in (1, 7, 64, 400, 5000):
        tasks = sequences.plan(sequences.sized([(0, str(tmp_path / "x"))], False), split)
        assert len(tasks) > 1
        got = [s for t in tasks for b in sequences.batches(t) for s in b.column(1).to_pylist()]
        assert [s.encode() for s in got] == want


def test_stream_of_arriving_files(spark, tmp_path):
    manifest, out = tmp_path / "files.txt", []

    def run():
        q = sequences.stream_sequences(spark, str(manifest)).writeStream.foreachBatch(lambda b, _: out.extend(tuple(r) for r in b.collect()))
        q.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    for i, s in enumerate(["ACGT", "GGCC", "TTAA"]):
        (tmp_path / f"_{i}").write_text(f">r\n{s}\n")
    manifest.write_text(f"{tmp_path}/_0\n\n{tmp_path}/_1\n")
    run()
    assert sorted(out) == [(0, "ACGT"), (1, "GGCC")]
    manifest.write_text(f"{tmp_path}/_0\n\n{tmp_path}/_1\n{tmp_path}/_2\n")
    run()
    assert sorted(out) == [(0, "ACGT"), (1, "GGCC"), (2, "TTAA")]


@pytest.mark.parametrize(("k", "m", "buckets"), [(7, 3, 5), (8, 2, 3), (11, 4, 1)])
def test_fragments_stitch_to_the_unitigs(spark, k, m, buckets):
    r = random.Random(k)
    draw = lambda n: "".join(r.choices("ACGT", k=n))
    rows = []
    for n in (9, 20, 40, 90, 200):  # circles, of one color and with arcs of another
        s = draw(n)
        rows += [(0, s + s[: k - 1])] + ([(3, (s * 2)[n // 2 : n // 2 + k + 6])] if n > 20 else [])
    base = [draw(60) for _ in range(8)]
    rows += [(r.randrange(4), r.choice(base)[r.randrange(20) :] + r.choice(base)[: r.randrange(60)]) for _ in range(30)]
    rows += [(1, rc(rows[-1][1])), (2, "A" * 40), (2, "ACGTNACG"), (5, None), (1, "AC" * 20)]
    seqs = spark.createDataFrame(rows, "color int, seq string")
    got, sets = fragments.fragment_unitigs(seqs, k, m, buckets)
    kc = colors.packed_colors(seqs, k).cache()
    want_sets = colors.color_sets(kc)
    want = graph.unitigs(colors.encode_colors(kc, want_sets), k)
    assert sorted(tuple(x) for x in sets.collect()) == sorted(tuple(x) for x in want_sets.collect())
    named = {c: tuple(s) for c, s in sets.collect()}
    show = lambda df: sorted((x["seq"], named[x["cid"]], x["num_kmers"]) for x in df.select("seq", "cid", "num_kmers").collect())
    assert show(got) == show(want)


def test_damaged_graphs_are_found_out(spark):
    r = random.Random(12)
    base = "".join(r.choices("ACGT", k=120))
    seqs = spark.createDataFrame([(0, base), (1, base[30:90]), (1, rc(base[:50])), (0, base[40:70] + "A" * 15), (2, base[90:] + "ACG"), (2, (x := "GATTACCAGT") + x)], "color int, seq string")
    k = 9
    kc = colors.packed_colors(seqs, k).cache()
    sets = colors.color_sets(kc).cache()
    tigs = graph.unitigs(colors.encode_colors(kc, sets), k).select("cid", "seq").collect()
    long = max(tigs, key=lambda t: len(t["seq"]))
    rest = [t for t in tigs if t != long]
    halves = [(long["cid"], long["seq"][:15]), (long["cid"], long["seq"][15 - k + 1 :])]
    other = next(t for t in tigs if t["cid"] != long["cid"])
    cases = {
        "": tigs, "kmer_lost": rest, "kmer_repeated": [*tigs, long], "kmer_strange": [*tigs, (long["cid"], "CCCCCCCCC")], "path_stops": [*rest, *halves],
        "path_runs_on": [*[t for t in tigs if t != other], (other["cid"], other["seq"] + "T")],
    }
    for fault, rows in cases.items():
        got = {x["fault"]: x["n"] for x in verify.graph_faults(seqs, spark.createDataFrame(rows, "cid long, seq string"), sets, k).collect()}
        assert set(got) == set(verify.FAULTS) and (got[fault] > 0 if fault else not any(got.values())), (fault, got)
    twice = sets.union(spark.createDataFrame([(99, sets.first()["colors"])], "cid long, colors array<int>"))
    got = {x["fault"]: x["n"] for x in verify.graph_faults(seqs, spark.createDataFrame(tigs, "cid long, seq string"), twice, k).collect()}
    assert got["set_repeated"] == 1 and got["set_unused"] == 1


def test_rings_begin_where_their_color_changes():
    assert list(stretches([{"seq": "ACGGTACG", "runs": [{"cid": 4, "num_kmers": 1}, {"cid": 5, "num_kmers": 3}, {"cid": 4, "num_kmers": 1}]}], 4, True)) == [("CCGTA", 4, 2), ("CGGTAC", 5, 3)]


def test_color_sets_of_many_colors(spark):
    r = random.Random(9)
    base = ["".join(r.choices("ACGT", k=30)) for _ in range(12)]
    rows = [(c, base[j]) for j in range(12) for c in r.sample(range(5000), r.choice([1, 3, 40, 700]))] + [(c, base[0]) for c in range(5000)]
    seqs = spark.createDataFrame(rows, "color int, seq string").repartition(4)
    held = {}
    for c, s in rows:
        for i in range(30 - 11 + 1):
            held.setdefault(can(s[i : i + 11]), set()).add(c)
    kmers, sets = colors.digest_colors(seqs, 11, 5000)
    of = {x["cid"]: x["colors"] for x in sets.collect()}
    assert [of[i] for i in range(len(of))] == [list(x) for x in sorted({tuple(sorted(v)) for v in held.values()})]
    assert {x["kmer"]: of[x["cid"]] for x in kmers.select(dna.unpack("code", 11).alias("kmer"), "cid").collect()} == {x: sorted(v) for x, v in held.items()}
    for bad in (None, -1, 20):
        with pytest.raises(Exception, match="is not one of"):
            colors.packed_colors(spark.createDataFrame([(bad, base[0])], "color int, seq string"), 11, 20).collect()


def test_an_end_joins_once(spark):
    k, r = 7, random.Random(3)
    join = "ACCTGAT"
    own = ["".join(r.choice("ACGT") for _ in range(20)) for _ in range(4)]
    rows = [(0, own[0] + join, [(1, 21)], False, True), (1, own[1] + join, [(1, 21)], False, True), (2, rc(join + own[2]), [(1, 21)], False, True), (3, own[3] + join, [(1, 21)], False, False)]
    df = spark.createDataFrame(rows, "frag_id long, seq string, runs array<struct<cid:bigint,num_kmers:int>>, open_left boolean, open_right boolean")
    got = {x["seq"] for x in stitch(df, k).collect()}
    assert got == {can(own[0] + join + own[2]), can(own[1] + join), can(own[3] + join)}


def test_shared_kmers_keep_the_color_that_is_known(spark):
    k, a = 5, "ACGGTTCATGCAAGGT"
    runs = lambda *x: [{"cid": c, "num_kmers": n} for c, n in x]
    rows = [(0, a[:8], runs((4, 3), (-1, 1)), False, True), (1, a[3:12], runs((5, 1), (4, 4)), True, True), (2, a[7:], runs((-1, 1), (6, 4)), True, False)]
    df = spark.createDataFrame(rows, "frag_id long, seq string, runs array<struct<cid:bigint,num_kmers:int>>, open_left boolean, open_right boolean")
    assert sorted((x["cid"], x["num_kmers"], x["seq"]) for x in stitch(df, k).collect()) == sorted([(4, 3, can(a[:7])), (5, 1, can(a[3:8])), (4, 4, can(a[4:12])), (6, 4, can(a[8:]))])


def test_stretches_of_many_colors():
    k, r = 5, random.Random(9)
    whole = "".join(r.choice("ACGT") for _ in range(400))
    of = [r.choice([1, 1, 1, 2, 3]) for _ in range(400 - k + 1)]
    cuts = [0, *sorted(r.sample(range(1, len(of) - 1), 60)), len(of) - 1]
    for knows in (0, 1):  # the earlier or the later piece knows the shared k-mer
        pieces = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            cids = of[a : b + 1]
            if knows and i < len(cuts) - 2:
                cids[-1] = -1
            if not knows and i:
                cids[0] = -1
            pieces.append({"seq": whole[a : b + k], "runs": [{"cid": c, "num_kmers": 1} for c in cids]})
        got, at = list(stretches(pieces, k)), 0
        for seq, cid, n in got:
            assert of[at : at + n] == [cid] * n and seq == can(whole[at : at + n + k - 1])
            at += n
        assert at == len(of) and all(a[1] != b[1] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("k", [9, 31])
def test_stitch_rebuilds_unitigs(spark, k):
    r, fragments, truth = random.Random(5), [], []
    for cid in range(30):
        size = r.choice([k, k + 3, 90, 200])
        seq = "".join(r.choice("ACGT") for _ in range(size))
        truth.append((can(seq), cid, size - k + 1))
        cuts = sorted(r.sample(range(1, size - k + 1), min(r.randint(0, 5), max(0, size - k)))) if size > k + 1 else []
        starts, stops = [0, *cuts], [*[c + k for c in cuts], size]  # neighbours share k bases
        for i, (a, b) in enumerate(zip(starts, stops)):
            if b - a <= k and len(starts) > 1:
                b = a + k
            s, left, right = seq[a:b], i > 0, i < len(starts) - 1
            if r.random() < 0.5:
                s, left, right = rc(s), right, left
            fragments.append((len(fragments), s, [(cid, len(s) - k + 1)], left, right))
    df = spark.createDataFrame(fragments, "frag_id long, seq string, runs array<struct<cid:bigint,num_kmers:int>>, open_left boolean, open_right boolean")
    got = sorted((x["seq"], x["cid"], x["num_kmers"]) for x in stitch(df, k).collect())
    assert got == sorted(truth)


def test_stream_ingest_matches_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    seqs = random_seqs(6)
    for i in range(3):
        spark.createDataFrame(seqs[i::3], "color int, seq string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("color int, seq string").option("maxFilesPerTrigger", 1).parquet(src)
    ingest.ingest(stream, 9, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = {r["kmer"]: set(r["colors"]) for r in ingest.ingested(spark, str(tmp_path / "t")).collect()}
    assert got == naive(seqs, 9)[0]
