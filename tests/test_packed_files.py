"""Succinct structures and packed files against plain lists, by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hueweave.functions.succinct import BitVector, Monotone
from hueweave.operators.ranking import number_rows
from hueweave.plans.build import BuildConfig, build_graph, open_graph
from hueweave.sources import packed_files
from hueweave.sources.packed_files import ColorSetFiles, RunEndFiles, write_color_sets, write_run_ends


def at(data):
    return lambda i, n: data[i : i + n]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("share", [0, 0.01, 0.5, 1])
def test_rank_and_select(n, share):
    r = random.Random(n)
    bits = np.array([r.random() < share for _ in range(n)], bool)
    data = BitVector.pack(bits)
    v = BitVector(at(data), n)
    assert v.size == len(data) and [v.rank(i) for i in range(n + 1)] == np.cumsum([0, *bits]).tolist()
    assert [v.select(j) for j in range(int(bits.sum()))] == np.flatnonzero(bits).tolist()
    for bad in (lambda: v.rank(n + 1), lambda: v.select(int(bits.sum())), lambda: v.rank(-1), lambda: v.select(-1)):
        with pytest.raises(IndexError):
            bad()


@pytest.mark.parametrize("n", [0, 1, 2, 600, 70_000])
@pytest.mark.parametrize("most", [0, 1, 1000, 1 << 45])
def test_ascending_numbers(n, most):
    r = random.Random(n + most)
    x = sorted(r.randint(0, most) for _ in range(n))
    data = b"ahead" + Monotone.pack(np.array(x, np.int64))
    m = Monotone(at(data), 5)
    assert m.all().tolist() == x and [m[i] for i in range(0, n, max(1, n // 500))] == x[:: max(1, n // 500)]
    if n > 1 and most > n:  # two bits a number, its low bits, the directory and the head
        assert 8 * len(data) <= n * (2 + np.log2(most / n) + 1) + 64 * (3 * n / 512 + 20)
    with pytest.raises(IndexError):
        m[n]


@pytest.mark.parametrize("most", [1 << 21, 5])
def test_color_sets_in_place(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(packed_files.ColorSetWriter, "most", most)
    r = random.Random(3)
    sets = [sorted(r.sample(range(300), r.choice([0, 1, 2, 40, 75, 150, 225, 299, 300]))) for _ in range(700)]
    rows = spark.createDataFrame(list(enumerate(sets)), "cid long, colors array<int>").repartition(5)
    path = str(tmp_path / "[sets]*")
    write_color_sets(rows, 300, path)
    load = lambda **o: {x["cid"]: x["colors"] for x in spark.read.format("packed_color_sets").options(path=path, **o).load().collect()}
    assert load() == dict(enumerate(sets))
    assert load(cids="[3, 699, 3, 900]") == {3: sets[3], 699: sets[699]} and load(cids="[]") == {}
    files = ColorSetFiles(path)
    assert [files.colors(i).tolist() for i in range(700)] == sets
    for bad in (-1, 700):
        with pytest.raises(IndexError):
            files.colors(bad)
    if most > 5:
        files = ColorSetFiles(path)
        one = next(i for i, x in enumerate(sets) if len(x) == 150)
        files.colors(one)
        assert files.read < 1500  # its own code has about 40 bytes, the rest is search in the offsets
        with pytest.raises(Exception, match="has an index"):
            write_color_sets(rows, 300, path)
        with pytest.raises(Exception, match="not dense|do not follow"):
            write_color_sets(rows.where("cid <> 300"), 300, str(tmp_path / "gap"))


@pytest.mark.parametrize("most", [1 << 30, 1024, 7])
def test_run_ends_in_place(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(packed_files.RunEndWriter, "most", most)
    r = random.Random(5)
    sizes = [r.choice([1, 1, 1, 2, 30, 2000]) for _ in range(150)]
    ends = np.cumsum(sizes)
    bits = np.zeros(ends[-1], bool)
    bits[ends - 1] = True
    rows = spark.createDataFrame([(i, bool(x)) for i, x in enumerate(bits)], "unitig_id long, run_end boolean").repartition(3)
    path = f"file://{tmp_path}/ends"
    write_run_ends(rows, path)
    got = sorted(map(tuple, spark.read.format("run_ends").option("path", path).load().collect()))
    assert got == [(i, int(e) - n, n) for i, (e, n) in enumerate(zip(ends, sizes))]
    files = RunEndFiles(path)
    assert all(files.unitigs(i) == range(int(e) - n, int(e)) for i, (e, n) in enumerate(zip(ends, sizes)))
    for i in [0, int(ends[-1]) - 1, *r.sample(range(int(ends[-1])), 100)]:
        assert files.cid(i) == int(np.searchsorted(ends, i, "right"))
    for bad in (lambda: files.unitigs(150), lambda: files.unitigs(-1), lambda: files.cid(int(ends[-1])), lambda: files.cid(-1)):
        with pytest.raises(IndexError):
            bad()


def test_nothing_to_pack(spark, tmp_path):
    write_run_ends(spark.createDataFrame([], "unitig_id long, run_end boolean"), str(tmp_path / "e"))
    write_color_sets(spark.createDataFrame([], "cid long, colors array<int>"), 4, str(tmp_path / "s"))
    assert spark.read.format("run_ends").option("path", str(tmp_path / "e")).load().count() == 0
    assert spark.read.format("packed_color_sets").option("path", str(tmp_path / "s")).load().count() == 0


def test_last_rows_of_runs(spark):
    r = random.Random(2)
    rows = [(r.choice([0, 0, 0, 1, 5, 6, 7]), i) for i in range(400)]
    got = number_rows(spark.createDataFrame(rows, "a int, b int"), "id", ["a", "b"], "end").orderBy("id").collect()
    truth = sorted(rows)
    assert [(x["a"], x["b"]) for x in got] == truth and [x["id"] for x in got] == list(range(400))
    assert [x["end"] for x in got] == [i == 399 or truth[i + 1][0] != truth[i][0] for i in range(400)]


def test_a_stored_graph_gives_single_sets(spark, tmp_path):
    r = random.Random(8)
    base = ["".join(r.choices("ACGT", k=60)) for _ in range(6)]
    seqs = spark.createDataFrame([(c, base[j]) for j in range(6) for c in r.sample(range(9), 3)], "color int, seq string")
    g = build_graph(seqs, 9, BuildConfig(k=9))
    g.write(str(tmp_path / "g"), packed=True)
    stored = open_graph(spark, str(tmp_path / "g"))
    sets, ends = stored.packed()
    for x in stored.color_sets().collect():
        assert sets.colors(x["color_set_id"]).tolist() == x["color_set"] and ends.unitigs(x["color_set_id"]) == range(x["unitig_start"], x["unitig_start"] + x["num_unitigs"])
    some = stored.unitigs().agg(F.collect_list(F.struct("unitig_id", "cid")).alias("x")).first()["x"]
    assert all(ends.cid(x["unitig_id"]) == x["cid"] for x in some)
