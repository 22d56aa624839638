"""SimHash near-duplicates: fingerprints, Burkhard-Keller trees over shards, components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hueweave.operators.components import connected_components
from hueweave.runtime import broadcast_if_small, discard, materialize

BITS = 64


def fingerprint(text: bytes, width: int = 4) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats included; 0 without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[width - 1 :].tolist() if len(words) >= width else [len(line)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), b"")
            fp = np.fromiter((fingerprint(x.as_py(), width) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class Trees:
    """Burkhard-Keller trees over shards of distinct fingerprints, in arrays.

    Rows come sorted by shard; a shard's first row is its root. A row goes down from the root
    along the edge that is its distance to the node, and stops where no child is; all rows
    take one step at a time. A child comes after its parent in row order.
    """

    def __init__(self, fp: np.ndarray, root: np.ndarray):
        self.fp, self.root = fp, root
        keys, kids = [], []
        active = np.flatnonzero(np.arange(len(fp)) != root)
        at = root[active]
        while len(active):
            key = at * (BITS + 1) + np.bitwise_count(fp[active] ^ fp[at])
            slots, first, back = np.unique(key, return_index=True, return_inverse=True)
            child = active[first]
            keys.append(slots)
            kids.append(child)
            at = child[back]
            on = at != active
            active, at = active[on], at[on]
        key, kid = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, kids))
        order = np.argsort(key, kind="stable")
        self.key, self.kid = key[order], kid[order]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, earlier row of its shard) within the radius: only edges within the radius of a node's distance are followed."""
        q, at = queries, self.root[queries]
        left, right = [], []
        while len(q):
            on = at < q  # whatever stands below a later row is later too
            q, at = q[on], at[on]
            d = np.bitwise_count(self.fp[q] ^ self.fp[at]).astype(np.int64)
            hit = d <= radius
            left.append(q[hit])
            right.append(at[hit])
            base = at * (BITS + 1)
            lo = np.searchsorted(self.key, base + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, base + np.minimum(d + radius, BITS), side="right") - lo
            q = np.repeat(q, n)
            at = self.kid[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        return (np.concatenate(left), np.concatenate(right)) if left else (queries[:0], queries[:0])


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a and b in place; a set's label is its least row."""
    while len(a):
        x, y = label[a], label[b]
        on = x != y
        a, b, x, y = a[on], b[on], x[on], y[on]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def shard_links(fp: np.ndarray, shard: np.ndarray, radius: int, pairs: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected within each shard (rows sorted by shard): (fingerprint, least linked row's fingerprint)."""
    new = np.concatenate([[True], shard[1:] != shard[:-1]])
    root = np.flatnonzero(new)[np.cumsum(new) - 1]
    trees, label = Trees(fp, root), np.arange(len(fp))
    cost = np.cumsum(np.arange(len(fp)) - root + 1)  # a query meets the earlier rows of its shard at most
    start = 0
    while start < len(fp):
        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + pairs, side="right")))
        union(label, *trees.near(np.arange(start, stop), radius))
        start = stop
    on = np.flatnonzero(label != np.arange(len(fp)))
    return fp[on], fp[label[on]]


def _blocks(fp: Column, width: int, count: int) -> list[Column]:
    """The ``count`` nearly equal bit blocks of the low ``width`` bits."""
    cuts = [round(i * width / count) for i in range(count + 1)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _rest(fp: Column, width: int, count: int, i: int) -> tuple[Column, int]:
    """The bits outside block i, closed up."""
    a, b = round(i * width / count), round((i + 1) * width / count)
    low = fp.bitwiseAND(F.lit((1 << a) - 1).cast("long"))
    high = F.shiftleft(F.shiftrightunsigned(fp, b), a) if b < width else F.lit(0).cast("long")
    return high.bitwiseOR(low), width - (b - a)


def links(distinct: DataFrame, radius: int = 4, split: int = 1024, per_task: int = 200_000) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) that connect all within ``radius`` bits.

    Two such fingerprints agree in one of radius+1 bit blocks, so each goes to one shard for
    each block, and each shard has its own tree. A shard of over ``split`` fingerprints is
    split again in the same way over its remaining bits, which loses no link. Shards
    that share a task are bounded by the shuffle, not broadcast: their number grows with the corpus.
    """
    k = radius + 1
    fp = F.col("fp")
    sub = []
    for i, x in enumerate(_blocks(fp, BITS, k)):
        rest, width = _rest(fp, BITS, k, i)
        sub.append(F.struct(F.xxhash64(F.lit(i), x).alias("shard"), F.array(*[F.xxhash64(F.lit(i), x, F.lit(j), y) for j, y in enumerate(_blocks(rest, width, k))]).alias("finer")))
    keyed = distinct.select("fp", F.explode(F.array(*sub)).alias("x")).select("fp", "x.shard", "x.finer")
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keyed.join(sizes, "shard").select("fp", F.explode(F.when(F.col("n") > split, F.col("finer")).otherwise(F.array("shard"))).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, shards, held = [], [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal fps, shards, held
            fp, shard = np.concatenate(fps), np.concatenate(shards)
            stop = len(fp) if last else int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            if stop:
                a, b = shard_links(fp[:stop].view(np.uint64), shard[:stop], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            fps, shards, held = [fp[stop:]], [shard[stop:]], len(fp) - stop

        for batch in batches:
            if batch.num_rows:
                fps.append(batch.column(0).to_numpy())
                shards.append(batch.column(1).to_numpy())
                held += batch.num_rows
                if held >= per_task:
                    yield from flush(False)
        if held:
            yield from flush(True)

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest doc_id reachable. Copies share a fingerprint, and only distinct fingerprints enter
    the trees, so a group of copies of any size costs one entry. Null and empty texts have
    fingerprint zero and are linked like any other; null doc_ids are kept and never the
    smallest; repeated rows come back each; an empty table gives an empty table.
    """
    fps = materialize(fingerprints(docs, width), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = materialize(least, "simhash-classes")
    found = connected_components(materialize(links(classes.select("fp"), radius).distinct(), "simhash-links"))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    rooted = materialize(rooted, "simhash-rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-smallest")  # two scans join, so a large component's rows can be split over tasks
    member = materialize(rooted.join(smallest, "root").select(F.col("fp").alias("f"), "component_id"), "simhash-members")
    out = fps.join(member, fps.fp == member.f)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicates by shingle sets: postings of rare shingles as shards, trees of wider fingerprints, exact check.

WIDE = 128


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct XXH64 keys of the lower-cased (A-Z) text's word shingles (fewer words: the whole sequence; none: no key)."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[width - 1 :].tolist() if len(words) >= width else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def wide_fingerprint(keys: np.ndarray) -> np.ndarray:
    """SimHash of a set of keys in WIDE bits, as two unsigned longs: the keys themselves and a remixing of them."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(keys), 1 << 15):
        h = keys[at : at + (1 << 15)]
        again = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        again = (again ^ (again >> np.uint64(27))) * np.uint64(0xBF58476D1CE4E5B9)
        both = np.stack([h, again ^ (again >> np.uint64(31))], axis=1)
        ones += np.unpackbits(both.astype("<u8").view(np.uint8).reshape(-1, WIDE // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(keys), bitorder="little").view("<u8")


def bitmap(keys: np.ndarray) -> bytes:
    """A bit for each shingle at its hash, of a power of two of 2 to 4 times as many bits (64 at least)."""
    bits = np.zeros(1 << max(6, int(2 * len(keys) - 1).bit_length()), np.uint8)
    bits[(keys & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(a: bytes, b: bytes, na: int, nb: int) -> int:
    """An upper bound of the shingles that two sets of na and nb share: those whose bits both bitmaps hold, and those that share a bit with another."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    both = int(np.bitwise_count(x & y).sum())
    return both + min(na - int(np.bitwise_count(x).sum()), nb - int(np.bitwise_count(y).sum()))


def common_shingles(docs: DataFrame, width: int, share: int = 32, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` commonest shingles of one row in ``share``, ascending, and how many of these rows hold each (3 at least).

    They only order shingles, rare ones first: what is not among them costs time, not results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in pc.fill_null(b.column(0), b""):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py(), width).view(np.int64))], ["shingle"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("text").distinct()
    counted = some.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 2")
    top = counted.orderBy(F.desc("count"), "shingle").limit(most).toArrow()
    shingle, count = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(shingle)
    return shingle[order], count[order]


def prefix(keys: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The set's first shingles, rare ones first: two sets of similarity ``least`` or more have one of these in common.

    They share at least ceil(least * n) of each one's n shingles, so not all of the n - ceil(least * n) + 1 first are unshared.
    """
    shingle, count = common
    seen = np.zeros(len(keys), np.int64)
    if len(shingle):
        at = np.minimum(np.searchsorted(shingle, keys), len(shingle) - 1)
        seen = np.where(shingle[at] == keys, count[at], 0)
    return keys[np.lexsort((keys, seen))][: len(keys) - int(np.ceil(least * len(keys) - 1e-9)) + 1]


def profiles(docs: DataFrame, width: int, least: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h0, h1, doc_id, key, n, f0, f1, bits, prefix) of rows (h0, h1, doc_id, text): a 128-bit key of the words, and the shingle set's size, fingerprint, bitmap and prefix."""
    import xxhash

    names = ["h0", "h1", "doc_id", "key", "n", "f0", "f1", "bits", "prefix"]
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                fp, key, n, held, first = np.zeros((b.num_rows, 2), np.uint64), [], [], [], []
                for i, x in enumerate(pc.fill_null(b.column(3), b"")):
                    text = x.as_py()
                    keys = shingle_set(text, width)
                    fp[i] = wide_fingerprint(keys)
                    key.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())))
                    n.append(len(keys))
                    held.append(bitmap(keys))
                    first.append(prefix(keys, shared.value, least).view(np.int64))
                fp = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(held, pa.binary()), pa.array(first, pa.list_(pa.int64()))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("h0", "h1", "doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"h0 long, h1 long, doc_id {kind}, key binary, n long, f0 long, f1 long, bits binary, prefix array<long>")


def shared_postings(classes: DataFrame, least: float, often: list[int]) -> DataFrame:
    """(node, n, at, shingle, many) of the prefix shingles that can connect two classes; ``many`` is their number of rows.

    Of a pair of similarity ``least``, the smaller set's first common shingle stands among its first
    n - ceil(2 * least / (1 + least) * n) + 1; a shingle that stands so early in no set, or in one set
    only, connects nothing. Shingles listed in ``often`` are known to be shared, so their rows, which
    may be a good part of all, are not brought together for that.
    """
    early = F.col("at") <= F.col("n") - F.ceil(F.lit(2 * least / (1 + least)) * F.col("n") - 1e-9)
    rows = classes.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))
    every = W.partitionBy("shingle")
    frequent = F.col("shingle").isin(often) if often else F.lit(False)
    rare = rows.where(~frequent).withColumns({"many": F.count("*").over(every), "early": F.max(early).over(every)})
    out = rare.where("many > 1 and early").drop("early")
    if often:
        hot = rows.where(frequent)
        sizes = hot.groupBy("shingle").agg(F.count("*").alias("many"))
        out = out.unionByName(hot.join(F.broadcast(sizes), "shingle").select(*out.columns))  # a row for each of a short list
    return out


def _shards(rows: DataFrame, keys: list[str], order: list[str], find: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]], per_task: int = 200_000) -> DataFrame:
    """Distinct pairs (a, b), b the smaller node, that ``find`` gives for shards: rows with equal ``keys``, in ``order``.

    ``find`` takes the shard's number for each row, and the other columns of ``rows``, all longs.
    """
    others = [c for c in rows.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, held
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[: len(keys)]], axis=0)])
            stop = held if last else int(np.flatnonzero(new)[-1])  # the last shard may go on
            found = [np.stack(x, axis=1) for x in find(np.cumsum(new[:stop]), *(c[:stop] for c in cols[len(keys) :])) if len(x[0])] if stop else []
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            parts, held = [[c[stop:] for c in cols]], held - stop

        for b in batches:
            if b.num_rows:
                parts.append([c.to_numpy() for c in b.columns])
                held += b.num_rows
                if held >= per_task:
                    yield from flush(False)
        if held:
            yield from flush(True)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, *others).repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, "a long, b long").distinct()


class WideTrees:
    """Burkhard-Keller trees over shards of WIDE-bit fingerprints; rows come sorted by shard, a shard's first row is its root."""

    def __init__(self, fp: np.ndarray, root: np.ndarray):
        self.fp, self.root = fp, root
        keys, kids = [], []
        active = np.flatnonzero(np.arange(len(fp)) != root)
        at = root[active]
        while len(active):  # all rows go one edge down at a time; the first at a free edge becomes its child
            key = at * (WIDE + 1) + self.apart(active, at)
            slots, first, back = np.unique(key, return_index=True, return_inverse=True)
            child = active[first]
            keys.append(slots)
            kids.append(child)
            at = child[back]
            on = at != active
            active, at = active[on], at[on]
        key, kid = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, kids))
        order = np.argsort(key, kind="stable")
        self.key, self.kid = key[order], kid[order]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[a] ^ self.fp[b]).sum(axis=1, dtype=np.int64)

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, earlier row of its shard) within the radius; only edges within the radius of a node's distance are followed."""
        q, at = queries, self.root[queries]
        left, right = [queries[:0]], [queries[:0]]
        while len(q):
            on = at < q  # a child stands after its parent, so all below a later row is later
            q, at = q[on], at[on]
            d = self.apart(q, at)
            left.append(q[d <= radius])
            right.append(at[d <= radius])
            base = at * (WIDE + 1)
            lo = np.searchsorted(self.key, base + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, base + np.minimum(d + radius, WIDE), side="right") - lo
            q = np.repeat(q, n)
            at = self.kid[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        return np.concatenate(left), np.concatenate(right)


def _roots(shard: np.ndarray) -> np.ndarray:
    new = np.concatenate([[True], shard[1:] != shard[:-1]])
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _near_in_blocks(trees: WideTrees, queries: np.ndarray, radius: int, pairs: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cost = np.cumsum(queries - trees.root[queries] + 1)
    at = 0
    while at < len(queries):
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + pairs, side="right")))
        yield trees.near(queries[at:stop], radius)
        at = stop


def _hubs(fp: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For rows sorted by shard: the row of their shard that is closest to the shard's bitwise majority, the first of several."""
    root = _roots(shard)
    first = np.flatnonzero(root == np.arange(len(root)))
    size = np.diff(np.append(first, len(root)))
    ones = np.add.reduceat(np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, WIDE // 8), axis=1), first, axis=0, dtype=np.int32)
    middle = np.packbits(2 * ones > size[:, None], axis=1).view("<u8")
    off = np.bitwise_count(fp ^ np.repeat(middle, size, axis=0)).sum(axis=1, dtype=np.int64)
    return np.repeat(np.lexsort((off, root))[first], size)


def least_neighbours(node: np.ndarray, fp: np.ndarray, shard: np.ndarray, radius: int, passes: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows by (shard, node): pairs of each row and a hub, or the least node, near it in its shard; the greater node first.

    In each pass a shard's middle row takes all rows near it, and these leave; so a large family
    costs one comparison a row, against the member most like the rest. What remains goes into trees.
    """
    for _ in range(passes):
        if not len(node):
            return
        hub = _hubs(fp, shard)
        near = np.bitwise_count(fp ^ fp[hub]).sum(axis=1, dtype=np.int64) <= radius
        on = near & (np.arange(len(node)) != hub)
        yield np.maximum(node[on], node[hub[on]]), np.minimum(node[on], node[hub[on]])
        node, fp, shard = node[~near], fp[~near], shard[~near]
    if len(node):
        trees = WideTrees(fp, _roots(shard))
        for q, at in _near_in_blocks(trees, np.arange(len(node)), radius):
            if len(q):
                order = np.lexsort((at, q))
                q, at = q[order], at[order]
                first = np.concatenate([[True], q[1:] != q[:-1]])
                yield node[q[first]], node[at[first]]


def crossing_pairs(shard: np.ndarray, node: np.ndarray, label: np.ndarray, n: np.ndarray, at: np.ndarray, major: np.ndarray, first: np.ndarray, least: float, pairs: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows by (shard, n), a shingle of a node's prefix and its place there: pairs of different labels, the greater node first.

    Rows of the shard's commonest label (``major``) never pair among themselves; pairs of two other rows are
    looked for only where ``first`` is set. Left out is what sizes forbid, and what shares too little even if
    this shingle is the first in common and all after it are: at the first one in common no pair of
    similarity ``least`` is left out.
    """
    size, root = int(n.max(initial=0)) + 2, shard.astype(np.int64)
    place = root * size + n
    ask = np.flatnonzero(major == 0)
    low = np.searchsorted(place, root[ask] * size + np.ceil(least * n[ask] - 1e-9).astype(np.int64))
    high = np.searchsorted(place, root[ask] * size + np.minimum(size - 1, np.floor(n[ask] / least + 1e-9).astype(np.int64)), side="right")
    many = high - low
    cost, start = np.cumsum(many), 0
    while start < len(ask):
        stop = max(start + 1, int(np.searchsorted(cost, (int(cost[start - 1]) if start else 0) + pairs, side="right")))
        k = many[start:stop]
        q = np.repeat(ask[start:stop], k)
        r = np.repeat(low[start:stop] - np.cumsum(k) + k, k) + np.arange(len(q))
        need = np.ceil(least / (1 + least) * (n[q] + n[r]) - 1e-9)
        on = (label[q] != label[r]) & ((major[r] == 1) | ((first[q] == 1) & (q < r))) & (np.minimum(n[q] - at[q], n[r] - at[r]) >= need)
        q, r = q[on], r[on]
        yield np.maximum(node[q], node[r]), np.minimum(node[q], node[r])
        start = stop


def _bounded(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that can have this similarity by their sizes and bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            need = [least / (1 + least) * (x + y) - 1e-9 for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            on = [most_shared(*x) >= k for k, *x in zip(need, *(b.column(c).to_pylist() for c in (4, 5, 2, 3)), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    one, two = (classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"m{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)
    return both.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, least: float, few: int = 500_000) -> DataFrame:
    """The pairs whose shingle sets have at least this Jaccard similarity; sets are made for the classes in the pairs that bitmaps leave only."""
    pairs = materialize(_bounded(pairs, classes, least), "near-pairs")
    ends = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    ends = materialize(classes.join(ends, "node").select("node", F.col("least.h0").alias("e0"), F.col("least.h1").alias("e1")), "near-ends")
    held = docs.join(broadcast_if_small(ends, ends.count(), few), (F.col("h0") == F.col("e0")) & (F.col("h1") == F.col("e1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):  # sets are as large as texts
                part = b.slice(at, 500)
                keys = [shingle_set(x.as_py(), width).view(np.int64) for x in pc.fill_null(part.column(1), b"")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    sets = held.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, keys array<long>")
    sets = materialize(sets.dropDuplicates(["node"]), "near-sets")
    one, two = sets.select(F.col("node").alias("a"), F.col("keys").alias("ka")), sets.select(F.col("node").alias("b"), F.col("keys").alias("kb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("ka", "kb")))
    links = materialize(both.where(F.col("both") >= least * (F.size("ka") + F.size("kb") - F.col("both")) - 1e-9).select("a", "b"), "near-links")
    discard(pairs, ends, sets)
    return links


def near_groups(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 32, chunk: int = 20_000, hot: int = 1_000_000) -> DataFrame:
    """(h0, h1, doc_id, least) of every row: h0 and h1 hash its doc_id and text, ``least`` is the first row of its group
    by doc_id (null last) and hashes, as a struct (no_id, doc_id, h0, h1).

    Rows are linked where the Jaccard similarity of their sets of ``width``-word shingles is at least ``least``;
    groups are what links connect. Rows with equal words form a class, so copies cost one entry.

    Of every two similar sets a rare shingle stands in both prefixes, so classes that share a prefix shingle form a
    shard. In round one a shard is a Burkhard-Keller tree of 128-bit SimHash fingerprints, after its middle rows took
    what is within ``radius`` bits of them: each class is checked exactly, on the sets, against a middle row or its
    least neighbour. Round two checks all pairs of a shard that round one did not connect, unless sizes, places
    in the prefixes or bitmaps of the sets rule them out, so the result is complete (up to equal 64-bit keys of different shingles).

    Shards of over ``chunk`` rows are dealt to chunks, twice over in round one; in round two the rows of the
    commonest group stay in their chunk and only the others go to all of them. Shingles estimated in over ``hot``
    rows are not brought together at all.
    """
    h = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "text")
    docs = docs.select(h(0).alias("h0"), h(1).alias("h1"), "doc_id", "text")
    share = 32
    common = common_shingles(docs, width, share)
    often = [int(x) for x in common[0][common[1] * share > hot].view(np.int64)]
    rows = materialize(profiles(docs, width, least, common), "near-profiles")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h0", "h1")
    classes = rows.groupBy("key").agg(F.min(first).alias("least"), *[F.first(c).alias(c) for c in ("n", "f0", "f1", "bits", "prefix")])
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    shared = materialize(shared_postings(classes, least, often), "near-postings")
    chunks = F.ceil(F.col("many") / chunk)
    dealt = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), chunks)

    marked = shared.join(classes.select("node", "f0", "f1"), "node")
    once = marked.select("shingle", dealt(1).alias("chunk"), "node", "f0", "f1")
    again = marked.where(chunks > 1).select("shingle", (-1 - dealt(2)).alias("chunk"), "node", "f0", "f1")
    near = lambda shard, node, f0, f1: least_neighbours(node, np.stack([f0, f1], axis=1).view(np.uint64), shard, radius)
    tried = materialize(_shards(once.unionByName(again), ["shingle", "chunk"], ["node"], near), "near-first")
    links = _verified(tried, docs, classes, width, least)
    found = connected_components(links)

    labelled = shared.join(found, "node", "left").withColumn("label", F.coalesce("root", "node"))
    labelled = materialize(labelled.select("shingle", "node", "label", "n", "at", "many"), "near-labelled")
    counts = labelled.groupBy("shingle", "label").agg(F.count("*").alias("rows"))
    mixed = counts.groupBy("shingle").agg(F.count("*").alias("labels"), F.max(F.struct("rows", "label")).alias("top")).where("labels > 1")
    mixed = materialize(mixed.select(F.col("shingle").alias("s"), F.col("top.label").alias("top")), "near-mixed")
    held = labelled.join(mixed, F.col("shingle") == F.col("s")).withColumn("major", (F.col("label") == F.col("top")).cast("long"))
    place = F.when(F.col("major") == 1, F.array(dealt(1))).otherwise(F.sequence(F.lit(0).cast("long"), chunks - 1))
    held = held.withColumn("chunk", F.explode(place)).select("shingle", "chunk", "node", "label", "n", F.col("at").cast("long").alias("at"), "major", (F.col("chunk") == 0).cast("long").alias("first"))
    cross = lambda *columns: crossing_pairs(*columns, least)
    rest = materialize(_shards(held, ["shingle", "chunk"], ["n"], cross).join(tried, ["a", "b"], "left_anti"), "near-rest")
    if not rest.isEmpty():
        more = _verified(rest, docs, classes, width, least)
        if not more.isEmpty():
            found = connected_components(links.unionByName(more))
    rooted = materialize(classes.select("key", "least", "node").join(found, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "least"), "near-rooted")
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("group")), "near-smallest")
    member = materialize(rooted.join(smallest, "root").select(F.col("key").alias("k"), "group"), "near-members")
    discard(classes, shared, tried, links, labelled, mixed, rest, rooted, smallest)
    return rows.select("h0", "h1", "doc_id", "key").join(member, F.col("key") == F.col("k")).select("h0", "h1", "doc_id", F.col("group").alias("least"))


def near_duplicates(docs: DataFrame, **options: float) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id of its group of near-duplicates (see ``near_groups``), null if no row of it has one.

    Null and empty texts have the empty set and form one group; rows of one doc_id with different texts are rows
    of their own; repeated rows come back each; an empty table gives an empty table; other columns are not read.
    """
    return near_groups(docs, **options).select("doc_id", F.col("least.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, few: int = 500_000, **options: float) -> DataFrame:
    """The first row of each group of near-duplicates (see ``near_groups``), with all its columns.

    First is by doc_id, null last, then by hashes of doc_id and text; of rows that repeat both, the least by their
    other columns stays, or one of them if a column has no order. Rows without doc_id are grouped like any other. An empty table gives an empty table.
    """
    groups = near_groups(docs, **options)
    kept = (F.col("h0") == F.col("least.h0")) & (F.col("h1") == F.col("least.h1"))
    rows = groups.groupBy("h0", "h1").agg(F.first(kept).alias("kept"), F.count("*").alias("many"))
    marks = materialize(rows.where("not kept or many > 1").select(F.col("h0").alias("_hw_h0"), F.col("h1").alias("_hw_h1"), "kept"), "near-dropped")
    n = marks.count()
    h = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "text")
    on = (h(0) == F.col("_hw_h0")) & (h(1) == F.col("_hw_h1"))
    out = docs.join(broadcast_if_small(marks, n, few), on, "left_anti")
    repeated = docs.join(broadcast_if_small(marks.where("kept"), n, few), on, "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    ordered = not any(re.search(r"\b(map|variant|interval)\b", docs.schema[c].dataType.simpleString()) for c in others)
    once = repeated.groupBy("doc_id", "text").agg((F.min if ordered else F.first)(F.struct(*others)).alias("_hw_o")).select("doc_id", "text", "_hw_o.*") if others else repeated.distinct()
    return out.unionByName(once)
