"""Removal of repeated passages: suffixes at sampled places, sorted in runs, exchanged front-coded and merged by loser trees that know common prefixes.

A passage counts if ``length`` bytes of it also start anywhere else. Each such string holds a place whose gram hashes least among the
``window`` grams from the string's begin, and equal strings hold it at the same offset. So suffixes are sorted at these places only:
the strings around two places are equal as far as the suffixes agree to the right and what stands before them agrees to the left.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.functions.packed import sliding_minimum
from hueweave.runtime import discard, materialize

_HEAD = struct.Struct("<IIIqqq")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def sizes(length: int) -> tuple[int, int, int]:
    """(window, gram, least): places of a window, bytes of a gram, and how far a place's suffix agrees at least with that of an equal string."""
    window = max(1, length * 3 // 4)
    least = length - window + 1
    return window, 1 << min(4, least.bit_length() - 1), least


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hashes of the ``gram`` bytes from each place on; grams are put together from halves."""
    h, size, level = text.astype(np.uint64) * _MULTIPLIERS[0] + _MULTIPLIERS[3], 1, 1
    while size < gram:
        h = h[:-size] * _MULTIPLIERS[level] + h[size:]
        h ^= h >> np.uint64(31)
        size, level = 2 * size, level + 1
    return ((h * _MULTIPLIERS[4]) >> np.uint64(32)).astype(np.uint32)


def places(text: bytes, length: int, piece: int = 1 << 18) -> np.ndarray:
    """The sampled places: those that hash least in some window at the begin of a string of ``length`` bytes. About two in ``window`` places, and all where grams are the same."""
    window, gram, _ = sizes(length)
    every, out = np.frombuffer(text, np.uint8), []
    for at in range(0, len(every) - length + 1, piece):
        strings = min(piece, len(every) - length + 1 - at)
        h = gram_hashes(every[at : at + strings + window + gram - 2], gram)
        low = ~sliding_minimum(h, window)
        edge = np.full(window - 1, np.iinfo(np.uint32).max, np.uint32)
        out.append(np.flatnonzero(h == ~sliding_minimum(np.concatenate([edge, low, edge]), window)) + at)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def context(text: bytes, place: int, length: int, window: int) -> tuple[bytes, bytes]:
    """What stands before a place, as far as a string that it serves may reach, and its suffix."""
    return text[max(0, place - window + 1) : place], text[place : place + length]


def agreement(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known and not looked at."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def front_coded(rows: list[tuple]) -> bytes:
    """A sorted run of (suffix, before, f1, f2, n): each suffix as what it has in common with the one above and the rest."""
    out, above = [], b""
    for suffix, before, f1, f2, n in rows:
        known = agreement(above, suffix)
        out += [_HEAD.pack(known, len(suffix) - known, len(before), f1, f2, n), suffix[known:], before]
        above = suffix
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple]:
    """(common prefix with the suffix above, suffix, before, f1, f2, n) of a front-coded run."""
    at, above = 0, b""
    while at < len(run):
        known, rest, back, f1, f2, n = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        above = above[:known] + run[at : at + rest]
        at += rest
        yield known, above, run[at : at + back], f1, f2, n
        at += back


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Sorted runs as one, in the form of ``decoded``: a loser tree whose entries know how far they agree with the last suffix given out.

    Of two entries the one that agrees further comes first; only if they agree equally far are bytes compared, from there on. A
    run's next entry knows its agreement from the front coding. So no byte of a known prefix is compared again.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [0] * k  # agreement of each run's head with the suffix that last beat it
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        s, t = x[1], y[1]
        both = agreement(s, t, known[a])
        first = a if s[both : both + 1] <= t[both : both + 1] else b
        last = a + b - first
        known[last] = both
        return first, last

    def built(node: int) -> int:
        if node >= k:
            return node - k
        first, loser[node] = play(built(2 * node), built(2 * node + 1))
        return first

    top = built(1) if k > 1 else 0
    while heads[top] is not None:
        yield (known[top], *heads[top][1:])
        heads[top] = next(runs[top], None)
        known[top] = heads[top][0] if heads[top] else 0
        node = (top + k) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def reaches(group: list[tuple], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(f1, f2, left, right): how far around each place of a group (as of ``decoded``, with a common prefix of enough bytes) equal strings reach.

    Places join at the boundaries of the sorted order, those that agree furthest first; each side of a boundary is kept sorted by what stands
    before, and the smaller side's places are put into the larger. A place's nearest neighbours there agree furthest to the
    left, so every pair that is not outdone in both directions is seen. A context that occurs twice agrees with itself.
    """
    m = len(group)
    back = [g[2][::-1] for g in group]
    left, right = [0] * m, [0] * m

    def seen(i: int, l: int, r: int) -> None:
        if l + r >= length:
            left[i], right[i] = max(left[i], l), max(right[i], r)

    for i, g in enumerate(group):
        if g[5] > 1:
            seen(i, len(g[2]), len(g[1]))
    part, of = [[(back[i], i)] for i in range(m)], list(range(m))

    def root(i: int) -> int:
        while of[i] != i:
            of[i] = i = of[of[i]]
        return i

    for i in sorted(range(1, m), key=lambda i: -group[i][0]):
        r, a, b = group[i][0], root(i - 1), root(i)
        if len(part[a]) < len(part[b]):
            a, b = b, a
        large, small = part[a], part[b]
        for x in small:
            at = bisect_left(large, x)
            for j in (at - 1, at):
                if 0 <= j < len(large):
                    l = agreement(x[0], large[j][0])
                    seen(x[1], l, r)
                    seen(large[j][1], l, r)
            large.insert(at, x)
        of[b], part[b] = a, []
    for g, l, r in zip(group, left, right, strict=True):
        if r:
            yield g[3], g[4], l, r


def numbered_texts(documents: DataFrame) -> DataFrame:
    """(rid, doc_id, data): each row's whole text as UTF-8 (null: empty), deflated, with a number of its own; a written table."""
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zlib.compress(x.as_py(), 1) for x in b.column(2)], pa.binary())], ["rid", "doc_id", "data"])

    return materialize(rows.mapInArrow(run, rows.schema), "texts")


def sampled(texts: DataFrame, length: int) -> DataFrame:
    """(rid, place, g, f1, f2) of the sampled places that can serve a string: hashes of the bytes that equal strings share at least, and of the whole context."""
    window, _, least = sizes(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = zlib.decompress(data.as_py())
                at = places(text, length)
                at = at[at + least <= len(text)]
                for i in range(0, len(at), 1 << 16):
                    some = at[i : i + (1 << 16)]
                    g, f = [], []
                    for p in some.tolist():
                        low = max(0, p - window + 1)
                        g.append(xxhash.xxh3_64_digest(text[p : p + least]))
                        f.append(xxhash.xxh3_128_digest(text[low : p + length], seed=p - low))
                    f = np.frombuffer(b"".join(f), "<i8").reshape(-1, 2)
                    columns = np.full(len(some), rid, np.int64), some.astype(np.int64), np.frombuffer(b"".join(g), "<i8"), f[:, 0].copy(), f[:, 1].copy()
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rid", "place", "g", "f1", "f2"])

    return texts.select("rid", "data").mapInArrow(run, "rid long, place long, g long, f1 long, f2 long")


def _contexts(texts: DataFrame, classes: DataFrame, length: int, work, schema: str) -> DataFrame:
    """``work`` on (before, suffix, g, f1, f2, n) of one context of each class (rid, place, g, f1, f2, n), a task's contexts at a time."""
    window = sizes(length)[0]
    of = classes.groupBy(F.col("rid").alias("r")).agg(F.collect_list(F.struct("place", "g", "f1", "f2", "n")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for data, held in zip(b.column(0), b.column(1), strict=True):
                    text, rows = zlib.decompress(data.as_py()), held.values
                    for place, *rest in zip(*(rows.field(i).to_pylist() for i in range(5)), strict=True):
                        yield *context(text, place, length, window), *rest

        return work(each())

    return texts.join(of, F.col("rid") == F.col("r")).select("data", "held").mapInArrow(run, schema)


def merge_reaches(texts: DataFrame, classes: DataFrame, length: int, per_bucket: int = 20_000, run_bytes: int = 1 << 25) -> DataFrame:
    """(f1, f2, left, right) of classes (rid, place, g, f1, f2, n) by a distributed merge sort of their suffixes.

    Tasks sort their suffixes to runs, cut them to buckets by ``g`` (so those that may hold equal strings meet) and front-code them; a
    bucket's runs, about ``per_bucket`` suffixes, are merged in one task.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, least = max(n, classes.count() // per_bucket), sizes(length)[2]

    def sort(contexts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, rows in held.items():
                rows.sort()
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([front_coded(rows)], pa.binary())], ["bucket", "run"])

        for before, suffix, g, f1, f2, count in contexts:
            held.setdefault(g % buckets, []).append((suffix, before, f1, f2, count))
            size += len(before) + len(suffix) + 200
            if size > run_bytes:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
            out, group = [], []
            for entry in merged([decoded(r) for r in runs]):
                if group and entry[0] < least:
                    out += reaches(group, length)
                    group = []
                group.append(entry)
            out += reaches(group, length)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([r[i] for r in out], np.int64)) for i in range(4)], ["f1", "f2", "left", "right"])

        now, runs = None, []
        for b in batches:
            for bucket, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if runs and bucket != now:
                    yield from found(runs)
                    runs = []
                now = bucket
                runs.append(run)
        if runs:
            yield from found(runs)

    runs = _contexts(texts, classes, length, sort, "bucket long, run binary")
    return runs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "f1 long, f2 long, left long, right long")


def string_reaches(texts: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """What ``merge_reaches`` gives, for classes of which too many share a ``g``: their strings are counted one by one, in a shuffled aggregate."""

    def strings(contexts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for before, suffix, _, f1, f2, n in contexts:
            text, offsets = before + suffix, range(max(0, length - len(suffix)), len(before) + 1)
            at = [len(before) - o for o in offsets]
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[i : i + length]) for i in at), "<i8").reshape(-1, 2)
            fixed = [np.full(len(at), x, np.int64) for x in (f1, f2, n)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(offsets, np.int64), h[:, 0].copy(), h[:, 1].copy(), *fixed)], ["o", "h1", "h2", "f1", "f2", "n"])

    rows = materialize(_contexts(texts, classes, length, strings, "o long, h1 long, h2 long, f1 long, f2 long, n long"), "strings")
    repeated = rows.groupBy("o", "h1", "h2").agg(F.sum("n").alias("times")).where("times > 1")
    return rows.join(repeated, ["o", "h1", "h2"], "left_semi").groupBy("f1", "f2").agg(F.max("o").alias("left"), (length - F.min("o")).alias("right"))


def repeated_stretches(texts: DataFrame, length: int, most: int = 50_000) -> DataFrame:
    """(rid, start, end): stretches of the texts that cover exactly the bytes of strings of ``length`` bytes that also start elsewhere; they may overlap.

    Places whose ``g`` occurs once serve no repeated string and leave first. Places with one context are one class with a count, so
    copies of a document are sorted once. Classes of which over ``most`` share a ``g`` go through ``string_reaches``, which no task holds together.
    """
    every = materialize(sampled(texts, length), "places")
    shared = materialize(every.groupBy("g").agg(F.count("*").alias("times")).where("times > 1").select("g"), "shared")
    kept = materialize(every.join(shared, "g", "left_semi"), "shared-places")
    discard(every)
    classes = kept.groupBy("g", "f1", "f2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("at"))
    classes = materialize(classes.select("at.rid", "at.place", "g", "f1", "f2", "n"), "contexts")
    hot = materialize(classes.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > most).select(F.col("g").alias("hot")), "hot-places")
    if hot.isEmpty():
        found = merge_reaches(texts, classes, length)
    else:
        on = F.col("g") == F.col("hot")
        found = merge_reaches(texts, classes.join(hot, on, "left_anti"), length).unionByName(string_reaches(texts, classes.join(hot, on, "left_semi"), length))
    found = materialize(found, "reaches").select(F.col("f1").alias("a"), F.col("f2").alias("b"), "left", "right")
    there = kept.join(found, (F.col("f1") == F.col("a")) & (F.col("f2") == F.col("b")))
    return there.select("rid", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end"))


def remove_repeats(documents: DataFrame, length: int = 400, most: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of (doc_id, text): the text's UTF-8 bytes without any that a string of ``length`` bytes
    covers which also starts anywhere else, in this text or another; ``spans`` are the maximal removed runs (start, end).

    Strings are judged on the whole input and never cross documents; overlapping repeats count. Null texts are empty, rows are
    told apart by themselves (repeated rows are copies and lose all, doc_id may be null), texts under ``length`` bytes stay whole,
    other columns are not looked at, and an empty table gives no rows.
    """
    texts = numbered_texts(documents)
    stretches = repeated_stretches(texts, length, most).groupBy(F.col("rid").alias("r")).agg(F.collect_list(F.struct("start", "end")).alias("held"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, spans, kept = [], [], []
            for data, held in zip(b.column(1), b.column(2), strict=True):
                text, runs = zlib.decompress(data.as_py()), []
                if held.is_valid:
                    start, end = (held.values.field(i).to_numpy() for i in range(2))
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                    runs = list(zip(start[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))
                parts, at = [], 0
                for s, e in runs:
                    parts.append(text[at:s])
                    at = e
                total.append(len(text))
                spans.append([{"start": s, "end": e} for s, e in runs])
                kept.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    rows = texts.join(stretches, F.col("rid") == F.col("r"), "left").select("doc_id", "data", "held")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
