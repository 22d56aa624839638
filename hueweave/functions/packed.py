"""Packed k-mers of whole sequences, and their minimizers, in numpy over Arrow batches: time linear in the bases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hueweave.functions.dna import MAX_PACKED_K, NTHASH_SEEDS, check_k

BREAK = 4
CODES = np.full(256, BREAK, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODES[[ord(_c), ord(_c.lower())]] = _i


def windows(codes: np.ndarray, w: int) -> np.ndarray:
    """The ``w`` codes from each place on as one number, two bits a code; windows are put together from halves, so log2(w) steps do."""
    out, done, part, size = None, 0, codes, 1
    while True:
        if w & size:
            n = len(codes) - done - size + 1
            out = part if out is None else (out[:n] << np.uint64(2 * size)) | part[done : done + n]
            done += size
        if done == w:
            return out
        part = (part[:-size] << np.uint64(2 * size)) | part[size:]
        size *= 2


def canonical_windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the canonical k-mer from each place on; hi is 0 up to 31 bases. Codes beyond 3 must not matter to the caller."""
    n = len(codes) - k + 1
    own = codes.astype(np.uint64) & np.uint64(3)
    other = (np.uint64(3) - own)[::-1]
    low = min(k, MAX_PACKED_K)
    lo, turned = windows(own, low)[k - low :], windows(other, low)[k - low :][::-1]
    if k == low:
        return np.zeros(n, np.uint64), np.minimum(lo, turned)
    hi, turned_hi = windows(own, k - low)[:n], windows(other, k - low)[:n][::-1]
    less = (turned_hi < hi) | ((turned_hi == hi) & (turned < lo))
    return np.where(less, turned_hi, hi), np.where(less, turned, lo)


def counted_kmers(bases: bytes, k: int, piece: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hi, lo, count) of the distinct canonical k-mers of each piece of a sequence; any byte but ACGT in either case breaks a run."""
    every = np.frombuffer(bases, np.uint8)
    for at in range(0, max(0, len(every) - k + 1), piece):
        codes = CODES[every[at : at + piece + k - 1]]
        broken = np.concatenate([[0], np.cumsum(codes == BREAK, dtype=np.int32)])
        whole = broken[k:] == broken[:-k]
        hi, lo = (x[whole] for x in canonical_windows(codes, k))
        if not len(lo):
            continue
        if k <= MAX_PACKED_K:
            lo, count = np.unique(lo, return_counts=True)
            yield np.zeros(len(lo), np.uint64), lo, count
        else:
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
            yield hi[first], lo[first], np.diff(np.append(first, len(hi)))


def _column(hi: np.ndarray, lo: np.ndarray, k: int) -> pa.Array:
    lo = pa.array(lo.view(np.int64))
    return lo if k <= MAX_PACKED_K else pa.StructArray.from_arrays([pa.array(hi.view(np.int64)), lo], ["hi", "lo"])


def packed_type(k: int) -> str:
    return "long" if k <= MAX_PACKED_K else "struct<hi: long, lo: long>"


def packed_kmers(sequences: DataFrame, k: int, n_colors: int | None = None) -> DataFrame:
    """(color, code, n): the canonical k-mers of (color, seq) rows, packed, n times each; a k-mer may have several rows.

    Equal k-mers of a color are put together within each Arrow batch, so what is shuffled afterwards is a partial
    count. Null and short sequences have none. A null or negative color, or one of ``n_colors`` or more, is an error.
    """
    check_k(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for color, hi, lo, count in kmers_by_color(batches, k, n_colors):
            yield pa.RecordBatch.from_arrays([pa.array([color] * len(lo), pa.int32()), _column(hi, lo, k), pa.array(count)], ["color", "code", "n"])

    rows = sequences.selectExpr("cast(color as int) AS color", "cast(seq as binary) AS seq")
    return rows.mapInArrow(run, f"color int, code {packed_type(k)}, n long")


def kmers_by_color(batches: Iterator[pa.RecordBatch], k: int, n_colors: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(color, hi, lo, count): the k-mers of batches of (color, seq), those of a color put together within a batch."""
    for b in batches:
        of: dict[int, list[bytes]] = {}
        for color, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if seq is not None:
                of.setdefault(color, []).append(seq)
        for color, seqs in of.items():
            if color is None or color < 0 or (n_colors is not None and color >= n_colors):
                raise ValueError(f"color {color} is not one of {n_colors if n_colors is not None else 'the colors from 0 on'}")
            for hi, lo, count in counted_kmers(b"\n".join(seqs), k):
                yield color, hi, lo, count


def add_minimizer(kmers: DataFrame, k: int, m: int) -> DataFrame:
    """Add ``minimizer``, packed, to rows (code): the least canonical m-mer of a packed k-mer of up to 31 bases, in lexicographic order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << 2 * m) - 1)
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            least = np.full(len(x), np.iinfo(np.uint64).max)
            for j in range(k - m + 1):
                own = (x >> np.uint64(2 * j)) & mask
                turned = np.zeros(len(x), np.uint64)
                for i in range(m):
                    turned = (turned << np.uint64(2)) | (np.uint64(3) - ((own >> np.uint64(2 * i)) & np.uint64(3)))
                least = np.minimum(least, np.minimum(own, turned))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(least.view(np.int64))], ["code", "minimizer"])

    return kmers.select("code").mapInArrow(run, "code long, minimizer long")


def nthashes(mers: np.ndarray, m: int) -> np.ndarray:
    """ntHash of packed m-mers: for each base, rotate by one, then xor with the base's seed."""
    seeds = np.array([NTHASH_SEEDS[c] for c in "ACGT"], np.uint64)
    h = np.zeros(len(mers), np.uint64)
    for i in reversed(range(m)):
        h = ((h << np.uint64(1)) | (h >> np.uint64(63))) ^ seeds[((mers >> np.uint64(2 * i)) & np.uint64(3)).astype(np.int64)]
    return h


def rotated(x: np.ndarray, n: int) -> np.ndarray:
    """Longs with their bits rotated to the left."""
    n %= 64
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n)) if n else x


def least_hashes(code: list[np.ndarray], k: int, m: int) -> np.ndarray:
    """The least canonical ntHash, as an unsigned number, of the m-mers of packed k-mers, (lo) or (hi, lo). Hashes roll from one m-mer to the next."""
    seeds = np.array([NTHASH_SEEDS[c] for c in "ACGT"], np.uint64)
    other, leaving, entering = seeds[::-1], rotated(seeds, m), rotated(seeds[::-1], m - 1)
    code = [x.view(np.uint64) for x in code]

    def base(i: int) -> np.ndarray:
        place = k - 1 - i
        x, place = (code[-1], place) if len(code) == 1 or place < MAX_PACKED_K else (code[0], place - MAX_PACKED_K)
        return ((x >> np.uint64(2 * place)) & np.uint64(3)).astype(np.intp)

    own = back = np.zeros(len(code[0]), np.uint64)
    for i in range(m):
        own, back = rotated(own, 1) ^ seeds[base(i)], back ^ rotated(other, i)[base(i)]
    least = np.minimum(own, back)
    for i in range(m, k):
        gone, come = base(i - m), base(i)
        own = rotated(own, 1) ^ leaving[gone] ^ seeds[come]
        back = rotated(back ^ other[gone], 63) ^ entering[come]
        least = np.minimum(least, np.minimum(own, back))
    return least


def turned_codes(x: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of packed k-mers, pairs of bits turned round by halves."""
    x = ~x
    for n, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = ((x >> np.uint64(n)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(n))
    return x >> np.uint64(64 - 2 * k)


def turned_pairs(hi: np.ndarray, lo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Reverse complements of k-mers of 31 to 62 bases, packed in two: both parts are turned and change places, and bases cross over."""
    top, lo = k - MAX_PACKED_K, turned_codes(lo, MAX_PACKED_K)
    if not top:
        return np.zeros(len(lo), np.uint64), lo
    rest = np.uint64((1 << 2 * (MAX_PACKED_K - top)) - 1)
    return lo >> np.uint64(2 * (MAX_PACKED_K - top)), ((lo & rest) << np.uint64(2 * top)) | turned_codes(hi, top)


def add_bucket(kmers: DataFrame, k: int, m: int, buckets: int) -> DataFrame:
    """Add ``bucket`` to rows of packed k-mers (code), longs or pairs of them: the least canonical ntHash of their m-mers, as an unsigned number, without its lowest bit, modulo ``buckets``.

    A k-mer and its reverse complement have one bucket, and so most neighbours do.
    """
    kind = kmers.schema["code"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(0).flatten() if pa.types.is_struct(b.column(0).type) else [b.column(0)]
            least = least_hashes([x.to_numpy() for x in code], k, m)
            bucket = pa.array(((least >> np.uint64(1)) % np.uint64(buckets)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, bucket], [*b.schema.names, "bucket"])

    others = [f for f in kmers.schema if f.name not in ("code", "bucket")]
    rows = kmers.select("code", *[f.name for f in others])
    return rows.mapInArrow(run, ", ".join([f"code {kind}", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "bucket int"]))


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The least of the ``w`` numbers from each place on; windows are put together from overlapping halves, so log2(w) steps do."""
    size = 1
    while 2 * size <= w:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return x if size == w else np.minimum(x[: len(x) - (w - size)], x[w - size :])


def junction_hashes(run: bytes, k: int, m: int) -> np.ndarray:
    """For each (k-1)-mer of an ACGT run, in order, the least canonical ntHash of its m-mers (m under k)."""
    codes = CODES[np.frombuffer(run, np.uint8)].astype(np.uint64)
    other = nthashes(windows(np.uint64(3) - codes[::-1], m), m)[::-1]
    return sliding_minimum(np.minimum(nthashes(windows(codes, m), m), other), k - m)


def joined_runs(runs: pa.Array, k: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each run, text of them with breaks in between) of the runs of at least k bases, about ``most`` bases at a time."""
    rows, held, size = [], [], 0
    for row, x in enumerate(runs.to_pylist()):
        if x is not None and len(x) >= k:
            rows.append(row)
            held.append(x)
            size += len(x)
            if size >= most:
                yield np.array(rows), np.frombuffer("\n".join(held).encode(), np.uint8)
                rows, held, size = [], [], 0
    if rows:
        yield np.array(rows), np.frombuffer("\n".join(held).encode(), np.uint8)


def minimizer_stretches(sequences: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, run, start, minimizer, bases) of (doc_id, seq) rows: maximal stretches of each run whose k-mers have one least canonical m-mer, in lexicographic order. Runs are numbered from 0, short ones too."""
    if not 1 <= m <= check_k(k) or m > MAX_PACKED_K:
        raise ValueError("a minimizer has from 1 to k bases")
    letters = np.frombuffer(b"ACGT", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, text in joined_runs(b.column(0), k):
                codes = CODES[text]
                valid = codes != BREAK
                starts = valid & np.append(True, ~valid[:-1])
                number = np.cumsum(starts) - 1
                run_at = np.flatnonzero(starts)
                begin = np.concatenate([[0], np.flatnonzero(text == ord("\n")) + 1])
                broken = np.concatenate([[0], np.cumsum(~valid, dtype=np.int32)])
                at = np.flatnonzero(broken[k:] == broken[:-k])
                if not len(at):
                    continue
                least = sliding_minimum(canonical_windows(codes, m)[1], k - m + 1)[at]
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
                cut = np.flatnonzero(new)
                first, of = at[cut], number[at[cut]]
                text_of = np.searchsorted(begin, first, "right") - 1
                base = np.searchsorted(run_at, begin)  # runs before each text
                spelt = letters[((least[cut][:, None] >> (np.uint64(2) * np.arange(m - 1, -1, -1, dtype=np.uint64))) & np.uint64(3)).astype(np.int64)]
                mers = pa.StringArray.from_buffers(len(cut), pa.py_buffer((np.arange(len(cut) + 1) * m).astype(np.int32)), pa.py_buffer(spelt.tobytes()))
                columns = [b.column(1).take(pa.array(rows[text_of])), pa.array(of - base[text_of]), pa.array(first - run_at[of]), mers, pa.array(np.diff(np.append(cut, len(at))) + k - 1)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "run", "start", "minimizer", "bases"])

    kind = sequences.schema["doc_id"].dataType.simpleString()
    rows = sequences.selectExpr("translate(seq, '\\n', ' ') AS seq", "doc_id")  # a line end joins texts here
    return rows.mapInArrow(run, f"doc_id {kind}, run long, start long, minimizer string, bases long")


def super_kmers(runs: DataFrame, k: int, m: int, buckets: int) -> DataFrame:
    """Split ACGT runs (column ``run_seq``) where the minimizer of their (k-1)-mers changes: the runs' other columns and
    (start, seq, bucket, is_begin, is_end, owns_first, owns_last), a row a super-k-mer.

    A super-k-mer holds the k-mers whose left or right (k-1)-mer has its minimizer, so neighbours share one k-mer, all k-mers that
    meet at a junction meet in one bucket, and of two neighbours the one with the lesser hash owns the k-mer they share: each
    k-mer of a run is owned once. Null runs and those under k bases give none.
    """
    if not 1 <= m < check_k(k) or m > MAX_PACKED_K:
        raise ValueError("a minimizer has at least 1 and fewer than k bases")
    others = [f for f in runs.schema if f.name != "run_seq"]
    names = ["start", "seq", "bucket", "is_begin", "is_end", "owns_first", "owns_last"]

    from hueweave.functions import blobs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, text in joined_runs(b.column(0), k):
                codes = CODES[text]
                s = blobs.cut(codes, k, m, most=len(codes) + 1)
                size = (s["n"] + k - 1).astype(np.int64)
                within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                seqs = text[np.repeat(s["first"], size) + within]
                seq = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(seqs.tobytes()))
                bucket = ((s["hash"] >> np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
                flags = [s["flags"] & f > 0 for f in (blobs.OPEN_LEFT, blobs.OPEN_RIGHT, blobs.OWNS_FIRST, blobs.OWNS_LAST)]
                columns = [s["first"] - s["run_start"], seq, bucket, ~flags[0], ~flags[1], *flags[2:]]
                kept = pa.RecordBatch.from_arrays(b.columns[1:], names=b.schema.names[1:]).take(pa.array(rows[s["run"]], pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], [*kept.schema.names, *names])

    types = ["long", "string", "int", "boolean", "boolean", "boolean", "boolean"]
    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *map(" ".join, zip(names, types))]
    return runs.select("run_seq", *[f.name for f in others]).mapInArrow(run, ", ".join(schema))
