"""Stretches of bases with a few numbers each, packed to bytes: what is shuffled in place of single k-mers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from hueweave.functions.dna import MAX_PACKED_K, NTHASH_SEEDS
from hueweave.functions.packed import BREAK, rotated, sliding_minimum, turned_codes, turned_pairs

#: Junctions of a super-k-mer at most; longer ones are cut, which leaves them in one bucket.
MOST = 200
OPEN_LEFT, OPEN_RIGHT, OWNS_FIRST, OWNS_LAST, SINGLE, RING = 1, 2, 4, 8, 16, 32
_HEAD = struct.Struct("<I")


def mer_hashes(codes: np.ndarray, m: int) -> np.ndarray:
    """The canonical ntHash of the m-mer from each place on; hashes of windows are put together from those of halves, so log2(m) steps do."""
    seeds = np.array([NTHASH_SEEDS[c] for c in "ACGT"], np.uint64)
    c = codes & np.uint8(3)
    part, out, done, size = (seeds[c], seeds[3 - c]), None, 0, 1
    while True:
        if m & size:
            n = len(codes) - done - size + 1
            out = part if out is None else (rotated(out[0][:n], size) ^ part[0][done : done + n], out[1][:n] ^ rotated(part[1][done : done + n], done))
            done += size
        if done == m:
            return np.minimum(*out)
        part = rotated(part[0][:-size], size) ^ part[0][size:], part[1][:-size] ^ rotated(part[1][size:], size)
        size *= 2


def cut(codes: np.ndarray, k: int, m: int, most: int = MOST) -> dict[str, np.ndarray]:
    """The super-k-mers of a text's runs, cut where the minimizer of junctions changes: ``first`` (place of the first k-mer), ``n`` (k-mers),
    ``hash``, ``flags``, ``run`` (number of the run among those of at least k-1 bases) and ``run_start``. Neighbours share a k-mer, which the one of the lesser hash owns."""
    none = np.zeros(0, np.int64)
    if len(codes) < k:
        return dict(first=none, n=none, hash=none.view(np.uint64), flags=none.astype(np.uint8), run=none, run_start=none)
    broken = np.concatenate([[0], np.cumsum(codes == BREAK, dtype=np.int32)])
    at = np.flatnonzero(broken[k - 1 :] == broken[: -(k - 1)])
    h = sliding_minimum(mer_hashes(codes, m), k - m)[at]
    starts = np.ones(len(at), bool)
    starts[1:] = at[1:] != at[:-1] + 1
    new = starts.copy()
    new[1:] |= h[1:] != h[:-1]
    a = np.flatnonzero(new)
    pieces = -(-np.diff(np.append(a, len(at))) // most)
    if len(pieces) and pieces.max() > 1:
        a = np.repeat(a, pieces) + most * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    b = np.append(a[1:], len(at)) - 1
    begin, end = starts[a], np.append(starts[a[1:]], True)[: len(a)]
    first = at[a] - ~begin
    n = at[b] - end - first + 1
    run_at = np.flatnonzero(starts)
    run = np.cumsum(starts)[a] - 1
    single = (np.diff(np.append(run_at, len(at))) == 2)[run]
    h = h[a]
    less = h[:-1] < h[1:]
    owns_first, owns_last = begin | np.append(True, ~less)[: len(a)], end | np.append(less, True)[: len(a)]
    flags = ~begin * OPEN_LEFT + ~end * OPEN_RIGHT + owns_first * OWNS_FIRST + owns_last * OWNS_LAST + single * SINGLE
    kept = n > 0
    return dict(first=first[kept], n=n[kept], hash=h[kept], flags=flags.astype(np.uint8)[kept], run=run[kept], run_start=at[run_at][run[kept]])


def packed_stretches(codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each stretch begins): stretches of codes, four a byte, each from a new byte on."""
    width = (size + 3) >> 2
    upto = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(4 * upto[-1], np.uint8)
    within = np.arange(int(size.sum()), dtype=np.int32 if size.sum() < 1 << 31 else np.int64)
    before = np.cumsum(size) - size
    out[within + np.repeat(4 * upto[:-1] - before, size)] = codes[within + np.repeat(first - before, size)]
    out = out.reshape(-1, 4)
    return (out[:, 0] << 6) | (out[:, 1] << 4) | (out[:, 2] << 2) | out[:, 3], upto


def blob(columns: list[np.ndarray], data: np.ndarray) -> bytes:
    """Numbers from 0 on, each column as narrow as its largest one lets it be, and packed bases."""
    out = [_HEAD.pack(len(columns[0]))]
    for c in columns:
        top = int(c.max()) if len(c) else 0
        c = c.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        out += [bytes([c.itemsize]), c.tobytes()]
    return b"".join([*out, data.tobytes()])


def blobs(codes: np.ndarray, first: np.ndarray, size: np.ndarray, bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, number of stretches, blob) of stretches of codes, with their sizes as first column."""
    order = np.argsort(bucket, kind="stable")
    bucket, size = bucket[order], size[order]
    columns = [size, *(c[order] for c in columns)]
    data, upto = packed_stretches(codes, first[order], size)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for i, j in zip(cuts, np.append(cuts[1:], len(bucket))):
        yield int(bucket[i]), int(j - i), blob([c[i:j] for c in columns], data[upto[i] : upto[j]])


def read_blobs(parts: list[bytes], n_columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of some blobs (sizes first), and their packed bases, with 8 more bytes."""
    columns: list[list[np.ndarray]] = [[] for _ in range(n_columns)]
    data = []
    for p in parts:
        (n,), at = _HEAD.unpack_from(p), _HEAD.size
        for c in columns:
            kind = np.dtype(f"u{p[at]}")
            c.append(np.frombuffer(p, kind, n, at + 1))
            at += 1 + n * kind.itemsize
        data.append(np.frombuffer(p, np.uint8, -1, at))
    return [np.concatenate(c).astype(np.int64) for c in columns], np.concatenate([*data, np.zeros(8, np.uint8)])


def starts_of(size: np.ndarray) -> np.ndarray:
    """The places of the first bases of packed stretches."""
    width = (size + 3) >> 2
    return 4 * (np.cumsum(width) - width)


def unpacked(data: np.ndarray) -> np.ndarray:
    out = np.empty((len(data), 4), np.uint8)
    for i in range(4):
        out[:, i] = (data >> np.uint8(6 - 2 * i)) & np.uint8(3)
    return out.reshape(-1)


def bases(data: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` (to 32) bases from each place on of packed ones, as numbers; ``data`` has 8 bytes more than that needs."""
    if n > 29:
        return (bases(data, place, n - 16) << np.uint64(32)) | bases(data, place + (n - 16), 16)
    words = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    x = words[place >> 2].astype(np.uint64)
    return (x >> (64 - 2 * n - 2 * (place & 3)).astype(np.uint64)) & np.uint64((1 << 2 * n) - 1)


def canonical_at(data: np.ndarray, place: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The canonical k-mers at some places, (lo) or over 31 bases (hi, lo), and which of them are turned."""
    if k <= MAX_PACKED_K:
        own = bases(data, place, k)
        back = turned_codes(own, k)
        return [np.minimum(own, back)], back < own
    codes = 3 - unpacked(data)[::-1]
    other = np.concatenate([packed_stretches(codes, np.zeros(1, np.int64), np.array([len(codes)]))[0], np.zeros(8, np.uint8)])
    there, top = len(codes) - place - k, k - MAX_PACKED_K
    own = [bases(data, place, top), bases(data, place + top, MAX_PACKED_K)]
    back = [bases(other, there, top), bases(other, there + top, MAX_PACKED_K)]
    turned = (back[0] < own[0]) | ((back[0] == own[0]) & (back[1] < own[1]))
    return [np.where(turned, b, o) for o, b in zip(own, back)], turned


def mixed(x: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """A hash of numbers of one or two longs."""
    h = np.full(len(x[0]), (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1), np.uint64)
    for p in x:
        h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def grouped(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): equal numbers, of one or two longs, follow each other in ``order``; ``begins`` are the places where another begins."""
    key = x[0] if len(x) == 1 else mixed(x)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = np.any([p[order][1:] != p[order][:-1] for p in x], axis=0)
    if len(x) > 1 and (new[1:] & (key[order][1:] == key[order][:-1])).any():  # different ones with one hash
        order = np.lexsort(x[::-1])
        new[1:] = np.any([p[order][1:] != p[order][:-1] for p in x], axis=0)
    return order, np.flatnonzero(new)


def turned_numbers(x: list[np.ndarray], k: int) -> list[np.ndarray]:
    return [turned_codes(x[0], k)] if len(x) == 1 else list(turned_pairs(*x, k))


def spelt_codes(x: list[np.ndarray], k: int) -> np.ndarray:
    """A row of codes for each k-mer."""
    low = min(k, MAX_PACKED_K)
    part = lambda p, n: ((p[:, None] >> (np.uint64(2) * np.arange(n - 1, -1, -1, dtype=np.uint64))) & np.uint64(3)).astype(np.uint8)
    return part(x[-1], low) if len(x) == 1 else np.concatenate([part(x[0], k - low), part(x[1], low)], axis=1)
