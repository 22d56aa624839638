"""Hybrid coding of color sets: Elias delta gaps, a bitmap, or gaps of the complement. Time is linear in the coded bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def delta_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elias delta codes of x + 1 (x under 2^32), lowest bit first, and their widths: the length of the length in unary, the length, the number without its top bit."""
    v = x.astype(np.uint64) + np.uint64(1)
    n = np.frexp(v.astype(np.float64))[1].astype(np.uint64)  # exact: v has at most 33 bits
    m = np.frexp(n.astype(np.float64))[1].astype(np.uint64)
    one = np.uint64(1)
    low = lambda y, bits: y & ((one << bits) - one)
    code = (one << (m - one)) | (low(n, m - one) << m) | (low(v, n - one) << (2 * m - one))
    return code, (2 * m + n - np.uint64(2)).astype(np.int64)


def _stored(colors: np.ndarray, n_colors: int) -> tuple[np.ndarray, bool]:
    """The numbers whose gaps stand for a set, and whether they are a bitmap instead: fewer than a quarter of all colors go as they are, fewer than three quarters as a bitmap, else what the set lacks."""
    if len(colors) < int(0.25 * n_colors):
        return colors, False
    if len(colors) < int(0.75 * n_colors):
        return colors, True
    held = np.zeros(n_colors, bool)
    held[colors] = True
    return np.flatnonzero(~held), False


def encode(colors: list[int] | np.ndarray, n_colors: int) -> tuple[bytes, int]:
    """The code of an ascending set, padded to whole bytes, and its number of bits."""
    colors = np.asarray(colors, np.int64)
    kept, bitmap = _stored(colors, n_colors)
    gaps = np.diff(kept, prepend=-1) - 1 if not bitmap else np.zeros(0, np.int64)
    code, width = delta_codes(np.concatenate([[len(colors)], gaps]))
    ends = np.cumsum(width)
    size = int(ends[-1])
    place = np.arange(size) - np.repeat(ends - width, width)
    bits = (np.repeat(code, width) >> place.astype(np.uint64) & np.uint64(1)).astype(np.uint8)
    if bitmap:
        held = np.zeros(n_colors, np.uint8)
        held[kept] = 1
        bits, size = np.concatenate([bits, held]), size + n_colors
    return np.packbits(bits, bitorder="little").tobytes(), size


def decode(data: bytes, n_colors: int) -> np.ndarray:
    """The ascending set of a code."""
    at = 0

    def delta() -> int:
        nonlocal at
        w = int.from_bytes(data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
        m = (w & -w).bit_length()
        n = (w >> m) & ((1 << m - 1) - 1) | 1 << m - 1
        at += 2 * m + n - 2
        return ((w >> 2 * m - 1) & ((1 << n - 1) - 1) | 1 << n - 1) - 1

    size = delta()
    if int(0.25 * n_colors) <= size < int(0.75 * n_colors):
        bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
        return np.flatnonzero(bits[at : at + n_colors])
    lacks = size >= int(0.25 * n_colors)
    gaps = np.fromiter((delta() for _ in range(n_colors - size if lacks else size)), np.int64)
    kept = np.cumsum(gaps + 1) - 1
    if not lacks:
        return kept
    held = np.ones(n_colors, bool)
    held[kept] = False
    return np.flatnonzero(held)


def encode_sets(sets: DataFrame, n_colors: int) -> DataFrame:
    """(cid, n_colors, code, n_bits) of (cid, colors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            colors = b.column(1)
            flat, ends = colors.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(n or 0 for n in colors.value_lengths().to_pylist())])
            coded = [encode(flat[i:j], n_colors) for i, j in zip(ends, ends[1:])]
            rows = [b.column(0), pa.array([n_colors] * len(coded), pa.int32()), pa.array([x for x, _ in coded], pa.binary()), pa.array([n for _, n in coded], pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, ["cid", "n_colors", "code", "n_bits"])

    return sets.select("cid", "colors").mapInArrow(run, "cid long, n_colors int, code binary, n_bits long")


def decode_sets(coded: DataFrame) -> DataFrame:
    """(cid, colors) of ``encode_sets``' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            colors = [decode(x, n) for x, n in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            flat = np.concatenate([np.zeros(0, np.int64), *colors]).astype(np.int32)
            ends = np.cumsum([0, *map(len, colors)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cid", "colors"])

    return coded.select("cid", "n_colors", "code").mapInArrow(run, "cid long, colors array<int>")
