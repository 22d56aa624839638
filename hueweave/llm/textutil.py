"""Whole-text helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_hash(*cols: Column) -> Column:
    """A portable 32-bit hash (first half of an MD5's upper word) that other SQL engines can compute too."""
    joined = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def coded_words(text: pa.Array, on_space: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Split each text and code its words by first appearance in the batch.

    Returns offsets (n+1), codes and the distinct words. ``on_space`` splits at each
    single space, so runs give empty words; otherwise ASCII white space separates
    words and empty words at the ends are coded too. Null counts as empty.
    """
    text = pc.fill_null(text, "")
    if len(text) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), []
    lists = pc.split_pattern(text, " ") if on_space else pc.ascii_split_whitespace(text)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]]; empty slices give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(own))
    return [letters[b] for b in range(256)]
