"""Token counts by byte-pair merging over a heap and a linked list."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hueweave.llm.textutil import byte_letters, coded_words, sums

# The byte-level pre-tokenizer's pattern, and white space as the tokenizers library has it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SPACES = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class HeapMerger:
    """Counts the tokens of a text under a byte-level byte-pair vocabulary (a tokenizers .json file)."""

    def __init__(self, path: str, words: int = 500_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[x] for x in byte_letters()]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = f" [{SPACES}]| $" + "".join("|" + regex.escape(x) for x in self.special)
        self.words = words
        self.piece_cache: dict[str, int] = {}
        self.word_cache: dict[str, int] = {}

    def merges(self, data: bytes) -> int:
        """How many merges the bytes undergo: the lowest-rank adjacent pair first, the leftmost of equals."""
        first, ranks, made = self.first, self.ranks, self.made
        sym = [first[x] for x in data]
        n = len(sym)
        heap = []
        for i in range(n - 1):
            r = ranks.get(sym[i] << 20 | sym[i + 1])
            if r is not None:
                heap.append(r << 40 | i)
        if not heap:
            return 0
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before, done = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            x = pop(heap)
            rank, i = x >> 40, x & 0xFFFFFFFFFF
            a = sym[i]
            j = after[i]
            if a < 0 or j >= n or ranks.get(a << 20 | sym[j]) != rank:
                continue  # one of the two has merged since
            new = made[rank]
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                r = ranks.get(new << 20 | sym[k])
                if r is not None:
                    push(heap, r << 40 | i)
            h = before[i]
            if h >= 0:
                r = ranks.get(sym[h] << 20 | new)
                if r is not None:
                    push(heap, r << 40 | h)
        return done

    def piece(self, piece: str) -> int:
        n = self.piece_cache.get(piece)
        if n is None:
            data = piece.encode("utf-8", "replace")
            n = len(data) - self.merges(data)
            if len(piece) < 64:
                if len(self.piece_cache) >= self.words:
                    self.piece_cache.clear()
                self.piece_cache[piece] = n
        return n

    def plain(self, text: str) -> int:
        return sum(map(self.piece, self.pieces.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of a text; special strings in it are one token each."""
        if self.cut is None:
            return self.plain(text)
        return sum(1 if i % 2 else self.plain(x) for i, x in enumerate(self.cut.split(text)))

    def word(self, word: str) -> int:
        """Tokens of a space and a word."""
        n = self.word_cache.get(word)
        if n is None:
            n = self.plain(" " + word)
            if len(word) < 64:
                if len(self.word_cache) >= self.words:
                    self.word_cache.clear()
                self.word_cache[word] = n
        return n

    def counts(self, text: pa.Array) -> np.ndarray:
        """Tokens of each text. A piece never spans a space and what stands before it, so texts
        whose spaces all stand alone are counted word by word, each distinct word once."""
        text = pc.fill_null(text, "")
        odd = np.asarray(pc.match_substring_regex(text, self.odd))
        out = np.zeros(len(text), np.int64)
        for i in np.flatnonzero(odd):
            out[i] = self.count(text[i].as_py())
        even = np.flatnonzero(~odd)
        if len(even):
            offsets, codes, distinct = coded_words(text.take(pa.array(even)), on_space=True)
            each = np.fromiter(map(self.word, distinct), np.int64, len(distinct))[codes]
            heads = codes[offsets[:-1]]
            bare = np.fromiter((self.plain(distinct[c]) for c in heads), np.int64, len(heads))
            out[even] = sums(each, offsets) - each[offsets[:-1]] + bare
        return out


_MERGERS: dict[str, HeapMerger] = {}


def merger(path: str) -> HeapMerger:
    """One merger for each Python worker and vocabulary."""
    if path not in _MERGERS:
        _MERGERS[path] = HeapMerger(path)
    return _MERGERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text; ``tokenizer`` names a public vocabulary.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty
    table gives an empty table; other columns are not read. There is no shuffle, and a worker
    holds one Arrow batch and its bounded caches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        m = merger(public_tokenizers.path(tokenizer))
        for b in batches:
            n = m.counts(b.column(1))
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
