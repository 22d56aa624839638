"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.llm.textutil import coded_words
from hueweave.runtime import broadcast_if_small, materialize

BITS, BLOCKS = 64, 8


def word_keys(words: list[str]) -> np.ndarray:
    """A 64-bit key of each word, lower-cased and without punctuation at its ends; 0 for words of punctuation alone."""
    import xxhash

    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        w = w.lower()
        if not w.isalnum():
            a, b = 0, len(w)
            while a < b and not w[a].isalnum():
                a += 1
            while b > a and not w[b - 1].isalnum():
                b -= 1
            w = w[a:b]
        if w:
            out[i] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 1) | 1
    return out


def shingles(keys: np.ndarray, width: int) -> np.ndarray:
    """64-bit keys of the runs of ``width`` words."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + keys[i : i + n]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


@dataclass
class Bag:
    held: dict[int, int]
    one: dict[int, int]
    total: int


class BenchmarkIndex:
    """Items by size, their fingerprints in block tables, and their shingles with weights.

    Takes (item, shingles, weights, words): the keys of the ``width``-word shingles of an item and their weights, or, of an
    item with fewer words, no shingles and the keys of its words.
    """

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], width: int, radius: int, least: float):
        self.width, self.radius, self.least = width, radius, least
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, h, _, words in items:
            if not len(h):
                self.short[len(words)][int(shingles(words, len(words))[0])].append(item)
        self.short = {k: dict(x) for k, x in self.short.items()}
        keyed = [(item, h, w) for item, h, w, _ in items if len(h)]
        every = np.concatenate([np.zeros(0, np.uint64), *(h for _, h, _ in keyed)])
        self.known, at = np.unique(every, return_index=True)
        self.weights = np.concatenate([np.zeros(0, np.int32), *(w for _, _, w in keyed)])[at].astype(np.int32)
        sizes = defaultdict(list)
        for item, h, w in keyed:
            sizes[len(h)].append((item, h, w))
        self.sizes = {}
        reach = radius // BLOCKS  # one block of eight differs in no more bits
        values = np.arange(256, dtype=np.uint8)
        for m, rows in sorted(sizes.items()):
            fp = np.array([self.fingerprint(x, y) for _, x, y in rows], np.uint64)
            octets = fp.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
            tables = [np.bitwise_count(values[:, None] ^ octets[None, :, k]) <= reach for k in range(BLOCKS)]
            self.sizes[m] = ([x for x, _, _ in rows], fp, tables, [self.bag(x, y) for _, x, y in rows])
        self.most = max(self.sizes, default=0)
        self.few = min(self.sizes, default=0)
        self.holders: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for m, (_, _, _, bags) in self.sizes.items():
            for j, bag in enumerate(bags):
                for x in bag.held:
                    self.holders[x].append((m, j))

    def weight(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        return np.where(self.known[at] == h, self.weights[at], 4).astype(np.int32)

    def exact(self, keys: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, 1) of the items with fewer than ``width`` words that stand in a text, at their first place."""
        out = []
        for k, held in self.short.items():
            h = shingles(keys, k)
            known = np.array(sorted(held), np.uint64)
            for i in np.flatnonzero(np.isin(h, known))[::-1].tolist():
                out += [(item, i, k, 1.0) for item in held[int(h[i])]]
        return [(x, *y) for x, *y in {x[0]: x for x in out}.values()]

    @staticmethod
    def fingerprint(h: np.ndarray, w: np.ndarray) -> int:
        return int(np.packbits(2 * (bits(h) * w[:, None]).sum(axis=0) > w.sum(), bitorder="little").view("<u8")[0])

    @staticmethod
    def bag(h: np.ndarray, w: np.ndarray) -> Bag:
        """The weight of each shingle, repeats added, with that of one, and the total."""
        one = dict(zip(h.tolist(), w.tolist(), strict=True))
        many = Counter(h.tolist())
        return Bag({x: many[x] * one[x] for x in one}, one, int(w.sum()))

    @staticmethod
    def similarity(h: np.ndarray, item: Bag) -> float:
        """Weighted Jaccard of a text's shingles and an item's bag; a shingle that the item lacks weighs 4."""
        both = other = 0
        for x, n in Counter(h.tolist()).items():
            weight, held = item.one.get(x, 4), item.held.get(x, 0)
            both += min(n * weight, held)
            other += max(0, n * weight - held)
        return both / max(1, other + item.total)

    def regions(self, hit: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of shingles outside which no window can be similar.

        At similarity s at least s/(1+s) of a window's shingles are an item's (its others weigh 4, the
        most). Covered by pieces of the smallest size, one piece has at least half that share.
        """
        m = self.few
        need = max(1, int(np.ceil(self.least / (1 + self.least) * m / 2 - 1e-9)))
        total = np.concatenate([[0], np.cumsum(hit)])
        size = min(m, len(hit))
        dense = np.flatnonzero(total[size:] - total[:-size] >= need)
        out: list[tuple[int, int]] = []
        for a in dense.tolist():
            lo, hi = max(0, a - self.most), min(len(hit), a + size + self.most)
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
        return out

    def find(self, h: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item that the text holds."""
        best: dict[int, tuple[float, int, int]] = {}
        if len(h) < self.most:
            self._whole(h, hit, best)
        for lo, hi in self.regions(hit) if len(h) >= self.few else []:
            for at in range(lo, max(lo + 1, hi - self.few + 1), 50_000):  # stretches of a very long region, overlapping by a window
                self._stretch(h[at : min(hi, at + 50_000 + self.most)], hit[at : min(hi, at + 50_000 + self.most)], at, best)
        return [(item, at, m + self.width - 1, s) for item, (s, at, m) in sorted(best.items())]

    def _whole(self, h: np.ndarray, hit: np.ndarray, best: dict[int, tuple[float, int, int]]) -> None:
        """The whole text as its one window, against all longer items that share a shingle with it, without fingerprints."""
        for m, j in sorted({x for y in set(h[hit].tolist()) for x in self.holders[y] if x[0] > len(h)}):
            items, _, _, bags = self.sizes[m]
            s = self.similarity(h, bags[j])
            if s >= self.least and (items[j] not in best or s > best[items[j]][0]):
                best[items[j]] = (s, 0, len(h))

    def _stretch(self, h: np.ndarray, hit: np.ndarray, base: int, best: dict[int, tuple[float, int, int]]) -> None:
        w = self.weight(h)
        ones = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bits(h) * w[:, None], axis=0, dtype=np.int32)])
        weight, hits = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(hit)])
        share = self.least / (1 + self.least)
        for m, (items, fps, tables, bags) in self.sizes.items():
            if m > len(h):
                break
            at = np.flatnonzero(hits[m:] - hits[:-m] >= share * m - 1e-9)
            if not len(at):
                continue
            bit = 2 * (ones[at + m] - ones[at]) > (weight[at + m] - weight[at])[:, None]
            octets = np.packbits(bit, axis=1, bitorder="little")
            fp = octets.view("<u8")[:, 0]
            near = np.zeros((len(at), len(items)), bool)
            for k, table in enumerate(tables):
                near |= table[octets[:, k]]
            a, b = np.nonzero(near)
            close = np.bitwise_count(fp[a] ^ fps[b]) <= self.radius
            for i, j in zip(at[a[close]].tolist(), b[close].tolist(), strict=True):
                s = self.similarity(h[i : i + m], bags[j])
                if s >= self.least and (items[j] not in best or s > best[items[j]][0]):
                    best[items[j]] = (s, base + i, m)


def keyed_items(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, text, shingles, weights, words) of the items with a word, each shingle weighted by 4 over the number of items that hold it, 1 at least.

    Holders are counted over the whole benchmark. Items with fewer than ``width`` words have no shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [word_keys(x.split()) for x in b.column(1).to_pylist()]
            keys = [x[x != 0].view(np.int64) for x in keys]
            h = [shingles(x.view(np.uint64), width).view(np.int64) for x in keys]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h, kind), pa.array([x if len(x) < width else x[:0] for x in keys], kind)], ["item_id", "text", "shingles", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    items = items.mapInArrow(run, "item_id long, text string, shingles array<long>, words array<long>").where("size(shingles) + size(words) > 0")
    items = materialize(items, "benchmark")
    places = items.select("item_id", "text", F.posexplode("shingles").alias("at", "x"))
    held = places.groupBy("x").agg(F.count_distinct("item_id", "text").alias("n"))
    weight = F.greatest(F.lit(1), F.floor(4 / F.col("n"))).cast("int")
    weights = places.join(held, "x").groupBy("item_id", "text").agg(F.sort_array(F.collect_list(F.struct("at", weight.alias("w")))).alias("w"))
    weights = weights.select(F.col("item_id").alias("i"), F.col("text").alias("t"), F.col("w.w").alias("weights"))
    return materialize(items.join(weights, (F.col("item_id") == F.col("i")) & (F.col("text") == F.col("t")), "left").select("item_id", "text", "shingles", "weights", "words"), "benchmark")


def _held_items(docs: DataFrame, benchmark: DataFrame, width: int, radius: int, least: float, block: int) -> DataFrame:
    """The other columns of ``docs`` (all but the first, the text), with each item that the text holds."""
    spark = docs.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[1:])
    schema = f"{fields}, item_id long, first_word long, words long, similarity double"
    names = [*docs.columns[1:], "item_id", "first_word", "words", "similarity"]
    items = keyed_items(benchmark, width)
    n = items.count()
    out, last = None, None
    for _ in range(0, n, block):
        some = items if last is None else items.where((F.col("item_id") > last[0]) | ((F.col("item_id") == last[0]) & (F.col("text") > last[1])))
        rows = some.orderBy("item_id", "text").limit(block).collect()
        last = (rows[-1]["item_id"], rows[-1]["text"])
        own = lambda x, kind: np.array(x or [], np.int64).astype(kind)
        keyed = [(r["item_id"], own(r["shingles"], np.uint64), own(r["weights"], np.int32), own(r["words"], np.uint64)) for r in rows]
        index = spark.sparkContext.broadcast(BenchmarkIndex(keyed, width, radius, least))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            for b in batches:
                found: list[list] = [[], [], [], [], []]
                for i, rows in matches(x, b.column(0)):
                    for item, at, m, s in rows:
                        for column, v in zip(found, (i, item, at, m, s), strict=True):
                            column.append(v)
                if found[0]:
                    own = b.take(pa.array(found[0]))
                    yield pa.RecordBatch.from_arrays([*own.columns[1:], *[pa.array(c, t) for c, t in zip(found[1:], [pa.int64()] * 3 + [pa.float64()], strict=True)]], names)

        found = docs.mapInArrow(run, schema)
        if n > block:  # one index at a time
            found = materialize(found, "benchmark-found")
            index.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 3, radius: int = 20, least: float = 0.6, block: int = 2000) -> DataFrame:
    """(doc_id, item_id, first_word, words, similarity) for each row and each item that its whole text holds.

    Windows as long as an item slide over the text; those whose weighted SimHash is within ``radius`` bits of
    an item's are candidates. Eight byte blocks with up to radius/8 differing bits each find all of these.
    A candidate counts if the weighted Jaccard of its ``width``-word shingles with the item's is at least
    ``least``; a shingle's weight falls with the number of items that hold it, and what the item lacks weighs most.
    Windows with too few shingles of any item to reach that are not fingerprinted. A text that is
    shorter than an item is its one window, checked without fingerprints. Items with fewer than ``width``
    words count where they stand word for word.

    Words are compared lower-cased and without punctuation at their ends. The benchmark is a stated query set: it
    goes to the tasks in blocks of ``block`` items, one pass over the texts each, and of several blocks each index
    is destroyed after its pass. Null and empty texts and items match nothing; a null item_id takes no part; items
    that repeat are one; repeated rows come back each; an empty table on either side gives an empty result.
    """
    return _held_items(docs.select("text", "doc_id"), benchmark, width, radius, least, block)


def matches(x: BenchmarkIndex, text: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
    """Rows of a batch that hold an item, with what they hold."""
    for at in range(0, len(text), 1000):
        part = pc.fill_null(text.slice(at, 1000), "")
        offsets, codes, distinct = coded_words(part)
        keys = word_keys_cached(distinct)[codes]
        real = keys != 0
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        keys = keys[real]
        h = shingles(keys, x.width)
        hit = np.isin(h, x.known) if len(x.known) < 100 else x.known[np.minimum(np.searchsorted(x.known, h), len(x.known) - 1)] == h
        total = np.concatenate([[0], np.cumsum(hit)])
        for i in range(len(part)):
            a, b = int(offsets[i]), int(offsets[i + 1]) - x.width + 1
            rows = x.exact(keys[a : int(offsets[i + 1])]) if x.short else []
            if b > a and total[b] > total[a]:
                rows = rows + x.find(h[a:b], hit[a:b])
            if rows:
                yield at + i, rows


_KEYS: dict[str, int] = {}


def word_keys_cached(words: list[str], most: int = 300_000) -> np.ndarray:
    new = [w for w in words if w not in _KEYS]
    if new:
        if len(_KEYS) + len(new) > most:
            _KEYS.clear()
            return word_keys(words)
        _KEYS.update(zip(new, word_keys(new).tolist(), strict=True))
    return np.fromiter((_KEYS[w] for w in words), np.uint64, len(words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 3, radius: int = 20, least: float = 0.6, block: int = 2000, few: int = 500_000) -> DataFrame:
    """The rows whose whole text holds no item, with all their columns.

    A row goes by its own doc_id and text: rows without doc_id are judged too, and a clean row stays where another of its
    doc_id goes. Null and empty texts stay; no items leave all rows.
    """
    h = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "text")
    keyed = docs.select("text", h(0).alias("_hw_h0"), h(1).alias("_hw_h1"))
    found = materialize(_held_items(keyed, benchmark, width, radius, least, block).select("_hw_h0", "_hw_h1").distinct(), "contaminated")
    on = (h(0) == F.col("_hw_h0")) & (h(1) == F.col("_hw_h1"))
    return docs.join(broadcast_if_small(found, found.count(), few), on, "left_anti").select(*docs.columns)
