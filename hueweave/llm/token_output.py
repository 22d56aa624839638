"""Token ids in grammar-compressed blocks: Re-Pair rules, expansion lengths, random access."""

from __future__ import annotations

import math
import os
import string
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hueweave.llm.textutil import byte_letters, sums
from hueweave.runtime import broadcast_if_small, materialize

BLOCK_SCHEMA = "shard int, block int, doc_ids array<{id}>, lengths binary, first long, rules binary, expansions binary, symbols binary, n_ids long"


@dataclass
class Grammar:
    """``symbols`` below ``first`` are ids; symbol first + i is rule i, the pair ``rules[i]``, which expands to ``expansions[i]`` ids."""

    first: int
    rules: np.ndarray
    expansions: np.ndarray
    symbols: np.ndarray
    _lists: pa.LargeListArray | None = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of some symbols: every rule is spelt out once, from the two before it; rules that need none of each other together."""
        if not len(self.rules) or not (symbols >= self.first).any():
            return symbols
        if self._lists is None:
            ends = np.concatenate([np.arange(self.first + 1), self.first + np.cumsum(self.expansions, dtype=np.int64)])
            spelt, needs, done = np.arange(ends[-1], dtype=np.uint32), self.rules.max(axis=1).astype(np.int64) - self.first, 0
            while done < len(self.rules):
                late = np.flatnonzero(needs[done:] >= done)
                to = done + int(late[0]) if len(late) else len(self.rules)
                parts = self.rules[done:to].ravel()
                n = ends[parts + 1] - ends[parts]
                spelt[ends[self.first + done] : ends[self.first + to]] = spelt[np.repeat(ends[parts] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                done = to
            self._lists = pa.LargeListArray.from_arrays(ends, pa.array(spelt))
        return self._lists.take(pa.array(symbols)).flatten().to_numpy()

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop; only the symbols that cover them are expanded."""
        if start == 0 and stop is None:
            return self.expand(self.symbols)
        sizes = np.ones(len(self.symbols), np.int64)
        deep = self.symbols >= self.first
        sizes[deep] = self.expansions[self.symbols[deep] - self.first]
        ends = np.cumsum(sizes)
        stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop - 1, side="right")
        skip = start - int(ends[a] - sizes[a])
        return self.expand(self.symbols[a : b + 1])[skip : skip + stop - start]


def repair(ids: np.ndarray, first: int, least: int = 8) -> Grammar:
    """Replace frequent pairs of adjacent symbols by rules until no pair is seen ``least`` times or more.

    A round counts pairs, makes a rule of each frequent one, and replaces their occurrences from left to
    right without overlap. Of pairs that share a slot of the lookup table the most frequent is replaced; the others
    wait for the next round, and so does a pair whose every occurrence overlaps another's. The first round counts
    all pairs. After that only pairs with a symbol of the last round and those that wait can be frequent, as a
    replacement makes no other pairs, so rounds count at these places alone.
    """
    seq = ids.astype(np.uint32)
    rules = [np.zeros((0, 2), np.uint32)]
    sizes = np.ones(first, np.int64)
    places = np.arange(max(0, len(seq) - 1))
    while len(places):
        shift = 16 if len(sizes) <= 1 << 16 else 32
        word = np.uint32 if shift == 16 else np.uint64
        code = (seq[places].astype(word) << word(shift)) | seq[places + 1]
        ranked = np.sort(code)
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
        count = np.diff(edge)
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        pairs = ranked[edge[often]]
        bits = min(22, max(16, int(4 * len(pairs)).bit_length()))
        slot = lambda x: (x * word(0x9E3779B97F4A7C15 & ((1 << 2 * shift) - 1))) >> word(2 * shift - bits)  # noqa: B023, E731
        rising = np.argsort(count[often], kind="stable")  # the most frequent of a slot is written last
        owner, slots = np.full(1 << bits, -1, np.int32), slot(pairs)
        owner[slots[rising]] = rising
        waits = np.zeros(1 << bits, bool)  # slots of pairs that are not replaced in this round
        waits[slots[owner[slots] != np.arange(len(pairs))]] = True
        hit = slot(code)
        rule = owner[hit]
        known = np.flatnonzero(rule >= 0)
        same = pairs[rule[known]] == code[known]
        others = known[~same]
        hot = np.zeros(len(seq), bool)
        hot[places[others[waits[hit[others]]]]] = True
        known = known[same]
        at, rule = places[known], rule[known]
        hot[at] = True
        fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        every_other = (at - run) % 2 == 0  # of overlapping pairs
        at, rule = at[every_other], rule[every_other]
        used = np.flatnonzero(np.bincount(rule, minlength=len(pairs)))
        name = np.zeros(len(pairs), np.int64)
        name[used] = np.arange(len(used)) + len(sizes)
        left, right = (pairs[used] >> word(shift)).astype(np.int64), (pairs[used] & word((1 << shift) - 1)).astype(np.int64)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq[at] = name[rule]
        hot[at[at > 0] - 1] = True
        seq, hot = seq[keep], hot[keep]
        places = np.flatnonzero(hot[:-1])
        sizes = np.concatenate([sizes, sizes[left] + sizes[right]])
        rules.append(np.stack([left, right], axis=1).astype(np.uint32))
    return Grammar(first, np.concatenate(rules), sizes[first:].astype(np.uint32), seq)


class WordEncoder:
    """Ids of texts under a vocabulary that drops white space and case: each distinct piece is encoded once by the library.

    A word of Latin letters, with or without ASCII punctuation behind it, is known by its lower-case
    letters and the punctuation, which the vocabulary encodes apart; every other word is known as it stands.
    """

    def __init__(self, path: str, pieces: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.model = self.tok.model
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.most = pieces
        self.pieces: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, x: str) -> bytes | None:
        """Ids of one pre-token, Latin letters, which the model takes in lower case with a letter for each byte; of anything else none."""
        low = x.lower()
        if not low.isalpha() or not (x.isascii() or max(x) < "\u0250"):
            return None
        letters = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
        got = self.pieces[x] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return got

    def _marks(self, words: list[str]) -> list[bytes]:
        """Ids of words, or of punctuation behind a word, that the library takes as they stand."""
        new = [w for w in words if w not in self.marks]
        for at in range(0, len(new), 4096):
            self.marks.update(zip(new[at : at + 4096], self._ids(new[at : at + 4096]), strict=True))
        return [self.marks[w] for w in words]

    def words(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and each word's number of ids."""
        if len(self.pieces) > self.most:
            self.pieces.clear()
        if len(self.marks) > 100_000:
            self.marks.clear()
        # each word as what stands before its last punctuation and that, both in the words' own buffer
        offsets = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, 4 * distinct.offset)
        cuts = np.empty(2 * len(distinct) + 1, np.int32)
        cuts[::2] = offsets
        cuts[1::2] = offsets[:-1] + pc.binary_length(pc.utf8_rtrim(distinct, characters=string.punctuation)).to_numpy()
        halves = pa.StringArray.from_buffers(2 * len(distinct), pa.py_buffer(cuts), distinct.buffers()[2] or pa.py_buffer(b"")).dictionary_encode()
        at = halves.indices.to_numpy().astype(np.int64).reshape(-1, 2)
        texts, piece = halves.dictionary.to_numpy(zero_copy_only=False).tolist(), self.pieces.get
        data = [piece(x) or self._piece(x) for x in texts]
        letters = np.fromiter((x is not None for x in data), bool, len(data))[at[:, 0]]
        ends = np.flatnonzero(np.bincount(at[letters, 1], minlength=len(data))).tolist()
        for i, ids in zip(ends, self._marks([texts[i] for i in ends]), strict=True):
            data[i] = ids
        whole = self._marks(distinct.filter(pa.array(~letters)).to_pylist())
        at[~letters, 0] = len(data) + np.arange(len(whole))
        at[~letters, 1] = len(data) + len(whole)
        data = [*(x or b"" for x in data), *whole, b""]
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), pa.array(np.frombuffer(b"".join(data), "<u4")))
        return lists.take(pa.array(at.ravel())).flatten().to_numpy(), size[at].sum(axis=1)

    def encode(self, text: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and each text's number of ids."""
        text = pc.fill_null(text, "")
        if not pc.any(pc.match_substring(text, "<|")).as_py():  # else a special string could come about
            text = pc.ascii_lower(text)
        words = pc.ascii_split_whitespace(text)
        offsets = words.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        flat, size = self.words(coded.dictionary.cast(pa.string()))
        # a text's words, then one pseudo-word: the end id
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(np.append(size, 1))]), pa.array(np.append(flat, np.uint32(end))))
        ids = lists.take(pa.array(np.insert(codes, offsets[1:], len(size)))).flatten().to_numpy()
        return ids, sums(size[codes], offsets) + 1


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_token_blocks(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, block_ids: int = 2_000_000, rows_per_part: int = 250_000, slice_bytes: int = 1 << 22) -> DataFrame:
    """Encode every whole text and write the ids, in ascending doc_id order, as grammar-compressed blocks.

    Rows are range-partitioned by doc_id (null first, equal ids by content); a partition is a shard,
    cut after the document that fills ``block_ids``; texts are encoded by ``slice_bytes``. Each block has its own grammar. Blocks are rows
    of a Parquet table in the shared folder, so Spark's commit makes a retried task's output appear
    once. ``tokenizer`` names a public vocabulary whose words white space separates.
    """
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / rows_per_part))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = BLOCK_SCHEMA.format(id=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        enc = encoder(public_tokenizers.path(tokenizer))
        shard, block = TaskContext.get().partitionId(), 0
        ids, sizes, docs_, held = [], [], [], 0

        def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(), dtype=np.int64), 0
            while at < b.num_rows:
                to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + slice_bytes, side="right"))
                yield b.slice(at, max(1, to - at))
                at = max(at + 1, to)

        def flush() -> pa.RecordBatch:
            nonlocal ids, sizes, docs_, held, block
            g = repair(np.concatenate(ids), enc.size)
            size = np.concatenate(sizes)
            wide = "<u2" if enc.size + len(g.rules) <= 1 << 16 else "<u4"
            row = [[shard], [block], [pa.concat_arrays(docs_).to_pylist()], [size.astype("<u4").tobytes()], [enc.size], [g.rules.astype("<u4").tobytes()], [g.expansions.astype("<u4").tobytes()], [g.symbols.astype(wide).tobytes()], [int(size.sum())]]
            types = [pa.int32(), pa.int32(), pa.list_(docs_[0].type), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["shard", "block", "doc_ids", "lengths", "first", "rules", "expansions", "symbols", "n_ids"])
            ids, sizes, docs_, held, block = [], [], [], 0, block + 1
            pa.default_memory_pool().release_unused()
            return out

        for b in batches:
            for part in parts(b):
                x, size = enc.encode(part.column(1), end_id)
                ends, at, done = np.cumsum(size), 0, 0
                while at < len(size):
                    to = min(len(size), int(np.searchsorted(ends, done + block_ids - held)) + 1)
                    ids.append(x[done : ends[to - 1]])
                    sizes.append(size[at:to])
                    docs_.append(part.column(0).take(pa.array(np.arange(at, to))))  # a slice would keep the texts
                    held += int(ends[to - 1]) - done
                    at, done = to, int(ends[to - 1])
                    if held >= block_ids:
                        yield flush()
                del x, part
        if held:
            yield flush()

    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return materialize(placed.select("doc_id", "text").mapInArrow(run, schema), "token-blocks")


def grammar(first: int, rules: bytes, expansions: bytes, symbols: bytes) -> Grammar:
    r = np.frombuffer(rules, "<u4").reshape(-1, 2)
    wide = "<u2" if first + len(r) <= 1 << 16 else "<u4"
    return Grammar(first, r, np.frombuffer(expansions, "<u4"), np.frombuffer(symbols, wide).astype(np.uint32))


def read_token_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the written blocks.

    ``start`` counts the ids of all documents before it: the offset of its shard, of its block in the
    shard, and its own in the block. Only the counts of blocks are shuffled, never ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(k)[i] for k in b.schema.names}
                ids = grammar(*(row[k].as_py() for k in ("first", "rules", "expansions", "symbols"))).decode().astype("<u4", copy=False)
                size = np.frombuffer(row["lengths"].as_py(), "<u4").astype(np.int64)
                ends = np.cumsum(size)
                view = memoryview(ids).cast("B")
                crc = np.fromiter((zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)), np.int64, len(size))
                k = len(size)
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(np.full(k, row["shard"].as_py(), np.int32)), pa.array(np.full(k, row["block"].as_py(), np.int32)), pa.array(ends - size), pa.array(size), pa.array(crc)], ["doc_id", "shard", "block", "at", "n_tokens", "ids_crc32"])
                del ids, view
                pa.default_memory_pool().release_unused()

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = materialize(blocks.select("shard", "block", "n_ids"), "token-sizes")
    ahead = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select(F.col("shard").alias("s"), ahead(W.orderBy("shard")).alias("shard_at"))
    places = sizes.select("shard", "block", ahead(W.partitionBy("shard").orderBy("block")).alias("block_at"))
    places = places.join(shards, F.col("shard") == F.col("s")).select(F.col("shard").alias("s"), F.col("block").alias("b"), (F.col("block_at") + F.col("shard_at")).alias("base"))
    found = blocks.mapInArrow(run, f"doc_id {kind}, shard int, block int, at long, n_tokens long, ids_crc32 long")
    out = found.join(broadcast_if_small(places, sizes.count()), (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")))
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(blocks: DataFrame, wanted: DataFrame, few: int = 100_000) -> DataFrame:
    """(doc_id, ids) of the documents whose doc_id is in ``wanted``: random access, only the symbols that cover a document are expanded.

    Blocks without such a document are not decoded. Null ids find nothing; a repeated doc_id gives a row each; ``wanted`` has no repeats to speak of.
    """
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    wanted = wanted.select("doc_id").where("doc_id is not null").distinct()
    at = blocks.select("shard", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    places = at.join(broadcast_if_small(wanted, wanted.count(), few), "doc_id", "left_semi")
    places = places.groupBy("shard", "block").agg(F.sort_array(F.collect_list("place")).alias("places")).select(F.col("shard").alias("s"), F.col("block").alias("b"), "places")
    held = blocks.join(places, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b"))).select(*blocks.columns, "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(k)[i] for k in b.schema.names}
                g = grammar(*(row[k].as_py() for k in ("first", "rules", "expansions", "symbols")))
                ends = np.cumsum(np.frombuffer(row["lengths"].as_py(), "<u4").astype(np.int64))
                places = row["places"].as_py()
                ids = [g.decode(int(ends[j - 1]) if j else 0, int(ends[j])).astype(np.int64) for j in places]
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values.take(pa.array(places)), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return held.mapInArrow(run, f"doc_id {kind}, ids array<long>")


def token_output(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Write the token blocks of ``docs`` and return each document's place and digest as read back.

    Null and empty texts have the end id alone; repeated ids and rows are documents of their own, in
    an order by content; an empty table gives an empty table; other columns are not read.
    """
    return read_token_blocks(write_token_blocks(docs, tokenizer, end_id))
