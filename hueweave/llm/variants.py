"""Spelling variants: words one edit apart, found by pairs of trie nodes; each word's more frequent form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hueweave.operators.ranking import number_rows
from hueweave.runtime import materialize

#: A word's characters: the letters A to Z in either case and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def typed_words(documents: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """(word, n): how often each word of at least ``least`` code points occurs in (doc_id, text) rows, A to Z lower-cased.

    Typing errors are put in by rule: where the CRC-32 of ``<doc_id>:<run>`` is a multiple of ``every``, the run loses the code point
    that the CRC names. Null texts have no words; a null doc_id counts as empty. Runs become words in expressions and are counted before they are shuffled.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    rows = rows.select("d", F.translate("run", _UPPER, _LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _trie(words: DataFrame, key: str) -> DataFrame:
    """Add ``nodes``: for each length from 0 on, the number of the trie node of that prefix of ``key`` (distinct strings, of any alphabet).

    Words are sorted over ranges. In a range, a word shares the nodes of what it has in common with the word before and opens
    new ones for the rest, so only the last word's nodes are held. A range's numbers start after those of the ranges before it, and
    the nodes that its first word shares with the range before are theirs: that takes one row a range.
    """
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = [f for f in words.schema if f.name != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, nodes, last = "", [0], 0
        for b in batches:
            lists, ends = [], [0]
            for x in b.column(0).to_pylist():
                shared, most = 0, min(len(x), len(before))
                while shared < most and x[shared] == before[shared]:
                    shared += 1
                new = len(x) - shared
                nodes = nodes[: shared + 1] + list(range(last + 1, last + 1 + new))
                last, before = last + new, x
                lists += nodes
                ends.append(len(lists))
            column = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(lists, np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, "nodes"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (words.schema[key], *others))
    rows = words.select(key, *[f.name for f in others]).repartitionByRange(n, key).sortWithinPartitions(key)
    rows = materialize(rows.mapInArrow(run, f"{types}, nodes array<long>").withColumn("part", F.spark_partition_id()), "trie")
    ranges = rows.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("nodes", key).alias("path"), F.max(F.array_max("nodes")).alias("made"))
    ahead, before, path, shift = 0, "", [0], []
    for r in ranges.orderBy("part").collect():  # a row a range
        shared, most = 0, min(len(r["first"]), len(before))
        while shared < most and r["first"][shared] == before[shared]:
            shared += 1
        theirs = path[: shared + 1]  # what the first word has in common with the range before
        shift.append((r["part"], theirs, ahead - shared))
        path = [theirs[x] if x <= shared else x + ahead - shared for x in r["path"]]
        ahead, before = ahead + r["made"] - shared, r["last"]
    table = F.broadcast(words.sparkSession.createDataFrame(shift, "p int, theirs array<long>, shift long"))
    own = F.transform("nodes", lambda x: F.when(x < F.size("theirs"), F.element_at("theirs", (x + 1).cast("int"))).otherwise(x + F.col("shift")))
    return rows.join(table, F.col("part") == F.col("p")).select(key, *[f.name for f in others], own.alias("nodes"))


def near_words(words: DataFrame) -> DataFrame:
    """(wid, word, n, n_near, form_id, form_n) of distinct words (word, n): how many words are one code point apart (inserted, deleted or replaced), and the most frequent of them.

    ``wid`` numbers words in code-point order. Each word gives, for each place, the pair of the forward trie's node before it and
    the backward trie's node after it, once with the place's code point skipped and once with a place put in between. Two words
    that skip at one pair differ in that code point; a word that skips at another's pair in between has one more. So a pair
    has at most one word in between and one for each code point of the alphabet that skip. Where equal code points stand in a row only
    the last is skipped for insertions, so each neighbour comes up once. Ties go to the word that is first in code-point order.
    """
    numbered = materialize(number_rows(words.select("word", "n"), "wid", ["word"]).select("word", "n", "wid"), "words")
    forward = _trie(numbered, "word").select("wid", "n", "word", F.col("nodes").alias("pre"))
    backward = _trie(numbered.select(F.reverse("word").alias("turned"), "wid"), "turned").select(F.col("wid").alias("w"), F.reverse("nodes").alias("suf"))
    both = forward.join(backward, F.col("wid") == F.col("w"))
    at = lambda c, i: F.element_at(c, i + 1)
    last = lambda i: (F.substring("word", i + 1, F.lit(1)) != F.substring("word", i + 2, F.lit(1)))
    skip = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.struct(at("pre", i).alias("a"), at("suf", i + 1).alias("b"), F.when(last(i), 2).otherwise(1).alias("kind")))
    gap = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.struct(at("pre", i).alias("a"), at("suf", i).alias("b"), F.lit(0).alias("kind")))
    pairs = both.where("length(word) > 0").select("wid", "n", F.explode(F.concat(skip, gap)).alias("p")).select("p.a", "p.b", "p.kind", "wid", "n")
    group = W.partitionBy("a", "b").orderBy(F.col("n").desc(), "wid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    mine = F.struct("n", (-F.col("wid")).alias("w"))
    on = lambda kinds: F.when(F.col("kind").isin(*kinds), mine)
    at_pair = pairs.select(
        "wid", "kind", F.count_if(F.col("kind") > 0).over(group).alias("skips"), F.count_if(F.col("kind") == 2).over(group).alias("longer"),
        F.first(on([0]), True).over(group).alias("between"), F.first(on([2]), True).over(group).alias("longest"),
        F.first(on([1, 2]), True).over(group).alias("first"), F.nth_value(on([1, 2]), 2, True).over(group).alias("second"),
    )
    in_between, shorter = F.col("kind") == 0, F.when(F.col("kind") == 2, F.col("between"))
    replaced = F.when(F.col("first.w") != -F.col("wid"), F.col("first")).otherwise(F.col("second"))
    found = at_pair.select(
        "wid", F.when(in_between, F.col("longer")).otherwise(F.col("skips") - 1 + shorter.isNotNull().cast("long")).alias("near"),
        F.when(in_between, F.col("longest")).otherwise(F.greatest(replaced, shorter)).alias("best"),
    ).where("near > 0")
    found = found.groupBy("wid").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")).withColumnRenamed("wid", "w")
    out = numbered.join(found, F.col("wid") == F.col("w"), "left")
    return out.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.w")).alias("form_id"), F.col("best.n").alias("form_n"))


def _roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(wid, root_id): where the chain of (wid, form_id) ends. Each round doubles the steps, and counts grow tenfold along a chain, so a few rounds do."""
    reached = materialize(forms.select("wid", F.col("form_id").alias("root_id")), "forms")
    for _ in range(max_rounds):
        onward = reached.select(F.col("wid").alias("via"), F.col("root_id").alias("onward"))
        step = materialize(reached.join(onward, F.col("root_id") == F.col("via"), "left").select("wid", F.coalesce("onward", "root_id").alias("root_id"), F.col("onward").isNotNull().alias("moved")), "forms")
        reached = step.select("wid", "root_id")
        if step.where("moved").isEmpty():
            return reached
    raise RuntimeError("chains of forms did not end")


def variant_forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    A word's form is its most frequent near word (ties: the first in code-point order) if that is at least ``ratio`` times as
    frequent; its root is where forms lead, the word itself if it has none. ``ratio`` is over 1. An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    near = near_words(words.where(F.col("word").isNotNull()))
    formed = F.col("form_n") >= ratio * F.col("n")
    near = materialize(near.select("wid", "word", "n", "n_near", F.when(formed, F.col("form_id")).alias("form_id"), F.when(formed, F.col("form_n")).alias("form_n")), "near-words")
    roots = _roots(near.where("form_id is not null")).select(F.col("wid").alias("r"), "root_id")
    spelt = near.select(F.col("wid").alias("id"), F.col("word").alias("spelt"))
    linked = near.where("form_id is not null").join(roots, F.col("wid") == F.col("r"))
    linked = linked.join(spelt.select(F.col("id").alias("f"), F.col("spelt").alias("form")), F.col("form_id") == F.col("f")).join(spelt, F.col("root_id") == F.col("id"))
    alone = near.where("form_id is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return linked.select("word", "form", F.col("spelt").alias("root"), "n", "n_near", "form_n").unionByName(alone)


def group_variants(documents: DataFrame, least: int = 7, occurs: int = 2, every: int = 31, ratio: int = 10) -> DataFrame:
    """``variant_forms`` of the words of (doc_id, text) rows that have ``least`` code points and occur ``occurs`` times at least."""
    return variant_forms(typed_words(documents, least, every).where(F.col("n") >= occurs), ratio)
