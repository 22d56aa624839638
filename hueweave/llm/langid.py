"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hueweave.llm.textutil import coded_words, sums


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of a word's letters as a whole and of their 2- to 4-grams with end marks; none without a letter."""
    w = word.lower()
    if not w.isalpha():
        w = "".join(filter(str.isalpha, w))
        if not w:
            return []
    b = f"<{w}>"
    if len(b) > 66:  # a very long run of letters: its grams say enough, and there are as many as letters
        grams = {b[i : i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1)}
    else:
        grams = [b[i : i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1)] + [b]
    return [zlib.crc32(g.encode("utf-8", "replace")) % buckets for g in sorted(grams)]


@dataclass
class LanguageModel:
    """``table`` holds each bucket's embedding times the output weights, so a text's logits are a mean of its rows."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    words: int = 700_000
    cache: dict[str, tuple[float, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def _words(self, distinct: list[str]) -> np.ndarray:
        """A row for each word: the sum of its subwords' rows, and their number."""
        out = np.zeros((len(distinct), len(self.langs) + 1))
        new = []
        for i, w in enumerate(distinct):
            row = self.cache.get(w)
            if row is None:
                new.append(i)
            else:
                out[i] = row
        if len(self.cache) + len(new) > self.words:
            self.cache.clear()
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            ids = [subwords(distinct[i], len(self.table)) for i in some]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.int64, int(n.sum()))
            out[some] = np.concatenate([sums(self.table[flat].astype(np.float64), np.concatenate([[0], np.cumsum(n)])), n[:, None]], axis=1)
            for i in some:
                if len(distinct[i]) < 64 and len(self.cache) < self.words:
                    self.cache[distinct[i]] = tuple(out[i].tolist())
        return out

    def predict(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each text (-1 without a letter) and the calibrated score."""
        offsets, codes, distinct = coded_words(text)
        rows = sums(self._words(distinct)[codes], offsets) if len(codes) else np.zeros((len(text), len(self.langs) + 1))
        n = rows[:, -1]
        z = (rows[:, :-1] / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True)) if z.shape[1] else z
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        if not z.shape[1]:
            return np.full(len(text), -1), np.zeros(len(text))
        return np.where(n > 0, p.argmax(axis=1), -1), np.where(n > 0, p.max(axis=1), 0.0)


def train(samples: list[tuple[str, str]], buckets: int = 1 << 16, dim: int = 16, epochs: int = 4, span: int = 24, windows: int = 12_000, rate: float = 2.0, seed: int = 7) -> LanguageModel:
    """Fit on (lang, text) samples by stochastic gradient descent over about ``windows`` windows of ``span`` words, 400 of each language at least.

    A fifth of the windows is held back to fit the temperature, and the least score at
    which 99 of 100 held-back windows are right.
    """
    langs = sorted({x for x, _ in samples})
    if not langs:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    each = max(400, windows // len(langs))
    xs: list[np.ndarray] = []
    ys: list[int] = []
    for k, lang in enumerate(langs):
        mine = [w for x, t in samples if x == lang for words in [t.split()] for i in range(0, len(words), span) if (w := words[i : i + span])]
        for i in rng.permutation(len(mine))[:each]:
            size = int(rng.integers(2, span + 1))
            if ids := [b for w in mine[i][:size] for b in subwords(w, buckets)]:
                xs.append(np.array(ids))
                ys.append(k)
    if not xs:
        return LanguageModel(langs, np.zeros((buckets, len(langs)), np.float32), np.zeros(len(langs)))
    y = np.array(ys)
    order = rng.permutation(len(xs))
    back, fit = order[: len(xs) // 5], order[len(xs) // 5 :]
    emb = rng.normal(0, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    steps, batch, done = epochs * max(1, len(fit) // 32), 32, 0
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for at in range(0, len(fit), batch):
            pick = fit[at : at + batch]
            n = np.array([len(xs[i]) for i in pick])
            flat = np.concatenate([xs[i] for i in pick])
            h = np.add.reduceat(emb[flat], np.concatenate([[0], np.cumsum(n)[:-1]])) / n[:, None].astype(np.float32)
            z = h @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            lr = np.float32(rate * max(0.02, 1 - done / steps))
            g = p @ out.T
            out -= lr * (h.T @ p) / len(pick)
            bias -= lr * p.mean(axis=0)
            np.add.at(emb, flat, -lr * np.repeat(g / n[:, None].astype(np.float32), n, axis=0))
            done += 1
    table = emb @ out
    model = LanguageModel(langs, table, bias.astype(np.float64))
    held = back if len(back) else fit
    z = np.array([table[xs[i]].mean(axis=0) + bias for i in held], np.float64)

    def scores(t: float) -> np.ndarray:
        p = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(np.maximum(scores(t)[np.arange(len(held)), y[held]], 1e-12)).mean()))
    p = scores(model.temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    rank = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[rank]) >= 0.99 * np.arange(1, len(rank) + 1))
    model.least_score = float(best[rank[good[-1]]]) if len(good) else 1.0
    return model


def held_out() -> Column:
    """True for documents that never serve to fit: crc32 of the id's text, mod 4, is 2. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, rows: int = 800, most: int = 50_000, chars: int = 2_000) -> LanguageModel:
    """Fit on a bounded sample: about ``rows`` rows of each language, fewer if all languages together had over ``most``
    rows, and of each row a stretch of ``chars`` characters at a place that depends on the row.

    Every language of the rows that are not held out is learned. The sample is by a hash of doc_id and the row order is
    fixed, so reruns agree; the driver gets at most ``most`` x ``chars`` characters.
    """
    fit = docs.select("doc_id", "lang", "text").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = fit.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a short row for each language
    if not n:
        return train([])
    each = min(rows, max(1, most // len(n)))
    share = F.create_map(*[x for r in n for x in (F.lit(r["lang"]), F.lit(min(1.0, each / r["n"])))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    picked = fit.where(place < share[F.col("lang")]).select("lang", "doc_id", F.substring("text", start.cast("int"), F.lit(chars)).alias("text"))
    got = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(most).collect()
    return train([(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["lang"], str(r["doc_id"]), r["text"]))])


def identify_languages(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row's whole text.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned. ``accepted`` is the calibrated rejection: the score reaches the level at which 99 of 100
    held-back windows were right. Repeated rows come back each; an empty table gives an empty table.
    The broadcast model has one row of numbers for each bucket, whatever the size of the corpus.
    """
    model = model or fit_languages(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for b in (batch.slice(at, 1000) for batch in batches for at in range(0, batch.num_rows, 1000)):
            k, score = m.predict(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[k], pa.string()), pa.array(score), pa.array((score >= m.least_score) & (k >= 0))], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
