"""Quality rules: base counts and distribution divergence, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hueweave.llm.textutil import WORD
from hueweave.runtime import materialize

# Frequent function words of the four languages that the tables hold.
COMMON_WORDS = (
    "the of and to in a is that it for "
    "de la que el y los del se las por "
    "der die und das von zu mit den ist nicht "
    "le et les des une un en est du pour"
).split()

#: One character for each common word: a text's common words become a short string of these.
CODES = "".join(chr(ord("0") + i) for i in range(len(COMMON_WORDS)))

CLASSES = ["space", "digit", "upper", "punct", "symbol", "wide", "plain"]


def _repeat_words(d: DataFrame, window_hash: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """Add n_repeat_words: words inside 3-word windows that the text holds twice or more.

    Only texts whose window hashes are not all distinct go on: hash and place are packed into one
    long, a sort of longs brings equal windows together, and neighbours that agree in the hash
    bits are compared word by word. If any of these differ, the text's windows are sorted as strings instead.
    """
    words, s, keep = F.col("_hw_words"), F.col("_hw_packed"), F.bitwise_not(F.col("_hw_mask"))
    windows = (F.size(words) - 2).cast("int")
    hashes = F.when(windows > 0, F.transform(F.sequence(F.lit(0), windows - 1), lambda i: window_hash(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    d = d.withColumns({"_hw_hash": hashes, "_hw_mask": F.expr("shiftleft(1L, length(bin(cast(size(_hw_words) as bigint)))) - 1")})
    packed = F.when(F.size(F.array_distinct("_hw_hash")) < F.size("_hw_hash"), F.sort_array(F.transform("_hw_hash", lambda x, i: x.bitwiseAND(keep).bitwiseOR(i.cast("long")))))
    d = d.withColumn("_hw_packed", packed)
    at = lambda i: F.get(s, i).bitwiseAND(F.col("_hw_mask")).cast("int")
    equal = lambda i, j: (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))
    bits = lambda x, j: F.coalesce((x.bitwiseXOR(F.get(s, j)) <= F.col("_hw_mask")) & (x.bitwiseXOR(F.get(s, j)) >= 0), F.lit(False))
    met = F.filter(s, lambda x, i: bits(x, i - 1) | bits(x, i + 1))
    clash = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: bits(F.get(s, i), i - 1) & ~equal(at(i), at(i - 1)))
    spelt = F.sort_array(F.transform(F.sequence(F.lit(0), windows - 1), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))
    d = d.withColumn("_hw_spelt", F.when((F.size(s) > 1) & clash, spelt))
    z = F.col("_hw_spelt")
    twin = lambda x, j: F.coalesce(x["w"] == F.get(z, j)["w"], F.lit(False))
    plain = F.transform(F.filter(z, lambda x, i: twin(x, i - 1) | twin(x, i + 1)), lambda x: x["i"])
    quick = F.transform(met, lambda x: x.bitwiseAND(F.col("_hw_mask")).cast("int"))
    starts = F.when(z.isNotNull(), F.sort_array(plain)).when(F.size(s) > 1, F.sort_array(quick))
    d = d.withColumn("_hw_starts", starts)
    p = F.col("_hw_starts")
    covered = F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0), lambda acc, i: acc + F.least(F.lit(3), F.coalesce(F.get(p, i) - F.get(p, i - 1), F.lit(3))))
    return d.withColumn("n_repeat_words", F.coalesce(F.when(F.size(p) > 0, covered), F.lit(0)).cast("long"))


def quality_features(docs: DataFrame) -> DataFrame:
    """Add the base counts, ``classes`` (a count for each of CLASSES, in bytes or characters) and
    ``common`` (a count for each common word, as written) to each row, without a shuffle.

    Null text counts as empty: every count is 0. Columns so named are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_hw_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    words = F.col("_hw_words")
    d = d.withColumns({"n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long")})
    n = F.col("n_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    gone = lambda cls: F.length(text) - F.length(F.regexp_replace(text, cls, ""))
    d = _repeat_words(d)
    code = F.array_join(F.transform(F.filter(words, lambda w: w.isin(*COMMON_WORDS)), lambda w: F.substring(F.lit(CODES), F.array_position(F.array(*map(F.lit, COMMON_WORDS)), w).cast("int"), F.lit(1))), "")
    d = d.withColumns(
        {
            "_hw_lines": lines,
            "_hw_code": code,
            "n_symbols": gone(r"[#*$%&|<>]+").cast("long"),
            "_hw_digit": gone("[0-9]+").cast("long"),
            "_hw_upper": gone("[A-Z]+").cast("long"),
            "_hw_punct": gone(r"""[.,;:!?'"()\-]+""").cast("long"),
            "_hw_chars": F.length(text).cast("long"),
            "_hw_octets": F.octet_length(text).cast("long"),
        }
    )
    d = d.withColumn("n_dup_lines", (F.size("_hw_lines") - F.size(F.array_distinct("_hw_lines"))).cast("long"))
    wide = F.col("_hw_octets") - F.col("_hw_chars")
    space = F.col("_hw_chars") - F.col("word_chars")
    known = space + F.col("_hw_digit") + F.col("_hw_upper") + F.col("_hw_punct") + F.col("n_symbols") + wide
    d = d.withColumns(
        {
            "classes": F.array(space, F.col("_hw_digit"), F.col("_hw_upper"), F.col("_hw_punct"), F.col("n_symbols"), wide, F.greatest(F.lit(0), F.col("_hw_octets") - known)),
            "common": F.array(*[(F.length("_hw_code") - F.length(F.replace("_hw_code", F.lit(c)))).cast("long") for c in CODES]),
            "base_failed": (n < 50) | (100 * F.col("n_repeat_words") > 50 * n),
        }
    )
    return d.drop(*[c for c in d.columns if c.startswith("_hw_")])


def references(features: DataFrame) -> list[tuple[list[float], list[float], str]]:
    """Class and common-word distributions of each language, and the language, over all rows that pass the base rule.

    Every language is a reference; the driver holds one short row for each.
    """
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, k in (("classes", len(CLASSES)), ("common", len(COMMON_WORDS))) for i in range(k)]
    rows = features.where("lang is not null and not base_failed").groupBy("lang").agg(F.sum("n_words").alias("total"), *sums).orderBy("lang").collect()
    out = []
    for r in rows:
        classes = [r[f"classes{i}"] for i in range(len(CLASSES))]
        common = [r[f"common{i}"] for i in range(len(COMMON_WORDS))]
        if sum(classes):
            out.append(([c / sum(classes) for c in classes], [c / r["total"] for c in common] + [1 - sum(common) / r["total"]], r["lang"]))
    return out


def _divergence(counts: Column, total: Column, ref: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, so 0 to 1) of counts / total to a reference."""

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    q = F.array(*[F.lit(float(x)) for x in ref])
    parts = F.zip_with(counts, q, lambda c, y: (term(c / total, (c / total + y) / 2) + term(y, (c / total + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def bare_distance(ref: list[float]) -> float:
    """Jensen-Shannon distance of a text without any common word to a common-word reference (whose last part is the other words)."""
    m = (1 + ref[-1]) / 2
    rest = ref[-1] * math.log2(ref[-1] / m) if ref[-1] else 0.0
    return math.sqrt(max(0.0, (1 - ref[-1] - math.log2(m) + rest) / 2))


def judge(
    features: DataFrame,
    refs: list[tuple[list[float], list[float], str]],
    most_class: float = 0.3,
    most_common: float = 0.6,
    least_chars: int = 200,
    least_words: int = 80,
    bare_share: float = 0.9,
    least_common: float = 0.05,
) -> DataFrame:
    """Add ``class_distance``, ``common_distance`` (to the nearest reference, rounded to 6 places) and ``kept``.

    Texts under ``least_chars`` bytes or ``least_words`` words are too short for the
    respective distance, which is then null and rejects nothing; so are texts of a language without
    reference, and all without references. Texts without a language are judged by every reference.

    A text fails on common words if its distance to each reference is over ``most_common`` or over ``bare_share``
    of the distance that a text without any common word has to it. References with fewer than ``least_common``
    common words (languages that the list does not cover) have no such share and count for texts of their language only.
    """
    classes_total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    common = F.concat(F.col("common"), F.array(F.greatest(F.lit(0).cast("long"), F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x))))
    f = features.withColumns({"_hw_total": classes_total, "_hw_common": common})
    none = F.lit(None).cast("double")
    known = F.col("lang").isNull() | F.col("lang").isin([r[2] for r in refs])
    enough = (known & (F.col("n_words") >= max(1, least_words))) if refs else F.lit(False)
    least = lambda xs: F.array_min(F.array(*xs)) if xs else none
    f = f.withColumns(
        {
            "class_distance": F.when(known & (F.col("_hw_total") >= least_chars), F.round(least([_divergence(F.col("classes"), F.col("_hw_total"), r[0]) for r in refs]), 6)).otherwise(none),
            "_hw_away": F.when(enough, F.array(*[_divergence(F.col("_hw_common"), F.col("n_words"), r[1]) for r in refs])) if refs else none,
        }
    )
    near = F.lit(False)
    for i, (_, ref, lang) in enumerate(refs):
        away = F.get("_hw_away", F.lit(i))
        if 1 - ref[-1] >= least_common:
            near = near | (away <= min(most_common, bare_share * bare_distance(ref)))
        else:
            near = near | ((away <= most_common) & (F.col("lang").isNull() | (F.col("lang") == lang)))
    f = f.withColumn("common_distance", F.round(F.array_min("_hw_away"), 6) if refs else none)
    bad = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > most_class) | (enough & ~F.coalesce(near, F.lit(False)))
    return f.withColumn("kept", ~F.col("base_failed") & ~bad).drop("_hw_total", "_hw_common", "_hw_away")


def quality_rules(docs: DataFrame, **thresholds: float) -> DataFrame:
    """Add the base counts, both distances, ``base_failed`` and ``kept`` to each row.

    The features are written once; the references are sums over them, and the verdict is a
    narrow pass with the references as literals. Null text fails the base rule; null languages
    give no reference but are judged; repeated rows are judged alike; an empty table gives an
    empty table; added columns replace columns of the same name.
    """
    held = [c for c in docs.columns if c not in ("text", "lang")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in held], F.lit(0).alias("_hw_none")).alias("held"), "text", "lang")  # no name of the input meets a helper's
    features = materialize(quality_features(rows), "quality")
    added = [c for c in features.columns if c not in ("held", "text", "lang", "classes", "common")] + ["class_distance", "common_distance", "kept"]
    own = [F.col(c) if c in ("text", "lang") else F.col("held")[c].alias(c) for c in docs.columns if c not in added]
    return judge(features, references(features), **thresholds).select(*own, *added)
