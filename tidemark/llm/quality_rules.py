"""Quality rules with DataFrame functions only: counts and distribution divergence.

A document's histogram of character classes and of common words is compared with
that of its language, by Jensen-Shannon distance. The references are sums over
all documents of the language that pass the base rules. Documents too short for
a histogram are not judged by it. Which words are common is learned from the table,
for every language in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import lookup_join, materialize, materialize_observed

# White space between words, and symbol characters.
BLANKS = r" \x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"

# Common words of a language, one letter each.
MOST_COMMON = 26
# With more languages the lists stay off the driver, with equal results.
FEW_LANGUAGES = 200

# Character classes, counted by taking each out of what the ones before left.
CLASSES = {
    "lower": "[a-z]+",
    "blank": r"\s+",
    "upper": "[A-Z]+",
    "letter": r"[\p{L}\p{M}]+",
    "digit": r"\p{N}+",
    "stop": r"[.,;:!?'\"()-]+",
}


@dataclass(frozen=True)
class Settings:
    """Base limits, the largest distances, and the least sizes they apply from.

    A distance may exceed its limit by the noise of a small sample, ``noise``
    over the square root of the characters or words. With its noise, the limit of the
    word distance stays under ``none_listed`` of the distance that a text without any
    listed word has from its reference, so such texts go from ``least_listed`` words on.
    A word can be listed if ``common_percent`` of the language's documents have it, and
    two at least.
    """

    least_words: int = 10
    repeat_percent: int = 20
    class_distance: float = 0.2
    class_noise: float = 3.0
    word_distance: float = 0.12
    word_noise: float = 2.0
    none_listed: float = 0.97
    least_chars: int = 200
    least_listed: int = 50
    common_percent: int = 20


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+"))


def common_words(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang, listed``: the words in most documents of every language, without case.

    Words in equally many documents go by the word. A null language has no list.
    """
    rows = documents.where("lang is not null").select("lang", F.array_distinct(_words(F.lower(F.coalesce("text", F.lit(""))))).alias("w"))
    rows = rows.where("size(w) > 0").select("lang", F.explode(F.concat("w", F.array(F.lit("")))).alias("word"))
    counts = materialize(rows.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    # The empty word counts the documents.
    found = lookup_join(counts.where("word <> '' and n > 1"), counts.where("word = ''").selectExpr("lang", "n as documents"), ["lang"])
    found = found.where(f"100 * n >= {settings.common_percent} * documents")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    found = found.where(f"place <= {MOST_COMMON}").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("l"))
    return found.select("lang", F.col("l.word").alias("listed"))


def _base(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The base counts of ``text``; ``words`` stays for the histograms."""
    rows = rows.withColumn("_t", F.coalesce("text", F.lit("")))
    rows = rows.select(*keep, "_t", _words(F.col("_t")).alias("words"))
    full = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    rows = rows.withColumns({"_h": F.transform("words", lambda x: F.xxhash64(x)), "_lines": full})
    window = F.transform(
        F.sequence(F.lit(0), F.size("_h") - 5), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(5)])
    )
    rows = rows.withColumn("_w", F.when(F.size("_h") >= 5, window).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_w")) < F.size("_w")
    ordered = F.array_sort(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(again, ordered))
    last = F.size("_s") - 1

    def repeats(x: Column, k: Column) -> Column:
        before, after = F.get(F.col("_s"), k - 1), F.get(F.col("_s"), k + 1)
        return ((k > 0) & (before["h"] == x["h"])) | ((k < last) & (after["h"] == x["h"]))

    rows = rows.withColumn("_p", F.array_sort(F.transform(F.filter("_s", repeats), lambda x: x["i"])))
    following = F.concat(F.expr("slice(_p, 2, size(_p))"), F.array(F.element_at("_p", -1) + 5))
    covered = F.aggregate(F.zip_with("_p", following, lambda a, b: F.least(b - a, F.lit(5))), F.lit(0), lambda s, x: s + x)
    return rows.select(
        *keep, "_t", "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_s").isNotNull(), covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _histograms(rows: DataFrame, keep: list[str], candidates: list[str] | None) -> DataFrame:
    """``classes`` and ``common``: counts by character class, by common word and of other words.

    ``candidates`` are the common words of all languages, if known: most words are in no list.
    """
    left, counts = "_t", []
    for name, pattern in CLASSES.items():
        rows = rows.withColumn(f"_{name}", F.regexp_replace(left, pattern, ""))
        counts.append((F.length(left) - F.length(f"_{name}")).cast("double"))
        left = f"_{name}"
    letters = "".join(chr(97 + k) for k in range(MOST_COMMON))
    # Each common word as one letter, so counts are lengths.
    known = F.filter(F.transform("words", F.lower), (lambda x: x.isin(candidates)) if candidates else (lambda x: F.array_contains("_listed", x)))
    coded = F.transform(known, lambda x: F.substring(F.lit("-" + letters), F.array_position(F.col("_listed"), x).cast("int") + 1, F.lit(1)))
    rows = rows.withColumn("_coded", F.array_join(coded, ""))
    common = [(F.length("_coded") - F.length(F.replace("_coded", F.lit(c)))).cast("double") for c in letters]
    common.append(F.when(F.size("_listed") > 0, F.size("words") - F.length(F.replace("_coded", F.lit("-")))).otherwise(0).cast("double"))
    return rows.select(*keep, F.array(*counts, F.length(left).cast("double")).alias("classes"), F.array(*common).alias("common"))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def jensen_shannon(one: str, two: str) -> Column:
    """Distance of two histograms of counts, from 0 to 1; null if one is empty."""

    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    def shares(counts: str) -> Column:
        total = F.nullif(F.col(f"_{counts}_total"), F.lit(0.0))
        return F.transform(F.col(counts), lambda v: v / total)

    terms = F.zip_with(shares(one), shares(two), lambda p, q: (half(p, q) + half(q, p)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.round(_total(terms), 12)))


def judge(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Base counts, distances and verdict of every row of ``documents``.

    ``doc_id``, the counts, ``base_failed``, ``class_distance``, ``word_distance``
    (null under the least sizes: fewer characters, fewer words, or a
    language without common words) and ``kept``. A null text has no words; a null
    ``lang`` has a reference of its own for the character classes only. An
    empty table gives no rows; other columns are not looked at.
    """
    rows = documents.select("doc_id", "text", "lang")
    learned, seen = materialize_observed(common_words(documents, settings), "common", F.count(F.lit(1)).alias("languages"))
    rows = lookup_join(rows, learned, ["lang"], "left", seen["languages"], MOST_COMMON)
    # At most MOST_COMMON words of every language, of which there are few in most tables.
    few = seen["languages"] <= FEW_LANGUAGES
    candidates = sorted({w for r in learned.collect() for w in r.listed}) if few else None
    rows = rows.withColumn("_listed", F.coalesce("listed", F.array().cast("array<string>")))
    rows = _histograms(_base(rows, ["doc_id", "lang", "_listed"]), ["doc_id", "lang", *BASE], candidates)
    failed = (F.col("n_words") < settings.least_words) | (100 * F.col("n_repeat_words") > settings.repeat_percent * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed), "histograms")

    n_classes, n_common = len(CLASSES) + 1, MOST_COMMON + 1
    sums = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for c, n in (("classes", n_classes), ("common", n_common)) for k in range(n)]
    found = rows.where("not base_failed").groupBy("lang").agg(*sums)
    found = found.select(
        "lang",
        F.array(*[f"classes{k}" for k in range(n_classes)]).alias("all_classes"),
        F.array(*[f"common{k}" for k in range(n_common)]).alias("all_common"),
    )
    rows = lookup_join(rows, found, ["lang"], "left")
    for c in ("classes", "common"):
        rows = rows.withColumns({f"_{c}_total": _total(F.col(c)), f"_all_{c}_total": _total(F.col(f"all_{c}"))})
    class_distance = F.when(F.col("_classes_total") >= settings.least_chars, jensen_shannon("classes", "all_classes"))
    word_distance = F.when(F.col("_common_total") >= settings.least_listed, jensen_shannon("common", "all_common"))
    rows = rows.withColumns({"class_distance": class_distance, "word_distance": word_distance})
    # The distance of a text that has only words that are not listed.
    nothing = F.array(*[F.lit(0.0)] * (n_common - 1), F.lit(1.0))
    rows = rows.withColumns({"none": nothing, "_none_total": F.lit(1.0)}).withColumn("_farthest", jensen_shannon("none", "all_common"))
    noisy = settings.word_distance + settings.word_noise / F.sqrt("_common_total")
    limits = {
        "class_distance": settings.class_distance + settings.class_noise / F.sqrt("_classes_total"),
        "word_distance": F.least(noisy, settings.none_listed * F.col("_farthest")),
    }
    far = F.lit(False)
    for name, limit in limits.items():
        far |= F.coalesce(F.col(name) > limit, F.lit(False))
    return rows.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")
