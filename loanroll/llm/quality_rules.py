"""Quality rules: Jensen-Shannon divergence of a text's histograms from language references.

Two histograms describe a text: its characters by class and its words by the
common words of four languages (all other words are one entry; punctuation
around a word is left out). A text is rejected if, against every reference, its
character-class divergence or its common-word divergence exceeds a limit. The
limit of the words follows from the reference and the text's length: it is a
share of the divergence of a text without any common word, the larger the
shorter the text, but always below 1. Texts shorter than a minimum number of
words are not judged by divergence.

A language's reference is made of the documents of that language in the table,
so that junk does not set it: over all of them that have the minimum of words,
the median share of each character class and of the language's common words is
taken (from histograms of whole per mille), and the documents near these
medians have one vote each. Up to half of a language's documents may be junk.
All sums are of integers, so that they don't depend on partitions.

Everything is a DataFrame expression: no Python runs on the executors. The
measures of all texts are written once (a few numbers per document), the
references are summed from them, and nothing is shuffled but those sums.

An expression holds a text's words as objects, some 30 times the text's bytes.
Texts of more than LONG bytes are therefore written apart, each with a key, and
cut into pieces between words, or between lines: counts of pieces are summed,
and windows and lines of a text are counted by grouping, to the same numbers.
Nothing of this runs where no text is as long. What a task must hold of a long
text is the text itself, as bytes and as a string, and its pieces.

Defined results: null, empty and blank texts have no words and fail the base
rules; documents in other languages or with a null language are compared with
all references, and add to none; without any reference no divergence is
judged; repeated documents are judged one by one; an empty table gives no
rows. Only id, text and language are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Common words of the languages, lower case. Fixed values.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat".split(),
    "en": "the of and to a in is it that for was on as with be by at this are from or have an they which you had not were".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son".split(),
}
#: Character classes of the histogram; what is in none of them is the class "other".
CHARACTER_CLASSES = {"lower": "a-z", "space": " \\x09-\\x0D", "letter": "\\x{80}-\\x{10FFFF}", "stop": ".,;:", "symbol": "#*$%&|<>",
                     "upper": "A-Z", "exclaim": "!?", "digit": "0-9"}
_PLACE = {name: i for i, name in enumerate(CHARACTER_CLASSES)}
WORD_BREAKS = "[\\x20\\x09-\\x0D]+"
#: Limit of the character divergence (in bits, 0 to 1), and the fewest words that are judged by divergence.
CHARACTER_LIMIT, MIN_WORDS = 0.10, 50
#: The limit of the word divergence is that of a text without common words times least(MOST, SHARE + NOISE / sqrt(words)).
WORD_MOST, WORD_SHARE, WORD_NOISE = 0.9, 0.5, 4.0
#: What is left out around a word before it is looked up.
PUNCTUATION = ".,;:!?\"'()[]"
#: Shares are taken in whole parts of BINS for medians, of VOTE for references; a typical document's shares of
#: characters differ from the medians by at most NEAR + a quarter, and it has at least half the median share of common words.
BINS, VOTE, NEAR = 1000, 1_000_000, 20

#: A text of more bytes is measured in pieces, which have PIECE characters and the rest of the word or line that they end in.
LONG, PIECE = 4 << 20, 1 << 20

VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
OTHER_WORD = ""


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAKS), lambda w: w != "")


def _lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _class_counts(text: Column) -> Column:
    """Array of the characters of each class, the last entry being the others.

    Each class is removed from what the classes before it have left, the most
    frequent ones first, so that the later passes run over little text.
    """
    def count(left: Column, names: list[str]) -> Column:
        if not names:
            return F.array(F.length(left).cast("bigint"))
        rest = F.regexp_replace(left, f"[{CHARACTER_CLASSES[names[0]]}]+", "")
        return _let(rest, lambda r: F.concat(F.array((F.length(left) - F.length(r)).cast("bigint")), count(r, names[1:])))

    return count(text, list(CHARACTER_CLASSES))


def _repeated_words(words: Column, window: int) -> Column:
    """Words in windows that occur at least twice in the text.

    Windows are compared by 64-bit hashes. Only where the hashes are not
    distinct they are sorted with their places; a covered word is counted with
    the last covered window that begins before it.
    """
    n = F.size(words) - (window - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h: Column) -> Column:
        by = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def counted(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return _let(places, lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
                F.lit(0).cast("bigint"), lambda a, x: a + x))

        return _let(by, counted)

    distinct = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h))
    return F.when(n < 2, F.lit(0).cast("bigint")).otherwise(_let(hashes, distinct))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an array of one element, transformed."""
    return F.get(F.transform(F.array(value), body), 0)


def _word_counts(words: Column) -> Column:
    """Sorted array of (w, n): the counts of the common words in lower case, and of all other words under OTHER_WORD."""
    lower = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION)))
    common = F.array_sort(F.filter(lower, lambda w: w.isin(*VOCABULARY)))

    def runs(s: Column) -> Column:
        last = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i + 1)))
        return _let(last, lambda e: F.transform(e, lambda x, i: F.struct(
            F.get(s, x).alias("w"), (x - F.coalesce(F.get(e, i - 1), F.lit(-1))).cast("bigint").alias("n"))))

    counted = lambda s: F.concat(
        F.array(F.struct(F.lit(OTHER_WORD).alias("w"), (F.size(words) - F.size(s)).cast("bigint").alias("n"))),
        F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<w:string,n:bigint>>")))
    return _let(common, counted)


def measures(text: Column, window: int = 8) -> Column:
    """A text's base measures with ``chars`` (class counts) and ``common`` (word counts), as one struct."""
    text = F.coalesce(text, F.lit(""))
    lines = _lines(text)
    return _let(F.struct(_words(text).alias("words"), _class_counts(text).alias("chars")), lambda m: F.struct(
        F.size(m["words"]).cast("bigint").alias("n_words"),
        (F.length(text) - F.get(m["chars"], _PLACE["space"])).alias("word_chars"),
        F.get(m["chars"], _PLACE["symbol"]).alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(m["words"], window).alias("n_repeat_words"),
        m["chars"].alias("chars"), _word_counts(m["words"]).alias("common")))


def is_long(text: Column) -> Column:
    """Whether a text is measured in pieces; false for null."""
    return F.octet_length(F.coalesce(text, F.lit(""))) > LONG


def _pieces(text: Column, rest: str) -> Column:
    """The text cut into pieces of PIECE characters, each with what follows of the class ``rest``.

    No part of the pattern gives back what it took, so no text is too long for it.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+{rest}*+"), F.lit(0))


def long_measures(texts: DataFrame, window: int = 8) -> DataFrame:
    """``measures`` of long texts by pieces, one row per key (columns key, unique, and text, not empty)."""
    pieces = texts.select("key", F.posexplode(_pieces(F.col("text"), "[^\\x20\\x09-\\x0D]")).alias("i", "piece"))
    counts = _let(_words(F.col("piece")), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _word_counts(w).alias("common")))
    counted = staged(pieces.select("key", _class_counts(F.col("piece")).alias("chars"), counts.alias("m")).select("key", "chars", "m.*"), "piece-counts")
    sums = [F.sum(F.get("chars", i)) for i in range(len(CHARACTER_CLASSES) + 1)]
    totals = counted.groupBy("key").agg(F.sum("n_words").alias("n_words"), F.array(*sums).alias("chars"))
    common = counted.select("key", F.explode("common").alias("c")).groupBy("key", F.col("c.w").alias("w")).agg(F.sum("c.n").alias("n"))
    common = common.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("common"))

    at = Window.partitionBy("key").orderBy("i", "j")
    words = pieces.select("key", "i", F.posexplode(_words(F.col("piece"))).alias("j", "w"))
    windows = words.select("key", F.row_number().over(at).alias("at"), F.collect_list("w").over(at.rowsBetween(0, window - 1)).alias("words"))
    hashes = windows.where(F.size("words") == window).select("key", "at", F.xxhash64("words").alias("h"))
    twice = hashes.withColumn("times", F.count("*").over(Window.partitionBy("key", "h"))).where("times > 1")
    step = F.lead("at").over(Window.partitionBy("key").orderBy("at")) - F.col("at")
    covered = twice.select("key", F.least(F.lit(window), F.coalesce(step, F.lit(window))).alias("n"))
    repeated = covered.groupBy("key").agg(F.sum("n").alias("n_repeat_words"))

    lines = texts.select("key", F.explode(_pieces(F.col("text"), "[^\\n]")).alias("piece")).select("key", F.explode(_lines(F.col("piece"))).alias("line"))
    lines = lines.groupBy("key", F.sha2("line", 256)).count()
    dup_lines = lines.groupBy("key").agg(F.sum(F.col("count") - 1).alias("n_dup_lines"))

    found = totals.join(common, "key").join(repeated, "key", "left").join(dup_lines, "key", "left")
    size = F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x)
    none = F.lit(0).cast("bigint")
    return found.select(
        "key", "n_words", (size - F.get("chars", _PLACE["space"])).alias("word_chars"), F.get("chars", _PLACE["symbol"]).alias("n_symbols"),
        F.coalesce("n_dup_lines", none).alias("n_dup_lines"), F.coalesce("n_repeat_words", none).alias("n_repeat_words"), "chars", "common")


def references(measured: DataFrame) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Per language the shares of character classes and of common words (columns lang, n_words, chars, common).

    Two aggregates over the written measures: at most BINS + 1 rows per language and class, then one per entry.
    """
    k = len(CHARACTER_CLASSES) + 1
    size = F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x)
    own = F.lit(0).cast("bigint")
    for lang, words in COMMON_WORDS.items():
        known = F.aggregate(F.filter("common", lambda x: x["w"].isin(*words)), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])  # noqa: B023
        own = F.when(F.col("lang") == lang, known).otherwise(own)
    # Spark computes arrays that are to be exploded before it applies the filter: texts without words are divided by, too.
    some = lambda n: F.greatest(n, F.lit(1))
    rows = measured.where(F.col("lang").isin(*COMMON_WORDS) & (F.col("n_words") >= MIN_WORDS)).select(
        "lang", some(F.col("n_words")).alias("n_words"), "chars", "common", some(size).alias("size"), own.alias("own"))
    bins = F.concat(F.transform("chars", lambda n: F.floor(n * BINS / F.col("size"))),
                    F.array(F.floor(F.col("own") * BINS / F.col("n_words"))))
    rows = rows.withColumn("bins", bins)
    counted = rows.select("lang", F.posexplode("bins").alias("i", "bin")).groupBy("lang", "i", "bin").count().collect()
    medians: dict[str, dict[int, int]] = {}
    for lang in sorted({r.lang for r in counted}):
        for i in range(k + 1):
            found = sorted((r.bin, r["count"]) for r in counted if r.lang == lang and r.i == i)
            total, until = sum(n for _, n in found), 0
            for b, n in found:
                until += n
                if 2 * until >= total:
                    medians.setdefault(lang, {})[i] = b
                    break
    if not medians:
        return {}
    typical = F.lit(False)
    for lang, m in medians.items():
        near = F.get("bins", k) * 2 >= m[k]
        for i in range(k):
            near = near & (F.abs(F.get("bins", i) - m[i]) <= NEAR + m[i] // 4)
        typical = typical | ((F.col("lang") == lang) & near)
    votes = F.concat(
        F.transform("chars", lambda n, i: F.struct(F.concat(F.lit("\x00"), i.cast("string")).alias("w"), F.floor(n * VOTE / F.col("size")).alias("n"))),
        F.transform("common", lambda x: F.struct(x["w"].alias("w"), F.floor(x["n"] * VOTE / F.col("n_words")).alias("n"))))
    pooled = rows.where(typical).select("lang", F.explode(votes).alias("e")).groupBy("lang", F.col("e.w").alias("w")).agg(F.sum("e.n").alias("n"))
    out: dict[str, tuple[list[float], dict[str, float]]] = {}
    by: dict[str, dict[str, int]] = {}
    for lang, w, n in pooled.collect():
        by.setdefault(lang, {})[w] = n
    for lang, counts in by.items():
        chars = [counts.get(f"\x00{i}", 0) for i in range(k)]
        words = {w: n for w, n in counts.items() if not w.startswith("\x00") and n}
        out[lang] = ([c / sum(chars) for c in chars], {w: n / sum(words.values()) for w, n in words.items()})
    return dict(sorted(out.items()))


def without_common_words(reference: dict[str, float]) -> float:
    """The word divergence of a text that has no common word."""
    q = reference.get(OTHER_WORD, 0.0)
    both = math.log2(2 / (1 + q)) + (q * math.log2(2 * q / (1 + q)) if q else 0.0)
    return (both + 1 - q) / 2


def _term(p: Column, q: Column) -> Column:
    """p and q's part of twice the divergence, where p is positive."""
    left = p * F.log2(2 * p / (p + q))
    return left + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(F.lit(0.0))


def _character_divergence(chars: Column, reference: list[float]) -> Column:
    total = F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = F.lit(0.0)
    for i, share in enumerate(reference):
        p, q = F.get(chars, i) / total, F.lit(share)
        parts = parts + F.when(p > 0, _term(p, q)).otherwise(q)
    return parts / 2


def _word_divergence(common: Column, n_words: Column, reference: dict[str, float]) -> Column:
    """Entries that the text lacks add their reference share: together, one less the shares of those it has."""
    known = F.create_map(*(F.lit(x) for pair in reference.items() for x in pair))

    def add(a: Column, x: Column) -> Column:
        q = F.coalesce(known[x["w"]], F.lit(0.0))
        return F.when(x["n"] > 0, a + _term(x["n"] / n_words, q) - q).otherwise(a)

    return F.aggregate(common, F.lit(1.0), add) / 2


def verdict(m: Column, refs: dict[str, tuple[list[float], dict[str, float]]], min_words: int = MIN_WORDS,
            character_limit: float = CHARACTER_LIMIT) -> Column:
    """Measures (a struct) with base_failed, the least divergences over the languages, and kept."""
    base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    part = F.least(F.lit(WORD_MOST), WORD_SHARE + WORD_NOISE / F.sqrt(m["n_words"]))
    pairs = [F.struct(_character_divergence(m["chars"], c).alias("c"), _word_divergence(m["common"], m["n_words"], w).alias("w"),
                      (F.lit(without_common_words(w)) * part).alias("most")) for c, w in refs.values()]
    kind = "array<struct<c:double,w:double,most:double>>"
    against = F.when(m["n_words"] >= min_words, F.array(*pairs)).otherwise(F.lit(None).cast(kind)) if pairs else F.lit(None).cast(kind)

    def judged(pairs: Column) -> Column:
        near = F.exists(pairs, lambda x: (x["c"] <= character_limit) & (x["w"] <= x["most"]))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return F.struct(*(m[n].alias(n) for n in names), base.alias("base_failed"),
                        F.array_min(F.transform(pairs, lambda x: x["c"])).alias("char_divergence"),
                        F.array_min(F.transform(pairs, lambda x: x["w"])).alias("word_divergence"),
                        (~base & F.coalesce(near, F.lit(True))).alias("kept"))

    return _let(against, judged)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Measures and verdicts of every document, with references from the same table."""
    text = F.col(text_col)
    whole = F.when(~is_long(text), measures(text))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), whole.alias("m"))
    measured = staged(rows.select("doc_id", "lang", "m.*"), "measures")
    if measured.where(F.col("n_words").isNull()).count():
        texts = docs.where(is_long(text)).select(
            F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
        texts = staged(texts, "long-texts")
        long = staged(texts.select("key", "doc_id", "lang").join(long_measures(texts), "key").drop("key"), "long-measures")
        measured = measured.where(F.col("n_words").isNotNull()).unionByName(long)
    refs = references(measured)
    m = F.struct(*(c for c in measured.columns if c not in ("doc_id", "lang")))
    return measured.select("doc_id", _let(m, lambda m: verdict(m, refs, **options)).alias("judged")).select("doc_id", "judged.*")


def keep_well_formed(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that pass, with all their columns.

    The texts are read twice: for the references (their counts are written),
    and again while filtering instead of a shuffle that would bring verdicts to
    texts. Rows with long texts are written, and meet their verdicts by key.
    """
    text = F.coalesce(text_col, F.lit(""))
    counts = _let(_words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _word_counts(w).alias("common")))
    counts = F.struct(_class_counts(text).alias("chars"), counts.alias("m"))
    long = is_long(F.col(text_col))
    rows = docs.where(F.col(lang_col).isin(*COMMON_WORDS) | long).select(F.col(lang_col).alias("lang"), F.when(~long, counts).alias("c"))
    measured = staged(rows.select("lang", "c.chars", "c.m.*"), "reference-counts")
    passed = lambda m: verdict(m, refs, **options)["kept"]
    if not measured.where(F.col("n_words").isNull()).count():
        refs = references(measured)
        return docs.where(_let(measures(F.col(text_col)), passed))
    texts = staged(docs.where(long).select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "long-texts")
    by_key = staged(long_measures(texts.select("key", F.col("row")[text_col].alias("text"))), "long-measures")
    langs = texts.select("key", F.col("row")[lang_col].alias("lang"))
    refs = references(measured.unionByName(by_key.join(langs, "key").select("lang", "chars", "n_words", "common")))
    kept = by_key.where(_let(F.struct(*(c for c in by_key.columns if c != "key")), passed)).select("key")
    short = docs.where(F.when(~long, _let(measures(F.col(text_col)), passed)))
    return short.unionByName(texts.join(kept, "key").select("row.*"))
