"""Quality rules with distribution divergence.  DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated windows of 8 words.  Beyond them a
document's histograms of character classes and of common words are compared with the reference of its
language by Jensen-Shannon distance (base 2, so 0 to 1).  All words that are not common are one more cell of
the second histogram, so that a text without common words is far from any prose.  A reference is the sum of
the histograms of all documents of the language that pass the base rules.  Distances count only past
minimum lengths: of the document (too short a histogram is far from anything) and of the reference.  Even a
clean sample of n words is some way off, by about cells / (8 ln 2 n) of the squared distance; a document fails
past MOST_WORD_DISTANCE and that allowance, of WORD_NOISE / n.

Repeated windows are found inside the row: words are hashed, hashes of 8 neighbours are folded by
doubling (2, 4, 8), and where a document has fewer distinct windows than windows the hashes are sorted
with their positions, so that the work grows as n log n with a document's words.

Edge cases: null and empty texts have no words and fail the base rules; a null language is a language of
its own; texts under the minimum lengths are judged by the base rules alone; rows that repeat each get
their row, and count twice in the reference; a distance equal to its limit passes; a language whose documents
all fail the base rules has no reference and no distances; other columns are not read, and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import WORD, spill

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words

#: Common words of English, German, French and Spanish.
COMMON = (
    "the", "of", "and", "to", "in", "is", "was", "for", "on", "are", "as", "with", "that", "it", "by", "be", "this", "at", "from", "or", "an", "a",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur", "avec",
    "el", "y", "los", "del", "se", "las", "por", "con", "no", "su", "al", "lo", "como",
)
UPPER, DIGIT, PUNCTUATION = r"\p{Lu}", r"[0-9]", r"""[.,;:!?'"()-]"""
CLASSES = ("blank", "symbol", "upper", "digit", "punctuation", "other")

#: Distances past these fail.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.15
#: For some 30 cells in use in a language: 30 / (8 ln 2) and a little.
WORD_NOISE = 6.0
#: References of so many languages take about 10 MB, and are sent to all executors; more are joined by shuffle.
MOST_LANGUAGES = 10_000
#: Of a document's characters and words, and of a reference's of either.
LEAST_CHARS, LEAST_HISTOGRAM_WORDS, LEAST_REFERENCE = 200, 50, 2000


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _fold(df: DataFrame, name: str, step: int) -> DataFrame:
    """Hashes of each element with the one step further on; as many fewer as that."""
    short = F.greatest(F.lit(0), F.size(name) - step)
    return df.withColumn(name, F.zip_with(F.slice(name, F.lit(1), short), F.slice(name, F.lit(1 + step), short), lambda a, b: F.xxhash64(a, b)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for each document: doc_id, lang, the base counts, and the histograms classes and common."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn("lines", lines)
    usual = F.filter("words", lambda w: F.lower(w).isin(*COMMON))
    df = df.select(
        "doc_id", "lang", F.length("text").alias("chars"), F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), _count(F.col("text"), UPPER).alias("upper"), _count(F.col("text"), DIGIT).alias("digit"), _count(F.col("text"), PUNCTUATION).alias("punctuation"),
        F.transform(usual, lambda w: F.lower(w)).alias("usual"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    for step in (1, 2, 4):
        df = _fold(df, "h", step)
    at = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("at", F.when(F.size(F.array_distinct("h")) < F.size("h"), at).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("h")
    rest = lambda c: F.slice(c, F.lit(2), F.greatest(F.lit(0), F.size(c) - 1))
    df = df.withColumn("at", F.zip_with("at", rest("at"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
    df = df.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter("at", lambda p: p.isNotNull())))))
    gaps = F.zip_with("at", rest("at"), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g))
    classes = F.array(F.col("chars") - F.col("word_chars"), "n_symbols", "upper", "digit", "punctuation", F.col("word_chars") - F.col("n_symbols") - F.col("upper") - F.col("digit") - F.col("punctuation"))
    kinds = F.array_distinct("usual")
    common = F.when(F.size("usual") > 0, F.transform(kinds, lambda k: F.struct(k.alias("w"), (F.size("usual") - F.size(F.array_remove("usual", k))).cast("long").alias("m"))))
    return df.select(
        "doc_id", "lang", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars")],
        classes.cast("array<bigint>").alias("classes"), F.coalesce(common, F.array().cast("array<struct<w:string,m:bigint>>")).alias("common"),
    )


def _part(x: Column, y: Column) -> Column:
    """x log2(x / mean), 0 for 0."""
    return F.when(x > 0, x * F.log2(F.try_divide(2 * x, x + y))).otherwise(F.lit(0.0))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    sums = F.aggregate(F.zip_with(p, q, lambda x, y: _part(x, y) + _part(y, x)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(F.lit(0.0), sums / 2))


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _word_shares(counts: str, n_words: str) -> Column:
    """Shares of n_words of each common word, by a map of counts, and of all others."""
    of = F.transform(F.array(*[F.lit(w) for w in COMMON]), lambda w: F.coalesce(F.try_element_at(counts, w), F.lit(0).cast("long")))
    usual = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.transform(F.array_append(of, F.col(n_words) - usual), lambda m: F.try_divide(m, F.col(n_words)))


def references(found: DataFrame) -> DataFrame:
    """A row for each language: shares of classes and of words, and how many characters and words they rest on."""
    found = found.where(~_base_failed())
    sums = found.groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))], F.sum("n_words").alias("r_words"))
    words = found.select("lang", F.inline("common")).groupBy("lang", "w").agg(F.sum("m").alias("m")).groupBy("lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("w", "m")))).alias("common"))
    words = words.select(F.col("lang").alias("l"), "common")
    both = sums.join(words, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l").withColumn("common", F.coalesce("common", F.create_map().cast("map<string,bigint>")))
    total = sum((F.col(f"c{i}") for i in range(1, len(CLASSES))), F.col("c0"))
    return both.select(F.col("lang").alias("r_lang"), F.array(*[F.try_divide(F.col(f"c{i}"), total) for i in range(len(CLASSES))]).alias("r_classes"), total.alias("r_chars"), _word_shares("common", "r_words").alias("r_common"), "r_words")


def judged(found: DataFrame, max_class: float = MOST_CLASS_DISTANCE, max_word: float = MOST_WORD_DISTANCE) -> DataFrame:
    """measured() with base_failed, class_distance, word_distance (null under the minimum lengths) and kept."""
    ref = spill(references(found), "references")
    few = ref.count() <= MOST_LANGUAGES  # a language may hold a third of all rows, so they are not dealt out by it
    df = found.join(F.broadcast(ref) if few else ref, F.col("lang").eqNullSafe(F.col("r_lang")), "left")
    df = df.withColumn("own", F.map_from_entries("common"))
    class_distance = F.when((F.col("chars") >= LEAST_CHARS) & (F.col("r_chars") >= LEAST_REFERENCE), _distance(F.transform("classes", lambda c: F.try_divide(c, F.col("chars"))), F.col("r_classes")))
    word_distance = F.when((F.col("n_words") >= LEAST_HISTOGRAM_WORDS) & (F.col("r_words") >= LEAST_REFERENCE), _distance(_word_shares("own", "n_words"), F.col("r_common")))
    df = df.withColumn("class_distance", class_distance).withColumn("word_distance", word_distance)
    most_word = F.sqrt(F.lit(max_word**2) + F.try_divide(F.lit(WORD_NOISE), F.col("n_words")))
    far = F.coalesce(F.col("class_distance") > max_class, F.lit(False)) | F.coalesce(F.col("word_distance") > most_word, F.lit(False))
    return df.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & ~far)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, kept and the two distances."""
    found = spill(measured(docs, id_col, text_col, lang_col), "measured")  # texts are read once, for both the references and the verdicts
    return judged(found, **limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
