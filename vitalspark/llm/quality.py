"""Line-first quality rules, native.

Every line with a word is judged by itself: *punctuation* (no letter or digit,
or too many symbols for its length, or short and without closing punctuation),
*navigation* (several menu separators) and *boilerplate* (stock phrases, whole
words, that cover ``PHRASE_PERCENT`` of the line's words or more; a line equal
to an earlier one of the text). Failing lines are removed, and a document that lost
more than ``max_loss`` of its word characters is rejected. Two document rules
come first (``base_failed``): fewer than ten words, or more than a fifth of the
words inside five-word windows that occur again in the text.

Five-word windows are compared by xxhash64 inside one document.

Defined cases: a null or empty text has no words and fails the base rules;
repeated rows are judged alike; ``judge`` replaces extra columns that have a
result's name, the stage keeps them; an empty table gives an empty result. Very long texts are handled
by sorts of their own windows, never by pairs of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import free_name, set_aside, table, whole_text, words

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
MAX_LOSS, MAX_SYMBOL_SHARE, SHORT_WORDS, SEPARATORS = 0.5, 0.1, 3, 3
SYMBOLS = r"[#*$%&|<>]"
# Stock phrases of page furniture, lower case.
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "sign in", "log in", "subscribe to", "click here", "read more", "enable javascript", "licensed under",
)
#: A line is boilerplate when the words of stock phrases are so many of its words.
PHRASE_PERCENT = 20
# no letter, digit, hyphen or apostrophe on either side
PHRASE = r"(?<![\p{L}\p{N}_'’-])(?:" + "|".join(PHRASES) + r")(?![\p{L}\p{N}_'’-])"
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(w: Column) -> Column:
    """Words covered by windows that occur twice or more in the array ``w``."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        steps = F.transform(
            starts, lambda s, i: F.least(F.lit(WINDOW), F.when(i + 1 < n, F.get(starts, i + 1) - s).otherwise(WINDOW))
        )
        return F.aggregate(steps, F.lit(0).cast("int"), lambda a, x: a + x)

    def among(ordered: Column) -> Column:
        same = lambda x, i: (
            F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))
        )
        found = F.filter(ordered, same)
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        once = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(once, F.lit(0)).otherwise(let(F.sort_array(pairs), among))

    def of(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v) - (WINDOW - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(v, i, WINDOW))), windows)

    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(w, of)).cast("long")


def line_fails(line: Column) -> Column:
    chars = F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", ""))
    found = F.regexp_extract_all(F.lower(line), F.lit(PHRASE), F.lit(0))
    # phrases have single spaces
    covered = F.size(F.split(F.array_join(found, " "), " "))
    phrase = (F.size(found) > 0) & (100 * covered >= PHRASE_PERCENT * F.size(words(line)))
    punctuation = (
        ~line.rlike(r"[\p{L}\p{N}]")
        | (matches(line, SYMBOLS) > chars * MAX_SYMBOL_SHARE)
        | ((F.size(words(line)) < SHORT_WORDS) & ~line.rlike(r"[\p{P}][\x20\x09-\x0D]*$"))
    )
    navigation = matches(line, r"[|»›•·]") >= SEPARATORS
    return punctuation | navigation | phrase


def judge(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """Add the counts, ``base_failed``, ``kept`` and ``clean_text`` (the text
    without its failing lines)."""
    taken = docs.drop(*[c for c in docs.columns if c in RESULT])
    w, rest = free_name(taken, "_words"), free_name(taken, "_lines")
    df = taken.withColumn(w, words(whole_text(text))).withColumn(rest, F.split(whole_text(text), "\n"))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    worded = F.filter(F.col(rest), has_word)
    chars = lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", "")).cast("long")
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": chars(whole_text(text)),
            "n_symbols": matches(whole_text(text), SYMBOLS),
            "n_dup_lines": let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col(w)),
            # a later copy of a line is removed with the failing ones
            "clean_text": F.array_join(F.array_distinct(F.filter(F.col(rest), lambda x: has_word(x) & ~line_fails(x))), "\n"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = 1 - chars(F.col("clean_text")) / F.greatest(F.col("word_chars"), F.lit(1))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & (lost <= max_loss)).drop(w, rest)


def quality_query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(documents).select("doc_id", *RESULT[:-1])


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines."""
    own, back = set_aside(docs, RESULT)
    kept = judge(own.withColumn("text", whole_text())).where("kept")
    return kept.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(back)
