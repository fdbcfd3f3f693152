"""Line-first cleaning: rules on every line, then a verdict on what is left of the document.

A line goes if it is boilerplate, navigation, symbols or shouting, or a short line without an end mark. A
document goes if it is too short, repeats itself, or loses too much of its text with its lines. All of it is
column functions within a row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, contains_any, count_of, known, unused, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Percent of a document's words in three-word windows that occur more than once.
MOST_REPEATED = 50
#: Percent of a document's characters that the removed lines may have.
MOST_LOST = 50
#: Words of a line from which it needs no end mark.
LONG_LINE = 8
#: Words of a line from which capitals alone are shouting.
SHOUTED_WORDS = 4

#: A separator for every so many words makes a line navigation.
WORDS_PER_SEPARATOR = 5

SEPARATORS = "|»›·•>"
END_MARKS = (".", "!", "?", "…", ":", ";")
#: What may follow an end mark.
CLOSING = " \t\r)]\"'”»"
# Phrases of notices, licences and menus.
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "©", "privacy policy", "terms of use", "terms of service", "cookie policy",
    "cookie settings", "uses cookies", "accept cookies", "enable javascript", "click here", "read more", "sign in to",
    "sign up for", "sign up now", "subscribe to", "subscribe now", "licensed under", "released under the", "lorem ipsum",
    "skip to content", "skip to main content", "share this",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "jetzt abonnieren",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "utiliza cookies",
)


def _letters(text: Column) -> Column:
    """Characters of a text that are no ASCII white space."""
    return F.length(F.translate(text, " " + WHITE, ""))


def _measured(line: Column) -> Column:
    """What the rules need of a line, each measure taken once; n is its number of words if one blank parts them."""
    trimmed = F.trim(line, F.lit(" " + WHITE))
    return F.struct(
        line.alias("line"),
        F.lower(line).alias("lower"),
        F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).alias("n"),
        count_of(line, SYMBOLS).alias("symbols"),
        count_of(line, SEPARATORS).alias("separators"),
    )


def _passes(x: Column) -> Column:
    """Whether a measured line is text. Blank lines pass; they have nothing to lose."""
    line, lower, n = x["line"], x["lower"], x["n"]
    navigation = x["separators"] * WORDS_PER_SEPARATOR >= F.greatest(n, F.lit(WORDS_PER_SEPARATOR))
    symbols = (x["symbols"] > 0) & (x["symbols"] * 3 >= n)
    # The end of a line tells most lines apart from shouting before all of it is looked at.
    shouted = (n >= SHOUTED_WORDS) & (F.right(line, F.lit(8)) != F.right(lower, F.lit(8))) & (line == F.upper(line))
    open_end = (n < LONG_LINE) & ~F.right(F.rtrim(line, F.lit(CLOSING)), F.lit(1)).isin(*END_MARKS)
    return (n == 0) | ~(navigation | symbols | open_end | shouted | contains_any(lower, BOILERPLATE))


def _duplicate_lines(lines: Column) -> Column:
    worded = F.filter(lines, lambda x: F.trim(x, F.lit(" " + WHITE)) != "")
    return (F.size(worded) - F.size(F.array_distinct(worded))).cast("bigint")


def with_repeats(df: DataFrame, words_col: str, to: str) -> DataFrame:
    """Add the number of words in windows of three that occur at least twice among the words of a row.

    Windows are compared by a 64-bit hash of their words. They are sorted with their places, windows equal to a
    neighbour give theirs, and from one such place to the next at most three words are counted. Each step is a
    column of its own, as a step used twice within an expression would be computed twice.
    """
    grams, marked, places = unused(df, "grams", "marked", "places")
    count, w = F.size(words_col), F.col(words_col)
    n = F.greatest(count - 2, F.lit(0))
    parts = F.arrays_zip(*[F.slice(w, i, n).alias(f"w{i}") for i in (1, 2, 3)])
    gram = F.transform(parts, lambda x, i: F.struct(F.xxhash64(x["w1"], x["w2"], x["w3"]).alias("h"), i.alias("i")))
    df = df.withColumn(grams, F.sort_array(gram))
    g, last = F.col(grams), F.greatest(F.size(grams) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(g, 1, last), F.slice(g, 2, last), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    df = df.withColumn(marked, F.array_compact(pairs))
    df = df.withColumn(places, F.sort_array(F.array_distinct(F.flatten(marked))))
    p, most = F.col(places), F.greatest(F.size(places) - 1, F.lit(0))
    steps = F.zip_with(F.slice(p, 1, most), F.slice(p, 2, most), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(0), lambda acc, x: acc + x) + F.when(F.size(places) > 0, 3).otherwise(0)
    return df.withColumn(to, covered.cast("bigint")).drop(grams, marked, places)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, the lines that stay and the verdict.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines (with words),
    n_removed_lines, lost_chars, clean_text, kept. A null text counts as empty, and an empty one fails for its
    length. ``clean_text`` has the lines that pass, blank ones included.
    """
    text = known(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("*", words(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    rows = with_repeats(rows, "words", "n_repeat_words")
    measured = F.transform("lines", _measured)
    rows = rows.withColumn("passed", F.transform(F.filter(measured, _passes), lambda x: x["line"]))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        _duplicate_lines(F.col("lines")).alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("passed")).cast("bigint").alias("n_removed_lines"),
        F.array_join("passed", "\n").alias("clean_text"),
    )
    lost = F.when(F.col("n_removed_lines") == 0, 0).otherwise(F.col("word_chars") - _letters(F.col("clean_text")))
    rows = rows.withColumn("lost_chars", lost.cast("bigint"))
    few, same = F.col("n_words") < LEAST_WORDS, F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED
    rows = rows.withColumn("base_failed", few | same)
    lost = F.col("lost_chars") * 100 > F.col("word_chars") * MOST_LOST
    return rows.withColumn("kept", ~F.col("base_failed") & ~lost)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of the documents kept, without the lines that failed."""
    return judged(docs, id_col, text_col).where("kept").select("doc_id", F.col("clean_text").alias("text"))
