"""Line-first quality rules, in DataFrame and SQL functions only.

Every line of a text is judged by itself: lines that don't end as sentences do, that navigate, that are boilerplate, that are mostly symbols, or
that repeat an earlier line are removed. A document is rejected if that takes too much of its text. Some measures of the whole text
(``base``) are taken beside, and reject documents with few words or many repeated ones at once.

Nothing is shuffled: a document is judged where it lies, in time that grows as its length (times its logarithm, where five words recur).

Defined cases: a null text is empty, has no words and fails; white space is space and tab to carriage return, as bytes; a null doc_id stays null; repeated rows are judged each;
lines without a word count neither as lines nor as repeats; a very long text is judged whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.runtime import full_text

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window, the least words of a document, the most per cent of words in repeated windows, the most per cent of word characters that cleaning may take.
WINDOW, LEAST_WORDS, MOST_REPEATED, MOST_LOST = 5, 10, 20, 40
#: Patterns that Java and RE2 read alike. Fixed values.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
#: A sentence's end, with what may close it; the marks of other scripts too.
ENDS = r"""[.!?…:;。！？：；؟۔।]["'”’»）)\]]*[\x20\x09-\x0D]*$"""
#: A sentence's end within a line. A line of so many characters that holds one is a paragraph, though its own end be cut off.
INNER = r"""[.!?…。！？؟।]["'”’»）)\]]*[\x20\x09]+[^\x20\x09-\x0D|*#$%&<>]"""
PARAGRAPH_CHARS = 100
#: Two bars or arrows between words, or a line that is a menu's entry alone.
NAVIGATES = r"""(?i)([|»›•·→].*[|»›•·→])|^[\x20\x09]*(home|menu|search|next|previous|back|login|log in|sign in|sign up|register|share|tweet|print|contact|contact us|about|about us|sitemap|skip to content|read more|top)[\x20\x09.:!?]*$"""
#: What sites put on every page. Only lines of up to 200 characters are looked at: in a longer one it is a subject.
BOILERPLATE = r"""(?i)(^|[^a-z])(javascript|cookie policy|cookies? settings|we use cookies|accept all cookies|privacy policy|terms of (use|service)|terms and conditions|all rights reserved|click here|subscribe to our|sign up for our|lorem ipsum|powered by|copyright (©|\(c\)|[0-9]{4}))"""
BOILERPLATE_CHARS = 200
#: The most per cent of a line's word characters that symbols may be.
MOST_SYMBOLS = 10
_WINDOWS = rf"(?:^| )(?=([^ ]++(?: [^ ]++){{{WINDOW - 1}}}))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(windows: Column) -> Column:
    """How many words lie in windows found more than once, given all windows in order."""

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("words"))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["words"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("words"))
        return F.aggregate(places, zero, step, lambda acc: acc["words"])

    def places(ordered: Column) -> Column:
        """Of windows in order of their words, the places of those that a neighbour equals."""
        twin = lambda e, i: F.coalesce(F.get(ordered, i + 1)["w"] == e["w"], F.lit(False)) | F.coalesce(F.get(ordered, i - 1)["w"] == e["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, twin), lambda e: e["i"]))

    def counted(all_windows: Column) -> Column:
        numbered = F.sort_array(F.transform(all_windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(all_windows)) == F.size(all_windows), F.lit(0).cast("bigint")).otherwise(let(numbered, lambda s: covered(places(s))))

    return let(windows, counted)


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, WHITE, "")).cast("bigint")


def symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint")


def line_fails(line: Column) -> Column:
    """Whether a line (that holds a word) is removed for itself."""
    ended = line.rlike(ENDS) | ((F.length(line) >= PARAGRAPH_CHARS) & line.rlike(INNER))
    return ~ended | (100 * symbols(line) > MOST_SYMBOLS * word_chars(line)) | line.rlike(NAVIGATES) | ((F.length(line) <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE))


def lines_of(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def clean_lines(lines: Column) -> Column:
    """The lines that no rule removes, each different one once, in order."""
    return F.array_distinct(F.filter(lines, lambda line: ~line_fails(line)))


def base(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    plain = F.trim(F.regexp_replace("text", SPACE, " "))
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), full_text().alias("text")).withColumn("lines", lines_of(F.col("text")))
    n_words = F.when(F.length("plain") == 0, 0).otherwise(F.length("plain") - F.length(F.translate("plain", " ", "")) + 1).cast("bigint")
    measures = {
        "n_words": n_words,
        "word_chars": word_chars(F.col("text")),
        "n_symbols": symbols(F.col("text")),
        "n_dup_lines": let(F.col("lines"), lambda own: F.size(own) - F.size(F.array_distinct(own))).cast("bigint"),
        "n_repeat_words": repeated_words(F.regexp_extract_all("plain", F.lit(_WINDOWS), F.lit(1))),
    }
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("plain", plain).select("doc_id", "text", "lines", *[c.alias(k) for k, c in measures.items()]).withColumn("base_failed", failed)


def judge(docs: DataFrame) -> DataFrame:
    """``base`` with cleaned_text (the lines left, joined), lost_chars (of word characters) and kept."""
    cleaned = base(docs).withColumn("cleaned_text", F.array_join(clean_lines(F.col("lines")), "\n"))
    lost = cleaned.withColumn("lost_chars", F.col("word_chars") - word_chars(F.col("cleaned_text")))
    return lost.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))
