"""Text expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separator controls.
WHITE = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    """Lower-case words between white space, in order; punctuation stays on them."""
    return F.filter(F.split(F.lower(text), WHITE), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lines(text: Column) -> Column:
    return F.split(text, r"\R|[\x1c-\x1e]")


def filled_lines(text: Column) -> Column:
    """Trimmed lines without the blank ones."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def chunk_id(doc_id: Column, start: Column) -> Column:
    """The same id at every run, unlike a random one."""
    return F.sha2(F.concat_ws("|", doc_id.cast("string"), start.cast("string")), 256)


def contains_text(text: Column, part: Column) -> Column:
    """Case-insensitive containment; % and _ mean themselves."""
    return F.contains(F.lower(text), F.lower(part))


def prompt(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)
