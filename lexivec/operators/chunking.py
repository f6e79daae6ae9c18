"""Chunks of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexivec.functions.text import chunk_id
from lexivec.workers import ship


def fixed_stride(docs: DataFrame, size: int = 512, overlap: int = 64, text: str = "content", key: str = "doc_id") -> DataFrame:
    """Windows of ``size`` code points, each beginning ``size - overlap`` after the one before, up to the first that reaches the end.

    Gives chunk_id, start_char and end_char besides the document's own columns; the text becomes the chunk's. An
    empty or null text has no chunks. Narrow: no shuffle.
    """
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be at least 0 and under the size, not {overlap} of {size}")
    step, n = size - overlap, F.length(text)
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    # the windows themselves are exploded: a row for each that held the whole text would cost its length squared
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.substring(F.col(text), i * step + 1, F.lit(size)).alias("text")))
    rest = [c for c in docs.columns if c not in (text, key)]
    cut = docs.where(n > 0).withColumn("_length", n).select(key, *rest, "_length", F.explode_outer(windows).alias("_window"))
    start = F.col("_window.start").cast("int")
    return cut.select(chunk_id(F.col(key), start).alias("chunk_id"), key, F.col("_window.text").alias(text), *rest, start.alias("start_char"), F.least(start + size, F.col("_length")).cast("int").alias("end_char"))


class _Paragraphs:
    """(start_char, end_char, content) of a text's paragraphs. ``least``: a shorter one is joined with what follows, up to the text's end."""

    @staticmethod
    def analyze(text: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        if text.dataType != StringType():
            raise ValueError(f"paragraphs are those of a string, not of a {text.dataType.simpleString()}")
        if not isinstance(least.value, int) or least.value < 0:
            raise ValueError("the least length must be a constant count of at least 0")
        return AnalyzeResult(StructType().add("start_char", IntegerType()).add("end_char", IntegerType()).add("content", StringType()))

    def eval(self, text: str | None, least: int) -> Iterator[tuple[int, int, str]]:
        start = at = 0
        lines = (text or "").split("\n")
        for i, line in enumerate(lines):
            at += len(line)
            own = text[start:at] if text else ""
            if own.strip(" \t\n\v\f\r") and (len(own) >= least or i == len(lines) - 1):
                yield start, at, own
                start = at + 1
            elif not own.strip(" \t\n\v\f\r"):
                start = at + 1
            at += 1


#: The table function, for SQL and lateral joins.
paragraph_function = udtf(_Paragraphs, useArrow=True)


def paragraphs(docs: DataFrame, least: int = 0, text: str = "content", key: str = "doc_id") -> DataFrame:
    """Paragraphs (what line feeds part, if it holds more than white space) as chunks, with the columns that ``fixed_stride`` gives.

    A table function, joined laterally: each document gives its own rows where it lies. An empty or null text has none.
    """
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, key, "start_char", "end_char", "chunk_id")]
    own = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), *rest)
    found = own.lateralJoin(paragraph_function(F.col("_text").outer(), F.lit(least)))
    return found.select(chunk_id(F.col("_key"), F.col("start_char")).alias("chunk_id"), F.col("_key").alias(key), F.col("content").alias(text), *[own[c] for c in rest], "start_char", "end_char")


#: Chunkers by name; each takes documents and gives chunks. Others may be put in.
CHUNKERS: dict[str, Callable[..., DataFrame]] = {"fixed": fixed_stride, "paragraphs": paragraphs}


def chunk(docs: DataFrame, name: str = "fixed", **settings) -> DataFrame:
    """Chunks by the chunker of that name."""
    if name not in CHUNKERS:
        raise ValueError(f"no chunker named {name!r}; there are {', '.join(sorted(CHUNKERS))}")
    return CHUNKERS[name](docs, **settings)
