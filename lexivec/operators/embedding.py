"""Embedding: a hashing embedder in SQL, and the plug for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.text import words


def bucket(word: Column, dim: int) -> Column:
    """A word's bucket: the first 32 bits of its MD5, modulo ``dim``."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim


def hash_counts(docs: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, bucket, n): how many words of a text fall into each bucket. Counted within the row's partition before the shuffle."""
    cut = docs.select(key, F.explode(words(F.col(text))).alias("word"))
    return cut.groupBy(key, bucket(F.col("word"), dim).alias("bucket")).agg(F.count("*").alias("n"))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """The same counts as one dense vector, without a shuffle."""
    found = F.transform(words(text), lambda w: bucket(w, dim))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(found, lambda b: b == i)).cast("double"))


def model_embedding(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A model as a column function. ``load`` runs once in each worker; texts come in Arrow batches. A short reply leaves nulls."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            got = [None if v is None else [float(x) for x in v] for v in model(texts.tolist())][: len(texts)]
            yield pd.Series(got + [None] * (len(texts) - len(got)), dtype=object)

    return embed
