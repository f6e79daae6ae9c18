"""Approximate vector search: random hyperplane signs as keys, exact scores for what shares one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.vector import cosine, has_vector
from lexivec.operators.search import top_k


def sign_keys(vector: Column, dim: int, tables: int, bits: int, seed: int) -> Column:
    """One key per table: the signs of the vector's products with the table's hyperplanes, as one matrix product per Arrow batch."""
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    weights = (1 << np.arange(bits))[None, None, :]
    base = (np.arange(tables) << bits)[None, :]

    @F.pandas_udf("array<int>")
    def keys(vectors: pd.Series) -> pd.Series:
        x = np.zeros((len(vectors), dim))
        for i, v in enumerate(vectors):
            x[i, : min(dim, len(v))] = v[:dim]
        signs = ((x @ planes) >= 0).reshape(len(x), tables, bits)
        return pd.Series([*((signs * weights).sum(2) + base).astype("int32")])

    return keys(vector)


def lsh_search(chunks: DataFrame, queries: DataFrame, dim: int, k: int = 5, tables: int = 12, bits: int = 5, seed: int = 3, digits: int = 9) -> DataFrame:
    """(qid, chunk_id, seq, score, rank): the best of those chunks that share a key with the query in some table."""
    own = chunks.where(has_vector(F.col("embedding"))).select("chunk_id", "seq", "embedding", F.explode(sign_keys(F.col("embedding"), dim, tables, bits, seed)).alias("key"))
    asked = queries.select("qid", "query_vector", F.explode(sign_keys(F.col("query_vector"), dim, tables, bits, seed)).alias("key"))
    met = own.join(asked, "key").select("qid", "chunk_id", "seq").distinct()
    scored = met.join(chunks.select("chunk_id", "embedding"), "chunk_id").join(F.broadcast(queries.select("qid", "query_vector")) if queries.count() <= 4096 else queries.select("qid", "query_vector"), "qid")
    return top_k(scored.select("qid", "chunk_id", "seq", F.round(cosine(F.col("embedding"), F.col("query_vector")), digits).alias("score")), k)
