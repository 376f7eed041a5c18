"""Vectors of texts and retrieval by similarity."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

DIMS = 256


def embed(tokens: pd.Series) -> pd.Series:
    """Counts of tokens in 256 buckets by their hash, scaled to length one; zeros if there are no tokens."""
    place: dict[str, int] = {}
    out = []
    for ts in tokens:
        v = np.zeros(DIMS)
        for t in ts if ts is not None else ():
            if t not in place:
                place[t] = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % DIMS
            v[place[t]] += 1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return pd.Series(out)


def embedding(c: Column) -> Column:
    return F.pandas_udf(embed, "array<double>")(T.plain_words(c))


def similarity(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; vectors of different length fail."""
    return F.when(F.size(a) == F.size(b), T.dot(a, b)).otherwise(F.raise_error("vectors differ in length").cast("double"))


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(T.dot(a, a)) * F.sqrt(T.dot(b, b))
    return F.when(n > 0, T.dot(a, b) / n).otherwise(0.0)


def top_k(rows: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector", score=similarity, where: Column | None = None) -> DataFrame:
    """The k rows most like the query: score down, then key up; k of 0 or less gives none. Filters hold before ranking.

    The query is a literal, so each task scores its own rows and keeps its k best.
    """
    rows = (rows if where is None else rows.where(where)).where(F.col(vector).isNotNull())
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, score(F.col(vector), q).alias("score")).orderBy(F.col("score").desc(), key).limit(max(k, 0))


def top_k_per_query(rows: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector", block: int = 4096) -> DataFrame:
    """(query, key, score, rank) for a stated set of queries(query, vector) against all rows, by cosine.

    The set is taken in blocks, each broadcast as one matrix; a batch of rows meets a block in one product and sends on
    no more than k rows a query.
    """
    spark = rows.sparkSession
    kind, qkind = dict(rows.dtypes)[key], dict(queries.dtypes)["query"]
    held, out = [], None

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def scored(part: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in part], object), unit(np.array([r[1] for r in part], float))))

        def run(batches):
            ids, q = sent.value
            for b in batches:
                if not len(b):
                    continue
                s = unit(np.stack(b[vector].to_numpy()).astype(float)) @ q.T
                keys = b[key].to_numpy()
                order = np.argsort(keys, kind="stable")
                top = np.argsort(-s[order], axis=0, kind="stable")[:k]
                at = order[top]
                yield pd.DataFrame({"query": np.tile(ids, len(at)), key: keys[at].ravel(), "score": np.take_along_axis(s, at, 0).ravel()})

        return rows.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(run, f"query {qkind}, `{key}` {kind}, score double")

    for r in queries.select("query", vector).where(F.col(vector).isNotNull()).toLocalIterator():
        held.append(r)
        if len(held) == block:
            out = scored(held) if out is None else out.unionByName(scored(held))
            held = []
    if held or out is None:
        out = scored(held) if out is None else out.unionByName(scored(held)) if held else out
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), key)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
