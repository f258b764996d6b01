"""Exact vector retrieval: every query against every chunk of a subject, top k, dedup across queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlow.functions import vectors
from marlow.operators.ordering import ordinal

#: Queries that are broadcast at once; more of them are scored in blocks.
MOST_QUERIES = 4096


def blocks(queries: DataFrame, key: str = "query_idx", most: int = MOST_QUERIES) -> list[DataFrame]:
    """``queries`` in parts of at most ``most`` rows, by ranges of their places in the order of ``key``; one part where they are few."""
    n = queries.limit(most + 1).count()
    if n <= most:
        return [queries]
    placed = ordinal(queries, key)
    return [placed.where(F.floor(F.col("_place") / most) == b).drop("_place") for b in range(-(-placed.count() // most))]


def scored(chunks: DataFrame, queries: DataFrame, score: Column | None = None, exact: str | None = None) -> DataFrame:
    """Each chunk with each query (query_idx, vector) and their ``score`` (cosine by default) to 4 places; with ``exact`` the unrounded one too, by that name.
    Chunks are read once for each block of queries."""
    raw = score if score is not None else vectors.cosine(F.col("vector"), F.col("query_vector"))
    out = None
    for some in blocks(queries, most=MOST_QUERIES):
        q = F.broadcast(some.select("query_idx", F.col("vector").alias("query_vector")))
        part = chunks.join(q).withColumn("_raw", raw).withColumn("score", F.round("_raw", 4)).drop("query_vector")
        part = part.withColumnRenamed("_raw", exact) if exact else part.drop("_raw")
        out = part if out is None else out.unionByName(part)
    return out


def top_k(scores: DataFrame, k: int, keys: list[str], order: str = "score", tie: str = "vec_id") -> DataFrame:
    """The ``k`` best rows of each key with their ``rank`` from 1."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_across_queries(hits: DataFrame) -> DataFrame:
    """Each chunk of a subject once, where it stands first by query and rank."""
    w = Window.partitionBy("subject_id", "vec_id").orderBy("query_idx", "rank")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
