"""The gated evidence model on Spark: items by a window of k a query, then one small group a subject through the numpy model.

A group holds at most ``k`` items for each query, however many vectors the subject has; summaries and gates are aggregates.
The queries and the model's weights are bounded (``MOST_QUERIES``) and are broadcast.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlow.functions import vectors
from marlow.functions.encoder import Layer
from marlow.functions.gated import Gated, Subject
from marlow.operators import retrieval

K = 4


def gumbel(seed: int, *keys: str) -> Column:
    """Seeded Gumbel noise of a row by its keys."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary")), 1, 8), 16, 10).cast("long")
    return -F.log(-F.log((h + 1) / F.lit(4294967298.0)))


def chosen(chunks: DataFrame, queries: DataFrame, k: int = K, noise: tuple[int, float] | None = None) -> DataFrame:
    """(subject_id, vec_id, days, query_idx, rank, raw, vector): the ``k`` items of each subject and query by ``raw``, their dot product with the query's
    direction (rounded to 4 places, ties to the smaller id); with ``noise`` (seed, temperature) they are drawn without repetition by the softmax of
    ``raw`` over the temperature.  Vectors wait until the items are chosen."""
    q = F.col("query_vector")
    raw = vectors.dot(F.col("vector"), q) / F.greatest(vectors.norm(q), F.lit(1e-8))
    scores = retrieval.scored(chunks, queries, raw, exact="raw").drop("vector")
    if noise:
        scores = scores.withColumn("score", F.col("raw") / noise[1] + gumbel(noise[0], "subject_id", "query_idx", "vec_id"))
    top = retrieval.top_k(scores, k, ["subject_id", "query_idx"])
    return top.select("subject_id", "vec_id", "days", "query_idx", "rank", "raw").join(chunks.select("vec_id", "subject_id", "vector"), ["vec_id", "subject_id"])


def selected(notes: DataFrame, codes: DataFrame, queries: DataFrame, k: int = K, noise: tuple[int, float] | None = None) -> DataFrame:
    """The chosen items of the queries of both kinds, with ``modality``."""
    out = [chosen(rows, queries.where(F.col("modality") == m), k, noise).withColumn("modality", F.lit(m)) for m, rows in (("Note", notes), ("Code", codes))]
    return out[0].unionByName(out[1])


def ordered(queries: DataFrame) -> list:
    """The queries, those over notes first; refuses more than ``retrieval.MOST_QUERIES``."""
    rows = queries.limit(retrieval.MOST_QUERIES + 1).collect()
    if len(rows) > retrieval.MOST_QUERIES:
        raise ValueError(f"more than {retrieval.MOST_QUERIES} queries")
    return sorted(rows, key=lambda r: (r["modality"] != "Note", r["query_idx"]))


def fixed(queries: DataFrame, **how) -> Gated:
    """The model of these queries with weights by a rule."""
    rows = ordered(queries)
    return Gated.fixed(np.array([r["vector"] for r in rows], float), sum(r["modality"] == "Note" for r in rows), **how)


def brought(notes: DataFrame, codes: DataFrame, queries: DataFrame, gates: DataFrame, k: int = K) -> DataFrame:
    """Rows of all subjects and queries (subject_id, q, open) with their items (rank, vec_id, vector; null where a query found none).  ``q`` is the
    place among the ordered queries."""
    places = [(r["modality"], r["query_idx"], i) for i, r in enumerate(ordered(queries))]
    order = F.broadcast(queries.sparkSession.createDataFrame(pd.DataFrame(places, columns=["modality", "query_idx", "q"])))
    items = selected(notes, codes, queries, k).select("subject_id", "modality", "query_idx", "rank", "vec_id", "vector")
    rows = gates.select("subject_id", "modality", "query_idx", "open").join(items, ["subject_id", "modality", "query_idx"], "left")
    return rows.join(order, ["modality", "query_idx"]).select("subject_id", "q", "modality", "query_idx", "open", "rank", "vec_id", "vector")


def subject(rows: pd.DataFrame, model: Gated, k: int = K) -> tuple[Subject, np.ndarray]:
    """(the subject of these rows with given gates, the row number of each of its items or -1)."""
    n, d = model.weights["queries"].shape
    items, at, open_ = np.zeros((n, k, d)), np.full((n, k), -1), np.zeros(n)
    open_[0] = 1
    for i, (q, o, rank, v) in enumerate(zip(rows["q"], rows["open"], rows["rank"], rows["vector"])):
        open_[q] = o
        if v is not None:
            items[q, int(rank) - 1], at[q, int(rank) - 1] = v, i
    return Subject(items, at >= 0, np.zeros((2, d)), open_), at


def scored(rows: DataFrame, model: Gated) -> DataFrame:
    """(subject_id, p): the fused probability of what each subject brought."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"subject_id": pdf["subject_id"].iloc[:1], "p": [shared.value.probability(subject(pdf, shared.value)[0])]})

    return rows.groupBy("subject_id").applyInPandas(run, "subject_id long, p double")


def attributed(rows: DataFrame, model: Gated, steps: int = 50) -> DataFrame:
    """Items with the subject's fused probability and their integrated gradients from zero and from the mean of all selected items; ``gap`` is what they
    leave of the difference of the probabilities."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        s, at = subject(pdf, m)
        p = m.probability(s)
        out = pdf.loc[:, ["subject_id", "modality", "query_idx", "vec_id"]].assign(p=round(p, 6))
        flat, rows_ = s.real.reshape(-1), at.reshape(-1)
        mean = s.items.reshape(len(flat), -1)[flat].mean(0) if flat.any() else np.zeros(s.items.shape[2])
        for name, start in (("zero", np.zeros_like(s.items)), ("mean", s.real[..., None] * mean)):
            share = m.attributed(s, start, steps).reshape(-1)
            column = np.full(len(pdf), np.nan)
            column[rows_[flat]] = share[flat]
            out[f"from_{name}"] = column.round(6)
            out[f"gap_{name}"] = round(p - m.probability(Subject(start, s.real, s.summaries, s.gates)) - share.sum(), 6)
        return out[pdf["vec_id"].notna()]

    schema = "subject_id long, modality string, query_idx int, vec_id long, p double, from_zero double, gap_zero double, from_mean double, gap_mean double"
    return rows.groupBy("subject_id").applyInPandas(run, schema)


def padded_bags(chunks: DataFrame) -> DataFrame:
    """(subject_id, batch, place, mask, vector): all vectors of each subject by place from 1, and zero vectors up to the longest bag of its batch."""
    dim = vectors.width(chunks)
    place = F.row_number().over(Window.partitionBy("subject_id").orderBy("vec_id"))
    real = chunks.select("subject_id", "batch", place.alias("place"), F.lit(True).alias("mask"), vectors.doubles(F.col("vector")).alias("vector"))
    sizes = chunks.groupBy("batch", "subject_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    longest = sizes.groupBy("batch").agg(F.max("n").alias("longest"))
    short = sizes.join(longest, "batch").where("n < longest")
    filling = short.select("subject_id", "batch", F.explode(F.sequence(F.col("n") + 1, F.col("longest"))).alias("place"), F.lit(False).alias("mask"), F.array_repeat(F.lit(0.0), dim).alias("vector"))
    return real.unionByName(filling)


#: Vectors of a subject that attend, or are attended to, at once.
BLOCK = 256


def encoded_summaries(chunks: DataFrame, layer: Layer, block: int = BLOCK) -> DataFrame:
    """(subject_id, v): the mean of each subject's vectors after an encoder layer.

    A subject's vectors are cut into blocks; a task works out what one block of queries attends to in one block of keys, and a block's partial results are
    merged as they come.  So a subject may have more vectors than a task could hold; the work is that of attention, the square of their number.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(layer)
    dim, heads = layer.weights["q"].shape[0], layer.heads
    place = F.row_number().over(Window.partitionBy("subject_id").orderBy("vec_id")) - 1
    rows = chunks.select("subject_id", F.floor(place / block).cast("int").alias("block"), "vec_id", vectors.doubles(F.col("vector")).alias("vector"))
    blocks = rows.groupBy("subject_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "vector"))), lambda e: e["vector"]).alias("x"))
    pairs = blocks.join(blocks.select("subject_id", F.col("block").alias("of"), F.col("x").alias("keys")), "subject_id")

    def attend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, k, of, x, keys in zip(b["subject_id"], b["block"], b["of"], b["x"], b["keys"]):
                x = np.stack(x)
                part = shared.value.attended(x, np.stack(keys))
                out.append((s, k, of, x.tobytes() if of == 0 else None, *[p.tobytes() for p in part]))
            yield pd.DataFrame(out, columns=["subject_id", "block", "of", "x", "top", "total", "mixed"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        merged, x = None, None
        for raw, top, total, mixed in zip(pdf["x"], pdf["top"], pdf["total"], pdf["mixed"]):
            t = np.frombuffer(top).reshape(heads, -1)
            part = (t, np.frombuffer(total).reshape(t.shape), np.frombuffer(mixed).reshape(*t.shape, dim // heads))
            merged = part if merged is None else shared.value.merged(merged, part)
            x = np.frombuffer(raw).reshape(-1, dim) if raw is not None else x
        y = shared.value.finished(x, merged)
        return pd.DataFrame({"subject_id": pdf["subject_id"].iloc[:1], "n": [len(y)], "total": [y.sum(0).tolist()]})

    kind = "subject_id long, block int"
    parts = pairs.mapInPandas(attend, f"{kind}, of int, x binary, top binary, total binary, mixed binary")
    sums = parts.groupBy("subject_id", "block").applyInPandas(finish, "subject_id long, n long, total array<double>")
    long = sums.select("subject_id", "n", F.posexplode("total").alias("i", "x")).groupBy("subject_id", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    whole = long.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return whole.select("subject_id", F.transform("v", lambda e: e["x"]).alias("v"))
