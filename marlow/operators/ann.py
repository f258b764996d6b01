"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Vectors go to the nearest of ``cells`` centres; what a vector differs from its centre is cut into parts, and each part is kept as
the number of the nearest entry of that part's codebook.  A query looks into the cells nearest to it, adds up distances from tables of
its own (one number a part and entry), and the best of them are scored again with their true vectors.

Centres and codebooks are fitted on a bounded sample (``SAMPLE`` rows, by a hash of the id) by rounds of k-means whose sums come from the
executors; every row is indexed.  Both are broadcast: their size goes by ``cells``, at most ``CELLS``, and the width.  Codes are a table; a cell
that holds more than ``SLICE`` rows is split, and its queries go to all its slices, so that no task holds a whole hot cell.  How many cells are
probed, and how many candidates scored again, is measured against brute force with a bounded set of queries.

Vectors are compared by cosine; rows without a vector, with another width or with a component that is null or not finite are not indexed.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlow.functions import vectors
from marlow.operators.ordering import settled

#: Rows that centres and codebooks are fitted on, at most; most cells; entries of a codebook; rounds of k-means.
SAMPLE, CELLS, ENTRIES, ROUNDS = 65_536, 4096, 256, 8
#: Rows of a cell that one task holds, and queries of it that are looked up at once.
SLICE, AT_ONCE = 50_000, 256
#: Queries that the number of probes is measured with, at most.
MEASURED = 256


@dataclass
class Index:
    """Centres (cells, width), codebooks (parts, entries, width / parts), the codes (cell, slice, id, code) and the indexed rows (id, vector)."""

    centres: np.ndarray
    books: np.ndarray
    codes: DataFrame
    rows: DataFrame
    slices: DataFrame

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(x @ self.centres.T) + 0.5 * (self.centres**2).sum(1), axis=1, kind="stable")[:, :n]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32) if len(column) else np.empty((0, 0), np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (0.5 * (centres**2).sum(1) - x @ centres.T).argmin(1)


def directions(rows: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """(id, vector): finite vectors of the given width, of unit length."""
    v = F.col(column)
    fine = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(v.isNotNull() & fine).select(F.col(key).alias("id"), vectors.l2_normalize(v).cast("array<float>").alias("vector"))


def _fitted(sample: DataFrame, start: np.ndarray, residuals_of: np.ndarray | None, rounds: int) -> np.ndarray:
    """k-means of each part of the sample's vectors (or of what they differ from their centre): (parts, entries, width)."""
    spark = sample.sparkSession
    parts, entries, width = start.shape
    books = start.astype(np.float32)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, entries, width + 1))
            for b in batches:
                x = _matrix(b.column(0))
                if len(x):
                    x = x if residuals_of is None else x - residuals_of[_nearest(x, residuals_of)]
                    for p in range(parts):
                        part = x[:, p * width : (p + 1) * width]
                        np.add.at(total[p], _nearest(part, shared.value[p]), np.c_[part, np.ones(len(part))])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["at", "x"])

        flat = np.zeros(parts * entries * (width + 1))
        for r in sample.select("vector").mapInArrow(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            flat[r["at"]] = r["x"]
        new = flat.reshape(parts, entries, width + 1)
        books = np.where(new[..., -1:] > 0, new[..., :-1] / np.maximum(new[..., -1:], 1), books).astype(np.float32)
        shared.unpersist()
    return books


def build(rows: DataFrame, key: str = "vec_id", column: str = "embedding", cells: int | None = None, parts: int = 8, rounds: int = ROUNDS) -> Index:
    """The index of all finite vectors of ``rows``; ``cells`` by default half the square root of their number."""
    spark = rows.sparkSession
    width = rows.where(F.col(column).isNotNull()).select(F.size(column)).first()[0]
    if width % parts:
        raise ValueError(f"width {width} is no multiple of {parts} parts")
    all_ = settled(directions(rows, key, column, width))
    n = all_.count()
    cells = max(1, min(CELLS, n, cells or round(n**0.5 / 2)))
    order = F.xxhash64("id")
    share = min(1.0, 1.25 * SAMPLE / max(n, 1))
    sample = settled(all_.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(order).limit(SAMPLE) if n > SAMPLE else all_)
    seeds = np.array([r["vector"] for r in sample.orderBy(order, "id").select("vector").limit(max(cells, ENTRIES)).collect()], np.float32)
    centres = _fitted(sample, seeds[None, :cells], None, rounds)[0]
    rest = seeds[: min(ENTRIES, len(seeds))]
    rest = rest - centres[_nearest(rest, centres)]
    books = _fitted(sample, np.stack(np.split(rest, parts, axis=1)), centres, rounds)
    shared = spark.sparkContext.broadcast((centres, books))
    step = width // parts

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mid, book = shared.value
        for b in batches:
            x = _matrix(b.column(1))
            if len(x):
                cell = _nearest(x, mid)
                x = x - mid[cell]
                code = np.stack([_nearest(x[:, p * step : (p + 1) * step], book[p]) for p in range(len(book))], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "cell", "code"])

    kind = all_.schema["id"].dataType.simpleString()
    codes = settled(all_.mapInArrow(coded, f"id {kind}, cell int, code binary"))
    slices = codes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    codes = codes.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).drop("slices")
    return Index(centres, books, codes, all_, slices)


def search(index: Index, queries: DataFrame, k: int, probes: int, more: int = 16) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best by cosine of what the ``probes`` nearest cells hold, among ``more * k`` of each query by its codes.
    ``queries``: (query_id, vector) of unit length."""
    spark = queries.sparkSession
    parts, entries, step = index.books.shape
    shared = spark.sparkContext.broadcast((index.centres, index.books))
    find = Index(index.centres, index.books, None, None, None)
    probes = min(probes, len(index.centres))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": index.codes.schema["id"].dataType.simpleString()}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            if len(x):
                cell = find.nearest_cells(x, probes)
                who = np.repeat(np.arange(len(x)), probes)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), b.column(1).take(pa.array(who)), pa.array(cell.reshape(-1), pa.int32())], names=["query_id", "vector", "cell"])

    asked = queries.select("query_id", "vector").mapInArrow(probe, f"query_id {kinds['query_id']}, vector array<float>, cell int")
    asked = asked.join(F.broadcast(index.slices), "cell").select("query_id", "vector", "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def looked_up(_: tuple, codes: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        mid, book = shared.value
        found = []
        if len(codes) and len(asked_):
            code = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), parts)
            ids = codes["id"].to_numpy()
            centre = mid[codes["cell"].iloc[0]]
            for lo in range(0, len(asked_), AT_ONCE):
                few = asked_.iloc[lo : lo + AT_ONCE]
                x = np.stack(few["vector"].to_numpy()).astype(np.float32)
                table = np.stack([x[:, p * step : (p + 1) * step] @ book[p].T for p in range(parts)])  # (parts, queries, entries)
                dot = (x @ centre)[:, None] + sum(table[p][:, code[:, p]] for p in range(parts))
                keep = min(more * k, len(ids))
                best = np.argpartition(-dot, keep - 1, axis=1)[:, :keep]
                who = np.repeat(np.arange(len(few)), keep)
                found.append(pd.DataFrame({"query_id": few["query_id"].to_numpy()[who], "id": ids[best.reshape(-1)], "rough": dot[who, best.reshape(-1)]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "rough": []})

    near = index.codes.groupBy("cell", "slice").cogroup(asked.groupBy("cell", "slice")).applyInPandas(looked_up, f"query_id {kinds['query_id']}, id {kinds['id']}, rough double")
    rough = Window.partitionBy("query_id").orderBy(F.col("rough").desc(), "id")
    short = near.withColumn("_n", F.row_number().over(rough)).where(F.col("_n") <= more * k).select("query_id", "id")
    q = queries.select("query_id", F.col("vector").alias("_q"))
    true = short.join(index.rows, "id").join(q, "query_id").select("query_id", "id", F.round(vectors.dot(F.col("vector"), F.col("_q")), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return true.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def exact(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) by brute force: blocks of queries, at most ``AT_ONCE`` each, against all rows; a task keeps the best of its rows."""
    spark = rows.sparkSession
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": rows.schema["id"].dataType.simpleString()}
    blocks = queries.withColumn("_b", F.floor(F.monotonically_increasing_id() / AT_ONCE)).groupBy("_b").agg(F.collect_list(F.struct("query_id", "vector")).alias("q"))
    out = None
    for block in blocks.toLocalIterator():
        ids = [r["query_id"] for r in block["q"]]
        shared = spark.sparkContext.broadcast(np.array([r["vector"] for r in block["q"]], np.float64))

        def score(batches: Iterator[pa.RecordBatch], ids=ids, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1)).astype(np.float64)
                if len(x):
                    dot = np.round(shared.value @ x.T, 6)
                    keep = min(k, len(x))
                    names = np.array(b.column(0).to_pylist())
                    best = np.lexsort((np.broadcast_to(names, dot.shape), -dot), axis=1)[:, :keep]
                    who = np.repeat(np.arange(len(ids)), keep)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[w] for w in who]), b.column(0).take(pa.array(best.reshape(-1))), pa.array(dot[who, best.reshape(-1)])], names=["query_id", "id", "score"])

        part = rows.select("id", "vector").mapInArrow(score, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.select("query_id", F.lit(None).cast(kinds["id"]).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of ``true`` (query_id, id) that ``found`` has."""
    n = true.count()
    return true.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / n if n else 1.0


def settings_for(index: Index, queries: DataFrame, k: int, goal: float = 0.95, measured: int = MEASURED) -> tuple[int, int]:
    """(probes, more) for :func:`search`, measured with a bounded set of queries (those least by a hash): the cells that hold all but half of the
    misses allowed, from the places of the true neighbours' cells in each query's order; then as many candidates, doubled from 4, as
    reach ``goal``."""
    few = settled(queries.orderBy(F.xxhash64("query_id")).limit(measured))
    true = settled(exact(index.rows, few, k))
    asked = few.collect()
    if not asked:
        return 1, 4
    order = index.nearest_cells(np.array([r["vector"] for r in asked], np.float32), len(index.centres))
    place = {r["query_id"]: np.argsort(o) for r, o in zip(asked, order)}
    depth = np.sort([place[r["query_id"]][r["cell"]] for r in true.join(index.codes.select("id", "cell"), "id").select("query_id", "cell").collect()])
    probes = 1 + int(depth[max(0, min(len(depth), int(np.ceil(len(depth) * (1 + goal) / 2))) - 1)])
    more, n = 4, index.codes.count()
    while more * k < n and recall(search(index, few, k, probes, more), true) < goal:
        more *= 2
    return probes, more
