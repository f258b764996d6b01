"""Exact evaluation metrics as aggregates and windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlow.operators.ordering import ordinal, running


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def filled(df: DataFrame, fallback: float = 0.5) -> DataFrame:
    """``df`` with p, the probability or the fallback, and parsed, whether there was one."""
    return df.withColumn("p", F.coalesce("probability", F.lit(fallback))).withColumn("parsed", F.col("probability").isNotNull())


def confusion(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 of p >= threshold by ``keys``."""
    hit = F.col("p") >= threshold
    yes = F.col("label") == 1
    c = df.groupBy(*keys).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *keys,
        "tp",
        "fp",
        "fn",
        "tn",
        F.round(share(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"),
        F.round(share(tp, tp + fp), 6).alias("precision"),
        F.round(share(tp, tp + fn), 6).alias("recall"),
        F.round(share(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


def auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """ROC-AUC by the rank-sum statistic with average ranks for ties; null with one class.

    Ties are first counted by score; the negatives below each score are a running sum
    over range partitions, so that few methods with many scores still spread.
    """
    by = df.groupBy(*keys, "p").agg(F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") == 0).alias("_neg"))
    wins = F.col("_pos") * (F.col("_before") + F.col("_neg") / 2)
    total = running(by, keys, "p", "_neg").withColumn("_w", wins).groupBy(*keys).agg(F.sum("_w").alias("_w"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    return total.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.round(F.col("_w") / (F.col("n_pos") * F.col("n_neg")), 6)).alias("auc"))


#: Subjects whose draws are counted together.
BLOCK = 512


def taken(rows: DataFrame, key: str, n_draws: int, seed: int, give: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Bootstrap with replacement, n of the n subjects in each draw, alike for all methods: ``give(rows, times)`` for blocks of subjects, ``times[i, d]`` being how
    often draw ``d`` took the subject of the block's row ``i``.

    Draw ``d`` hashes every place to the place it takes.  Tasks do so for their places and send the pairs on as packed arrays by
    the block they name, where they meet the block's rows: no row a draw and subject, and no task a draw.
    """
    spark = rows.sparkSession
    placed = ordinal(rows.select(key).distinct(), key)
    n = placed.count()
    mine = rows.join(placed, key).withColumn("_block", F.floor(F.col("_place") / BLOCK))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = [f"{seed}|{d}|".encode() for d in range(n_draws)]
        for batch in batches:
            places = batch.column(0).to_pylist()
            for lo in range(0, len(places), 256):
                suffixes = [str(i).encode() for i in places[lo : lo + 256]]
                raw = b"".join([hashlib.md5(p + i, usedforsecurity=False).digest()[:4] for i in suffixes for p in prefixes])
                source = np.frombuffer(raw, ">u4").astype(np.int64) % n
                pairs = np.rec.fromarrays([source, np.tile(np.arange(n_draws), len(suffixes))], dtype=_PAIR)
                pairs = pairs[np.argsort(source, kind="stable")]
                which = pairs["source"] // BLOCK
                edges = np.r_[0, np.flatnonzero(np.diff(which)) + 1, len(which)]
                yield pa.RecordBatch.from_arrays([pa.array(which[edges[:-1]], pa.int64()), pa.array([pairs[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], names=["_block", "pairs"])

    def met(key_: tuple, own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        times = np.zeros((BLOCK, n_draws), np.int32)
        for x in sent["pairs"]:
            pairs = np.frombuffer(x, _PAIR)
            np.add.at(times, (pairs["source"] - key_[0] * BLOCK, pairs["draw"]), 1)
        return give(own, times[own["_place"].to_numpy() - key_[0] * BLOCK])

    pairs = spark.range(0, n, 1, max(1, min(-(-n // 64), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(hashed, "_block long, pairs binary")
    width = max(1, min(-(-n // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))))  # a number of our own, so that small inputs too use all cores
    return mine.repartition(width, "_block").groupBy("_block").cogroup(pairs.repartition(width, "_block").groupBy("_block")).applyInPandas(met, schema)


_PAIR = np.dtype([("source", "<i8"), ("draw", "<i4")])


def times(subjects: DataFrame, key: str, n_draws: int, seed: int = 42) -> DataFrame:
    """(draw, key, times) of the subjects that each draw took: the long form, for looking at draws."""

    def give(own: pd.DataFrame, taken_: np.ndarray) -> pd.DataFrame:
        i, d = np.nonzero(taken_)
        return pd.DataFrame({"draw": d, key: own[key].to_numpy()[i], "times": taken_[i, d]})

    return taken(subjects.select(key).distinct(), key, n_draws, seed, give, f"draw long, {key} {subjects.schema[key].dataType.simpleString()}, times int")


def draws(subjects: DataFrame, key: str, n_draws: int, seed: int = 42) -> DataFrame:
    """(draw, n_distinct, n, checksum) of each draw: subjects it took, how many times in all, and the sum of their whole-number keys."""

    def give(own: pd.DataFrame, times: np.ndarray) -> pd.DataFrame:
        sums = (times * own[key].to_numpy()[:, None].astype(np.int64)).sum(0)
        return pd.DataFrame({"draw": np.arange(n_draws), "some": (times > 0).sum(0), "n": times.sum(0), "sums": sums})

    by = taken(subjects.select(key).distinct(), key, n_draws, seed, give, "draw long, some long, n long, sums long").groupBy("draw")
    return by.agg(F.sum("some").alias("n_distinct"), F.sum("n").alias("n"), F.sum("sums").alias("checksum"))


def resampled(scores: DataFrame, key: str, keys: list[str], n_draws: int, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """(draw, *keys, auc, accuracy, precision, recall, f1) of ``scores`` (key, *keys, label, p) in every draw that has
    both classes.

    A row weighs in all draws at once, by a vector of how often each took it.  Within a block of subjects the vectors of equal scores are
    added up, so that a score which many rows share is a row a block; then they are range-partitioned by score, and a task
    runs over its scores in order with vectors of what lies below.  What lies in the partitions before is added at the end, when there is one
    row a partition and draw."""
    kinds = ", ".join(f"{k} {scores.schema[k].dataType.simpleString()}" for k in keys)

    def give(own: pd.DataFrame, times: np.ndarray) -> pd.DataFrame:
        group = own.groupby([*keys, "p", "label"], dropna=False, sort=False)
        at = group.ngroup().to_numpy()
        total = np.zeros((group.ngroups, times.shape[1]), np.int32)
        np.add.at(total, at, times)
        first = np.unique(at, return_index=True)[1]
        return own.iloc[first][[*keys, "p", "label"]].assign(times=[t.tobytes() for t in total])

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        state: dict[tuple, dict[str, np.ndarray]] = {}
        open_: tuple | None = None  # the score that is being added up: (*keys, p)
        pos = neg = np.zeros(n_draws)

        def close() -> None:
            s = state.setdefault(open_[:-1], {c: np.zeros(n_draws) for c in ("pos", "neg", "won", "tp", "fp")})
            s["won"] += pos * (s["neg"] + neg / 2)
            s["pos"], s["neg"] = s["pos"] + pos, s["neg"] + neg
            if open_[-1] >= threshold:
                s["tp"], s["fp"] = s["tp"] + pos, s["fp"] + neg

        for b in batches:
            for row, label, times in zip(b[[*keys, "p"]].itertuples(index=False, name=None), b["label"], b["times"]):
                if row != open_:
                    if open_ is not None:
                        close()
                    open_, pos, neg = row, np.zeros(n_draws), np.zeros(n_draws)
                if label == 1:
                    pos = pos + np.frombuffer(times, np.int32)
                else:
                    neg = neg + np.frombuffer(times, np.int32)
        if open_ is not None:
            close()
        if state:
            yield pd.DataFrame([dict(zip(keys, k)) | {"part": part} | {c: v.tolist() for c, v in s.items()} for k, s in state.items()])

    vectors = taken(scores.select(key, *keys, "label", "p"), key, n_draws, seed, give, f"{kinds}, p double, label int, times binary")
    parts = vectors.repartitionByRange(*keys, "p").sortWithinPartitions(*keys, "p").mapInPandas(below, f"{kinds}, part int, " + ", ".join(f"{c} array<double>" for c in ("pos", "neg", "won", "tp", "fp")))
    rows = parts.select(*keys, "part", F.posexplode(F.arrays_zip("pos", "neg", "won", "tp", "fp")).alias("draw", "x")).select(*keys, "part", F.col("draw").cast("long").alias("draw"), "x.*")
    before = F.coalesce(F.sum("neg").over(Window.partitionBy("draw", *keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = rows.withColumn("won", F.col("won") + F.col("pos") * before).groupBy("draw", *keys).agg(*[F.sum(c).alias(c) for c in ("won", "pos", "neg", "tp", "fp")])
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    return sums.where((pos > 0) & (neg > 0)).select(
        "draw",
        *keys,
        (F.col("won") / (pos * neg)).alias("auc"),
        ((tp + neg - fp) / (pos + neg)).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        (tp / pos).alias("recall"),
        share(2 * tp, pos + tp + fp).alias("f1"),
    )
