"""A text encoder fitted to a corpus: words weighed by how rare they are, projected to a vector.

Fitting counts in how many texts each hash bucket of words occurs, by sums over the executors; the weights are one number a bucket and are
broadcast.  A bucket's direction is a row of seeded signs, made where it is needed.  Texts are encoded in batches of like length, as a neural encoder
would want them; any function from a list of texts to vectors can stand in for :meth:`Encoder.encode`.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, WIDTH = 1 << 16, 64
WORD = re.compile(r"\w+")


def buckets_of(text: str | None) -> Counter:
    """How often each bucket has a word of a text, letters in lower case."""
    return Counter(zlib.crc32(w.encode()) % BUCKETS for w in WORD.findall((text or "").lower()))


@cache
def directions(seed: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (BUCKETS, width))


@dataclass
class Encoder:
    """Weights of the buckets, the seed of their directions, and the width of a vector."""

    weights: np.ndarray
    seed: int = 1
    width: int = WIDTH

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """Vectors of unit length; zero for a text without words."""
        out = np.zeros((len(texts), self.width), np.float32)
        signs = directions(self.seed, self.width)
        for i, t in enumerate(texts):
            if c := buckets_of(t):
                at, n = np.fromiter(c, np.int64), np.fromiter(c.values(), float)
                v = ((1 + np.log(n)) * self.weights[at]) @ signs[at]
                out[i] = v / max(float(np.linalg.norm(v)), 1e-12)
        return out


def fitted(texts: DataFrame, column: str = "text", seed: int = 1, width: int = WIDTH) -> Encoder:
    """An encoder whose weights are the inverse document frequencies of ``texts``."""

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for f in frames:
            for t in f[column]:
                total[list(buckets_of(t))] += 1
            n += len(f)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.r_[at, -1], "n": np.r_[total[at], n]})

    got = {r["bucket"]: r["n"] for r in texts.select(column).mapInPandas(seen, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n = got.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(got)] = list(got.values())
    return Encoder(np.log((1 + n) / (1 + df)) + 1, seed, width)


def encoded(rows: DataFrame, column: str, encoder: Encoder, at_once: int = 64) -> DataFrame:
    """``rows`` with ``vector``; a batch holds texts of like length."""
    shared = rows.sparkSession.sparkContext.broadcast(encoder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            order = f[column].fillna("").str.len().to_numpy().argsort(kind="stable")
            out = np.zeros((len(f), shared.value.width), np.float32)
            for lo in range(0, len(f), at_once):
                at = order[lo : lo + at_once]
                out[at] = shared.value.encode(f[column].iloc[at].tolist())
            yield f.assign(vector=list(out))

    return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", vector array<float>")
