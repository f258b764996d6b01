"""Relational preparation where order matters: the order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlow.operators.ordering import ordinal, ordinal_within


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key the row that comes first by ``order`` (a partial ``min_by``, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key the row that comes last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def seeded(seed: int, *cols: str) -> Column:
    """A hash that orders rows pseudo-randomly and alike in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """80/10/10 split of ``key`` within each label, by seeded hash."""
    placed = ordinal_within(df.select(key, label, seeded(seed, key).alias("_h")), label, "_h", key)
    place, n = F.col("_place") + 1, F.col("_size")
    train = F.floor(n * 8 / 10)
    val = train + F.floor((n - train) / 2)
    return placed.select(key, label, F.when(place <= train, "train").when(place <= val, "val").otherwise("test").alias("split"))


def contiguous_batches(df: DataFrame, key: str, n_batches: int) -> DataFrame:
    """``df`` with ``batch``: rows in the order of ``key``, cut every ceil(n / n_batches)."""
    placed = ordinal(df, key)
    n = df.groupBy().agg(F.count(F.lit(1)).alias("_n"))
    size = F.ceil(F.col("_n") / n_batches)
    return placed.join(F.broadcast(n)).select(*df.columns, F.floor(F.col("_place") / size).cast("int").alias("batch"))


def length_bucketed(df: DataFrame, key: str, length: str, world: int, per_rank: int = 50, seed: int = 7) -> DataFrame:
    """Seeded shuffle cut into megabatches, each by length descending, dealt to ``world``
    ranks in turn; the last incomplete turn is left out."""
    mega = ordinal(df.withColumn("_h", seeded(seed, key)), "_h", key).withColumn("mega", F.floor(F.col("_place") / (per_rank * world))).drop("_h", "_place")
    placed = ordinal(mega, F.col("mega"), F.col(length).desc(), F.col(key))
    n = df.groupBy().agg(F.count(F.lit(1)).alias("_n"))
    kept = placed.join(F.broadcast(n)).where(F.col("_place") < F.col("_n") - F.col("_n") % world)
    return kept.select(key, length, "mega", (F.col("_place") % world).cast("int").alias("rank"), F.floor(F.col("_place") / world).alias("step"))


def missing(df: DataFrame, key: str, **others: DataFrame) -> DataFrame:
    """One row: how many keys ``df`` has (n), and how many of them each of ``others`` lacks."""
    rows = df.select(key)
    for name, other in others.items():
        rows = rows.join(other.select(key).distinct().withColumn(name, F.lit(1)), key, "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(name).isNull()).alias(name) for name in others])


def complete(df: DataFrame, key: str, **others: DataFrame) -> DataFrame:
    """``df``, if all its keys are in each of ``others``; else ValueError with the counts."""
    r = missing(df, key, **others).first()
    if any(r[name] for name in others):
        raise ValueError(f"keys that miss: { {name: r[name] for name in others} } of {r['n']}")
    return df


def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    """``df`` with ``prefix`` before the names of all columns but ``key``, to be joined without clashes."""
    return df.select(key, *[F.col(c).alias(prefix + c) for c in df.columns if c != key])


def with_row_index(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``row_index``, its gapless place by ``order``: what positional look-ups join on."""
    return ordinal(df, *order).withColumnRenamed("_place", "row_index")
