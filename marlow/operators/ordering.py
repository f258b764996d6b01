"""Places and running sums in a total order without a global window.

Rows are range-partitioned by the order and sorted; a row's place or sum is that within its
partition plus what the partitions before it hold.  The partitioned rows are
checkpointed in between (``spark.checkpoint.dir``), so that both passes see the same partitions
even if an executor is lost.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one only where the session names none and the master is local."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="marlow-checkpoint-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _laid(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` in range partitions by ``order``, with _part and _at, the place within."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = settled(rows)
    return rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def ordinal(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``_place``, the gapless place from 0 by ``order``."""
    rows = _laid(df, *order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return rows.join(F.broadcast(before), "_part").withColumn("_place", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def ordinal_within(df: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """``df`` with ``_place`` from 0 among the rows of its ``group`` and ``_size``, how many
    these are; a large group spreads over partitions."""
    placed = ordinal(df, group, *order)
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.withColumn("_start", F.sum("_size").over(Window.orderBy("_g")) - F.col("_size"))
    out = placed.join(starts, F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("_place", F.col("_place") - F.col("_start")).drop("_g", "_start")


def running(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``df`` with ``_before``: the sum of ``value`` over the rows of equal ``keys`` that come
    earlier by ``order``.  Rows of equal keys and order must be one row."""
    rows = _laid(df, *keys, order)
    sums = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_part")
    before = sums.select(*keys, "_part", (F.sum("_s").over(w) - F.col("_s")).alias("_base"))
    own = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, [*keys, "_part"]).withColumn("_before", F.col("_base") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_part", "_at", "_base")
