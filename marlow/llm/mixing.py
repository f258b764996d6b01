"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in a pseudo-random order of their ids, are cut into blocks.  A
source of weight ``w`` (weights add up to 1) has the window from ``floor(i / w)``
(release) to ``ceil((i + 1) / w)`` (deadline) for its block ``i``; slots are
given to the released block with the earliest deadline.  Every
slot is used, every deadline met, and after any number of slots each source is
within less than one block of its target.  Weights are exact fractions (a float counts as the decimal that it
prints as), and so are windows: nothing drifts, however long the schedule.

The schedule is made in frames of slots, each by a task of its own.  What each source has had at the border ``t``
of a frame follows from the weights alone: the schedule is run up to ``t`` from ``2 / w`` slots before (``w`` the least weight), where of the
sources within a block those with the earliest deadlines count as served.  No window of that start can be missed, and
no window that ends at ``t`` reaches back beyond it, so by Hall's condition the blocks between two borders always fit their windows.

Rows are kept whole: the schedule runs until the last source has had all its blocks,
and sources that end sooner start another epoch.  Without given weights the target
is the tempered share ``share ** alpha`` (alpha 0.7), which repeats less than the
uniform target does.

Distribution: places within a source come from a range partition on (source, hash,
doc_id), so a hot source spreads over tasks.  The schedule is a table of (source, block, epoch, slot), joined to the rows by source
and block: 16 rows at most have a key, so none is hot; up to ``SLOTS`` slots it is broadcast instead, which saves the rows a shuffle.

Values: a null source is a source of its own; null doc_ids and repeated rows are
rows like others; an empty table gives an empty result; other columns pass through
:func:`mixed`, but that columns of the new names give way; a source without a weight,
or a weight not above 0, raises ValueError, since its rows would be lost.
The sources with their counts (one row each) go to the driver and their weights to all tasks: sources are corpora or groups of hosts, not
documents, and more than ``SOURCES`` of them, some 100 MB, are refused with ValueError.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlow.llm.shared import lasting, lean, numbered, packed, shuffle_width, small, unpacked, written

#: Rows in a block.
BLOCK = 16
ALPHA = 0.7
#: Most sources.
SOURCES = 1_000_000
#: Slots in a frame, at least, and slots of a schedule that is broadcast, at most.
FRAME, SLOTS = 1 << 16, 1 << 19


def exact(weights: dict) -> dict:
    """The weights as fractions that add up to 1."""
    read = {s: Fraction(repr(float(w))) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    total = sum(read.values())
    return {s: w / total for s, w in read.items()}


class Pfair:
    """The schedule of sources 0, 1, ... with the given weights (fractions that add up to 1)."""

    def __init__(self, weights: list[Fraction]):
        self.up, self.down = [w.numerator for w in weights], [w.denominator for w in weights]
        #: Slots that a border looks back: beyond them every source has had a whole block more.
        self.back = -(-2 // min(weights)) + 1

    def release(self, s: int, i: int) -> int:
        return i * self.down[s] // self.up[s]

    def deadline(self, s: int, i: int) -> int:
        return -(-(i + 1) * self.down[s] // self.up[s])

    def run(self, had: list[int], begin: int, end: int, upto: list[int] | None = None) -> Iterator[tuple[int, int, int]]:
        """(source, block, slot) from ``begin`` to ``end``, the blocks before having been given; only blocks before ``upto``."""
        waiting = [(self.release(s, i), s, i) for s, i in enumerate(had) if upto is None or i < upto[s]]
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int]] = []
        for slot in range(begin, end):
            while waiting and waiting[0][0] <= slot:
                _, s, i = heapq.heappop(waiting)
                heapq.heappush(ready, (self.deadline(s, i), s, i))
            _, s, i = heapq.heappop(ready)
            yield s, i, slot
            if upto is None or i + 1 < upto[s]:
                heapq.heappush(waiting, (self.release(s, i + 1), s, i + 1))

    def border(self, t: int) -> list[int]:
        """The blocks that each source has had at the border ``t``."""
        start = max(0, t - self.back)
        had = [start * a // b for a, b in zip(self.up, self.down)]
        inside = [s for s, i in enumerate(had) if i * self.down[s] < start * self.up[s]]
        for s in sorted(inside, key=lambda s: (self.deadline(s, had[s]), s))[: start - sum(had)]:
            had[s] += 1
        for s, i, _ in self.run(list(had), start, t):
            had[s] = i + 1
        return had

    def frame(self, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(source, block, slot) of the slots between two borders."""
        return self.run(self.border(begin), begin, end, self.border(end))


def schedule(spark: SparkSession, weights: list[Fraction], slots: int, frame: int = FRAME) -> DataFrame:
    """(s, i, slot): source number and block of each of the first ``slots`` slots, a frame a task."""
    plan = Pfair(weights)
    size = max(frame, plan.back)
    shared = spark.sparkContext.broadcast(plan)
    frames = -(-slots // size)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column(0).to_pylist():
                rows = np.fromiter((x for row in shared.value.frame(f * size, min(slots, (f + 1) * size)) for x in row), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], names=["s", "i", "slot"])

    return spark.range(0, frames, 1, min(frames, 10_000)).mapInArrow(lambda b: lean(give(b)), "s long, i long, slot long")


def mixed(rows: DataFrame, weights: dict | None = None, block: int = BLOCK, alpha: float = ALPHA, frame: int = FRAME) -> DataFrame:
    """Every scheduled row: the columns of ``rows`` with ``block``, ``in_block``,
    ``epoch`` and ``slot`` (place of the block in the mixture)."""
    new = ("block", "in_block", "epoch", "slot")
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["source"]
    placed = numbered(rows, [F.col("source"), F.xxhash64("doc_id"), F.col("doc_id")], grouped=True)
    kept = unpacked(rows.columns, new)
    n = {r["k0"]: r["n"] for r in placed.groupBy("k0").agg(F.count(F.lit(1)).alias("n")).limit(SOURCES + 1).collect()}
    if len(n) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources; group them first")
    if not n:
        return placed.select(*kept, *[F.lit(0).cast("long").alias(c) for c in new])
    if weights is None:
        weights = {s: x**alpha for s, x in n.items()}
    lost = [s for s in n if not weights.get(s, 0) > 0]
    if lost:
        raise ValueError(f"no weight for sources {lost[:5]}")
    share = exact({s: weights[s] for s in n})
    order = sorted(n, key=lambda s: (s is not None, str(s)))
    blocks = [-(-n[s] // block) for s in order]
    slots = max(-(-b // share[s]) for s, b in zip(order, blocks))
    sources = F.broadcast(small(spark, [(s, k, b) for k, (s, b) in enumerate(zip(order, blocks))], f"name {kind}, s long, nb long"))
    given = written(schedule(spark, [share[s] for s in order], slots, frame).join(sources.select("s", "nb"), "s"))
    end = 1 + given.where(F.col("i") == F.col("nb") - 1).agg(F.max("slot")).first()[0]
    given = given.where(F.col("slot") < end).select("s", (F.col("i") % F.col("nb")).alias("block"), F.floor(F.col("i") / F.col("nb")).cast("long").alias("epoch"), "slot")
    cut = (
        placed.join(sources, F.col("k0").eqNullSafe(F.col("name")))
        .withColumn("block", F.floor(F.col("rank") / block).cast("long"))
        .withColumn("in_block", F.col("rank") - F.col("block") * block)
    )
    return cut.join(F.broadcast(given) if slots <= SLOTS else given, ["s", "block"]).select(*kept, "block", "in_block", "epoch", "slot")


def arranged(docs: DataFrame, **how) -> DataFrame:
    """The scheduled rows of ``docs``, columns unchanged, in files that follow the schedule."""
    inner = packed(docs, F.col("source"), F.col("doc_id"))
    out = mixed(inner, **how).repartitionByRange(shuffle_width(docs.sparkSession), "slot", "in_block").sortWithinPartitions("slot", "in_block")
    return out.select(*unpacked(docs.columns))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return lasting(lambda: mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")))
