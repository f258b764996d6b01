"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``POINTS`` points.  A row stands at the point its text hashes to, so
equal texts (a group) stand together; each shard owns ``vnodes`` points, and a row
belongs to the next owned point clockwise.  Loads are bounded by exact capacities
(row counts at most one apart, law ``rows``): a shard first takes its own arcs in
ring order, and what overflows a full shard continues clockwise to the next virtual
node with room.  A group is therefore split only where a shard is full, and a hot
group spreads over as many shards as it needs.

Distribution: rows are numbered in ring order by a range partition on (position,
doc_id); the driver sees one count for each ring point (at most ``POINTS``) and
fills the ring arc by arc, which gives intervals of that numbering.  Shard and slot
of a row follow from its interval by arithmetic; no group or shard meets in a task.

Values: null text has no bytes (size 1) and the checksum of the empty text; null
doc_ids sort first; repeated rows are rows of their own and change places freely;
an empty table gives an empty result; other columns pass through :func:`sharded`
as they are, but that columns named shard or slot give way to the new ones.
"""

from __future__ import annotations

from collections import deque

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlow.llm.shared import lasting, numbered, small, unpacked, written

POINTS = 1 << 16


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes in ring order; a taken point moves on to the next free one."""
    if n_shards * vnodes > POINTS // 2:
        raise ValueError("more virtual nodes than half the ring's points")
    owner: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            p = xxhash.xxh64_intdigest(f"shard {shard} node {v}") % POINTS
            while p in owner:
                p = (p + 1) % POINTS
            owner[p] = shard
    return sorted(owner.items())


def filled(counts: dict[int, int], n_shards: int, vnodes: int) -> list[tuple[int, int, int]]:
    """(lo, hi, shard) intervals of the ring-order numbering, by the bounded-load rule.

    ``counts``: rows at each ring point.  Row numbers start at point 0.
    """
    total = sum(counts.values())
    nodes = ring(n_shards, vnodes)
    free = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    starts, at = [], 0
    ends = []
    points = iter(sorted(counts.items()))
    nxt = next(points, None)
    for p, _ in nodes:
        starts.append(at)
        while nxt is not None and nxt[0] <= p:
            at += nxt[1]
            nxt = next(points, None)
        ends.append(at)
    out: list[tuple[int, int, int]] = []
    waiting: list[list[tuple[int, int]]] = [[] for _ in nodes]

    def own(i: int, lo: int, hi: int) -> None:
        shard = nodes[i][1]
        took = min(free[shard], hi - lo)
        if took:
            free[shard] -= took
            out.append((lo, lo + took, shard))
        if lo + took < hi:
            waiting[i].append((lo + took, hi))

    own(0, at, total)  # past the last node the ring wraps to the first
    for i in range(len(nodes)):
        own(i, starts[i], ends[i])
    carry: deque[tuple[int, int]] = deque()
    for step in range(2 * len(nodes) + 1):
        i = step % len(nodes)
        shard = nodes[i][1]
        while carry and free[shard]:
            lo, hi = carry.popleft()
            took = min(free[shard], hi - lo)
            free[shard] -= took
            out.append((lo, lo + took, shard))
            if lo + took < hi:
                carry.appendleft((lo + took, hi))
        if step < len(nodes):
            carry.extend(waiting[i])
    return sorted(out)


def sharded(rows: DataFrame, n_shards: int = 16, vnodes: int = 128, place: Column | None = None) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; ``place`` is the ring position of a row, by
    default that of its ``text``."""
    placed = numbered(rows, [position() if place is None else place, F.col("doc_id")])
    point = F.shiftright("k0", 47).cast("int")
    counts = {r["p"]: r["n"] for r in placed.groupBy(point.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first: dict[int, int] = {}
    at = 0
    for p in sorted(counts):
        first[p] = at
        at += counts[p]
    slots = [0] * n_shards
    cells: list[tuple] = []
    order = sorted(counts)
    k = 0
    for lo, hi, shard in filled(counts, n_shards, vnodes):
        while k and first[order[k]] > lo:
            k -= 1
        while k + 1 < len(order) and first[order[k + 1]] <= lo:
            k += 1
        j = k
        while j < len(order) and first[order[j]] < hi:
            cells.append((order[j], lo, hi, shard, slots[shard] - lo))
            j += 1
        slots[shard] += hi - lo
    table = F.broadcast(small(rows.sparkSession, cells, "p int, lo long, hi long, shard int, base long"))
    on = (point == F.col("p")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return placed.join(table, on).select(*unpacked(rows.columns, ("shard", "slot")), "shard", (F.col("rank") + F.col("base")).alias("slot"))


def position() -> Column:
    """Ring position of a text, 63 bits; its 16 high bits are the ring point."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    narrow = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), position().alias("pos")
    )
    # The narrow rows are written first: numbering samples its input, and so texts are read once.
    out = lasting(lambda: sharded(written(narrow), place=F.col("pos")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
