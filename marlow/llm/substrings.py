"""Substring dedup: content-defined chunking with a gear rolling hash.

Chunks end where the low byte of a gear hash (which sees the last 8 bytes) falls below a
threshold, so an insertion moves no boundary but those next to it.  The unit that is
deduplicated by digest is a run of ``RUN`` chunks in a row (the bytes from the first
one's start to the last one's end, 96-bit digest): single chunks of some 25 bytes
repeat by chance, runs hardly do.  A unit is a duplicate where its digest also stands in
a row before it, by doc_id and then by a hash of the text; the first one keeps it.
Overlapping and touching duplicate units become spans.  Repeats within one row are not duplicates.

A passage reaches further than the units within it.  How far is measured by a ladder of short
hashes of the bytes before and after each unit, compared with those of the row that it repeats; spans
that reach over less than ``LEAST`` bytes so are left alone.  Only the span itself, whose bytes the digests prove
equal, is reported and cut.

Distribution: each task chunks its rows and settles digests among them first
(one entry for each digest and its first row goes on, the rest is known to be
duplicate), which takes a hot passage out of the shuffle; equal rows are chunked once, and places of a row at even
steps with the same digest and surroundings are one entry, so neither copies of a row nor repeats within it add to what is sent.  Entries travel as packed
arrays, one row for each task and bucket; a bucket is sorted in numpy, one at a
time.  Buckets follow the number of shuffle partitions.

Values: null or empty texts have no chunks; rows with a null doc_id come last; rows that share a doc_id, or have none,
are told apart by their texts, and equal rows are one; doc_ids that are no whole numbers are
numbered in their order first; an empty table gives an empty result; other columns are ignored by
:func:`duplicate_spans` and kept by :func:`without_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlow.llm.shared import lean, numbered, packed, shuffle_width

#: 256 / CUT is the mean distance of boundaries in bytes (16), before those too near are taken out (25).
CUT = 16
#: A boundary closer than this to the boundary before it is none.
NEAR = 8
#: Longest chunk.
FAR = 4096
#: Chunks in a unit.
RUN = 3
#: Shortest reach of a span that is reported, in bytes.
LEAST = 150
#: Bytes before and after a unit that are compared.
LADDER = (8, 16, 24, 40, 64)
#: Bytes of text chunked at once, and units that a task settles at once.
PIECE, SETTLE = 1 << 21, 1 << 20

PAD = bytes(32)
NO_ID = np.iinfo(np.int64).max
UNITS = np.dtype([("d1", "<u8"), ("d2", "<u4"), ("doc", "<i8"), ("sub", "<i8"), ("start", "<i4"), ("size", "<u2"), ("pre", "u1", len(LADDER)), ("post", "u1", len(LADDER)), ("step", "<i4"), ("times", "<i4")])
FOUND = np.dtype([("doc", "<i8"), ("sub", "<i8"), ("start", "<i4"), ("size", "<u2"), ("step", "<i4"), ("times", "<i4"), ("pre", "u1"), ("post", "u1")])

#: Gear values (the low byte is all that counts); byte 0 has none, so that padding between texts leaves no trace.
GEAR = np.array([0] + [xxhash.xxh32_intdigest(bytes([b]), 7) & 255 for b in range(1, 256)], np.uint8)
#: An odd number and its inverse modulo 2**64, for hashes of any stretch from one running sum.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places in ``data`` (uint8) before which a chunk may end, by content alone."""
    h = GEAR[data]
    step = 1
    while step < 8:  # the sum over 2 * step bytes from two sums over step bytes
        h[step:] = h[step:] + (h[:-step] << np.uint8(step))
        step *= 2
    at = np.flatnonzero(h < CUT) + 1
    at = at[at < len(data)]
    for _ in range(3):  # not within a character
        at = at + ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
    if len(at):
        at = at[np.r_[True, np.diff(at) >= NEAR]]
    return at


def chunk_edges(data: bytes, edges: np.ndarray) -> list[int]:
    """Edges of the chunks of one text from its boundaries, longest chunk FAR."""
    inner = edges.tolist()
    out = [0]
    for e in [*inner, len(data)]:
        while e - out[-1] > FAR:
            cut = out[-1] + FAR
            while cut > out[-1] + FAR - 4 and data[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(cut)
        if e > out[-1]:
            out.append(e)
    return out


@cache
def _powers(base: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, enough for one slice of :func:`rungs`."""
    x = np.full(PIECE + RUN * FAR + 2 * LADDER[-1] + 2, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def rungs(line: np.ndarray, starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (1 to 255; 0 where the text ends before) of the LADDER's stretches of ``line`` that end at ``starts``
    and that begin at ``ends``, within texts from ``lows`` to ``highs``; ``starts`` ascend, and PIECE bytes are hashed at once."""
    pre, post = np.zeros((len(starts), len(LADDER)), np.uint8), np.zeros((len(starts), len(LADDER)), np.uint8)
    at = 0
    while at < len(starts):
        stop = int(np.searchsorted(starts, starts[at] + PIECE))
        lo = max(0, int(starts[at]) - LADDER[-1])
        data = line[lo : int(ends[at:stop].max()) + LADDER[-1]].astype(np.uint64) + np.uint64(1)
        total = np.r_[np.uint64(0), np.cumsum(data * _powers(BASE)[: len(data)])]
        back = _powers(INVERSE)

        def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            x = (total[b] - total[a]) * back[a]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(BASE)
            return np.maximum(x >> np.uint64(56), np.uint64(1)).astype(np.uint8)

        s, e = starts[at:stop], ends[at:stop]
        for k, n in enumerate(LADDER):
            fit = np.flatnonzero(s - n >= lows[at:stop])
            pre[at + fit, k] = hashed(s[fit] - n - lo, s[fit] - lo)
            fit = np.flatnonzero(e + n <= highs[at:stop])
            post[at + fit, k] = hashed(e[fit] - lo, e[fit] + n - lo)
        at = stop
    return pre, post


def units(texts: list[bytes], docs: list[int], subs: list[int]) -> np.ndarray:
    """The units of all ``texts``, whose rows are known by ``docs`` and ``subs``."""
    digest = xxhash.xxh3_128_digest
    parts = []
    group: list[int] = []
    size = 0

    def done() -> None:
        line = np.frombuffer(PAD.join(texts[g] for g in group), np.uint8)
        cuts = boundaries(line)
        at = 0
        mine, spans = [], []
        for g in group:
            data = texts[g]
            lo, hi = np.searchsorted(cuts, (at + 1, at + len(data)))
            e = chunk_edges(data, cuts[lo:hi] - at)
            run = min(RUN, len(e) - 1)
            starts, ends = e[: len(e) - run], e[run:]
            u = np.zeros(len(starts), UNITS)
            both = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(starts, ends)]), "<u8").reshape(-1, 2)
            u["d1"], u["d2"], u["doc"], u["sub"], u["start"] = both[:, 0], both[:, 1] & np.uint64(0xFFFFFFFF), docs[g], subs[g], starts
            u["times"] = 1
            u["size"] = np.array(ends) - np.array(starts)
            mine.append(u)
            spans.append((at, at + len(data), len(u)))
            at += len(data) + len(PAD)
        u = np.concatenate(mine)
        n = [x[2] for x in spans]
        lows, highs = (np.repeat(np.array([x[k] for x in spans], np.int64), n) for k in (0, 1))
        starts = u["start"].astype(np.int64) + lows
        u["pre"], u["post"] = rungs(line, starts, starts + u["size"], lows, highs)
        parts.append(u)

    for k, data in enumerate(texts):
        if data:
            group.append(k)
            size += len(data)
        if size >= PIECE:
            done()
            group, size = [], 0
    if group:
        done()
    return np.concatenate(parts) if parts else np.empty(0, UNITS)


def settled(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units of the first row with their digest, duplicates found)."""
    if not len(u):
        return u, np.empty(0, FOUND)
    u = u[np.lexsort((u["start"], u["sub"], u["doc"], u["d2"], u["d1"]))]
    d1, d2, doc, sub = (np.ascontiguousarray(u[c]) for c in ("d1", "d2", "doc", "sub"))
    new = np.r_[True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    own = (doc == doc[first]) & (sub == sub[first])
    rest, kept = u[~own], u[first[~own]]
    found = np.empty(len(rest), FOUND)
    for c in ("doc", "sub", "start", "size", "step", "times"):
        found[c] = rest[c]
    for c in ("pre", "post"):
        same = np.logical_and.accumulate((rest[c] == kept[c]) & (rest[c] != 0), axis=1).sum(1)
        found[c] = np.array((0, *LADDER), np.uint8)[same]
    return joined_places(u[own]), found


def joined_places(u: np.ndarray) -> np.ndarray:
    """Units of a row with equal digest, size and surroundings at even steps as one entry (their places ascend): a row that
    repeats a passage sends it once."""
    if len(u) < 2 or (u["times"] > 1).any():
        return u
    like = np.ones(len(u) - 1, bool)
    for c in ("d1", "d2", "doc", "sub", "size"):
        like &= u[c][1:] == u[c][:-1]
    for c in ("pre", "post"):
        like &= (u[c][1:] == u[c][:-1]).all(1)
    step = np.diff(u["start"])
    cut = np.r_[True, ~like]  # where another entry begins, at least
    uneven = np.r_[False, False, step[1:] != step[:-1]]
    cut |= uneven & ~np.r_[True, cut[:-1]]
    at = np.flatnonzero(cut)
    out = u[at].copy()
    out["times"] = np.diff(np.r_[at, len(u)])
    several = out["times"] > 1
    out["step"][several] = step[at[several]]
    return out


def placed(f: np.ndarray) -> np.ndarray:
    """What was found, each place alone again."""
    if (f["times"] == 1).all():
        return f
    out = np.repeat(f, f["times"])
    nth = np.arange(len(out)) - np.repeat(np.cumsum(f["times"]) - f["times"], f["times"])
    out["start"] += (nth * out["step"]).astype(np.int32)
    out["times"] = 1
    return out


def _sent(bucket: list[int], kind: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])


def entries(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """What a task sends of its rows (doc_id, sub, text): one entry for each digest and its first row by bucket (kind 0), and
    the duplicates of these (kind 1).  Equal rows are chunked once between two settlements."""
    held: list[np.ndarray] = []
    seen: set[tuple[int, int]] = set()
    count = 0

    def out() -> pa.RecordBatch:
        own, found = settled(np.concatenate(held))
        bucket, kind, blob = [], [], []
        # Units are in the order of d1, and so buckets are ranges of it.
        cuts = np.searchsorted(own["d1"], np.array([((1 << 64) * b + buckets - 1) // buckets for b in range(1, buckets)], np.uint64)) if buckets > 1 else np.empty(0, int)
        for b, part in enumerate(np.split(own, cuts)):
            if len(part):
                bucket.append(b), kind.append(0), blob.append(part.tobytes())
        if len(found):
            for b, part in enumerate(np.array_split(found, min(buckets, 1 + len(found) // 4096))):
                bucket.append(int((int(part["doc"][0]) + b) % buckets)), kind.append(1), blob.append(part.tobytes())
        return _sent(bucket, kind, blob)

    for batch in batches:
        rows = [(NO_ID if d is None else d, s) for d, s in zip(batch.column("doc_id").to_pylist(), batch.column("sub").to_pylist())]
        fresh = []
        for k, row in enumerate(rows):
            if row not in seen:
                seen.add(row)
                fresh.append(k)
        column = batch.column("text")
        texts = [(column[k].as_py() or "").encode("utf-8", "surrogatepass") for k in fresh]
        u = units(texts, [rows[k][0] for k in fresh], [rows[k][1] for k in fresh])
        held.append(u)
        count += len(u)
        if count >= SETTLE:
            yield out()
            held, count = [], 0
            seen.clear()
    if held:
        yield out()


def duplicate_units(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, start, size, pre, post) of every duplicate unit of ``docs`` (doc_id a long, text), in bytes of
    the UTF-8 text; ``sub`` is the text's hash, ``pre`` and ``post`` how far the match goes on."""
    buckets = 4 * shuffle_width(docs.sparkSession)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def give(f: np.ndarray) -> Iterator[pa.RecordBatch]:
            total = np.cumsum(f["times"])
            for few in np.split(f, np.searchsorted(total, np.arange(1 << 16, total[-1] if len(f) else 0, 1 << 16))):
                p = placed(few)
                cols = [pa.array(p["doc"].copy(), mask=p["doc"] == NO_ID), pa.array(p["sub"].copy()), *[pa.array(p[c].astype(np.int32)) for c in ("start", "size", "pre", "post")]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sub", "start", "size", "pre", "post"])

        for batch in batches:
            for b, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob")):
                if kind:
                    yield from give(np.frombuffer(blob.as_buffer(), FOUND))
                    continue
                if b != at:
                    if held:
                        yield from give(settled(np.concatenate(held))[1])
                    at, held = b, []
                held.append(np.frombuffer(blob.as_py(), UNITS))
        if held:
            yield from give(settled(np.concatenate(held))[1])

    sent = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("sub"), F.col("text").cast("string")).mapInArrow(lambda b: lean(entries(b, buckets)), "bucket int, kind int, blob binary")
    return sent.repartition(buckets // 4, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda b: lean(merged(b)), "doc_id long, sub long, start int, size int, pre int, post int")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def duplicate_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text_hash, start, n_bytes, reach): the duplicate spans of each row of ``docs`` in bytes of its
    UTF-8 text, and the bytes that the repeated passage has around them at least; ``text_hash`` tells rows
    of one doc_id apart."""
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        return _spans(docs, least)
    ids = numbered(docs.where("doc_id IS NOT NULL").select("doc_id").distinct(), [F.col("doc_id")]).select(F.col("k0").alias("name"), "rank")
    ranked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("name"), "left").select(F.col("rank").alias("doc_id"), "text")
    return _spans(ranked, least).withColumnRenamed("doc_id", "rank").join(ids, "rank", "left").select(F.col("name").alias("doc_id"), "text_hash", "start", "n_bytes", "reach")


def _spans(docs: DataFrame, least: int) -> DataFrame:
    end = F.col("start") + F.col("size")
    order = Window.partitionBy("doc_id", "sub").orderBy("start", "size")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = duplicate_units(docs).withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", F.col("sub").alias("text_hash"), "run").agg(
        F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("n_bytes"), (F.max(end + F.col("post")) - F.min(F.col("start") - F.col("pre"))).alias("reach")
    )
    return spans.where(F.col("reach") >= least).drop("run")


def without_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the duplicate spans cut out of ``text``; other columns unchanged."""
    names = docs.columns
    spans = duplicate_spans(docs, least).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "n_bytes"))).alias("spans"))
    joined = packed(docs, F.col("doc_id").alias("id"), F.col("text").alias("body"), text_hash(F.col("text")).alias("hash")).join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    raw = "encode(body, 'UTF-8')"
    cut = f"""aggregate(spans, named_struct('at', 0, 'out', CAST('' AS BINARY)),
        (a, s) -> named_struct('at', s.start + s.n_bytes, 'out', a.out || substring({raw}, a.at + 1, s.start - a.at)),
        a -> decode(a.out || substring({raw}, a.at + 1), 'UTF-8'))"""
    text = F.when(F.col("spans").isNull() | F.col("body").isNull(), F.col("body")).otherwise(F.expr(cut))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
