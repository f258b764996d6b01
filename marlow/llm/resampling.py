"""Importance resampling towards a target distribution.

The words of all documents and of the target texts (the benchmark) are counted by hash bucket; a bucket's gain is the
smoothed log ratio of the two.  A document's weight is the mean gain over its words, looked up in one array, and its
score adds seeded Gumbel noise, so that the highest scores are a draw without repetition.

The threshold is found exactly by radix selection: the composite key (score downwards, doc_id upwards, row
number) is cut into digits of ``DIGIT`` bits, most significant first.  Each pass counts the rows that
still share the prefix by their next digit and keeps the digit in which the k-th key lies; it ends as soon as a digit is taken
whole.  Only the rows up to that key are then sorted by range and ranked.

Distribution: two passes over the texts.  Each task adds up its own counts in an array of ``BUCKETS`` numbers, so a frequent
word is one number a task in the shuffle; scores are written as one narrow row a document and all selection passes read
that table.  The driver sees ``BUCKETS`` counts and, in each pass, ``2**DIGIT`` counts; it broadcasts ``BUCKETS`` gains.

Values: a null text has no words (weight 0, never drawn); a null doc_id has the noise of an empty id and stands last among equal scores;
rows that share a doc_id are drawn each for itself, rows equal in score and doc_id in the order of
their features, then as they stand in the files; doc_ids that are no whole numbers go by their own order; an empty table
gives an empty result, an empty target only smooths; other columns are ignored.  Texts are read in slices of
``SLICE`` bytes, so very long ones cost no more memory than others.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from marlow.llm.shared import lasting, lean, numbered, written

BUCKETS = 10_000
SEED = 2024
#: Least words of a document that can be drawn, and the percentage of these that is drawn.
LEAST, PERCENT = 20, 10
#: Bits of a digit of the selection.
DIGIT = 12
#: Bytes of text that are cut into words at once, and the longest word whose checksum is taken beside others.
SLICE, LONG = 1 << 21, 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


_CRC = _crc_table()


def _checksums(line: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of ``line``: one step a byte for all words at once, long ones each alone."""
    size = ends - starts
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -LONG) :]
    for k in np.flatnonzero(size > LONG):
        out[k] = zlib.crc32(line[starts[k] : ends[k]].tobytes())
    if len(order):
        longest, at = size[order], starts[order]
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for k in range(int(longest[0])):
            n = int(np.searchsorted(-longest, -k))  # words of more than k bytes
            c = crc[:n]
            crc[:n] = _CRC[(c ^ line[at[:n] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
        out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """The bytes of some texts, each ended by a byte that is in no word, with the texts' numbers and their ends; a
    text longer than a slice comes in several, cut between words (a word longer than a slice stays whole)."""
    group: list[bytes] = []
    owners: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        data = memoryview(text.as_buffer()) if text.is_valid else b""
        at = 0
        while at < len(data):
            end = min(len(data), at + SLICE)
            while end < len(data) and _IN_WORD[_LOWER[data[end]]]:
                step = np.flatnonzero(~_IN_WORD[_LOWER[np.frombuffer(data[end : end + SLICE], np.uint8)]])
                end = end + int(step[0]) if len(step) else min(len(data), end + SLICE)
            group.append(bytes(data[at:end]))
            owners.append(k)
            size += end - at
            at = end
            if size >= SLICE:
                yield np.frombuffer(b" ".join(group) + b" ", np.uint8), owners, np.cumsum([len(g) + 1 for g in group]).tolist()
                group, owners, size = [], [], 0
    if group:
        yield np.frombuffer(b" ".join(group) + b" ", np.uint8), owners, np.cumsum([len(g) + 1 for g in group]).tolist()


def bucketed(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of every word, slice by slice."""
    for raw, owners, ends in _slices(texts):
        line = _LOWER[raw]
        edge = np.diff(np.r_[False, _IN_WORD[line]].astype(np.int8))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            yield np.asarray(owners)[np.searchsorted(ends, starts, "right")], (_checksums(line, starts, stops) % np.uint32(buckets)).astype(np.int64)


def counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket has a word of the column ``text``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket in bucketed(b.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = df.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda b: lean(add(b)), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths, rounded down."""
    n, total_have, total_want = len(have), float(have.sum()), float(want.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (total_have + n) / ((s + 1.0) * (total_want + n)))) for s, t in zip(have.tolist(), want.tolist())], np.int64)


def noise(key: str, seed: int = SEED) -> int:
    """Seeded Gumbel noise in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score) of every document."""
    table = gains(counts(docs, buckets), counts(target, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema["doc_id"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for owner, bucket in bucketed(b.column(2), buckets):
                first = owner[0]
                n[first : owner[-1] + 1] += np.bincount(owner - first)
                edges = np.flatnonzero(np.r_[True, np.diff(owner) > 0])
                total[owner[edges]] += np.add.reduceat(gain[bucket], edges)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            luck = np.array([noise(k, seed) for k in b.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(weight), pa.array(weight + luck)], names=["doc_id", "n_features", "weight", "score"])

    narrow = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(lambda b: lean(score(b)), f"doc_id {kind.simpleString()}, n_features long, weight long, score long")


def selected(df: DataFrame, keys: list[tuple[Column, int]], k: int) -> Column:
    """The condition that holds for the ``k`` rows of ``df`` (0 < k <= rows) with the least composite key.

    ``keys`` are whole numbers from 0 with their bits, most significant first; together they tell rows apart.
    Each pass counts rows by one digit, among those that share all digits before.
    """
    before: list[tuple[Column, int]] = []  # components that are settled, with their values
    for x, bits in keys:
        prefix, shift = 0, bits
        while shift:
            step = min(DIGIT, shift)
            shared = [y == F.lit(v) for y, v in before]
            if shift < bits:
                shared.append(F.shiftright(x, shift) == F.lit(prefix))
            shift -= step
            rows = df
            for c in shared:
                rows = rows.where(c)
            found = rows.groupBy(F.shiftright(x, shift).bitwiseAND(F.lit((1 << step) - 1)).alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()
            done = False
            for r in sorted(found, key=lambda r: r["digit"]):
                if k <= r["n"]:
                    prefix, done = prefix << step | r["digit"], k == r["n"]
                    break
                k -= r["n"]
            if done:
                return _upto(before, F.shiftright(x, shift), prefix)
        before.append((x, prefix))
    (x, prefix) = before.pop()
    return _upto(before, x, prefix)


def _upto(before: list[tuple[Column, int]], x: Column, value: int) -> Column:
    out = x <= F.lit(value)
    for y, v in reversed(before):
        out = (y < F.lit(v)) | ((y == F.lit(v)) & out)
    return out


def _components(df: DataFrame) -> list[tuple[Column, int]]:
    """The selection key's components: score downwards, ``id`` upwards (null last), features, row number."""
    lo, hi, id_lo, id_hi, most, rows = df.agg(F.min("score"), F.max("score"), F.min("id"), F.max("id"), F.max("n_features"), F.max("at")).first()
    parts = [((F.lit(hi) - F.col("score")), hi - lo)]
    if id_lo is not None:
        parts.append((F.col("id").isNull().cast("long"), 1))
        if id_hi - id_lo < 1 << 62:
            parts.append((F.coalesce(F.col("id") - F.lit(id_lo), F.lit(0)), id_hi - id_lo))
        else:  # from the very least to the very largest number: in two halves
            parts += [(F.coalesce(F.shiftright("id", 32) + F.lit(1 << 31), F.lit(0)), (1 << 32) - 1), (F.coalesce(F.col("id").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)), (1 << 32) - 1)]
    parts += [(F.col("n_features"), most), (F.col("at"), rows)]
    return [(c.cast("long"), int(top).bit_length()) for c, top in parts if top]


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document; ``rank`` from 1 for those drawn, else null."""
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    if not whole:  # numbers in the order of the ids; rows without an id have none
        order = numbered(docs.select("doc_id", "text"), [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")])
        docs = order.select("row.doc_id", "row.text", F.when(F.col("row.doc_id").isNotNull(), F.col("rank")).alias("id"))
        first = written(docs.groupBy("doc_id").agg(F.min("id").alias("id")))
    table = scored(docs, target, seed, buckets)
    table = table.withColumn("id", F.col("doc_id").cast("long")) if whole else table.join(first, "doc_id", "left")
    table = written(table.withColumn("at", F.monotonically_increasing_id()))
    can = table.where(F.col("n_features") >= least)
    k = percent * can.count() // 100
    names = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return table.select(*names, F.lit(None).cast("long").alias("rank"))
    parts = _components(can)
    drawn = (F.col("n_features") >= least) & selected(can, parts, k)
    order = [F.col("score") * -1, F.col("id").isNull(), F.col("id"), F.col("n_features"), F.col("at")]
    ranked = numbered(table.where(drawn), order)
    return ranked.select(*[f"row.{c}" for c in names], (F.col("rank") + 1).alias("rank")).union(table.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    return lasting(lambda: resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
