"""Vector code compression: a codebook for each of some equal parts of the vectors, by Lloyd's rounds with heaps.

Every part of a vector lies in the heap of its codebook entry, within the block of vectors that a task holds.  Its key is the
slack, the lower bound of its distance to any other entry less the upper bound to its own, plus the drift that the entry had
gathered when the part came in.  After a round each entry's drift grows by its own movement and the largest of the others.
As long as a key is above that number the part can't have changed its entry; so each heap gives up just the parts
whose bounds are violated, and these are compared with the whole codebook, exactly, in whole numbers.
Bounds are rounded to the safe side and a tie counts as violated, so the result is that of plain rounds.

Distribution: blocks of vectors with their heaps are rows of a table in the shared folder, written anew in each round; the
round before is then removed.  A block reports only what its moved parts change in the sums of entries,
which are added up by place in the codebook.  The driver sees those sums, ``parts * entries * (width + 1)`` numbers at
most, and broadcasts the codebook and its drifts.  Error sums of labels that hold a thousandth of the rows or more (a thousand at most) are broadcast, the
others are joined by label.

Values: rows whose vector is null, or has a null or non-finite component, are dropped; a null vec_id stands last;
rows that share a vec_id are ordered by their vectors; repeated rows are vectors like others; vectors of unequal lengths, and lengths that the parts don't
divide, are filled up with zeros; components so large that an error could pass the range of a long are cut to that
range; a label's error that passes it is null; fewer vectors than entries make as many entries; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm.shared import forget, lasting, lean, small, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a block, and the share of all rows (one in so many) from which a label's error is broadcast.
BLOCK, HEAVY = 8192, 1000
#: Relative width by which bounds are rounded to the safe side.
SAFE = 1e-9

_HEAP = np.dtype([("key", "<f8"), ("row", "<i4")])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``c``, exact: through floats while every sum stays below 2**53."""
    top = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top * top * max(1, x.shape[1]) < 1 << 52:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for e in range(len(c)):
        d = x - c[e]
        out[:, e] = (d * d).sum(1)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties to the lowest), and its slack rounded to the safe side."""
    d = distances(x, c)
    first = d.argmin(1)
    own = d[np.arange(len(x)), first]
    if len(c) == 1:
        return first, np.full(len(x), np.inf)
    d[np.arange(len(x)), first] = np.iinfo(np.int64).max
    upper, lower = np.sqrt(own.astype(np.float64)), np.sqrt(d.min(1).astype(np.float64))
    return first, lower - upper - SAFE * (lower + upper + 1)


class Heaps:
    """The heaps of one part position in a block."""

    def __init__(self, entries: int):
        self.of: list[list[tuple[float, int]]] = [[] for _ in range(entries)]

    @classmethod
    def read(cls, data: bytes, sizes: bytes) -> Heaps:
        ends = np.cumsum(np.frombuffer(sizes, "<i4"))
        items = np.frombuffer(data, _HEAP)
        pairs = list(zip(items["key"].tolist(), items["row"].tolist()))
        out = cls(len(ends))
        out.of = [pairs[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]  # a heap's order is kept in the bytes
        return out

    def bytes(self) -> tuple[bytes, bytes]:
        items = np.array([x for h in self.of for x in h], _HEAP)
        return items.tobytes(), np.array([len(h) for h in self.of], "<i4").tobytes()

    def violated(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take out the parts whose key the drift of their entry has reached; (rows, entries)."""
        rows, old = [], []
        for e, (heap, limit) in enumerate(zip(self.of, drift.tolist())):
            while heap and heap[0][0] <= limit:
                rows.append(heappop(heap)[1])
                old.append(e)
        return np.array(rows, np.int64), np.array(old, np.int64)

    def add(self, rows: np.ndarray, entries: np.ndarray, keys: np.ndarray, first: bool) -> None:
        for r, e, k in zip(rows.tolist(), entries.tolist(), keys.tolist()):
            if first:
                self.of[e].append((k, r))
            else:
                heappush(self.of[e], (k, r))
        if first:
            for h in self.of:
                heapify(h)

    def entries(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        for e, h in enumerate(self.of):
            if h:
                out[[r for _, r in h]] = e
        return out


def _moved(x: np.ndarray, rows: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> np.ndarray:
    """What moved parts change in the sums and counts of entries: (entries, width + 1)."""
    out = np.zeros((entries, x.shape[1] + 1), np.int64)
    full = np.c_[x[rows], np.ones(len(rows), np.int64)]
    np.add.at(out, new, full)
    if old is not None:
        np.subtract.at(out, old, full)
    return out


def _whole(column: pa.Array, width: int, most: int) -> np.ndarray:
    """Vectors as rows of whole numbers, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE), -most, most).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _limit(width: int) -> int:
    """The largest component for which no error of a vector passes a long."""
    return min((1 << 31) - 1, math.isqrt((1 << 62) // max(1, width)) // 2)


_STATE = "vecs binary, n int, heaps array<binary>, sizes array<binary>, rescanned long, at array<int>, change array<long>"


def first_round(kept: DataFrame, codebook: np.ndarray) -> DataFrame:
    """Blocks with every part in the heap of its nearest entry."""
    shared = kept.sparkSession.sparkContext.broadcast(codebook)
    ids, labels = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    parts, entries, width = codebook.shape
    most = _limit(parts * width)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                piece = b.slice(lo, BLOCK)
                x = _whole(piece.column(2), parts * width, most)
                heaps, change = [], []
                for p in range(parts):
                    part = x[:, p * width : (p + 1) * width]
                    new, slack = nearest(part, shared.value[p])
                    h = Heaps(entries)
                    h.add(np.arange(len(x)), new, slack, first=True)
                    heaps.append(h)
                    change.append(_moved(part, np.arange(len(x)), None, new, entries))
                yield _row(piece.column(0), piece.column(1), x, heaps, len(x) * parts, np.stack(change))

    return kept.select("vec_id", "label", "vec").mapInArrow(lambda b: lean(block(b)), f"ids array<{ids}>, labels array<{labels}>, {_STATE}")


def _row(ids: pa.Array, labels: pa.Array, x: np.ndarray, heaps: list[Heaps], rescanned: int, change: np.ndarray) -> pa.RecordBatch:
    flat = change.reshape(-1)
    at = np.flatnonzero(flat)
    data, sizes = zip(*[h.bytes() for h in heaps])
    one = [0, len(ids)]
    columns = [pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, labels), pa.array([x.astype("<i4").tobytes()]), pa.array([len(x)], pa.int32())]
    columns += [pa.array([list(data)], pa.list_(pa.binary())), pa.array([list(sizes)], pa.list_(pa.binary())), pa.array([rescanned]), pa.array([at], pa.list_(pa.int32())), pa.array([flat[at]], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "vecs", "n", "heaps", "sizes", "rescanned", "at", "change"])


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple]:
    """(ids, labels, vectors, heaps) of each block in its rows."""
    for b in batches:
        for k in range(b.num_rows):
            x = np.frombuffer(b.column("vecs")[k].as_py(), "<i4").astype(np.int64).reshape(b.column("n")[k].as_py(), parts * width)
            heaps = [Heaps.read(d, s) for d, s in zip(b.column("heaps")[k].as_py(), b.column("sizes")[k].as_py())]
            yield b.column("ids")[k].values, b.column("labels")[k].values, x, heaps


def _rescan(x: np.ndarray, heaps: list[Heaps], codebook: np.ndarray, drift: np.ndarray) -> tuple[int, np.ndarray]:
    """Bring all heaps up to ``codebook``; (parts rescanned, changes of the sums)."""
    parts, entries, width = codebook.shape
    total, change = 0, np.zeros((parts, entries, width + 1), np.int64)
    for p, h in enumerate(heaps):
        rows, old = h.violated(drift[p])
        if len(rows):
            part = x[:, p * width : (p + 1) * width]
            new, slack = nearest(part[rows], codebook[p])
            h.add(rows, new, slack + drift[p][new], first=False)
            m = np.flatnonzero(new != old)
            change[p] = _moved(part, rows[m], old[m], new[m], entries)
            total += len(rows)
    return total, change


def next_round(blocks: DataFrame, codebook: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after a rescan of the parts that the drift has set free."""
    shared = blocks.sparkSession.sparkContext.broadcast((codebook, drift))
    parts, _, width = codebook.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x, heaps in _blocks(batches, parts, width):
            rescanned, change = _rescan(x, heaps, *shared.value)
            yield _row(ids, labels, x, heaps, rescanned, change)

    return blocks.mapInArrow(lambda b: lean(step(b)), blocks.schema)


def coded(blocks: DataFrame, codebook: np.ndarray, drift: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    shared = blocks.sparkSession.sparkContext.broadcast((codebook, drift))
    parts, _, width = codebook.shape
    ids, labels = (blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vec_id, label, x, heaps in _blocks(batches, parts, width):
            _rescan(x, heaps, *shared.value)
            book = shared.value[0]
            chosen = np.stack([h.entries(len(x)) for h in heaps])
            error = sum(((x[:, p * width : (p + 1) * width] - book[p][chosen[p]]) ** 2).sum(1) for p in range(parts))
            code = ["".join(f"{e:02x}" for e in es) for es in chosen.T.tolist()]
            yield pa.RecordBatch.from_arrays([vec_id, label, pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(lambda b: lean(step(b)), f"vec_id {ids}, label {labels}, code string, error long")


def _updated(codebook: np.ndarray, sums: np.ndarray) -> np.ndarray:
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), codebook)


def _drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much the bounds of each entry's parts may have lost: its own movement and the largest of the others."""
    step = np.sqrt(((new - old).astype(np.float64) ** 2).sum(2)) * (1 + SAFE)
    out = step.copy()
    if step.shape[1] > 1:
        for p, s in enumerate(step):
            far = int(s.argmax())
            other = np.full(len(s), s[far])
            other[far] = np.delete(s, far).max()
            out[p] += other
    return out * (1 + SAFE)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, column: str = "embedding", scans: list | None = None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept; ``scans`` gets the number of parts
    compared with the codebook in each round."""
    spark = vectors.sparkSession
    vec = F.col(column)
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where(vec.isNotNull() & finite).select("vec_id", "label", vec.alias("vec"))
    longest = kept.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return kept.select("vec_id", *[F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")])
    width = -(-longest // parts)
    seed = [r["vec"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()]
    start = _whole(pa.array(seed, pa.list_(pa.float64())), parts * width, _limit(parts * width))
    codebook = np.ascontiguousarray(start.reshape(len(seed), parts, width).transpose(1, 0, 2))
    sums = np.zeros((*codebook.shape[:2], width + 1), np.int64)
    drift = np.zeros(codebook.shape[:2])
    blocks = None
    for _ in range(rounds):
        before, blocks = blocks, written(first_round(kept, codebook) if blocks is None else next_round(blocks, codebook, drift))
        if before is not None:
            forget(before)
        changes = blocks.select(F.explode(F.arrays_zip("at", "change")).alias("x")).groupBy("x.at").agg(F.sum("x.change").alias("change"))
        flat = sums.reshape(-1)
        for r in changes.collect():
            flat[r["at"]] += r["change"]
        if scans is not None:
            scans.append(blocks.agg(F.sum("rescanned")).first()[0])
        new = _updated(codebook, sums)
        drift += _drift(codebook, new)
        codebook = new
    result = written(coded(blocks, codebook, drift))
    forget(blocks)
    digest = hashlib.sha256(",".join(map(str, codebook.reshape(-1).tolist())).encode()).hexdigest()
    return _with_label_errors(result).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _with_label_errors(result: DataFrame) -> DataFrame:
    """The errors summed over equal labels (nulls together): frequent labels by broadcast, so that none is hot in the join of the others."""
    rows = result.count()
    sums = written(result.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    heavy = F.broadcast(sums.where(F.col("n") * HEAVY >= rows).select("of", F.col("label_error").alias("heavy_error"), F.lit(True).alias("is_heavy")))
    marked = result.join(heavy, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    light = sums.where(F.col("n") * HEAVY < rows).select("of", "label_error")
    done = marked.where("is_heavy").withColumn("label_error", F.col("heavy_error")).drop("heavy_error", "is_heavy")
    rest = marked.where("is_heavy IS NULL").drop("heavy_error", "is_heavy").join(light, F.col("label").eqNullSafe(F.col("of")))
    return done.unionByName(rest.drop("of"))


def op12_compression(spark, sf_dir: str) -> DataFrame:
    return lasting(lambda: compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
