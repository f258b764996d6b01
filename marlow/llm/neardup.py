"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints of ``64 * lanes`` bits are compared in tiles: numpy exclusive-or and bit
counts of all pairs of two tiles, where a pair of tiles whose population counts
differ by more than the radius is skipped.  Tiles are laid out by groups, so that the number of
compared pairs stays in proportion to the rows:

* one lane (:func:`clustered` by default): the bits are cut into ``radius + 2`` runs, and there is a layout for
  every pair of runs.  Two fingerprints that differ in at most ``radius`` bits agree on two
  runs at least, so no link is lost.  With radius 2 that is six layouts of 32 bits: a fingerprint meets
  one other by chance for each 700 million fingerprints;
* more lanes and a wide radius (:func:`one_of_each`): ``layouts`` layouts, grouped by the
  least value of a hash over the text's shingles.  Texts of Jaccard similarity 0.8 share
  one of 8 least values but for a chance of 3e-6.  What is linked so is a candidate only:
  each pair must have ``jaccard`` by its sets of shingles before it counts (:func:`alike`).

Exact copies fall together before (one row for each distinct fingerprint), a group
beyond ``UNIT`` fingerprints is split by population count and hash into pairs of
sub-tiles that are work units of their own, and a unit returns a star for each of
its components, not its pairs.  Stars are joined by
:func:`marlow.llm.shared.components`.  A task holds two sub-tiles at most.

Values: a text that is null, empty or without words has fingerprint zero and links
like any other; fewer words than a shingle give one shingle of all words; repeated
rows share a component; a null doc_id is never the smallest unless all are null; an
empty table gives an empty result; columns besides doc_id and text are ignored by
:func:`clustered` and kept by :func:`one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm.shared import components, lasting, lean, packed, row_key, shuffle_width, unpacked, written

#: Fingerprints that one work unit holds (twice as many for a pair of sub-tiles).
UNIT = 8192
#: Rows of a tile of the comparison.
TILE = 512
#: Shingle hashes whose bits are counted at once.
PIECE = 1 << 16
#: Shingles of the sets that one work unit holds (twice as many for a pair of sub-tiles).
HELD = 1 << 22


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """The SimHash of each array of shingle hashes: bits set in over half of them."""
    n = np.array([len(h) for h in hashes], np.int64)
    ones = np.zeros((len(hashes), 64), np.int64)
    flat = np.concatenate(hashes) if len(hashes) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(hashes)), n)
    for at in range(0, len(flat), PIECE):
        bits = np.unpackbits(flat[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + PIECE]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    bits = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _scrambled(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Salts of the further lanes and of the least values.
SALTS = [xxhash.xxh64_intdigest(f"salt {j}") for j in range(64)]


def fingerprinted(docs: DataFrame, k: int = 3, lanes: int = 1, layouts: int = 0, sets: bool = False) -> DataFrame:
    """(doc_id, fp, sig, pop, least, n) of each row's whole text: a long that names the
    fingerprint (with one lane it is the fingerprint), its bytes, its population
    count, the least values of ``layouts`` hashes over the shingles and how many these are.  With ``sets``
    each shingle counts once and ``fp`` names the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs: list[np.ndarray] = []
            held: list[np.ndarray] = []
            least: list[list[int]] = []
            named: list[int] = []
            many: list[int] = []
            size = 0

            def done() -> np.ndarray:
                parts = [fingerprints(held)] + [fingerprints([_scrambled(h, SALTS[j]) for h in held]) for j in range(1, lanes)]
                return np.stack(parts, 1)

            for text in b.column("text"):
                h = shingle_hashes(text.as_py(), k)
                if sets:
                    h = np.unique(h)
                    named.append(xxhash.xxh64_intdigest(h.tobytes()))
                held.append(h)
                many.append(len(h))
                if layouts:
                    least.append([int(_scrambled(h, SALTS[32 + j]).min().view(np.int64)) for j in range(layouts)] if len(h) else [])
                size += len(h)
                if size >= PIECE:
                    sigs.append(done())
                    held, size = [], 0
            sigs.append(done())
            sig = np.concatenate(sigs)
            raw = [r.tobytes() for r in sig.astype("<u8")]
            fp = np.array(named, np.uint64) if sets else sig[:, 0] if lanes == 1 else np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
            pops = np.bitwise_count(sig).sum(1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(fp.copy().view(np.int64)), pa.array(raw, pa.binary()), pa.array(pops), pa.array(least or [[]] * len(raw), pa.list_(pa.int64())), pa.array(many, pa.int64())], ["doc_id", "fp", "sig", "pop", "least", "n"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda b: lean(run(b)), f"doc_id {kind}, fp long, sig binary, pop int, least array<long>, n long")


class _Sets:
    """Union of numbered items; ``label`` holds the component of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        open_ = a != b
        if not open_.any():
            return
        pairs = np.unique(np.stack([np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])], 1), axis=0)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        for x in list(up):
            to[x] = top(x)
        self.label = to[self.label]


def common(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of common members of ``a[i]`` and ``b[j]`` (sorted sets) for each pair i, j."""
    if len(i) < 64:
        return np.fromiter((len(np.intersect1d(a[p], b[q], assume_unique=True)) for p, q in zip(i, j)), np.int64, len(i))
    rows, cols = np.unique(i), np.unique(j)
    x, y = np.concatenate([a[r] for r in rows]), np.concatenate([b[c] for c in cols])
    both = np.intersect1d(x, y)
    out = np.zeros((len(rows), len(cols)), np.float32)
    sides = []
    for flat, sets in ((x, [a[r] for r in rows]), (y, [b[c] for c in cols])):
        at = np.searchsorted(both, flat)
        known = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == flat) if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[known], kind="stable")
        sides.append((at[known][order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known][order], len(sets)))
    for lo in range(0, len(both), 4096):  # products of 0-1 matrices, exact below 2**24
        m = []
        for at, owner, n in sides:
            p, q = np.searchsorted(at, (lo, lo + 4096))
            one = np.zeros((n, min(4096, len(both) - lo)), np.float32)
            one[owner[p:q], at[p:q] - lo] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)


def linked(ids: np.ndarray, sigs: np.ndarray, radius: int, tile: int = TILE, sets: list[np.ndarray] | None = None, jaccard: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """(ids, roots) of all components of two members or more among the fingerprints
    ``sigs`` (a row of 64-bit lanes each); a root is the least id of its component.
    With ``sets`` a pair must have the similarity ``jaccard`` (a fraction) too."""
    pops = np.bitwise_count(sigs).sum(1, dtype=np.int32)
    order = np.argsort(pops, kind="stable")
    ids, sigs, pops = ids[order], sigs[order], pops[order]
    if sets is not None:
        sets = [sets[o] for o in order.tolist()]
        size = np.array([len(s) for s in sets], np.int64)
        over, under = jaccard
    groups = _Sets(len(ids))
    for a in range(0, len(ids), tile):
        for b in range(a, len(ids), tile):
            if pops[b] - pops[min(a + tile, len(ids)) - 1] > radius:
                break  # tiles further on have counts as large or larger
            apart = np.zeros((len(ids[a : a + tile]), len(ids[b : b + tile])), np.uint16)
            for lane in range(sigs.shape[1]):
                apart += np.bitwise_count(sigs[a : a + tile, None, lane] ^ sigs[None, b : b + tile, lane])
            near = apart <= radius
            if a == b:
                near &= np.tri(*near.shape, -1, dtype=bool)
            cols = np.flatnonzero(near.any(0))
            if not len(cols):
                continue
            first = True
            if sets is None:
                groups.join(a + near[:, cols].argmax(0), b + cols)
                i, j = np.nonzero(near)
                groups.join(a + i, b + j)
                continue
            while True:  # pairs of one component need no proof; the first open one of each column, then all
                i, j = np.nonzero(near & (groups.label[a : a + tile, None] != groups.label[None, b : b + tile]))
                if not len(i):
                    break
                some = np.unique(j, return_index=True)[1] if first else np.arange(len(i))
                i, j, first = i[some], j[some], False
                near[i, j] = False
                la, lb = size[a + i], size[b + j]
                fit = under * np.minimum(la, lb) >= over * np.maximum(la, lb)
                i, j, la, lb = i[fit], j[fit], la[fit], lb[fit]
                if len(i):
                    n = common(sets[a : a + tile], sets[b : b + tile], i, j)
                    good = under * n >= over * (la + lb - n)
                    groups.join(a + i[good], b + j[good])
    _, root, size = np.unique(groups.label, return_inverse=True, return_counts=True)
    many = size[root] > 1
    out, lab = ids[many], groups.label[many]
    if not len(out):
        return out, out
    by = np.lexsort((out, lab))
    first = np.r_[True, lab[by][1:] != lab[by][:-1]]
    return out[by], out[by][first][np.cumsum(first) - 1]


def links(fps: DataFrame, radius: int, layouts: int = 0, unit: int = UNIT) -> DataFrame:
    """Stars (a, b) over ``fp`` that connect just the distinct fingerprints (fp, sig,
    pop, least) that are linked through steps of at most ``radius`` bits."""
    spark = fps.sparkSession
    if layouts:
        groups = F.transform("least", lambda x, i: F.struct(i.alias("k"), x.alias("run")))
    else:
        cuts = [64 * k // (radius + 2) for k in range(radius + 3)]
        parts = [(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)), b - a) for a, b in zip(cuts, cuts[1:])]
        groups = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftleft(x, n).bitwiseOR(y).alias("run")) for k, ((x, _), (y, n)) in enumerate(combinations(parts, 2))])
    laid = fps.select("fp", "sig", "pop", F.explode(groups).alias("g")).select("fp", "sig", "pop", "g.k", "g.run")
    sizes = laid.groupBy("k", "run", "pop").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy("k", "run").agg(F.sum("n").alias("total")).where("total > 1")
    small = laid.join(totals.where(F.col("total") <= unit), ["k", "run"]).select(F.xxhash64("k", "run").alias("unit"), "k", "run", F.lit(0).alias("p"), F.lit(0).alias("q"), "fp", "sig")
    # Sub-tiles of groups beyond one unit: by population count, then by hash.
    hot = sizes.join(totals.where(F.col("total") > unit), ["k", "run"]).select("k", "run", "pop", F.ceil(F.col("n") / unit).cast("int").alias("m"))
    tiles = hot.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("k", "run", "pop", "m", "s", (F.col("pop") * (1 << 20) + F.col("s")).alias("tile"))
    other = tiles.select("k", "run", F.col("pop").alias("pop2"), F.col("tile").alias("tile2"))
    pairs = tiles.join(other, ["k", "run"]).where((F.col("tile") <= F.col("tile2")) & (F.col("pop2") - F.col("pop") <= radius))
    unit_id = F.xxhash64("k", "run", "tile", "tile2")
    sides = pairs.select("k", "run", "tile", F.col("tile").alias("p"), F.col("tile2").alias("q"), unit_id.alias("unit")).union(
        pairs.where("tile <> tile2").select("k", "run", F.col("tile2"), F.col("tile"), F.col("tile2"), unit_id)
    )
    big = (
        laid.join(hot, ["k", "run", "pop"])
        .withColumn("tile", F.col("pop") * (1 << 20) + F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
        .join(sides, ["k", "run", "tile"])
        .select("unit", "k", "run", "p", "q", "fp", "sig")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, raw = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if held and sum(map(len, held)) > 1:
                ids = np.concatenate(held)
                a, b = linked(ids, np.frombuffer(b"".join(raw), "<u8").reshape(len(ids), -1), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "k", "run", "p", "q")]
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            sig = batch.column("sig").to_pylist()
            new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)] if len(fp) else np.empty(0, bool)
            at = np.flatnonzero(new).tolist() + [len(fp)]
            for lo, hi in zip(at, at[1:]):
                this = tuple(c[lo] for c in cols)
                if this != key:
                    yield from done()
                    key, held, raw = this, [], []
                held.append(fp[lo:hi])
                raw += sig[lo:hi]
        yield from done()

    width = shuffle_width(spark)
    order = ("unit", "k", "run", "p", "q")
    return small.union(big).repartition(width, *order).sortWithinPartitions(*order).mapInArrow(lambda b: lean(run(b)), "a long, b long")


def alike(coarse: DataFrame, docs: DataFrame, k: int, radius: int, jaccard: tuple[int, int], unit: int = UNIT, held: int = HELD) -> DataFrame:
    """Stars (a, b) over ``fp`` that connect just the rows of ``coarse`` (key, fp, sig, n, root) that
    are linked through pairs of at most ``radius`` bits and a Jaccard similarity of ``jaccard``
    (a fraction), both of one ``root``; ``n`` is the size of a row's set.  ``docs`` (key, text) has the texts.

    A root is one work unit; beyond ``unit`` members or ``held`` shingles its members are dealt to sub-tiles by
    hash, and each pair of sub-tiles is a unit.  How many follows from ``n``, so the sets travel once, from
    the task that has the text to the unit."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.unique(shingle_hashes(t.as_py(), k)).astype("<u8").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("root", "fp", "sig", "m")], pa.array(got, pa.binary())], ["root", "fp", "sig", "m", "hashes"])

    sizes = coarse.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / unit, F.sum("n") / held)).cast("int").alias("m"))
    texts = docs.join(coarse.join(sizes, "root"), "key").dropDuplicates(["key"]).select("root", "fp", "sig", "m", "text")
    sets = texts.mapInArrow(lambda b: lean(shingled(b)), "root long, fp long, sig binary, m int, hashes binary")
    tile = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    dealt = sets.withColumn("t", tile).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).where("m = 1 OR s <> t")
    dealt = dealt.select("root", F.least("s", "t").alias("p"), F.greatest("s", "t").alias("q"), "fp", "sig", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sigs, raw = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                a, b = linked(np.array(ids, np.int64), np.frombuffer(b"".join(sigs), "<u8").reshape(len(ids), -1), radius, sets=[np.frombuffer(r, "<u8") for r in raw], jaccard=jaccard)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            for root, p, q, fp, sig, hashes in zip(*[b.column(c).to_pylist() for c in ("root", "p", "q", "fp", "sig", "hashes")]):
                if (root, p, q) != key:
                    yield from done()
                    key, ids, sigs, raw = (root, p, q), [], [], []
                ids.append(fp), sigs.append(sig), raw.append(hashes)
        yield from done()

    order = ("root", "p", "q")
    return dealt.repartition(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(lambda b: lean(run(b)), "a long, b long")


def clustered(docs: DataFrame, k: int = 3, radius: int = 2, lanes: int = 1, layouts: int = 0, jaccard: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.  With ``jaccard`` (a fraction)
    doc_id must be unique but for repeated rows, and linked pairs are verified by :func:`alike`."""

    def build() -> DataFrame:
        rows = written(fingerprinted(docs, k, lanes, layouts, jaccard is not None))
        fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("sig", "pop", "least", "n")]))
        roots = components(links(fps, radius, layouts))
        if jaccard:
            coarse = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp").select(F.col("rep").alias("key"), "fp", "sig", "n", "root")
            roots = components(alike(coarse, docs.select(F.col("doc_id").alias("key"), F.col("text").cast("string")), k, radius, jaccard))
        named = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        ids = named.join(least, "root").select("fp", "component_id")
        return rows.select("doc_id", "fp").join(ids, "fp").select("doc_id", "fp", "component_id")

    return lasting(build)


#: Of 256 bits, the distance of sets of 5-word shingles with a similarity of 0.8 is 39 on
#: average (48 for sets of 4 and 5, the worst); 76 leaves room for its spread, a miss of 3e-6 there.
STAGE = {"k": 5, "radius": 76, "lanes": 4, "layouts": 8, "jaccard": (4, 5)}


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` for each component, the one of the smallest doc_id (null is the
    largest; of rows with the same doc_id the one of the least text digest); columns unchanged.
    Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, stay where
    their texts are not alike.  ``how`` goes to :func:`clustered`, by default pairs whose sets of 5-word
    shingles have a similarity of 0.8 or more."""
    names = docs.columns
    keep = lasting(lambda: clustered(docs.select(row_key().alias("doc_id"), "text"), **{**STAGE, **how}).where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct())
    return packed(docs, row_key().alias("key")).join(keep, "key", "left_semi").dropDuplicates(["key"]).select(*unpacked(names))


def op5_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clustered(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
