"""Benchmark decontamination: size-partitioned MinHash containment search.

Short items hide in long documents, where the Jaccard similarity of the whole texts is
too small for any signature.  A document is first reduced to its hits, the shingles that some item holds:
no other one can be in both.  Then both sides are partitioned by size: items into
classes of at most 1, 2, 4, 8, ... shingles, and for a class of at most ``u`` shingles the hits of a
document, in order, into windows of ``2 * u`` at a step of ``u``, so that any passage of an
item lies whole in one window; a document with at most ``2 * u`` different hits is one window, wherever in it they
stand.  A window and an item of its class that share 0.8 of the item's shingles have a Jaccard similarity
of 0.19 at least; with ``PERMUTATIONS`` minima, one in a band, such a pair is missed with a chance of 1e-6.
Candidates are then verified by the exact share of the item's shingles in the whole document.  What may be
missed beyond that: an item whose shingles do not stand together, in a document with more than ``2 * u``
different hits.

Distribution: one scan of the documents without a shuffle.  Items are sent to the
executors in blocks of at most ``ITEMS`` (the bound of what is broadcast); more items
make more scans.

Values: an item or document that is null, empty or without words holds no shingle and
matches nothing; an item of fewer words than a shingle is one shingle of all its
words; very long texts are hashed in pieces; repeated rows give one result row;
empty tables give an empty result; other columns are ignored by :func:`leaks` and
kept by :func:`clean`.  Rows with a null doc_id are searched like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm.shared import lasting, lean, numbered, packed, row_key, small, unpacked, written

SHINGLE = 5
CONTAINMENT = 0.8
PERMUTATIONS = 64
#: Items in a broadcast block.
ITEMS = 20_000
#: Bytes of text hashed at once.
PIECE = 1 << 20

#: A-Z to lower case; white space, controls and ASCII punctuation to a blank.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_U = np.uint64
MIX = np.array([xxhash.xxh64_intdigest(f"word {j}") | 1 for j in range(SHINGLE)], np.uint64)
SALT = np.array([[xxhash.xxh64_intdigest(f"times {j}") | 1, xxhash.xxh64_intdigest(f"plus {j}")] for j in range(PERMUTATIONS)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words from the words' hashes."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += w[j : j + n] * MIX[j]
    return _scrambled(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set of shingle hashes."""
    return np.array([_scrambled(shingles * a + b).min() for a, b in SALT], np.uint64)


def _keys(signature: np.ndarray, size: int) -> np.ndarray:
    """A signature's bands (one minimum each) as keys that tell place and size class apart."""
    return _scrambled(signature * _U(2) + np.arange(PERMUTATIONS, dtype=np.uint64) * MIX[0] + np.full(PERMUTATIONS, size, np.uint64) * MIX[1])


class Index:
    """The signatures of a block of items by size class."""

    def __init__(self, items: list[tuple], shingle: int = SHINGLE):
        self.ids: list = []
        self.texts: list[tuple[int, frozenset]] = []  # words in a shingle, the shingles
        keys, owners, all_ = [], [], {}
        self.sizes: dict[int, set[int]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            k = min(shingle, len(words))
            got = frozenset(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
            hashes = np.unique(shingle_hashes(word_hashes(words), k))
            size = 1
            while size < len(hashes):
                size *= 2
            self.sizes.setdefault(k, set()).add(size)
            all_.setdefault(k, []).append(hashes)
            keys.append(_keys(minima(hashes), size))
            owners.append(np.full(PERMUTATIONS, len(self.ids)))
            self.ids.append(item_id)
            self.texts.append((k, got))
        flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.owners = flat[order], (np.concatenate(owners)[order] if owners else np.empty(0, int))
        self.known = {k: np.unique(np.concatenate(v)) for k, v in all_.items()}
        self.seen = {k: np.zeros(1 << 22, bool) for k in all_}
        for k, v in self.known.items():
            self.seen[k][(v & _U((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, shingles: np.ndarray, k: int) -> np.ndarray:
        """Places of ``shingles`` that hold a shingle of some item."""
        at = np.flatnonzero(self.seen[k][(shingles & _U((1 << 22) - 1)).view(np.int64)])
        if not len(at):
            return at
        known, got = self.known[k], shingles[at]
        return at[known[np.minimum(np.searchsorted(known, got), len(known) - 1)] == got]

    def candidates(self, hits: np.ndarray, k: int) -> set[int]:
        """Items that share a minimum with a window of ``hits``, shingles of items in the order of a document."""
        out: set[int] = set()
        kinds = np.unique(hits)
        for size in self.sizes[k]:
            if len(kinds) <= 2 * size:
                windows = [kinds]
            else:
                windows = [hits[at : at + 2 * size] for at in range(0, max(1, len(hits) - size), size)]
            for w in windows:
                keys = _keys(minima(w), size)
                lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
                for a, b in zip(lo[hi > lo], hi[hi > lo]):
                    out.update(self.owners[a:b].tolist())
        return out

    def found(self, texts: list[str | None], threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(text, item, shingles of the item in the text, containment) of all matches."""
        held: list[list[bytes]] = []
        first, size = 0, 0
        for t, text in enumerate(texts):
            held.append(words_of(text))
            size += len(text or "")
            if size >= PIECE or t == len(texts) - 1:
                yield from self._piece(held, first, threshold)
                held, first, size = [], t + 1, 0

    def _piece(self, docs: list[list[bytes]], first: int, threshold: float) -> Iterator[tuple[int, int, int, float]]:
        n = np.array([len(d) for d in docs], np.int64)
        w = np.concatenate([word_hashes(d) for d in docs])
        ends = np.cumsum(n)
        for k in self.sizes:
            s = shingle_hashes(w, k)
            hits = self.hits(s, k)
            owner = np.searchsorted(ends, hits, "right")
            whole = hits + k <= ends[owner]  # not across two documents
            hits, owner = hits[whole], owner[whole]
            for d in np.unique(owner).tolist():
                lo = int(ends[d] - n[d])
                mine = hits[np.searchsorted(owner, d, "left") : np.searchsorted(owner, d, "right")]
                cand = self.candidates(s[mine], k)
                if not cand:
                    continue
                words = docs[d]
                have = {b" ".join(words[h - lo : h - lo + k]) for h in mine.tolist()}
                for i in sorted(cand):
                    kk, want = self.texts[i]
                    share = len(want & have) / len(want) if kk == k else 0.0
                    if share >= threshold:
                        yield first + d, i, len(want & have), share


def leaks(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, containment) for each item of ``items`` (item_id, text)
    of which ``docs`` hold at least ``threshold`` of the shingles."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    item_kind = dict(items.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, n_shingles long, containment double"
    ordered = numbered(items.select("item_id", "text"), [F.col("item_id"), F.col("text")]).select("row.*", "rank")
    total = items.count()
    out = small(spark, [], schema)
    for at in range(0, total, ITEMS):
        block = ordered.where((F.col("rank") >= at) & (F.col("rank") < at + ITEMS)).collect()
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in block]))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                got = list(ix.found(b.column("text").to_pylist(), threshold))
                if got:
                    cols = [b.column("doc_id").take(pa.array([g[0] for g in got])), *[pa.array(x) for x in ([ix.ids[g[1]] for g in got], [g[2] for g in got], [g[3] for g in got])]]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "n_shingles", "containment"])

        part = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda b, run=run: lean(run(b)), schema)
        if total > ITEMS:  # one block after the other, so that one index at a time is held
            part = written(part)
            index.destroy()
        out = out.union(part)
    return out.distinct()


def clean(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns unchanged; rows are told apart by
    doc_id and text."""
    names = docs.columns
    bad = lasting(lambda: leaks(docs.select(row_key().alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias("key")).distinct())
    return packed(docs, row_key().alias("key")).join(bad, "key", "left_anti").select(*unpacked(names))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lasting(lambda: leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
