"""Packing of tokenised documents into sequences by best-fit decreasing.

Documents longer than a sequence are first cut into full windows; what is left of each document is shorter than
a sequence.  These rests are placed longest first, each into the tightest window that still has room, which
a segment tree over the remaining capacity finds.  As all that matters of a rest is its length, and there are fewer
lengths than ``SIZE``, the schedule is made from the counts of lengths, a run of equal rests at once; it is the
same as if every rest were placed alone.

At the end the emptiest windows are dissolved: as many as fit into the gaps of ``CRUMB`` tokens and more that the
others have, and one more, of which what finds no gap goes to sequences of powers of two (or, if it nearly fills one, to one).  Their rests are cut at the ends of
the gaps.  So only gaps below ``CRUMB`` are padded, and all other documents stay whole.

Distribution: each task tokenises its documents and writes their lengths, the checksums of all pieces that need no further cut,
and the ids of the rest.  The driver sees the count of each length (fewer than ``SIZE``) and of the full windows of each task, and broadcasts
the schedule, whose size goes by the number of lengths, not by documents.  Rests get their place among those of equal
length by range partitions on (length, row), so that a length which a third of all documents have is spread
over many tasks.  Ids are read again, and joined by row number, only for the rests that are cut: the schedule knows them as ranges of
rows of a length.

Tokens: the different words of a group of texts are encoded once each and their ids laid out in the texts' order, which gives the ids of the
whole texts, since the tokenizer drops white space and no token reaches over it.  Words of Latin letters go to the same merges without
the steps that leave them as they are, and marks after them apart, as the tokenizer has it.

Values: a null text is empty: its document is the end id alone; null doc_ids and repeated rows are documents like others; an empty table gives an
empty result; other columns are ignored; very long texts are tokenised in slices of ``SLICE`` characters, cut at white space.  Which of the documents
of equal length go together follows the rows' order in the files.  Sequence ids are gapless from 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm.shared import lasting, lean, numbered, small, written

SIZE = 2048
#: Gaps of fewer tokens stay and are padded.
CRUMB = 16
#: The id at the end of each document.
END = 1
#: Characters of a text that are tokenised at once, and of texts that are looked up together; rows that are.
SLICE, GROUP, ROWS = 1 << 20, 1 << 23, 4096
#: Words that go to the tokenizer as one text.
PART = 1 << 15
#: Marks that are one token run after a letter, and letters that normalising leaves as they are but for their case.
MARKS = ".,;:!?%&$#*()[]{}/\\-_=+~@^`\""
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
#: Texts with separators that not all take for white space are tokenised whole.
ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]").search


# -- tokens


class Words:
    """The ids of words as bytes (little-endian, 32 bits), for a tokenizer that drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        comma = self.whole.encode(",", add_special_tokens=False).ids
        self.comma = comma[0] if len(comma) == 1 else -1

    def encoded(self, texts: list[str]) -> pa.Array:
        ids = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return pa.array([x.tobytes() for x in ids], pa.binary())

    def heads(self, words: pa.Array) -> pa.Array:
        """Ids of words of Latin letters in lower case: ``PART`` of them at a time as one text, parted at commas."""
        return pa.concat_arrays([pa.array([], pa.binary()), *[self._joined(words.slice(lo, PART)) for lo in range(0, len(words), PART)]])

    def _joined(self, words: pa.Array) -> pa.Array:
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " , ")[0].as_py()
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = ids == self.comma
        if at.sum() != len(words) - 1:
            return self.encoded(words.to_pylist())
        ends = np.r_[0, np.flatnonzero(at) - np.arange(at.sum()), len(ids) - at.sum()]
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids[~at].tobytes())])

    def ids(self, words: pa.Array) -> pa.Array:
        """The ids of each of ``words``: Latin letters without the marks behind them, the marks, and other words as they are."""
        bare = pc.utf8_rtrim(words, MARKS)
        simple = pc.match_substring_regex(bare, f"^{LETTERS}+$")
        head = pc.utf8_lower(bare.filter(simple)).dictionary_encode()
        tail = pc.replace_substring_regex(words.filter(simple), f"^{LETTERS}+", "").dictionary_encode()
        parts = self.heads(head.dictionary).take(head.indices), self.encoded(tail.dictionary.to_pylist()).take(tail.indices)
        known = pc.binary_join_element_wise(*parts, b"")
        order = np.empty(len(words), np.int64)
        mask = simple.to_numpy(zero_copy_only=False)
        order[np.flatnonzero(mask)], order[np.flatnonzero(~mask)] = np.arange(mask.sum()), mask.sum() + np.arange((~mask).sum())
        return pa.concat_arrays([known, self.encoded(words.filter(pc.invert(simple)).to_pylist())]).take(pa.array(order))


@cache
def _words(path: str) -> Words:
    return Words(path)


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and text[end] not in " \n":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def token_bytes(texts: list[str], path: str) -> Iterator[tuple[int, bytes]]:
    """(number of the text, ids as bytes), a long text in several."""
    known = _words(path)
    group: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        for part in _parts(text):
            group.append((k, part))
            size += len(part)
            if size >= GROUP:
                yield from _looked_up(known, group)
                group, size = [], 0
    yield from _looked_up(known, group)


def _looked_up(known: Words, group: list[tuple[int, str]]) -> Iterator[tuple[int, bytes]]:
    """Each text's ids: the different words of all texts are encoded once, and their ids laid out in the texts' order."""
    odd = [ODD(text) is not None for _, text in group]
    apart = iter(known.encoded([text for (_, text), o in zip(group, odd) if o]).to_pylist())
    split = pc.utf8_split_whitespace(pa.array(["" if o else text for (_, text), o in zip(group, odd)], pa.string()))
    words = split.flatten().dictionary_encode()
    ids = known.ids(words.dictionary).take(words.indices)
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    data = memoryview(ids.buffers()[2] or b"") if len(ids) else memoryview(b"")
    edges = ends[split.offsets.to_numpy()].tolist() if group else []
    for (owner, _), o, a, b in zip(group, odd, edges, edges[1:]):
        yield owner, next(apart) if o else bytes(data[a:b])


def tokenised(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, n, part, at, before, full, rest_crc, rest): tokens with the end id; the row's task and number in it; full windows of
    that task before this row; checksums of its full windows; checksum and ids of the rest."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()
    step = 4 * size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at = before = 0
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                piece = b.slice(lo, ROWS)
                texts = ["" if t is None else t for t in piece.column(1).to_pylist()]
                n, full, rests = [0] * len(texts), [[] for _ in texts], [b""] * len(texts)

                def add(k: int, ids: bytes) -> None:
                    n[k] += len(ids) // 4
                    data = rests[k] + ids
                    whole = len(data) // step * step
                    full[k] += [zlib.crc32(data[i : i + step]) for i in range(0, whole, step)]
                    rests[k] = data[whole:]

                for k, ids in token_bytes(texts, path):
                    add(k, ids)
                for k in range(len(texts)):
                    add(k, last)
                counts = np.array([len(f) for f in full], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(n, pa.int64()),
                        pa.array([part] * len(n), pa.int32()),
                        pa.array((np.int64(part) << 33) + at + np.arange(len(n))),
                        pa.array(before + np.cumsum(counts) - counts),
                        pa.array(full, pa.list_(pa.int64())),
                        pa.array([zlib.crc32(r) for r in rests], pa.int64()),
                        pa.array(rests, pa.binary()),
                    ],
                    names=["doc_id", "n", "part", "at", "before", "full", "rest_crc", "rest"],
                )
                at += len(n)
                before += int(counts.sum())

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(lambda b: lean(cut(b)), f"doc_id {kind}, n long, part int, at long, before long, full array<long>, rest_crc long, rest binary")


# -- the schedule


class Openings:
    """Runs of windows (first, count) by remaining capacity; a segment tree over the capacities finds the tightest that is open."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, capacity: int) -> None:
        k = self.leaves + capacity
        self.open[k] = bool(self.runs[capacity])
        while k := k // 2:
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def push(self, capacity: int, first: int, count: int) -> None:
        self.runs[capacity].append((first, count))
        self._mark(capacity)

    def pop(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that has a window."""
        k = self.leaves + need
        if self.open[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:  # the next subtree to the right
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def best_fit(counts: dict[int, int], size: int) -> tuple[list[tuple], list[tuple], int]:
    """Runs of rests (length, first place among its length, count, first window, rests a window, offset); the
    windows at the end as (capacity left, first, count); the number of windows."""
    tree, runs, windows = Openings(size), [], 0
    for length in sorted(counts, reverse=True):
        place, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = size
                first, count = windows, -(-left // (size // length))
                windows += count
            else:
                first, count = tree.pop(room)
            each = room // length  # a window that took one is the tightest for the next, as long as it has room
            shares = [(each, min(count, left // each))]
            if shares[0][1] < count and left % each:
                shares.append((left % each, 1))
            for share, m in shares:
                if m:
                    runs.append((length, place, m * share, first, share, size - room))
                    tree.push(room - share * length, first, m)
                    place, left, first, count = place + m * share, left - m * share, first + m, count - m
            if count:
                tree.push(room, first, count)
    return runs, [(c, first, count) for c, rs in enumerate(tree.runs) for first, count in rs], windows


@dataclass
class Schedule:
    """The schedule as sorted arrays; ``place`` looks rests up in it."""

    runs: np.ndarray  # length, place, count, window, each, offset
    donors: np.ndarray  # first window, count, filling, place in the stream of what is dissolved
    gaps: np.ndarray  # place in the stream, gap, first sequence, offset
    sequences: int

    def kept(self, window: np.ndarray) -> np.ndarray:
        """The sequence ids of windows that stay: those dissolved before them are left out."""
        gone = np.r_[0, np.cumsum(self.donors[:, 1])]
        return window - gone[np.searchsorted(self.donors[:, 0], window, "right")]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(number of the rest, start in it, length, sequence, offset, whether it is cut) of each piece of the rests."""
        key = self.runs[:, 0] << 48 | self.runs[:, 1]
        run = self.runs[np.searchsorted(key, length << 48 | rank, "right") - 1]
        nth = rank - run[:, 1]
        window, offset = run[:, 3] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * length
        d = np.searchsorted(self.donors[:, 0], window, "right") - 1
        gone = np.zeros(len(length), bool)
        if len(self.donors):
            gone = (d >= 0) & (window < self.donors[d, 0] + self.donors[d, 1])
        stay, go = np.flatnonzero(~gone), np.flatnonzero(gone)
        zero = np.zeros(len(stay), np.int64)
        out = [(stay, zero, length[stay], self.kept(window[stay]), offset[stay], zero)]
        if len(go):
            donor = self.donors[d[go]]
            lo = donor[:, 3] + (window[go] - donor[:, 0]) * donor[:, 2] + offset[go]
            hi = lo + length[go]
            base = self.gaps[:, 0]

            def ordinal(at: np.ndarray, first: np.ndarray) -> np.ndarray:  # number of the gap that a place of the stream is in
                g = np.searchsorted(base, at, "right") - 1
                return first[g] + (at - base[g]) // self.gaps[g, 1]

            sizes = np.diff(np.r_[base, base[-1] + self.gaps[-1, 1]])
            first = np.r_[0, np.cumsum(-(-sizes // self.gaps[:, 1]))][:-1]
            a, b = ordinal(lo, first), ordinal(hi - 1, first)
            times = b - a + 1
            who = np.repeat(np.arange(len(go)), times)
            gap = a[who] + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            g = np.searchsorted(first, gap, "right") - 1
            at = base[g] + (gap - first[g]) * self.gaps[g, 1]
            begin, end = np.maximum(at, lo[who]), np.minimum(at + self.gaps[g, 1], hi[who])
            cut = (times[who] > 1).astype(np.int64)
            out.append((go[who], begin - lo[who], end - begin, self.gaps[g, 2] + gap - first[g], self.gaps[g, 3] + begin - at, cut))
        return tuple(np.concatenate(x) for x in zip(*out))

    def cut_runs(self) -> list[tuple[int, int, int]]:
        """(length, first place, end) of the rests in windows that are dissolved."""
        out = []
        length, place, count, window, each = self.runs[:, :5].T
        for first, n, _, _ in self.donors.tolist():
            lo, hi = np.maximum(first, window), np.minimum(first + n, window - (-count // each))
            for k in np.flatnonzero(lo < hi).tolist():
                out.append((int(length[k]), int(place[k] + (lo[k] - window[k]) * each[k]), int(min(place[k] + count[k], place[k] + (hi[k] - window[k]) * each[k]))))
        return out


def scheduled(counts: dict[int, int], size: int = SIZE, crumb: int = CRUMB) -> Schedule:
    """The whole schedule from the number of rests of each length."""
    runs, ends, windows = best_fit(counts, size)
    open_ = sorted(((c, first, n) for c, first, n in ends if c >= crumb), reverse=True)
    total = sum(c * n for c, _, n in open_)
    gone = -(-total // size)
    donors, gaps, at = [], [], 0
    for c, first, n in open_:  # the emptiest first
        m = min(n, gone)
        if m:
            donors.append((first, m, size - c, at))
            at += m * (size - c)
            gone -= m
        if n > m:
            gaps.append((c, first + m, n - m, size - c))
    base = np.array(sorted(donors), np.int64).reshape(-1, 4)
    schedule = Schedule(np.array(sorted(runs), np.int64).reshape(-1, 6), base, np.zeros((0, 4), np.int64), 0)
    rows, place, last = [], 0, windows - int(base[:, 1].sum())
    for c, first, n, offset in gaps:
        rows.append((place, c, int(schedule.kept(np.array([first]))[0]), offset))
        place += c * n
    spare = at - place  # what finds no gap
    for room in [spare] if spare > size - size // 8 else [1 << b for b in reversed(range(size.bit_length())) if spare >> b & 1]:
        rows.append((place, room, last, 0))
        place, last = place + room, last + 1
    schedule.gaps, schedule.sequences = np.array(rows, np.int64).reshape(-1, 4), last
    return schedule


# -- the whole


def packed_pieces(docs: DataFrame, path: str, size: int = SIZE, crumb: int = CRUMB, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = written(tokenised(docs, path, size, end))
    rest = F.col("n") % size
    counts = {r["length"]: r["n"] for r in rows.groupBy(rest.alias("length")).agg(F.count(F.lit(1)).alias("n")).collect() if r["length"]}
    plan = scheduled(counts, size, crumb)

    # full windows: gapless numbers from the running counts of the tasks
    parts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum(F.size("full")).alias("n")).collect())
    first = np.r_[0, np.cumsum([n for _, n in parts])].astype(int).tolist()
    bases = F.broadcast(small(spark, [(p, plan.sequences + b) for (p, _), b in zip(parts, first)], "base_part int, base long"))
    full = rows.where(F.size("full") > 0).join(bases, F.col("part") == F.col("base_part")).select("doc_id", "n", (F.col("base") + F.col("before")).alias("base"), F.posexplode("full").alias("k", "crc"))
    full = full.select("doc_id", (F.col("k").cast("long") * size).alias("start"), F.lit(size).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not counts:
        return full

    ranked = numbered(rows.where(rest > 0).select("doc_id", "n", "at", "rest_crc"), [rest, F.col("at")], grouped=True)
    shared = spark.sparkContext.broadcast(plan)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: dict[str, Any] = {n: b.column(n) for n in b.schema.names}
            length, n, crc = c["length"].to_numpy(), c["n"].to_numpy(), c["rest_crc"].to_numpy()
            who, start, size_, sequence, offset, cut = shared.value.place(length, c["rank"].to_numpy())
            arrays = [c["doc_id"].take(pa.array(who)), pa.array((n - length)[who] + start), pa.array(size_), pa.array(np.where(cut > 0, 0, crc[who]), mask=cut > 0), pa.array(n[who]), pa.array(sequence), pa.array(offset), pa.array(c["at"].to_numpy()[who]), pa.array(start)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "at", "begin"])

    flat = ranked.select("row.doc_id", "row.n", F.col("k0").alias("length"), F.col("k1").alias("at"), "row.rest_crc", "rank")
    placed = written(flat.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, at long, begin long"))
    whole = placed.where(F.col("ids_crc32").isNotNull()).select(*names)
    out = full.union(whole)
    if len(plan.donors):
        # ids again for the rests that are cut: rows of a length in the order of ``at``, so ranges of ``at``
        ranges = _ranges(plan, ranked)
        some = rows.join(F.broadcast(small(spark, ranges, "r_length long, low long, high long")), (rest == F.col("r_length")) & F.col("at").between(F.col("low"), F.col("high"))).select(F.col("at").alias("rest_at"), "rest")
        cut = placed.where(F.col("ids_crc32").isNull()).join(some, F.col("at") == F.col("rest_at"))
        crc = F.crc32(F.substring("rest", F.col("begin").cast("int") * 4 + 1, F.col("length").cast("int") * 4))
        out = out.union(cut.select("doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"))
    return out


def _ranges(plan: Schedule, ranked: DataFrame) -> list[tuple[int, int, int]]:
    """(length, first row, last row) of the rests that are dissolved; joined runs of a length make one range."""
    runs: list[list[int]] = []
    for length, lo, hi in sorted(plan.cut_runs()):
        if runs and runs[-1][0] == length and runs[-1][2] == lo:
            runs[-1][2] = hi
        else:
            runs.append([length, lo, hi])
    spark = ranked.sparkSession
    table = F.broadcast(small(spark, [tuple(r) for r in runs], "r_length long, lo long, hi long"))
    found = ranked.join(table, (F.col("k0") == F.col("r_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return [tuple(r) for r in found.groupBy("r_length", "lo").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).select("r_length", "low", "high").collect()]


def op13_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lasting(lambda: packed_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
