"""Truncation of records to a budget of tokens, counted by a black box over the whole rendered prompt.

What a tokenizer makes of a prompt is not the sum of its parts, so the largest number of notes that fits is found by bisection over rendered
prompts.  All records of a batch take their steps together: each round is one call of the counter for those that are
still open (a call has :data:`AT_ONCE` characters, or one prompt), so a tokenizer that works on many texts at once can.

A record may come whole (:func:`fit`) or in parts (:func:`fit_parts`).  In parts, only notes that a prompt within the budget can
have room for are gathered (:func:`gathered`), by lower bounds of its tokens that add up over notes, so no row grows with a subject's history.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlow.functions.prompts import PROMPTS

Counter = Callable[[list[str]], list[int]]
#: A size of :data:`SIZES`, and the most of it that a prompt within the budget can have.
Bound = tuple[str, int]

#: Characters that a counter gets in one call, unless a single prompt has more.
AT_ONCE = 1 << 20

#: How a record's parts begin.
NOTE, CODES = re.compile(r"(?m)^(?=\[Note \d+\] )"), re.compile(r"\n\nCodes \(N=\d+\)\n")


@dataclass
class Record:
    """A record in its parts: the line before the notes, the notes from the oldest on (null without a text), what follows them;
    ``total``, where the notes are only those from the end that is kept, says how many there are."""

    head: str
    notes: list[str | None]
    tail: str
    total: int | None = None

    def __post_init__(self) -> None:
        self.total = len(self.notes) if self.total is None else self.total

    def first(self, newest: bool) -> int:
        """The place of the first note with a text, from the end that is kept; beyond all notes without one."""
        return next((i for i, x in enumerate(reversed(self.notes) if newest else self.notes, 1) if x is not None), self.total + 1)

    def size(self) -> int:
        return len(self.head) + len(self.tail) + sum(len(x) + 1 for x in self.notes if x is not None)

    @classmethod
    def of(cls, text: str) -> Record:
        ends = [m.start() for m in CODES.finditer(text)]
        body, tail = (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")
        parts = NOTE.split(body)
        notes = [p[:-1] if p.endswith("\n") and i < len(parts) - 2 else p for i, p in enumerate(parts[1:])]
        return cls(parts[0], notes, tail)

    def text(self, kept: int, newest: bool) -> str:
        """The record with ``kept`` notes from one end, and a line that says how many were left out."""
        left = self.total - kept
        body = "\n".join(x for x in (self.notes[len(self.notes) - kept :] if newest else self.notes[:kept]) if x is not None)
        if left:
            body = f"[{left} older notes left out]\n{body}" if newest else f"{body}\n[{left} newer notes left out]"
        return self.head + body + self.tail


def rendered(prompt: str, text: str, extra: str = "") -> str:
    """A prompt over ``text`` as one string."""
    p = PROMPTS[prompt]
    return f"<system>\n{p['system']}" + (f"\n\n{extra}" if extra else "") + f"\n<user>\n{p['user']}{text}\n<assistant>\n{p.get('prefill', '')}"


#: Fixed value: a word of a prompt, in Python and in Spark.
WORD = r"[^\t\n\f\r ]+"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


#: Sizes of a text that add up over the texts of a prompt; of a text that begins with a line, that line has no more than the whole.
SIZES: dict[str, Callable[[Column], Column]] = {"words": words, "bytes": F.octet_length}


def approximate(prompts: list[str]) -> list[int]:
    """Tokens by the rule of thumb: thirteen for ten words."""
    return [sum(1 for _ in re.finditer(WORD, p)) * 13 // 10 for p in prompts]


def approximate_bounds(budget: int) -> list[Bound]:
    """The most words that make ``budget`` tokens by the rule of thumb."""
    return [("words", (10 * budget + 9) // 13)]


def byte_pairs(path: str) -> Counter:
    """Tokens by the tokenizer in a file; it is loaded once a process."""
    loaded: list = []

    def count(prompts: list[str]) -> list[int]:
        from tokenizers import Tokenizer

        if not loaded:
            loaded.append(Tokenizer.from_file(path))
            loaded[0].encode_special_tokens = True
        return [len(e.ids) for e in loaded[0].encode_batch(prompts, add_special_tokens=False)]

    return count


def byte_pair_bounds(path: str, budget: int) -> list[Bound]:
    """Of a byte-level tokenizer without normalizer: no token is longer than the longest of its vocabulary (which writes each
    byte as one character) and, where it cuts texts by its pattern, none reaches from one word into the next."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    before = j["pre_tokenizer"] or {}
    if j["normalizer"] or j["model"].get("unk_token") or before.get("type") != "ByteLevel" or not all(x["special"] for x in j["added_tokens"]):
        raise ValueError("not a plain byte-level tokenizer")
    longest: list[Bound] = [("bytes", budget * max(map(len, j["model"]["vocab"])))]
    return longest + [("words", budget)] * bool(before.get("use_regex", True))


def _together(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of at most ``most`` items and :data:`AT_ONCE` characters, or one item."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo == most or total + n > AT_ONCE):
            yield slice(lo, i)
            lo, total = i, 0
        total += n
    if sizes:
        yield slice(lo, len(sizes))


def _counted(prompts: list[str], count: Counter) -> list[int]:
    return [n for part in _together([len(p) for p in prompts], len(prompts)) for n in count(prompts[part])]


def fitted(records: list[Record], budget: int, count: Counter, newest: bool, render: Callable[[str], str]) -> list[tuple[str, int, int]]:
    """(prompt, tokens, notes kept) of each record: whole where it fits or has one note at most, else the most notes that fit, at least one.
    Notes without a text are not kept for themselves: where only such would fit, one is."""
    sizes, first = [r.total for r in records], [r.first(newest) for r in records]
    out: list[tuple[str, int, int] | None] = [None] * len(records)
    whole = [i for i, r in enumerate(records) if len(r.notes) == r.total]
    best = [render(records[i].text(sizes[i], newest)) for i in whole]
    for i, p, t in zip(whole, best, _counted(best, count)):
        if sizes[i] <= 1 or t <= budget and first[i] <= sizes[i]:
            out[i] = (p, t, sizes[i])
    low, high = first, [min(len(r.notes), r.total - 1) for r in records]
    open_ = [i for i, x in enumerate(out) if x is None and low[i] <= high[i]]
    while open_:
        middle = {i: (low[i] + high[i]) // 2 for i in open_}
        prompts = [render(records[i].text(middle[i], newest)) for i in open_]
        for i, p, t in zip(open_, prompts, _counted(prompts, count)):
            if t <= budget:
                out[i], low[i] = (p, t, middle[i]), middle[i] + 1
            else:
                if middle[i] == 1:  # not even one fits; it stays
                    out[i] = (p, t, 1)
                high[i] = middle[i] - 1
        open_ = [i for i in open_ if low[i] <= high[i]]
    rest = [i for i, x in enumerate(out) if x is None]
    prompts = [render(records[i].text(1, newest)) for i in rest]
    for i, p, t in zip(rest, prompts, _counted(prompts, count)):
        out[i] = (p, t, 1)
    return out


_RESULT = "prompt string, tokens long, truncated boolean, kept int, total int"


def _fit(subjects: pd.Series, parts: list[Record], budget: int, count: Counter, newest: bool, render: Callable[[str], str], at_once: int) -> Iterator[pd.DataFrame]:
    for part in _together([r.size() for r in parts], at_once):
        some = parts[part]
        got = fitted(some, budget, count, newest, render)
        total = [r.total for r in some]
        yield pd.DataFrame({"subject_id": subjects.iloc[part].to_numpy(), "prompt": [g[0] for g in got], "tokens": [g[1] for g in got], "truncated": [g[2] < n for g, n in zip(got, total)], "kept": [g[2] for g in got], "total": total})


def fit(records: DataFrame, budget: int, count: Counter = approximate, newest: bool = True, prompt: str = "full_context", extra: str = "", at_once: int = 64) -> DataFrame:
    """(subject_id, prompt, tokens, truncated, kept, total) of records (subject_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _together([len(t or "") for t in b["text"]], at_once):
                some = b.iloc[part]
                yield from _fit(some["subject_id"], [Record.of(t or "") for t in some["text"]], budget, count, newest, lambda t: rendered(prompt, t, extra), at_once)

    kind = records.schema["subject_id"].dataType.simpleString()
    return records.select("subject_id", "text").mapInPandas(run, f"subject_id {kind}, {_RESULT}")


def in_reach(notes: DataFrame, bounds: list[Bound], newest: bool = True) -> DataFrame:
    """Of notes (subject_id, charttime, note_id and, by its name, the size of each bound), with their ``place`` from the end that is kept and the subject's
    ``total`` where they don't have it, the first ones as far as no sum of sizes is above its bound's most; the first in any case."""
    ends = [F.col(c).desc() if newest else F.col(c).asc() for c in ("charttime", "note_id")]
    w = Window.partitionBy("subject_id").orderBy(*ends)
    sums = [(F.sum(F.coalesce(F.col(size), F.lit(0)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) <= most).alias(f"fits_{size}") for size, most in bounds]
    total = [] if "total" in notes.columns else [F.count(F.lit(1)).over(Window.partitionBy("subject_id")).alias("total")]
    n = notes.select("*", F.row_number().over(w).alias("place"), *sums, *total)
    for size, _ in bounds:
        n = n.where((F.col("place") == 1) | F.col(f"fits_{size}"))
    return n.drop(*[f"fits_{size}" for size, _ in bounds])


def gathered(notes: DataFrame, bounds: list[Bound], newest: bool = True) -> DataFrame:
    """(subject_id, total, notes) of notes (subject_id, charttime, note_id, line): how many a subject has, and those :func:`in_reach`, numbered and from the oldest on.
    Notes with a ``total`` are the first of so many from the end that is kept, all of those in reach among them."""
    n = in_reach(notes.select("*", *[SIZES[size](F.col("line")).alias(size) for size, _ in bounds]), bounds, newest)
    i = F.col("total") - F.col("place") + 1 if newest else F.col("place")
    line = F.concat(F.lit("[Note "), i.cast("string"), F.lit("] "), F.col("line"))
    g = n.groupBy("subject_id").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct(i.cast("long").alias("i"), line.alias("line")))).alias("x"))
    return g.select("subject_id", "total", F.transform("x", lambda x: x["line"]).alias("notes"))


def fit_parts(parts: DataFrame, budget: int, count: Counter = approximate, newest: bool = True, prompt: str = "full_context", extra: str = "", at_once: int = 64) -> DataFrame:
    """The same of parts (subject_id, head, notes, total, tail), the notes by :func:`gathered` with bounds of ``count`` and ``budget``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            records = [Record(h, list(n), t, int(k)) for h, n, t, k in zip(b["head"], b["notes"], b["tail"], b["total"])]
            yield from _fit(b["subject_id"], records, budget, count, newest, lambda t: rendered(prompt, t, extra), at_once)

    kind = parts.schema["subject_id"].dataType.simpleString()
    return parts.select("subject_id", "head", "notes", "total", "tail").mapInPandas(run, f"subject_id {kind}, {_RESULT}")
