"""Language id: interpolated Kneser-Ney character models in sorted hash arrays.

Texts become letters in lower case with one blank between words.  For every language,
counts of four-character sequences over all training rows give an interpolated
Kneser-Ney model (lower orders from continuation counts).  The models of the languages
share one table for each order: sorted hashes of the sequences, a matrix of log
probabilities (by back-off where a language lacks the sequence), and back-off weights.
The language with the lowest length-normalised cross-entropy is chosen.  Rejection is
calibrated on labelled rows that gave no counts: a prediction is ``rejected`` where its
cross-entropy is above what ``ACCEPT`` of the calibration rows of that language have.

Size: every sequence that was counted is in the model, however many there are; the counts stay in a table of
the shared folder.  What a process holds is a block: up to ``LANGUAGES`` languages, and of the sequences
of four and three characters those whose middle two fall into a range of hashes, chosen so that there are
``CELLS`` numbers at most (but one of 4096 parts of the hashes is never cut).  All that a sequence needs for its
back-off down to two characters has the same middle, so a block scores its sequences by itself; pairs and single
characters are in each block.  A language's sums over the blocks are added up, and as no number depends on how
the blocks are cut, neither does a prediction.  The documents are read once for each block: one block is
enough for some millions of sequences.

Values: a null text or one without a letter is ``und`` with score 0, not rejected;
ties go to the language that sorts first; repeated rows get equal predictions; rows
with a null lang are never trained on but predicted; an empty table gives an empty
result, and no training rows make every prediction ``und``; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlow.llm.shared import lasting, lean, written

ORDER = 4
#: Most numbers of the highest order in a block, over its languages.
CELLS = 8_000_000
#: Most languages of a block.
LANGUAGES = 32
#: Parts of the sequences, by a hash of their middle two characters.
PARTS = 4096
#: Sequences that a task holds before it sends its counts on.
HELD = 4_000_000
#: Share of calibration rows that are accepted.
ACCEPT = 0.995
#: Letters that count towards the confidence of a score.
CONFIDENT = 40
#: Characters handled at once.
PIECE = 1 << 20

_U = np.uint64
BLANK = 32
_letters: tuple[np.ndarray, np.ndarray] | None = None


def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or mark as 16 bits, else a blank; whether it is a letter.
    Letters beyond 16 bits share the 6400 codes of the private use area, in which there are no letters."""
    global _letters
    if _letters is None:
        t, is_letter = np.full(0x110000, BLANK, np.uint16), np.zeros(0x110000, bool)
        for cp in range(0x110000):
            c = chr(cp)
            kind = unicodedata.category(c)[0]
            if kind in "LM":
                low = ord(c.lower()[0])
                t[cp] = low if low < 0x10000 else 0xE000 + low % 6400
                is_letter[cp] = kind == "L"
        _letters = t, is_letter
    return _letters


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed four-character sequences, owner of each, has a letter by text).

    Each sequence is a predicted character below the three before it; texts start
    after three blanks, and a word ends with one where anything follows it.
    """
    raw = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    n = np.array([len(r) for r in raw], np.int64)
    has = np.zeros(len(raw), bool)
    if not n.sum():
        return np.empty(0, _U), np.empty(0, np.int64), has
    code = np.concatenate(raw)
    table, is_letter = letters()
    low = table[code]
    owner = np.repeat(np.arange(len(raw)), n)
    word = low != BLANK
    has = np.bincount(owner[is_letter[code]], minlength=len(raw)) > 0
    first = np.r_[True, owner[1:] != owner[:-1]]
    keep = word | (~first & np.r_[False, word[:-1]])  # a blank after a letter of the same text
    low, owner = low[keep], owner[keep]
    if not len(low):
        return np.empty(0, _U), np.empty(0, np.int64), has
    first = np.r_[True, owner[1:] != owner[:-1]]
    start = np.flatnonzero(first)
    place = np.arange(len(low)) - np.repeat(start, np.diff(np.r_[start, len(low)]))
    out = low.astype(_U)
    for back in range(1, ORDER):
        before = np.full(len(low), BLANK, np.uint16)
        before[back:] = low[:-back]
        before[place < back] = BLANK
        out |= before.astype(_U) << _U(16 * back)
    return out, owner, has


def stretches(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(packed sequences, owner of each, has a letter by text) of all ``texts``, at most some PIECE characters at once: short texts
    together, and a longer one in slices that go on where the one before ended."""
    for lo, hi in _pieces(texts):
        for k in (k for k in range(lo, hi) if len(texts[k] or "") > PIECE):
            yield from _sliced(texts[k], k, len(texts))
        short = [t if len(t or "") <= PIECE else None for t in texts[lo:hi]]
        seqs, owner, own = sequences(short)
        has = np.zeros(len(texts), bool)
        has[lo:hi] = own
        yield seqs, owner + lo, has


def _sliced(text: str, k: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    table, is_letter = letters()
    before, in_word = np.full(ORDER - 1, BLANK, np.uint16), False
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        low = table[code]
        word = low != BLANK
        kept = low[word | np.r_[in_word, word[:-1]]]
        in_word = bool(word[-1])
        line = np.r_[before, kept]
        before = line[len(line) - ORDER + 1 :]
        out = np.zeros(len(kept), _U)
        for back in range(ORDER):
            out |= line[ORDER - 1 - back : len(line) - back].astype(_U) << _U(16 * back)
        has = np.zeros(n, bool)
        has[k] = is_letter[code].any()
        yield out, np.full(len(out), k), has


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Table:
    """Sorted hashes with rows of values; found through the hashes' high bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = _hash(keys)
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order].astype(np.float32)
        self.bits = max(1, int(len(h)).bit_length())
        self.start = np.searchsorted(self.hashes >> _U(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        h = _hash(keys)
        b = (h >> _U(64 - self.bits)).astype(np.int64)
        at, end = self.start[b], self.start[b + 1]
        out = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            p = at[open_]
            hit = self.hashes[p] == h[open_]
            out[open_[hit]] = p[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def part_of(seqs: np.ndarray) -> np.ndarray:
    """The part of each packed sequence, from its middle two characters."""
    return (_hash((seqs >> _U(16)) & _U(0xFFFFFFFF)) >> _U(52)).astype(np.int64)


class Model:
    """A block of the interpolated Kneser-Ney models of several languages."""

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray]], discounts: list[list[float]], symbols: int, parts: tuple[int, int] = (0, PARTS)):
        """By language: the packed sequences of this block and their counts, all pairs and how many characters
        stand before each, and the discounts of orders 1 to ORDER; ``symbols``: distinct characters of all languages."""
        self.langs, self.parts = langs, parts
        by: list[list] = [[] for _ in range(ORDER + 1)]
        for (keys, n), (two, n_two) in zip(grams, pairs):
            by[4].append((keys.astype(_U), n.astype(np.float64)))
            three, inv = np.unique(by[4][-1][0] & _U((1 << 48) - 1), return_inverse=True)
            by[3].append((three, np.bincount(inv, minlength=len(three)).astype(np.float64)))  # one for each character before
            by[2].append((two.astype(_U), n_two.astype(np.float64)))
            one, inv = np.unique(by[2][-1][0] & _U(0xFFFF), return_inverse=True)
            by[1].append((one, np.bincount(inv, minlength=len(one)).astype(np.float64)))
        self.base = -np.log(symbols + 1.0)
        self.tables: list = [None] * (ORDER + 1)
        self.bows: list = [None] * (ORDER + 1)
        for order in range(1, ORDER + 1):
            union = np.unique(np.concatenate([keys for keys, _ in by[order]]))
            ctx = np.unique(union >> _U(16))
            if order > 1:
                low = self._logs(union & _U((1 << 16 * (order - 1)) - 1), order - 1).astype(np.float64)
            else:
                low = np.full((len(union), len(langs)), self.base)
            bow, logp = np.zeros((len(ctx), len(langs))), low.copy()
            in_ctx = np.searchsorted(ctx, union >> _U(16))
            for k, (keys, n) in enumerate(by[order]):
                d = discounts[k][order - 1]
                own, inv = np.unique(keys >> _U(16), return_inverse=True)
                total, kinds = np.bincount(inv, n), np.bincount(inv)
                lam = d * kinds / total
                bow[np.searchsorted(ctx, own), k] = np.log(lam)
                logp[:, k] += bow[in_ctx, k]
                at = np.searchsorted(union, keys)
                logp[at, k] = np.log(np.maximum(n - d, 0) / total[inv] + lam[inv] * np.exp(low[at, k]))
            self.tables[order], self.bows[order] = Table(union, logp), Table(ctx, bow)

    def _logs(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of packed sequences of ``order`` characters, by language."""
        row = self.tables[order].find(keys)
        out = self.tables[order].values[np.maximum(row, 0)]
        lost = np.flatnonzero(row < 0)
        if len(lost):
            if order == 1:
                out[lost] = self.bows[1].values[0] + self.base
            else:
                low = self._logs(keys[lost] & _U((1 << 16 * (order - 1)) - 1), order - 1)
                ctx = self.bows[order].find(keys[lost] >> _U(16))
                out[lost] = low + np.where((ctx >= 0)[:, None], self.bows[order].values[np.maximum(ctx, 0)], 0)
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of log probabilities of this block's sequences by text and language, characters of
        the whole text, has a letter)."""
        total, n, has = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        step = max(1, PIECE // max(1, len(self.langs) // 8))
        for seqs, owner, own_has in stretches(texts):
            n += np.bincount(owner, minlength=len(texts))
            has |= own_has
            if self.parts != (0, PARTS):
                part = part_of(seqs)
                mine = (part >= self.parts[0]) & (part < self.parts[1])
                seqs, owner = seqs[mine], owner[mine]
            for at in range(0, len(seqs), step):
                own = owner[at : at + step]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[first]] += np.add.reduceat(self._logs(seqs[at : at + step], ORDER), first, axis=0, dtype=np.float64)
        return total, n, has


def verdicts(langs: list[str], total: np.ndarray, n: np.ndarray, has: np.ndarray) -> dict[str, list]:
    """Prediction, cross-entropy in nats a character, characters and score of each row of ``total``."""
    h = -total / np.maximum(n, 1)[:, None]
    pick = h.argmin(1)
    e = h[np.arange(len(h)), pick]
    odds = np.exp((e[:, None] - h) * np.minimum(n, CONFIDENT)[:, None]).sum(1)
    return {"lang_pred": [langs[p] if ok else "und" for p, ok in zip(pick, has)], "entropy": np.where(has, e, 0.0).tolist(), "n_letters": n.tolist(), "score": np.where(has, 1.0 / odds, 0.0).tolist()}


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE or k == len(texts) - 1:
            yield lo, k + 1
            lo, size = k + 1, 0


def counted(docs: DataFrame) -> DataFrame:
    """(lang, part, gram, n): counts of packed sequences in ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([p[0] for p in parts])
            uniq, inv = np.unique(keys, return_inverse=True)
            return uniq, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(uniq)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(part_of(keys).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "part", "gram", "n"])

        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lang in set(langs):
                mine = [t for t, x in zip(texts, langs) if x == lang]
                for seqs, _, _ in stretches(mine):
                    keys, n = np.unique(seqs, return_counts=True)
                    held.setdefault(lang, []).append((keys, n))
                    if len(held[lang]) >= 32:
                        held[lang] = [merge(held[lang])]
            if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                yield from out()
                held = {}
        yield from out()

    parts = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(lambda b: lean(run(b)), "lang string, part int, gram long, n long")
    return parts.groupBy("lang", "part", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Trained:
    """The counts of all training rows (tables in the shared folder) and the blocks they are cut into."""

    grams: DataFrame
    pairs: DataFrame
    discounts: dict[str, list[float]]
    symbols: int
    blocks: list[tuple[list[str], int, int]]

    def block(self, k: int) -> Model:
        """Block ``k``, gathered at the driver."""
        langs, lo, hi = self.blocks[k]
        number = (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int").alias("k")

        def by_lang(rows: DataFrame, key: str) -> list[tuple[np.ndarray, np.ndarray]]:
            got = rows.where(F.col("lang").isin(langs)).select(number, key, "n").toArrow()
            k, keys, n = (got.column(c).to_numpy() for c in ("k", key, "n"))
            return [(keys[k == i].view(_U), n[k == i]) for i in range(len(langs))]

        grams = by_lang(self.grams.where((F.col("part") >= lo) & (F.col("part") < hi)), "gram")
        return Model(langs, grams, by_lang(self.pairs, "pair"), [self.discounts[x] for x in langs], self.symbols, (lo, hi))


def trained(docs: DataFrame, cells: int = CELLS, languages: int = LANGUAGES) -> Trained | None:
    """The counts of all rows of ``docs`` with a text and a lang; None if there are none.  The driver
    sees a few numbers for each language and part."""
    grams = written(counted(docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())))
    orders = {4: grams.select("lang", F.col("gram").alias("key"), "n")}
    for order in (3, 2, 1):  # how many characters stand before each shorter sequence
        shorter = F.col("key").bitwiseAND(F.lit((1 << 16 * order) - 1))
        orders[order] = orders[order + 1].groupBy("lang", shorter.alias("key")).agg(F.count(F.lit(1)).alias("n"))
        if order == 2:
            orders[2] = written(orders[2])
    discounts: dict[str, list[float]] = {}
    for order, rows in orders.items():
        for r in rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect():
            d = r["one"] / (r["one"] + 2.0 * r["two"]) if r["one"] and r["two"] else 0.5
            discounts.setdefault(r["lang"], [0.0] * ORDER)[order - 1] = min(max(d, 0.1), 0.9)
    if not discounts:
        return None
    sizes: dict[str, dict[int, int]] = {}
    for r in grams.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes.setdefault(r["lang"], {})[r["part"]] = r["n"]
    blocks = []
    langs = sorted(discounts)
    for at in range(0, len(langs), languages):
        some, lo, held = langs[at : at + languages], 0, 0
        for part in range(PARTS):
            size = len(some) * sum(sizes[x].get(part, 0) for x in some)
            if held and held + size > cells:
                blocks.append((some, lo, part))
                lo, held = part, 0
            held += size
        blocks.append((some, lo, PARTS))
    return Trained(grams, orders[2].withColumnRenamed("key", "pair"), discounts, orders[1].select("key").distinct().count(), blocks)


def scored(docs: DataFrame, model: Trained | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, lang_pred, entropy, n_letters and score."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    kept = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    says = "lang_pred string, entropy double, n_letters long, score double"
    types = {"lang_pred": pa.string(), "entropy": pa.float64(), "n_letters": pa.int64(), "score": pa.float64()}
    if model is None:
        none = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("entropy"), F.lit(0).cast("long").alias("n_letters"), F.lit(0.0).alias("score")]
        return docs.select(*keep, *none)
    text = F.col("text").cast("string")
    if len(model.blocks) == 1:
        sent = spark.sparkContext.broadcast(model.block(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for b in batches:
                texts = b.column("text").to_pylist()
                got: dict[str, list] = {c: [] for c in types}
                for lo, hi in _pieces(texts):
                    for c, values in verdicts(m.langs, *m.sums(texts[lo:hi])).items():
                        got[c] += values
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(v, types[c]) for c, v in got.items()]], [*keep, *got])

        return docs.select(*keep, text.alias("text")).mapInArrow(lambda b: lean(run(b)), f"{kept}, {says}")

    # Several blocks: one pass over the texts for each, and sums by row number; the numbered rows are written first, so that a row keeps its number.
    docs = written(docs.select(*keep, text.alias("text")).withColumn("_row", F.monotonically_increasing_id()))
    langs = sorted({x for some, _, _ in model.blocks for x in some})
    place = {x: i for i, x in enumerate(langs)}
    passes = []
    for k, (some, _, _) in enumerate(model.blocks):
        sent = spark.sparkContext.broadcast(model.block(k))

        def partial(batches: Iterator[pa.RecordBatch], k=k, sent=sent) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for b in batches:
                texts = b.column("text").to_pylist()
                for lo, hi in _pieces(texts):
                    total, n, has = m.sums(texts[lo:hi])
                    cols = [b.column("_row").slice(lo, hi - lo), pa.array([k] * (hi - lo), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(has)]
                    yield pa.RecordBatch.from_arrays(cols, ["_row", "k", "total", "n", "has"])

        passes.append(written(docs.select("_row", "text").mapInArrow(lambda b, f=partial: lean(f(b)), "_row long, k int, total array<double>, n long, has boolean")))
        sent.destroy()
    parts = passes[0]
    for p in passes[1:]:
        parts = parts.union(p)
    one = parts.groupBy("_row").agg(F.collect_list(F.struct("k", "total")).alias("parts"), F.first("n").alias("n"), F.first("has").alias("has"))
    where = [np.array([place[x] for x in some]) for some, _, _ in model.blocks]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.zeros((b.num_rows, len(langs)))
            for i, row in enumerate(b.column("parts").to_pylist()):
                for p in sorted(row, key=lambda p: p["k"]):
                    total[i, where[p["k"]]] += p["total"]
            got = verdicts(langs, total, b.column("n").to_numpy(), b.column("has").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("_row"), *[pa.array(v, types[c]) for c, v in got.items()]], ["_row", *got])

    said = one.mapInArrow(lambda b: lean(summed(b)), f"_row long, {says}")
    return docs.select(*keep, "_row").join(said, "_row").select(*keep, *types)


def calibrated(rows: DataFrame, labelled: Column, accept: float = ACCEPT, width: float = 0.02) -> DataFrame:
    """``rows`` of :func:`scored` with ``rejected``, from the entropies of ``labelled``
    rows that were predicted right, in a histogram by language."""
    bins = rows.where(labelled).groupBy("lang_pred", F.floor(F.col("entropy") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    by: dict[str, list] = {}
    for r in bins:
        by.setdefault(r["lang_pred"], []).append((r["bin"], r["n"]))
    limit = F.lit(None).cast("double")
    for lang, got in by.items():
        total, seen = sum(n for _, n in got), 0
        for b, n in sorted(got):
            seen += n
            if seen >= accept * total:
                limit = F.when(F.col("lang_pred") == lang, F.lit((b + 1) * width)).otherwise(limit)
                break
    return rows.withColumn("rejected", (F.col("lang_pred") != "und") & F.coalesce(F.col("entropy") > limit, F.lit(False)))


def identified(docs: DataFrame, fold: Column, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, fold, lang_pred, score, entropy, rejected) of every row of ``docs`` (doc_id, text, lang): learned from folds 0 and
    1, calibrated on fold 3."""
    docs = docs.select("doc_id", "text", "lang", fold.alias("fold"))

    def build() -> DataFrame:
        model = trained(docs.where("fold IN (0, 1)"))
        rows = written(scored(docs, model, ("doc_id", "lang", "fold")))
        return calibrated(rows, (F.col("fold") == 3) & (F.col("lang") == F.col("lang_pred")), accept)

    return lasting(build).select("doc_id", "fold", "lang_pred", "score", "entropy", "rejected")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identified(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)))
    return out.select("doc_id", F.coalesce(F.col("fold") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
