"""Resampling, vector compression and packing: brute force, edge cases, hot lengths and ties."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlow.llm import compression, packing, resampling
from tests.llm.test_edges import CLASH, LONG

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n ", "one", "Été İSTANBUL K naïve 中文字 x y z", "the cat and the dog " * 8, "the cat and the dog " * 8, LONG, "w" * 3_000_000, "a\x00b\x1cc \x1f d", "It's we'll <|endoftext|> end... (so) ab.", "Don't; é ́x 12345 ½ !?."]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("z").alias(c) for c in CLASH if c not in ("id",)], F.lit(1).alias("score"), F.lit(1).alias("n"))


# -- op11


def features(text):
    return [zlib.crc32(w.encode()) % 10_000 for w in WORD.findall((text or "").translate(str.maketrans(UP, LOW)))]


def resampled(docs, target, least=20, percent=10):
    have, want = Counter(), Counter()
    for _, t in docs:
        have.update(features(t))
    for t in target:
        want.update(features(t))
    s, t = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[k] + 1) * (s + 10_000) / ((have[k] + 1) * (t + 10_000)))) for k in range(10_000)]
    out = []
    for i, text in docs:
        f = features(text)
        w = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    can = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(can[: percent * len(can) // 100]):
        x[4] = k + 1
    return sorted(out, key=str)


def got_of(df):
    return sorted(([r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")] for r in df.collect()), key=str)


def test_resampling_edges(spark):
    rows = list(enumerate(TEXTS)) + [(5, TEXTS[5])] * 30 + [(None, TEXTS[5]), (None, "some words " * 15)]
    target = ["the cat of istanbul", None, "12345"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for percent in (10, 50, 97):
        assert got_of(resampling.resampled(docs_of(spark, rows), bench, percent=percent)) == resampled(rows, target, percent=percent)
    empty = docs_of(spark, [])
    assert resampling.resampled(empty, bench).count() == 0
    assert got_of(resampling.resampled(docs_of(spark, rows), bench.limit(0))) == resampled(rows, [])


def test_resampling_of_other_ids(spark):
    rows = [(f"id{k % 90:03d}" if k else None, "a b c d e f g " * (3 + k % 5)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    bench = spark.createDataFrame([(1, "a a a")], "item_id long, text string")
    got = resampling.resampled(df, bench, percent=40).collect()
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 49)) and len(got) == 120
    keys = [(-r["score"], r["doc_id"] is None, r["doc_id"] or "") for r in drawn]
    assert keys == sorted(keys) and max(r["score"] for r in got if not r["rank"]) <= drawn[-1]["score"]


def test_selection_finds_the_kth_key(spark):
    rng = np.random.default_rng(3)
    n = 3000
    score = rng.integers(-9000, 9000, n) * (rng.random(n) > 0.4)  # two fifths are equal
    ids = np.where(rng.random(n) < 0.3, -(2**63), rng.integers(-(2**63), 2**63 - 1, n))
    df = spark.createDataFrame(pd.DataFrame({"score": score, "id": ids, "n_features": rng.integers(20, 50, n), "at": np.arange(n)})).cache()
    order = sorted(range(n), key=lambda k: (-score[k], ids[k], df_n[k], k)) if (df_n := [r["n_features"] for r in df.orderBy("at").collect()]) else []
    for k in (1, 7, 500, 1501, 2999, 3000):
        got = {r["at"] for r in df.where(resampling.selected(df, resampling._components(df), k)).collect()}
        assert got == set(order[:k])


# -- op12


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max(len(v) for _, _, v in kept) // parts)
    x = np.zeros((len(kept), parts * width), np.int64)
    for k, (_, _, v) in enumerate(kept):
        x[k, : len(v)] = np.floor(np.array(v, np.float64) * 1024)
    books = [x[:entries, p * width : (p + 1) * width].copy() for p in range(parts)]

    def assigned(p):
        return ((x[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(-1).argmin(1)

    for _ in range(rounds):
        for p in range(parts):
            a = assigned(p)
            for e in set(a.tolist()):
                members = x[a == e, p * width : (p + 1) * width]
                books[p][e] = members.sum(0) // len(members)
    chosen = [assigned(p) for p in range(parts)]
    error = sum(((x[:, p * width : (p + 1) * width] - books[p][chosen[p]]) ** 2).sum(1) for p in range(parts))
    labels = Counter()
    for (_, lab, _), e in zip(kept, error.tolist()):
        labels[lab] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted(((i, "".join(f"{c[k]:02x}" for c in chosen), int(error[k]), labels[lab], sha) for k, (i, lab, _) in enumerate(kept)), key=str)


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").select("*", *[F.lit("z").alias(c) for c in CLASH if c != "label"])


def codes(df, **how):
    return sorted((tuple(r) for r in compression.compressed(df, **how).collect()), key=str)


def test_compression_edges(spark):
    rng = np.random.default_rng(4)
    f = [[float(np.float32(v)) for v in row] for row in rng.normal(0, 0.3, (300, 8))]
    rows = [(k, k % 3, v) for k, v in enumerate(f)] + [(5, None, f[7])] * 40 + [(None, None, f[1])]  # repeated ids and vectors
    bad = [(900, 1, None), (901, 1, [1.0, None] + [0.0] * 6), (902, 1, [float("nan")] * 8), (903, 1, [float("-inf")] + [0.0] * 7)]
    assert codes(vectors_of(spark, rows + bad)) == plain_codes(rows)
    assert codes(vectors_of(spark, rows), entries=7, rounds=9) == plain_codes(rows, entries=7, rounds=9)
    ragged = [(k, k % 2, [float(k % 7)] * (k % 6)) for k in range(60)]
    assert codes(vectors_of(spark, ragged)) == plain_codes(ragged)
    assert codes(vectors_of(spark, rows[:1])) == plain_codes(rows[:1])
    assert codes(vectors_of(spark, bad)) == codes(vectors_of(spark, [])) == []
    same = [(k, k, [0.25] * 8) for k in range(300)]
    assert codes(vectors_of(spark, same)) == plain_codes(same)
    huge = [(k, 0, [1e30 * (-1) ** k] * 8) for k in range(20)]
    assert len(codes(vectors_of(spark, huge, "double"))) == 20


def test_compression_through_whole_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(k, k % 5, v) for k, v in enumerate(rng.integers(-60_000, 60_000, (80, 8)).astype(float).tolist())]  # past what floats hold
    assert codes(vectors_of(spark, rows, "double"), entries=16) == plain_codes(rows, entries=16)


def test_compression_rescans_few_parts_of_grouped_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 4, (16, 8))
    rows = [(k, 0, v) for k, v in enumerate((centres[rng.integers(0, 16, 4000)] + rng.normal(0, 0.02, (4000, 8))).tolist())]
    scans: list = []
    compression.compressed(vectors_of(spark, rows, "double"), entries=12, rounds=6, scans=scans)
    assert scans[0] == 16_000 and scans[-1] < 0.35 * scans[0]


# -- op13


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def check_pieces(rows, pieces, tokenizer, size=2048):
    ids = Counter()
    by_length: dict = {}
    for i, t in rows:
        x = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        ids[i, len(x)] += 1
        by_length[i, len(x)] = x
    filling: dict = {}
    for r in pieces:
        x = by_length[r["doc_id"], r["doc_tokens"]]
        assert zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["length"] > 0
        filling.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, n in ids.items():
        cover = np.zeros(key[1], int)
        for r in pieces:
            if (r["doc_id"], r["doc_tokens"]) == key:
                cover[r["start"] : r["start"] + r["length"]] += 1
        assert (cover == n).all()
    assert sorted(filling) == list(range(len(filling)))
    padding = 0
    for parts in filling.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_edges(spark, tokenizer):
    rows = list(enumerate(TEXTS)) + [(5, TEXTS[5])] * 3 + [(None, "nobody's words"), (None, None)]
    got = packing.packed_pieces(docs_of(spark, rows), VOCABULARY).collect()
    assert check_pieces(rows, got, tokenizer) <= 2048 // 8
    assert packing.packed_pieces(docs_of(spark, []), VOCABULARY).count() == 0
    one = [(1, "one")]
    assert [r["length"] for r in packing.packed_pieces(docs_of(spark, one), VOCABULARY).collect()] == [2]


def test_packing_of_one_hot_length(spark, tokenizer):
    rows = [(k, "cat " * 700) for k in range(90)] + [(100 + k, "dog " * (40 * k)) for k in range(30)]
    got = packing.packed_pieces(docs_of(spark, rows).repartition(7), VOCABULARY).collect()
    total = sum(r["length"] for r in got)
    assert check_pieces(rows, got, tokenizer) < 0.01 * total
    whole = sum(1 for r in got if r["length"] == 701 and r["doc_tokens"] == 701)
    assert whole >= 55  # two in a window stay whole; the others fill the gaps


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 40), st.dictionaries(st.integers(1, 39), st.integers(1, 30), max_size=12))
def test_schedule_is_that_of_single_rests(size, counts):
    counts = {k: n for k, n in counts.items() if k < size}
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min(((r, k) for k, r in enumerate(rooms) if r >= length), default=None)
            if fit:
                rooms[fit[1]] -= length
            else:
                rooms.append(size - length)
    _, ends, windows = packing.best_fit(counts, size)
    assert windows == len(rooms) and sorted(c for c, _, n in ends for _ in range(n)) == sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,;:!?'sStT<|>aZÀÖœŒıȺǅ-_\"%&)`^+~@{*#é́  　\x1c\x85İß中½  "), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_give_the_ids_of_the_whole_text(text):
    whole = Tokenizer.from_file(VOCABULARY) if not hasattr(test_words_give_the_ids_of_the_whole_text, "t") else test_words_give_the_ids_of_the_whole_text.t
    test_words_give_the_ids_of_the_whole_text.t = whole
    got = b"".join(b for _, b in packing.token_bytes([text], VOCABULARY))
    assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_words_in_groups_and_slices(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "SLICE", 100)
    monkeypatch.setattr(packing, "GROUP", 300)
    texts = [" ".join(f"Word{'abcdefgh'[k % 8] * (k % 5)}{k}, and so" for k in range(j, j + 40)) for j in range(20)] + ["", "x\x1cy " * 90, "“Curly” — Œuvre’s  İx" * 9]
    got: dict = {}
    for k, ids in packing.token_bytes(texts, VOCABULARY):
        got[k] = got.get(k, b"") + ids
    assert all(np.frombuffer(got[k], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts))
