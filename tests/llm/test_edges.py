"""Nulls, empty and long texts, repeats, empty tables and clashing names, for every operator."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlow.llm import chat, decontamination, language, licences, mixing, neardup, quality, sharding, substrings, urls

LONG = " ".join(f"word{i % 5000} of the" for i in range(40_000))
CLASH = ["row", "rank", "k0", "shard", "slot", "fp", "m", "w", "text_hash", "block", "epoch", "unit", "spans", "base", "part", "at", "label", "_id", "body", "id", "g"]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return df.select("*", *[F.lit("z").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n ", "one", "one two", "the cat and the dog " * 5, "the cat and the dog " * 5, "é ü ñ", LONG, "a\x00b \udfff".replace("\udfff", "?"), "Licensed under CC BY-NC 4.0."]
    rows = [(i, t, "s" if i % 2 else None, "en") for i, t in enumerate(texts)]
    return docs_of(spark, rows + [rows[5], rows[5], (None, "one", None, None)])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_quality(docs, none):
    got = quality.judged(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_words"] == by[1]["n_words"] == by[2]["n_words"] == 0 and by[0]["base_failed"] and not by[0]["kept"]
    assert by[8]["n_words"] == 120_000
    kept = quality.passing(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert quality.judged(none).count() == 0 and quality.passing(none).count() == 0


def test_quality_of_other_scripts(spark):
    russian = "это простой русский текст о погоде и о том как мы жили у моря много лет назад " * 3
    chinese = "\n".join("这是一个关于天气和海边生活的普通文本编号" + str(k) for k in range(50))
    polish = " ".join(f"dom{k} nie jest z miasta{k} i wsi{k}" for k in range(20))
    nonsense = " ".join(f"blub{k} florp{k}" for k in range(40))
    rows = [(k, " ".join(f"{w}{j}" for j, w in enumerate(t.split())) if k == 0 else t) for k, t in enumerate((russian, chinese, polish, nonsense))]
    got = {r["doc_id"]: r["broken"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["stop_words"]}


def test_quality_is_exact_in_very_long_texts(spark):
    rng = np.random.default_rng(5)
    w = rng.integers(0, 1 << 40, 4_000_000).tolist()
    w[3_900_000:3_900_005] = w[100:105]  # one true repeat among windows whose shortened hashes meet
    text = " ".join(map(str, w))
    r = quality.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_repeat_words"]) == (4_000_000, 10)


def test_neardup(docs, none):
    got = neardup.clustered(docs)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == docs.count()
    assert {rows[i]["component_id"] for i in (0, 1, 2)} == {0} and rows[0]["fp"] == 0
    assert rows[6]["component_id"] == 5 and rows[None]["component_id"] == 3
    one = neardup.one_of_each(docs)
    assert one.columns == docs.columns
    ids = [r["doc_id"] for r in one.collect()]
    assert len(ids) == len(set(ids)) and 6 not in ids and {0, 3, 5, 8} <= set(ids)
    assert neardup.clustered(none).count() == 0 and neardup.one_of_each(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "cat and the dog the cat and"), (4, "cat and the dog the cat and")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()} == {(4, 3), (5, 4), (6, 4)}
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and {4, 5, 6}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert kept.count() == docs.count() - 5
    assert decontamination.leaks(none, items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0


def test_rows_without_an_id_or_with_one_id_keep_their_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    leak = "cat and the dog the cat and " + c.replace("c", "e")
    rows = [(None, a), (None, a), (None, b), (1, b), (None, c), (None, "d " + c), (2, a + " " + c), (2, b + " " + c), (2, b + " " + c), (3, c + " " + a), (3, leak)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in neardup.one_of_each(df).collect())
    one = [r for r in got if r[1] in (c, "d " + c)]
    assert len(one) == 1 and one[0][0] == "None"
    assert [r for r in got if r not in one] == sorted([("None", a), ("1", b), ("2", a + " " + c), ("2", b + " " + c), ("3", leak)])  # c a is like a c
    items = spark.createDataFrame([(1, "a1 a2 a3 a4 a5 a6 a7"), (2, "cat and the dog the cat and")], "item_id long, text string")
    left = Counter((r["doc_id"], r["text"]) for r in decontamination.clean(df, items).collect())
    assert left == {(None, b): 1, (1, b): 1, (None, c): 1, (None, "d " + c): 1, (2, b + " " + c): 2}


def test_sharding(docs, none):
    got = sharding.sharded(docs, 4, 8)
    assert got.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    n = sorted(r["count"] for r in got.groupBy("shard").count().collect())
    assert sum(n) == docs.count() and n[-1] - n[0] <= 1
    assert sharding.sharded(none).count() == 0


def test_mixing(docs, none, monkeypatch):
    got = mixing.mixed(docs, block=2)
    assert got.where("epoch = 0").count() == docs.count()
    assert mixing.arranged(docs).columns == docs.columns
    assert mixing.mixed(none).count() == 0 and mixing.arranged(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(docs, {"s": 1.0})
    monkeypatch.setattr(mixing, "SOURCES", 1)
    with pytest.raises(ValueError):
        mixing.mixed(docs)


def test_substrings(spark, docs, none):
    got = substrings.duplicate_spans(docs, 60).collect()
    assert {r["doc_id"] for r in got} == {6}
    cut = substrings.without_duplicates(docs, 60)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert text[8] == LONG and text[0] is None and len(text[6]) < 20
    assert substrings.duplicate_spans(none).count() == 0 and substrings.without_duplicates(none).count() == 0


def test_substrings_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(3)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))

    p, other = prose(80), prose(300)
    rows = [(None, prose(90) + " " + p), (None, other), (None, p + " " + prose(70)), (4, prose(50) + " " + p), (4, prose(200)), (4, prose(200)), (9, prose(60) + " " + p), (9, prose(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text_ids = df.select(F.lpad(F.col("doc_id").cast("string"), 5, "0").alias("doc_id"), "text")
    for table in (df, text_ids):
        cut = Counter(r["text"] for r in substrings.without_duplicates(table).collect())
        whole = [t for _, t in rows if p not in t] + [rows[3][1]]  # the smallest doc_id keeps the passage
        assert len(rows) == sum(cut.values()) and all(cut[t] == 1 for t in whole)
        assert sum(len(t) for t in cut) < sum(len(t) for _, t in rows) - 3 * (len(p) - 130)


def test_licences(docs, none):
    got = {r["doc_id"]: r for r in licences.scanned(docs).collect()}
    assert got[0]["n_words"] == 0 and got[0]["first_word"] is None and got[0]["labels"] == "" and got[0]["score"] == 0
    assert got[10]["labels"] == "cc-by,cc-by-nc-4.0" and got[10]["first_word"] == 2
    assert licences.scanned(docs).count() == docs.count() and licences.scanned(none).count() == 0


def test_language(docs, none):
    model = language.trained(docs)
    got = {r["doc_id"]: r for r in language.scored(docs, model).collect()}
    assert {got[i]["lang_pred"] for i in (0, 1, 2)} == {"und"} and got[0]["score"] == 0 and got[5]["lang_pred"] == "en"
    assert language.trained(none) is None and language.scored(none, model).count() == 0
    assert {r["lang_pred"] for r in language.scored(docs, None).collect()} == {"und"}
    assert language.sequences(["\u0301", "a\u0301", "12"])[2].tolist() == [False, True, False]
    assert language.letters()[0][0x10400] == language.letters()[0][0x10428] != language.letters()[0][0x10429] and language.letters()[0][0x20000] != 0xFFFF


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, 1, None, "x"), (2, None, "assistant", "<|im_end|>\\<|"), (2, 3, "a\nb", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(9)).withColumn("spans", F.lit(1))
    got = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    assert got[1]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert chat.read_back(got[2]["formatted"]) == [("assistant", "<|im_end|>\\<|"), ("a\nb", "")]
    assert chat.formatted(df.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://WWW.Example.COM/en/x?y"), (3, "http://WWW.Example.COM/en/x?y"), (4, "http://a.net/es/#z"), (5, "http://a.com"), (6, "x://h" + "a" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("z")).withColumn("shape", F.lit("z"))
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judged(df).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[4] == ("a.net", "/es/", "net/es/", "block") and got[5][:3] == ("a.com", "", None)
    assert urls.threshold(spark.createDataFrame([(False, -2.0), (True, -1.0)], "bad boolean, score double")) < 0  # empty hosts are allowed even so
    alike = spark.createDataFrame([(1, "http://a1.org/x"), (2, "http://a2.org/x"), (3, "http://a2.org/x"), (4, "http://a2.org/7"), (5, "http://a2.org/8")], "page_id long, url string")
    assert sorted(r["page_id"] for r in urls.judged(alike).collect()) == [1, 2, 3, 4, 5]
    assert urls.judged(df).count() == 7 and urls.judged(df.limit(0)).count() == 0
