"""Scalars, parsers, kernels and interfaces on literal cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlow.functions import gated, networks, parsing, text, vectors
from marlow.operators import external, metrics, relational
from marlow.sources import config, io


def chunk(spark, s, length=4, overlap=1):
    return spark.createDataFrame([(s,)], "t string").select(text.chunks(F.col("t"), length, overlap)).first()[0]


def test_chunks(spark):
    assert chunk(spark, "a  b\nc d") == ["a  b\nc d"]
    assert chunk(spark, "a b c d e") == ["a b c d", "d e"]
    assert chunk(spark, "a b c d e f g h") == ["a b c d", "d e f g", "g h"]
    assert chunk(spark, "") == [""]
    with pytest.raises(ValueError):
        text.chunks(F.col("t"), 3, 3)


def test_tokens_and_prefix(spark):
    df = spark.createDataFrame([("a " * 10,), ("",), (" \n",)], "t string")
    assert [r[0] for r in df.select(text.approx_tokens(F.col("t"))).collect()] == [13, 0, 0]
    back = df.select(text.without_age_prefix(text.age_prefix(F.lit(41), F.lit("x y")))).first()[0]
    assert back == "x y"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [float("nan"), float("inf")])], "a array<double>, b array<double>")
    assert df.select(vectors.l2_normalize(F.col("a"))).first()[0] == pytest.approx([0.6, 0.8])
    assert df.select(vectors.repaired(F.col("b"))).first()[0] == [0.0, 3.4028234663852886e38]


def test_completions(spark):
    cases = {
        '{"probability": 0.3, "report": "x"}': (0.3, "x", True),
        'so: {"probability": 0.4, "report": "a {b} \\" c"} done': (0.4, 'a {b} " c', True),
        'text "probability": .7 more': (0.7, 'text "probability": .7 more', False),
        '{"probability": 1.5, "report":"x"}': (None, '{"probability": 1.5, "report":"x"}', False),
        "none": (None, "none", False),
    }
    cases |= {
        '  {"probability": "0.25", "summary": "s"} ': (0.25, "s", True),
        '{"probability": 1}': (1.0, "", True),
        '{"PROBABILITY": 0.2, "x": {': (0.2, '{"PROBABILITY": 0.2, "x": {', False),
        'a {"x": 1} then {"probability": 2} and {"probability": 0.5, "summary": "t"}': (0.5, "t", True),
        "{'probability': 0.3}": (None, "{'probability': 0.3}", False),
        'was "probability": 1.0.': (1.0, 'was "probability": 1.0.', False),
        '"probability": 0': (0.0, '"probability": 0', False),
    }
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "c string")
    got = {r["c"]: (r["probability"], r["report"], r["ok"]) for r in parsing.completions(df, "c").collect()}
    assert got == {**cases, None: (None, None, False)}


def test_answers(spark):
    cases = {
        'Yes\n{"report": "r {1}"}': "r {1}",
        'No\nnot {"x": 1} but {"summary": "s"}': "s",
        "Yes\n  the rest\nof it ": "the rest\nof it",
        "Yes": "",
        'Yes\n{"report": broken': '{"report": broken',
    }
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "c string")
    assert {r["c"]: r["report"] for r in parsing.answers(df, "c").collect()} == {**cases, None: ""}


def test_asserted(spark):
    df = spark.createDataFrame([('"a b" (note_id: 7) and “c” (ICD code: I10.9)',)], "e string")
    assert df.select(parsing.asserted(F.col("e"))).first()[0].split() == ["a", "b", "and", "c"]


def test_evidence(spark):
    df = spark.createDataFrame([('Supporting evidence: "abc def" (ICD code: I10.9-10)',), ('"abc" and "abcdef"',), ('"ab" and "abcd"',), ("none",)], "e string")
    kind, handle = parsing.citation(F.col("e"))
    got = [tuple(r) for r in df.select(parsing.longest_quote(parsing.evidence_line(F.col("e"))), kind, handle).collect()]
    assert got == [("abc def", "icd", "I109-10"), ("abcdef", None, None), ("and", None, None), (None, None, None)]


def parsed(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("i").select(*columns).collect()]


def test_factors_of_all_headings(spark):
    t = F.col("t")
    body = "1. Factor summary: a\n   Reasoning: the first Recommendations inside a line\n\n 2. **Factor summary**: b\n"
    two = ["1. Factor summary: a\n   Reasoning: the first Recommendations inside a line", "2. **Factor summary**: b"]
    heads = ["[Predictive Factors + Evidence-Based Reasoning]", "**Predictive Factors**", "Predictive Factors:", "  predictive   factors"]
    ends = ["[Reasoning Lens]", "**Recommendations**", " Reasoning Lens:", ""]
    texts = [f"Prediction\nx\n{h}\n{body}{e}\n3. Factor: none\n" for h, e in zip(heads, ends)]
    got = parsed(spark, texts, F.transform(parsing.factors(t), lambda x: parsing.stripped(x)))
    assert got[:3] == [two] * 3 and got[3] == [*two, "3. Factor: none"]
    assert parsed(spark, ["no heading\n1. Factor summary: a", "Predictive Factors", "see Predictive Factors\n1. x"], parsing.factors(t)) == [[], [], []]
    assert parsed(spark, ["12. Factor: a", " 3. x", "x"], parsing.factor_number(t)) == [12, 3, None]


def test_evidence_of_all_forms(spark):
    t = F.col("t")
    kind, handle = parsing.citation(t)
    cases = {
        '"abc def" (note_id: 12345-DS-3)': ("abc def", "note", "12345-DS-3"),
        "“curly ‘one’” ( NOTE_ID : 7;)": ("curly ‘one", "note", "7"),
        '"a b c" (note_id: 5), "x y z and w" (ICD code: I10.9-10)': ("x y z and w", "note", "5"),
        '"a b c" (ICDcode:I10.9.) then (note_id: 5)': ("a b c", "icd", "I109"),
        "said (Note ID: 5) and note_id: 6": (None, None, None),
        '"ab" ""': (None, None, None),
        '"   " (note_id: 1)': (None, "note", "1"),
    }
    assert parsed(spark, cases, parsing.longest_quote(t), kind, handle) == list(cases.values())
    lines = {
        "1. Factor: a\n  Supporting  Evidence :  x\n  Age: 3; Date: d\n  Reasoning - why\n  y": "x\n  Age: 3; Date: d",
        "Supporting evidence: x\nAttribution: y\nConsideration: z": "x\nAttribution: y",
        "Supporting evidence: x\n2. Factor summary: y": "x",
        "Supporting evidence: x\n2. other\n[Reasoning Lens]": "x\n2. other",
        " 1. Factor: a\n  no label \n": "1. Factor: a\n  no label",
    }
    assert parsed(spark, lines, parsing.evidence_line(t)) == list(lines.values())


def test_cleaning_takes_nothing_else(spark):
    cases = {
        "#### Head\n##### five\n a # b": "Head\n# five\n a # b",
        "low **bold word** here": "low **bold word** here",
        "  - Supporting evidence: x\n  - other: y\n• Provenance : z": "  Supporting evidence: x\n  - other: y\nProvenance : z",
        " **2. Title of it** rest": " 2. Title of it rest",
        "3. ** Factor summary **: x\n4. **Reasoning**  : y\n5. **bold** z": "3. Factor summary: x\n4. Reasoning: y\n5. **bold** z",
        "**Cited source** : a **Attribution score**: b": "Cited source: a Attribution score: b",
        "Predictive Factors\nFactor summary: a\n**2. Factor summary: b**\nFactor summary: c": "Predictive Factors\n1. Factor summary: a\n2. Factor summary: b\nFactor summary: c",
        None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r["t"] for r in parsing.clean(df, "t").orderBy("i").collect()] == list(cases.values())


def test_valid_reports_have_lines_that_head_all_sections(spark):
    good = "[Prediction + Explanation]\n**Predictive Factors**\nReasoning Lens\n  recommendation:\n" + "x" * 500
    inside = good.replace("Reasoning Lens", "the Reasoning Lens")
    assert parsed(spark, [good, good[:500], inside, good.replace("[Pred", "[Pre-d"), None], parsing.valid(F.col("t"))) == [True, False, False, False, None]


def test_section_spans_and_order(spark):
    a, b, c, d = parsing.SECTIONS
    t = F.col("t")
    got = parsed(spark, [f"x{a}{b}yy{c}{d}z", f"{a}{c}{b}{d}", f"{a}{b}{c}"], parsing.section_spans(t))
    assert [tuple(s) for s in got[0]] == [(a, 1, 1 + len(a)), (b, 1 + len(a), 3 + len(a + b)), (c, 3 + len(a + b), 3 + len(a + b + c)), (d, 3 + len(a + b + c), 4 + len(a + b + c + d))]
    assert got[1:] == [None, None]
    moved = f"{c}{d}{a}{b}"  # after a step back the next one is held against that
    assert parsed(spark, [moved], parsing.listed(parsing.section_issues(t, moved="o:", back=True)))[0] == [f"o:{c}"]
    assert parsed(spark, [moved], parsing.listed(parsing.section_issues(t, moved="o:")))[0] == [f"o:{c}", f"o:{d}"]


def test_partial_ratio():
    assert parsing.partial_ratio("abc", "xxabcxx") == 100.0
    assert parsing.partial_ratio("", "x") == 0.0
    assert parsing.partial_ratio("abcd", "abxd") == pytest.approx(75.0)
    assert parsing.spans_ratio("abc … xyz", "xyz then abc") == 100.0
    assert parsing.spans_ratio("a .. b", "a .. b") == 100.0 and parsing.spans_ratio("", "x") == 0.0
    assert parsing.plain("Ａge  X…") == "age x" and parsing.plain("Patient age: 53 years... Clinical Note: The  ﬁrst..") == "the first"
    assert parsing.plain("the age 53 years.") == "the age 53 years."


def test_partial_ratio_is_the_best_window_at_any_length():
    rng = np.random.default_rng(3)

    def slow(a, b):
        if len(a) > len(b):
            a, b = b, a
        m = len(a)
        pairs = [(a, b[i : i + m]) for i in range(len(b) - m + 1)] + [(a, b[:k]) for k in range(1, m)] + [(a, b[-k:]) for k in range(1, m)]
        if len(a) == len(b):
            pairs += [(b, a[:k]) for k in range(1, m)] + [(b, a[-k:]) for k in range(1, m)]

        def lcs(x, y):
            row = [0] * (len(y) + 1)
            for c in x:
                before = 0
                for j, d in enumerate(y, 1):
                    before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
            return row[-1]

        return max(200 * lcs(x, y) / (len(x) + len(y)) for x, y in pairs)

    for m in (3, 20, 64, 65, 90):
        for _ in range(4):
            b = "".join(rng.choice(list("abc de"), 130))
            a = "".join(rng.choice(list("abc de"), int(m * 0.3))) + b[: m - int(m * 0.3)]
            assert parsing.partial_ratio(a, b) == pytest.approx(slow(a, b))
    assert parsing.partial_ratio("abcde", "bcdex") == pytest.approx(slow("abcde", "bcdex"))
    for m in (64, 65):  # cut alike: a quote whose first ten characters are missing from the source
        q = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), m))
        assert parsing.partial_ratio(q, q[10:] + " " + "0123456789" * 20) > 90


def test_partial_ratio_tries_few_windows_in_full(monkeypatch):
    rng = np.random.default_rng(8)
    tried, bits = [], parsing._bits
    monkeypatch.setattr(parsing, "_bits", lambda m, masks, at: tried.append(len(at)) or bits(m, masks, at))
    letters = list("etaoin shrdlu")
    b = "".join(rng.choice(letters, 6000))
    a = b[3000:3020] + "".join(rng.choice(letters, 20))  # half of it is there
    got = parsing.partial_ratio(a, b)
    assert sum(tried) < 6000 / 3 and len(tried) == 2

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            before = 0
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    assert got == pytest.approx(max(100 * lcs(a, b[i : i + 40]) / 40 for i in range(2900, 3100)))
    x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (a, b[:400]))
    assert parsing._combed(x, y).tolist() == [lcs(a, b[i : i + 40]) for i in range(361)]
    long = "".join(rng.choice(letters, 700))  # in time with the product of the lengths, not with its square
    assert parsing.partial_ratio(long[:300] + "#" + long[300:], "".join(rng.choice(letters, 9000)) + long) > 99


def test_fuzzy_quotes_reads_the_reports_once(spark):
    from marlow.plans import catalog
    from tests.test_parity import SF

    df = catalog.QUERIES["fuzzy_quotes"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("ArrowEvalPython") == 1
    rows = df.collect()
    assert {r["score"] == 100.0 for r in rows} == {True, False} and all(r["at_85"] == (r["score"] >= 85) for r in rows)


def test_joins_of_factors_carry_no_whole_texts(spark):
    from marlow.plans import roles
    from tests.test_parity import SF

    d, f = roles.role(spark, SF, "documents"), roles.role(spark, SF, "factor_rows")
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(text") == 4 and plan.split("Join LeftOuter")[1].count(", 1, 50)") == 2
    quotes = d.selectExpr("doc_id AS id", "substring(text, 11, 40) AS own").join(f, F.col("id") == F.col("doc_id")).where("(doc_id + k) % 3 <> 0")
    assert quotes.where("own <=> raw_quote").count() == quotes.count() > 0


def test_unwrap_and_renumber():
    assert parsing.unwrap('```json\n{"report": "r1"}\n```') == "r1"
    assert parsing.unwrap('{"report": "a\nb \\"c\\" \\\\d", "x": 1}') == 'a\nb "c" \\d'
    assert parsing.unwrap('{\n[Reasoning Lens]\nbecause\n}') == "[Reasoning Lens]\nbecause" and parsing.unwrap('{"report": "Recommendations: rest}') == "Recommendations: rest"
    assert parsing.unwrap("{ nothing }") is None and parsing.unwrap(" ") is None and parsing.unwrap({"report": "x"}) == "x" and parsing.unwrap({"report": 3}) is None
    assert parsing.unwrap("plain") == "plain" and parsing.unwrap(None) is None
    r = "Predictive Factors\nFactor summary: a\n3. Factor summary: b\n\n  Factor summary: c\n4. **Title**\n\nFactor summary: d\nReasoning Lens\nFactor summary: e"
    assert parsing.renumber(r) == "Predictive Factors\n1. Factor summary: a\n3. Factor summary: b\n\n  Factor summary: c\n4. **Title**\n\nFactor summary: d\nReasoning Lens\nFactor summary: e"
    assert parsing.renumber("[Predictive Factors + x]\nHeart\n  Factor summary: a\nLungs\nFactor summary: b\n[Reasoning Lens]") == "[Predictive Factors + x]\nHeart\n1. Factor summary: a\nLungs\n2. Factor summary: b\n[Reasoning Lens]"


def a_model(r, concat=False):
    m = gated.Gated.fixed(r.normal(size=(5, 12)), 3, hidden=7, concat=concat)
    for k in m.weights:
        m.weights[k] = m.weights[k] + r.normal(0, 0.1, m.weights[k].shape)
    real = np.ones((5, 3), bool)
    real[1, 2] = real[4] = False
    return m, gated.Subject(r.normal(size=(5, 3, 12)) * real[..., None], real, r.normal(size=(2, 12)))


@pytest.mark.parametrize("concat", [False, True])
def test_gradients_by_differences(concat):
    r = np.random.default_rng(1)
    m, s = a_model(r, concat)
    s.gates = m.gates(s)[0]  # hard gates have no slope; see the next test
    grads, items = m.backward(s, m.forward(s)[1], 1.0)
    for name, x in [*m.weights.items(), ("items", s.items)]:
        g = items if name == "items" else grads[name]
        for _ in range(6):
            i = tuple(int(r.integers(0, n)) for n in x.shape)
            if name == "items" and not s.real[i[:2]]:
                continue
            old, ends = x[i], []
            for e in (1e-6, -1e-6):
                x[i] = old + e
                ends.append(m.forward(s)[0])
            x[i] = old
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(g[i], abs=2e-6), name


def test_gates_pass_their_gradient_straight_through():
    r = np.random.default_rng(2)
    m, s = a_model(r)
    logit, c = m.forward(s)
    grads, _ = m.backward(s, c, 1.0)

    def soft(w):  # the logit if gates were hard + (now - before) of sigmoid(cos) - sigmoid(theta)
        m.weights, old = w, m.weights
        p = m.gates(s)[1]
        m.weights = old
        now = gated.sigmoid(p["cos"][1:]) - gated.sigmoid(w["theta"])
        open_ = c["open"] + np.r_[0, now - before]
        mixed = (c["out"] * open_[:, None]).sum(0) / c["count"][0]
        n, _ = gated.norm(mixed)
        return float(((n * w["final_gain"][0] + w["final_shift"][0]) * w["head"][0]).sum() + w["bias"][0])

    p = c["gate"]
    before = gated.sigmoid(p["cos"][1:]) - gated.sigmoid(m.weights["theta"])
    assert soft(m.weights) == pytest.approx(logit)
    for name in ("theta", "summary_gain", "summary_shift"):
        for i in range(2):
            ends = []
            for e in (1e-6, -1e-6):
                w = {k: v.copy() for k, v in m.weights.items()}
                w[name][i] += e
                ends.append(soft(w))
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(grads[name][i], abs=1e-6), name


@pytest.mark.parametrize("concat", [False, True])
def test_integrated_gradients_are_complete(concat):
    m, s = a_model(np.random.default_rng(3), concat)
    open_ = m.gates(s)[0]
    mean = s.real[..., None] * s.items.reshape(-1, 12)[s.real.reshape(-1)].mean(0)
    for start, steps in ((np.zeros_like(s.items), 6000), (mean, 200)):
        a = m.attributed(s, start, steps)
        assert a.sum() == pytest.approx(m.probability(s) - m.probability(gated.Subject(start, s.real, s.summaries, open_)), abs=1e-3)
        assert (a[open_ == 0] == 0).all() and (a[~s.real] == 0).all()


def test_queries_loss_by_differences():
    m, _ = a_model(np.random.default_rng(4))
    _, g = m.diversity()
    q = m.weights["queries"]
    for i in ((0, 0), (1, 3), (4, 11)):
        old, ends = q[i], []
        for e in (1e-6, -1e-6):
            q[i] = old + e
            ends.append(m.diversity()[0])
        q[i] = old
        assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(g[i], abs=1e-5)


def test_gelu_is_exact():
    assert networks.gelu(np.array([1.0]))[0] == pytest.approx(0.8413447460685429) and networks.gelu(np.array([-3.0]))[0] == pytest.approx(-0.00404969409489031)


def test_auc(spark):
    df = spark.createDataFrame([("t", 1, 0.5), ("t", 0, 0.5), ("s", 1, 0.1), ("s", 1, 0.9), ("o", 0, 0.1), ("o", 1, 0.9)], "m string, label int, p double")
    assert {r["m"]: r["auc"] for r in metrics.auc(df, ["m"]).collect()} == {"t": 0.5, "s": None, "o": 1.0}


def test_batches_and_split(spark):
    def sizes(n):
        got = relational.contiguous_batches(spark.range(n).withColumnRenamed("id", "k"), "k", 4).groupBy("batch").count().collect()
        return [dict((r["batch"], r["count"]) for r in got).get(b, 0) for b in range(4)]

    assert sizes(10) == [3, 3, 3, 1] and sizes(9) == [3, 3, 3, 0]
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"))
    got = {(r["y"], r["split"]): r["count"] for r in relational.stratified_split(df, "k", "y").groupBy("y", "split").count().collect()}
    assert got == {(y, s): n for y in (0, 1) for s, n in (("train", 40), ("val", 5), ("test", 5))}


def test_keep_first(spark):
    df = spark.createDataFrame([(1, "A", 0), (1, "A", 1), (1, "B", 2)], "s int, c string, o int")
    assert sorted(r["o"] for r in relational.keep_first(df, ["s", "c"], "o").collect()) == [0, 2]
    assert sorted(r["o"] for r in relational.last_wins(df, ["s", "c"], "o").collect()) == [1, 2]


def test_judge_reads_only_cache_misses(spark, tmp_path):
    work = spark.createDataFrame([(1, "a"), (2, "bb")], "subject_id long, report string")
    cache = spark.createDataFrame([], "key string")
    first = external.judged(work, cache, external.stub_judge, "m")
    assert first.count() == 2
    io.write_jsonl(first, str(tmp_path / "cache"), append=True)
    again = io.read_jsonl(spark, str(tmp_path / "cache"), "key string, verdict string", tolerant=True)
    assert external.judged(work, again, external.stub_judge, "m").count() == 0
    keys = external.with_keys(spark.createDataFrame([(1, "r")], "subject_id long, report string"), "m").first()["key"]
    assert keys == "54f9df2d17903d70d5df3731dd2c012845e1ded4"
    p = spark.createDataFrame([("x",)], "prompt string")
    assert json.loads(external.generated(p, external.stub_generate).first()["completion"])["report"] == "r"


def test_sources(spark, tmp_path):
    (tmp_path / "n.csv").write_text('subject_id,note_id,note_type,charttime,age_at_note,text,DaysToLastNotes,label\n1,n1,t,2020-01-01 00:00:00,50,"a ""q""\nb",3,1\n')
    assert io.read_csv(spark, str(tmp_path / "n.csv"), io.NOTES, ["note_id", "text"]).first()["text"] == 'a "q"\nb'
    (tmp_path / "p.jsonl").write_text('{"subject_id": 1, "notes_kept": 3}\n{"subject_id": 2, "notes_kept": ["a","b"]}\n')
    got = {r["subject_id"]: (r["notes_kept_n"], r["notes_kept_ids"]) for r in io.read_predictions(spark, str(tmp_path / "p.jsonl")).collect()}
    assert got == {1: (3, None), 2: (2, ["a", "b"])}
    (tmp_path / "r.json").write_text('{"patients": {"7": {"candidates": [{"idx": 4, "sample_score": 0.5}], "n_candidates_valid": 1}}}')
    assert io.read_rollouts(spark, str(tmp_path / "r.json")).first()["idx"] == 4
    df = spark.createDataFrame([(1, "train"), (2, "test")], "a int, split string")
    io.write_jsonl(df, str(tmp_path / "out"), by=["split"])
    assert sorted(p.name for p in (tmp_path / "out").glob("split=*")) == ["split=test", "split=train"]
    assert "| a | split |" in io.markdown(df)
    with pytest.raises(Exception):
        io.write_vectors(spark.createDataFrame([([1.0],)], "vector array<float>"), str(tmp_path / "v"), 2)


CONFIG = """
# queries
emb_dim: 6   # width
num_queries: 3
num_note_queries: 2
num_code_queries: 1
k_retrieval: 2
attn_temperature: 1.0
use_sampling_retrieval: FALSE
init_temperature: 1.5
final_temperature: 0.05
temp_anneal_epochs: 2
aggregator: "mean"
transformer_layers: 1
transformer_heads: 8
transformer_dim_ff: 2048
dropout: 0.1
expert_hidden_dim: 4
num_epochs: 1
batch_size: 8
lr: 1e-3
weight_decay: 0.01
warmup_steps: 2
aux_loss_weight: 0.01
simplicity_loss_weight: 1.0
max_grad_norm: null
note_parquet: "NOTES"
code_parquet: CODES
db_uri: "x#y"
note_table: n
code_table: c
train_set_ratio: 0.8
random_state: 42
device: "cuda"
seed: 42
"""


def test_settings():
    values = config.parsed(CONFIG)
    good = config.settings(values)
    assert (good.emb_dim, good.lr, good.use_sampling_retrieval, good.max_grad_norm, good.db_uri, good.enable_dynamic_gating) == (6, 0.001, False, None, "x#y", True)
    plan = good.plan(17)
    assert plan.batches == 3 and plan.warmup_steps == 2 and plan.max_grad_norm is None and plan.simplicity_loss_weight == 1.0
    for bad in ({"num_code_queries": 2}, {"num_note_queries": 0, "num_code_queries": 3}, {"aggregator": "x"}):
        with pytest.raises(ValueError):
            config.settings({**values, **bad})
    for bad in ({**values, "typo": 1}, {k: v for k, v in values.items() if k != "lr"}):
        with pytest.raises(TypeError):
            config.settings(bad)
    assert config.settings({**values, "enable_dynamic_gating": False}).model(np.ones((3, 6))).static
    with pytest.raises(ValueError):
        good.model(np.ones((3, 5)))
    with pytest.raises(ValueError):
        config.parsed("a: 1\n  - b")


def test_command_line(spark, tmp_path):
    from marlow.__main__ import main

    rng = np.random.default_rng(7)
    label = rng.integers(0, 2, 12)
    rows = [(s, s * 10 + j, j, (rng.normal(0, 0.3, 6) + (2 * label[s] - 1) * np.eye(6)[j]).tolist()) for s in range(12) for j in range(4)]
    notes = spark.createDataFrame(rows, "subject_id long, vec_id long, days long, vector array<double>")
    notes.write.parquet(f"{tmp_path}/notes")
    notes.where("days < 2").write.parquet(f"{tmp_path}/codes")
    spark.createDataFrame([("Note", 0, rng.normal(size=6).tolist()), ("Note", 1, rng.normal(size=6).tolist()), ("Code", 2, rng.normal(size=6).tolist())], "modality string, query_idx int, vector array<double>").write.parquet(f"{tmp_path}/queries")
    spark.createDataFrame([(s, int(label[s]), "val" if s % 3 == 0 else "train") for s in range(12)], "subject_id long, label int, part string").write.parquet(f"{tmp_path}/labels")
    (tmp_path / "run.yaml").write_text(CONFIG.replace("NOTES", f"{tmp_path}/notes").replace("CODES", f"{tmp_path}/codes"))
    common = ["--config", f"{tmp_path}/run.yaml", "--queries", f"{tmp_path}/queries", "--labels", f"{tmp_path}/labels", "--state", f"{tmp_path}/state"]
    main(["train", *common, "--set", "lr=0.01"], spark)
    main(["score", *common, "--output", f"{tmp_path}/scores"], spark)
    main(["explain", *common, "--output", f"{tmp_path}/shares", "--num-steps", "400"], spark)
    p = {r["subject_id"]: r["probability"] for r in spark.read.json(f"{tmp_path}/scores").collect()}
    shares = spark.read.parquet(f"{tmp_path}/shares").toPandas()
    assert len(p) == 12 and set(shares["subject_id"]) == set(range(12)) and all(abs(g["p"].iloc[0] - p[s]) < 1e-9 for s, g in shares.groupby("subject_id"))
    assert set(zip(shares["subject_id"], shares["vec_id"])) <= {(r[0], r[1]) for r in rows}
    block = "=" * 72 + "\nEVIDENCE ALIGNMENT REPORT: Patient {}\n" + "=" * 72 + "\nMortality prediction: 0.5\n"
    (tmp_path / "typed.txt").write_text("".join(block.format(k) for k in (3, 1, 3)))
    main(["check", "--typed-txt", f"{tmp_path}/typed.txt", "--out-check", f"{tmp_path}/check", "--out-per-pat", f"{tmp_path}/blocks"], spark)
    checked = spark.read.json(f"{tmp_path}/check").collect()
    assert sorted(r["sid"] for r in checked) == [1, 3] and all("missing_verification_line" in r["failures"] and not r["format_pass"] for r in checked)


def test_streams(spark, tmp_path):
    from marlow.streaming import streams

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a b c d e")], "note_id long, text string").write.parquet(src)
    s = spark.readStream.schema("note_id long, text string").parquet(src)
    q = streams.chunk_stream(s, 4, 1).writeStream.format("memory").queryName("chunks").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("chunks").count() == 2


def test_keyed_streams(spark, tmp_path):
    from marlow.streaming import streams

    rows = [(1, "A", "2024-01-01 00:00:00"), (1, "A", "2024-01-01 00:10:00"), (1, "B", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "subject_id long, code string, t string").withColumn("t", F.col("t").cast("timestamp_ntz")).write.parquet(str(tmp_path / "c"))
    s = spark.readStream.schema("subject_id long, code string, t timestamp_ntz").parquet(str(tmp_path / "c"))
    q = streams.keep_first_stream(s, "t").writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["code"] for r in spark.table("firsts").collect()) == ["A", "B"]
    e = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = streams.verdict_counts(e).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").groupBy().sum("n").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_ordering(spark):
    from marlow.operators import ordering

    df = spark.range(50).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 50).alias("o"), F.lit(1).alias("v")).repartition(4)
    placed = ordering.ordinal(df, "o").collect()
    assert [r["o"] for r in sorted(placed, key=lambda r: r["_place"])] == list(range(50))
    within = ordering.ordinal_within(df, "g", "o").collect()
    assert sorted((r["g"], r["_place"]) for r in within) == sorted((g, k) for g in range(3) for k in range(17 if g < 2 else 16))
    sums = {(r["g"], r["o"]): r["_before"] for r in ordering.running(df, ["g"], "o", "v").collect()}
    assert all(sums[r["g"], r["o"]] == r["_place"] for r in within)


def test_documents_caches_and_manifests(spark, tmp_path):
    import json

    df = spark.createDataFrame([(2, 'b "x"', None), (1, "a", 0.5)], "k long, t string, p double")
    io.write_document(df, f"{tmp_path}/list")
    io.write_document(df, f"{tmp_path}/map", key="t")
    read = lambda name: json.loads(next(p for p in (tmp_path / name).iterdir() if p.name.startswith("part")).read_text())
    assert sorted(read("list"), key=lambda r: r["k"]) == [{"k": 1, "t": "a", "p": 0.5}, {"k": 2, "t": 'b "x"', "p": None}]
    assert read("map") == {"a": {"k": 1, "p": 0.5}, 'b "x"': {"k": 2, "p": None}}
    io.write_texts(df, f"{tmp_path}/texts", "k", "t", manifest=True)
    assert set(read("texts-manifest")) == {"1", "2"} and read("texts-manifest")["1"]["n_chars"] == 1
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/a.jsonl").write_text('{"key": "x", "v": 1}\nbroken\n{"v": 2}\n{"key": "y", "v": 3}\n{"key": "x", "v": 4}\n')
    (tmp_path / "cache/b.jsonl").write_text('{"key": "y", "v": 5}\n')
    assert {r["key"]: r["v"] for r in io.read_cache(spark, f"{tmp_path}/cache", "key string, v int").collect()} == {"x": 4, "y": 5}
    for n in (10, 2, 1):
        (tmp_path / f"batch_{n:02d}.json").write_text(json.dumps([{"n": n}]))
    assert [r["file"] for r in io.read_batches(spark, f"{tmp_path}/batch_*.json", "n int").collect()] == ["batch_01.json", "batch_02.json", "batch_10.json"]
    vectors_ = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<float>")
    io.write_vectors(vectors_, f"{tmp_path}/v", 2)
    said = io.copied(spark, f"{tmp_path}/v", f"{tmp_path}/w")
    assert said["rows"] == 1 and said["bytes_before"] > 0 and said["bytes_after"] > 0 and spark.read.parquet(f"{tmp_path}/w").first()["vector"] == [1.0, 2.0]
    assert io.read_texts(spark, f"{tmp_path}/texts").count() == 2 and io.first_column(df, ["z", "t"]) == "t"


def test_prompts(spark):
    from marlow.functions import prompts

    df = spark.createDataFrame([("x {y}", 0.5)], "t string, p double")
    m = df.select(prompts.messages("answer", F.col("t"), "More.").alias("m")).first()["m"]
    assert [r["role"] for r in m] == ["system", "user", "assistant"] and m[0]["content"].endswith("\n\nMore.") and m[1]["content"].endswith("x {y}")
    assert df.select(prompts.filled("{a} {1} {b}{a}", a=F.col("p"), b=F.lit(None).cast("string"))).first()[0] == "0.5 {1} 0.5"
    with pytest.raises(KeyError):
        prompts.filled("{a}{zz}", a=F.lit(1))
    v = df.select(prompts.verdict(F.lit('{"per_factor": [{"idx": 1, "reasoning_follows_from_evidence": true}], "overall_rationale": "r"}'), prompts.COHERENCE).alias("v")).first()["v"]
    assert v["per_factor"][0]["reasoning_follows_from_evidence"] and v["overall_rationale"] == "r"


def test_judges_are_called_some_at_a_time(spark):
    from marlow.operators import external

    def judge(report):
        if report == "bad":
            raise RuntimeError("no")
        return report.upper()

    work = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "subject_id long, report string")
    none = spark.createDataFrame([], "key string")
    got = {r["subject_id"]: r["verdict"] for r in external.judged(work, none, judge, "m", tries=2, wait=0.01, at_once=3).collect()}
    assert got == {1: "A", 2: None, 3: "C"}


def test_completeness_and_row_index(spark):
    from marlow.operators import relational

    a, b = spark.range(5).withColumnRenamed("id", "k"), spark.range(3).withColumnRenamed("id", "k")
    assert relational.missing(a, "k", b=b).first().asDict() == {"n": 5, "b": 2} and relational.complete(b, "k", a=a).count() == 3
    with pytest.raises(ValueError):
        relational.complete(a, "k", b=b)
    assert {r["k"]: r["row_index"] for r in relational.with_row_index(a.where("k % 2 = 0"), "k").collect()} == {0: 0, 2: 1, 4: 2}
    assert relational.prefixed(a.withColumn("v", F.lit(1)), "verdict_", "k").columns == ["k", "verdict_v"]


def test_factor_and_anatomy_issues(spark):
    good = "\n".join(f'{k}. Factor summary: f\n   Supporting evidence: "q" (note_id: 1)\n   Reasoning: r\n   Attribution score: +0.1' for k in range(1, 6))
    a, b, c, d = parsing.SECTIONS
    cases = {
        f"{a}\n{b}\n{good}\n{c}\n{d}": ([], []),
        f"{a}\n{b}\n{c}\n{d}": (["factor_numbering:none"], ["wrong_factor_count_or_order:", "too_few_supporting_evidence:0", "too_few_reasoning:0", "too_few_attribution:0"]),
        f"{b}\n{good}\n{a}\n{c}\n{d}": ([f"section_out_of_order:{b}"], [f"out_of_order_section:{b}"]),
        "": (["empty_report"], None),
    }
    cases[f"{a}\n{b}\n" + good.replace('2. Factor summary: f\n   Supporting evidence: "q" (note_id: 1)', "2. Factor summary: f") + f"\n{c}\n{d}"] = (["factor2:missing_supporting_evidence"], ["too_few_supporting_evidence:4"])
    df = spark.createDataFrame([(x,) for x in cases], "r string")
    for r in df.select("r", parsing.factor_issues(F.col("r")).alias("f"), parsing.listed(parsing.anatomy_issues(F.col("r"))).alias("a")).collect():
        factors, anatomy = cases[r["r"]]
        assert r["f"] == factors and (anatomy is None or r["a"] == anatomy), r["r"]


def test_bags_are_scored_by_sums(spark):
    from marlow.functions.networks import GatedMil
    from marlow.plans import modelling

    rng = np.random.default_rng(2)
    v = rng.normal(size=(9, 8))
    df = spark.createDataFrame([(k % 2, v[k].tolist()) for k in range(9)], "subject_id long, vector array<double>")
    got = {r["subject_id"]: (r["n_items"], r["p"]) for r in modelling.mil_scores(df.limit(5), df.exceptAll(df.limit(5))).collect()}
    for s in (0, 1):
        bag = v[[k for k in range(9) if k % 2 == s]]
        assert got[s] == (len(bag), pytest.approx(GatedMil(8, 16, 5).score(bag), abs=1e-6))


def test_bootstrap_against_plain_metrics(spark):
    from marlow.operators import metrics

    rng = np.random.default_rng(5)
    rows = [(k, m, int(k % 3 == 0), round(float(rng.random()), 1)) for k in range(30) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "s long, method string, label int, p double")
    weights = {}
    for r in metrics.times(df, "s", 20).collect():
        weights.setdefault(r["draw"], {})[r["s"]] = r["times"]
    for r in metrics.resampled(df, "s", ["method"], 20).collect():
        items = [(y, p, weights[r["draw"]].get(s, 0)) for s, m, y, p in rows if m == r["method"]]
        pos, neg = [(p, w) for y, p, w in items if y], [(p, w) for y, p, w in items if not y]
        n1, n0 = sum(w for _, w in pos), sum(w for _, w in neg)
        won = sum(w * v * ((p > q) + 0.5 * (p == q)) for p, w in pos for q, v in neg)
        tp, fp = sum(w for p, w in pos if p >= 0.5), sum(w for p, w in neg if p >= 0.5)
        assert n1 and n0 and sum(weights[r["draw"]].values()) == 30
        want = (won / n1 / n0, (tp + n0 - fp) / 30, tp / (tp + fp) if tp + fp else 0, tp / n1, 2 * tp / (n1 + tp + fp))
        assert (r["auc"], r["accuracy"], r["precision"], r["recall"], r["f1"]) == pytest.approx(want)
    one = spark.createDataFrame([(1, "a", 1, 0.5)], "s long, method string, label int, p double")
    assert metrics.resampled(one, "s", ["method"], 5).count() == 0


def test_weights_and_padding(spark, tmp_path):
    w = {"head": np.arange(6.0).reshape(2, 3), "bias": np.array([0.5])}
    io.write_weights(spark, f"{tmp_path}/w", w, [{"epoch": 1, "auc": 0.5}, {"epoch": 2, "auc": 0.6}])
    got = io.read_weights(spark, f"{tmp_path}/w")
    assert set(got) == set(w) and all((got[k] == w[k]).all() and got[k].shape == w[k].shape for k in w)
    assert spark.read.json(f"{tmp_path}/w-history").count() == 2
    df = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, [[1.0, 1.0]] * 4), (3, [])], "k long, bag array<array<double>>")
    got = {r["k"]: r["p"] for r in df.select("k", vectors.padded(F.col("bag"), 3, 2).alias("p")).collect()}
    assert got == {1: [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]], 2: [[1.0, 1.0]] * 3, 3: [[0.0, 0.0]] * 3}


def test_bootstrap_of_hot_scores(spark):
    from marlow.operators import metrics

    rng = np.random.default_rng(5)
    n, draws = 1300, 7  # several blocks of subjects; half of all scores are equal, methods with two keys
    p = np.where(rng.random(n) < 0.5, 0.5, rng.random(n).round(2))
    label = rng.integers(0, 2, n)
    rows = [(int(i), m, "x", int(label[i]), float(abs(p[i] - k))) for i in range(n) for k, m in enumerate(("a", "b"))]
    df = spark.createDataFrame(rows, "subject_id long, method string, kind string, label int, p double")
    got = {(r["draw"], r["method"]): r for r in metrics.resampled(df, "subject_id", ["method", "kind"], draws).collect()}
    import hashlib

    for d in range(draws):
        source = [int(hashlib.md5(f"42|{d}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        for k, m in enumerate(("a", "b")):
            x, y = abs(p[source] - k), label[source]
            pos, neg = np.sort(x[y == 1]), np.sort(x[y == 0])
            won = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2
            r = got[d, m]
            assert r["auc"] == pytest.approx(won / (len(pos) * len(neg))) and r["recall"] == pytest.approx((pos >= 0.5).mean()) and r["accuracy"] == pytest.approx(((x >= 0.5) == (y == 1)).mean())
    counted = metrics.draws(df.select("subject_id"), "subject_id", draws).collect()
    assert all(r["n"] == n and 0.6 * n < r["n_distinct"] < 0.66 * n for r in counted) and len(counted) == draws


def test_index_of_split_cells(spark, monkeypatch):
    from marlow.operators import ann

    monkeypatch.setattr(ann, "SLICE", 100)
    monkeypatch.setattr(ann, "AT_ONCE", 16)
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(0, 0.02, (600, 16)) + rng.normal(0, 1, 16), rng.normal(0, 1, (600, 16))])  # half of all in one place
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [float("nan")] * 16), (2002, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = ann.build(df, cells=4, parts=4, rounds=4)
    assert index.codes.count() == 1200 and index.codes.groupBy("cell", "slice").count().agg(F.max("count")).first()[0] <= 200 and index.slices.agg(F.max("slices")).first()[0] >= 3
    asked = index.rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    true = ann.exact(index.rows, asked, 4)
    unit_ = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, ids in true.groupBy("query_id").agg(F.collect_set("id")).collect():
        score = unit_ @ unit_[q]
        assert len(ids) == 4 and score[ids].min() > np.sort(score)[-4] - 1e-5
    found = ann.search(index, asked, 4, *ann.settings_for(index, asked, 4))
    assert ann.recall(found, true) >= 0.9 and found.groupBy("query_id").count().where("count <> 4").count() == 0


@pytest.mark.parametrize("newest", [True, False])
def test_truncation_is_that_of_a_linear_scan(newest):
    import public_tokenizers

    from marlow.operators import truncation as tr

    bpe = tr.byte_pairs(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(9)
    words = ["fever", "42", "naïve", "—", "sepsis!!", "a" * 30, "\n", "[x]"]
    texts = ["", "Clinical notes (N=0)\n\n\nCodes (N=1)\nc", "no notes at all"]
    for n in (1, 2, 5, 17):
        notes = [f"[Note {i + 1}] t at age 3, 4 days\n" + " ".join(rng.choice(words, int(rng.integers(1, 60)))) for i in range(n)]
        texts.append(f"Clinical notes (N={n})\n" + "\n".join(notes) + "\n\nCodes (N=2)\nx (1-9)\ny (2-10)")
    records = [tr.Record.of(t) for t in texts]
    assert [len(r.notes) for r in records] == [0, 0, 0, 1, 2, 5, 17] and all(r.text(len(r.notes), newest) == t for r, t in zip(records, texts))
    render = lambda t: tr.rendered("answer", t, "Be brief.")
    for budget in (10, 120, 300, 700, 10_000):
        for r, (prompt, tokens, kept) in zip(records, tr.fitted(records, budget, bpe, newest, render)):
            n = len(r.notes)
            costs = bpe([render(r.text(k, newest)) for k in range(n + 1)])
            fits = [k for k in range(1, n + 1) if costs[k] <= budget]
            assert kept == (max(fits) if fits else min(1, n)) and tokens == costs[kept] and prompt == render(r.text(kept, newest))
    calls = []
    tr.fitted(records, 300, lambda p: calls.append(len(p)) or bpe(p), newest, render)
    assert calls[0] == 7 and len(calls) <= 6  # all together, and by halves


@pytest.mark.parametrize("newest", [True, False])
def test_truncation_gathers_only_notes_that_can_fit(spark, newest):
    import datetime

    import public_tokenizers

    from marlow.operators import truncation as tr
    from marlow.plans import catalog  # noqa: F401
    from marlow.plans import texts

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng, day = np.random.default_rng(4), datetime.datetime(2020, 1, 1)
    words = ["fever", "42", "naïve", "—", "sepsis!!", "a" * 30, "\n", "[x]", "two\u00a0words"]
    sizes = {1: [1500] * 60, 2: [], 3: [20, 9000, 20], 4: [5, 7], 5: [40] * 300, 6: [9000] * 3}
    rows = [(s, 1000 * s + i, "t", day + datetime.timedelta(i), 50, 900 - i, " ".join(rng.choice(words, n))) for s, ns in sizes.items() for i, n in enumerate(ns)]
    notes = spark.createDataFrame(rows, "subject_id long, note_id long, note_type string, charttime timestamp, age int, days int, text string").repartition(6)
    codes = spark.createDataFrame([(s, c, 9, f"title {c}", c, c) for s in (1, 2, 4) for c in range(3)], "subject_id long, code long, version int, title string, days int, ord long")
    labels = spark.createDataFrame([(s, s % 2) for s in sizes], "subject_id long, label int")
    calls = []
    for count, bounds in ((tr.byte_pairs(path), tr.byte_pair_bounds(path, 6000)), (tr.approximate, tr.approximate_bounds(6000))):
        parts = texts.record_parts(notes, codes, labels, bounds, newest)
        got = {r["subject_id"]: r for r in tr.fit_parts(parts, 6000, count, newest).collect()}
        want = tr.fit(texts.records(notes, codes, labels), 6000, count, newest).collect()
        assert len(got) == len(want) == 6 and all(got[r["subject_id"]] == r for r in want) and got[1]["total"] == 60 and got[6]["kept"] == 1 and got[2]["kept"] == 0
        held = {r["subject_id"]: r["notes"] for r in parts.collect()}
        assert len(held[1]) < 6 and len(held[5]) < 200  # of 60 and 300, whatever the history's length
    records = [tr.Record("h", ["w" * 50_000], "t") for _ in range(64)]
    tr.fitted(records, 10, lambda p: calls.append(sum(map(len, p))) or [1] * len(p), newest, lambda t: t)
    assert max(calls) <= tr.AT_ONCE and len(calls) == 4  # sixty-four large prompts are not tokenised at once


@pytest.mark.parametrize("newest", [True, False])
def test_notes_without_text_count_as_in_the_sql(spark, newest, tmp_path):
    import shutil

    import duckdb
    import pandas as pd

    from marlow.plans import catalog, roles
    from tests.test_parity import SF

    for name in roles.TABLES:
        if name != "documents":
            shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    d = pd.read_parquet(f"{SF}/documents.parquet")
    more = d.assign(doc_id=d["doc_id"] + 97 * 10, text="nbsp\u00a0joined " + d["text"])
    blank = d["doc_id"] % 97 < 9
    d.loc[blank & (d["doc_id"] >= 97), "text"] = None
    more.loc[more["doc_id"] % 97 < 5, "text"] = None
    d.loc[d["doc_id"] < 3, "text"] = None
    pd.concat([d, more]).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    for name in roles.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    name = "fit_prompt_recent" if newest else "fit_prompt_early"
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLES[name]).df()
    columns = ["subject_id", "digest", "tokens", "truncated", "kept", "total"]
    key = lambda x: [tuple(r) for r in x[columns].sort_values("subject_id").astype(object).to_numpy().tolist()]
    assert key(got) == key(want) and got["truncated"].any()


@pytest.mark.parametrize("newest", [True, False])
def test_texts_out_of_reach_are_not_gathered(spark, newest):
    import datetime

    from marlow.operators import truncation as tr
    from marlow.plans import catalog, texts  # noqa: F401

    day = datetime.datetime(2020, 1, 1)
    # a history that is long, one of notes without texts but for a few in the middle, and two notes of the same key
    sizes = {1: ["a b c"] * 4000, 2: [None] * 1500 + ["x y"] * 3 + [None] * 1500, 3: ["p"], 4: ["q"]}
    rows = [(s, 10000 * s + i, "t", day + datetime.timedelta(i), 50, len(x) - i, t) for s, x in sizes.items() for i, t in enumerate(x)] + [(3, 30000, "t", day, 50, 1, "r r")]
    notes = spark.createDataFrame(rows, "subject_id long, note_id long, note_type string, charttime timestamp, age int, days int, text string").repartition(3)
    codes = spark.createDataFrame([], "subject_id long, code long, version int, title string, days int, ord long")
    labels = spark.createDataFrame([(s, 1) for s in (1, 2, 3)], "subject_id long, label int")
    bounds = tr.approximate_bounds(6000)
    heads = notes.withColumn("text", F.when(F.col("text").isNotNull(), ""))
    for few in (256, 0):  # keys broadcast, and joined
        texts.FEW, before = few, texts.FEW
        try:
            near = {s: [r for r in texts.notes_in_reach(notes, heads, labels, bounds, newest).collect() if r["subject_id"] == s] for s in sizes}
            assert len(near[1]) == bounds[0][1] // 6 and all(r["total"] == 4000 for r in near[1]) and not near[4]
            assert len(near[2]) == 3003 and sorted(r["text"] for r in near[3]) == ["p", "r r"]
            got = {r["subject_id"]: r for r in tr.fit_parts(texts.record_parts(notes, codes, labels, bounds, newest), 6000, newest=newest).collect()}
        finally:
            texts.FEW = before
        want = {r["subject_id"]: r for r in tr.fit(texts.records(notes, codes, labels), 6000, newest=newest).collect()}
        assert got[1] == want[1] and got[2]["total"] == got[2]["kept"] == 3003 and got[2]["prompt"].count("x y") == 3
        assert got[3]["total"] == got[3]["kept"] == 2 and {"p", "r"} <= set(got[3]["prompt"].split())


@pytest.mark.parametrize("name", ["fit_prompt_recent", "fit_prompt_early", "fit_prompt_tokens"])
def test_prompts_take_no_text_through_the_window_of_notes(spark, name):
    import re

    from marlow.plans import catalog
    from tests.test_parity import SF

    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    windows = [k for k, x in enumerate(plan) if "Window [max(doc_id#" in x]
    for k in windows:
        table = next(i for i in range(k, len(plan)) if "Relation [" in plan[i])
        text = re.search(r"text#\d+", plan[table])[0]
        assert not any(re.search(rf"[\[ ]{text}[,\]]", x) for x in plan[k:table])
    assert windows


def test_any_cut_of_a_file_gives_the_same_reports(spark, tmp_path):
    import io as bytes_

    from marlow.sources import reports

    rng = np.random.default_rng(4)
    parts = []
    for k in range(40):
        rule = "=" * int(rng.integers(1, 9000 if k == 7 else 80))
        parts.append((str(k % 30), f"{rule}\nEVIDENCE ALIGNMENT REPORT: Patient {k % 30}\n=====\n" + "é text = x\n====\nEVIDENCE ALIGNMENT REPORT: Patient none\n" * int(rng.integers(0, 30)) + ("==\n" if k % 3 else "")))
    text = "a preface\n" + "".join(p for _, p in parts)
    (tmp_path / "all.txt").write_text(text)
    import re

    heads = list(re.finditer(r"=+\nEVIDENCE ALIGNMENT REPORT: Patient (\d+)\n=+", text))
    want = [(m[1], text[m.start() : heads[i + 1].start() if i + 1 < len(heads) else len(text)].rstrip() + "\n") for i, m in enumerate(heads)]
    assert len(want) == 40
    data = text.encode()
    for split in (1, 7, 64, 1000, 10**6):
        for step in (50, 1 << 20) if split > 50 else (1 << 20,):
            reports.STEP, old = step, reports.STEP
            try:
                f = bytes_.BytesIO(data)
                lows = range(0, len(data), split) if split > 7 else range(0, 4000, split)
                got = [(n, b) for lo in lows for n, _, b in reports.blocks(f, lo, min(len(data), lo + split), len(data))]
            finally:
                reports.STEP = old
            assert got == (want if split > 7 else want[: len(got)]) and len(got) >= 3
    df = reports.read_reports(spark, str(tmp_path), split=500).orderBy("path", "start")
    assert [(r["subject_id"], r["block"]) for r in df.collect()] == want and df.rdd.getNumPartitions() >= 1


def test_encoder_layer_against_loops(spark):
    from marlow.functions.encoder import Layer
    from marlow.operators import gating

    rng = np.random.default_rng(1)
    layer, dim = Layer.fixed(8, heads=2, hidden=6), 8
    w = layer.weights

    def by_loops(x):
        out = []
        for i in range(len(x)):
            mixed = []
            for h in range(2):
                cols = slice(h * 4, h * 4 + 4)
                q = x[i] @ w["q"][:, cols] + w["q_bias"][cols]
                score = [q @ (k @ w["k"][:, cols] + w["k_bias"][cols]) / 2 for k in x]
                e = [np.exp(s) for s in score]
                mixed += list(sum(a * (k @ w["v"][:, cols] + w["v_bias"][cols]) for a, k in zip(e, x)) / sum(e))
            y = x[i] + np.array(mixed) @ w["o"] + w["o_bias"]
            y = (y - y.mean()) / np.sqrt(y.var() + 1e-5) * w["norm1"] + w["norm1_bias"]
            z = y + networks.gelu(y @ w["f1"] + w["f1_bias"]) @ w["f2"] + w["f2_bias"]
            out.append((z - z.mean()) / np.sqrt(z.var() + 1e-5) * w["norm2"] + w["norm2_bias"])
        return np.mean(out, axis=0)

    bags = {1: rng.normal(size=(23, dim)), 2: rng.normal(size=(1, dim)), 3: rng.normal(size=(7, dim))}
    df = spark.createDataFrame([(s, 100 * s + i, v.tolist()) for s, x in bags.items() for i, v in enumerate(x)], "subject_id long, vec_id long, vector array<double>")
    for block in (4, 256):  # one block, and many that are merged
        for r in gating.encoded_summaries(df, layer, block).collect():
            assert np.allclose(r["v"], by_loops(bags[r["subject_id"]]), atol=1e-9)


def test_training_lowers_the_loss_and_goes_on_from_its_files(spark, tmp_path):
    from marlow.operators import gating, training

    rng = np.random.default_rng(7)
    n, d = 24, 6
    label = rng.integers(0, 2, n)
    side = np.where(label == 1, 1.0, -1.0)
    rows = [(s, s * 10 + j, j, (rng.normal(0, 0.3, d) + side[s] * np.eye(d)[j % d]).tolist()) for s in range(n) for j in range(5)]
    notes = spark.createDataFrame(rows, "subject_id long, vec_id long, days long, vector array<double>").cache()
    codes = notes.where("vec_id % 10 < 3 AND subject_id <> 5")  # one subject has no codes
    labels = spark.createDataFrame([(s, int(label[s]), "val" if s % 4 == 0 else "train") for s in range(n)], "subject_id long, label int, part string")
    model = gated.Gated.fixed(rng.normal(size=(3, d)), 2, hidden=4)
    fixed = training.inputs(notes, codes, labels)
    got = training.gradient(training._rows(notes, codes, fixed, model, 2), model, 2)
    asked = training._rows(notes, codes, fixed, model, 2).toPandas()
    total, loss = None, 0.0
    for _, s, y in training.subjects(iter([asked.sort_values("subject_id").iloc[:31], asked.sort_values("subject_id").iloc[31:]]), model, 2):
        logit, c = model.forward(s)
        g = training._flat(model.backward(s, c, float(gated.sigmoid(np.float64(logit))) - y)[0])
        total, loss = g if total is None else total + g, loss + np.logaddexp(0, logit) - y * logit
    assert got[1] == n and got[0] == pytest.approx(loss) and np.allclose(training._flat(got[2]), total)

    plan = training.Plan(num_epochs=2, batches=2, lr=0.03, warmup_steps=2, k_retrieval=2)
    path = f"{tmp_path}/state"
    training.fit(notes, codes, labels, model, plan, path)
    trained, history = training.fit(notes, codes, labels, model, training.replace(plan, num_epochs=4), path)
    assert [h["epoch"] for h in history] == [1, 2, 3, 4] and history[-1]["loss"] < 0.8 * history[0]["loss"]
    whole, all_ = training.fit(notes, codes, labels, model, training.replace(plan, num_epochs=4), f"{tmp_path}/whole")
    assert [h["loss"] for h in all_] == pytest.approx([h["loss"] for h in history]) and all(np.allclose(whole.weights[k], trained.weights[k]) for k in whole.weights)
    assert training.stopped([{"auc": a} for a in (0.6, 0.5, 0.6, 0.6)], 3) and not training.stopped([{"auc": a} for a in (0.6, 0.5, 0.7, 0.6)], 3)
    t = training.Plan(use_sampling_retrieval=True, batches=2, temp_anneal_epochs=2)
    assert [training.temperature(t, s) for s in (0, 3, 4)] == [1.5, pytest.approx(0.05), None] and training.temperature(plan, 0) is None
    drawn = gating.chosen(notes, training._queries(spark, model), 2, (1, 0.5)).collect()
    assert len({(r["subject_id"], r["query_idx"], r["vec_id"]) for r in drawn}) == n * 3 * 2


def test_rollouts_come_once_and_give_probabilities(spark):
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(9)], "subject_id long, prompt string").repartition(3)
    got = external.rollouts(prompts, external.stub_rollout, 4, top=2)
    rows = got.collect()
    assert len({(r["subject_id"], r["rollout_idx"]) for r in rows}) == len(rows) == 36 and len({r["seed"] for r in rows}) == 36
    assert rows == got.collect() and all(len(r["first"]) <= 2 and r["first"][0]["logprob"] >= r["first"][-1]["logprob"] for r in rows)
    rest = external.rollouts(prompts, external.stub_rollout, 4, done=got.where("rollout_idx < 3"))
    assert sorted((r["subject_id"], r["rollout_idx"]) for r in rest.collect()) == [(k, 3) for k in range(9)]
    cases = [([("Yes", -1.0), ("No", -3.0)], 1 / (1 + np.exp(-2.0)), "Yes"), ([(" Yes", -2.0)], 1.0, "Yes"), ([("Maybe", -0.1), ("No ", -1.0)], 0.0, "Maybe"), ([("x", -1.0)], 0.5, "x"), ([], 0.5, "first")]
    df = spark.createDataFrame([(i, [(t, x) for t, x in f], "first word") for i, (f, _, _) in enumerate(cases)], f"i int, first {external.FIRST}, completion string")
    x = external.answer_probability(F.col("first"), F.col("completion"))
    out = df.select("i", x["probability"].alias("p"), x["generated_token"].alias("t"), x["parse_ok"].alias("ok")).orderBy("i").collect()
    assert [(r["p"], r["t"]) for r in out] == [(pytest.approx(p), t) for _, p, t in cases] and [r["ok"] for r in out] == [True, True, True, False, False]


def test_verdicts_are_appended_with_their_costs(spark, tmp_path):
    work = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "ccc")], "subject_id long, report string")

    def judge(report):
        if report == "bad":
            raise RuntimeError("no")
        return external.Judgement(report.upper(), len(report), 2)

    path = str(tmp_path / "cache")
    first = {r["subject_id"]: (r["verdict"], r["input_tokens"], r["output_tokens"]) for r in external.judged_through(work, path, judge, "m", tries=1).collect()}
    assert first == {1: ("A", 1, 2), 3: ("CCC", 3, 2)}
    again = external.judged_through(work, path, lambda r: external.Judgement("late"), "m", tries=1)  # only the failed one is asked again
    assert {r["subject_id"]: r["verdict"] for r in again.collect()} == {1: "A", 2: "late", 3: "CCC"}


def test_pooled_head_by_hand(spark):
    from marlow.functions.networks import MeanPoolMlp, layer_norm
    from marlow.plans import modelling

    rng = np.random.default_rng(3)
    notes, codes = rng.normal(size=(4, 6)), rng.normal(size=(2, 6))
    frame_ = lambda x, ids: spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "subject_id long, vector array<double>")
    got = {r["subject_id"]: r["p"] for r in modelling.mean_pool_mlp(frame_(notes, [1, 1, 1, 2]), frame_(codes, [1, 3])).collect()}
    head = MeanPoolMlp(12, 16, 7)
    for s, a, b in ((1, notes[:3].mean(0), codes[0]), (2, notes[3], np.zeros(6)), (3, np.zeros(6), codes[1])):
        z = np.r_[a, b] @ head.w + head.b
        z = np.array([x * 0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z])
        assert got[s] == pytest.approx(1 / (1 + np.exp(-(layer_norm(z) @ head.head))), abs=1e-6)


def test_encoder_fitted_to_a_corpus(spark):
    from marlow.operators import encoding

    texts = ["the cat sat", "the dog sat", "the end", None, "", "the rare word"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    e = encoding.fitted(df)
    at = {w: next(iter(encoding.buckets_of(w))) for w in ("the", "cat", "sat", "never")}
    assert e.weights[at["the"]] == pytest.approx(math.log(7 / 5) + 1) and e.weights[at["sat"]] == pytest.approx(math.log(7 / 3) + 1) and e.weights[at["never"]] == pytest.approx(math.log(7) + 1)
    got = {r["i"]: np.array(r["vector"]) for r in encoding.encoded(df, "text", e, at_once=2).collect()}
    want = e.weights[at["the"]] * encoding.directions(1, 64)[at["the"]].astype(float)
    assert np.allclose(e.encode(["The"])[0], want / np.linalg.norm(want), atol=1e-6) and np.allclose(got[0], e.encode(["the cat sat"])[0])
    assert not got[3].any() and not got[4].any() and got[0] @ got[1] > got[0] @ got[2]


def test_unwrapped_reports_of_all_wrappers(spark):
    from marlow.plans import reports

    cases = {'{"report": "a"}': "a", '```json\n{"report": "b\nc"}\n```': "b\nc", '{"report": "Reasoning Lens d': "Reasoning Lens d", "{ nothing }": None, "plain": "plain", '{"x": 1}': None}
    df = spark.createDataFrame([(i, 0, c) for i, c in enumerate(cases)], "conv_id long, turn int, completion string")
    assert [r["report"] for r in reports.unwrap_reports(df).orderBy("conv_id").collect()] == list(cases.values())


def test_normalised_texts_are_compatible_forms(spark):
    from marlow.plans import reports
    import hashlib

    cases = {"ﬁrst  Ａge": "first age", "x²\u00a0y": "x2 y", "e\u0301": "é", "①…": "1", "½ cup": "1⁄2 cup"}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "note_id long, text string")
    assert [r["digest"] for r in reports.normalize_text(df).orderBy("note_id").collect()] == [hashlib.md5(v.encode()).hexdigest() for v in cases.values()]


def test_many_queries_are_scored_in_blocks(spark, monkeypatch):
    from marlow.operators import retrieval

    rng = np.random.default_rng(2)
    chunks = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(rng.normal(size=(7, 4)))], "subject_id long, vec_id long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(11, 4)))], "query_idx int, vector array<double>")
    whole = sorted(map(tuple, retrieval.scored(chunks, queries).select("vec_id", "query_idx", "score").collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 4)
    assert len(retrieval.blocks(queries, most=4)) == 3
    assert sorted(map(tuple, retrieval.scored(chunks, queries).select("vec_id", "query_idx", "score").collect())) == whole and len(whole) == 77
