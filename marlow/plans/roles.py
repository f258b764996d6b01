"""Roles: what the driver's tables stand for in an evidence pipeline.

``note_events`` are dated texts of subjects, ``code_events`` dated codes of subjects,
vectors are embedded chunks of either, ``predictions`` are scores of three methods for
labelled texts, and so on.  Each role has a Spark SQL text and the same in the oracle's
dialect (where it differs), both over raw tables and other roles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from marlow.functions.parsing import SECTIONS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _factor(k: int) -> str:
    """SQL: factor ``k`` of a typed report, with the faults of variant ``v``."""
    number = f"CASE WHEN v = 5 THEN '{9 - k if k > 3 else k}' ELSE '{k}' END"
    quote = f"CASE WHEN v = 6 AND {k} = 2 THEN 'no quote' ELSE '\"' || q || ' {k}\"' END"
    cited = f"CASE WHEN v = 12 AND {k} = 4 THEN '' WHEN (doc_id + {k}) % 3 = 0 THEN ' (ICD code: I1' || '{k}.9-10)' ELSE ' (note_id: ' || CAST(doc_id AS STRING) || ')' END"
    reason = f"CASE WHEN v = 11 AND {k} = 3 THEN '' ELSE '   Reasoning: since ' || '{k}' || chr(10) END"
    score = f"CASE WHEN v = 7 AND {k} > 3 THEN '' ELSE '   Attribution score: ' || CASE WHEN {k} % 2 = 0 THEN '-' ELSE '+' END || '0.' || CAST({k} * 1000 + doc_id % 1000 AS STRING) || chr(10) END"
    flag = f"CASE WHEN doc_id % {k + 3} = 0 THEN '   >> Possible provenance error ' || DASH || ' look again' || chr(10) ELSE '' END"
    whole = f"{number} || '. Factor summary: f{k}' || chr(10) || '   Supporting evidence: ' || {quote} || {cited} || chr(10) || {reason} || {score} || {flag}"
    return f"CASE WHEN v = 4 AND {k} = 5 THEN '' ELSE {whole} END" if k == 5 else whole


_LENS = f"CASE WHEN v = 2 THEN '' WHEN v = 3 THEN '{SECTIONS[3]}' || chr(10) || '{SECTIONS[2]}' || chr(10) ELSE '{SECTIONS[2]}' || chr(10) || 'Because.' || chr(10) END || CASE WHEN v = 3 THEN '' ELSE '{SECTIONS[3]}' || chr(10) || 'Watch.' || chr(10) END"
_FIRST = f"'{SECTIONS[0]}' || chr(10) || 'It is so.' || chr(10) || '{SECTIONS[1]}' || chr(10) || {' || '.join(_factor(k) for k in range(1, 6))}"
#: A typed report of every document, the same SQL in both dialects; fourteen variants, of which 0 has no fault.
TYPED = f"""SELECT doc_id AS subject_id, v, repeat('=', 72) || chr(10) || 'EVIDENCE ALIGNMENT REPORT: Patient ' || CAST(CASE WHEN v = 9 THEN doc_id + 1 ELSE doc_id END AS STRING) || chr(10) || repeat('=', 72) || chr(10)
    || 'Mortality prediction: ' || CASE WHEN v = 1 THEN 'high' ELSE '0.' || CAST(1000 + doc_id % 9000 AS STRING) END || chr(10) || CASE WHEN v = 13 THEN {_LENS} || {_FIRST} ELSE {_FIRST} || {_LENS} END
    || CASE WHEN v = 8 THEN 'Verification: 6/5 steps passed.' ELSE 'Verification: ' || CAST(doc_id % 6 AS STRING) || '/5 steps passed.' END || chr(10)
    || CASE WHEN v = 10 THEN '  Flagged: Factor 9 ' || DASH || ' provenance error.' || chr(10) WHEN doc_id % 5 = 0 THEN '  Flagged: Factor 2 ' || DASH || ' hallucination.' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 29 = 0 THEN '' ELSE repeat('=', 72) || chr(10) END AS report
  FROM (SELECT doc_id, doc_id % 14 AS v, translate(substring(coalesce(text, ''), 11, 30), '"' || chr(10), '  ') AS q FROM {{documents}}) d"""

# Reports as models write them: headings in brackets, in bold or bare (``form``), quotes straight or curly, evidence with or without
# its label, citations of notes and codes, a code after a note, evidence that goes on in the next line.
_K, _FORM = "CAST(k AS STRING)", "doc_id % 3"


def _heading(bracketed: str, bold: str, bare: str) -> str:
    return f"CASE {_FORM} WHEN 0 THEN '[{bracketed}]' WHEN 1 THEN '**{bold}**' ELSE '{bare}' END || chr(10)"


#: SQL of a factor's citation, of its evidence, of itself, both dialects, over the role ``factors``.
CITATION = "CASE WHEN kind = 'icd' THEN '(ICD code: ' || substring(code, 1, 1) || '.' || substring(code, 2) || ')' ELSE '(note_id: ' || CAST(handle AS STRING) || ')' END"
EVIDENCE = f"""CASE WHEN (doc_id + k) % 2 = 0 THEN '“' || quote || '”' ELSE '"' || quote || '"' END || ' ' || {CITATION} || CASE WHEN kind = 'note' AND (doc_id + k) % 9 = 4 THEN '; see (ICD code: I10-10)' ELSE '' END
    || CASE WHEN (doc_id + k) % 4 = 1 THEN chr(10) || '   Age: 60; Date: 2020-01-01' ELSE '' END"""
LABELLED = "(doc_id + k) % 6 <> 5"
FACTOR = f"""CASE {_FORM} WHEN 0 THEN {_K} || '. Factor summary: f' WHEN 1 THEN {_K} || '. **Factor summary**: f' ELSE {_K} || '. Factor: f' END || {_K} || chr(10) || '   ' || CASE WHEN {LABELLED} THEN 'Supporting evidence: ' ELSE '' END
    || {EVIDENCE} || chr(10) || '   Reasoning: r' || {_K} || ', not yet the Recommendations' || chr(10) || '   Attribution score: +0.' || {_K} || chr(10)"""
_BEFORE = f"""{_heading(SECTIONS[0][1:-1], 'Prediction', 'Prediction and explanation')} || 'Risk: ' || CAST(doc_id % 100 AS STRING) || '%' || chr(10) || chr(10) || {_heading(SECTIONS[1][1:-1], 'Predictive Factors', 'Predictive Factors:')}"""
_BEHIND = f"""{_heading('Reasoning Lens', 'Reasoning Lens', 'Reasoning Lens')} || 'It follows.' || chr(10) || CASE WHEN doc_id % 10 = 9 THEN '' ELSE {_heading('Recommendations', 'Recommendations', 'Recommendations:')} || 'Watch.' || chr(10) END"""
#: SQL of a factor with Markdown around headings and labels, and of the same factor clean; those without a number are counted by themselves.
RAW_FACTOR = f"""CASE k % 3 WHEN 0 THEN '**' || {_K} || '. Factor summary: f' || {_K} || '**' WHEN 1 THEN {_K} || '. **Factor summary**: f' || {_K} ELSE 'Factor summary: f' || {_K} END || chr(10) || '   - Supporting evidence: "' || quote || '"' || chr(10)
    || '   **Reasoning**: low **bold word** here' || chr(10) || '   * Attribution score: +0.' || {_K} || chr(10) || '   ** Cited source ** : x' || chr(10) || '   - Other: y' || chr(10)"""
CLEAN_FACTOR = f"""CASE k % 3 WHEN 2 THEN CAST((k + 1) / 3 AS STRING) ELSE {_K} END || '. Factor summary: f' || {_K} || chr(10) || '   Supporting evidence: "' || quote || '"' || chr(10)
    || '   Reasoning: low **bold word** here' || chr(10) || '   Attribution score: +0.' || {_K} || chr(10) || '   Cited source: x' || chr(10) || '   - Other: y' || chr(10)"""


def _joined(before: str, factor: str, behind: str, aggregate: str) -> str:
    return f"SELECT doc_id AS subject_id, {before} || {aggregate.replace('FACTOR', factor)} || {behind} AS report FROM {{factors}} GROUP BY doc_id"


_SPARK_JOIN = "array_join(transform(array_sort(collect_list(struct(k, FACTOR AS body))), x -> x.body), '')"
_DUCK_JOIN = "string_agg(FACTOR, '' ORDER BY k)"
_RAW = ("'## [Prediction + Explanation]' || chr(10) || '##### five' || chr(10) || '### Predictive Factors' || chr(10)", "'# Reasoning Lens' || chr(10) || 'so' || chr(10)")
CLEAN_REPORT = _joined("'[Prediction + Explanation]' || chr(10) || '# five' || chr(10) || 'Predictive Factors' || chr(10)", CLEAN_FACTOR.replace("/ 3", "// 3"), "'Reasoning Lens' || chr(10) || 'so' || chr(10)", _DUCK_JOIN)

#: role -> (Spark SQL, other SQL or None); {x} is a table or role.
ROLES: dict[str, tuple[str, str | None]] = {
    "note_events": (
        """SELECT d.doc_id AS note_id, CAST(d.doc_id % 97 AS BIGINT) AS subject_id, d.source AS note_type,
             CAST(date_add(DATE '2020-01-01', CAST(d.doc_id AS INT)) AS TIMESTAMP) AS charttime, CAST(40 + d.doc_id % 50 AS INT) AS age,
             CAST(max(d.doc_id) OVER (PARTITION BY d.doc_id % 97) - d.doc_id AS INT) AS days, d.text AS text FROM {documents} d""",
        """SELECT d.doc_id AS note_id, CAST(d.doc_id % 97 AS BIGINT) AS subject_id, d.source AS note_type,
             CAST(DATE '2020-01-01' + CAST(d.doc_id AS INT) AS TIMESTAMP) AS charttime, CAST(40 + d.doc_id % 50 AS INT) AS age,
             CAST(max(d.doc_id) OVER (PARTITION BY d.doc_id % 97) - d.doc_id AS INT) AS days, d.text AS text FROM {documents} d""",
    ),
    "code_events": (
        """SELECT o.o_custkey AS subject_id, l.l_partkey AS code, CAST(9 + p.p_size % 2 AS INT) AS version, p.p_name AS title, o.o_orderdate AS charttime,
             CAST(datediff(max(o.o_orderdate) OVER (PARTITION BY o.o_custkey), o.o_orderdate) AS INT) AS days, (l.l_orderkey * 16 + l.l_linenumber) * 1000000 + l.l_partkey AS ord
           FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey""",
        """SELECT o.o_custkey AS subject_id, l.l_partkey AS code, CAST(9 + p.p_size % 2 AS INT) AS version, p.p_name AS title, o.o_orderdate AS charttime,
             CAST(date_diff('day', o.o_orderdate, max(o.o_orderdate) OVER (PARTITION BY o.o_custkey)) AS INT) AS days, (l.l_orderkey * 16 + l.l_linenumber) * 1000000 + l.l_partkey AS ord
           FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey""",
    ),
    "note_vectors": ("SELECT vec_id, vec_id % 50 AS subject_id, CAST(vec_id AS BIGINT) AS days, embedding AS vector, label FROM {embeddings}", None),
    "code_vectors": ("SELECT vec_id, (vec_id * 7 + 3) % 50 AS subject_id, CAST(vec_id AS BIGINT) AS days, embedding AS vector, label FROM {embeddings}", None),
    "query_vectors": ("SELECT CAST(vec_id AS INT) AS query_idx, CASE WHEN vec_id < 4 THEN 'Note' ELSE 'Code' END AS modality, embedding AS vector FROM {embeddings} WHERE vec_id < 8", None),
    "subject_labels": ("SELECT CAST(d.doc_id % 97 AS BIGINT) AS subject_id, max(l.quality) AS label FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id GROUP BY d.doc_id % 97", None),
    "predictions": (
        """SELECT l.doc_id AS subject_id, m.method AS method, l.quality AS label,
             CASE WHEN l.doc_id % 11 = 0 THEN NULL ELSE CAST(0.3 AS DOUBLE) * l.quality * (m.k % 3) / CAST(2.0 AS DOUBLE) + CAST(0.7 AS DOUBLE) * ((l.doc_id * 37 + d.n_chars * m.k) % 1000) / CAST(1000.0 AS DOUBLE) END AS probability,
             d.n_chars AS n_chars, d.n_chars > 2000 AS truncated
           FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id CROSS JOIN (SELECT 'm1' AS method, 1 AS k UNION ALL SELECT 'm2', 2 UNION ALL SELECT 'm3', 3) m""",
        None,
    ),
    "completions": (
        """SELECT conv_id, turn, CASE conv_id % 7
             WHEN 0 THEN concat('{"probability": ', p, ', "report": "r', CAST(conv_id AS STRING), '"}')
             WHEN 1 THEN concat('So: {"probability": "', p, '", "summary": "s \\\\"', CAST(turn AS STRING), '\\\\" }"} done')
             WHEN 2 THEN concat('{"probability": ', p, '}')
             WHEN 3 THEN concat('{"x": {"probability": 3}} {"probability": ', p, ', "report": "z"}')
             WHEN 4 THEN concat('Here: "Probability" : .', d, ' end ')
             WHEN 5 THEN concat('{"probability": 1.5, "text": "', d, '"')
             ELSE 'no answer' END AS completion FROM (
               SELECT conv_id, turn, CAST(CAST((conv_id * 7 + turn) % 10 AS INT) AS STRING) AS d, CAST(round(0.5 + CAST((conv_id * 7 + turn) % 10 AS INT) / CAST(20 AS DOUBLE), 2) AS STRING) AS p FROM {conversations} WHERE role = 'assistant') c""",
        """SELECT conv_id, turn, CASE conv_id % 7
             WHEN 0 THEN concat('{"probability": ', p, ', "report": "r', CAST(conv_id AS STRING), '"}')
             WHEN 1 THEN concat('So: {"probability": "', p, '", "summary": "s \\"', CAST(turn AS STRING), '\\" }"} done')
             WHEN 2 THEN concat('{"probability": ', p, '}')
             WHEN 3 THEN concat('{"x": {"probability": 3}} {"probability": ', p, ', "report": "z"}')
             WHEN 4 THEN concat('Here: "Probability" : .', d, ' end ')
             WHEN 5 THEN concat('{"probability": 1.5, "text": "', d, '"')
             ELSE 'no answer' END AS completion FROM (
               SELECT conv_id, turn, CAST(CAST((conv_id * 7 + turn) % 10 AS INT) AS STRING) AS d, CAST(round(0.5 + CAST((conv_id * 7 + turn) % 10 AS INT) / CAST(20 AS DOUBLE), 2) AS STRING) AS p FROM {conversations} WHERE role = 'assistant') c""",
    ),
    # Reports of four sections and three to five factors; every third quote is of another text, every fourth handle of another subject.
    "factor_rows": (
        """SELECT d.doc_id, CAST(f.k AS INT) AS k, CASE WHEN (d.doc_id + f.k) % 3 = 0 THEN substring(e.text, 1, 40) ELSE substring(d.text, 11, 40) END AS raw_quote,
             CASE WHEN (d.doc_id + f.k) % 4 = 0 THEN d.doc_id + 1 ELSE d.doc_id END AS handle
           FROM {documents} d CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) f
           LEFT JOIN {documents} e ON e.doc_id = d.doc_id + 7 WHERE f.k <= 3 + d.doc_id % 3""",
        None,
    ),
    "factors": (
        """SELECT doc_id, k, handle, regexp_replace(coalesce(raw_quote, ''), '["\\\\n]', ' ') AS quote, CASE WHEN (doc_id + 2 * k) % 7 = 0 THEN 'icd' ELSE 'note' END AS kind,
             CAST((doc_id * 13 + k * 7) % 200 AS STRING) || '-' || CAST(9 + k % 2 AS STRING) AS code FROM {factor_rows}""",
        """SELECT doc_id, k, handle, regexp_replace(coalesce(raw_quote, ''), '["\\n]', ' ', 'g') AS quote, CASE WHEN (doc_id + 2 * k) % 7 = 0 THEN 'icd' ELSE 'note' END AS kind,
             CAST((doc_id * 13 + k * 7) % 200 AS STRING) || '-' || CAST(9 + k % 2 AS STRING) AS code FROM {factor_rows}""",
    ),
    "reports": (_joined(_BEFORE, FACTOR, _BEHIND, _SPARK_JOIN), _joined(_BEFORE, FACTOR, _BEHIND, _DUCK_JOIN)),
    "raw_reports": (_joined(_RAW[0], RAW_FACTOR, _RAW[1], _SPARK_JOIN), _joined(_RAW[0], RAW_FACTOR, _RAW[1], _DUCK_JOIN)),
    # The notes that a subject's prompt kept: the latest seven of ten.
    "kept_notes": (
        """SELECT subject_id, note_id FROM (SELECT subject_id, note_id, row_number() OVER (PARTITION BY subject_id ORDER BY days, note_id) AS place, count(*) OVER (PARTITION BY subject_id) AS n FROM {note_events}) WHERE 10 * place <= 7 * n""",
        None,
    ),
    # What a citation may name: notes by id and codes by code and version, with their subjects and texts.
    "sources": (
        """SELECT 'note' AS kind, CAST(note_id AS STRING) AS id, subject_id, text FROM {note_events} UNION ALL
           SELECT 'icd', CAST(code AS STRING) || '-' || CAST(version AS STRING), subject_id % 97, title FROM {code_events}""",
        None,
    ),
    "typed_reports": (TYPED.replace("DASH", "'—'"), None),
    "rollouts": (
        """SELECT doc_id AS subject_id, CAST(c.idx AS INT) AS idx, CASE WHEN (doc_id + c.idx) % 5 = 0 THEN NULL ELSE CAST((doc_id * 3 + c.idx) % 7 AS INT) END AS n_flagged, CAST((doc_id * 17 + c.idx * 5) % 101 AS DOUBLE) AS sample_score
           FROM {labels} CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1 UNION ALL SELECT 2) c WHERE doc_id % 8 <> 7""",
        None,
    ),
    "verdicts": (
        """SELECT event_id, user_id AS subject_id, concat('b', CAST(CAST(user_id % 3 AS INT) AS STRING)) AS baseline, event_type AS trust,
             CAST(get_json_object(props, '$.k') AS INT) AS k, value FROM {events}""",
        """SELECT event_id, user_id AS subject_id, concat('b', CAST(CAST(user_id % 3 AS INT) AS VARCHAR)) AS baseline, event_type AS trust,
             CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM {events}""",
    ),
    "flag_tasks": ("SELECT event_id AS flag_id, user_id AS subject_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS type_a, CASE WHEN event_id % 3 = 0 THEN event_type END AS type_b FROM {events}", None),
    "flag_verdicts": (
        """SELECT event_id AS flag_id, CASE k % 3 WHEN 0 THEN 'agree' WHEN 1 THEN 'disagree' ELSE 'unsure' END AS agree, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 'minor' ELSE 'major' END AS severity
           FROM {verdicts} WHERE k <> 13""",
        None,
    ),
}

# For Spark alone, the same SQL over less: notes with empty texts (see USED), and the codes of labelled subjects (a subject's days are worked out from
# its own orders, so orders of others can go before the joins).
ROLES["note_heads"] = ROLES["note_events"]
ROLES["labelled_codes"] = (ROLES["code_events"][0].replace("{orders}", "(SELECT * FROM {orders} LEFT SEMI JOIN {subject_labels} ON o_custkey = subject_id)"), None)

#: role -> {table: all that the role's SQL uses of it}, where that is little of a long column: quotes are cut from the first
#: fifty characters of a text, so whole texts need not go through the role's joins, once for each factor; heads of notes need to know
#: whether there is a text, which then need not go through the role's window.
USED: dict[str, dict[str, list[str]]] = {
    "factor_rows": {"documents": ["doc_id", "substring(text, 1, 50) AS text"]},
    "note_heads": {"documents": ["doc_id", "source", "CASE WHEN text IS NOT NULL THEN '' END AS text"]},
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The role or table ``name`` as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return queried(spark, sf_dir, ROLES[name][0], USED.get(name, {}))


def queried(spark: SparkSession, sf_dir: str, text: str, used: dict[str, list[str]] | None = None) -> DataFrame:
    """Spark SQL ``text`` over the roles and tables that it names in braces; other braces are plain.  Of tables in ``used``, it gets these columns."""
    names = set(re.findall(r"\{([a-z_]+)\}", text))
    plain = re.sub(r"\{(?![a-z_]+\})", "{{", text)
    plain = re.sub(r"(?<![a-z_])\}", "}}", plain)
    inputs = {n: role(spark, sf_dir, n) for n in names}
    return spark.sql(plain, **{n: x.selectExpr(*used[n]) if used and n in used else x for n, x in inputs.items()})


def with_roles(text: str, names: list[str]) -> str:
    """``text`` after a WITH clause of the roles ``names`` and those they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done or name not in ROLES:
            return
        own = ROLES[name][1] or ROLES[name][0]
        for n in re.findall(r"\{([a-z_]+)\}", own):
            add(n)
        done[name] = re.sub(r"\{([a-z_]+)\}", r"\1", own)

    for n in names:
        add(n)
    if not done:
        return text
    ctes = ",\n".join(f"{n} AS ({t})" for n, t in done.items())
    body = text.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
