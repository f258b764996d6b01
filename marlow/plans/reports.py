"""Reports: completions parsed, factors and evidence extracted, citations checked, formats gated."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlow.functions import parsing as p
from marlow.operators import relational
from marlow.operators.ordering import settled, shared_folder
from marlow.plans import roles
from marlow.plans.catalog import frame, sql

_DIGIT = "CAST(CAST((conv_id * 7 + turn) % 10 AS INT) AS STRING)"


@frame(
    "parse_completion",
    f"""SELECT conv_id, turn, CASE WHEN k IN (0, 1, 2, 3) THEN round(0.5 + d / CAST(20 AS DOUBLE), 6) WHEN k = 4 THEN round(d / CAST(10 AS DOUBLE), 6) END AS probability,
         CASE k WHEN 0 THEN 'r' || CAST(conv_id AS STRING) WHEN 1 THEN 's "' || CAST(turn AS STRING) || '" }}' WHEN 2 THEN '' WHEN 3 THEN 'z' ELSE trim(completion) END AS report, k < 4 AS ok
       FROM (SELECT *, conv_id % 7 AS k, CAST(CAST((conv_id * 7 + turn) % 10 AS INT) AS DOUBLE) AS d FROM {{completions}})""",
    "completions",
)
def parse_completion(completions):
    """Strict JSON, JSON with a summary within a text, without a report, behind another object, a pattern, out of range, none."""
    return p.completions(completions, "completion").select("conv_id", "turn", F.round("probability", 6).alias("probability"), "report", "ok")


@frame(
    "verbalizer_report",
    """SELECT conv_id, turn, CASE WHEN k = 0 THEN 'r' || CAST(conv_id AS STRING) WHEN k = 1 THEN 's "' || CAST(turn AS STRING) || '" }' WHEN k = 3 THEN 'z' WHEN k = 2 THEN trim(completion) ELSE trim(completion) END AS report
       FROM (SELECT *, conv_id % 7 AS k FROM {completions})""",
    "completions",
)
def verbalizer_report(completions):
    """The report after a one-word answer."""
    told = completions.withColumn("told", F.concat(F.lit("Yes\n"), F.col("completion")))
    return p.answers(told, "told").select("conv_id", "turn", "report")


sql(
    "verbalizer_probability",
    """SELECT subject_id, method, round(CASE WHEN yes IS NULL AND no IS NULL THEN CAST(0.5 AS DOUBLE) WHEN no IS NULL THEN CAST(1.0 AS DOUBLE) WHEN yes IS NULL THEN CAST(0.0 AS DOUBLE) ELSE 1 / (1 + exp(no - yes)) END, 6) AS p FROM (
         SELECT subject_id, method, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE probability * -3 END AS yes, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE probability * -2 - 1 END AS no FROM {predictions})""",
)
sql("verbalizer_tokens", "SELECT method, label, CASE method WHEN 'm1' THEN CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END WHEN 'm2' THEN CASE WHEN label = 1 THEN '+' ELSE '-' END ELSE CASE WHEN label = 1 THEN '<r1>' ELSE '<r0>' END END AS token, count(*) AS n FROM {predictions} GROUP BY method, label")


_ROLLED = """SELECT subject_id, idx, HASH32[['Subject ' || CAST(subject_id AS STRING) || '|' || CAST(seed AS STRING)]] AS h FROM (
    SELECT p.subject_id, r.idx, HASH32[['42|' || CAST(p.subject_id AS STRING) || '|' || CAST(r.idx AS STRING)]] AS seed FROM {predictions} p CROSS JOIN unnest(range(0, 3)) r(idx) WHERE p.method = 'm1')"""
_LOGS = f"SELECT *, CASE WHEN h % 11 > 0 THEN -(h % 1000) / CAST(250 AS DOUBLE) END AS yes, CASE WHEN h % 13 > 0 THEN -((h // 1000) % 1000) / CAST(250 AS DOUBLE) END AS no FROM ({_ROLLED})"


@frame(
    "rollout_answers",
    f"""SELECT subject_id, CAST(idx AS INT) AS rollout_idx, round(yes, 6) AS logp_yes, round(no, 6) AS logp_no, round(CASE WHEN yes IS NULL AND no IS NULL THEN 0.5 WHEN no IS NULL THEN 1.0 WHEN yes IS NULL THEN 0.0 ELSE 1 / (1 + exp(no - yes)) END, 6) AS probability,
          CASE WHEN yes IS NULL AND no IS NULL THEN 'Maybe' WHEN no IS NULL OR yes >= no THEN 'Yes' ELSE 'No' END AS generated_token, 'r' || CAST(h % 100 AS STRING) AS report FROM ({_LOGS})""",
    "predictions",
)
def rollout_answers(predictions):
    """Three seeded rollouts of a prompt for each subject, from the call (of a stand-in model) through its first tokens' log probabilities to the probability
    and the report behind the answer."""
    from marlow.operators import external

    asked = predictions.where("method = 'm1'").select("subject_id", F.concat(F.lit("Subject "), F.col("subject_id").cast("string")).alias("prompt"))
    got = p.answers(external.rollouts(asked, external.stub_rollout, 3), "completion")
    x = external.answer_probability(F.col("first"), F.col("completion"))
    return got.select("subject_id", "rollout_idx", *[F.round(x[c], 6).alias(c) for c in ("logp_yes", "logp_no", "probability")], x["generated_token"].alias("generated_token"), "report")


def factor_rows(reports):
    """(subject_id, k, factor): the numbered factors of each report."""
    return reports.select("subject_id", F.explode(p.factors(F.col("report"))).alias("factor")).select("subject_id", p.factor_number(F.col("factor")).alias("k"), "factor")


def evidence(reports):
    e = factor_rows(reports).withColumn("evidence", p.evidence_line(F.col("factor")))
    kind, handle = p.citation(F.col("evidence"))
    return e.select("subject_id", "k", "evidence", p.longest_quote(F.col("evidence")).alias("quote"), kind.alias("kind"), handle.alias("handle"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BODY = f"trim({roles.FACTOR}, {_BLANK})"
#: What the pieces of a report say of its evidence, as parsing them back should.
PARSED = f"""SELECT doc_id, k, CASE WHEN {roles.LABELLED} THEN trim({roles.EVIDENCE}, {_BLANK}) ELSE {_BODY} END AS evidence,
    CASE WHEN length(quote) >= 3 THEN nullif(trim(quote, '"''`“”‘’ ' || chr(9)), '') END AS quote, kind, CASE WHEN kind = 'icd' THEN code ELSE CAST(handle AS STRING) END AS handle FROM {{factors}}"""


@frame("extract_factors", f"SELECT doc_id AS subject_id, k, md5({_BODY}) AS digest FROM {{factors}}", "reports")
def extract_factors(reports):
    return factor_rows(reports).select("subject_id", "k", F.md5(p.stripped(F.col("factor")).cast("binary")).alias("digest"))


@frame("evidence_line", f"SELECT doc_id AS subject_id, k, evidence FROM ({PARSED})", "reports")
def evidence_line(reports):
    return evidence(reports).select("subject_id", "k", "evidence")


@frame("parse_evidence", f"SELECT doc_id AS subject_id, k, quote, kind, handle FROM ({PARSED})", "reports")
def parse_evidence(reports):
    return evidence(reports).select("subject_id", "k", "quote", "kind", "handle")


@frame("asserted_evidence", "SELECT doc_id AS subject_id, k, md5(quote || ' ' || 'x') AS digest FROM {factors}", "factors")
def asserted_evidence(factors):
    """Evidence lines without their citation and quotation marks."""
    line = F.concat(F.lit('"'), F.col("quote"), F.lit('"(note_id: '), F.col("handle").cast("string"), F.lit(")x"))
    return factors.select(F.col("doc_id").alias("subject_id"), "k", F.md5(p.asserted(line).cast("binary")).alias("digest"))


_FLAT = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
CITED = f"""SELECT e.doc_id AS subject_id, e.k, e.kind, bool_or(s.id IS NOT NULL) AS in_corpus, bool_or(coalesce(s.subject_id = e.doc_id % 97, FALSE)) AS owned, max(CASE WHEN t.note_id IS NULL THEN 0 ELSE 1 END) = 1 AS was_kept,
         bool_or(coalesce(contains({_FLAT.format('s.text')}, {_FLAT.format('e.quote')}), FALSE)) AS found
       FROM ({PARSED}) e LEFT JOIN {{sources}} s ON s.kind = e.kind AND s.id = e.handle LEFT JOIN {{kept_notes}} t ON e.kind = 'note' AND CAST(t.note_id AS STRING) = e.handle AND t.subject_id = e.doc_id % 97 GROUP BY e.doc_id, e.k, e.kind"""


def checked(reports, sources, kept):
    """Each factor's citation and quote, parsed from the reports: whether the source exists, belongs to the subject, was shown,
    and holds the quote.  A source that is cited is normalised once, and only then meets its quotes; sources of one id (a code that
    several subjects have) are one row with the set of its subjects."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    e = settled(evidence(reports).select("subject_id", "k", "kind", "handle", flat(F.col("quote")).alias("quote")))  # parsed once, used twice
    cited = e.where("kind IS NOT NULL").select("kind", F.col("handle").alias("id")).distinct()
    src = sources.join(cited, ["kind", "id"], "left_semi").groupBy("kind", "id").agg(F.collect_set("subject_id").alias("owners"), flat(F.max("text")).alias("text"))
    shown = kept.select(F.lit("note").alias("kind"), F.col("note_id").cast("string").alias("id"), F.col("subject_id").alias("shown_to")).distinct()
    both = e.join(src.withColumnRenamed("id", "handle"), ["kind", "handle"], "left").join(shown.withColumnRenamed("id", "handle"), ["kind", "handle"], "left")
    person = F.col("subject_id") % 97
    return both.select(
        "subject_id",
        "k",
        "kind",
        F.col("owners").isNotNull().alias("in_corpus"),
        F.coalesce(F.array_contains("owners", person), F.lit(False)).alias("owned"),
        F.coalesce(F.col("shown_to") == person, F.lit(False)).alias("was_kept"),
        F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False)).alias("found"),
    )


@frame("citation_validity", CITED, "reports", "sources", "kept_notes")
def citation_validity(reports, sources, kept):
    return checked(reports, sources, kept)


@frame("quote_containment", f"SELECT owned, count(*) AS n, count(*) FILTER (WHERE found) AS n_found FROM ({CITED}) GROUP BY owned", "reports", "sources", "kept_notes")
def quote_containment(reports, sources, kept):
    return checked(reports, sources, kept).groupBy("owned").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("n_found"))


@frame(
    "faithfulness_summary",
    f"""SELECT CAST(subject_id % 3 AS BIGINT) AS baseline, count(*) AS n, count(*) FILTER (WHERE in_corpus) AS n_corpus, count(*) FILTER (WHERE owned) AS n_owned, count(*) FILTER (WHERE owned AND found) AS n_faithful,
        round(100 * count(*) FILTER (WHERE owned AND found) / CAST(count(*) AS DOUBLE), 2) AS pct FROM ({CITED}) GROUP BY subject_id % 3""",
    "reports",
    "sources",
    "kept_notes",
)
def faithfulness_summary(reports, sources, kept):
    good = F.col("owned") & F.col("found")
    g = checked(reports, sources, kept).groupBy((F.col("subject_id") % 3).alias("baseline"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if("in_corpus").alias("n_corpus"), F.count_if("owned").alias("n_owned"), F.count_if(good).alias("n_faithful"), F.round(100 * F.count_if(good) / F.count(F.lit(1)), 2).alias("pct"))


@frame("record_fully_faithful", f"SELECT subject_id, count(*) AS n, count(*) = 5 AND count(*) FILTER (WHERE owned AND found) = 5 AS fully FROM ({CITED}) GROUP BY subject_id", "reports", "sources", "kept_notes")
def record_fully_faithful(reports, sources, kept):
    n, good = F.count(F.lit(1)), F.count_if(F.col("owned") & F.col("found"))
    return checked(reports, sources, kept).groupBy("subject_id").agg(n.alias("n"), ((n == 5) & (good == 5)).alias("fully"))


@frame(
    "handle_validity",
    f"""SELECT subject_id AS doc_id, k, kind, in_corpus AS source_found, owned, kind = 'note' AND owned AND NOT was_kept AND subject_id % 97 IN (SELECT subject_id FROM {{kept_notes}}) AS cited_dropped FROM ({CITED})""",
    "reports",
    "sources",
    "kept_notes",
)
def handle_validity(reports, sources, kept):
    """Parsed handles against all sources, the subject's own, and those that its prompt kept; where it kept none, none counts as dropped."""
    known = kept.select(F.col("subject_id").alias("person")).distinct().withColumn("has_list", F.lit(True))
    c = checked(reports, sources, kept).join(known, F.col("subject_id") % 97 == F.col("person"), "left")
    dropped = (F.col("kind") == "note") & F.col("owned") & ~F.col("was_kept") & F.col("has_list").isNotNull()
    return c.select(F.col("subject_id").alias("doc_id"), "k", "kind", F.col("in_corpus").alias("source_found"), "owned", dropped.alias("cited_dropped"))


@frame("clean_report", f"SELECT subject_id, md5(report) AS digest FROM ({roles.CLEAN_REPORT})", "raw_reports")
def clean_report(reports):
    """Headings, labels and numbers as the parsers want them."""
    return p.clean(reports).select("subject_id", F.md5(F.col("report").cast("binary")).alias("digest"))


@frame("validate_report", "SELECT subject_id, length(report) > 500 AND subject_id % 10 <> 9 AS ok FROM {reports}", "reports")
def validate_report(reports):
    return reports.select("subject_id", p.valid(F.col("report")).alias("ok"))


@frame(
    "section_spans",
    f"""SELECT subject_id, s.name, CAST(s.a AS BIGINT) AS start, CAST(s.b AS BIGINT) AS stop FROM (SELECT subject_id, unnest([{', '.join(f"{{'name': '{n}', 'a': p{k}, 'b': {f'p{k + 1}' if k < 3 else 'length(report)'}}}" for k, n in enumerate(p.SECTIONS))}]) AS s
         FROM (SELECT *, {', '.join(f"strpos(report, '{n}') - 1 AS p{k}" for k, n in enumerate(p.SECTIONS))} FROM {{typed_reports}}) WHERE p0 >= 0 AND p0 <= p1 AND p1 <= p2 AND p2 <= p3)""",
    "typed_reports",
)
def section_spans(reports):
    """Where each section of a typed report begins and ends, for reports that have all four in order."""
    return reports.select("subject_id", F.explode(p.section_spans(F.col("report"))).alias("s")).select("subject_id", "s.*")


_ORDER = "wrong_factor_count_or_order:"


@frame(
    "format_issues",
    f"""SELECT subject_id, CASE v WHEN 2 THEN 'missing_section:{p.SECTIONS[2]}' WHEN 3 THEN 'section_out_of_order:{p.SECTIONS[3]}' WHEN 4 THEN 'factor_numbering:1,2,3,4' WHEN 5 THEN 'factor_numbering:1,2,3,5,4'
         WHEN 6 THEN 'factor2:no_quoted_evidence' WHEN 11 THEN 'factor3:missing_reasoning' WHEN 12 THEN 'factor4:no_note_id' WHEN 13 THEN 'section_out_of_order:{p.SECTIONS[2]}' ELSE '' END AS issues, v NOT IN (2, 3, 4, 5, 6, 11, 12, 13) AS passed FROM {{typed_reports}}""",
    "typed_reports",
)
def format_issues(reports):
    issues = p.factor_issues(F.col("report"))
    return reports.select("subject_id", F.array_join(issues, ";").alias("issues"), (F.size(issues) == 0).alias("passed"))


def _found(pattern: str) -> str:
    return f"len(regexp_extract_all(report, '{pattern}'))"


_E, _R, _A = (_found(x) for x in (p.EVIDENCE_LINE, p.REASONING_LINE, p.ATTRIBUTION_LINE))
_N = f"array_to_string(regexp_extract_all(report, '{p.FACTOR_LINE}', 1), ',')"
_POS = ", ".join(f"strpos(report, '{x}') AS s{k}" for k, x in enumerate(p.SECTIONS))
# The sections of the role miss only from the third on, and move together.
_ANATOMY = f"""CASE WHEN s2 = 0 THEN 'missing_section:{p.SECTIONS[2]};out_of_order_section:{p.SECTIONS[3]};' WHEN s2 < s1 THEN 'out_of_order_section:{p.SECTIONS[2]};out_of_order_section:{p.SECTIONS[3]};' WHEN s3 < s2 THEN 'out_of_order_section:{p.SECTIONS[3]};' ELSE '' END || CASE WHEN {_N} <> '1,2,3,4,5' THEN '{_ORDER}' || {_N} || ';' ELSE '' END
  || CASE WHEN {_E} < 5 THEN 'too_few_supporting_evidence:' || {_E} || ';' ELSE '' END || CASE WHEN {_R} < 5 THEN 'too_few_reasoning:' || {_R} || ';' ELSE '' END"""
_ATTRIBUTED = f"CASE WHEN {_A} < 5 THEN 'too_few_attribution:' || {_A} || ';' ELSE '' END"
TYPED_CHECK = rf"""SELECT subject_id, CASE WHEN regexp_extract(report, 'Patient (\d+)', 1) <> CAST(subject_id AS STRING) THEN 'missing_patient_header;' ELSE '' END || CASE WHEN contains(report, 'Mortality prediction: high') THEN 'missing_mortality_line;' ELSE '' END
    || {_ANATOMY} || {_ATTRIBUTED} || CASE WHEN contains(report, 'Verification: 6/5') THEN 'verification_passed_gt_total;' ELSE '' END || CASE WHEN contains(report, 'Factor 9') THEN 'flagged_factor_out_of_range:9;' ELSE '' END
    || CASE WHEN NOT rtrim(report, chr(10)) LIKE '%====' THEN 'missing_closing_separator;' ELSE '' END AS failures, {_found(p.FLAG_LINE)} AS n_flags, CAST(regexp_extract(report, '{p.VERIFIED_LINE}', 1) AS INT) AS verified, {_found(p.FLAGGED_LINE)} AS n_flagged
  FROM (SELECT *, {_POS} FROM {{typed_reports}})"""


def typed_checked(reports):
    r = F.col("report")
    return reports.select(
        "subject_id",
        p.typed_issues(F.col("subject_id"), r).alias("issues"),
        F.regexp_count(r, F.lit(p.FLAG_LINE)).cast("long").alias("n_flags"),
        F.regexp_extract(r, p.VERIFIED_LINE, 1).try_cast("int").alias("verified"),
        F.regexp_count(r, F.lit(p.FLAGGED_LINE)).cast("long").alias("n_flagged"),
    )


@frame("typed_format_check", f"SELECT subject_id, rtrim(failures, ';') AS failures, failures = '' AS passed, n_flags, verified, n_flagged FROM ({TYPED_CHECK})", "typed_reports")
def typed_format_check(reports):
    return typed_checked(reports).select("subject_id", F.array_join("issues", ";").alias("failures"), (F.size("issues") == 0).alias("passed"), "n_flags", "verified", "n_flagged")


@frame("failure_histogram", f"SELECT split_part(f, ':', 1) AS bucket, count(*) AS n FROM (SELECT unnest(string_split(rtrim(failures, ';'), ';')) AS f FROM ({TYPED_CHECK})) WHERE f <> '' GROUP BY split_part(f, ':', 1)", "typed_reports")
def failure_histogram(reports):
    f = typed_checked(reports).select(F.explode("issues").alias("f"))
    return f.groupBy(F.substring_index("f", ":", 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "bucket")


@frame("review_format_check", f"SELECT subject_id, rtrim({_ANATOMY} || {_ATTRIBUTED}, ';') AS failures, rtrim({_ANATOMY}, ';') AS failures_without_attribution FROM (SELECT *, {_POS} FROM {{typed_reports}})", "typed_reports")
def review_format_check(reports):
    """Sections and factors only; attribution lines are asked for by one of the two checks."""
    both = [F.array_join(p.listed(p.anatomy_issues(F.col("report"), a)), ";") for a in (True, False)]
    return reports.select("subject_id", both[0].alias("failures"), both[1].alias("failures_without_attribution"))


FIRST = "SELECT subject_id, n_flagged FROM {rollouts} WHERE idx = 0 AND n_flagged IS NOT NULL"


@frame(
    "first_candidate_flags",
    f"""SELECT t.subject_id, f.n_flagged, t.v NOT IN (2, 3, 4, 5, 6, 11, 12, 13) AS format_pass, coalesce(t.v NOT IN (2, 3, 4, 5, 6, 11, 12, 13) AND f.n_flagged <= 2, FALSE) AS gated FROM {{typed_reports}} t LEFT JOIN ({FIRST}) f ON f.subject_id = t.subject_id""",
    "typed_reports",
    "rollouts",
)
def first_candidate_flags(reports, rollouts):
    """Flags of the first candidate only, and the gate: a good format and a known, small number of flags."""
    first = rollouts.where("idx = 0 AND n_flagged IS NOT NULL").select("subject_id", "n_flagged")
    good = format_issues(reports).select("subject_id", F.col("passed").alias("format_pass"))
    return good.join(first, "subject_id", "left").select("subject_id", "n_flagged", "format_pass", F.coalesce(F.col("format_pass") & (F.col("n_flagged") <= 2), F.lit(False)).alias("gated"))


@frame(
    "judged_formats",
    """SELECT t.subject_id, t.v NOT IN (2, 3, 4, 5, 6, 11, 12, 13) AS passed FROM {typed_reports} t WHERE EXISTS (SELECT 1 FROM {verdicts} v WHERE v.subject_id = t.subject_id AND lower(trim(v.trust)) = 'purchase')""",
    "typed_reports",
    "verdicts",
)
def judged_formats(reports, verdicts):
    """Format results of the subjects that a judge saw and trusted."""
    trusted = verdicts.where(F.lower(F.trim("trust")) == "purchase").select("subject_id")
    return format_issues(reports).join(trusted, "subject_id", "left_semi").select("subject_id", "passed")


@frame(
    "review_records",
    """SELECT t.subject_id, s.method, md5(t.report) AS digest, round(s.probability, 6) AS probability, length(t.report) AS n_chars FROM {typed_reports} t JOIN (SELECT DISTINCT subject_id FROM {rollouts} WHERE idx = 0 AND n_flagged <= 2) r ON r.subject_id = t.subject_id
       LEFT JOIN (SELECT subject_id, method, probability FROM {predictions}) s ON s.subject_id = t.subject_id WHERE t.v NOT IN (2, 3, 4, 5, 6, 11, 12, 13)""",
    "typed_reports",
    "rollouts",
    "predictions",
)
def review_records(reports, rollouts, predictions):
    """Reports that pass both gates with each method's probability, in the order of subjects."""
    good = first_candidate_flags(reports, rollouts).where("gated").select("subject_id")
    scores = predictions.select("subject_id", "method", F.round("probability", 6).alias("probability"))
    kept = reports.join(good, "subject_id", "left_semi").join(scores, "subject_id", "left")
    return kept.select("subject_id", "method", F.md5(F.col("report").cast("binary")).alias("digest"), "probability", F.length("report").cast("long").alias("n_chars")).orderBy("subject_id", "method")


@frame(
    "review_completeness",
    """SELECT count(*) AS n, count(*) FILTER (WHERE r.subject_id IS NULL) AS without_rollouts, count(*) FILTER (WHERE l.subject_id IS NULL) AS without_scores FROM {typed_reports} t
       LEFT JOIN (SELECT DISTINCT subject_id FROM {rollouts}) r ON r.subject_id = t.subject_id LEFT JOIN (SELECT DISTINCT subject_id FROM {predictions}) l ON l.subject_id = t.subject_id""",
    "typed_reports",
    "rollouts",
    "predictions",
)
def review_completeness(reports, rollouts, predictions):
    """How many subjects of a review set miss in the other two; an export is refused unless both are 0 (:func:`relational.complete`)."""
    return relational.missing(reports, "subject_id", without_rollouts=rollouts, without_scores=predictions)


@frame(
    "holistic_report",
    """SELECT p.subject_id, p.method, md5('# Holistic report, whole history' || chr(10) || '# subject_id: ' || CAST(p.subject_id AS STRING) || '    label: ' || CAST(p.label AS STRING) || '    probability: ' || CASE WHEN p.probability IS NULL THEN 'None' ELSE printf('%.4f', p.probability) END || chr(10) || chr(10) || rtrim(t.report, chr(10)) || chr(10)) AS digest
       FROM {predictions} p JOIN {typed_reports} t ON t.subject_id = p.subject_id""",
    "predictions",
    "typed_reports",
)
def holistic_report(predictions, reports):
    """A report under a header with subject, label and probability."""
    p_ = F.when(F.col("probability").isNull(), "None").otherwise(F.format_string("%.4f", "probability"))
    head = F.concat(F.lit("# Holistic report, whole history\n# subject_id: "), F.col("subject_id").cast("string"), F.lit("    label: "), F.col("label").cast("string"), F.lit("    probability: "), p_, F.lit("\n\n"))
    rows = predictions.join(reports.select("subject_id", "report"), "subject_id")
    return rows.select("subject_id", "method", F.md5(F.concat(head, F.regexp_replace("report", r"\n+\z", ""), F.lit("\n")).cast("binary")).alias("digest"))


@frame("split_patient_blocks", rf"SELECT regexp_extract(report, 'Patient (\d+)', 1) AS subject_id, md5(rtrim(report, {_BLANK}) || chr(10)) AS digest FROM {{typed_reports}}", "typed_reports")
def split_patient_blocks(reports):
    """Typed reports, written one after the other into few text files and read back as single reports by byte ranges."""
    import uuid

    from marlow.sources.reports import read_reports

    spark = reports.sparkSession
    path = f"{shared_folder(spark)}/marlow/{uuid.uuid4().hex}"
    reports.repartitionByRange(2, "subject_id").sortWithinPartitions("subject_id").select("report").write.text(path)
    blocks = read_reports(spark, path, split=1 << 18)
    out = settled(blocks.select("subject_id", F.md5(F.col("block").cast("binary")).alias("digest")))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    return out


ITEMS = "SELECT doc_id AS subject_id, k, handle, quote, ((doc_id * 31 + k * 17) % 21 - 10) / CAST(10 AS DOUBLE) AS attribution FROM {factors}"


def items(factors):
    a = ((F.col("doc_id") * 31 + F.col("k") * 17) % 21 - 10) / F.lit(10.0)
    return factors.select(F.col("doc_id").alias("subject_id"), "k", "handle", "quote", a.alias("attribution"))


def top_items(rows):
    """``rows`` with ``place`` by the size of their attribution in each subject; a missing one counts as 0."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("subject_id").orderBy(F.abs(F.coalesce("attribution", F.lit(0.0))).desc(), "k")
    return rows.withColumn("place", F.row_number().over(w))


@frame("top_evidence", f"SELECT subject_id, k, attribution, CAST(rn AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY abs(attribution) DESC, k) AS rn FROM ({ITEMS})) WHERE rn <= 3", "factors")
def top_evidence(factors):
    return top_items(items(factors)).where("place <= 3").select("subject_id", "k", "attribution", "place")


@frame("evidence_prompt", f"SELECT subject_id, string_agg('[' || CAST(k AS STRING) || '] ' || printf('%+.4f', attribution) || ' ' || quote, chr(10) ORDER BY k) AS prompt FROM ({ITEMS}) GROUP BY subject_id", "factors")
def evidence_prompt(factors):
    line = F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] "), F.format_string("%+.4f", "attribution"), F.lit(" "), F.col("quote"))
    g = items(factors).groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("x"))
    return g.select("subject_id", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("prompt"))


_TOP = f"SELECT i.*, row_number() OVER (PARTITION BY subject_id ORDER BY abs(attribution) DESC, k) AS place FROM ({ITEMS}) i"


@frame(
    "raw_evidence_card",
    rf"""SELECT t.subject_id, s.method, repeat('=', 72) || chr(10) || 'RAW EVIDENCE: subject ' || CAST(t.subject_id AS STRING) || chr(10) || repeat('=', 72) || chr(10) || 'Predicted probability: ' || printf('%.4f', max(s.probability)) || chr(10) || chr(10)
          || string_agg(CAST(place AS STRING) || '. "' || trim(regexp_replace(quote, '\s+', ' ', 'g')) || '"' || chr(10) || '   Citation: ' || CASE WHEN k % 2 = 0 THEN '(ICD code: ' WHEN k = 5 THEN '(note_id: unknown' ELSE '(note_id: ' END || CASE WHEN k = 5 THEN '' ELSE CAST(handle AS STRING) END || ')' || chr(10)
            || '   Attribution score: ' || printf('%+.4f', attribution) || chr(10), chr(10) ORDER BY place) || chr(10) || repeat('=', 72) || chr(10) AS card
        FROM ({_TOP}) t JOIN (SELECT subject_id, method, probability FROM {{predictions}} WHERE probability IS NOT NULL) s ON s.subject_id = t.subject_id WHERE place <= 4 GROUP BY t.subject_id, s.method""",
    "factors",
    "predictions",
)
def raw_evidence_card(factors, predictions):
    """A card of the four items with the largest attribution, without any reasoning: quote, citation (unknown where there is no
    handle) and score."""
    scores = predictions.where("probability IS NOT NULL").select("subject_id", "method", "probability")
    handle = F.when(F.col("k") != 5, F.col("handle").cast("string"))
    top = top_items(items(factors).withColumn("handle", handle)).where("place <= 4")
    cited = F.concat(F.when(F.col("k") % 2 == 0, "(ICD code: ").otherwise("(note_id: "), F.coalesce("handle", F.lit("unknown")), F.lit(")"))
    text = F.trim(F.regexp_replace("quote", r"\s+", " "))
    line = F.concat(F.col("place").cast("string"), F.lit('. "'), text, F.lit('"\n   Citation: '), cited, F.lit("\n   Attribution score: "), F.format_string("%+.4f", "attribution"), F.lit("\n"))
    g = top.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("x")).join(scores, "subject_id")
    head = F.concat(F.lit(f"{p.RULE}\nRAW EVIDENCE: subject "), F.col("subject_id").cast("string"), F.lit(f"\n{p.RULE}\nPredicted probability: "), F.format_string("%.4f", "probability"), F.lit("\n\n"))
    return g.select("subject_id", "method", F.concat(head, F.array_join(F.transform("x", lambda e: e["line"]), "\n"), F.lit(f"\n{p.RULE}\n")).alias("card"))


@frame("collect_note_ids", "SELECT doc_id AS subject_id, string_agg(CAST(handle AS STRING), ',' ORDER BY k) AS note_ids FROM (SELECT doc_id, handle, min(k) AS k FROM {factors} GROUP BY doc_id, handle) GROUP BY doc_id", "factors")
def collect_note_ids(factors):
    g = factors.groupBy(F.col("doc_id").alias("subject_id")).agg(F.array_sort(F.collect_list(F.struct("k", "handle"))).alias("x"))
    return g.select("subject_id", F.array_join(F.array_distinct(F.transform("x", lambda e: e["handle"].cast("string"))), ",").alias("note_ids"))


@frame("explanation_items", f"SELECT subject_id, count(*) AS n_items, round(sum(attribution), 6) AS total, string_agg(CAST(handle AS STRING), ',' ORDER BY k) AS handles FROM ({ITEMS}) WHERE k % 2 = 1 GROUP BY subject_id", "factors")
def explanation_items(factors):
    g = items(factors).where("k % 2 = 1").groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("k", "handle"))).alias("x"), F.round(F.sum("attribution"), 6).alias("total"))
    return g.select("subject_id", F.size("x").cast("long").alias("n_items"), "total", F.array_join(F.transform("x", lambda e: e["handle"].cast("string")), ",").alias("handles"))


@frame("normalize_text", "SELECT note_id, md5(lower(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')))) AS digest FROM {note_events}", "note_events")
def normalize_text(notes):
    return notes.select("note_id", F.md5(p.normalized("text").cast("binary")).alias("digest"))


@frame("fuzzy_quotes", None, "reports", "note_events")
def fuzzy_quotes(reports, notes):
    """Partial ratio of each quote with its source, at three thresholds; quotes found as
    they are score 100 and never reach Python."""
    e = evidence(reports).where("kind = 'note'").withColumn("note_id", F.col("handle").try_cast("long")).where("length(quote) >= 3").join(notes.where("text IS NOT NULL").select("note_id", "text"), "note_id")
    e = e.withColumn("found", F.col("text").contains(F.col("quote")))
    asked = [F.when(~F.col("found"), F.col(c)) for c in ("quote", "text")]
    s = e.select("subject_id", "k", "found", p.fuzzy(*asked).alias("ratio")).withColumn("score", F.when(F.col("found"), 100.0).otherwise(F.col("ratio")))
    return s.select("subject_id", "k", F.round("score", 4).alias("score"), *[(F.col("score") >= t).alias(f"at_{t}") for t in (85, 90, 95)])


@frame("unwrap_reports", None, "completions")
def unwrap_reports(completions):
    return completions.select("conv_id", "turn", p.unwrapped("completion").alias("report"))


@frame("renumber_factors", None, "reports")
def renumber_factors(reports):
    bare = F.regexp_replace("report", r"(?m)^[2-9]\d*\. (?=Factor summary)", "")
    return reports.select("subject_id", p.renumbered(bare).alias("report"))
