"""Text preparation: chunks, prefixes, token estimates, records, truncation to a budget."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlow.functions import prompts
from marlow.functions import text as t
from marlow.plans.catalog import frame, sql

LENGTH, OVERLAP = 200, 40
STEP = LENGTH - OVERLAP
W = "CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN [] ELSE string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') END"
CHUNKS = f"""WITH w AS (SELECT note_id, age, text, {W} AS w FROM {{note_events}}), n AS (SELECT *, CASE WHEN len(w) <= {LENGTH} THEN 0 ELSE CAST(ceil((len(w) - {LENGTH}) / {STEP}.0) AS BIGINT) END AS last FROM w),
  c AS (SELECT note_id, age, i AS chunk_no, CASE WHEN len(w) <= {LENGTH} THEN text ELSE array_to_string(w[i * {STEP} + 1 : i * {STEP} + {LENGTH}], ' ') END AS chunk FROM n, unnest(range(0, last + 1)) r(i))"""


def chunked(notes):
    return notes.select("note_id", "age", F.posexplode(t.chunks(F.col("text"), LENGTH, OVERLAP)).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@frame("chunk_documents", f"{CHUNKS} SELECT note_id, chunk_no, chunk FROM c", "note_events")
def chunk_documents(notes):
    return chunked(notes).select("note_id", "chunk_no", "chunk")


@frame("prefixed_chunks", f"{CHUNKS} SELECT note_id, chunk_no, md5('Patient age: ' || CAST(age AS STRING) || ' years' || chr(10) || ' ' || chr(10) || ' Clinical Note:' || chr(10) || chunk) AS digest FROM c", "note_events")
def prefixed_chunks(notes):
    return chunked(notes).select("note_id", "chunk_no", F.md5(t.age_prefix(F.col("age"), F.col("chunk")).cast("binary")).alias("digest"))


@frame("strip_chunk_prefix", f"{CHUNKS} SELECT note_id, chunk_no, md5(ltrim(chunk, ' ')) AS digest FROM c", "note_events")
def strip_chunk_prefix(notes):
    c = chunked(notes)
    return c.select("note_id", "chunk_no", F.md5(t.without_age_prefix(t.age_prefix(F.col("age"), F.col("chunk"))).cast("binary")).alias("digest"))


@frame("approx_tokens", f"SELECT note_id, len({W}) * 13 // 10 AS tokens FROM {{note_events}}", "note_events")
def approx_tokens(notes):
    return notes.select("note_id", t.approx_tokens(F.col("text")).alias("tokens"))


NOTE_LINE = "'[Note ' || CAST(i AS STRING) || '] ' || coalesce(note_type, '') || ' at age ' || CAST(age AS STRING) || ', ' || CAST(days AS STRING) || ' days' || chr(10) || text"
RECORDS = f"""n AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY charttime, note_id) AS i FROM {{note_events}}),
  nn AS (SELECT subject_id, count(*) AS num_notes, string_agg({NOTE_LINE}, chr(10) ORDER BY i) AS body FROM n GROUP BY subject_id),
  cd AS (SELECT *, row_number() OVER (PARTITION BY subject_id, code, version ORDER BY days DESC, ord) AS rn FROM {{code_events}}),
  cc AS (SELECT subject_id, count(*) AS num_codes, string_agg(title || ' (' || CAST(code AS STRING) || '-' || CAST(version AS STRING) || ')', chr(10) ORDER BY days DESC, ord) AS body FROM cd WHERE rn = 1 GROUP BY subject_id),
  rec AS (SELECT s.subject_id, s.label, coalesce(nn.num_notes, 0) AS num_notes, coalesce(cc.num_codes, 0) AS num_codes,
    'Clinical notes (N=' || CAST(coalesce(nn.num_notes, 0) AS STRING) || ')' || chr(10) || coalesce(nn.body, '') || chr(10) || chr(10) || 'Codes (N=' || CAST(coalesce(cc.num_codes, 0) AS STRING) || ')' || chr(10) || coalesce(cc.body, '') AS text
    FROM {{subject_labels}} s LEFT JOIN nn ON nn.subject_id = s.subject_id LEFT JOIN cc ON cc.subject_id = s.subject_id)"""


def note_line():
    """A note with its kind, age and days, without its number."""
    return F.concat(F.coalesce("note_type", F.lit("")), F.lit(" at age "), F.col("age").cast("string"), F.lit(", "), F.col("days").cast("string"), F.lit(" days\n"), F.col("text"))


def code_lists(codes):
    """(subject_id, code_words, num_codes, codes): each code of a subject once, a line each, the latest first."""
    first = codes.groupBy("subject_id", "code", "version").agg(F.max_by(F.struct("days", "title", "ord"), F.struct("days", -F.col("ord"))).alias("c"))
    title = t.word_count(F.concat(F.col("c.title"), F.lit(" (x)")))
    c = first.groupBy("subject_id").agg(F.sum(title).alias("code_words"), F.array_sort(F.collect_list(F.struct((-F.col("c.days")).alias("a"), F.col("c.ord").alias("b"), F.concat(F.col("c.title"), F.lit(" ("), F.col("code").cast("string"), F.lit("-"), F.col("version").cast("string"), F.lit(")")).alias("line")))).alias("items"))
    return c.select("subject_id", "code_words", F.size("items").cast("long").alias("num_codes"), F.array_join(F.transform("items", lambda x: x["line"]), "\n").alias("codes"))


def codes_part(num_codes, codes):
    return F.concat(F.lit("\n\nCodes (N="), num_codes.cast("string"), F.lit(")\n"), codes)


def records(notes, codes, labels):
    """(subject_id, label, num_notes, num_codes, text, words): the whole history of each subject, and how many words it has (of the parts, before they are joined)."""
    line = note_line()
    notes, codes = (x.join(labels.select("subject_id"), "subject_id", "left_semi") for x in (notes, codes))
    n = notes.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("charttime", "note_id", line.alias("line")))).alias("items"), F.sum(t.word_count(line) + 2).alias("note_words"))
    n = n.select("subject_id", "note_words", F.size("items").cast("long").alias("num_notes"), F.array_join(F.transform("items", lambda x, i: F.concat(F.lit("[Note "), (i + 1).cast("string"), F.lit("] "), x["line"])), "\n").alias("notes"))
    c = code_lists(codes)
    both = labels.join(n, "subject_id", "left").join(c, "subject_id", "left").fillna(0, ["num_notes", "num_codes", "note_words", "code_words"]).fillna("", ["notes", "codes"])
    body = F.concat(F.lit("Clinical notes (N="), F.col("num_notes").cast("string"), F.lit(")\n"), F.col("notes"), codes_part(F.col("num_codes"), F.col("codes")))
    return both.select("subject_id", "label", "num_notes", "num_codes", body.alias("text"), (F.col("note_words") + F.col("code_words") + 5).alias("words"))


@frame("full_context_records", f"WITH {RECORDS} SELECT subject_id, label, num_notes, num_codes, md5(text) AS digest, len({W}) * 13 // 10 AS approx_tokens FROM rec", "note_events", "code_events", "subject_labels")
def full_context_records(notes, codes, labels):
    r = records(notes, codes, labels)
    return r.select("subject_id", "label", "num_notes", "num_codes", F.md5(F.col("text").cast("binary")).alias("digest"), t.tokens_of(F.col("words")).alias("approx_tokens"))


@frame("notes_only_ablation", f"WITH {RECORDS} SELECT subject_id, num_notes, md5(regexp_replace(text, '(?s)' || chr(10) || chr(10) || 'Codes \\(N=\\d+\\)' || chr(10) || '.*$', chr(10))) AS digest FROM rec", "note_events", "code_events", "subject_labels")
def notes_only_ablation(notes, codes, labels):
    r = records(notes, codes, labels)
    return r.select("subject_id", "num_notes", F.md5(F.regexp_replace("text", r"(?s)\n\nCodes \(N=\d+\)\n.*$", "\n").cast("binary")).alias("digest"))


@frame(
    "split_note_blocks",
    f"""WITH {RECORDS}, b AS (SELECT subject_id, string_split(regexp_replace(regexp_replace(text, '(?s)' || chr(10) || chr(10) || 'Codes \\(N=\\d+\\)' || chr(10) || '.*$', ''), '(?m)^(\\[Note \\d+\\] )', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM rec)
        SELECT subject_id, i - 1 AS block_no, length(parts[i]) AS n_chars, md5(parts[i]) AS digest FROM b, unnest(range(2, len(parts) + 1)) t(i)""",
    "note_events",
    "code_events",
    "subject_labels",
)
def split_note_blocks(notes, codes, labels):
    body = F.regexp_replace("text", r"(?s)\n\nCodes \(N=\d+\)\n.*$", "")
    parts = records(notes, codes, labels).select("subject_id", F.posexplode(F.split(body, r"(?m)(?=^\[Note \d+\] )")).alias("block_no", "block"))
    return parts.where("block_no > 0").select("subject_id", F.col("block_no").cast("long").alias("block_no"), F.length("block").cast("long").alias("n_chars"), F.md5(F.col("block").cast("binary")).alias("digest"))


BUDGET, FIXED = 3000, 200


def fitted(notes, newest: bool):
    """Notes of each subject that fit a token budget, from the newest (or oldest) on; at least one."""
    order = F.col("charttime").desc() if newest else F.col("charttime").asc()
    w = Window.partitionBy("subject_id").orderBy(order, F.col("note_id"))
    r = notes.select("subject_id", "note_id", "charttime", t.approx_tokens(F.col("text")).alias("tokens"))
    r = r.withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) + FIXED).withColumn("place", F.row_number().over(w))
    return r.where((F.col("used") <= BUDGET) | (F.col("place") == 1)).select("subject_id", "note_id", "tokens", "used")


def _fit(direction: str) -> str:
    return f"""WITH t AS (SELECT subject_id, note_id, charttime, len({W}) * 13 // 10 AS tokens FROM {{note_events}}),
      u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY subject_id ORDER BY charttime {direction}, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) + {FIXED} AS used, row_number() OVER (PARTITION BY subject_id ORDER BY charttime {direction}, note_id) AS place FROM t)
      SELECT subject_id, note_id, tokens, used FROM u WHERE used <= {BUDGET} OR place = 1"""


@frame("truncate_recent", _fit("DESC"), "note_events")
def truncate_recent(notes):
    return fitted(notes, True)


@frame("truncate_early", _fit("ASC"), "note_events")
def truncate_early(notes):
    return fitted(notes, False)


sql("token_label", "SELECT DISTINCT regexp_replace(note_type || ' run:' || CAST(age AS STRING), '[^A-Za-z0-9_.-]', '_') AS label FROM {note_events}", "SELECT DISTINCT regexp_replace(note_type || ' run:' || CAST(age AS STRING), '[^A-Za-z0-9_.-]', '_', 'g') AS label FROM {note_events}")


LONG_ = 300
STEP_ = LONG_ - t.default_overlap(LONG_)


@frame("default_overlap_chunks", f"SELECT note_id, CASE WHEN n <= {LONG_} THEN 1 ELSE 1 + CAST(ceil((n - {LONG_}) / {STEP_}.0) AS BIGINT) END AS n_chunks FROM (SELECT note_id, len({W}) AS n FROM {{note_events}})", "note_events")
def default_overlap_chunks(notes):
    return notes.select("note_id", F.size(t.chunks(F.col("text"), LONG_)).cast("long").alias("n_chunks"))


_KEPT = "SELECT subject_id, count(*) AS n_total, count(*) FILTER (WHERE used <= {b} OR place = 1) AS n_kept, string_agg(CASE WHEN used <= {b} OR place = 1 THEN '<' || CAST(note_id AS STRING) || '>' END, '' ORDER BY charttime, note_id) AS kept FROM u GROUP BY subject_id"


def _omitted(newest: bool) -> str:
    older = "'[' || CAST(n_total - n_kept AS STRING) || ' {which} notes left out]' || chr(10)"
    text = f"CASE WHEN n_kept < n_total THEN {older.format(which='older')} ELSE '' END || kept" if newest else f"kept || CASE WHEN n_kept < n_total THEN {older.format(which='newer')} ELSE '' END"
    body = _fit("DESC" if newest else "ASC").split("SELECT subject_id, note_id, tokens, used FROM u")[0]
    return f"{body}, k AS ({_KEPT.format(b=BUDGET)}) SELECT subject_id, n_total, n_kept, {text} AS body FROM k"


def reassembled(notes, newest: bool):
    """Kept notes of each subject in order, and a line for those left out: before them where the newest are kept, else after."""
    kept = fitted(notes, newest).select("note_id", F.lit(True).alias("kept"))
    parts = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("charttime", "note_id"))))
    g = notes.join(kept, "note_id", "left").groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_total"), F.count("kept").alias("n_kept"), parts.alias("x"))
    body = F.array_join(F.transform("x", lambda e: F.concat(F.lit("<"), e["note_id"].cast("string"), F.lit(">"))), "")
    line = F.when(F.col("n_kept") < F.col("n_total"), F.concat(F.lit("["), (F.col("n_total") - F.col("n_kept")).cast("string"), F.lit(" older notes left out]\n" if newest else " newer notes left out]\n"))).otherwise("")
    return g.select("subject_id", "n_total", "n_kept", (F.concat(line, body) if newest else F.concat(body, line)).alias("body"))


@frame("omitted_older", _omitted(True), "note_events")
def omitted_older(notes):
    return reassembled(notes, True)


@frame("omitted_newer", _omitted(False), "note_events")
def omitted_newer(notes):
    return reassembled(notes, False)


_CHAT = " UNION ALL ".join(
    f"""SELECT note_id, '{name}' AS prompt, md5('system:' || '{p["system"]}' || chr(10) || chr(10) || 'Be brief.' || '|user:' || '{p["user"]}' || text || '{"|assistant:" + p["prefill"] if "prefill" in p else ""}') AS digest FROM {{note_events}}""".replace("\n", "' || chr(10) || '")
    for name, p in ((n, {k: v.replace("'", "''") for k, v in prompts.PROMPTS[n].items()}) for n in ("full_context", "answer"))
)


@frame("chat_prompts", _CHAT, "note_events")
def chat_prompts(notes):
    """Chat messages of two prompts over each note, with a further line for the system and the beginning of an answer."""
    out = None
    for name in ("full_context", "answer"):
        turns = F.transform(prompts.messages(name, F.col("text"), "Be brief."), lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
        rows = notes.select("note_id", F.lit(name).alias("prompt"), F.md5(F.array_join(turns, "|").cast("binary")).alias("digest"))
        out = rows if out is None else out.unionByName(rows)
    return out


@frame("filled_prompt", "SELECT subject_id, method, 'The model gave ' || printf('%.4f', probability) || '. Its evidence, with attributions:' || chr(10) || 'about ' || CAST(n_chars AS STRING) || ' characters' || chr(10) || 'Write the report.' AS prompt FROM {predictions} WHERE probability IS NOT NULL", "predictions")
def filled_prompt(predictions):
    rows = predictions.where("probability IS NOT NULL")
    evidence = F.concat(F.lit("about "), F.col("n_chars").cast("string"), F.lit(" characters"))
    return rows.select("subject_id", "method", prompts.filled(prompts.PROMPTS["explain"]["user"], probability=F.format_string("%.4f", "probability"), evidence=evidence).alias("prompt"))


PROMPT_BUDGET = 6000
_SYSTEM, _USER = (prompts.PROMPTS["full_context"][k].replace("'", "''").replace("\n", "' || chr(10) || '") for k in ("system", "user"))


def _words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> ''))"


def _prompt(body: str) -> str:
    return f"'<system>' || chr(10) || '{_SYSTEM}' || chr(10) || '<user>' || chr(10) || '{_USER}' || {body} || chr(10) || '<assistant>' || chr(10)"


def _fits(newest: bool) -> str:
    """A linear scan over the number of notes kept, by the words of all parts."""
    line = f"'[' || CAST(t.n - k AS STRING) || ' {'older' if newest else 'newer'} notes left out]'"
    kept = f"string_agg(b.block, chr(10) ORDER BY b.i) FILTER (WHERE b.i {'> t.n - f.kept' if newest else '<= f.kept'})"
    line_ = line.replace("t.n - k", "any_value(t.n) - any_value(f.kept)")
    body = f"CASE WHEN any_value(f.kept) = any_value(t.n) THEN '' ELSE {line_} || chr(10) END || coalesce({kept}, '')" if newest else f"coalesce({kept}, '') || CASE WHEN any_value(f.kept) = any_value(t.n) THEN '' ELSE chr(10) || {line_} END"
    return rf"""WITH {RECORDS}, b AS (SELECT n.subject_id, n.i, '[Note ' || CAST(i AS STRING) || '] ' || coalesce(note_type, '') || ' at age ' || CAST(age AS STRING) || ', ' || CAST(days AS STRING) || ' days' || chr(10) || text AS block FROM n SEMI JOIN rec ON rec.subject_id = n.subject_id),
      t AS (SELECT subject_id, num_notes AS n, 'Clinical notes (N=' || CAST(num_notes AS STRING) || ')' || chr(10) AS head, regexp_extract(text, '(?s)' || chr(10) || chr(10) || 'Codes \(N=\d+\)' || chr(10) || '.*$') AS tail FROM rec),
      c AS (SELECT t.subject_id, t.n, {_words(_prompt("head || tail"))} AS fixed FROM t),
      w AS (SELECT subject_id, i, {_words('block')} AS w FROM b),
      k AS (SELECT c.subject_id, c.n, w.i AS k, (c.fixed + CASE WHEN w.i < c.n THEN 5 ELSE 0 END + sum(w.w) OVER (PARTITION BY c.subject_id ORDER BY w.i)) * 13 // 10 AS tokens FROM c JOIN (SELECT x.subject_id, CASE WHEN {newest} THEN y.n - x.i + 1 ELSE x.i END AS i, x.w FROM w x JOIN c y ON y.subject_id = x.subject_id) w ON w.subject_id = c.subject_id),
      f AS (SELECT c.subject_id, coalesce(max(k.k) FILTER (WHERE k.tokens <= {PROMPT_BUDGET}), least(1, any_value(c.n))) AS kept FROM c LEFT JOIN k ON k.subject_id = c.subject_id GROUP BY c.subject_id),
      o AS (SELECT t.subject_id, any_value(t.n) AS n, any_value(f.kept) AS kept, any_value(t.head) || {body} || any_value(t.tail) AS text FROM t JOIN f ON f.subject_id = t.subject_id LEFT JOIN b ON b.subject_id = t.subject_id GROUP BY t.subject_id)
      SELECT subject_id, md5({_prompt('text')}) AS digest, CAST({_words(_prompt('text'))} * 13 // 10 AS BIGINT) AS tokens, kept < n AS truncated, CAST(kept AS INT) AS kept, CAST(n AS INT) AS total FROM o"""


#: The most subjects of whom the keys of notes that may be in reach are broadcast: of each some 1000 at most for 6000 tokens, besides notes without a text.
FEW = 256


def notes_in_reach(notes, heads, labels, bounds, newest: bool = True):
    """The notes of labelled subjects, with the subject's ``total``, that are :func:`truncation.in_reach` by their ``heads`` (notes with empty texts, where they have one).
    These are all that are in reach by their texts, and few of a subject.  They are found without texts, and days (which follow from the key) come with their keys,
    so other texts go through no join or window."""
    from marlow.operators import truncation

    keys = ["subject_id", "charttime", "note_id"]
    h = heads.join(labels.select("subject_id"), "subject_id", "left_semi").select(*keys, "days", *[truncation.SIZES[size](note_line()).alias(size) for size, _ in bounds])
    near = truncation.in_reach(h, bounds, newest).dropDuplicates(keys).select(*[F.col(k).alias(f"near_{k}") for k in keys], "days", "total")
    near = F.broadcast(near) if labels.limit(FEW + 1).count() <= FEW else near
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"near_{k}"))
    return notes.select(*keys, "note_type", "age", "text").join(near, same).drop(*near.columns[:3])


def record_parts(notes, codes, labels, bounds, newest: bool = True, heads=None):
    """(subject_id, head, notes, total, tail): the records in parts, with the notes that a prompt within the bounds can have room for.
    ``heads`` are the notes with empty texts, where these can be had for less."""
    from marlow.operators import truncation

    heads = notes.withColumn("text", F.when(F.col("text").isNotNull(), "")) if heads is None else heads
    codes = codes.join(labels.select("subject_id"), "subject_id", "left_semi")
    near = notes_in_reach(notes, heads, labels, bounds, newest)
    n = truncation.gathered(near.select("subject_id", "charttime", "note_id", note_line().alias("line"), "total"), bounds, newest)
    both = labels.join(n, "subject_id", "left").join(code_lists(codes), "subject_id", "left").fillna(0, ["total", "num_codes"]).fillna("", ["codes"])
    head = F.concat(F.lit("Clinical notes (N="), F.col("total").cast("string"), F.lit(")\n"))
    return both.select("subject_id", head.alias("head"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), "total", codes_part(F.col("num_codes"), F.col("codes")).alias("tail"))


def _fitted_prompts(notes, codes, labels, heads, newest: bool):
    from marlow.operators import truncation

    parts = record_parts(notes, codes, labels, truncation.approximate_bounds(PROMPT_BUDGET), newest, heads)
    out = truncation.fit_parts(parts, PROMPT_BUDGET, newest=newest)
    return out.select("subject_id", F.md5(F.col("prompt").cast("binary")).alias("digest"), "tokens", "truncated", "kept", "total")


@frame("fit_prompt_recent", _fits(True), "note_events", "labelled_codes", "subject_labels", "note_heads")
def fit_prompt_recent(notes, codes, labels, heads):
    """The newest notes that a rendered prompt has room for, by bisection."""
    return _fitted_prompts(notes, codes, labels, heads, True)


@frame("fit_prompt_early", _fits(False), "note_events", "labelled_codes", "subject_labels", "note_heads")
def fit_prompt_early(notes, codes, labels, heads):
    return _fitted_prompts(notes, codes, labels, heads, False)


@frame("fit_prompt_tokens", None, "note_events", "labelled_codes", "subject_labels", "note_heads")
def fit_prompt_tokens(notes, codes, labels, heads):
    """The same with the tokens of a byte-pair tokenizer."""
    import public_tokenizers

    from marlow.operators import truncation

    path = public_tokenizers.path("byte_bpe_50k.json")
    parts = record_parts(notes, codes, labels, truncation.byte_pair_bounds(path, PROMPT_BUDGET), heads=heads)
    out = truncation.fit_parts(parts, PROMPT_BUDGET, truncation.byte_pairs(path))
    return out.select("subject_id", "tokens", "truncated", "kept", "total")
