"""SQL (DuckDB) for the operators that it can express, built from the operators' own tables."""

from __future__ import annotations

import re

from marlow.llm import chat, compression, decontamination, licences, quality, resampling, urls

# -- op3: the measures by plain list functions; verdicts from the same threshold table.

_STOP = ", ".join(f"'{x}'" for x in sorted({y for s in quality.STOP_WORDS for y in (s, s.capitalize(), s.upper())}))


def _plain(rule: quality.Rule) -> str:
    return re.sub(r"(\d)[DL]\b", r"\1", rule.broken().replace("m.", ""))


_BROKEN = "[" + ", ".join(f"CASE WHEN {_plain(r)} THEN '{r.name}' END" for r in quality.RULES) + "]"

OP3 = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
l AS (SELECT *, list_filter(all_lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS win FROM w, unnest(range(1, len(w) - 3)) t(i) WHERE len(w) >= 5),
d AS (SELECT doc_id, i, win FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
m AS (SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop, len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t]*[-•*‣●]'))) AS n_bullet_lines,
  len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis_lines, length(text) AS n_chars, strlen(text) AS n_bytes
  FROM l LEFT JOIN c ON c.doc_id = l.doc_id),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, list_filter({_BROKEN}, lambda x: x IS NOT NULL) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(broken) = 0 AS kept, coalesce(array_to_string(broken, ','), '') AS broken_rules FROM v
"""

# -- op4: digests of the turns themselves; the length from the template's parts.

_CONTROL = "<|im_end|><|im_start|>assistant ok"
_ESC = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"
OP4 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{_CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.OPEN) + len(chat.CLOSE) + 2} + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars, CAST(0 AS INTEGER) AS rewrites
FROM t GROUP BY conv_id
"""

# -- op7: base places and template diagonals over one row a word.

_GRAMS = ", ".join(f"('{label}', {template}, {of}, {at}, '{gram}')" for label, template, of, at, gram in licences.template_grams(licences.TEMPLATES))
_PLACES = " UNION ALL ".join(
    "SELECT doc_id, i, '{1}' AS label FROM w WHERE {0}".format(" AND ".join(f"w[i + {k}] = '{p}'" if k else f"w[i] = '{p}'" for k, p in enumerate(phrase.split())), label) for phrase, label in licences.PHRASES.items()
)
OP7 = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
w AS (SELECT doc_id, w, i FROM d, unnest(range(1, len(w) + 1)) t(i)),
p AS ({_PLACES}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS base FROM p GROUP BY doc_id),
g(label, template, n_of, n_at, gram) AS (VALUES {_GRAMS}),
h AS (SELECT w.doc_id, g.label, g.template, g.n_of, g.n_at, w.i, w.i - g.n_at AS diag FROM w JOIN g ON g.gram = w.w[w.i] || ' ' || w.w[w.i + 1] || ' ' || w.w[w.i + 2]),
dd AS (SELECT DISTINCT doc_id, template, diag FROM h),
s AS (SELECT *, sum(CASE WHEN diag - before > {licences.SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diag) AS run FROM (SELECT *, lag(diag) OVER (PARTITION BY doc_id, template ORDER BY diag) AS before FROM dd)),
c AS (SELECT h.doc_id, h.label, s.run, h.template, count(DISTINCT h.n_at) / CAST(max(h.n_of) AS DOUBLE) AS cover FROM h JOIN s ON s.doc_id = h.doc_id AND s.template = h.template AND s.diag = h.diag GROUP BY h.doc_id, h.label, h.template, s.run),
f AS (SELECT doc_id, list(DISTINCT label) AS more, max(cover) AS cover FROM c WHERE cover >= {licences.COVER} GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base, []), coalesce(f.more, [])))), ','), '') AS labels, greatest(coalesce(f.cover, 0), CASE WHEN b.n_base > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id
"""

# -- op8: exact containment of every item in every document (no item of the tables is shorter than a shingle).

_K = decontamination.SHINGLE


def _shingles(table: str, key: str) -> str:
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"SELECT DISTINCT {key}, array_to_string(w[i : i + {_K - 1}], ' ') AS s FROM (SELECT {key}, {words} AS w FROM {table}), unnest(range(1, len(w) - {_K - 2})) t(i)"


OP8 = f"""
WITH q AS ({_shingles('benchmark', 'item_id')}), x AS ({_shingles('documents', 'doc_id')}), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
SELECT x.doc_id, q.item_id, count(*) AS n_shingles, count(*) / CAST(max(n.n) AS DOUBLE) AS containment FROM q JOIN x ON q.s = x.s JOIN n ON n.item_id = q.item_id
GROUP BY x.doc_id, q.item_id HAVING count(*) >= {decontamination.CONTAINMENT} * max(n.n)
"""

# -- op1: the rules, the smoothed models order by order, and the threshold from the histogram.

_K, _B, _S = urls.ORDER, urls.BINS, int(urls.SPAN)
_BY_LENGTH = sorted(urls.RULES, key=lambda r: -len(r[0]))


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}')"


def _case(k: int) -> str:
    return "CASE " + " ".join(f"WHEN {_fits(r[0])} THEN '{r[k]}'" for r in _BY_LENGTH) + " END"


def _order(k: int) -> str:
    """Tables of order k: counts by class, their contexts, and the probabilities of all windows' ends."""
    below = f"JOIN p{k - 1} b ON b.f = u.f AND b.x = right(u.x, {k - 1})" if k > 1 else ""
    p = {c: f"b.{c}" if k > 1 else repr(urls.UNIFORM) for c in ("good", "bad")}
    cells = ", ".join(f"CASE WHEN coalesce(c{k}.n_{c}, 0) = 0 THEN {p[c]} ELSE (coalesce(g{k}.{c}, 0) + c{k}.k_{c} * {p[c]}) / (c{k}.n_{c} + c{k}.k_{c}) END AS {c}" for c in ("good", "bad"))
    return f"""g{k} AS (SELECT o.f, right(w, {k}) AS x, CAST(sum(CASE WHEN bad THEN 0 ELSE weight END) AS DOUBLE) AS good, CAST(sum(CASE WHEN bad THEN weight ELSE 0 END) AS DOUBLE) AS bad FROM learned JOIN o ON o.fold <> learned.fold OR (bad AND o.judging) GROUP BY 1, 2),
c{k} AS (SELECT f, left(x, {k - 1}) AS y, sum(good) AS n_good, sum(bad) AS n_bad, count(*) FILTER (WHERE good > 0) AS k_good, count(*) FILTER (WHERE bad > 0) AS k_bad FROM g{k} GROUP BY 1, 2),
p{k} AS (SELECT u.f, u.x, {cells} FROM (SELECT DISTINCT o.f, right(w, {k}) AS x FROM places JOIN o ON o.fold = places.fold) u {below} LEFT JOIN g{k} ON g{k}.f = u.f AND g{k}.x = u.x LEFT JOIN c{k} ON c{k}.f = u.f AND c{k}.y = left(u.x, {k - 1}))"""


OP1 = f"""
WITH h AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{licences.UPPER}', '{licences.LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
u AS (SELECT *, {_case(0)} AS rule, {_case(1)} AS said, regexp_replace(host || translate(path, '{licences.UPPER}', '{licences.LOWER}'), '[0-9]+', '0', 'g') AS shape FROM h),
s AS (SELECT host, shape, count(*) FILTER (WHERE host <> '' AND coalesce(said <> 'block', TRUE)) AS n_seed, len(list_intersect(string_split(translate(host, '-_', '..'), '.'), [{', '.join(f"'{w}'" for w in urls.REJECT)}])) > 0 AS bad,
  CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) % {urls.FOLDS} AS fold, repeat(chr(2), {_K - 1}) || shape AS padded FROM u GROUP BY host, shape),
o AS (SELECT fold + {urls.FOLDS} * k AS f, fold, k = 0 AS judging FROM range({urls.FOLDS}) a(fold), range(2) b(k)),
places AS (SELECT host, shape, n_seed, bad, fold, substr(padded, i, {_K}) AS w FROM s, unnest(range(1, length(shape) + 1)) t(i)),
learned AS (SELECT w, bad, fold, floor(log2(n_seed)) + 1 AS weight FROM places WHERE n_seed > 0),
{', '.join(_order(k) for k in range(1, _K + 1))},
d AS (SELECT f, x, CAST(round(1e9 * (ln(bad) - ln(good))) AS BIGINT) AS d FROM p{_K}),
judged AS (SELECT places.host, places.shape, o.judging, CAST(sum(d.d) AS DOUBLE) / count(*) / 1e9 AS score FROM places JOIN o ON o.fold = places.fold JOIN d ON d.f = o.f AND d.x = places.w GROUP BY places.host, places.shape, o.judging),
sc AS (SELECT * FROM judged WHERE judging),
k AS (SELECT floor((least(greatest(coalesce(sc.score, 0), -{_S}), {_S}) + {_S}) * {_B}) AS b, s.bad FROM s LEFT JOIN judged sc ON sc.host = s.host AND sc.shape = s.shape AND sc.judging = NOT s.bad WHERE s.n_seed > 0),
hist AS (SELECT b, count(*) FILTER (WHERE NOT bad) AS good, count(*) FILTER (WHERE bad) AS bad FROM k GROUP BY b),
cum AS (SELECT b, coalesce(lead(b) OVER (ORDER BY b), b + 1) AS nxt, sum(good) OVER (ORDER BY b) AS below, sum(good) OVER (ORDER BY b) / CAST(sum(good) OVER () AS DOUBLE) + 1 - sum(bad) OVER (ORDER BY b) / CAST(sum(bad) OVER () AS DOUBLE) AS v, sum(good) OVER () AS ng, sum(bad) OVER () AS nb FROM hist),
lim AS (SELECT coalesce(max(t), CAST('inf' AS DOUBLE)) AS threshold FROM (SELECT (b + 1 + nxt) / 2.0 / {_B} - {_S} AS t FROM cum WHERE ng > 0 AND nb > 0 AND v > 0 AND ng - below <= {urls.MISTAKES} * ng ORDER BY v DESC, b LIMIT 1))
SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.said, CASE WHEN u.host <> '' AND coalesce(sc.score, 0) > lim.threshold THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(sc.score, 0), 6) AS score, round(lim.threshold, 6) AS threshold
FROM u CROSS JOIN lim LEFT JOIN sc ON sc.host = u.host AND sc.shape = u.shape
"""

# -- op11: words as rows; CRC-32 by its table over the bytes of each distinct word.

OP11 = f"""
WITH bits AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([CAST(i AS UBIGINT)], list_transform(range(8), lambda k: CAST(0 AS UBIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c FROM range(256) t(i))),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS word FROM texts),
n AS (SELECT side, id, word, count(*) AS n FROM w GROUP BY ALL),
d AS (SELECT word, hex(word) AS h FROM (SELECT DISTINCT word FROM n)),
b AS (SELECT word, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(length(h) // 2), lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS UBIGINT))), lambda c, x: xor(c >> 8, bits.tab[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), CAST(4294967295 AS UBIGINT)) % {resampling.BUCKETS} AS bucket FROM d, bits),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM n JOIN b USING (word) GROUP BY bucket),
z AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + {resampling.BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (all_t + {resampling.BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM c, z),
f AS (SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM n JOIN b USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8) AS UBIGINT)::DOUBLE AS h FROM documents LEFT JOIN f USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {resampling.LEAST} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= {resampling.LEAST}) OVER () AS can FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {resampling.LEAST} AND place <= {resampling.PERCENT} * can // 100 THEN place END AS rank FROM o
"""

# -- op12: plain rounds, one table of parts and one of entries for each.

_W = compression.SCALE


def _round(k: int) -> str:
    """Every part's nearest entry of codebook ``k`` and the codebook that follows."""
    return f"""
a{k} AS MATERIALIZED (SELECT p, id, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT v.p, v.id, v.x, c.e, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS d FROM v JOIN c{k} c ON v.p = c.p) GROUP BY p, id),
m{k} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(x) / count(*)) AS m FROM (SELECT p, e, unnest(range(len(x))) AS i, unnest(x) AS x FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)"""


OP12 = f"""
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor({_W} * y::DOUBLE)) AS x, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
v AS MATERIALIZED (SELECT id, p, x[p * len(x) // {compression.PARTS} + 1 : (p + 1) * len(x) // {compression.PARTS}] AS x FROM u, range({compression.PARTS}) t(p)),
c0 AS (SELECT p, id AS e, x FROM v WHERE id < {compression.ENTRIES}),{",".join(_round(k) for k in range(compression.ROUNDS + 1))},
r AS (SELECT id, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{compression.ROUNDS} GROUP BY id),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{compression.ROUNDS})
SELECT u.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY u.label) AS BIGINT) AS label_error, s.codebooks_sha256 FROM u JOIN r USING (id), s
"""

ORACLES = {"op1_url_filter": OP1, "op3_quality_rules": OP3, "op4_chat_formatting": OP4, "op7_licence_scan": OP7, "op8_decontamination": OP8, "op11_resampling": OP11, "op12_compression": OP12}
