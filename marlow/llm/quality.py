"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in expression over the whole text; no user function,
no shuffle.  Values:

* null text: no words, every count 0, fails the base rule (fewer than 10 words);
* empty text: the same;
* repeated rows and ties: each row is judged alone, so equal rows get equal rows;
* empty table: empty result with the same columns;
* columns of the input other than ``doc_id`` and ``text`` are left out of
  :func:`judged` and kept as they are by :func:`passing`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The separators of words besides the blank, as written in a SQL string.
SPACE = r"[\\t\\n\\x0B\\f\\r]"

# Common function words of English, French, German, Spanish, Italian, Portuguese, Dutch,
# Swedish, Polish, Czech, Finnish, Hungarian, Turkish, Indonesian and Romanian.
STOP_WORDS = (
    "the of and to in is that it was for as with on by at from this are or an be "
    "la le les des et du un une que qui dans pour pas sur est par "
    "der die das und ist nicht von zu mit den ein eine auf sich dem "
    "el los las de y en por con para se del no su al es "
    "il di che non per sono da della "
    "o os um uma em mais na ao "
    "het een van niet zijn dat voor "
    "och att det som inte har till "
    "i w nie z na jest to do "
    "a v se je ze si "
    "ja on ei se oli mutta "
    "az egy hogy nem is ez "
    "ve bir bu da de ile "
    "yang dan di dari ini untuk "
    "si la cu nu pe este"
).split()
#: Most UTF-8 bytes for a character in texts of the Latin script; other scripts take 1.5 to 3.
LATIN = 1.3


@dataclass(frozen=True)
class Rule:
    """``least <= over / under <= most``, judged where n_words >= from_words and, with
    ``latin``, only for texts in the Latin script: other scripts have other stop words, and some no blanks."""

    name: str
    over: str
    under: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0
    latin: bool = False

    def broken(self) -> str:
        """SQL over the struct ``m`` of measures."""
        ratio = f"m.{self.over} / greatest(m.{self.under}, 1L)"
        bad = [f"{ratio} < {self.least}D"] if self.least is not None else []
        bad += [f"{ratio} > {self.most}D"] if self.most is not None else []
        where = f"m.n_words >= {self.from_words}" + (f" AND m.n_bytes <= {LATIN}D * m.n_chars" if self.latin else "")
        return f"({where} AND ({' OR '.join(bad) or 'false'}))"


#: The threshold table.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=2.5, most=12.0, latin=True),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop", "n_words", least=0.06, from_words=40, latin=True),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.5, from_words=40),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=0.9, from_words=40),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=0.3, from_words=40),
)


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(w: str) -> str:
    """Words of ``w`` within a 5-word window that the text holds twice or more.

    Texts whose windows all have different 64-bit hashes end at a hash set.  Else each window
    becomes one long, its hash above its place (as many low bits as places need), and
    the longs are sorted: windows without a neighbour of equal bits stand alone.  The others are
    sorted by their words themselves, so that the result is exact at any length; the union of the
    repeated windows' places is counted from the gaps between them.
    """
    hashes = _let(f"transform({w}, x -> xxhash64(x))", "g", "transform(sequence(0, size(g) - 5), i -> xxhash64(g[i], g[i + 1], g[i + 2], g[i + 3], g[i + 4]))")
    packed = _let("CAST(ceil(log2(size(h) + 1)) AS INT)", "b", "sort_array(transform(h, (v, i) -> shiftleft(shiftright(v, b), b) | i))")
    like = _let("CAST(shiftleft(1L, CAST(ceil(log2(size(h) + 1)) AS INT)) - 1 AS BIGINT)", "z", "filter(transform(p, (x, k) -> if((k > 0 AND (p[k - 1] | z) = (x | z)) OR (k < size(p) - 1 AND (p[k + 1] | z) = (x | z)), x & z, -1L)), x -> x >= 0)")
    window = f"concat_ws(' ', slice({w}, CAST(x AS INT) + 1, 5))"
    exact = _let(f"sort_array(transform({like}, x -> named_struct('t', {window}, 'i', x)))", "q", "filter(transform(q, (x, k) -> if((k > 0 AND q[k - 1].t = x.t) OR (k < size(q) - 1 AND q[k + 1].t = x.t), x.i, -1L)), x -> x >= 0)")
    cover = _let(_let(packed, "p", f"sort_array({exact})"), "s", "aggregate(transform(s, (x, k) -> if(k = size(s) - 1, 5L, least(5L, s[k + 1] - x))), 0L, (a, x) -> a + x)")
    return f"if(size({w}) < 5, 0L, {_let(hashes, 'h', f'if(size(array_distinct(h)) = size(h), 0L, {cover})')})"


def _measures(text: str) -> str:
    """SQL of one struct with all measures of the SQL expression ``text``."""
    stop = ", ".join(f"'{x}'" for x in sorted({y for x in STOP_WORDS for y in (x, x.capitalize(), x.upper())}))
    by_word = (
        "named_struct('n_words', CAST(size(w) AS BIGINT), 'word_chars', aggregate(w, 0L, (a, x) -> a + char_length(x)), "
        f"'n_stop', CAST(size(filter(w, x -> x IN ({stop}))) AS BIGINT), "
        f"'n_repeat_words', {_repeat_words('w')})"
    )
    by_line = (
        "named_struct('n_lines', CAST(size(l) AS BIGINT), 'n_dup_lines', CAST(size(l) - size(array_distinct(l)) AS BIGINT), "
        "'n_bullet_lines', CAST(size(filter(l, x -> x rlike '^[ \\t]*[-•*‣●]')) AS BIGINT), "
        "'n_ellipsis_lines', CAST(size(filter(l, x -> endswith(rtrim(x), '...') OR endswith(rtrim(x), '…'))) AS BIGINT))"
    )
    words = _let(f"filter(split(regexp_replace({text}, '{SPACE}', ' '), ' ', -1), x -> x <> '')", "w", by_word)
    lines = _let(f"filter(split({text}, '\\n', -1), x -> x rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]')", "l", by_line)
    parts = f"named_struct('w', {words}, 'l', {lines}, 's', named_struct('n_symbols', CAST(length({text}) - length(regexp_replace({text}, '[#*$%&|<>]+', '')) AS BIGINT), 'n_chars', CAST(length({text}) AS BIGINT), 'n_bytes', CAST(octet_length({text}) AS BIGINT)))"
    fields = ", ".join(f"'{m}', y.{'s' if m in ('n_symbols', 'n_chars', 'n_bytes') else 'l' if 'line' in m else 'w'}.{m}" for m in MEASURES)
    return _let(parts, "y", f"named_struct({fields})")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_chars", "n_bytes")
TEXT = "coalesce(text, '')"
BASE_FAILED = "(m.n_words < 10 OR 100 * m.n_repeat_words > 20 * m.n_words)"


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, ``base_failed``, ``broken`` (names of broken rules)
    and ``kept`` of every row of ``docs``."""
    names = ", ".join(f"if({r.broken()}, '{r.name}', NULL)" for r in rules)
    verdict = f"named_struct('m', m, 'base_failed', {BASE_FAILED}, 'broken', filter(array({names}), x -> x IS NOT NULL))"
    one = docs.select("doc_id", F.expr(_let(_measures(TEXT), "m", verdict)).alias("_v"))
    return one.select(
        "doc_id",
        *[F.col(f"_v.m.{x}").alias(x) for x in MEASURES],
        F.col("_v.base_failed").alias("base_failed"),
        F.col("_v.broken").cast("array<string>").alias("broken"),
        F.expr("NOT _v.base_failed AND size(_v.broken) = 0").alias("kept"),
    )


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the base rule and every other rule keep, columns
    unchanged.  The verdict is one expression, so that no measure runs twice."""
    bad = " OR ".join([BASE_FAILED, *[r.broken() for r in rules]])
    return docs.where(F.expr(_let(_measures(TEXT), "m", f"NOT ({bad})")))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken_rules"))
