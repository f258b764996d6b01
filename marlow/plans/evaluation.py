"""Evaluation: fills, alignment, confusion, AUC, bootstrap, funnels and cross-tabs."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlow.operators import metrics
from marlow.plans.catalog import frame, sql

P = "SELECT *, coalesce(probability, CAST(0.5 AS DOUBLE)) AS p, probability IS NOT NULL AS parsed FROM {predictions}"
DRAWS = 1000
ALIGNED = f"SELECT subject_id, label, max(CASE WHEN method = 'm1' THEN p END) AS a, max(CASE WHEN method = 'm2' THEN p END) AS b FROM ({P}) GROUP BY subject_id, label"
GRID = f"""WITH s AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS source, count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM {{predictions}})),
       g AS (SELECT d AS draw, source AS place, n FROM s, unnest(range(0, {DRAWS})) t(d)),
       r AS (SELECT draw, HASH32[['42|' || CAST(draw AS STRING) || '|' || CAST(place AS STRING)]] % n AS source FROM g),
       w AS (SELECT r.draw AS draw, s.subject_id AS subject_id, count(*) AS times FROM r JOIN s ON r.source = s.source GROUP BY r.draw, s.subject_id)"""

sql("method_alignment", "SELECT subject_id, count(DISTINCT method) AS n_methods, round(min(probability), 6) AS lowest FROM {predictions} WHERE probability IS NOT NULL GROUP BY subject_id HAVING count(DISTINCT method) = 3")
sql(
    "select_true_positives",
    """SELECT subject_id, round(probability, 6) AS probability FROM {predictions} p WHERE method = 'm1' AND label = 1 AND probability > 0.5
         AND NOT EXISTS (SELECT 1 FROM {note_events} n WHERE n.note_id = p.subject_id AND n.note_type = 'src3') ORDER BY subject_id LIMIT 20""",
)
sql("threshold_sweep", "SELECT method, t.threshold AS threshold, count(*) FILTER (WHERE 100 * probability >= t.threshold) AS n_pass, count(*) AS n FROM {predictions} CROSS JOIN (SELECT 55 AS threshold UNION ALL SELECT 75 UNION ALL SELECT 95) t GROUP BY method, t.threshold")
sql("parse_health", "SELECT method, count(*) AS n, count(probability) AS n_parsed, count(*) FILTER (WHERE truncated) AS n_truncated, round(1 - count(probability) / CAST(count(*) AS DOUBLE), 6) AS failure_rate FROM {predictions} GROUP BY method")
sql("eval_losses", f"SELECT method, round(avg(-(label * ln(greatest(p, CAST(1e-6 AS DOUBLE))) + (1 - label) * ln(greatest(1 - p, CAST(1e-6 AS DOUBLE))))), 6) AS bce, round(avg(p), 6) AS mean_p, round(avg(CASE WHEN p >= 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS active FROM ({P}) GROUP BY method")
sql("token_stats", "SELECT min(n) AS least, CAST(floor(QUANTILE[[n ;; 0.5]]) AS BIGINT) AS median, round(QUANTILE[[n ;; 0.95]], 4) AS p95, max(n) AS most FROM (SELECT CAST(floor((WORDS[[text]]) * 13 / 10) AS BIGINT) AS n FROM {note_events})", "SELECT min(n) AS least, CAST(floor(QUANTILE[[n ;; 0.5]]) AS BIGINT) AS median, round(QUANTILE[[n ;; 0.95]], 4) AS p95, max(n) AS most FROM (SELECT (WORDS[[text]]) * 13 // 10 AS n FROM {note_events})")
sql("upper_median", "SELECT method, n_chars AS upper_median FROM (SELECT method, n_chars, row_number() OVER (PARTITION BY method ORDER BY n_chars, subject_id) AS rn, count(*) OVER (PARTITION BY method) AS n FROM {predictions}) WHERE rn = floor(n / 2) + 1")


@frame(
    "confusion_metrics",
    f"""SELECT method, tp, fp, fn, tn, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
          round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 6) AS f1 FROM (
        SELECT method, count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn FROM ({P}) GROUP BY method)""",
    "predictions",
)
def confusion_metrics(predictions):
    return metrics.confusion(metrics.filled(predictions), ["method"])


@frame(
    "auc_exact",
    f"""WITH f AS ({P}), u AS (SELECT method, 'filled' AS kind, label, p FROM f UNION ALL SELECT method, 'parsed', label, p FROM f WHERE parsed),
        r AS (SELECT *, rank() OVER (PARTITION BY method, kind ORDER BY p) + (count(*) OVER (PARTITION BY method, kind, p) - 1) / 2.0 AS rk FROM u)
        SELECT method, kind, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) AS auc FROM (
          SELECT method, kind, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_pos, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS n_neg, CAST(sum(rk) FILTER (WHERE label = 1) AS DOUBLE) AS s FROM r GROUP BY method, kind)""",
    "predictions",
)
def auc_exact(predictions):
    f = metrics.filled(predictions)
    return metrics.auc(f.withColumn("kind", F.lit("filled")).union(f.where("parsed").withColumn("kind", F.lit("parsed"))), ["method", "kind"])


@frame("bootstrap_draws", f"{GRID} SELECT draw, count(*) AS n_distinct, CAST(sum(times) AS BIGINT) AS n, CAST(sum(times * subject_id) AS BIGINT) AS checksum FROM w GROUP BY draw", "predictions")
def bootstrap_draws(predictions):
    return metrics.draws(predictions, "subject_id", DRAWS)


METRICS = ("auc", "accuracy", "precision", "recall", "f1")


def drawn(predictions):
    """(draw, method, ...): the five metrics of every method in every draw with both classes."""
    return metrics.resampled(metrics.filled(predictions), "subject_id", ["method"], DRAWS)


RESAMPLED = f"""{GRID}, b AS (SELECT w.draw AS draw, f.method AS method, f.p AS p, sum(CASE WHEN f.label = 1 THEN w.times ELSE 0 END) AS pos, sum(CASE WHEN f.label = 1 THEN 0 ELSE w.times END) AS neg
         FROM w JOIN ({P}) f ON f.subject_id = w.subject_id GROUP BY w.draw, f.method, f.p),
       c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY draw, method ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
       t AS (SELECT draw, method, CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) AS won, CAST(sum(pos) AS DOUBLE) AS pos, CAST(sum(neg) AS DOUBLE) AS neg, CAST(sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN p >= 0.5 THEN neg ELSE 0 END) AS DOUBLE) AS fp
         FROM c GROUP BY draw, method),
       m AS (SELECT draw, method, won / (pos * neg) AS auc, (tp + neg - fp) / (pos + neg) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, tp / pos AS recall, 2 * tp / (pos + tp + fp) AS f1 FROM t WHERE pos > 0 AND neg > 0)"""


@frame(
    "bootstrap_ci",
    f"{RESAMPLED} "
    + " UNION ALL ".join(f"SELECT method, '{x}' AS metric, count(*) AS n_draws, round(avg({x}), 6) AS mean, round(quantile_cont({x}, 0.025), 6) AS low, round(quantile_cont({x}, 0.975), 6) AS high FROM m GROUP BY method" for x in METRICS),
    "predictions",
)
def bootstrap_ci(predictions):
    long = drawn(predictions).select("method", F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("v")) for x in METRICS])).alias("m")).select("method", "m.*")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    out = long.groupBy("method", "metric").agg(F.count(F.lit(1)).alias("n_draws"), F.round(F.avg("v"), 6).alias("mean"), q.alias("q"))
    return out.select("method", "metric", "n_draws", "mean", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


@frame(
    "bootstrap_pairwise",
    f"""{RESAMPLED} SELECT a.method AS a, b.method AS b, count(*) AS n_draws, round(avg(CASE WHEN a.auc > b.auc THEN 1.0 ELSE 0.0 END), 6) AS p_better, round(avg(a.auc - b.auc), 6) AS gap,
         round(quantile_cont(a.auc - b.auc, 0.025), 6) AS low, round(quantile_cont(a.auc - b.auc, 0.975), 6) AS high FROM m a JOIN m b ON a.draw = b.draw AND a.method < b.method GROUP BY a.method, b.method""",
    "predictions",
)
def bootstrap_pairwise(predictions):
    """Chance that one method's AUC is above another's, and the gap, over draws that both share."""
    by = drawn(predictions).groupBy("draw").agg(F.collect_list(F.struct("method", "auc")).alias("x"))
    pair = F.explode(F.expr("flatten(transform(x, a -> transform(filter(x, b -> b.method > a.method), b -> named_struct('a', a.method, 'b', b.method, 'gap', a.auc - b.auc))))")).alias("p")
    gap = F.col("gap")
    q = F.percentile(gap, F.array(F.lit(0.025), F.lit(0.975)))
    out = by.select(pair).select("p.*").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_draws"), F.round(F.avg((gap > 0).cast("int")), 6).alias("p_better"), F.round(F.avg(gap), 6).alias("mean_gap"), q.alias("q"))
    return out.select("a", "b", "n_draws", "p_better", F.col("mean_gap").alias("gap"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


# Funnels and cross-tabs over verdicts and flags.
@frame(
    "judge_pass_rates",
    """WITH f AS (SELECT event_id, i, (k + i) % 3 > 0 AS follows, (k * i) % 4 > 0 AS stated FROM {verdicts}, unnest(range(1, 1 + k % 6)) t(i)),
         r AS (SELECT event_id, count(*) AS n, count(*) FILTER (WHERE follows) AS f, count(*) FILTER (WHERE stated) AS s, count(*) FILTER (WHERE follows AND stated) AS fs FROM f GROUP BY event_id),
         v AS (SELECT v.*, coalesce(r.n, 0) AS n, coalesce(r.f, 0) AS f, coalesce(r.s, 0) AS s, coalesce(r.fs, 0) AS fs, r.n IS NOT NULL AND r.n = r.fs AS all_pass FROM {verdicts} v LEFT JOIN r ON r.event_id = v.event_id)
       SELECT baseline, count(*) AS n_judged, CAST(sum(n) AS BIGINT) AS n_factors, round(100 * sum(f) / CAST(sum(n) AS DOUBLE), 2) AS follows_pct, round(100 * sum(s) / CAST(sum(n) AS DOUBLE), 2) AS stated_pct, round(100 * sum(fs) / CAST(sum(n) AS DOUBLE), 2) AS both_pct,
         round(100 * count(*) FILTER (WHERE all_pass) / CAST(count(*) AS DOUBLE), 2) AS all_factors_pct, round(100 * count(*) FILTER (WHERE k % 2 = 0 AND k % 3 = 0) / CAST(count(*) AS DOUBLE), 2) AS overall_pct, CAST(sum(k) AS BIGINT) AS tokens FROM v GROUP BY baseline""",
    "verdicts",
)
def judge_pass_rates(verdicts):
    """Pass rates of judged factors and records by baseline; a record passes with one factor or more and all of them good."""
    k = F.col("k")
    factors = F.when(k % 6 > 0, F.transform(F.sequence(F.lit(1), k % 6), lambda i: F.struct(((k + i) % 3 > 0).alias("follows"), ((k * i) % 4 > 0).alias("stated"))))
    v = verdicts.select("baseline", "k", F.coalesce(factors, F.array().cast("array<struct<follows:boolean,stated:boolean>>")).alias("f"))
    count = lambda g: F.size(F.filter("f", g))
    both = count(lambda x: x["follows"] & x["stated"])
    v = v.select("baseline", "k", F.size("f").alias("n"), count(lambda x: x["follows"]).alias("a"), count(lambda x: x["stated"]).alias("b"), both.alias("ab"))
    pct = lambda x, of: F.when(of == 0, 0.0).otherwise(F.round(100 * x / of, 2))
    n, rows = F.sum("n"), F.count(F.lit(1))
    return v.groupBy("baseline").agg(
        rows.alias("n_judged"),
        n.alias("n_factors"),
        pct(F.sum("a"), n).alias("follows_pct"),
        pct(F.sum("b"), n).alias("stated_pct"),
        pct(F.sum("ab"), n).alias("both_pct"),
        pct(F.count_if((F.col("n") > 0) & (F.col("n") == F.col("ab"))), rows).alias("all_factors_pct"),
        pct(F.count_if((k % 2 == 0) & (k % 3 == 0)), rows).alias("overall_pct"),
        F.sum("k").alias("tokens"),
    )


sql(
    "selection_funnel",
    """SELECT lower(trim(trust)) AS trust, count(*) AS n, count(*) FILTER (WHERE k < 50) AS gate_a, count(*) FILTER (WHERE k < 50 AND value > 20) AS gate_b, count(*) FILTER (WHERE k < 50 AND value > 20 AND value < 80) AS kept FROM {verdicts} GROUP BY lower(trim(trust))""",
)
sql(
    "format_gate_counts",
    """SELECT count(*) AS n, count(*) FILTER (WHERE k % 2 = 0) AS pass_a, count(*) FILTER (WHERE k % 3 = 0) AS pass_b, count(*) FILTER (WHERE k % 2 = 0 AND k % 3 = 0) AS pass_ab, count(*) FILTER (WHERE k IS NULL) AS n_null,
         count(*) FILTER (WHERE k = 0) AS zero, count(*) FILTER (WHERE k BETWEEN 1 AND 5) AS few, count(*) FILTER (WHERE k > 5) AS many FROM {verdicts}""",
)
sql("flag_verdict_join", "SELECT t.flag_id, t.type_a, t.type_b, coalesce(v.agree, 'missing') AS agree FROM {flag_tasks} t LEFT JOIN {flag_verdicts} v ON t.flag_id = v.flag_id")
sql(
    "flag_precision",
    """SELECT type_a, count(*) AS n, count(*) FILTER (WHERE agree = 'agree') AS agreed, count(*) FILTER (WHERE agree = 'disagree') AS disagreed, count(*) FILTER (WHERE agree = 'unsure') AS unsure,
         round(100 * count(*) FILTER (WHERE agree = 'agree') / CAST(count(*) AS DOUBLE), 2) AS pct FROM {flag_tasks} t JOIN {flag_verdicts} v ON t.flag_id = v.flag_id WHERE type_a IS NOT NULL GROUP BY type_a""",
)
sql("variant_overlap", "SELECT type_a IS NOT NULL AS has_a, type_b IS NOT NULL AS has_b, count(*) AS n FROM {flag_tasks} GROUP BY type_a IS NOT NULL, type_b IS NOT NULL")
sql(
    "bucket_crosstab",
    """SELECT variant, bucket, count(*) FILTER (WHERE agree = 'agree') AS agreed, count(*) FILTER (WHERE agree = 'disagree') AS disagreed, count(*) FILTER (WHERE agree = 'unsure') AS unsure FROM (
         SELECT 'a' AS variant, coalesce(type_a, 'unknown') AS bucket, agree FROM {flag_tasks} t JOIN {flag_verdicts} v ON t.flag_id = v.flag_id
         UNION ALL SELECT 'b', coalesce(type_b, 'unknown'), agree FROM {flag_tasks} t JOIN {flag_verdicts} v ON t.flag_id = v.flag_id) GROUP BY variant, bucket""",
)
sql("severity_histogram", "SELECT coalesce(severity, 'unspecified') AS severity, count(*) AS n FROM {flag_verdicts} WHERE agree = 'agree' GROUP BY coalesce(severity, 'unspecified')")
sql("step2_queue", "SELECT baseline, event_id, subject_id FROM (SELECT v.*, row_number() OVER (PARTITION BY baseline ORDER BY event_id) AS rn FROM {verdicts} v WHERE EXISTS (SELECT 1 FROM {subject_labels} s WHERE s.subject_id = v.subject_id AND s.label = 1)) WHERE rn <= 25")
sql(
    "early_stopping",
    """WITH f AS (SELECT method, CAST(subject_id % 7 AS BIGINT) AS epoch, label, coalesce(probability, CAST(0.5 AS DOUBLE)) AS p FROM {predictions}),
       r AS (SELECT *, rank() OVER (PARTITION BY method, epoch ORDER BY p) + (count(*) OVER (PARTITION BY method, epoch, p) - 1) / CAST(2 AS DOUBLE) AS rk FROM f),
       s AS (SELECT method, epoch, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS n0, sum(CASE WHEN label = 1 THEN rk ELSE CAST(0 AS DOUBLE) END) AS s FROM r GROUP BY method, epoch),
       e AS (SELECT method, epoch, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM s WHERE n1 > 0 AND n0 > 0),
       b AS (SELECT *, max(auc) OVER (PARTITION BY method ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
       g AS (SELECT *, max(CASE WHEN before IS NULL OR auc > before THEN epoch END) OVER (PARTITION BY method ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM b),
       x AS (SELECT method, min(CASE WHEN epoch - best >= 3 THEN epoch END) AS stopped_at FROM g GROUP BY method)
       SELECT g.method, x.stopped_at, max(g.best) AS best_epoch, max(g.auc) AS best_auc, count(*) AS n_epochs FROM g JOIN x ON x.method = g.method WHERE x.stopped_at IS NULL OR g.epoch <= x.stopped_at GROUP BY g.method, x.stopped_at""",
)
sql(
    "nested_filter_notes",
    """WITH r AS (SELECT l_orderkey, filter(collect_list(named_struct('kind', CASE WHEN l_linenumber % 2 = 1 THEN 'Note' ELSE 'Code' END, 'part', l_partkey)), x -> x.kind = 'Note') AS notes, count(*) AS n_items FROM {lineitem} GROUP BY l_orderkey)
       SELECT l_orderkey, n_items, CAST(size(notes) AS BIGINT) AS n_notes, aggregate(notes, 0L, (a, x) -> a + x.part) AS parts FROM r""",
    "SELECT l_orderkey, count(*) AS n_items, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS n_notes, CAST(coalesce(sum(CASE WHEN l_linenumber % 2 = 1 THEN l_partkey END), 0) AS BIGINT) AS parts FROM {lineitem} GROUP BY l_orderkey",
)
sql(
    "verbalizer_stats",
    """SELECT method, count(*) AS n, round(min(p), 6) AS least, round(QUANTILE[[p ;; 0.5]], 6) AS median, round(max(p), 6) AS most, round(avg(p), 6) AS mean, count(*) FILTER (WHERE trim(token) = 'Yes') AS n_yes, count(*) FILTER (WHERE trim(token) = 'No') AS n_no,
         count(*) FILTER (WHERE trim(token) NOT IN ('Yes', 'No')) AS n_other FROM (SELECT method, coalesce(probability, CAST(0.5 AS DOUBLE)) AS p, CASE n_chars % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'No ' WHEN 2 THEN 'Maybe' WHEN 3 THEN 'Yes' ELSE 'no' END AS token FROM {predictions}) x GROUP BY method""",
)
