"""Cohort preparation: projections, keep-first and last-wins dedup, splits, samples, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlow.operators import relational
from marlow.plans.catalog import frame, sql

sql("preview_limit", "SELECT subject_id, note_id, days FROM {note_events} ORDER BY note_id LIMIT 10")

sql(
    "semi_join_subjects",
    "SELECT n.subject_id, n.note_id, n.days FROM {note_events} n WHERE n.text IS NOT NULL AND EXISTS (SELECT 1 FROM {subject_labels} s WHERE s.subject_id = n.subject_id AND s.label = 1)",
)

sql(
    "code_event_projection",
    """SELECT CAST(subject_id AS STRING) AS subject_id, CAST(code AS STRING) || '-' || CAST(version AS STRING) AS code_ver,
         coalesce(nullif(title, 'small ring'), '') AS long_title, CAST(days AS INT) AS days FROM {code_events}""",
)


@frame(
    "dedup_codes_keep_first",
    """SELECT subject_id, code, version, title, days, ord FROM (
         SELECT *, row_number() OVER (PARTITION BY subject_id, code ORDER BY ord) AS rn FROM {code_events}) WHERE rn = 1""",
    "code_events",
)
def dedup_codes_keep_first(codes):
    return relational.keep_first(codes, ["subject_id", "code"], "ord").select("subject_id", "code", "version", "title", "days", "ord")


@frame(
    "last_wins",
    "SELECT subject_id, title, code, ord FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, title ORDER BY ord DESC) AS rn FROM {code_events}) WHERE rn = 1",
    "code_events",
)
def last_wins(codes):
    return relational.last_wins(codes, ["subject_id", "title"], "ord").select("subject_id", "title", "code", "ord")


sql("distinct_subject_label", "SELECT subject_id, label, min(doc_id) AS first_seen FROM (SELECT l.doc_id AS doc_id, l.doc_id % 97 AS subject_id, l.quality AS label FROM {labels} l) GROUP BY subject_id, label")
sql("label_conflicts", "SELECT subject_id, count(DISTINCT label) AS n_labels, count(*) AS n FROM (SELECT doc_id % 97 AS subject_id, quality AS label FROM {labels}) GROUP BY subject_id HAVING count(DISTINCT label) > 1")
sql("label_distribution", "SELECT label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM {subject_labels} GROUP BY label")


@frame(
    "stratified_split",
    """SELECT subject_id, label, CASE WHEN rn <= floor(n * 8 / 10) THEN 'train' WHEN rn <= floor(n * 8 / 10) + floor((n - floor(n * 8 / 10)) / 2) THEN 'val' ELSE 'test' END AS split FROM (
         SELECT subject_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(subject_id AS STRING)), subject_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM {subject_labels})""",
    "subject_labels",
)
def stratified_split(labels):
    return relational.stratified_split(labels, "subject_id", "label", seed=42)


sql("seeded_sample", "SELECT subject_id, label FROM (SELECT subject_id, label FROM {subject_labels} ORDER BY md5('42|' || CAST(subject_id AS STRING)), subject_id LIMIT 20) ORDER BY subject_id")


@frame(
    "contiguous_batches",
    """SELECT subject_id, CAST(floor((rn - 1) / CAST(ceil(n / 8.0) AS BIGINT)) AS INT) AS batch FROM (
         SELECT subject_id, row_number() OVER (ORDER BY subject_id) AS rn, count(*) OVER () AS n FROM {subject_labels})""",
    "subject_labels",
)
def contiguous_batches(labels):
    return relational.contiguous_batches(labels.select("subject_id"), "subject_id", 8)


@frame(
    "length_bucketed_order",
    """WITH m AS (SELECT note_id, length(text) AS n_chars, row_number() OVER (ORDER BY md5('7|' || CAST(note_id AS STRING)), note_id) - 1 AS rn FROM {note_events}),
       s AS (SELECT note_id, n_chars, CAST(floor(rn / 200) AS BIGINT) AS mega FROM m),
       o AS (SELECT note_id, n_chars, mega, row_number() OVER (ORDER BY mega, n_chars DESC, note_id) - 1 AS place, count(*) OVER () AS n FROM s)
       SELECT note_id, n_chars, mega, CAST(place % 4 AS INT) AS rank, CAST(floor(place / 4) AS BIGINT) AS step FROM o WHERE place < n - n % 4""",
    "note_events",
)
def length_bucketed_order(notes):
    from pyspark.sql import functions as F

    rows = notes.select("note_id", F.length("text").cast("long").alias("n_chars"))
    return relational.length_bucketed(rows, "note_id", "n_chars", world=4, per_rank=50, seed=7)


sql("roster_union", "SELECT subject_id FROM {subject_labels} UNION SELECT subject_id FROM {code_events}")
sql("subject_intersection", "SELECT subject_id FROM {subject_labels} INTERSECT SELECT subject_id FROM {code_events}")
sql("roster_except", "SELECT subject_id FROM {code_events} EXCEPT SELECT subject_id FROM {subject_labels}")

sql(
    "patient_assembly",
    """SELECT s.subject_id, s.label, coalesce(n.n, 0) AS n_notes, coalesce(c.n, 0) AS n_codes FROM {subject_labels} s
       LEFT JOIN (SELECT subject_id, count(*) AS n FROM {note_events} GROUP BY subject_id) n ON n.subject_id = s.subject_id
       LEFT JOIN (SELECT subject_id % 97 AS subject_id, count(*) AS n FROM {code_events} GROUP BY subject_id % 97) c ON c.subject_id = s.subject_id""",
)

sql("note_chronology", "SELECT subject_id, note_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY CASE WHEN note_id % 7 = 0 THEN NULL ELSE charttime END ASC NULLS LAST, note_id) AS BIGINT) AS place FROM {note_events}")

sql(
    "code_history_dedup",
    """SELECT subject_id, code, version, age, days, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY days DESC NULLS LAST, ord) AS BIGINT) AS place FROM (
         SELECT *, row_number() OVER (PARTITION BY subject_id, code, version, age ORDER BY days DESC NULLS LAST, ord) AS rn FROM (
           SELECT subject_id, code, version, CAST(40 + subject_id % 30 AS INT) AS age, CASE WHEN code % 13 = 0 THEN NULL ELSE days END AS days, ord FROM {code_events})) WHERE rn = 1""",
)

sql(
    "rank_slices",
    """WITH c AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS slice_rank FROM {events}),
       r AS (SELECT user_id, event_id, max(value) AS value FROM {events} WHERE event_type <> 'error' GROUP BY user_id, event_id)
       SELECT c.user_id, CAST(c.slice_rank AS INT) AS slice_rank, c.event_id, c.event_type, round(r.value, 4) AS value FROM c JOIN r ON c.user_id = r.user_id AND c.event_id = r.event_id WHERE c.slice_rank <= 10""",
)

sql(
    "cache_keys",
    "SELECT event_id, sha1('judge|' || CAST(subject_id AS STRING) || '|' || trust) AS cache_key FROM {verdicts}",
)
sql(
    "cache_antijoin",
    """SELECT w.event_id, w.cache_key FROM (SELECT event_id, sha1('judge|' || CAST(subject_id AS STRING) || '|' || trust) AS cache_key FROM {verdicts}) w
       LEFT JOIN (SELECT DISTINCT sha1('judge|' || CAST(subject_id AS STRING) || '|' || trust) AS cache_key FROM {verdicts} WHERE trust = 'click') c
       ON w.cache_key = c.cache_key WHERE c.cache_key IS NULL""",
)
sql("baseline_name", "SELECT DISTINCT regexp_extract(p, '([^/]+)/predictions_([^/]+)[.]jsonl$', 1) || '/' || regexp_extract(p, '([^/]+)/predictions_([^/]+)[.]jsonl$', 2) AS baseline, method FROM (SELECT method, '/data/run' || CAST(subject_id % 3 AS STRING) || '/predictions_' || method || '.jsonl' AS p FROM {predictions})")
sql("anneal_schedule", "SELECT CAST(s AS BIGINT) AS step, round(CAST(CASE WHEN s < 20 THEN s / 20.0 ELSE 1.0 END AS DOUBLE), 6) AS warm, round(CAST(CASE WHEN s >= 100 THEN 0.1 ELSE 1.0 - 0.9 * s / 100.0 END AS DOUBLE), 6) AS temperature FROM (SELECT note_id AS s FROM {note_events})")

sql(
    "roster_misses",
    """SELECT count(*) AS n, count(*) FILTER (WHERE v.subject_id IS NULL) AS without_vectors, round(sum(coalesce(v.n, 0)) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS mean_vectors
       FROM {subject_labels} s LEFT JOIN (SELECT subject_id, count(*) AS n FROM {note_vectors} GROUP BY subject_id) v ON v.subject_id = s.subject_id""",
)
sql(
    "rank_misses",
    """SELECT count(*) AS n, count(*) FILTER (WHERE r.event_id IS NOT NULL) AS matched, count(*) FILTER (WHERE r.event_id IS NULL) AS dropped FROM {events} c
       LEFT JOIN (SELECT user_id, event_id, max(value) AS value FROM {events} WHERE event_type <> 'error' GROUP BY user_id, event_id) r ON r.user_id = c.user_id AND r.event_id = c.event_id""",
)
sql(
    "mean_counts",
    """SELECT count(*) AS n, round(coalesce(sum(n_notes), 0) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS mean_notes, round(coalesce(sum(n_codes), 0) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS mean_codes,
         round(coalesce(sum(CASE WHEN n_codes > 3 THEN n_codes END), 0) / CAST(greatest(count(*) FILTER (WHERE n_codes > 3), 1) AS DOUBLE), 6) AS mean_many FROM (
         SELECT s.subject_id, coalesce(max(n.n), 0) AS n_notes, coalesce(max(c.n), 0) AS n_codes FROM {subject_labels} s
         LEFT JOIN (SELECT subject_id, count(*) AS n FROM {note_events} GROUP BY subject_id) n ON n.subject_id = s.subject_id
         LEFT JOIN (SELECT subject_id, count(*) AS n FROM {code_events} GROUP BY subject_id) c ON c.subject_id = s.subject_id GROUP BY s.subject_id) x""",
)
@frame("prefixed_verdicts", "SELECT t.flag_id, t.type_a, v.agree AS verdict_agree, v.severity AS verdict_severity FROM {flag_tasks} t JOIN {flag_verdicts} v ON v.flag_id = t.flag_id", "flag_tasks", "flag_verdicts")
def prefixed_verdicts(tasks, verdicts):
    return tasks.select("flag_id", "type_a").join(relational.prefixed(verdicts, "verdict_", "flag_id"), "flag_id")


@frame("positional_metadata", "SELECT i.vec_id, i.g AS global_index, m.vec_id AS found_id, m.days FROM (SELECT vec_id, (vec_id * 37 + 11) % count(*) OVER () AS g FROM {note_vectors}) i JOIN (SELECT vec_id, days, row_number() OVER (ORDER BY vec_id) - 1 AS row_index FROM {note_vectors}) m ON m.row_index = i.g", "note_vectors")
def positional_metadata(notes):
    """Items joined to the row at a position: positions are row numbers of a stated order."""
    n = notes.agg(F.count(F.lit(1)).alias("n"))
    items = notes.select("vec_id").join(F.broadcast(n)).select("vec_id", ((F.col("vec_id") * 37 + 11) % F.col("n")).alias("global_index"))
    rows = relational.with_row_index(notes.select(F.col("vec_id").alias("found_id"), "days"), "found_id")
    return items.join(rows, items["global_index"] == rows["row_index"]).select("vec_id", "global_index", "found_id", "days")


@frame("gathered_shards", "SELECT subject_id, method, round(max(probability), 6) AS probability FROM {predictions} GROUP BY subject_id, method", "predictions")
def gathered_shards(predictions):
    """Scores of eight ranks, each with its own files and the last ones padded with first rows so that all have as many; gathered from the files with one row a
    subject and method, a padded row being left out where the first one is."""
    import uuid

    from marlow.operators.ordering import settled, shared_folder
    from marlow.sources import io

    spark = predictions.sparkSession
    rows = relational.with_row_index(predictions.select("subject_id", "method", "probability"), "subject_id", "method")
    n = rows.count()
    padding = rows.where(F.col("row_index") < -n % 8).withColumn("row_index", F.col("row_index") + n)
    path = f"{shared_folder(spark)}/marlow/{uuid.uuid4().hex}"
    io.write_jsonl(rows.unionByName(padding).withColumn("rank", (F.col("row_index") % 8).cast("int")), path, by=["rank"])
    files = io.read_jsonl(spark, path, "subject_id long, method string, probability double, row_index long, rank int")
    out = settled(relational.keep_first(files, ["subject_id", "method"], "row_index").select("subject_id", "method", F.round("probability", 6).alias("probability")))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    return out
