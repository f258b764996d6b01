"""Evidence retrieval over vectors: normalise, score, top k, dedup, pooling and attention."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlow.functions import vectors
from marlow.operators import retrieval
from marlow.plans.catalog import frame, sql

DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _dot(a: str, b: str) -> str:
    return DOT.replace("{a}", a).replace("{b}", b)


COS = f"{_dot('v.vector', 'q.vector')} / (greatest(sqrt({_dot('v.vector', 'v.vector')}), 1e-8) * greatest(sqrt({_dot('q.vector', 'q.vector')}), 1e-8))"


def _scores(side: str, modality: str) -> str:
    return f"SELECT v.subject_id, v.vec_id, v.days, q.query_idx, round({COS}, 4) AS score FROM {{{side}}} v JOIN {{query_vectors}} q ON q.modality = '{modality}'"


def _topk(side: str, modality: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id, query_idx ORDER BY score DESC, vec_id) AS INT) AS rank FROM ({_scores(side, modality)})) WHERE rank <= {k}"


def _first(side: str, modality: str, k: int = 4) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, vec_id ORDER BY query_idx, rank) AS n FROM ({_topk(side, modality, k)})) WHERE n = 1"


def hits(chunks, queries, modality: str, k: int = 4):
    scores = retrieval.scored(chunks, queries.where(F.col("modality") == modality))
    return retrieval.top_k(scores, k, ["subject_id", "query_idx"]).select("subject_id", "vec_id", "days", "query_idx", "score", "rank")


@frame("rag_topk_notes", _topk("note_vectors", "Note", 4), "note_vectors", "query_vectors")
def rag_topk_notes(notes, queries):
    return hits(notes, queries, "Note")


@frame("rag_topk_codes", _topk("code_vectors", "Code", 4), "code_vectors", "query_vectors")
def rag_topk_codes(codes, queries):
    return hits(codes, queries, "Code")


@frame(
    "rag_dedup_union",
    f"""SELECT 'Note' AS modality, subject_id, vec_id, days, query_idx, score, rank FROM ({_first('note_vectors', 'Note')})
        UNION ALL SELECT 'Code', subject_id, vec_id, days, query_idx, score, rank FROM ({_first('code_vectors', 'Code')})""",
    "note_vectors",
    "code_vectors",
    "query_vectors",
)
def rag_dedup_union(notes, codes, queries):
    out = [retrieval.first_across_queries(hits(c, queries, m)).withColumn("modality", F.lit(m)) for c, m in ((notes, "Note"), (codes, "Code"))]
    return out[0].unionByName(out[1]).select("modality", "subject_id", "vec_id", "days", "query_idx", "score", "rank")


@frame(
    "rag_records",
    f"""SELECT subject_id, count(*) AS n_items, 'Retrieved notes: ' || CAST(count(*) AS STRING) || chr(10) ||
          string_agg('[' || CAST(vec_id AS STRING) || ', ' || CAST(days AS STRING) || ' days]', chr(10) ORDER BY days DESC, query_idx, rank) AS record FROM ({_first('note_vectors', 'Note')}) GROUP BY subject_id""",
    "note_vectors",
    "query_vectors",
)
def rag_records(notes, queries):
    kept = retrieval.first_across_queries(hits(notes, queries, "Note"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("days")).alias("a"), "query_idx", "rank", "vec_id", "days")))
    grouped = kept.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_items"), items.alias("items"))
    lines = F.transform("items", lambda x: F.concat(F.lit("["), x["vec_id"].cast("string"), F.lit(", "), x["days"].cast("string"), F.lit(" days]")))
    return grouped.select("subject_id", "n_items", F.concat(F.lit("Retrieved notes: "), F.col("n_items").cast("string"), F.lit("\n"), F.array_join(lines, "\n")).alias("record"))


@frame("learned_topk", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id, query_idx ORDER BY score DESC, vec_id) AS INT) AS rank FROM (SELECT v.subject_id, v.vec_id, q.query_idx, round({_dot('v.vector', 'q.vector')} / greatest(sqrt({_dot('q.vector', 'q.vector')}), 1e-8), 4) AS score FROM {{note_vectors}} v CROSS JOIN {{query_vectors}} q)) WHERE rank <= 2", "note_vectors", "query_vectors")
def learned_topk(notes, queries):
    score = vectors.dot(F.col("vector"), F.col("query_vector")) / F.greatest(vectors.norm(F.col("query_vector")), F.lit(1e-8))
    return retrieval.top_k(retrieval.scored(notes, queries, score), 2, ["subject_id", "query_idx"]).select("subject_id", "vec_id", "query_idx", "score", "rank")


@frame(
    "sampled_topk",
    f"""WITH s AS ({_scores('note_vectors', 'Note')}), u AS (SELECT *, (HASH32[['7|' || CAST(subject_id AS STRING) || '|' || CAST(query_idx AS STRING) || '|' || CAST(vec_id AS STRING)]] + 1) / CAST(4294967298.0 AS DOUBLE) AS u FROM s),
        g AS (SELECT *, round(score / CAST(0.5 AS DOUBLE) - ln(-ln(u)), 6) AS noisy FROM u)
        SELECT subject_id, query_idx, vec_id, noisy, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id, query_idx ORDER BY noisy DESC, vec_id) AS INT) AS rank FROM g) WHERE rank <= 3""",
    "note_vectors",
    "query_vectors",
)
def sampled_topk(notes, queries):
    """Sampling without replacement by a temperature softmax: top k of scores with Gumbel noise."""
    s = retrieval.scored(notes, queries.where("modality = 'Note'"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("7"), "subject_id", "query_idx", "vec_id").cast("binary")), 1, 8), 16, 10).cast("long")
    u = (h + 1) / F.lit(4294967298.0)
    noisy = s.withColumn("noisy", F.round(F.col("score") / F.lit(0.5) - F.log(-F.log(u)), 6))
    return retrieval.top_k(noisy, 3, ["subject_id", "query_idx"], order="noisy").select("subject_id", "query_idx", "vec_id", "noisy", "rank")


@frame("cosine_scores", _scores("note_vectors", "Note"), "note_vectors", "query_vectors")
def cosine_scores(notes, queries):
    return retrieval.scored(notes, queries.where("modality = 'Note'")).select("subject_id", "vec_id", "days", "query_idx", "score")


@frame("dot_scores", f"SELECT v.vec_id, q.query_idx, round({_dot('v.vector', 'q.vector')} / greatest(sqrt({_dot('q.vector', 'q.vector')}), 1e-8), 4) AS score FROM {{code_vectors}} v CROSS JOIN {{query_vectors}} q", "code_vectors", "query_vectors")
def dot_scores(codes, queries):
    score = vectors.dot(F.col("vector"), F.col("query_vector")) / F.greatest(vectors.norm(F.col("query_vector")), F.lit(1e-8))
    return retrieval.scored(codes, queries, score).select("vec_id", "query_idx", "score")


@frame("l2_normalize", f"SELECT vec_id, i - 1 AS position, round(CAST(vector[i] AS DOUBLE) / greatest(sqrt({_dot('vector', 'vector')}), 1e-8), 6) AS x FROM {{note_vectors}}, unnest(range(1, len(vector) + 1)) t(i)", "note_vectors")
def l2_normalize(notes):
    return notes.select("vec_id", F.posexplode(vectors.l2_normalize(F.col("vector"))).alias("position", "x")).select("vec_id", F.col("position").cast("long").alias("position"), F.round("x", 6).alias("x"))


@frame(
    "nan_audit",
    """WITH b AS (SELECT vec_id, i - 1 AS p, CASE WHEN (vec_id + i - 1) % 37 = 0 THEN CAST('nan' AS DOUBLE) WHEN (vec_id + i - 1) % 41 = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(vector[i] AS DOUBLE) END AS x FROM {note_vectors}, unnest(range(1, len(vector) + 1)) t(i))
       SELECT vec_id, count(*) FILTER (WHERE isnan(x)) AS n_nan, count(*) FILTER (WHERE isinf(x)) AS n_inf,
         round(sum(CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END), 5) AS finite_sum, max(CASE WHEN isnan(x) THEN 0 WHEN isinf(x) THEN 3.4028234663852886e38 ELSE x END) > 1e38 AS clamped FROM b GROUP BY vec_id""",
    "note_vectors",
)
def nan_audit(notes):
    bad = F.transform(vectors.doubles(F.col("vector")), lambda x, i: F.when((F.col("vec_id") + i) % 37 == 0, F.lit(float("nan"))).when((F.col("vec_id") + i) % 41 == 0, F.lit(float("inf"))).otherwise(x))
    top = F.lit(1e38)
    rows = notes.select("vec_id", bad.alias("v")).withColumn("r", vectors.repaired(F.col("v")))
    finite = F.aggregate(F.filter("r", lambda x: F.abs(x) < top), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "vec_id",
        F.size(F.filter("v", F.isnan)).cast("long").alias("n_nan"),
        F.size(F.filter("v", lambda x: x == float("inf"))).cast("long").alias("n_inf"),
        F.round(finite, 5).alias("finite_sum"),
        (F.array_max("r") > top).alias("clamped"),
    )


sql("dim_audit", "SELECT size(embedding) AS dim, count(*) AS n, count(*) FILTER (WHERE size(embedding) <> 64) AS n_bad FROM {embeddings} GROUP BY size(embedding)", "SELECT CAST(len(embedding) AS INT) AS dim, count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS n_bad FROM {embeddings} GROUP BY len(embedding)")

_LONG = "SELECT subject_id, i - 1 AS position, avg(CAST(vector[i] AS DOUBLE)) AS x FROM {note_vectors}, unnest(range(1, len(vector) + 1)) t(i) GROUP BY subject_id, i"


def mean_pooled(chunks):
    """(subject_id, position, x): the mean vector of each subject, one row an element."""
    e = chunks.select("subject_id", F.posexplode(vectors.doubles(F.col("vector"))).alias("position", "x"))
    return e.groupBy("subject_id", F.col("position").cast("long").alias("position")).agg(F.avg("x").alias("x"))


@frame("mean_pool", f"SELECT subject_id, position, round(x, 6) AS x FROM ({_LONG})", "note_vectors")
def mean_pool(notes):
    return mean_pooled(notes).withColumn("x", F.round("x", 6))


_LN = f"SELECT subject_id, position, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5) AS x FROM ({_LONG}) WINDOW w AS (PARTITION BY subject_id)"


def summaries(notes):
    """Layer-normalised mean vector of each subject, by element."""
    w = Window.partitionBy("subject_id")
    p = mean_pooled(notes)
    return p.select("subject_id", "position", ((F.col("x") - F.avg("x").over(w)) / F.sqrt(F.var_pop("x").over(w) + 1e-5)).alias("x"))


@frame("summary_layernorm", f"SELECT subject_id, position, round(x, 5) AS x FROM ({_LN})", "note_vectors")
def summary_layernorm(notes):
    return summaries(notes).withColumn("x", F.round("x", 5))


#: What divides the scores before their softmax.
TEMPERATURE = 0.5


def chosen_sql(side: str, modality: str, k: int = 4) -> str:
    """The items that each query of a kind retrieves by the dot product with its direction, with that product."""
    raw = f"SELECT v.subject_id, v.vec_id, v.days, v.vector, q.query_idx, {_dot('v.vector', 'q.vector')} / greatest(sqrt({_dot('q.vector', 'q.vector')}), 1e-8) AS raw FROM {{{side}}} v JOIN {{query_vectors}} q ON q.modality = '{modality}'"
    return f"SELECT *, '{modality}' AS modality FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id, query_idx ORDER BY round(raw, 4) DESC, vec_id) AS INT) AS rank FROM ({raw})) WHERE rank <= {k}"


def weighted_sql(side: str, modality: str) -> str:
    """The softmax-weighted sum of what each query retrieved, one row an element."""
    a = f"SELECT *, exp(raw / {TEMPERATURE}) / sum(exp(raw / {TEMPERATURE})) OVER (PARTITION BY subject_id, query_idx) AS a FROM ({chosen_sql(side, modality)})"
    return f"SELECT subject_id, modality, query_idx, i - 1 AS position, sum(a * CAST(vector[i] AS DOUBLE)) AS x FROM ({a}) w, unnest(range(1, len(vector) + 1)) t(i) GROUP BY subject_id, modality, query_idx, i"


@frame("linear_attention", f"SELECT subject_id, query_idx, position, round(x, 5) AS x FROM ({weighted_sql('note_vectors', 'Note')})", "note_vectors", "query_vectors")
def linear_attention(notes, queries):
    """Softmax-weighted sum of the retrieved vectors of each subject and query: the dot product with the query's direction, over a temperature."""
    from marlow.operators import gating

    asked = queries.where("modality = 'Note'")
    kept = gating.chosen(notes, asked).withColumn("e", F.exp(F.col("raw") / TEMPERATURE))
    total = F.sum("e").over(Window.partitionBy("subject_id", "query_idx"))
    e = kept.withColumn("a", F.col("e") / total).select("subject_id", "query_idx", "a", F.posexplode(vectors.doubles(F.col("vector"))).alias("position", "x"))
    return e.groupBy("subject_id", "query_idx", F.col("position").cast("long").alias("position")).agg(F.round(F.sum(F.col("a") * F.col("x")), 5).alias("x"))


EVERY = 50


def searched(embeddings, k: int = 4):
    """The index of all vectors, the queries (every vector whose id is divisible by 50), and what it finds."""
    from marlow.operators import ann

    index = ann.build(embeddings)
    asked = index.rows.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "vector")
    return index, asked, ann.search(index, asked, k, *ann.settings_for(index, asked, k))


@frame("ann_topk", None, "embeddings")
def ann_topk(embeddings):
    """The four nearest vectors of every fiftieth one by the index."""
    return searched(embeddings)[2].select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@frame("ann_recall", f"SELECT count(*) AS n_queries, TRUE AS reached FROM {{embeddings}} WHERE vec_id % {EVERY} = 0", "embeddings")
def ann_recall(embeddings):
    """Whether the index finds nine of ten of the four true neighbours of all queries."""
    from marlow.operators import ann

    index, asked, found = searched(embeddings)
    true = ann.exact(index.rows, asked, 4)
    hit = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("reached"))
