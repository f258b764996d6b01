"""Model inference on vectors: gates, fusion, closed-form attribution; numpy kernels by subject."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlow.functions import vectors
from marlow.plans.catalog import frame
from marlow.operators import gating
from marlow.plans.retrieval import _LN, chosen_sql, summaries, weighted_sql
from marlow.plans.texts import CHUNKS

WEIGHT = "(((i * 37) % 64) - 31.5) / CAST(64 AS DOUBLE)"


def weight(position):
    """A fixed head: no trained weights exist."""
    return ((position * 37) % 64 - F.lit(31.5)) / F.lit(64.0)


#: Most queries that are sent to every executor.
MOST_QUERIES = 4096
THETA = -0.02
LN_CODE = _LN.replace("{note_vectors}", "{code_vectors}")
Q_LONG = "SELECT query_idx, modality, i - 1 AS position, CAST(vector[i] AS DOUBLE) AS x FROM {query_vectors}, unnest(range(1, len(vector) + 1)) t(i)"
GATES = " UNION ALL ".join(
    f"SELECT s.subject_id, q.modality, q.query_idx, sum(s.x * q.x) / (sqrt(sum(s.x * s.x)) * sqrt(sum(q.x * q.x))) AS cos FROM ({side}) s JOIN ({Q_LONG}) q ON s.position = q.position WHERE q.modality = '{m}' GROUP BY s.subject_id, q.modality, q.query_idx"
    for m, side in (("Note", _LN), ("Code", LN_CODE))
)
OPEN = f"query_idx = 0 OR 1 / (1 + exp(-round(cos, 4))) > 1 / (1 + exp(CAST({-THETA} AS DOUBLE)))"


def few(queries):
    """``queries`` for a broadcast join, counted first."""
    if (n := queries.count()) > MOST_QUERIES:
        raise ValueError(f"{n} queries, more than {MOST_QUERIES}")
    return F.broadcast(queries)


def packed_summaries(vectors_):
    s = summaries(vectors_).groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("position", "x"))).alias("v"))
    return s.select("subject_id", F.transform("v", lambda e: e["x"]).alias("v"))


def gates(notes, codes, queries, static: bool = False):
    """Cosine of each subject's summary of a kind with the queries of that kind, and whether the gate is open: where its logistic is
    above theta's.  Query 0 is always open; with ``static`` all are."""
    out = None
    for modality, rows in (("Note", notes), ("Code", codes)):
        q = few(queries.where(F.col("modality") == modality).select("modality", "query_idx", F.col("vector").alias("q")))
        g = packed_summaries(rows).join(q).select("subject_id", "modality", "query_idx", F.round(vectors.cosine(F.col("v"), F.col("q")), 4).alias("cos"))
        out = g if out is None else out.unionByName(g)
    above = 1 / (1 + F.exp(-F.col("cos"))) > 1 / (1 + F.exp(F.lit(-THETA)))
    return out.withColumn("open", F.lit(True) if static else (F.col("query_idx") == 0) | above)


@frame("gating_mask", f"SELECT subject_id, modality, query_idx, round(cos, 4) AS cos, {OPEN} AS open FROM ({GATES})", "note_vectors", "code_vectors", "query_vectors")
def gating_mask(notes, codes, queries):
    return gates(notes, codes, queries)


@frame("static_gates", f"SELECT subject_id, count(*) AS n, count(*) AS n_open, CAST(sum(CASE WHEN {OPEN} THEN 1 ELSE 0 END) AS BIGINT) AS n_dynamic FROM ({GATES}) GROUP BY subject_id", "note_vectors", "code_vectors", "query_vectors")
def static_gates(notes, codes, queries):
    """The ablation without gates beside the dynamic ones: how many are open."""
    dynamic = gates(notes, codes, queries).groupBy("subject_id").agg(F.count_if("open").alias("n_dynamic"))
    static = gates(notes, codes, queries, static=True).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"))
    return static.join(dynamic, "subject_id")


#: SQL of the model's weights by query, place in the vector and place in the hidden layer (see ``Gated.fixed``), and of the error function by its series.
_H = 16
_W1, _B1 = "((p.position * 31 + j * 17 + p.query_idx * 13) % 61 - 30) / CAST(150 AS DOUBLE)", "((j * 7 + query_idx * 3) % 11 - 5) / CAST(50 AS DOUBLE)"
_W2, _B2 = "((j * 29 + t.i * 19 + query_idx * 7) % 53 - 26) / CAST(100 AS DOUBLE)", "((i * 5 + query_idx * 11) % 13 - 6) / CAST(100 AS DOUBLE)"
_ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 70), lambda n: power(-1, n) * power(y, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"
#: Every expert's output: what attention gathers, and a residual of layer norm, linear, GELU, linear.
EXPERTS = f"""x AS (SELECT * FROM ({weighted_sql('note_vectors', 'Note')}) UNION ALL SELECT * FROM ({weighted_sql('code_vectors', 'Code')})),
  z AS (SELECT *, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5) AS z FROM x WINDOW w AS (PARTITION BY subject_id, query_idx)),
  pre AS (SELECT subject_id, query_idx, j, sum(z * ({_W1})) + {_B1} AS h FROM z p, unnest(range(0, {_H})) t(j) GROUP BY subject_id, query_idx, j),
  act AS (SELECT subject_id, query_idx, j, 0.5 * h * (1 + {_ERF.replace('y,', '(h / sqrt(2)),')}) AS g FROM pre),
  o AS (SELECT subject_id, query_idx, i AS position, sum(g * ({_W2})) + {_B2} AS delta FROM act, unnest(range(0, 64)) t(i) GROUP BY subject_id, query_idx, i),
  e AS (SELECT x.subject_id, x.modality, x.query_idx, x.position, x.x + o.delta AS x FROM x JOIN o ON o.subject_id = x.subject_id AND o.query_idx = x.query_idx AND o.position = x.position),
  m AS (SELECT e.* FROM e JOIN (SELECT subject_id, query_idx FROM ({GATES}) WHERE {OPEN}) g ON g.subject_id = e.subject_id AND g.query_idx = e.query_idx)"""
_HEAD = WEIGHT.replace("i *", "position *")


@frame(
    "fused_score",
    f"""WITH {EXPERTS}, f AS (SELECT subject_id, position, avg(x) AS x FROM m GROUP BY subject_id, position), n AS (SELECT *, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5) AS z FROM f WINDOW w AS (PARTITION BY subject_id))
        SELECT subject_id, round(1 / (1 + exp(-sum(z * ({_HEAD})))), 4) AS p FROM n GROUP BY subject_id""",
    "note_vectors",
    "code_vectors",
    "query_vectors",
)
def fused_score(notes, codes, queries):
    """Addition fusion: the mean of all open experts, layer-normalised, through a linear head."""
    return gating.scored(gating.brought(notes, codes, queries, gates(notes, codes, queries)), gating.fixed(queries)).select("subject_id", F.round("p", 4).alias("p"))


@frame(
    "concat_fused_score",
    f"""WITH {EXPERTS}, f AS (SELECT subject_id, modality, position, avg(x) AS x FROM m GROUP BY subject_id, modality, position), n AS (SELECT *, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5) AS z FROM f WINDOW w AS (PARTITION BY subject_id, modality))
        SELECT subject_id, round(1 / (1 + exp(-sum(CASE WHEN modality = 'Note' THEN z ELSE -z END * ({_HEAD})))), 4) AS p FROM n GROUP BY subject_id""",
    "note_vectors",
    "code_vectors",
    "query_vectors",
)
def concat_fused_score(notes, codes, queries):
    """Concatenation fusion: open note experts and open code experts averaged and layer-normalised apart, then side by side through one head
    (the codes' half has the weights with their signs turned)."""
    return gating.scored(gating.brought(notes, codes, queries, gates(notes, codes, queries)), gating.fixed(queries, concat=True)).select("subject_id", F.round("p", 4).alias("p"))


@frame(
    "active_query_averages",
    f"""WITH g AS (SELECT subject_id, modality, query_idx, {OPEN} AS open FROM ({GATES})), n AS (SELECT subject_id, count(*) FILTER (WHERE open AND query_idx > 0) AS dyn, count(*) FILTER (WHERE open AND modality = 'Note') AS note, count(*) FILTER (WHERE open AND modality = 'Code') AS code FROM g GROUP BY subject_id)
        SELECT count(*) AS n, round(avg(dyn), 6) AS dynamic, round(avg(note), 6) AS notes, round(avg(code), 6) AS codes FROM n""",
    "note_vectors",
    "code_vectors",
    "query_vectors",
)
def active_query_averages(notes, codes, queries):
    """How many queries are open in a subject on average: all but the first, those over notes, those over codes."""
    kinds = {"dynamic": F.col("query_idx") > 0, "notes": F.col("modality") == "Note", "codes": F.col("modality") == "Code"}
    g = gates(notes, codes, queries).groupBy("subject_id").agg(*[F.count_if(F.col("open") & c).alias(name) for name, c in kinds.items()])
    return g.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(name), 6).alias(name) for name in kinds])


@frame(
    "active_items",
    f"""SELECT h.subject_id, count(*) AS n_items, string_agg(CAST(h.query_idx AS STRING) || ':' || CAST(h.vec_id AS STRING) || '@' || CAST(h.days AS STRING), ',' ORDER BY h.query_idx, h.rank) AS items
        FROM (SELECT subject_id, query_idx, vec_id, days, rank FROM ({chosen_sql('note_vectors', 'Note')}) UNION ALL SELECT subject_id, query_idx, vec_id, days, rank FROM ({chosen_sql('code_vectors', 'Code')})) h
        JOIN (SELECT subject_id, query_idx FROM ({GATES}) WHERE {OPEN}) g ON g.subject_id = h.subject_id AND g.query_idx = h.query_idx GROUP BY h.subject_id""",
    "note_vectors",
    "code_vectors",
    "query_vectors",
)
def active_items(notes, codes, queries):
    """Retrieved items of the queries of both kinds whose gate is open, with their metadata."""
    active = gates(notes, codes, queries).where("open").select("subject_id", "query_idx")
    kept = gating.selected(notes, codes, queries).select("subject_id", "query_idx", "vec_id", "days", "rank").join(active, ["subject_id", "query_idx"])
    g = kept.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list(F.struct("query_idx", "rank", "vec_id", "days"))).alias("x"))
    line = F.transform("x", lambda e: F.concat(e["query_idx"].cast("string"), F.lit(":"), e["vec_id"].cast("string"), F.lit("@"), e["days"].cast("string")))
    return g.select("subject_id", "n_items", F.array_join(line, ",").alias("items"))


SIMPLICITY = 0.1


@frame(
    "query_diversity",
    f"""WITH q AS (SELECT * FROM ({Q_LONG}) WHERE query_idx > 0), g AS (SELECT a.query_idx AS a, b.query_idx AS b, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS c FROM q a JOIN q b ON a.position = b.position GROUP BY a.query_idx, b.query_idx),
          d AS (SELECT sum(power(c - CASE WHEN a = b THEN 1 ELSE 0 END, 2)) AS diversity FROM g), s AS (SELECT sum(x * x) / count(DISTINCT query_idx) AS simplicity, count(DISTINCT query_idx) AS n FROM q)
        SELECT n, round(diversity, 5) AS diversity, round(simplicity, 5) AS simplicity, round(diversity + {SIMPLICITY} * simplicity, 5) AS loss FROM d CROSS JOIN s""",
    "query_vectors",
)
def query_diversity(queries):
    """Auxiliary loss of the queries but the first: squared Frobenius distance of their cosine matrix from the identity, and their mean
    squared norm.  The matrix of a bounded number of queries."""
    from pyspark.sql.functions import broadcast

    dynamic = few(queries.where("query_idx > 0"))
    a = dynamic.select(F.col("query_idx").alias("a"), F.col("vector").alias("x"))
    b = broadcast(queries.where("query_idx > 0").select(F.col("query_idx").alias("b"), F.col("vector").alias("y")))
    d = vectors.cosine(F.col("x"), F.col("y")) - (F.col("a") == F.col("b")).cast("int")
    own = F.when(F.col("a") == F.col("b"), vectors.dot(F.col("x"), F.col("x")))
    s = a.join(b).agg(F.sum(d * d).alias("diversity"), F.avg(own).alias("simplicity"), F.count(own).alias("n"))
    return s.select("n", F.round("diversity", 5).alias("diversity"), F.round("simplicity", 5).alias("simplicity"), F.round(F.col("diversity") + SIMPLICITY * F.col("simplicity"), 5).alias("loss"))


@frame("mean_pool_mlp", None, "note_vectors", "code_vectors")
def mean_pool_mlp(notes, codes):
    """The mean-pool baseline: note mean and code mean side by side through linear, GELU, layer norm, linear; a missing side is zero."""
    dim = vectors.width(notes, codes)
    n, c = ({m: f for m, f in zip(("notes", "codes"), (notes, codes))}[m].select("subject_id", vectors.doubles(F.col("vector")).alias("v")) for m in ("notes", "codes"))
    pool = lambda rows, name: rows.select("subject_id", F.posexplode("v").alias("i", "x")).groupBy("subject_id", "i").agg(F.avg("x").alias("x")).groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias(name))
    both = pool(n, "a").join(pool(c, "b"), "subject_id", "full")
    zero = F.array_repeat(F.lit(0.0), dim)
    z = both.select("subject_id", F.concat(*[F.coalesce(F.transform(x, lambda e: e["x"]), zero) for x in ("a", "b")]).alias("z"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from marlow.functions.networks import MeanPoolMlp

        head = MeanPoolMlp(2 * dim, 16, 7)
        for b in batches:
            p = head.probability(np.stack(b["z"].to_numpy())) if len(b) else np.empty(0)
            yield pd.DataFrame({"subject_id": b["subject_id"], "p": p.round(6)})

    return z.mapInPandas(run, "subject_id long, p double")


@frame(
    "ig_linear_closed_form",
    f"SELECT vec_id, subject_id, round(sum(CAST(vector[i] AS DOUBLE) * ({WEIGHT.replace('i *', '(i - 1) *')})) / max(n), 6) AS attribution FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM {{note_vectors}}), unnest(range(1, len(vector) + 1)) t(i) GROUP BY vec_id, subject_id",
    "note_vectors",
)
def ig_linear_closed_form(notes):
    """Integrated gradients of a linear head on the mean vector: each item's own share."""
    n = F.count(F.lit(1)).over(Window.partitionBy("subject_id"))
    own = F.aggregate(F.transform(vectors.doubles(F.col("vector")), lambda x, i: x * weight(i)), F.lit(0.0), lambda a, x: a + x)
    return notes.select("vec_id", "subject_id", F.round(own / n, 6).alias("attribution"))


@frame("mil_scores", None, "note_vectors", "code_vectors")
def mil_scores(notes, codes):
    """Gated-attention MIL over the bag of all note and code vectors of a subject.  An item gives two numbers, its attention and
    its value under the head; a bag is then sums of these, added up on the map side, however large it is."""
    dim = vectors.width(notes, codes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from marlow.functions.networks import GatedMil

        net = GatedMil(dim, 16, 5)
        for b in batches:
            if len(b):
                a, h = net.items(np.stack(b["vector"].to_numpy()).astype(float))
                yield pd.DataFrame({"subject_id": b["subject_id"], "a": a, "h": h})

    from marlow.functions.networks import GatedMil as Net

    cols = ["subject_id", "vector"]
    items_ = notes.select(*cols).unionByName(codes.select(*cols)).mapInPandas(run, "subject_id long, a double, h double")
    g = items_.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_items"), (F.sum(F.col("a") * F.col("h")) / F.sum("a") + Net(1, 1, 5).bias).alias("z"))
    return g.select("subject_id", "n_items", F.round(1 / (1 + F.exp(-F.col("z"))), 6).alias("p"))


@frame("expert_scores", None, "note_vectors", "code_vectors", "query_vectors")
def expert_scores(notes, codes, queries):
    """The items of each query with the subject's fused probability and their shares in it: integrated gradients through the whole
    model, from zero and from the mean of all items that the subject's queries selected, and what the shares miss of the probabilities' difference."""
    return gating.attributed(gating.brought(notes, codes, queries, gates(notes, codes, queries)), gating.fixed(queries))


@frame("encode_chunks", None, "note_events")
def encode_chunks(notes):
    """Chunks through an encoder fitted to them."""
    from marlow.operators import encoding
    from marlow.plans.texts import chunked

    chunks = chunked(notes).select("note_id", "chunk_no", "chunk")
    return encoding.encoded(chunks, "chunk", encoding.fitted(chunks, "chunk")).select("note_id", "chunk_no", "vector")


@frame("encoded_copies", rf"{CHUNKS} SELECT count(*) AS n, TRUE AS reached FROM c WHERE len(regexp_extract_all(chunk, '\S+')) >= 50", "note_events")
def encoded_copies(notes):
    """Whether copies that lack every fifth word lie nearer to their chunk than to another (the next by id) in 19 cases of 20; the encoder knows the
    chunks, not the copies."""
    from marlow.operators import encoding
    from marlow.plans.texts import chunked

    chunks = chunked(notes).select("note_id", "chunk_no", "chunk")
    words = F.regexp_extract_all("chunk", F.lit(r"\S+"), F.lit(0))
    long = chunks.where(F.size(words) >= 50)
    copies = long.withColumn("copy", F.array_join(F.filter(words, lambda w, i: i % 5 != 4), " "))
    e = encoding.fitted(chunks, "chunk")
    own = encoding.encoded(copies, "chunk", e).withColumnRenamed("vector", "v")
    both = encoding.encoded(own, "copy", e).select("note_id", "chunk_no", "v", F.col("vector").alias("c"))
    other = F.coalesce(F.lead("v").over(Window.partitionBy(F.pmod(F.xxhash64("note_id"), F.lit(64))).orderBy("note_id", "chunk_no")), F.array_repeat(F.lit(0.0).cast("float"), encoding.WIDTH))
    near = both.withColumn("other", other).select((vectors.cosine(F.col("c"), F.col("v")) > vectors.cosine(F.col("c"), F.col("other"))).alias("near"))
    return near.agg(F.count(F.lit(1)).alias("n"), (F.count_if("near") >= 0.95 * F.count(F.lit(1))).alias("reached"))


_BAG = "SELECT subject_id, CAST(subject_id / 8 AS BIGINT) AS batch, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY vec_id) AS INT) AS place, vector FROM {note_vectors}".replace("CAST(subject_id / 8 AS BIGINT)", "subject_id // 8")


@frame(
    "padded_bags",
    f"""WITH r AS ({_BAG}), n AS (SELECT subject_id, batch, count(*) AS n FROM r GROUP BY subject_id, batch), l AS (SELECT batch, max(n) AS longest FROM n GROUP BY batch)
        SELECT n.subject_id, n.batch, CAST(t.place AS INT) AS place, t.place <= n.n AS mask, round(coalesce(list_sum(list_transform(r.vector, lambda x: CAST(x AS DOUBLE))), 0), 5) AS total, CAST(coalesce(len(r.vector), 64) AS INT) AS width
        FROM n JOIN l ON l.batch = n.batch, unnest(range(1, l.longest + 1)) t(place) LEFT JOIN r ON r.subject_id = n.subject_id AND r.place = t.place""",
    "note_vectors",
)
def padded_bags(notes):
    """The vectors of each subject, all of them, filled up with zero vectors to the longest bag of its batch (eight subjects), and a mask of what is real.  A bag is
    its rows by place; it is never one value."""
    padded = gating.padded_bags(notes.withColumn("batch", F.floor(F.col("subject_id") / 8).cast("long")))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return padded.select("subject_id", "batch", "place", "mask", F.round(total, 5).alias("total"), F.size("vector").alias("width"))


@frame("encoded_gates", None, "note_vectors", "code_vectors", "query_vectors")
def encoded_gates(notes, codes, queries):
    """Gates of summaries through an encoder layer, beside those of plain means: (subject_id, modality, query_idx, cos, open, open_of_means)."""
    from marlow.functions.encoder import Layer

    layer = Layer.fixed(vectors.width(notes))
    w = Window.partitionBy("subject_id", "modality")
    sides = [gating.encoded_summaries(rows, layer).withColumn("modality", F.lit(m)) for m, rows in (("Note", notes), ("Code", codes))]
    x = sides[0].unionByName(sides[1]).select("subject_id", "modality", F.posexplode("v").alias("i", "x"))
    normed = x.withColumn("x", (F.col("x") - F.avg("x").over(w)) / F.sqrt(F.var_pop("x").over(w) + 1e-5)).groupBy("subject_id", "modality").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    q = few(queries.select("modality", "query_idx", F.col("vector").alias("q")))
    cos = F.round(vectors.cosine(F.transform("v", lambda e: e["x"]), F.col("q")), 4)
    g = normed.join(q, "modality").select("subject_id", "modality", "query_idx", cos.alias("cos"))
    above = 1 / (1 + F.exp(-F.col("cos"))) > 1 / (1 + F.exp(F.lit(-THETA)))
    plain = gates(notes, codes, queries).select("subject_id", "modality", "query_idx", F.col("open").alias("open_of_means"))
    return g.withColumn("open", (F.col("query_idx") == 0) | above).join(plain, ["subject_id", "modality", "query_idx"])


@frame("trained_gates", None, "note_vectors", "code_vectors", "query_vectors", "subject_labels")
def trained_gates(notes, codes, queries, labels):
    """The gated model trained for two epochs on four subjects of five, its state written each epoch, and all subjects asked: (subject_id,
    part, label, p)."""
    import uuid

    from marlow.operators import training
    from marlow.operators.ordering import settled, shared_folder

    spark = notes.sparkSession
    path = f"{shared_folder(spark)}/marlow/{uuid.uuid4().hex}"
    part = F.when(F.pmod(F.xxhash64("subject_id"), F.lit(5)) == 0, "val").otherwise("train")
    known = settled(labels.select("subject_id", "label", part.alias("part")).join(notes.select("subject_id").distinct(), "subject_id", "left_semi"))
    model, _ = training.fit(notes, codes, known, gating.fixed(queries), training.Plan(num_epochs=2, batches=2, warmup_steps=2, use_sampling_retrieval=True, temp_anneal_epochs=1), path)
    out = training.predicted(notes, codes, training.inputs(notes, codes, known), model, gating.K)
    return out.join(known.select("subject_id", "part"), "subject_id").where("label IS NOT NULL").select("subject_id", "part", "label", F.round("p", 4).alias("p"))
