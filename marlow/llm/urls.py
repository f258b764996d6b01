"""URL filter: rules, then the likelihood ratio of two character Markov models.

Rules (host, path prefix) decide where one fits, the longest first.  Any other URL is
judged by two variable-order Markov models over the characters of host and path, one of accepted
and one of rejected URLs: contexts of 0 to ``ORDER - 1`` characters with Witten-Bell smoothing, so that a context never
seen leaves the word to the next shorter one.  The verdict is ``block`` where the
difference of log-likelihoods, divided by the number of characters, is above a
threshold.  Hosts are dealt to ``FOLDS`` folds, and a URL is judged by a model of accepted URLs that learned nothing
from the hosts of its own fold: a rejected host without a mark is not known by heart as an accepted one.  The threshold
is calibrated on all seeds, the rejected ones judged by models that both know nothing of their fold: the best balanced
accuracy, over a histogram, of those thresholds that call at most ``MISTAKES`` of the accepted seeds rejected.

The models learn from all URLs of the input under seed labels: a host with one of
``REJECT`` among the words of its labels is rejected, every other host accepted;
URLs that a blocking rule decides are left out.  URLs alike but for their digits are one shape and count
by the logarithm of their number, so that one hot host doesn't become the model.

Everything is DataFrame code, and the model grows with the input: counts of all windows of ``ORDER`` characters
(of any script, as they are), and of their shorter ends, are tables.  The difference of each distinct window is
worked out once; shapes look up their windows by a join and add them up as whole billionths, so that
no order of addition matters.  A window or shape that has a thousandth of all rows is looked up by a broadcast
join (there are a thousand of these at most, whatever the input); so are the sequences of one and two characters, which all windows share, while
they are few enough (``FEW``).  All others meet by a shuffle.

Values: a null url or one without ``://`` has empty host and path and an empty text,
scores 0 and is allowed; repeated rows get equal verdicts; ties (score at the
threshold) are allowed; an empty table gives an empty result, and without rejected
seeds every URL is allowed; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlow.llm.shared import lasting, written

#: Rules of the query: host and path prefix, and what they say.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

# Words in host names that mark seeds of rejected URLs.
REJECT = "adult ads adserver bet bets betting casino cheap escort farm gambling hentai jackpot loan loans pills poker porn sex slots spam track tracker viagra warez xxx".split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a window: one that is predicted and those before it.
ORDER = 6
#: What stands before a text, and the probability of a character that nothing is known of.
START, UNIFORM = "\x02", 1 / 256
FOLDS = 5
#: Names of the pairs of models by the fold left out: of the accepted ones, and of both.
JUDGING, CALIBRATING = "abcde", "01234"
#: Share of accepted seeds that may score above the threshold.
MISTAKES = 0.02
BINS, SPAN = 400, 4.0
#: Rows of all rows that make a key hot, as a share.
HOT = 1000
#: Characters of sequences that are broadcast, as nearly all windows share them, and how many of these there may be at most.
SHORT, FEW = 2, 200_000


def host() -> Column:
    h = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(h, UPPER, LOWER), F.lit(""))


def path() -> Column:
    return F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) for columns host and path; null where none fits."""
    name = said = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # the last that fits, the longest, wins
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        name, said = F.when(fits, text).otherwise(name), F.when(fits, verdict).otherwise(said)
    return name, said


def shape() -> Column:
    """The text that the models see: host and path in lower case, runs of digits as one 0."""
    return F.regexp_replace(F.concat("host", F.translate("path", UPPER, LOWER)), "[0-9]+", "0")


def windows(text: str, order: int = ORDER) -> str:
    """SQL: all windows of ``order`` characters of a text that begins with ``order - 1`` starts, one for each character."""
    chars = f"concat(array_repeat('{START}', {order - 1}), filter(split({text}, ''), x -> x <> ''))"
    return f"element_at(transform(array({chars}), c -> if(size(c) < {order}, CAST(array() AS ARRAY<STRING>), transform(sequence(1, size(c) - {order - 1}), i -> array_join(slice(c, i, {order}), '')))), 1)"


def shapes(urls: DataFrame) -> DataFrame:
    """(sid, host, shape, n, n_seed, bad, fold): distinct shapes of ``urls`` (host, path), how often they stand there, how often
    the models may learn from them, as what, and the fold of the host."""
    words = F.split(F.translate(F.col("host"), "-_", ".."), r"\.")
    bad = F.arrays_overlap(words, F.array(*[F.lit(w) for w in REJECT]))
    seed = (F.col("host") != "") & F.coalesce(F.col("said") != "block", F.lit(True))
    by = urls.withColumn("said", rule()[1]).select("host", shape().alias("shape"), seed.alias("seed")).groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count_if("seed").alias("n_seed"))
    fold = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 8), 16, 10).cast("long") % FOLDS
    return by.select(F.monotonically_increasing_id().alias("sid"), "host", "shape", "n", "n_seed", bad.alias("bad"), fold.cast("int").alias("fold"))


def differences(known: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(w, d) for each row of ``asked`` (w: a letter of JUDGING or CALIBRATING and a window): log probability of the window's last
    character as rejected less that as accepted, in whole billionths; learned from ``known`` (w: a window, bad, weight, fold)."""
    parts = [f"{c}{f}" for c in ("good", "bad") for f in range(FOLDS)]
    by_fold = [F.sum(F.when((F.col("bad") == (c[:-1] == "bad")) & (F.col("fold") == int(c[-1])), F.col("weight")).otherwise(0)).alias(c) for c in parts]
    top = known.groupBy("w").agg(*by_fold)
    ends = F.explode(F.expr(f"transform(sequence(1, {order}), k -> right(w, k))")).alias("gram")
    sums = top.select(ends, *parts).groupBy("gram").agg(*[F.sum(c).alias(c) for c in parts])

    def without(c: str, fold: int | None) -> Column:
        return sum((F.col(f"{c}{g}") for g in range(FOLDS) if g != fold), F.lit(0)).alias(c)

    pairs = [(name, f, f if name in CALIBRATING else None) for names in (JUDGING, CALIBRATING) for f, name in enumerate(names)]
    others = F.explode(F.array(*[F.struct(F.lit(name).alias("f"), without("good", g), without("bad", b)) for name, g, b in pairs]))
    grams = written(sums.select("gram", others.alias("o")).select("gram", "o.*").where("good > 0 OR bad > 0"))
    contexts = written(
        grams.groupBy("f", F.expr("left(gram, length(gram) - 1)").alias("context")).agg(
            F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.count_if(F.col("good") > 0).alias("k_good"), F.count_if(F.col("bad") > 0).alias("k_bad")
        )
    )
    empty = contexts.where("context = ''").drop("context")  # a row for each pair of models, so not a hot key of the join
    ask = f"explode(transform(sequence(1, {order}), k -> named_struct('k', k, 'f', left(w, 1), 'gram', right(w, k), 'context', left(right(w, k), k - 1))))"
    steps = met(asked.select("w", F.expr(ask).alias("s")).select("w", "s.*"), grams, "gram", "k", SHORT)
    counts = ["n_good", "n_bad", "k_good", "k_bad"]
    longer = met(steps.where("k > 1"), contexts.where("context <> ''"), "context", "k", SHORT + 1).select("w", "k", "good", "bad", *counts)
    steps = longer.union(steps.where("k = 1").join(F.broadcast(empty), "f", "left").select("w", "k", "good", "bad", *counts))
    chain = steps.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("k", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("good", "bad", *counts)]))).alias("s"))

    def log(x: str) -> str:
        return f"ln(aggregate(s, {UNIFORM!r}D, (p, v) -> if(v.n_{x} = 0, p, (v.{x} + v.k_{x} * p) / (v.n_{x} + v.k_{x}))))"

    return chain.select("w", F.expr(f"CAST(round(1e9D * ({log('bad')} - {log('good')})) AS BIGINT)").alias("d"))


def met(rows: DataFrame, table: DataFrame, key: str, order: str, short: int) -> DataFrame:
    """``rows`` joined on the left to ``table`` by f and ``key``.  Keys of few characters, which all rows share (those of rows whose ``order`` is
    ``short`` at most), are broadcast if there are no more than ``FEW`` of them."""
    size = short - (key == "context")
    few = table.where(F.length(key) <= size)
    if few.limit(FEW + 1).count() > FEW:
        return rows.join(table, ["f", key], "left")
    near = rows.where(F.col(order) <= short).join(F.broadcast(few), ["f", key], "left")
    return near.unionByName(rows.where(F.col(order) > short).join(table.where(F.length(key) > size), ["f", key], "left"))


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``table`` (key, n, ...), which has each key once and in ``n`` how many of the ``total`` rows have it."""
    hot = F.broadcast(table.where(F.col("n") * HOT >= total))
    cold = table.where(F.col("n") * HOT < total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def threshold(rows: DataFrame) -> float:
    """The score above which balanced accuracy over ``rows`` (bad, score) is best, of those above which at most
    MISTAKES of the good ones are; infinite without both kinds."""
    b = F.floor((F.least(F.greatest("score", F.lit(-SPAN)), F.lit(SPAN)) + SPAN) * BINS).cast("int")
    counts: dict[int, list[int]] = {}
    for r in rows.groupBy(b.alias("b"), "bad").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["b"], [0, 0])[r["bad"]] += r["n"]
    good, bad = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not good or not bad:
        return float("inf")
    best, at, seen = 0.0, float("inf"), [0, 0]
    order = sorted(counts)
    for i, k in enumerate(order):
        seen = [seen[0] + counts[k][0], seen[1] + counts[k][1]]
        value = seen[0] / good + 1 - seen[1] / bad
        if value > best and good - seen[0] <= MISTAKES * good:
            after = order[i + 1] if i + 1 < len(order) else k + 1
            best, at = value, (k + 1 + after) / 2 / BINS - SPAN
    return at


def judged(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of every row of ``pages`` (page_id, url)."""

    def build() -> DataFrame:
        urls = pages.select("page_id", host().alias("host"), path().alias("path"))
        all_ = written(shapes(urls))

        def places(rows: DataFrame, names: str) -> DataFrame:
            return rows.select("sid", F.explode(F.expr(f"transform({windows('shape')}, x -> concat(substr('{names}', fold + 1, 1), x))")).alias("w"))

        seeds = all_.where("n_seed > 0")
        known = seeds.select(F.explode(F.expr(windows("shape"))).alias("w"), "bad", (F.floor(F.log2("n_seed")) + 1).alias("weight"), "fold")
        every = places(all_, JUDGING).unionByName(places(seeds.where("bad"), CALIBRATING))
        asked = written(every.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
        table = written(asked.join(differences(known, asked.select("w")), "w"))
        found = looked_up(every, table, "w", asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        judging = F.left("w", F.lit(1)).between(JUDGING[0], JUDGING[-1])

        def mean(of: Column) -> Column:
            return F.coalesce(F.sum(F.when(of, F.col("d"))) / F.count_if(of) / 1e9, F.lit(0.0))

        score = found.groupBy("sid").agg(mean(judging).alias("score"), F.when(F.count_if(~judging) > 0, mean(~judging)).alias("blind"))
        scored = written(all_.join(score, "sid", "left").withColumn("score", F.coalesce("score", F.lit(0.0))))
        limit = threshold(scored.where("n_seed > 0").select("bad", F.coalesce("blind", "score").alias("score")))
        known_as = F.concat("host", F.lit(START), "shape")  # hosts that differ in their digits share shapes
        keyed = urls.withColumn("shape", shape()).withColumn("key", known_as).drop("shape")
        rows = looked_up(keyed, scored.select(known_as.alias("key"), "n", "score"), "key", scored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        name, said = rule()
        block = (F.col("host") != "") & (F.col("score") > F.lit(limit))
        return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(said, F.when(block, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"), F.lit(round(limit, 6)).alias("threshold"))

    return lasting(build)


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
