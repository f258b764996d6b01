"""Calls to outside models as pluggable functions: generation, judging with a cache."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlow.sources import io


def generated(prompts: DataFrame, generate: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """``prompts`` (prompt, ...) with ``completion``: ``generate`` gets lists of at most ``batch`` prompts."""
    schema = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes) + ", completion string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[str] = []
            for at in range(0, len(f), batch):
                out += generate(f["prompt"].iloc[at : at + batch].tolist())
            yield f.assign(completion=out)

    return prompts.mapInPandas(run, schema)


@dataclass(frozen=True)
class Ask:
    """One call of a model: the prompt, a seed and a temperature of its own."""

    prompt: str
    seed: int
    temperature: float


@dataclass(frozen=True)
class Answer:
    """What came back: the text, and the likeliest first tokens with their log probabilities."""

    text: str
    first: list[tuple[str, float]] = field(default_factory=list)


FIRST = "array<struct<token: string, logprob: double>>"


def rollouts(prompts: DataFrame, generate: Callable[[list[Ask]], list[Answer]], n: int, seed: int = 42, temperature: float = 0.7, top: int = 20, batch: int = 32, done: DataFrame | None = None) -> DataFrame:
    """Each row of ``prompts`` (subject_id, prompt, ...) ``n`` times: with rollout_idx, seed, completion and ``first``, the ``top`` likeliest first tokens.

    A rollout's seed is that of its subject and number, so a task that is run again asks the same, and rollouts that ``done`` (subject_id, rollout_idx) has
    are left out; no rollout comes twice."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("subject_id").cast("string"), F.col("rollout_idx").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    asks = prompts.withColumn("rollout_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("seed", h)
    if done is not None:
        asks = asks.join(done.select("subject_id", "rollout_idx"), ["subject_id", "rollout_idx"], "left_anti")
    schema = ", ".join(f"`{c}` {t}" for c, t in asks.dtypes) + f", completion string, first {FIRST}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[Answer] = []
            for at in range(0, len(f), batch):
                some = f.iloc[at : at + batch]
                out += generate([Ask(p, int(s), temperature) for p, s in zip(some["prompt"], some["seed"])])
            first = [[{"token": t, "logprob": x} for t, x in sorted(a.first, key=lambda e: -e[1])[:top]] for a in out]
            yield f.assign(completion=[a.text for a in out], first=first)

    return asks.mapInPandas(run, schema)


def answer_probability(first: Column, completion: Column, yes: str = "Yes", no: str = "No") -> dict[str, Column]:
    """generated_token, logp_yes, logp_no, probability and parse_ok from the first tokens: the softmax of the two answers; 1 or 0 where only one is among the
    likeliest, a half where none is."""

    def of(token: str) -> Column:
        return F.get(F.filter(first, lambda e: F.trim(e["token"]) == token), F.lit(0))["logprob"]

    a, b = of(yes), of(no)
    p = F.when(a.isNotNull() & b.isNotNull(), 1 / (1 + F.exp(b - a))).when(a.isNotNull(), 1.0).when(b.isNotNull(), 0.0).otherwise(0.5)
    token = F.coalesce(F.trim(F.get(first, F.lit(0))["token"]), F.regexp_extract(completion, r"^\s*(\S*)", 1))
    return {"generated_token": token, "logp_yes": a, "logp_no": b, "probability": p, "parse_ok": a.isNotNull() | b.isNotNull()}


def stub_rollout(asks: list[Ask], yes: str = "Yes", no: str = "No") -> list[Answer]:
    """A deterministic stand-in for a model that answers with one word and a report."""
    out = []
    for x in asks:
        h = int(hashlib.md5(f"{x.prompt}|{x.seed}".encode()).hexdigest()[:8], 16)
        first = [(t, -(k % 1000) / 250) for t, k, lost in ((f" {yes}", h, h % 11), (no, h // 1000, h % 13)) if lost] + [("Maybe", -9.0)]
        out.append(Answer(f'{max(first, key=lambda e: e[1])[0].strip()}\n{{"report": "r{h % 100}"}}', first))
    return out


def with_keys(work: DataFrame, model: str) -> DataFrame:
    """``work`` (subject_id, report) with the cache key of each item."""
    return work.withColumn("key", F.sha1(F.concat_ws("|", F.lit(model), F.col("subject_id").cast("string"), F.col("report")).cast("binary")))


@dataclass(frozen=True)
class Judgement:
    """A judge's answer and what it cost."""

    verdict: str
    input_tokens: int | None = None
    output_tokens: int | None = None


JUDGED = "key string, subject_id long, model string, verdict string, input_tokens int, output_tokens int"


def judged(work: DataFrame, cache: DataFrame, judge: Callable[[str], str | Judgement], model: str, tries: int = 3, wait: float = 1.0, at_once: int = 1) -> DataFrame:
    """(key, subject_id, model, verdict, input_tokens, output_tokens) of the items that ``cache`` (key, ...) lacks.

    A failing call is repeated with doubled waits; after the last try the verdict is null.  A task has at most
    ``at_once`` calls open.
    """
    todo = with_keys(work, model).join(cache.select("key").distinct(), "key", "left_anti")

    def asked(report: str) -> Judgement | None:
        for k in range(tries):
            try:
                got = judge(report)
                return got if isinstance(got, Judgement) else Judgement(got)
            except Exception:  # noqa: BLE001  any failure of an outside service
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for f in frames:
                got = [x or Judgement(None) for x in pool.map(asked, f["report"])]
                costs = {c: pd.array([getattr(x, c) for x in got], "Int32") for c in ("input_tokens", "output_tokens")}
                yield pd.DataFrame({"key": f["key"], "subject_id": f["subject_id"], "model": model, "verdict": [x.verdict for x in got], **costs})

    return todo.select("key", "subject_id", "report").mapInPandas(run, JUDGED)


def judged_through(work: DataFrame, path: str, judge: Callable[[str], str | Judgement], model: str, **how) -> DataFrame:
    """The verdicts of all items of ``work``: those that the cache at ``path`` (JSON lines) lacks are asked for and appended to it first; failed ones are not, so
    the next call asks again."""
    spark = work.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
    cache = io.read_cache(spark, path, JUDGED) if known else spark.createDataFrame([], JUDGED)
    io.write_jsonl(judged(work, cache, judge, model, **how).where("verdict IS NOT NULL"), path, append=True)
    return io.read_cache(spark, path, JUDGED).join(with_keys(work, model).select("key").distinct(), "key", "left_semi")


def stub_generate(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a language model."""
    import zlib

    return [f'{{"probability": 0.{zlib.crc32(p.encode()) % 100:02d}, "report": "r"}}' for p in prompts]


def stub_judge(report: str) -> str:
    """A deterministic stand-in for a judge."""
    return '{"overall_trust": "high"}' if len(report) % 2 else '{"overall_trust": "low"}'
