"""Training of the gated evidence model: gradients by hand as sums over the executors, steps on the driver.

Each step selects the items of a batch's subjects for the queries as they are (with Gumbel noise while the temperature is annealed), streams
the subjects through the model, one at a time, and adds their gradients up within each task; slices of the sums are added across tasks, and the
driver, which sees as many numbers as the model has weights, takes a step of Adam with decoupled weight decay.  After each epoch the weights, the
moments and the history are appended to a table in the given folder; a run goes on from the last epoch it finds there.  Training stops when the
validation AUC has not risen for ``patience`` epochs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlow.functions import vectors
from marlow.functions.gated import Gated, Subject, sigmoid
from marlow.operators import gating, metrics
from marlow.operators.ordering import settled

#: Numbers of a gradient that travel together.
SLICE = 4096
STATE = "epoch int, name string, shape array<int>, numbers array<double>"


@dataclass(frozen=True)
class Plan:
    """How to train: names as in the settings of a run."""

    num_epochs: int = 10
    batches: int = 8
    lr: float = 1e-3
    weight_decay: float = 0.01
    warmup_steps: int = 10
    max_grad_norm: float | None = 1.0
    aux_loss_weight: float = 0.01
    simplicity_loss_weight: float = 0.1
    k_retrieval: int = gating.K
    use_sampling_retrieval: bool = False
    init_temperature: float = 1.5
    final_temperature: float = 0.05
    temp_anneal_epochs: int = 2
    patience: int = 3
    seed: int = 42


def temperature(plan: Plan, step: int) -> float | None:
    """The sampling temperature of a step, falling in a straight line; none once the annealing is over."""
    steps = plan.temp_anneal_epochs * plan.batches
    if not plan.use_sampling_retrieval or step >= steps:
        return None
    return plan.init_temperature + (plan.final_temperature - plan.init_temperature) * step / max(1, steps - 1)


def inputs(notes: DataFrame, codes: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that don't change while training (subject_id, q, rank, vector): the mean vectors of notes (q = -1) and codes (-2), and the label (-3, in ``rank``)."""

    def mean(rows: DataFrame, q: int) -> DataFrame:
        long = rows.select("subject_id", F.posexplode(vectors.doubles(F.col("vector"))).alias("i", "x")).groupBy("subject_id", "i").agg(F.avg("x").alias("x"))
        whole = long.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        return whole.select("subject_id", F.lit(q).alias("q"), F.lit(0).alias("rank"), F.transform("v", lambda e: e["x"]).alias("vector"))

    label = labels.select("subject_id", F.lit(-3).alias("q"), F.col("label").cast("int").alias("rank"), F.lit(None).cast("array<double>").alias("vector"))
    known = labels.select("subject_id")
    return mean(notes, -1).unionByName(mean(codes, -2)).join(known, "subject_id", "left_semi").unionByName(label)


def _queries(spark: SparkSession, model: Gated) -> DataFrame:
    q = model.weights["queries"]
    rows = [("Note" if i < model.notes else "Code", i, q[i].tolist()) for i in range(len(q))]
    return spark.createDataFrame(rows, "modality string, query_idx int, vector array<double>")


def _rows(notes: DataFrame, codes: DataFrame, fixed: DataFrame, model: Gated, k: int, noise: tuple[int, float] | None = None) -> DataFrame:
    items = gating.selected(notes, codes, _queries(fixed.sparkSession, model), k, noise)
    items = items.select("subject_id", F.col("query_idx").alias("q"), F.col("rank").cast("int").alias("rank"), vectors.doubles(F.col("vector")).alias("vector"), F.col("vec_id").cast("long").alias("vec_id"))
    # a column made anew: a union does not take constraints over from a checkpoint
    fixed = fixed.select("subject_id", "q", "rank", F.transform("vector", lambda x: x).alias("vector"), F.lit(None).cast("long").alias("vec_id"))
    return items.unionByName(fixed).repartition("subject_id").sortWithinPartitions("subject_id")


def subjects(batches: Iterator[pd.DataFrame], model: Gated, k: int) -> Iterator[tuple[int, Subject, int]]:
    """(subject_id, subject, label) from rows sorted by subject, one at a time; a subject's ``ids`` are the vec_ids of its items."""
    n, d = model.weights["queries"].shape
    rest: list[pd.DataFrame] = []

    def one(rows: pd.DataFrame) -> tuple[int, Subject, int]:
        items, real, means, label = np.zeros((n, k, d)), np.zeros((n, k), bool), np.zeros((2, d)), 0
        ids = np.zeros((n, k), np.int64)
        for q, rank, v, i in zip(rows["q"], rows["rank"], rows["vector"], rows["vec_id"]):
            if q >= 0:
                items[q, rank - 1], real[q, rank - 1], ids[q, rank - 1] = v, True, int(i)
            elif q == -3:
                label = int(rank)
            else:
                means[-1 - q] = v
        return rows["subject_id"].iloc[0], Subject(items, real, means, ids=ids), label

    for b in batches:
        if not len(b):
            continue
        if rest and rest[0]["subject_id"].iloc[0] != b["subject_id"].iloc[0]:
            yield one(pd.concat(rest))
            rest = []
        groups = [g for _, g in b.groupby("subject_id", sort=False)]
        if len(groups) > 1:
            yield one(pd.concat([*rest, groups[0]]))
            yield from map(one, groups[1:-1])
            rest = [groups[-1]]
        else:
            rest.append(groups[0])
    if rest:
        yield one(pd.concat(rest))


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def gradient(rows: DataFrame, model: Gated, k: int) -> tuple[float, int, dict[str, np.ndarray]]:
    """(loss, subjects, gradients): sums of the cross entropy over all subjects of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        total, loss, n = None, 0.0, 0
        for _, s, label in subjects(batches, m, k):
            logit, c = m.forward(s)
            g = _flat(m.backward(s, c, float(sigmoid(np.float64(logit))) - label)[0])
            total = g if total is None else total + g
            loss, n = loss + float(np.logaddexp(0, logit) - label * logit), n + 1
        if n:
            full = np.r_[total, loss, n]
            yield pd.DataFrame({"slice": range(-(-len(full) // SLICE)), "numbers": [full[lo : lo + SLICE].tobytes() for lo in range(0, len(full), SLICE)]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "numbers": [np.sum([np.frombuffer(x) for x in pdf["numbers"]], axis=0).tobytes()]})

    kind = "slice int, numbers binary"
    parts = rows.mapInPandas(run, kind).groupBy("slice").applyInPandas(added, kind).collect()
    if not parts:
        return 0.0, 0, {name: np.zeros_like(w) for name, w in model.weights.items()}
    full = np.concatenate([np.frombuffer(r["numbers"]) for r in sorted(parts, key=lambda r: r["slice"])])
    return float(full[-2]), int(full[-1]), _shaped(full[:-2], model.weights)


def predicted(notes: DataFrame, codes: DataFrame, fixed: DataFrame, model: Gated, k: int) -> DataFrame:
    """(subject_id, label, p) of all subjects."""
    shared = fixed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(i, label, shared.value.probability(s)) for i, s, label in subjects(batches, shared.value, k)]
        if got:
            yield pd.DataFrame(got, columns=["subject_id", "label", "p"])

    return _rows(notes, codes, fixed, model, k).mapInPandas(run, "subject_id long, label int, p double")


def explained(notes: DataFrame, codes: DataFrame, fixed: DataFrame, model: Gated, k: int, steps: int = 50) -> DataFrame:
    """The items of all open queries with their integrated gradients from zero and from the mean of what the subject's queries selected."""
    shared = fixed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for i, s, label in subjects(batches, m, k):
            open_ = m.gates(s)[0].astype(bool)
            at = np.nonzero(s.real & open_[:, None])
            mean = s.items[s.real].mean(0) if s.real.any() else np.zeros(s.items.shape[2])
            shares = [m.attributed(s, start, steps)[at] for start in (np.zeros_like(s.items), s.real[..., None] * mean)]
            yield pd.DataFrame({"subject_id": i, "label": label, "p": m.probability(s), "q": at[0], "rank": at[1] + 1, "vec_id": s.ids[at], "from_zero": shares[0], "from_mean": shares[1]})

    return _rows(notes, codes, fixed, model, k).mapInPandas(run, "subject_id long, label int, p double, q int, rank int, vec_id long, from_zero double, from_mean double")


def restored(spark: SparkSession, path: str, model: Gated) -> Gated:
    """``model`` with the weights of the epoch of the best AUC in a state's table."""
    found = _read(spark, path)
    if found is None:
        raise ValueError(f"no state at {path}")
    auc = np.nan_to_num(found[1]["history"][:, 1], nan=-np.inf)
    _, parts = _read(spark, path, int(auc.argmax()) + 1)
    return replace(model, weights={k: parts[k] for k in model.weights})


@dataclass
class Adam:
    """Adam with decoupled weight decay; the rate rises to ``lr`` over the warm-up."""

    plan: Plan
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: int = 0

    def move(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        p = self.plan
        size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, p.max_grad_norm / (size + 1e-6)) if p.max_grad_norm else 1.0
        rate = p.lr * min(1.0, (self.step + 1) / max(1, p.warmup_steps))
        self.step += 1
        out = {}
        for k, w in weights.items():
            g = grads[k] * scale
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g**2
            m, v = self.first[k] / (1 - 0.9**self.step), self.second[k] / (1 - 0.999**self.step)
            out[k] = w * (1 - rate * p.weight_decay) - rate * m / (np.sqrt(v) + 1e-8)
        return out


def _write(spark: SparkSession, path: str, epoch: int, parts: dict[str, np.ndarray]) -> None:
    rows = [(epoch, k, list(x.shape), x.astype(float).ravel().tolist()) for k, x in parts.items()]
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("append").parquet(path)


def _read(spark: SparkSession, path: str, epoch: int | None = None) -> tuple[int, dict[str, np.ndarray]] | None:
    """(epoch, all numbers) of the last epoch, or of a given one; none where nothing was written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return None
    table = spark.read.schema(StructType.fromDDL(STATE)).parquet(path)
    last = table.agg(F.max("epoch")).first()[0] if epoch is None else epoch
    if last is None:
        return None
    return last, {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in table.where(F.col("epoch") == last).collect()}


def fit(notes: DataFrame, codes: DataFrame, labels: DataFrame, model: Gated, plan: Plan, path: str) -> tuple[Gated, list[dict]]:
    """(the model of the best epoch, the history).  ``labels``: (subject_id, label, part), part ``train`` or ``val``."""
    spark = labels.sparkSession
    train, val = (labels.where(F.col("part") == x) for x in ("train", "val"))
    fixed = settled(inputs(notes, codes, train).withColumn("batch", F.pmod(F.xxhash64("subject_id", F.lit(plan.seed)), F.lit(plan.batches))))
    held = settled(inputs(notes, codes, val))
    of = lambda rows, ids: rows.join(ids, "subject_id", "left_semi")
    state = Adam(plan, {k: np.zeros_like(w) for k, w in model.weights.items()}, {k: np.zeros_like(w) for k, w in model.weights.items()})
    history: list[dict] = []
    if found := _read(spark, path):
        epoch, parts = found
        model = replace(model, weights={k: parts[k] for k in model.weights})
        state.first, state.second, state.step = {k: parts[f"first:{k}"] for k in model.weights}, {k: parts[f"second:{k}"] for k in model.weights}, int(parts["step"][0])
        history = [{"epoch": i + 1, "loss": x[0], "auc": x[1]} for i, x in enumerate(parts["history"])]
    while len(history) < plan.num_epochs and not stopped(history, plan.patience):
        total, seen = 0.0, 0
        for b in range(plan.batches):
            batch = fixed.where(F.col("batch") == b).drop("batch")
            ids = batch.where("q = -3").select("subject_id")
            t = temperature(plan, state.step)
            rows = _rows(of(notes, ids), of(codes, ids), batch, model, plan.k_retrieval, (plan.seed + state.step, t) if t else None)
            loss, n, grads = gradient(rows, model, plan.k_retrieval)
            if not n:
                continue
            grads = {k: g / n for k, g in grads.items()}
            aux, slope = model.diversity(plan.simplicity_loss_weight)
            grads["queries"] = grads["queries"] + plan.aux_loss_weight * slope
            model = replace(model, weights=state.move(model.weights, grads))
            total, seen = total + loss + n * plan.aux_loss_weight * aux, seen + n
        ids = held.where("q = -3").select("subject_id")
        scores = settled(predicted(of(notes, ids), of(codes, ids), held, model, plan.k_retrieval)).withColumn("m", F.lit("val"))
        auc = next((r["auc"] for r in metrics.auc(scores, ["m"]).collect()), None)
        history.append({"epoch": len(history) + 1, "loss": total / max(1, seen), "auc": float("nan") if auc is None else auc})
        parts = dict(model.weights) | {f"first:{k}": x for k, x in state.first.items()} | {f"second:{k}": x for k, x in state.second.items()}
        _write(spark, path, len(history), parts | {"step": np.array([state.step]), "history": np.array([[h["loss"], h["auc"]] for h in history])})
    return restored(spark, path, model), history


def stopped(history: list[dict], patience: int) -> bool:
    """Whether the AUC has not risen for ``patience`` epochs."""
    best, since = -np.inf, 0
    for h in history:
        best, since = (h["auc"], 0) if h["auc"] > best else (best, since + 1)
    return since >= patience
