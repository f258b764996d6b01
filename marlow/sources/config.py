"""Settings of a run, read strictly: unknown or missing names fail.

Files are flat YAML, one ``name: value`` a line; they are read without the yaml package.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from marlow.functions.gated import Gated
from marlow.operators.training import Plan


# The names and kinds of a run's settings.
@dataclass(frozen=True)
class Settings:
    emb_dim: int
    num_queries: int
    num_note_queries: int
    num_code_queries: int
    k_retrieval: int
    attn_temperature: float
    use_sampling_retrieval: bool
    init_temperature: float
    final_temperature: float
    temp_anneal_epochs: int
    aggregator: str
    transformer_layers: int
    transformer_heads: int
    transformer_dim_ff: int
    dropout: float
    expert_hidden_dim: int
    num_epochs: int
    batch_size: int
    lr: float
    weight_decay: float
    warmup_steps: int
    aux_loss_weight: float
    simplicity_loss_weight: float
    max_grad_norm: float | None
    note_parquet: str
    code_parquet: str
    db_uri: str
    note_table: str
    code_table: str
    train_set_ratio: float
    random_state: int
    device: str
    seed: int
    enable_dynamic_gating: bool = True

    def plan(self, subjects: int) -> Plan:
        """How to train on so many subjects; batches are as many as keep ``batch_size``."""
        same = {f.name: getattr(self, f.name) for f in fields(Plan) if hasattr(self, f.name)}
        return Plan(**same, batches=max(1, -(-subjects // self.batch_size)))

    def model(self, queries) -> Gated:
        """The untrained model of these settings over the given queries (notes first)."""
        if len(queries) != self.num_queries or len(queries[0]) != self.emb_dim:
            raise ValueError(f"{self.num_queries} queries of width {self.emb_dim} are asked for")
        return Gated.fixed(queries, self.num_note_queries, hidden=self.expert_hidden_dim, temperature=self.attn_temperature, static=not self.enable_dynamic_gating)


def settings(values: dict) -> Settings:
    """Settings from names and values, checked."""
    known = {f.name: f for f in fields(Settings)}
    needed = {n for n in known if n != "enable_dynamic_gating"}
    wrong = sorted(set(values) - set(known) | needed - set(values))
    if wrong:
        raise TypeError(f"unknown or missing settings: {wrong}")
    s = Settings(**values)
    if s.num_note_queries < 1 or s.num_code_queries < 0:
        raise ValueError("at least one note query, the shared one")
    if s.num_note_queries + s.num_code_queries != s.num_queries:
        raise ValueError(f"{s.num_note_queries} note queries and {s.num_code_queries} code queries are not {s.num_queries}")
    if s.aggregator not in ("mean", "transformer"):
        raise ValueError(f"unknown aggregator {s.aggregator}")
    return s


def value(text: str) -> object:
    """A plain YAML value: null, a truth value, a number, or a string, in quotes or bare."""
    text = text.strip()
    if m := re.fullmatch(r"(['\"])(.*?)\1\s*(?:#.*)?", text):
        return m[2]
    text = re.sub(r"(?:^|\s)#.*$", "", text).strip()
    if text.lower() in ("", "null", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parsed(text: str) -> dict:
    """The names and values of a flat file."""
    lines = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    pairs = [x.partition(":") for x in lines]
    if bad := [x for x, (name, colon, _) in zip(lines, pairs) if not colon or not re.fullmatch(r"\w+", name)]:
        raise ValueError(f"no name and value: {bad[:3]}")
    return {name: value(v) for name, _, v in pairs}


def load(spark: SparkSession, path: str, **changes) -> Settings:
    """Settings from a file in any store, with ``changes`` (a variant of them)."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return settings({**parsed(text), **changes})
