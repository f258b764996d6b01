"""Prompts: messages, templates and the wordings that come with the library (all its own)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Instructions by name: what the model is, what it is asked, and what its answer begins with.
PROMPTS: dict[str, dict[str, str]] = {
    "full_context": {"system": "You read a person's whole history and estimate the chance of the outcome.", "user": "Read the history. Answer with a JSON object that has a probability from 0 to 1 and a report.\n\n"},
    "full_context_sections": {"system": "You read a person's whole history and estimate the chance of the outcome.", "user": "Read the history. Answer with a JSON object: probability, and a report of four sections with five numbered factors, each with a quote and its source.\n\n"},
    "holistic": {"system": "You weigh a person's history as a whole.", "user": "Answer with a JSON object: probability, and a summary in running text.\n\n"},
    "retrieved": {"system": "You estimate the chance of the outcome from the passages that a search found.", "user": "The passages follow, the latest first. Answer with a JSON object: probability and report.\n\n"},
    "answer": {"system": "You answer with one word, then explain.", "user": "Will the outcome occur? Answer Yes or No, then a JSON object with a report.\n\n", "prefill": "Answer: "},
    "answer_retrieved": {"system": "You answer with one word, then explain, from the passages that a search found.", "user": "Will the outcome occur? Answer Yes or No, then a JSON object with a report.\n\n", "prefill": "Answer: "},
    "explain": {"system": "You explain a prediction by its evidence.", "user": "The model gave {probability}. Its evidence, with attributions:\n{evidence}\nWrite the report."},
    "explain_single_span": {"system": "You explain a prediction by its evidence.", "user": "The model gave {probability}. Quote each item once, in one piece:\n{evidence}\nWrite the report."},
    "explain_strict": {"system": "You explain a prediction by its evidence and nothing else.", "user": "The model gave {probability}. Reason only from what is quoted:\n{evidence}\nWrite the report."},
    "judge_coherence": {"system": "You judge whether reasoning follows from stated evidence.", "user": "Judge each factor and the whole. Answer with the JSON object described.\n\n{report}"},
    "judge_trust": {"system": "You judge whether a report can be trusted.", "user": "Answer with the JSON object described.\n\n{report}"},
}

# The fields of the judges' verdicts.
COHERENCE = (
    "per_factor array<struct<idx: int, reasoning_follows_from_evidence: boolean, reasoning_uses_only_stated_evidence: boolean, rationale: string>>, "
    "overall_reasoning_follows_from_factors boolean, overall_uses_only_stated_factors boolean, overall_rationale string"
)
TRUST = "factors_clinically_plausible boolean, evidence_supports_factor boolean, language_appropriately_hedged boolean, no_obvious_hallucination boolean, overall_trust string, notes string"


def messages(name: str, text: Column, extra: str = "") -> Column:
    """array<struct<role, content>> of a prompt over ``text``: system (and ``extra`` after a blank line), user, and the
    beginning of the answer where the prompt has one."""
    p = PROMPTS[name]
    turns = [("system", F.lit(p["system"] + (f"\n\n{extra}" if extra else ""))), ("user", F.concat(F.lit(p["user"]), text))]
    if "prefill" in p:
        turns.append(("assistant", F.lit(p["prefill"])))
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns])


def filled(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column; a name without a value is an error, and braces that
    name nothing stay."""
    parts = re.split(r"\{([a-z_]+)\}", template)
    lost = sorted(set(parts[1::2]) - set(values))
    if lost:
        raise KeyError(f"no value for {lost}")
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def verdict(text: Column, schema: str) -> Column:
    """A judge's answer as a struct; null where it is not JSON."""
    return F.from_json(text, schema)
