"""All queries of the library by name, with their SQL counterparts.

A query is a function of (spark, sf_dir).  Its text or operator reads *roles* (see
:mod:`marlow.plans.roles`): in Spark a role is a DataFrame over the driver's tables, in
the SQL counterpart it is a common table expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlow.plans import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NAME = re.compile(r"\{([a-z_]+)\}")

#: Functions whose spelling differs: name -> (Spark, oracle), $1 and $2 being the arguments.
MACROS = {
    "HASH32": ("CAST(conv(substr(md5($1), 1, 8), 16, 10) AS BIGINT)", "CAST('0x' || substr(md5($1), 1, 8) AS BIGINT)"),
    "QUANTILE": ("percentile($1, $2)", "quantile_cont($1, $2)"),
    "WORDS": ("CASE WHEN trim($1) = '' THEN 0 ELSE size(split(trim(regexp_replace($1, '\\\\s+', ' ')), ' ')) END", "CASE WHEN trim($1) = '' THEN 0 ELSE len(string_split(trim(regexp_replace($1, '\\s+', ' ', 'g')), ' ')) END"),
}


def _expand(text: str, side: int) -> str:
    """Macros ``NAME[[a]]`` and ``NAME[[a ;; b]]`` in one dialect."""
    inner = re.compile(r"([A-Z0-9]+)\[\[((?:(?!\[\[|\]\]).)*)\]\]", re.S)
    while m := inner.search(text):
        out = MACROS[m[1]][side]
        for k, arg in enumerate(m[2].split(";;"), 1):
            out = out.replace(f"${k}", arg.strip())
        text = text[: m.start()] + out + text[m.end() :]
    return text


def oracle(text: str) -> str:
    """``text`` with its roles put before it as common table expressions."""
    text = _expand(text, 1)
    return roles.with_roles(_NAME.sub(r"\1", text), _NAME.findall(text))


def sql(name: str, spark: str, duck: str | None = None) -> None:
    """Register a query whose Spark side is SQL over roles; ``duck`` where the dialects part."""

    def run(session: SparkSession, sf_dir: str) -> DataFrame:
        return roles.queried(session, sf_dir, _expand(spark, 0))

    QUERIES[name] = run
    ORACLES[name] = oracle(duck or spark)


def frame(name: str, duck: str | None, *inputs: str) -> Callable:
    """Register a query that applies a DataFrame function to the roles ``inputs``."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(session: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[roles.role(session, sf_dir, r) for r in inputs])

        QUERIES[name] = run
        if duck:
            ORACLES[name] = oracle(duck)
        return f

    return register


from marlow.plans import cohort, evaluation, modelling, reports, retrieval, texts  # noqa: E402, F401
