"""Verdict lattices, and the columns that say which checks ran.

Three orders are in use and must not be merged: `worst` (how checks combine), `ledger` (what counts as caught)
and `level` (when a gate fails). A check that was not made is never a pass: it is listed as skipped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The orders of verdicts.
WORST = {"allow": 0, "clear": 0, "ok": 0, "safe": 0, "unknown": 1, "caution": 1, "review": 1, "warn": 1, "block": 2, "danger": 2}
LEDGER = {"danger": 3, "block": 3, "caution": 2, "review": 2, "warn": 2, "unknown": 1}
LEVEL = {"any": 1, "note": 1, "low": 1, "caution": 2, "review": 2, "warn": 2, "unknown": 2, "danger": 3, "block": 3}


def rank(verdict: Column, order: dict[str, int]) -> Column:
    """Place of a verdict in an order; 0 for those that it doesn't name."""
    out = F.lit(0)
    for value in sorted(set(order.values()) - {0}):
        out = F.when(verdict.isin(*(k for k, v in order.items() if v == value)), value).otherwise(out)
    return out


def worst(*verdicts: Column) -> Column:
    """The worst of some verdicts; the first of equals; null ones don't count."""
    out = verdicts[0]
    for v in verdicts[1:]:
        out = F.when(out.isNull() | (rank(v, WORST) > rank(out, WORST)), v).otherwise(out)
    return out


def by_score(score: Column, *steps: tuple[int, str], default: str) -> Column:
    """The name of the first step whose least score is reached; steps from the top down."""
    out = F.lit(default)
    for least, name in reversed(steps):
        out = F.when(score >= least, name).otherwise(out)
    return out


def skipped(**checks: Column) -> Column:
    """Names of checks whose fact is null, in the order given."""
    return F.filter(F.array(*(F.when(fact.isNull(), F.lit(name)) for name, fact in checks.items())), lambda x: x.isNotNull())


def flags(*parts: tuple[str, Column, int]) -> tuple[Column, Column]:
    """(ids of conditions that hold, in order; sum of their weights up to 100)."""
    ids = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond, _ in parts)), lambda x: x.isNotNull())
    score = sum((F.when(cond, weight).otherwise(0) for _, cond, weight in parts), F.lit(0))
    return ids, F.least(score, F.lit(100))
