"""Scalar columns of ranking and state: priors, penalties, multipliers, clamps.

Fixed values: the numbers below are the engine's contract.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SENSITIVITY_RANKS = {"normal": 0, "sensitive": 1, "highly_sensitive": 2}
FACT_TYPE_PRIORS = {"core_identity": 1.0, "stable_preference": 0.8, "relational_state": 0.8, "commitment": 0.7}
LIFECYCLE_MULTIPLIERS = {"active": 1.0, "consolidated": 0.92, "dormant": 0.82, "archived": 0.55, "deep_archived": 0.35}
SENSITIVITY_PENALTIES = {"highly_sensitive": 0.1, "sensitive": 0.05}
SEARCH_TIERS = {"active": "hot", "consolidated": "hot", "dormant": "warm", "archived": "cold", "deep_archived": "deep_cold"}
UNKNOWN_SENSITIVITY = 3


def lookup(value: Column, table: dict, default) -> Column:
    """A CASE over a fixed table."""
    chain = reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), table.items(), F)
    return chain.otherwise(F.lit(default))


def sensitivity_rank(level: Column) -> Column:
    """Unknown levels rank above all permissions."""
    return lookup(level, SENSITIVITY_RANKS, UNKNOWN_SENSITIVITY)


def fact_type_prior(fact_type: Column) -> Column:
    return lookup(fact_type, FACT_TYPE_PRIORS, 0.5)


def lifecycle_multiplier(status: Column) -> Column:
    return lookup(status, LIFECYCLE_MULTIPLIERS, 1.0)


def sensitivity_penalty(level: Column) -> Column:
    return lookup(level, SENSITIVITY_PENALTIES, 0.0)


def fatigue_penalty(count: Column) -> Column:
    return F.when(count > 0, 0.6).otherwise(0.0)


def search_tier(status: Column) -> Column:
    return lookup(status, SEARCH_TIERS, "hot")


def clamp01(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def recency(created: Column, now: Column) -> Column:
    """1 / (1 + days / 30); 1 in the future, 0.5 where unknown."""
    days = F.timestamp_diff("SECOND", created, now) / 86400.0
    return F.when(created.isNull(), 0.5).when(days <= 0, 1.0).otherwise(1 / (1 + days / 30))


def log_quarter(n: Column) -> Column:
    """min(1, ln(1 + n) / ln 4)."""
    return F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log(F.lit(4.0)))


def evidence_strength(confidence: Column, n_sources: Column, pinned: Column, reinforced: Column) -> Column:
    known = F.when(confidence > 0, confidence).otherwise(0.5)
    quality = F.when(n_sources > 0, 1.0).when(pinned, 0.5).otherwise(0.0)
    return 0.45 * known + 0.25 * log_quarter(n_sources) + 0.20 * quality + 0.10 * log_quarter(reinforced)


def estimate_tokens(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, F.lit(1)).otherwise(F.floor(n / 2) + 8).cast("bigint")


def usage_guidance(validity: Column) -> Column:
    return F.when(validity == "invalidated", "historical; do not treat as current fact").otherwise("")
