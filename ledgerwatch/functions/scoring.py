"""Risk scores as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score profiles, decay steps and profile weights.
PROFILES: dict[str, dict[str, Any]] = {
    "conservative": {"multipliers": {"critical": 2.5, "high": 2.0, "medium": 1.5, "low": 1.0}, "low": 25.0, "medium": 50.0, "max": 100.0, "base_risk": 15.0},
    "balanced": {"multipliers": {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5}, "low": 33.0, "medium": 66.0, "max": 100.0, "base_risk": 10.0},
    "aggressive": {"multipliers": {"critical": 1.5, "high": 1.0, "medium": 0.7, "low": 0.3}, "low": 45.0, "medium": 75.0, "max": 100.0, "base_risk": 5.0},
}
DECAY_STEPS: tuple[tuple[float, float], ...] = ((24, 1.0), (168, 0.7), (720, 0.4))
DECAY_FLOOR = 0.2
SEVERITY_WEIGHTS = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0}


def clamped(score: Column, most: float = 100.0) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(float(most)))


def band(score: Column, low: float = 33.0, medium: float = 66.0) -> Column:
    return F.when(score < low, "low").when(score < medium, "medium").otherwise("high")


def lookup(key: Column, values: Mapping[str, float], default: float) -> Column:
    """values by lower-cased key."""
    if not values:
        return F.lit(default)
    cases = reduce(lambda c, kv: c.when(F.lower(key) == kv[0], F.lit(float(kv[1]))), values.items(), F)
    return cases.otherwise(F.lit(float(default)))


def severity_multiplier(severity: Column, values: Mapping[str, float] | None = None) -> Column:
    return lookup(severity, PROFILES["balanced"]["multipliers"] if values is None else values, 1.0)


def decay(hit: Column, as_of: Column, steps: Sequence[tuple[float, float]] = DECAY_STEPS, floor: float = DECAY_FLOOR) -> Column:
    """The factor of the first step whose age in hours is not exceeded, else the floor."""
    hours = (F.unix_micros(as_of) - F.unix_micros(hit)) / F.lit(3.6e9)
    cases = reduce(lambda c, s: c.when(hours <= float(s[0]), F.lit(float(s[1]))), sorted(steps), F)
    return cases.otherwise(F.lit(float(floor)))


def total(base: Column, hits: Column, delta) -> Column:
    """base plus delta(hit) over an array of hits."""
    return F.aggregate(hits, base.cast("double"), lambda a, h: a + delta(h))


def score_v1(base: Column, hits: Column, most: float = 100.0) -> Column:
    return clamped(total(base, hits, lambda h: h["score_delta"]), most)


def score_v2(base: Column, hits: Column, profile: Mapping[str, Any], hit_time: Column | None = None, as_of: Column | None = None) -> Column:
    """Deltas by severity and, where a hit time is given, by age; clamped to the profile's maximum."""
    age = F.lit(1.0) if hit_time is None else decay(hit_time, as_of)
    return clamped(total(base, hits, lambda h: h["score_delta"] * severity_multiplier(h["severity"], profile["multipliers"]) * age), profile["max"])


def breakdown_v2(hits: Column, profile: Mapping[str, Any]) -> Column:
    """rule_id, raw and weighted delta and severity of each hit."""
    weigh = lambda h: F.round(h["score_delta"] * severity_multiplier(h["severity"], profile["multipliers"]), 2)
    return F.transform(hits, lambda h: F.struct(h["rule_id"], h["score_delta"].alias("raw_delta"), weigh(h).alias("weighted_delta"), h["severity"]))


def recency_factor(days: Column) -> Column:
    return F.when(days <= 1, 2.0).when(days <= 7, 1.5).when(days <= 30, 1.0).otherwise(0.5)
