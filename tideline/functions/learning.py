"""Learner models: evidence weights, clamped folds, risk, style, pace and forecasts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far each kind of evidence moves a mastery.
EVIDENCE = {
    "correct": 0.15,
    "incorrect": -0.12,
    "confusion": -0.08,
    "affirmation": 0.10,
    "hint_used": -0.05,
    "retry_success": 0.08,
    "assignment_correct": 0.18,
    "assignment_incorrect": -0.14,
    "chapter_complete": 0.12,
}
#: The events' stand-ins for kinds of evidence.
EVENT_EVIDENCE = {"purchase": "correct", "error": "incorrect", "click": "affirmation", "view": "hint_used", "signup": "chapter_complete"}
WEAK, STRONG = 0.45, 0.75


def by_name(name: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def evidence_weight(event_type: Column) -> Column:
    return by_name(event_type, {e: EVIDENCE[k] for e, k in EVENT_EVIDENCE.items()}, 0.0)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def mastery_fold(steps: Column, start: float = 0.5) -> Column:
    """Adds ordered weights one by one, staying in 0..1 after each; the order matters."""
    return F.aggregate(steps, F.lit(start), lambda m, w: clamp01(m + w))


#: Sums of weights are rounded to so many places after each step, so that their order leaves no trace in comparisons.
PLACES = 12


def clamped_sum(steps: Column) -> Column:
    """A struct (low, high, shift) that stands for adding ordered weights one by one, staying in 0..1 after each: it takes
    x to least(high, greatest(low, x + shift))."""
    start = F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0.0).alias("shift"))
    return F.aggregate(steps, start, lambda a, w: F.struct(clamp01(a["low"] + w).alias("low"), clamp01(a["high"] + w).alias("high"), F.bround(a["shift"] + w, PLACES).alias("shift")))


def merged_sums(sums: Column) -> Column:
    """One struct for an array of clamped_sum() in the order of their slices."""
    into = lambda x, s: F.bround(F.least(s["high"], F.greatest(s["low"], x + s["shift"])), PLACES)
    start = F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0.0).alias("shift"))
    # Infinite ends stay as they are: a slice that moved nothing has them.
    end = lambda x, s: F.when(F.abs(x) == float("inf"), F.least(s["high"], F.greatest(s["low"], x))).otherwise(into(x, s))
    return F.aggregate(sums, start, lambda a, s: F.struct(end(a["low"], s).alias("low"), end(a["high"], s).alias("high"), F.bround(a["shift"] + s["shift"], PLACES).alias("shift")))


def applied(total: Column, start: float = 0.5) -> Column:
    return F.bround(F.least(total["high"], F.greatest(total["low"], F.lit(start) + total["shift"])), PLACES)


def confidence_fold(signals: Column, start: float = 0.5, alpha: float = 0.2) -> Column:
    """Exponential average over signals in the order given."""
    return F.aggregate(signals, F.lit(start), lambda c, s: clamp01(c * (1 - alpha) + s * alpha))


def risk_score(mastery: Column, confidence: Column, engagement: Column, regression: Column) -> Column:
    return clamp01((1 - mastery) * 0.35 + (1 - confidence) * 0.25 + (1 - engagement) * 0.25 + regression * 0.15)


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.65, "high").when(score >= 0.4, "medium").otherwise("low")


def engagement(events: Column, days: int = 7) -> Column:
    return clamp01(events / F.lit(float(days)) / 20.0) if days > 0 else F.lit(0.5)


def attention(idle_ratio: Column, minutes: Column, switches: Column) -> Column:
    length = F.when(minutes > 90, -0.15).when(minutes.between(10, 45), 0.1).otherwise(0.0)
    return clamp01(0.7 - F.least(F.lit(0.4), idle_ratio * 0.5) - F.least(F.lit(0.2), switches * 0.05) + length)


def pace(confusion: Column, attention_score: Column, mastery: Column) -> Column:
    return F.when((confusion >= 0.55) | (attention_score < 0.4), "slow").when((mastery >= 0.75) & (confusion < 0.3), "fast").otherwise("medium")


def difficulty_advice(mastery: Column, confidence: Column) -> Column:
    return F.when((mastery < WEAK) | (confidence < 0.4), "below_level").when((mastery >= STRONG) & (confidence >= 0.7), "above_level").otherwise("on_level")


def forecast(mastery: Column, improvement: Column, regression: Column) -> Column:
    return F.bround(clamp01(mastery + improvement * 0.15 - regression * 0.10), 3)


def misconception_confidence(count: Column, first: float = 0.5) -> Column:
    """Confidence after so many sightings: capped steps, so it does not depend on their order."""
    return F.least(F.lit(0.95), first + (count - 1) * 0.08)


def memorised(mastery: Column, level: Column, fast_correct: Column, slow_incorrect: Column) -> Column:
    return F.when((mastery >= 0.7) & (level <= 1), 0.75).when(fast_correct & (level <= 2), 0.65).when(slow_incorrect & (mastery < 0.4), 0.2).otherwise(clamp01(mastery - (level - 1) * 0.1))
