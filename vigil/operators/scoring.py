"""Turning class probabilities into decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(probs: Column) -> Column:
    """0-based index of the largest probability; ties -> first."""
    return F.array_position(probs, F.array_max(probs)) - 1


def class_from_probs(probs: Column, fallback_class: Column | None = None) -> Column:
    """struct(class_id, confidence); without probabilities the fallback class
    (a hard prediction) is reported with confidence 1.0 (F11)."""
    has = probs.isNotNull() & (F.size(probs) > 0)
    cls = F.when(has, argmax(probs))
    conf = F.when(has, F.array_max(probs)).otherwise(F.lit(1.0))
    if fallback_class is not None:
        cls = F.coalesce(cls, fallback_class)
    return F.struct(cls.cast("int").alias("class_id"), conf.alias("confidence"))


def ensemble_vote(p1: Column, p2: Column, p3: Column, weights=(0.40, 0.35, 0.25),
                  names=("gbt", "mlp", "seq")) -> Column:
    """Weighted vote of up to three probability vectors.

    When the third vector is absent the first two weights are renormalised.
    Returns struct(class_id, confidence, probabilities, model_votes, is_attack).
    """
    w1, w2, w3 = weights
    two = F.zip_with(p1, p2, lambda a, b: (a * w1 + b * w2) / (w1 + w2))
    three = F.zip_with(F.zip_with(p1, p2, lambda a, b: a * w1 + b * w2), p3, lambda ab, c: ab + c * w3)
    combined = F.when(p3.isNull(), two).otherwise(three)
    cls = argmax(combined)
    votes = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]),
        F.array(argmax(p1), argmax(p2), F.coalesce(argmax(p3), F.lit(-1))))
    return F.struct(cls.cast("int").alias("class_id"), F.array_max(combined).alias("confidence"),
                    combined.alias("probabilities"), votes.alias("model_votes"),
                    (cls > 0).alias("is_attack"))


def passes_confidence(class_id: Column, confidence: Column, threshold: float = 0.55) -> Column:
    """Keep attack alerts with confidence >= threshold; class 0 always kept."""
    return (class_id == 0) | (confidence >= threshold)
