"""Segmentation losses over pixel rows with logits.

``pixels`` has one column per class logit and ``target``. Softmax stays in plain columns, and all
sums are one partial aggregation per group, so a pixel table shuffles a few numbers per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.pixels import class_weight, double, log_softmax, softmax
from tilewright.operators.confusion import EPSILON


def _logits(names: Sequence[str]) -> list[Column]:
    return [F.col(n).cast("double") for n in names]


def _pixel_terms(pixels: DataFrame, by: Sequence[str], logits: Sequence[str], weights) -> DataFrame:
    """Probabilities, log-probability of the target and its weight, one row per pixel."""
    target = F.col("target")
    probs = softmax(_logits(logits))
    logs = log_softmax(_logits(logits))
    chosen = F
    for c, value in enumerate(logs):
        chosen = chosen.when(target == c, value)
    weight = class_weight(target, weights) if weights is not None else double(1.0)
    return pixels.select(
        *by,
        "target",
        *[p.alias(f"_p{c}") for c, p in enumerate(probs)],
        (-chosen * weight).alias("_ce"),
    )


def segmentation_loss(
    pixels: DataFrame,
    by: Sequence[str],
    logits: Sequence[str],
    *,
    class_weights: Sequence[float] | None = None,
    dice_weight: float = 1.0,
    ce_weight: float = 1.0,
    eps: float = EPSILON,
) -> DataFrame:
    """``dice_loss``, ``ce_loss`` and their weighted sum ``loss`` per group, in one pass.

    Cross-entropy is divided by the number of pixels, not by the sum of weights.
    """
    terms = _pixel_terms(pixels, by, logits, class_weights)
    aggs = [F.avg("_ce").alias("ce_loss"), F.count(F.lit(1)).alias("n_pixels")]
    for c in range(len(logits)):
        hit = F.when(F.col("target") == c, double(1.0)).otherwise(double(0.0))
        p = F.col(f"_p{c}")
        aggs.append(F.sum(p * hit).alias(f"_i{c}"))
        aggs.append(F.sum(p * p + hit).alias(f"_d{c}"))
    sums = terms.groupBy(*by).agg(*aggs)
    per_class = [
        (double(2.0) * F.col(f"_i{c}") + double(eps)) / (F.col(f"_d{c}") + double(eps))
        for c in range(len(logits))
    ]
    mean_dice = sum(per_class[1:], per_class[0]) / double(len(logits))
    return (
        sums.withColumn("dice_loss", double(1.0) - mean_dice)
        .withColumn(
            "loss", double(dice_weight) * F.col("dice_loss") + double(ce_weight) * F.col("ce_loss")
        )
        .select(*by, "n_pixels", "dice_loss", "ce_loss", "loss")
    )
