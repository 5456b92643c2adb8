"""Annotation quality control: class counts, violations, verdict."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.blocks import CODE_COUNTS, count_codes

# The class ids a mask may hold.
VALID_CLASSES = (0, 1, 2, 3)

def _values(row: dict[str, Any]) -> np.ndarray:
    return np.frombuffer(row["data"], dtype=np.dtype(row["dtype"]))


def label_counts(blocks: DataFrame) -> DataFrame:
    """``image_id, label, n`` of integer image or block rows, added up over blocks."""
    return (
        blocks.select("image_id", "dtype", "data")
        .mapInArrow(count_codes(_values), CODE_COUNTS)
        .groupBy("image_id", F.col("code").cast("int").alias("label"))
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def class_counts(
    counts: DataFrame, key: str = "image_id", classes: Sequence[int] = VALID_CLASSES
) -> DataFrame:
    """Wide zero-filled counts per image; the total covers valid classes only."""
    sums = [F.expr(f"sum(if(label = {c}, n, 0L))").alias(f"class_{c}") for c in classes]
    total = " + ".join(f"class_{c}" for c in classes)
    return counts.groupBy(key).agg(*sums).select("*", F.expr(total).alias("total_pixels"))


def class_distribution(
    wide: DataFrame, key: str = "image_id", classes: Sequence[int] = VALID_CLASSES
) -> DataFrame:
    """Percentages per image and over all images (``key`` null), from the wide counts."""
    totals = wide.groupingSets([[key], []], key).agg(
        F.grouping_id().alias("_g"),
        *[F.sum(f"class_{c}").cast("bigint").alias(f"class_{c}") for c in classes],
        F.sum("total_pixels").cast("bigint").alias("total_pixels"),
    )
    entries = [
        F.struct(F.lit(c).alias("label"), F.col(f"class_{c}").alias("n")) for c in classes
    ]
    rows = totals.select(
        F.when(F.col("_g") == 1, "all").otherwise("image").alias("grain"),
        key,
        "total_pixels",
        F.inline(F.array(*entries)),
    )
    return rows.withColumn(
        "pct",
        F.when(F.col("total_pixels") == 0, F.lit(0.0).cast("double")).otherwise(
            F.lit(100.0).cast("double") * F.col("n") / F.col("total_pixels")
        ),
    )


def invalid_labels(
    counts: DataFrame, key: str = "image_id", valid: Sequence[int] = VALID_CLASSES
) -> DataFrame:
    """Sorted labels outside the valid set, per image. A mask has at most 65536 labels."""
    valid_set = F.array(*[F.lit(v) for v in valid])
    return counts.groupBy(key).agg(
        F.array_sort(F.array_except(F.collect_set("label"), valid_set)).alias("invalid")
    )


def violations(checked: DataFrame) -> DataFrame:
    """Add ``violations`` (array of messages) to rows describing one raw/mask pair.

    Expected columns: ``raw_height, raw_width, mask_height, mask_width, mask_dtype, invalid`` and
    the read errors ``raw_error, mask_error`` (null when readable). A read error stops the rest.
    """
    raw_hw = F.format_string("(%d, %d)", "raw_height", "raw_width")
    mask_hw = F.format_string("(%d, %d)", "mask_height", "mask_width")
    messages = F.array_compact(
        F.array(
            F.when(
                (F.col("raw_height") != F.col("mask_height"))
                | (F.col("raw_width") != F.col("mask_width")),
                F.concat(F.lit("shape mismatch: raw "), raw_hw, F.lit(" vs mask "), mask_hw),
            ),
            F.when(
                F.col("mask_dtype") != "uint8",
                F.concat(F.lit("mask dtype "), F.col("mask_dtype"), F.lit(" != uint8")),
            ),
            F.when(
                F.size("invalid") > 0,
                F.concat(
                    F.lit("invalid mask values ["),
                    F.array_join(F.col("invalid").cast("array<string>"), ", "),
                    F.lit("]"),
                ),
            ),
        )
    )
    return checked.withColumn(
        "violations",
        F.when(
            F.col("raw_error").isNotNull(),
            F.array(F.concat(F.lit("raw read error: "), F.col("raw_error"))),
        )
        .when(
            F.col("mask_error").isNotNull(),
            F.array(F.concat(F.lit("mask read error: "), F.col("mask_error"))),
        )
        .otherwise(messages),
    )


def verdict(report: DataFrame) -> DataFrame:
    """One row: pairs seen, pairs with violations, and whether the check passed."""
    return report.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.size("violations") > 0).alias("n_failed"),
    ).withColumn("passed", F.col("n_failed") == 0)
