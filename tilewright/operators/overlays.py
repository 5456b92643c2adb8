"""Which images go into the overlay sheet, and their error pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import naming
from tilewright.functions.pixels import error_category


# Beyond this the rank filter is no longer pushed below the shuffle.
MAX_OVERLAYS = 600


def select_overlays(samples: DataFrame, k: int) -> DataFrame:
    """Up to ``k`` names: half 4x, half 10x, the rest filled up by name.

    ``samples`` has unique ``name`` and ``magnification``. Only the first ``k + k // 2`` names per
    magnification can be chosen; that rank filter is pushed below the shuffle, so a task passes on
    a few names however large a magnification is. Other labels are never chosen.
    """
    labels = [*naming.MAGNIFICATIONS, naming.UNKNOWN]
    if k <= 0:
        return samples.select("name", "magnification").limit(0)
    if k > MAX_OVERLAYS:
        raise ValueError(f"an overlay sheet holds at most {MAX_OVERLAYS} images, got {k}")
    half = k // 2
    by_name = Window.partitionBy("magnification").orderBy("name")
    near = (
        samples.filter(F.col("magnification").isin(*labels))
        .select("name", "magnification")
        .withColumn("_rank", F.row_number().over(by_name))
        .filter(F.col("_rank") <= k + half)
    )
    sure = F.col("magnification").isin(*naming.MAGNIFICATIONS) & (F.col("_rank") <= half)
    # At most 3 * (k + half) rows are left, so ranking them together is small.
    marked = near.withColumn("_sure", sure)
    overall = Window.partitionBy(F.lit(1)).orderBy(F.col("_sure").desc(), "name")
    return (
        marked.withColumn("_place", F.row_number().over(overall))
        .filter(F.col("_place") <= k)
        .select("name", "magnification")
    )


def error_counts(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Pixels per error category."""
    return pixels.groupBy(*by, error_category(F.col("gt"), F.col("pred")).alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )
