"""Fixed-size batches over a whole table and means of batch values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.draws import draw_key
from tilewright.operators.ordering import hash_rank, ordered_rank


def assign_batches(
    df: DataFrame, key: Sequence[str], batch_size: int, *, seed: int | None = None
) -> DataFrame:
    """Add ``batch_id`` (from 0) and ``slot`` (from 0); rows of a short last batch are left out.

    With a seed the order is by hash, without one it is by ``key``, which must be unique. The
    order runs over the whole table, yet no task sees more than a chunk of it.
    """
    if batch_size < 1:
        raise ValueError(f"batch size must be positive, got {batch_size}")
    if seed is not None:
        keyed = df.withColumn("_key", draw_key(seed, *[F.col(k) for k in key]))
        ranked = hash_rank(keyed, [], "_key", key, rank="_rn", size="_total").drop("_key")
    else:
        total = df.agg(F.count(F.lit(1))).scalar()
        ranked = (
            ordered_rank(df, [], key, rank="_rn").withColumn("_total", total)
        )
    full = F.floor(F.col("_total") / F.lit(batch_size)) * batch_size
    place = F.col("_rn") - 1
    return (
        ranked.filter(F.col("_rn") <= full)
        .withColumn("batch_id", F.floor(place / F.lit(batch_size)).cast("bigint"))
        .withColumn("slot", F.pmod(place, F.lit(batch_size)).cast("int"))
        .drop("_rn", "_total")
    )


def mean_of_batches(per_batch: DataFrame, values: Sequence[str]) -> DataFrame:
    """Plain mean over batches, each batch counting the same."""
    return per_batch.agg(
        *[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n_batches")
    )
