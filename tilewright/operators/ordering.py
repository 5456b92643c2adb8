"""Ranks and running values inside groups that may be too large for one task.

A plain ``row_number`` window puts a whole group into one task. Here a group is cut into chunks,
each chunk is ranked on its own, and the size of the chunks before it is added. Only chunk
summaries are ever brought together per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.session import scratch_path

CHUNK = "_chunk"
SEQ = "_seq"
AT = "_at"


def at_key(*keys: str) -> Column:
    """Group and chunk as one value. As a struct it is never null itself, so null groups join
    like any other, and windows and joins on it share one shuffle."""
    return F.struct(*keys)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a table that is unique per key; ``left`` carries the key as ``_at``."""
    kept = [c for c in right.columns if c not in keys]
    return left.join(right.select(at_key(*keys).alias(AT), *kept), AT, "left")


def prefix(group: Sequence[str]):
    """Window over the chunks before the current one; it runs on chunk summaries only."""
    return Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def _offsets(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows before each chunk, and rows in the group. One row per group and chunk comes in."""
    return counts.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(prefix(group)), F.lit(0)).cast("bigint"),
            "_size": F.sum("_n").over(Window.partitionBy(*group)).cast("bigint"),
        }
    )


def hash_rank(
    df: DataFrame,
    group: Sequence[str],
    hash_col: str,
    ties: Sequence[str],
    *,
    rank: str = "rn",
    size: str = "group_size",
    digits: int = 3,
) -> DataFrame:
    """Rank rows of each group by a hex digest, and add the group size.

    The leading ``digits`` of the digest are the chunk: digests are uniform, so a group of any
    size is spread over ``16 ** digits`` equal chunks, without sampling.
    """
    keys = [*group, CHUNK]
    chunked = df.withColumn(CHUNK, F.substring(hash_col, 1, digits))
    counts = chunked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    local = Window.partitionBy(AT).orderBy(hash_col, *ties)
    ranked = chunked.withColumn(AT, at_key(*keys)).withColumn("_local", F.row_number().over(local))
    return (
        attach(ranked, _offsets(counts, group), keys)
        .withColumn(rank, F.col("_before") + F.col("_local"))
        .withColumn(size, F.col("_size"))
        .drop(AT, CHUNK, "_local", "_before", "_size", "_n")
    )


def lay_out(
    df: DataFrame, group: Sequence[str], order: Sequence[str], *, partitions: int | None = None
) -> DataFrame:
    """Sort by group and order over all tasks and number the rows.

    Adds ``_chunk`` (range partition), ``_seq`` (increasing in sort order) and the key ``_at`` of
    group and chunk. The result is stored in the shared folder: the numbers come from one physical layout and must not be drawn
    twice, also not when an executor is lost. The order columns should be (nearly) unique per
    group, since equal values share a chunk. Adaptive execution picks the number of chunks unless
    ``partitions`` is given.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    path = scratch_path(spark, "layout")
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    (
        spread.sortWithinPartitions(*keys)
        .withColumn(SEQ, F.monotonically_increasing_id())
        .write.parquet(path)
    )
    laid = spark.read.parquet(path).withColumn(CHUNK, F.shiftright(SEQ, 33))
    return laid.withColumn(AT, at_key(*group, CHUNK))


def attach_to_groups(laid: DataFrame, values: DataFrame, group: Sequence[str]) -> DataFrame:
    """Left join of one row per group onto a ``lay_out`` table.

    The values go to the chunks of their group first and to the rows chunk by chunk, so a large
    group is never joined in one task.
    """
    keys = [*group, CHUNK]
    chunks = laid.select(*keys).distinct().withColumn(AT, at_key(*group))
    return attach(laid, attach(chunks, values, group).drop(AT), keys)


def add_rank(laid: DataFrame, group: Sequence[str], *, rank: str = "rn") -> DataFrame:
    """Dense position of each row in its group, from a ``lay_out`` table."""
    keys = [*group, CHUNK]
    counts = laid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(SEQ).alias("_first"))
    return (
        attach(laid, _offsets(counts, group), keys)
        .withColumn(rank, F.col("_before") + F.col(SEQ) - F.col("_first") + 1)
        .drop("_n", "_first", "_before", "_size")
    )


def ordered_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    *,
    rank: str = "rn",
    partitions: int | None = None,
) -> DataFrame:
    """Position of each row in its group by a natural order."""
    laid = lay_out(df, group, order, partitions=partitions)
    return add_rank(laid, group, rank=rank).drop(AT, CHUNK, SEQ)
