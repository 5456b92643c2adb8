"""What a training log says: best epoch, early stop, long form of the class scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.ordering import (
    AT,
    CHUNK,
    SEQ,
    attach,
    attach_to_groups,
    lay_out,
    prefix,
)

START_SCORE = -1.0


def early_stop(
    log: DataFrame,
    run: Sequence[str],
    *,
    epoch: str = "epoch",
    score: str = "score",
    patience: int,
    partitions: int | None = None,
) -> DataFrame:
    """Per epoch: did it improve, the last improvement so far, and whether training got here.

    An epoch improves when it beats every earlier score. Training stops after the first epoch
    that is ``patience`` past the last improvement; before any improvement the count starts at
    the beginning. ``epoch`` counts from 1 without gaps. Runs of any length are scanned in chunks.
    """
    laid = lay_out(log, run, [epoch], partitions=partitions)
    keys = [*run, CHUNK]
    # The last improvement inside a chunk is where the chunk first reaches its top, provided that
    # top beats everything before the chunk. So chunk summaries give both carried values.
    tops = laid.groupBy(*keys).agg(
        F.max(score).alias("_top"), F.min_by(epoch, F.struct(-F.col(score), epoch)).alias("_top_at")
    )
    start = F.lit(START_SCORE).cast("double")
    carried = (
        tops.withColumn("_best", F.max("_top").over(prefix(run)))
        .withColumn("_new", F.when(F.col("_top") > F.coalesce("_best", start), F.col("_top_at")))
        .withColumn("_last", F.max("_new").over(prefix(run)))
        .select(*keys, "_best", "_last")
    )
    local = Window.partitionBy(AT).orderBy(SEQ)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    best = F.greatest("_best", "_run")
    scanned = (
        attach(laid.withColumn("_run", F.max(score).over(earlier)), carried, keys)
        .withColumn("improved", F.col(score) > F.coalesce(best, start))
        .withColumn("_here", F.max(F.when(F.col("improved"), F.col(epoch))).over(so_far))
        .withColumn("last_improved", F.greatest("_last", "_here"))
        .drop("_run", "_best", "_last", "_here")
    )
    due = F.col(epoch) - F.coalesce(F.col("last_improved"), F.lit(0)) >= patience
    stops = scanned.filter(due).groupBy(*run).agg(F.min(epoch).alias("stop_epoch"))
    return (
        attach_to_groups(scanned, stops, run)
        .filter(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
        .drop(AT, CHUNK, SEQ)
    )


def run_outcome(
    stopped: DataFrame, run: Sequence[str], *, epoch: str = "epoch", score: str = "score"
) -> DataFrame:
    """One row per run: epochs run, best epoch and score, stop epoch (null when it ran out)."""
    return stopped.groupBy(*run).agg(
        F.max(epoch).alias("epochs_run"),
        F.max("last_improved").alias("best_epoch"),
        F.max(F.when(F.col("improved"), F.col(score))).alias("best_score"),
        F.max("stop_epoch").alias("stop_epoch"),
    )


def class_scores_long(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``dice_class_<c>`` columns of a log as rows ``class, dice``; columns are found by name."""
    columns = sorted(c for c in log.columns if c.startswith("dice_class_"))
    long = log.unpivot(list(keys), columns, "_column", "dice")
    return long.select(
        *keys, F.regexp_extract("_column", r"(\d+)$", 1).cast("int").alias("class"), "dice"
    )
