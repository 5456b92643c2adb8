"""Stratified train/val/test assignment and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import naming
from tilewright.functions.draws import draw_key
from tilewright.operators.ordering import hash_rank

SPLIT_NAMES = ("train", "val", "test")
MIN_GROUP = 3


def check_fractions(train: float, val: float) -> None:
    for name, value in (("train", train), ("val", val)):
        if not 0 < value < 1:
            raise ValueError(f"{name} fraction must lie between 0 and 1, got {value}")
    if train + val >= 1:
        raise ValueError(f"train ({train}) and val ({val}) leave nothing for test")


def cut_sizes(n: Column, train: float, val: float) -> tuple[Column, Column]:
    """Rows for train and val out of ``n``, rounded half to even; test takes the rest."""
    n = n.cast("double")
    return (
        F.rint(n * F.lit(train).cast("double")).cast("bigint"),
        F.rint(n * F.lit(val).cast("double")).cast("bigint"),
    )


def strata_sizes(metadata: DataFrame, train: float, val: float) -> DataFrame:
    """Joint strata with their sizes and whether all three splits get a row."""
    groups = metadata.groupBy(
        "magnification", naming.condition_label(F.col("condition")).alias("condition")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.coalesce(naming.strip("condition"), F.lit("")) != "").alias("named"),
    )
    n_train, n_val = cut_sizes(F.col("n"), train, val)
    return (
        groups.withColumn("n_train", n_train)
        .withColumn("n_val", n_val)
        .withColumn("n_test", F.col("n") - F.col("n_train") - F.col("n_val"))
        .withColumn(
            "fills_all",
            (F.col("n") >= MIN_GROUP)
            & (F.col("n_train") >= 1)
            & (F.col("n_val") >= 1)
            & (F.col("n_test") >= 1),
        )
    )


def joint_is_eligible(metadata: DataFrame, train: float, val: float) -> DataFrame:
    """One row, one flag: may magnification and condition be stratified together?"""
    return strata_sizes(metadata, train, val).agg(
        F.coalesce(F.bool_and("fills_all") & F.bool_or("named"), F.lit(False)).alias("joint")
    )


def assign_splits(
    metadata: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """Give each ``image_id`` a split within its stratum.

    Strata are (magnification, condition) when every joint group fills all three splits, else
    magnification alone. The order within a stratum is by ``md5(seed:image_id)``. Adds
    ``stratum, rn, group_size, split`` and keeps the input columns.
    """
    check_fractions(train, val)
    joint = joint_is_eligible(metadata, train, val).scalar()
    stratum = F.when(
        joint, F.concat_ws("|", "magnification", naming.condition_label(F.col("condition")))
    ).otherwise(F.col("magnification"))
    keyed = metadata.withColumn("stratum", stratum).withColumn(
        "_key", draw_key(seed, F.col("image_id"))
    )
    ranked = hash_rank(keyed, ["stratum"], "_key", ["image_id"])
    n_train, n_val = cut_sizes(F.col("group_size"), train, val)
    return ranked.withColumn(
        "split",
        F.when(F.col("rn") <= n_train, "train")
        .when(F.col("rn") <= n_train + n_val, "val")
        .otherwise("test"),
    ).drop("_key")


def split_summary(assigned: DataFrame) -> DataFrame:
    """Counts per split, per split and magnification, per split and condition.

    The finest grain is counted once; the three levels are added up from those few rows.
    """
    fine = assigned.groupBy(
        "split", "magnification", naming.condition_label(F.col("condition")).alias("condition")
    ).agg(F.count(F.lit(1)).alias("_n"))
    return (
        fine.groupingSets(
            [["split"], ["split", "magnification"], ["split", "condition"]],
            "split",
            "magnification",
            "condition",
        )
        .agg(F.sum("_n").cast("bigint").alias("n"))
        .select("split", "magnification", "condition", "n")
    )


def keep_first(lists: DataFrame) -> DataFrame:
    """Drop repeated names of a split list, keeping the first position and dropping blanks."""
    trimmed = lists.withColumn("image_id", naming.strip("image_id")).filter(F.col("image_id") != "")
    return trimmed.groupBy("split", "image_id").agg(F.min("pos").alias("pos"))


def split_leaks(splits: DataFrame) -> DataFrame:
    """Names that are in more than one split. The set per name holds split names only."""
    return (
        splits.groupBy("image_id")
        .agg(F.collect_set("split").alias("_in"))
        .filter(F.size("_in") > 1)
        .select("image_id", F.array_join(F.array_sort("_in"), ",").alias("splits"))
    )


def raise_on_leak(splits: DataFrame) -> None:
    first = split_leaks(splits).agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("name")).head()
    if first["n"]:
        raise ValueError(f"{first['n']} name(s) are in several splits, for example {first['name']}")
