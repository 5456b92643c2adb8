"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds at least this share of the rows, so there are at most
# HOT_SHARE hot keys whatever the data: the list of them is safe to broadcast.
HOT_SHARE = 256
SALTS = 64


def salted_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``facts`` to ``lookup`` (unique per key) with hot keys spread over several tasks.

    Rows of a hot key get a salt from their own content, and the one matching lookup row is
    repeated per salt. ``how`` is ``inner``, ``left`` or ``left_semi``/``left_anti``. Key counts
    read only the key column of ``facts``; binary columns do not take part in the salt.
    """
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    hot = counts.filter(F.col("_n") * HOT_SHARE >= total.scalar()).select(
        F.col(key), F.lit(True).alias("_hot")
    )
    hot = F.broadcast(hot)
    light = [name for name, kind in facts.dtypes if kind != "binary"]
    salt = F.pmod(F.xxhash64(*light), F.lit(SALTS)).cast("int")
    left = facts.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(0)
    )
    right = (
        lookup.join(hot, key, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
                    F.array(F.lit(0))
                )
            ),
        )
        .drop("_hot")
    )
    return left.drop("_hot").join(right, [key, "_salt"], how).drop("_salt")

