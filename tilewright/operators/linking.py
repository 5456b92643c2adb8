"""Connected components over links between numbered nodes, per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import shared_dir

MAX_ROUNDS = 64


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in ``spark.checkpoint.dir``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _falling(links: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each link once, from the larger to the smaller end."""
    return links.filter("a <> b").select(*group, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def smallest_reached(links: DataFrame, group: Sequence[str], *, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``group.., node, root`` for every node of ``links(group.., a, b)``; the root is the smallest one.

    A round has two halves (the alternating stars of Kiveris and others, 2014): every node first ties
    its larger neighbours to the smallest one it knows, then its smaller neighbours and itself. It
    ends when a round changes nothing. Shuffles go by group and node, with partial minima, so
    neither a large group nor a node with many links is gathered in one task; only a count and a
    check sum reach the driver.
    """
    node = [*group, "a"]
    edges = stored(_falling(links, group))
    before = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*node, "b").cast("decimal(38, 0)"))).first()
        if now == before:
            tied = edges.select(*group, F.col("a").alias("node"), F.col("b").alias("root"))
            roots = edges.select(*group, F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return tied.unionByName(roots)
        before = now
        around = edges.unionByName(edges.select(*group, F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy(*node).agg(F.min("b").alias("_least")).select(*node, F.least("a", "_least").alias("_least"))
        upper = around.join(least, node).filter("b > a").select(*group, F.col("b").alias("a"), F.col("_least").alias("b")).distinct()
        least = upper.groupBy(*node).agg(F.min("b").alias("_least"))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("_least").alias("b")), F.struct(F.col("a"), F.col("_least").alias("b")))
        edges = stored(_falling(upper.join(least, node).select(*group, F.explode(pairs).alias("_p")).select(*group, "_p.*"), group))
    raise RuntimeError("components did not settle")
