"""Split lists: one name per line, one text file per split, or versions with a folder per split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.operators.splits import SPLIT_NAMES, keep_first, raise_on_leak
from tilewright.session import path_exists
from tilewright.sources.metadata import VERSION, latest_version, numbered_lines, versions


def _folder_of(spark: SparkSession, folder: str) -> str:
    """The latest complete version of a set of lists, or the folder itself if it has none."""
    return latest_version(spark, folder) or folder


def read_split(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``split, image_id, pos`` of one list: trimmed, blanks dropped, first of repeats kept.

    Reads ``<name>.txt``, or the folder ``split=<name>`` of the latest version or of the folder
    itself. ``pos`` rises with the file name, then the line. A split that got no names has no
    folder; in a completely written set it is an empty list.
    """
    path = f"{folder}/{name}.txt"
    if not path_exists(spark, path):
        folder = _folder_of(spark, folder)
        path = f"{folder}/split={name}"
    if not path_exists(spark, path):
        if name in SPLIT_NAMES and path_exists(spark, f"{folder}/_SUCCESS"):
            return spark.createDataFrame([], "split string, image_id string, pos bigint")
        raise FileNotFoundError(f"no list for split {name!r} in {folder}")
    lines = numbered_lines(spark, path)
    # One row per file is brought together.
    files = lines.select("file").distinct().withColumn("_at", F.row_number().over(Window.orderBy("file")))
    placed = lines.join(files, "file").select(
        F.lit(name).alias("split"),
        F.col("value").alias("image_id"),
        F.expr("shiftleft(cast(_at as bigint), 40) + line_no").alias("pos"),
    )
    return keep_first(placed)


def read_splits(
    spark: SparkSession, folder: str, names: tuple[str, ...] = SPLIT_NAMES, *, check: bool = True
) -> DataFrame:
    """All lists together; a name in two of them is an error."""
    lists = reduce(DataFrame.unionByName, [read_split(spark, folder, n) for n in names])
    if check:
        raise_on_leak(lists)
    return lists


def write_splits(assigned: DataFrame, folder: str, *, force: bool = False) -> str:
    """Write the lists as the next version in ``folder``, read them back and compare the sizes.

    Nothing that is there is touched: ``force`` adds a version, and readers take the latest
    complete one. Sizes are counted while the lists are written, so the assignment runs once.
    Returns the folder of the version.
    """
    spark = assigned.sparkSession
    present = [
        n
        for n in SPLIT_NAMES
        if path_exists(spark, f"{folder}/split={n}") or path_exists(spark, f"{folder}/{n}.txt")
    ]
    found = versions(spark, folder)
    if (present or found) and not force:
        raise FileExistsError(f"split lists already exist: {', '.join(present) or folder}")
    target = f"{folder}/{VERSION}{found[-1] + 1 if found else 0}"
    seen = Observation()
    sizes = [F.count_if(F.col("split") == n).alias(n) for n in SPLIT_NAMES]
    (
        assigned.select("split", "image_id")
        .repartitionByRange("split", "image_id")
        .observe(seen, *sizes)
        .sortWithinPartitions("split", "image_id")
        .write.partitionBy("split")
        .text(target)
    )
    stored = read_splits(spark, target, check=False).agg(*sizes).head().asDict()
    bad = sorted(n for n in SPLIT_NAMES if stored[n] != seen.get[n])
    if bad:
        raise ValueError(f"stored splits differ in size: {bad}")
    return target
