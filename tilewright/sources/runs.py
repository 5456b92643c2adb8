"""Run folders: choosing an artifact and reading training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import naming
from tilewright.session import path_exists

# Fixed value: where a run keeps its best artifact.
BEST_ARTIFACT = "checkpoints/best_checkpoint.msgpack"


def artifact_listing(spark: SparkSession, runs_dir: str) -> DataFrame:
    """``path, modified`` of best artifacts of all runs; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", BEST_ARTIFACT.rsplit("/", 1)[1])
        .load(runs_dir)
        .select("path", F.col("modificationTime").alias("modified"))
    )


def newest_per_config(listing: DataFrame) -> DataFrame:
    """The newest artifact of every config, from run folders named ``<config>_<date>_<time>``."""
    pattern = r"([^/]+)_(\d{8}_\d{6})/" + BEST_ARTIFACT.replace(".", r"\.") + "$"
    return (
        listing.withColumn("config", F.regexp_extract("path", pattern, 1))
        .filter("config <> ''")
        .groupBy("config")
        .agg(
            F.max_by("path", F.struct("modified", "path")).alias("path"),
            F.max("modified").alias("modified"),
            F.count(F.lit(1)).alias("n_runs"),
        )
    )


def resolve_artifact(
    spark: SparkSession,
    runs_dir: str,
    config: str,
    *,
    run_dir: str | None = None,
    artifact: str | None = None,
) -> str:
    """An explicit artifact, else the one of a run folder, else the newest run of the config."""
    if artifact is not None or run_dir is not None:
        path = artifact if artifact is not None else f"{run_dir}/{BEST_ARTIFACT}"
        if path_exists(spark, path):
            return path
        raise FileNotFoundError(f"no artifact at {path}")
    tail = "/" + BEST_ARTIFACT
    found = (
        artifact_listing(spark, runs_dir)
        .filter(F.col("path").contains(f"/{config}_") & F.col("path").endswith(tail))
        .filter(F.regexp_extract("path", r"([^/]+)" + tail + "$", 1).startswith(f"{config}_"))
        .agg(F.max_by("path", F.struct("modified", "path")).alias("path"))
        .head()
    )
    if found is None or found["path"] is None:
        raise FileNotFoundError(f"no artifact for config {config!r} in {runs_dir}")
    return found["path"]


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """A training log by column names; the order of its columns does not matter."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    types = {"epoch": "int"}
    return raw.select(
        *[naming.strip(F.col(c)).cast(types.get(c.strip(), "double" if _is_number(c) else "string")).alias(c.strip()) for c in raw.columns]
    )


def _is_number(column: str) -> bool:
    name = column.strip()
    return name in ("train_loss", "val_loss", "mean_dice") or name.startswith("dice_class_")
