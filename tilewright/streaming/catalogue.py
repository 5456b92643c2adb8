"""Keeping the metadata table up to date with newly arrived image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import naming
from tilewright.operators import catalogue
from tilewright.session import path_exists, touch
from tilewright.sources import metadata
from tilewright.sources.images import IMAGE_GLOB

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _merge_batch(folder: str, checkpoint: str):
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = catalogue.metadata_rows(batch)
        mark = f"_batch-{query_id(spark, checkpoint)}-{batch_id}"
        found = metadata.versions(spark, folder)
        # A repeated batch must not merge with its own output, but with all that others wrote.
        others = [v for v in found if not path_exists(spark, f"{folder}/{metadata.VERSION}{v}/{mark}")]
        if others:
            existing = metadata.read_metadata_lenient(
                spark, f"{folder}/{metadata.VERSION}{others[-1]}"
            )
            merged = catalogue.merge_metadata(existing, fresh)
        else:
            merged = fresh.dropDuplicates(["image"])
        written = metadata.write_metadata(merged, folder, mode="update")
        touch(spark, f"{written}/{mark}")

    return merge


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps for a stream in its checkpoint folder."""
    return spark.read.json(f"{checkpoint}/metadata").head()["id"]


def ingest_new_images(spark: SparkSession, raw_dir: str, folder: str, checkpoint: str) -> DataFrame:
    """Merge the files that arrived since the last run, then return the current table.

    Existing rows win, also those edited by hand between two runs. Each batch adds a version and
    marks it as its own; run again, it merges with the newest version that is not its own.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", IMAGE_GLOB)
        .load(raw_dir)
        .select("path", naming.base_name(F.col("path")).alias("name"))
    )
    query = (
        arrivals.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(_merge_batch(folder, checkpoint))
        .start()
    )
    query.awaitTermination()
    latest = metadata.latest_version(spark, folder)
    if latest is None:
        raise FileNotFoundError(f"no images have arrived in {raw_dir}")
    return metadata.read_metadata_lenient(spark, latest)
