"""What several operators share: lineage cuts, shared files, row keys, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in ``spark.checkpoint.dir``.

    The files go when the session's context cleaner drops the reference
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared storage, as a URI."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# Names that Hadoop gives to stores, and the names the Python writer knows them by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "gcs": "gs"}


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Python side's file system for a URI of Hadoop's, and the path there."""
    scheme, sep, rest = uri.partition(":")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + sep + rest)


def read_shared(uri: str) -> bytes:
    """A whole file, read in a task."""
    fs, path = file_system(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def write_shared(uri: str, pieces: Iterator[bytes]) -> int:
    """Write one file from a task and give it its name only when it is complete.

    A task that runs twice writes the same bytes under its own temporary name first, so a lost
    executor leaves no half file behind a final name.
    """
    fs, path = file_system(uri)
    folder, name = os.path.split(path)
    fs.create_dir(folder, recursive=True)
    part, total = f"{folder}/_{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(part, compression=None) as out:
        for piece in pieces:
            out.write(piece)
            total += len(piece)
    try:
        fs.move(part, path)
    except OSError:
        # Some stores do not replace a file. Then another attempt of this task was first, and wrote the same.
        if not fs.get_file_info(path).is_file:
            raise
        fs.delete_file(part)
    return total


def read_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """``path, content`` of finished files; unfinished ones start with ``_``, which Spark skips."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")
    )


@lru_cache(1)
def held_alone(make: Callable, *args: object) -> Any:
    """``make(*args)``, kept by the worker until another such table is asked for.

    Workers go from stage to stage; what one of them remembers for an earlier one would stay beside the next.
    """
    return make(*args)


#: Rows of texts that are Python objects at a time.
SMALL_ROWS = 1024


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``SMALL_ROWS``, and memory given back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, SMALL_ROWS):
            yield batch.slice(at, SMALL_ROWS)
    pa.default_memory_pool().release_unused()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges stop
    changing. Each round is stored, so lineage stays short; only one count reaches the driver.
    """
    edges = cut(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                      F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*").filter("a <> b").distinct()
        )
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
