"""From folders of images and masks to a checked catalogue and split lists."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import annotation, catalogue, splits
from tilewright.sources import images, metadata, split_lists


def quality_report(spark: SparkSession, raw_dir: str, masks_dir: str) -> DataFrame:
    """One row per pair: ``image_id, total_pixels, class_0..3, violations``.

    An unreadable mask is reported with zero counts and the run goes on. Only headers of raw files
    are needed; masks are decoded once and counted where they are decoded.
    """
    def side(folder: str, prefix: str) -> DataFrame:
        return images.scan_headers(spark, folder).select(
            "image_id",
            "path",
            F.col("height").alias(f"{prefix}_height"),
            F.col("width").alias(f"{prefix}_width"),
            F.col("channels").alias(f"{prefix}_channels"),
            F.col("dtype").alias(f"{prefix}_dtype"),
            F.col("error").alias(f"{prefix}_error"),
        )

    raw, masks = side(raw_dir, "raw"), side(masks_dir, "mask")
    # Pairing looks at the listing only; the header of each file is read once, afterwards.
    pairs = catalogue.pair_files(
        images.scan_images(spark, raw_dir), images.scan_images(spark, masks_dir)
    )
    described = (
        pairs.join(raw.drop("image_id").withColumnRenamed("path", "raw_path"), "raw_path")
        .join(masks.drop("image_id").withColumnRenamed("path", "mask_path"), "mask_path")
        .withColumn(
            "mask_error",
            F.coalesce(
                "mask_error",
                F.when(
                    F.col("mask_channels") != 1,
                    F.format_string("mask must have one channel, got %d", "mask_channels"),
                ),
            ),
        )
    )
    readable = images.decode_images(spark, masks_dir).filter("data is not null and channels = 1")
    counts = annotation.label_counts(readable.withColumn("image_id", F.col("path"))).withColumnRenamed(
        "image_id", "mask_path"
    )
    wide = annotation.class_counts(counts, "mask_path")
    bad = annotation.invalid_labels(counts, "mask_path")
    joined = described.join(wide, "mask_path", "left").join(bad, "mask_path", "left").fillna(
        0, [*[f"class_{c}" for c in annotation.VALID_CLASSES], "total_pixels"]
    )
    return annotation.violations(
        joined.withColumn("invalid", F.coalesce("invalid", F.array().cast("array<int>")))
    ).select(
        "image_id",
        "total_pixels",
        *[f"class_{c}" for c in annotation.VALID_CLASSES],
        "violations",
    )


def update_metadata(spark: SparkSession, raw_dir: str, folder: str, *, mode: str = "refuse") -> DataFrame:
    """Build or merge the metadata table of a folder of raw images and write the next version.

    Returns the rows that still need a magnification by hand or are no longer backed by a file:
    ``image, problem``.
    """
    current = catalogue.metadata_rows(images.scan_images(spark, raw_dir))
    latest = metadata.latest_version(spark, folder)
    if mode == "update" and latest is not None:
        existing = metadata.read_metadata_lenient(spark, latest)
        merged = catalogue.merge_metadata(existing, current)
        stale = catalogue.stale_rows(existing, current)
    else:
        merged = current.withColumn("added", F.lit(True))
        stale = current.select("image").limit(0)
    metadata.write_metadata(merged, folder, mode=mode)
    todo = catalogue.unrecognised(merged.filter("added")).select(
        "image", F.lit("needs magnification").alias("problem")
    )
    return todo.unionByName(stale.select("image", F.lit("stale").alias("problem")))


def make_splits(
    spark: SparkSession,
    raw_dir: str,
    masks_dir: str,
    metadata_path: str,
    splits_dir: str,
    *,
    train: float = 0.7,
    val: float = 0.15,
    seed: int = 42,
    force: bool = False,
) -> DataFrame:
    """Check that files and metadata agree, assign splits, write the lists, return the summary.

    Warns if conditions are named but too rare to be stratified together with the magnification.
    """
    splits.check_fractions(train, val)
    clean, errors = metadata.read_metadata_strict(spark, metadata_path)
    metadata.raise_on_errors(errors)
    raw = images.scan_images(spark, raw_dir)
    masks = images.scan_images(spark, masks_dir)
    catalogue.raise_on_issues(catalogue.consistency_issues(raw, masks, clean))
    if not splits.joint_is_eligible(clean, train, val).first()["joint"] and not clean.filter("trim(coalesce(condition, '')) <> ''").isEmpty():
        warnings.warn("some conditions do not fill all splits; splits are stratified by magnification alone", stacklevel=2)
    assigned = splits.assign_splits(clean, train, val, seed)
    split_lists.write_splits(assigned, splits_dir, force=force)
    return splits.split_summary(assigned)
