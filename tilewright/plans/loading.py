"""Image and mask rows of a split that is stored as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import catalogue, intensity
from tilewright.sources import images, split_lists


def load_split(
    spark: SparkSession,
    raw_dir: str,
    masks_dir: str,
    splits_dir: str,
    split: str,
    *,
    channels: str = "grayscale",
    class_mapping: dict[int, int] | None = None,
    normalise: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Prepared images and remapped masks of the listed names.

    Listings are compared first, so a name without files stops the job before anything is decoded.
    """
    members = split_lists.read_split(spark, splits_dir, split)
    raw_files = images.stored_scan(spark, raw_dir)
    mask_files = images.stored_scan(spark, masks_dir)
    missing = catalogue.missing_members(members, raw_files, mask_files)
    gap = missing.agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("first")).head()
    if gap["n"]:
        raise FileNotFoundError(f"{gap['n']} listed image(s) lack files, first {gap['first']}")
    keep = members.select("image_id")

    def chosen(files: DataFrame) -> DataFrame:
        return catalogue.one_file_per_stem(files.join(keep, "image_id", "left_semi"))

    pictures = images.readable(images.decode_chosen(spark, chosen(raw_files)))
    if normalise:
        pictures = intensity.prepare_images(pictures, channels)
    else:
        pictures = intensity.convert_channels(pictures, channels)
    masks = images.one_channel(
        images.readable(images.decode_chosen(spark, chosen(mask_files)))
    )
    return pictures, intensity.remap_masks(masks, class_mapping)
