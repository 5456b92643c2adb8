"""Scoring a split of image/mask pairs and reporting on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import naming
from tilewright.operators import catalogue, confusion, intensity, scoring, tiles
from tilewright.operators.scoring import Predictor
from tilewright.plans.loading import load_split
from tilewright.sources import images, synthetic


def named_matrices(counted: DataFrame, num_classes: int, allow_out_of_range: bool = False) -> DataFrame:
    """One wide matrix per image from ``image_id, gt, pred, n``, with its magnification.

    Labels outside the classes are an error unless they are allowed; then they are counted apart.
    """
    wide = confusion.count_pixels(counted, ["image_id"], num_classes, "n").withColumn(
        "magnification", naming.magnification(F.col("image_id"))
    )
    return wide if allow_out_of_range else confusion.reject_out_of_range(wide)


def per_image_matrices(
    truth_blocks: DataFrame, predicted_blocks: DataFrame, num_classes: int, allow_out_of_range: bool = False
) -> DataFrame:
    """One wide confusion matrix per image from label blocks on the same grid."""
    counted = confusion.count_blocks(confusion.align_blocks(truth_blocks, predicted_blocks))
    return named_matrices(counted, num_classes, allow_out_of_range)


def evaluate_images(
    image_rows: DataFrame,
    mask_rows: DataFrame,
    predict: Predictor,
    *,
    tile: int,
    batch_size: int = 4,
    num_classes: int = 3,
    allow_out_of_range: bool = False,
) -> DataFrame:
    """Per-image matrices for prepared images and remapped masks from two tables.

    Raw pixels never move: images are scored where they were read, masks are cut on the same grid,
    and only label blocks, one byte per pixel, are joined.
    """
    predicted = scoring.predict_labels(image_rows, predict, tile=tile, batch_size=batch_size)
    return per_image_matrices(tiles.cut_blocks(mask_rows, tile), predicted, num_classes, allow_out_of_range)


def evaluate_pairs(
    pairs: DataFrame,
    predict: Predictor,
    *,
    tile: int,
    batch_size: int = 4,
    num_classes: int = 3,
    allow_out_of_range: bool = False,
) -> DataFrame:
    """Per-image matrices for rows that hold image and mask together.

    Scoring and counting happen in the task that reads the row; a few counts per image are all
    that is shuffled.
    """
    counted = scoring.count_pairs(pairs, predict, tile=tile, batch_size=batch_size)
    return named_matrices(counted, num_classes, allow_out_of_range)


def evaluate_split(
    spark: SparkSession,
    raw_dir: str,
    masks_dir: str,
    splits_dir: str,
    split: str,
    predict: Predictor,
    *,
    tile: int,
    channels: str = "grayscale",
    class_mapping: dict[int, int] | None = None,
    batch_size: int = 4,
    num_classes: int = 3,
    normalise: bool = True,
    allow_out_of_range: bool = False,
) -> DataFrame:
    """Per-image matrices of a split stored as files; a listed image without files is an error."""
    pictures, masks = load_split(
        spark,
        raw_dir,
        masks_dir,
        splits_dir,
        split,
        channels=channels,
        class_mapping=class_mapping,
        normalise=normalise,
    )
    return evaluate_images(
        pictures,
        masks,
        predict,
        tile=tile,
        batch_size=batch_size,
        num_classes=num_classes,
        allow_out_of_range=allow_out_of_range,
    )


def evaluate_synthetic(
    spark: SparkSession,
    split: str,
    predict: Predictor,
    *,
    tile: int,
    n_images: int = 16,
    height: int = 512,
    width: int = 512,
    seed: int = 42,
    batch_size: int = 4,
    class_mapping: dict[int, int] | None = None,
    num_classes: int = 3,
    allow_out_of_range: bool = False,
) -> DataFrame:
    """The same for a split of synthetic pictures, when there is no annotated data yet."""
    pairs = synthetic.synthetic_split(
        spark, split, n_images, height=height, width=width, seed=seed
    )
    pairs = intensity.remap_pairs(pairs, class_mapping)
    return evaluate_pairs(pairs, predict, tile=tile, batch_size=batch_size, num_classes=num_classes, allow_out_of_range=allow_out_of_range)


def evaluate_or_synthetic(
    spark: SparkSession, raw_dir: str, masks_dir: str, splits_dir: str, split: str, predict: Predictor, *, tile: int, **options
) -> DataFrame:
    """``evaluate_split`` where there is any image with a mask, else the same on synthetic pictures.

    Options about stored pictures (``channels``, ``normalise``) say nothing about synthetic ones.
    """
    raw, masks = images.scan_images(spark, raw_dir), images.scan_images(spark, masks_dir)
    if catalogue.has_pairs(raw, masks):
        return evaluate_split(spark, raw_dir, masks_dir, splits_dir, split, predict, tile=tile, **options)
    options = {k: v for k, v in options.items() if k not in ("channels", "normalise")}
    return evaluate_synthetic(spark, split, predict, tile=tile, **options)
