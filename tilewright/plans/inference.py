"""Scoring a folder of images with overlapping tiles and storing masks and overlays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.blocks import IMAGE_SCHEMA, flat_map, packed, pixels
from tilewright.functions.pixels import CLASS_COLOURS
from tilewright.operators import intensity, scoring, tiles
from tilewright.operators.scoring import Predictor
from tilewright.sources import images


def prediction_overlays(pictures: DataFrame, masks: DataFrame) -> DataFrame:
    """RGB image rows: half raw, half class colour. Both sides are uint8 rows of equal size."""
    table = np.zeros((256, 3), dtype=np.float64)
    for class_id, rgb in CLASS_COLOURS.items():
        table[class_id] = rgb

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        raw = pixels(row)
        if raw.ndim == 2:
            raw = np.repeat(raw[..., np.newaxis], 3, axis=2)
        labels = np.frombuffer(row["labels"], dtype=np.uint8).reshape(raw.shape[:2])
        blended = np.rint(raw * 0.5 + table[labels] * 0.5).astype(np.uint8)
        yield {"image_id": row["image_id"], **packed(blended)}

    labelled = masks.select("image_id", F.col("data").alias("labels"))
    return pictures.select(*IMAGE_SCHEMA.names).join(labelled, "image_id").mapInArrow(
        flat_map(one, IMAGE_SCHEMA), IMAGE_SCHEMA
    )


def _as_bytes(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
    yield {
        "image_id": row["image_id"],
        **packed(np.clip(pixels(row) * 255.0, 0, 255).astype(np.uint8)),
    }


def predict_folder(
    spark: SparkSession,
    input_path: str,
    predict: Predictor,
    *,
    tile: int,
    overlap: float = 0.15,
    channels: str = "grayscale",
    batch_size: int = 4,
    normalise: bool = True,
    store: str | None = None,
    export: bool = False,
) -> DataFrame:
    """Label blocks of every supported image of a file or folder; an unreadable one is an error.

    With ``store`` the blocks are written to ``<store>/blocks`` as a table first and everything
    later reads that, so the predictor runs once. ``export`` also writes one PNG mask and one
    overlay per image.
    """
    images.require_images(images.scan_images(spark, input_path))
    pictures = images.readable(images.decode_images(spark, input_path, refuse_deep=True))
    prepared = (
        intensity.prepare_images(pictures, channels)
        if normalise
        else intensity.convert_channels(pictures, channels)
    )
    blocks = scoring.predict_stitched(
        prepared, predict, tile=tile, overlap=overlap, batch_size=batch_size
    )
    if store is None:
        return blocks
    blocks.write.mode("overwrite").parquet(f"{store}/blocks")
    blocks = spark.read.parquet(f"{store}/blocks")
    if export:
        masks = tiles.assemble_images(blocks)
        images.write_png(masks, f"{store}/predictions")
        raw = (
            prepared.mapInArrow(flat_map(_as_bytes, IMAGE_SCHEMA), IMAGE_SCHEMA)
            if normalise
            else prepared
        )
        images.write_png(prediction_overlays(raw, masks), f"{store}/overlays")
    return blocks

