"""Per-image percentiles, normalisation and channel conversion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.blocks import BLOCK_SCHEMA, IMAGE_SCHEMA, flat_map, packed, pixels
from tilewright.functions.pixels import LUMINANCE
from tilewright.operators.annotation import label_counts


def percentiles(
    counts: DataFrame, key: str = "image_id", value: str = "label", low: float = 1, high: float = 99
) -> DataFrame:
    """Exact linear percentiles per image from a histogram ``key, value, n``.

    Integer images have at most 65536 different values, which bounds the state per image.
    """
    at = F.array(F.lit(low / 100).cast("double"), F.lit(high / 100).cast("double"))
    return (
        counts.groupBy(key)
        .agg(F.percentile(F.col(value).cast("double"), at, F.col("n")).alias("_p"))
        .select(key, F.col("_p")[0].alias("p_low"), F.col("_p")[1].alias("p_high"))
    )


def block_percentiles(blocks: DataFrame, low: float = 1, high: float = 99) -> DataFrame:
    """Percentiles of integer images that are spread over several block rows."""
    return percentiles(label_counts(blocks), low=low, high=high)


# Pixels whose values are counted at a time.
STRIP_PIXELS = 1 << 20


def _levels(image: np.ndarray) -> np.ndarray | None:
    """How often each value occurs, for integer images of up to 16 bits; strip by strip."""
    if image.dtype not in (np.uint8, np.uint16):
        return None
    counts = np.zeros(np.iinfo(image.dtype).max + 1, dtype=np.int64)
    flat = image.reshape(-1)
    for at in range(0, flat.size, STRIP_PIXELS):
        counts += np.bincount(flat[at : at + STRIP_PIXELS], minlength=counts.size)
    return counts


def _limits(image: np.ndarray, low: float, high: float) -> tuple[float, float]:
    """Percentiles with linear interpolation, off the value counts where there are any."""
    counts = _levels(image)
    if counts is None:
        found = np.percentile(image, [low, high])
        return float(found[0]), float(found[1])
    reached = np.cumsum(counts)
    out = []
    for q in (low, high):
        rank = q / 100 * (image.size - 1)
        below, above = np.searchsorted(reached, [int(rank), min(int(rank) + 1, image.size - 1)], side="right")
        out.append(float(below + (above - below) * (rank - int(rank))))
    return out[0], out[1]


def _unit(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """0 at ``low`` and 1 at ``high``, cut off beyond; all 0 if there is nothing between."""
    span = high - low
    place = (values - np.float64(low)) / span if span > 0 else np.zeros(values.shape)
    return np.clip(place, 0, 1, out=place).astype(np.float32)


def _scale(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Integer images are scaled by looking their values up, so no wide copy of them is made."""
    if image.dtype in (np.uint8, np.uint16):
        return _unit(np.arange(np.iinfo(image.dtype).max + 1), low, high)[image]
    return _unit(image, low, high)


def normalise_images(images: DataFrame, low: float = 1, high: float = 99) -> DataFrame:
    """Scale whole-image rows to [0, 1] between their percentiles, all channels together.

    The image is in the row, so its percentiles are taken there: no shuffle.
    """

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        image = pixels(row)
        yield {"image_id": row["image_id"], **packed(_scale(image, *_limits(image, low, high)))}

    return images.select(*IMAGE_SCHEMA.names).mapInArrow(flat_map(one, IMAGE_SCHEMA), IMAGE_SCHEMA)


def normalise_blocks(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """Scale block rows with limits that were computed over all blocks of the image."""

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        yield {**row, **packed(_scale(pixels(row), row["p_low"], row["p_high"]))}

    return blocks.select(*BLOCK_SCHEMA.names).join(limits, "image_id").mapInArrow(
        flat_map(one, BLOCK_SCHEMA), BLOCK_SCHEMA
    )


def _gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    if image.shape[2] == 3:
        gray = image.astype(np.float64) @ np.array(LUMINANCE)
        if np.issubdtype(image.dtype, np.integer):
            gray = np.rint(gray)
        return gray.astype(image.dtype)
    raise ValueError(f"cannot turn {image.shape[2]} channels into gray")


def convert_channels(images: DataFrame, channels: str) -> DataFrame:
    """``grayscale`` or ``rgb`` image rows."""
    if channels not in ("grayscale", "rgb"):
        raise ValueError(f"channels must be 'grayscale' or 'rgb', got {channels!r}")

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        image = pixels(row)
        if channels == "grayscale":
            image = _gray(image)
        elif image.ndim == 2 or image.shape[2] != 3:
            image = np.repeat(_gray(image)[..., np.newaxis], 3, axis=2)
        yield {"image_id": row["image_id"], **packed(image)}

    return images.select(*IMAGE_SCHEMA.names).mapInArrow(flat_map(one, IMAGE_SCHEMA), IMAGE_SCHEMA)


def prepare_images(images: DataFrame, channels: str = "grayscale") -> DataFrame:
    """Normalise first, then convert channels, as float32 in [0, 1]."""
    return convert_channels(normalise_images(images), channels)


def remap_masks(masks: DataFrame, mapping: dict[int, int] | None) -> DataFrame:
    """Replace class ids in uint8 mask rows; ids without an entry stay. Other number types are an
    error, since their values would not fit."""
    named = mapping or {}
    table = bytes(named.get(value, value) for value in range(256))

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        if (row["channels"] or 1) != 1 or row["dtype"] != "uint8":
            raise ValueError(f"{row['image_id']}: a mask is one channel of uint8, got {row['channels']} of {row['dtype']}")
        yield {**row, "data": bytes(row["data"]).translate(table)}

    return masks.select(*IMAGE_SCHEMA.names).mapInArrow(flat_map(one, IMAGE_SCHEMA), IMAGE_SCHEMA)


def remap_channels(masks: DataFrame, mappings: Sequence[dict[int, int]]) -> DataFrame:
    """Mask rows with one channel per mapping, each as by ``remap_masks``."""
    tables = np.array([[m.get(value, value) for m in mappings] for value in range(256)], dtype=np.uint8)

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        if (row["channels"] or 1) != 1 or row["dtype"] != "uint8":
            raise ValueError(f"{row['image_id']}: a mask is one channel of uint8, got {row['channels']} of {row['dtype']}")
        yield {"image_id": row["image_id"], **packed(tables[pixels(row)])}

    return masks.select(*IMAGE_SCHEMA.names).mapInArrow(flat_map(one, IMAGE_SCHEMA), IMAGE_SCHEMA)


def remap_pairs(pairs: DataFrame, mapping: dict[int, int] | None) -> DataFrame:
    """The same for the ``mask`` bytes of rows that hold image and mask."""
    if not mapping:
        return pairs
    table = bytes(mapping.get(value, value) for value in range(256))

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        yield {**row, "data": bytes(row["data"]), "mask": bytes(row["mask"]).translate(table)}

    return pairs.mapInArrow(flat_map(one, pairs.schema), pairs.schema)


def to_bytes(images: DataFrame) -> DataFrame:
    """Float rows in [0, 1] to uint8, cut off; colour is averaged over its channels first."""

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        image = pixels(row)
        if image.ndim == 3 and image.shape[2] == 3:
            image = image.mean(axis=-1)
        yield {
            "image_id": row["image_id"],
            **packed(np.clip(image * 255.0, 0, 255).astype(np.uint8)),
        }

    return images.select(*IMAGE_SCHEMA.names).mapInArrow(flat_map(one, IMAGE_SCHEMA), IMAGE_SCHEMA)


__all__: Sequence[str] = [
    "block_percentiles",
    "convert_channels",
    "normalise_blocks",
    "normalise_images",
    "percentiles",
    "prepare_images",
    "remap_masks",
    "to_bytes",
]
