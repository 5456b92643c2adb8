"""Synthetic image/mask pairs for tests and trial runs: stripes and blobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.blocks import IMAGE_SCHEMA, flat_map, packed
from tilewright.functions.draws import draw_integer, draw_key
from tilewright.operators.splits import assign_splits

# Grey bands per class (upper ends excluded), circles per class and their radii.
BAND_BACKGROUND = (0, 80)
BAND_CELL = (120, 180)
BAND_AGGREGATE = (180, 255)
BAND_ANY = (0, 256)
AGGREGATES = 4
CELLS = 6
MIXED_CIRCLES = 5
MIXED_MARGIN = 64
MIXED_RADII = (20, 60)
AGGREGATE_MARGIN = 100
CELL_MARGIN = 80
RADII = {"4x": ((40, 70), (15, 35)), "10x": ((80, 130), (35, 70))}


def stripe_label(y: Column, height: Column, labels: Sequence[int]) -> Column:
    """Class of row ``y`` when the labels are equal horizontal bands."""
    k = len(labels)
    band = F.floor(((y + 1) * k - 1) / height).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in labels]), band + 1)


def stripe_masks(sizes: DataFrame, labels: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """Mask image rows of stripes. ``sizes``: image_id, height, width."""

    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        line = np.arange(1, row["height"] + 1) * len(labels) - 1
        of_line = np.asarray(labels, dtype=np.uint8)[line // row["height"]]
        yield {"image_id": row["image_id"], **packed(np.repeat(of_line[:, np.newaxis], row["width"], axis=1))}

    return sizes.select("image_id", "height", "width").mapInArrow(
        flat_map(one, IMAGE_SCHEMA), IMAGE_SCHEMA
    )


def synthetic_names(spark: SparkSession, n_images: int) -> DataFrame:
    """``idx, image_id, magnification``: even indices are 4x, odd ones 10x."""
    return named(spark.range(n_images).select(F.col("id").alias("idx")))


def named(indices: DataFrame) -> DataFrame:
    """Add the synthetic name and magnification to rows with ``idx``."""
    magnification = F.when(F.col("idx") % 2 == 0, "4x").otherwise("10x")
    return indices.withColumn("magnification", magnification).withColumn(
        "image_id",
        F.concat(
            F.lit("synth_"),
            F.when(F.col("idx") < 1000, F.lpad(F.col("idx").cast("string"), 3, "0")).otherwise(
                F.col("idx").cast("string")
            ),
            F.lit("_"),
            F.col("magnification"),
        ),
    )


def draw_circles(names: DataFrame, *, height: int, width: int, seed: int, scale: float = 1.0) -> DataFrame:
    """Add ``circles``: ten of ``step, cy, cx, radius, label`` in drawing order.

    ``scale`` shrinks margins and radii for small canvases.
    """

    def span(low: int, high: int) -> tuple[int, int]:
        low, high = int(low * scale), int(high * scale)
        return low, max(high - low, 1)

    def circle(step: int) -> Column:
        aggregate = step < AGGREGATES
        margin = int((AGGREGATE_MARGIN if aggregate else CELL_MARGIN) * scale)
        key = draw_key(seed, F.col("image_id"), step)
        radii = {m: span(*r[0 if aggregate else 1]) for m, r in RADII.items()}
        is_4x = F.col("magnification") == "4x"
        low = F.when(is_4x, radii["4x"][0]).otherwise(radii["10x"][0])
        room = F.when(is_4x, radii["4x"][1]).otherwise(radii["10x"][1])
        return F.struct(
            F.lit(step).alias("step"),
            (F.pmod(draw_integer(key, 0), F.lit(max(height - 2 * margin, 1))) + margin).cast("int").alias("cy"),
            (F.pmod(draw_integer(key, 1), F.lit(max(width - 2 * margin, 1))) + margin).cast("int").alias("cx"),
            (F.pmod(draw_integer(key, 2), room) + low).cast("int").alias("radius"),
            F.lit(2 if aggregate else 1).alias("label"),
        )

    return names.select(
        "image_id",
        F.lit(height).alias("height"),
        F.lit(width).alias("width"),
        draw_integer(draw_key(seed, "noise", F.col("image_id"))).alias("noise_seed"),
        F.array(*[circle(i) for i in range(AGGREGATES + CELLS)]).alias("circles"),
    )


def draw_mixed_circles(names: DataFrame, *, height: int, width: int, seed: int) -> DataFrame:
    """Five circles of random class 1 to 3 per picture, as the batch viewer draws them."""

    def circle(step: int) -> Column:
        key = draw_key(seed, F.lit("mixed"), F.col("image_id"), step)
        at = lambda word, size: (F.pmod(draw_integer(key, word), F.lit(size))).cast("int")
        return F.struct(
            F.lit(step).alias("step"),
            (at(0, max(height - 2 * MIXED_MARGIN, 1)) + MIXED_MARGIN).alias("cy"),
            (at(1, max(width - 2 * MIXED_MARGIN, 1)) + MIXED_MARGIN).alias("cx"),
            (at(2, MIXED_RADII[1] - MIXED_RADII[0]) + MIXED_RADII[0]).alias("radius"),
            (at(3, 3) + 1).alias("label"),
        )

    return names.select(
        "image_id",
        F.lit(height).alias("height"),
        F.lit(width).alias("width"),
        draw_integer(draw_key(seed, "noise", F.col("image_id"))).alias("noise_seed"),
        F.array(*[circle(i) for i in range(MIXED_CIRCLES)]).alias("circles"),
    )


# Lowest gray and width of the gray band, by class. Class 3, which only the batch viewer draws, may have any gray.
GRAY_LOW, GRAY_WIDTH = np.array(
    [(low, high - low) for low, high in (BAND_BACKGROUND, BAND_CELL, BAND_AGGREGATE, BAND_ANY)], dtype=np.float32
).T

PAIR_SCHEMA = T.StructType([*IMAGE_SCHEMA.fields, T.StructField("mask", T.BinaryType())])


def _paint(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
    height, width = row["height"], row["width"]
    mask = np.zeros((height, width), dtype=np.uint8)
    for c in row["circles"]:
        y0, y1 = max(0, c["cy"] - c["radius"]), min(height, c["cy"] + c["radius"] + 1)
        x0, x1 = max(0, c["cx"] - c["radius"]), min(width, c["cx"] + c["radius"] + 1)
        dy, dx = np.ogrid[y0 - c["cy"] : y1 - c["cy"], x0 - c["cx"] : x1 - c["cx"]]
        mask[y0:y1, x0:x1][dy * dy + dx * dx <= c["radius"] ** 2] = c["label"]
    drawn = np.random.default_rng(row["noise_seed"]).random(mask.shape, dtype=np.float32)
    raw = (GRAY_LOW[mask] + drawn * GRAY_WIDTH[mask]).astype(np.uint8)
    yield {"image_id": row["image_id"], **packed(raw), "mask": mask.tobytes()}


def paint_pairs(drawn: DataFrame) -> DataFrame:
    """Image rows with a ``mask`` column, painted circle by circle; later circles lie on top."""
    return drawn.mapInArrow(flat_map(_paint, PAIR_SCHEMA), PAIR_SCHEMA)


def masks_of(pairs: DataFrame) -> DataFrame:
    """The masks of pair rows as image rows."""
    return pairs.select(
        "image_id",
        "height",
        "width",
        F.lit(1).alias("channels"),
        F.lit("uint8").alias("dtype"),
        F.col("mask").alias("data"),
    )


def synthetic_dataset(
    spark: SparkSession, n_images: int = 8, *, height: int = 512, width: int = 512, seed: int = 42
) -> DataFrame:
    """Blob pairs ``synth_000_4x, synth_001_10x, ...``."""
    return paint_pairs(draw_circles(synthetic_names(spark, n_images), height=height, width=width, seed=seed))


def synthetic_splits(spark: SparkSession, n_images: int, seed: int = 42) -> DataFrame:
    """``image_id, split``: 70 / 15 / 15 within each magnification."""
    return splits_of(synthetic_names(spark, n_images), seed)


def splits_of(names: DataFrame, seed: int = 42) -> DataFrame:
    """``image_id, split`` of rows with ``image_id, magnification``."""
    members = names.select("image_id", "magnification", F.lit("").alias("condition"))
    return assign_splits(members, seed=seed).select("image_id", "split")


def synthetic_split(
    spark: SparkSession,
    split: str,
    n_images: int = 16,
    *,
    height: int = 512,
    width: int = 512,
    seed: int = 42,
) -> DataFrame:
    """Blob pairs of one split; only its pictures are painted."""
    members = synthetic_splits(spark, n_images, seed).filter(F.col("split") == split)
    names = synthetic_names(spark, n_images).join(members, "image_id", "left_semi")
    return paint_pairs(draw_circles(names, height=height, width=width, seed=seed))


def threshold_labels(batch: np.ndarray) -> np.ndarray:
    """A predictor for synthetic raw pixels: cuts at the lower ends of the two object bands."""
    gray = batch[..., 0]
    return (gray >= BAND_CELL[0] - 20).astype(np.uint8) + (gray >= BAND_AGGREGATE[0]).astype(np.uint8)


def threshold_logits(batch: np.ndarray) -> np.ndarray:
    """The same cuts as logits of three classes."""
    labels = threshold_labels(batch)
    return (labels[..., np.newaxis] == np.arange(3)).astype(np.float32) * 10.0
