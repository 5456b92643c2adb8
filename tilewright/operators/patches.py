"""Training patches: random candidates, quotas for object patches, top-up and cropping."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tilewright.functions import geometry
from tilewright.functions.blocks import IMAGE_SCHEMA, OUTPUT_BATCH_ROWS, flat_map, iter_rows, packed, pixels
from tilewright.functions.draws import draw_integer, draw_key
from tilewright.operators.tiles import axis_reflection


def attempts_for(per_image: int) -> int:
    """Random positions to try per image."""
    return max(per_image * 10, 1000)


def object_quota(per_image: int, object_ratio: float) -> int:
    """Object patches wanted per image, rounded half to even."""
    return round(per_image * object_ratio)


def candidate_origins(
    sizes: DataFrame, *, patch: int, per_image: int, seed: int, attempts: int | None = None
) -> DataFrame:
    """Add ``candidates``: an array of ``attempt, y0, x0`` on the padded canvas.

    ``sizes`` has ``image_id, height, width``. The array has a fixed length, so the draws stay in
    the row of their image and nothing is shuffled.
    """
    n = attempts or attempts_for(per_image)
    room_y = F.col("height") + geometry.minimum_padding(F.col("height"), patch) - patch + 1
    room_x = F.col("width") + geometry.minimum_padding(F.col("width"), patch) - patch + 1

    def draw(attempt):
        key = draw_key(seed, F.col("image_id"), attempt)
        return F.struct(
            attempt.cast("int").alias("attempt"),
            F.pmod(draw_integer(key, 0), room_y).cast("int").alias("y0"),
            F.pmod(draw_integer(key, 1), room_x).cast("int").alias("x0"),
        )

    return sizes.withColumn(
        "candidates", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw)
    )


CANDIDATE_SCHEMA = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("y0", T.IntegerType()),
        T.StructField("x0", T.IntegerType()),
        T.StructField("foreground", T.LongType()),
    ]
)


def _padded(image: np.ndarray, patch: int) -> np.ndarray:
    """Reflect-pad up to one patch, half on each side."""
    for axis in (0, 1):
        missing = max(0, patch - image.shape[axis])
        if missing:
            index = axis_reflection(image.shape[axis], missing // 2, image.shape[axis] + missing)
            image = np.take(image, index, axis=axis)
    return image


def _foreground_counter(patch: int, pickable: tuple[float, int, int] | None = None):
    """For ``mapInArrow``: foreground pixels under every candidate, in column batches.

    ``pickable`` (threshold, object quota, background quota) keeps the earliest of each kind only.
    """
    schema = to_arrow_schema(CANDIDATE_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for counted in count(batches):
            waiting.append(counted)
            held += counted.num_rows
            if held >= OUTPUT_BATCH_ROWS:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, held = [], 0
        if held:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    def earliest(counts: np.ndarray) -> np.ndarray:
        threshold, objects, others = pickable
        is_object = counts / float(patch * patch) > threshold
        return np.where(is_object, is_object.cumsum() <= objects, (~is_object).cumsum() <= others)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = batch.column("candidates")
            bare = batch.drop_columns(["candidates"])
            for i, row in enumerate(iter_rows(iter([bare]))):
                inside = _padded(pixels(row), patch) > 0
                area = np.zeros((inside.shape[0] + 1, inside.shape[1] + 1), dtype=np.int64)
                area[1:, 1:] = inside.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
                places = drawn[i].values
                y = places.field("y0").to_numpy()
                x = places.field("x0").to_numpy()
                counts = (
                    area[y + patch, x + patch] - area[y, x + patch] - area[y + patch, x] + area[y, x]
                )
                counted = pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(row["image_id"]), len(counts)),
                        places.field("attempt"),
                        places.field("y0"),
                        places.field("x0"),
                        pa.array(counts),
                    ],
                    schema=schema,
                )
                yield counted.filter(pa.array(earliest(counts))) if pickable else counted

    return run


def score_candidates(
    masks: DataFrame,
    *,
    patch: int,
    per_image: int,
    min_object_fraction: float,
    seed: int,
    attempts: int | None = None,
    object_ratio: float | None = None,
) -> DataFrame:
    """``image_id, attempt, y0, x0, fg_fraction, is_object`` for every candidate of every mask.

    With ``object_ratio`` only for those that ``select_patches`` can pick, the earliest of each kind
    up to its quota. All candidates of a mask are in its row, so the others never leave it.
    """
    pickable = None
    if object_ratio is not None:
        quota = object_quota(per_image, object_ratio)
        pickable = (min_object_fraction, quota, per_image - quota)
    drawn = candidate_origins(
        masks.select(*IMAGE_SCHEMA.names),
        patch=patch,
        per_image=per_image,
        seed=seed,
        attempts=attempts,
    )
    counted = drawn.mapInArrow(_foreground_counter(patch, pickable), CANDIDATE_SCHEMA)
    return with_object_flag(counted, patch, min_object_fraction)


def with_object_flag(counted: DataFrame, patch: int, min_object_fraction: float) -> DataFrame:
    """Foreground share of a patch, strictly above the threshold for object patches."""
    share = F.col("foreground").cast("double") / F.lit(float(patch * patch)).cast("double")
    return (
        counted.withColumn("fg_fraction", share)
        .withColumn("is_object", F.col("fg_fraction") > F.lit(min_object_fraction).cast("double"))
        .drop("foreground")
    )


def select_patches(
    candidates: DataFrame, *, per_image: int, object_ratio: float, seed: int
) -> DataFrame:
    """Exactly ``per_image`` patches per image that has any.

    The earliest attempts fill the object and background quotas, the pick is put in hash order,
    and a shortage is made good by drawing from the pick with replacement. Windows here hold at
    most ``attempts`` small rows per image. Adds ``patch_id`` (from 1) and ``repeated``.
    """
    quota = object_quota(per_image, object_ratio)
    wanted = F.when(F.col("is_object"), F.lit(quota)).otherwise(F.lit(per_image - quota))
    first = Window.partitionBy("image_id", "is_object").orderBy("attempt")
    # The plain bound lets the optimiser cut the candidates down before they are shuffled.
    picked = (
        candidates.withColumn("_order", F.row_number().over(first))
        .filter((F.col("_order") <= max(quota, per_image - quota)) & (F.col("_order") <= wanted))
        .drop("_order")
        .withColumn("_key", draw_key(seed, F.lit("pick"), F.col("image_id"), F.col("attempt")))
    )
    shuffled = Window.partitionBy("image_id").orderBy("_key", "attempt")
    ranked = picked.withColumn("_rank", F.row_number().over(shuffled)).withColumn(
        "_have", F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    )
    # Every patch looks up how often it is drawn for the empty places have+1 .. per_image.
    slots = F.sequence(F.col("_have").cast("int"), F.lit(per_image))

    def hits(slot):
        drawn = draw_integer(draw_key(seed, F.lit("extra"), F.col("image_id"), slot))
        return (slot > F.col("_have")) & (F.pmod(drawn, F.col("_have")) + 1 == F.col("_rank"))

    places = F.concat(F.array(F.col("_rank").cast("int")), F.filter(slots, hits))
    return (
        ranked.withColumn("patch_id", F.explode(places))
        .withColumn("repeated", F.col("patch_id") > F.col("_have"))
        .drop("_key", "_rank", "_have")
    )


PATCH_SCHEMA = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("patch_id", T.IntegerType()),
        T.StructField("y0", T.IntegerType()),
        T.StructField("x0", T.IntegerType()),
        T.StructField("fg_fraction", T.DoubleType()),
        T.StructField("is_object", T.BooleanType()),
        T.StructField("patch", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("image", T.BinaryType()),
        T.StructField("mask", T.BinaryType()),
    ]
)


def _cropper(patch: int):
    def crop(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        image = _padded(pixels(row), patch)
        mask = np.frombuffer(row["mask"], dtype=np.uint8).reshape(row["height"], row["width"])
        mask = _padded(mask, patch)
        for place in row["places"]:
            y, x = place["y0"], place["x0"]
            cut = packed(image[y : y + patch, x : x + patch])
            yield {
                "image_id": row["image_id"],
                **place,
                "patch": patch,
                "channels": cut["channels"],
                "dtype": cut["dtype"],
                "image": cut["data"],
                "mask": np.ascontiguousarray(mask[y : y + patch, x : x + patch]).tobytes(),
            }

    return crop


def crop_patches(pairs: DataFrame, selected: DataFrame, patch: int) -> DataFrame:
    """Patch rows with image and mask bytes.

    ``pairs`` are image rows with a ``mask`` column (uint8, same size). The places of an image
    (a fixed number) are gathered first, so every image is read once.
    """
    places = selected.groupBy("image_id").agg(
        F.collect_list(F.struct("patch_id", "y0", "x0", "fg_fraction", "is_object")).alias("places")
    )
    return (
        pairs.select(*IMAGE_SCHEMA.names, "mask")
        .join(places, "image_id")
        .mapInArrow(flat_map(_cropper(patch), PATCH_SCHEMA), PATCH_SCHEMA)
    )


def pair_pixels(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Image rows with the mask of the same id alongside; sizes must agree."""
    other = masks.select(
        "image_id",
        F.col("height").alias("_h"),
        F.col("width").alias("_w"),
        F.col("data").alias("mask"),
    )
    agree = (F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w"))
    checked = F.when(agree, F.col("mask")).otherwise(
        F.raise_error(F.concat(F.lit("image and mask differ in size: "), F.col("image_id")))
    )
    return (
        images.select(*IMAGE_SCHEMA.names)
        .join(other, "image_id")
        .withColumn("mask", checked)
        .drop("_h", "_w")
    )


def build_patches(
    images: DataFrame,
    masks: DataFrame,
    *,
    patch: int,
    per_image: int,
    object_ratio: float,
    min_object_fraction: float,
    seed: int,
) -> DataFrame:
    """Patch table of a split: candidates on the masks, quotas, crops."""
    candidates = score_candidates(
        masks,
        patch=patch,
        per_image=per_image,
        min_object_fraction=min_object_fraction,
        seed=seed,
        object_ratio=object_ratio,
    )
    selected = select_patches(
        candidates, per_image=per_image, object_ratio=object_ratio, seed=seed
    )
    return crop_patches(pair_pixels(images, masks), selected, patch)
