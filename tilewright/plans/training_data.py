"""The data side of training: a stored patch table for a split, in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.operators.augment import AugmentSpec, augment_patches
from tilewright.operators.batches import assign_batches
from tilewright.operators.patches import build_patches
from tilewright.plans.loading import load_split


def patch_table(
    images: DataFrame,
    masks: DataFrame,
    *,
    patch: int = 512,
    per_image: int = 16,
    object_ratio: float = 0.8,
    min_object_fraction: float = 0.05,
    seed: int = 42,
    augment: AugmentSpec | None = None,
) -> DataFrame:
    """Patches of prepared images; augmented when a spec is given (training), else as cut."""
    patches = build_patches(
        images,
        masks,
        patch=patch,
        per_image=per_image,
        object_ratio=object_ratio,
        min_object_fraction=min_object_fraction,
        seed=seed,
    )
    return augment_patches(patches, augment, seed=seed) if augment is not None else patches


def split_patch_table(
    spark: SparkSession,
    raw_dir: str,
    masks_dir: str,
    splits_dir: str,
    split: str,
    *,
    channels: str = "grayscale",
    class_mapping: dict[int, int] | None = None,
    normalise: bool = True,
    **patch_options,
) -> DataFrame:
    """The patch table of a split stored as files; see ``patch_table`` for the options."""
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
    return patch_table(pictures, masks, **patch_options)


def batch_index(patches: DataFrame, batch_size: int, *, seed: int | None) -> DataFrame:
    """``image_id, patch_id, batch_id, slot``; the index holds keys only, never pixels."""
    return assign_batches(
        patches.select("image_id", "patch_id"), ["image_id", "patch_id"], batch_size, seed=seed
    )
