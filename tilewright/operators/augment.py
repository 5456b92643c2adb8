"""Seeded augmentation of patch rows: draws are columns, pixels change inside one narrow stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.blocks import flat_map
from tilewright.functions.draws import counter_normals, counter_uniforms, draw_integer, draw_key, draw_uniform
from tilewright.functions.pixels import clip, double
from tilewright.operators.patches import PATCH_SCHEMA
from tilewright.operators.tiles import axis_reflection


@dataclass(frozen=True)
class AugmentSpec:
    """Probabilities and ranges. The defaults are the published settings."""

    flip_probability: float = 0.5
    rotate90_probability: float = 0.5
    elastic_probability: float = 0.3
    elastic_alpha: float = 1.0
    elastic_sigma: float = 50.0
    scale_probability: float = 0.5
    scale_range: tuple[float, float] = (0.5, 2.0)
    blur_probability: float = 0.2
    blur_limit: tuple[int, int] = (3, 7)
    blur_sigma_limit: tuple[float, float] = (0.1, 2.0)
    noise_probability: float = 0.2
    noise_std_range: tuple[float, float] = (0.01, 0.05)
    brightness_contrast_probability: float = 0.5
    brightness_limit: float = 0.3
    contrast_limit: float = 0.3

    def __post_init__(self) -> None:
        if len(self.scale_range) != 2:
            raise ValueError("scale_range needs a lower and an upper bound")


def _between(key: Column, word: int, low: float, high: float) -> Column:
    return double(low) + draw_uniform(key, word) * double(high - low)


def draw_parameters(patches: DataFrame, spec: AugmentSpec, seed: int) -> DataFrame:
    """Add one column per drawn parameter; null or false means the step is skipped."""

    def key(step: str) -> Column:
        return draw_key(seed, F.lit(step), F.col("image_id"), F.col("patch_id"))

    def hit(step: str, probability: float) -> Column:
        return draw_uniform(key(step), 0) < double(probability)

    blur_low, blur_high = spec.blur_limit
    sizes = list(range(blur_low | 1, blur_high + 1, 2))
    size_at = F.pmod(draw_integer(key("blur"), 1), F.lit(len(sizes))) + 1
    jitter = hit("jitter", spec.brightness_contrast_probability)
    return patches.withColumns(
        {
            "flip_h": hit("flip_h", spec.flip_probability),
            "flip_v": hit("flip_v", spec.flip_probability),
            "quarter_turns": F.when(
                hit("rotate", spec.rotate90_probability),
                F.pmod(draw_integer(key("rotate"), 1), F.lit(4)).cast("int"),
            ).otherwise(0),
            "elastic_seed": F.when(
                hit("elastic", spec.elastic_probability), draw_integer(key("elastic"), 1)
            ),
            "zoom": F.when(
                hit("zoom", spec.scale_probability), _between(key("zoom"), 1, *spec.scale_range)
            ),
            "blur_size": F.when(
                hit("blur", spec.blur_probability),
                F.element_at(F.array(*[F.lit(s) for s in sizes]), size_at.cast("int")),
            ),
            "blur_sigma": F.when(
                hit("blur", spec.blur_probability), _between(key("blur"), 2, *spec.blur_sigma_limit)
            ),
            "noise_std": F.when(
                hit("noise", spec.noise_probability), _between(key("noise"), 1, *spec.noise_std_range)
            ),
            "noise_seed": draw_integer(key("noise"), 2),
            "contrast": F.when(
                jitter, double(1.0) + _between(key("jitter"), 1, -spec.contrast_limit, spec.contrast_limit)
            ),
            "brightness": F.when(
                jitter, _between(key("jitter"), 2, -spec.brightness_limit, spec.brightness_limit)
            ),
        }
    )


DRAWN = (
    "flip_h",
    "flip_v",
    "quarter_turns",
    "elastic_seed",
    "zoom",
    "blur_size",
    "blur_sigma",
    "noise_std",
    "noise_seed",
    "contrast",
    "brightness",
)


def turned_position(
    y: Column, x: Column, side: int, flip_h: Column, flip_v: Column, turns: Column
) -> tuple[Column, Column]:
    """Where a pixel of a square patch lands after the flips and counter-clockwise turns."""
    last = F.lit(side - 1)
    x1 = F.when(flip_h, last - x).otherwise(x)
    y1 = F.when(flip_v, last - y).otherwise(y)
    new_y = (
        F.when(turns == 1, last - x1).when(turns == 2, last - y1).when(turns == 3, x1).otherwise(y1)
    )
    new_x = (
        F.when(turns == 1, y1).when(turns == 2, last - x1).when(turns == 3, last - y1).otherwise(x1)
    )
    return new_y, new_x


def jittered(value: Column, contrast: Column, brightness: Column, top: float) -> Column:
    """Contrast and brightness on one pixel, clipped to [0, top]."""
    return clip(value * contrast + brightness * double(top), double(0.0), double(top))


def _sample(image: np.ndarray, y: np.ndarray, x: np.ndarray, nearest: bool) -> np.ndarray:
    """Values at real positions, mirrored outside; bilinear or nearest."""
    height, width = image.shape[:2]

    def mirrored(index: np.ndarray, size: int) -> np.ndarray:
        if size == 1:
            return np.zeros_like(index)
        folded = np.mod(index, 2 * (size - 1))
        return np.where(folded < size, folded, 2 * (size - 1) - folded)

    if nearest:
        rows = mirrored(np.rint(y).astype(np.intp), height)
        cols = mirrored(np.rint(x).astype(np.intp), width)
        return image[rows, cols]
    low_y, low_x = np.floor(y).astype(np.intp), np.floor(x).astype(np.intp)
    part_y, part_x = y - low_y, x - low_x
    if image.ndim == 3:
        part_y, part_x = part_y[..., np.newaxis], part_x[..., np.newaxis]
    top, bottom = mirrored(low_y, height), mirrored(low_y + 1, height)
    left, right = mirrored(low_x, width), mirrored(low_x + 1, width)
    upper = image[top, left] * (1 - part_x) + image[top, right] * part_x
    lower = image[bottom, left] * (1 - part_x) + image[bottom, right] * part_x
    return upper * (1 - part_y) + lower * part_y


@lru_cache(maxsize=64)
def _smoother(size: int, radius: int, sigma: float) -> np.ndarray:
    """Matrix that smooths one axis with a bell of the given radius and mirrored edges."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    source = axis_reflection(size, radius, size + 2 * radius)
    matrix = np.zeros((size, size))
    for offset, weight in enumerate(weights):
        np.add.at(matrix, (np.arange(size), source[offset : offset + size]), weight)
    return matrix


def _smooth(field: np.ndarray, radius: int, sigma: float) -> np.ndarray:
    rows = _smoother(field.shape[0], radius, sigma)
    cols = _smoother(field.shape[1], radius, sigma)
    return np.einsum("ij,jk...->ik...", rows, np.einsum("kl,jl...->jk...", cols, field, optimize=True), optimize=True)


def _augment(sigma: float, alpha: float, hook: Callable | None):
    def one(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        side = row["patch"]
        dtype = np.dtype(row["dtype"])
        top = 255.0 if dtype.kind == "u" else 1.0
        shape = (side, side) if row["channels"] == 1 else (side, side, row["channels"])
        image = np.frombuffer(row["image"], dtype=dtype).reshape(shape).astype(np.float64)
        mask = np.frombuffer(row["mask"], dtype=np.uint8).reshape(side, side)
        if hook is not None:
            image, mask = hook(image, mask, row)
        if row["flip_h"]:
            image, mask = image[:, ::-1], mask[:, ::-1]
        if row["flip_v"]:
            image, mask = image[::-1], mask[::-1]
        image, mask = np.rot90(image, row["quarter_turns"]), np.rot90(mask, row["quarter_turns"])
        grid_y, grid_x = np.mgrid[0:side, 0:side].astype(np.float64)
        if row["elastic_seed"] is not None:
            reach = max(1, int(3 * sigma))
            shift_y, shift_x = (
                _smooth(2 * counter_uniforms(row["elastic_seed"], stream, (side, side)) - 1, reach, sigma) * alpha for stream in (0, 1)
            )
            image = _sample(image, grid_y + shift_y, grid_x + shift_x, nearest=False)
            mask = _sample(mask, grid_y + shift_y, grid_x + shift_x, nearest=True)
        if row["zoom"] is not None:
            centre = (side - 1) / 2
            zoomed_y = centre + (grid_y - centre) / row["zoom"]
            zoomed_x = centre + (grid_x - centre) / row["zoom"]
            image = _sample(image, zoomed_y, zoomed_x, nearest=False)
            mask = _sample(mask, zoomed_y, zoomed_x, nearest=True)
        if row["blur_size"] is not None:
            image = _smooth(image, row["blur_size"] // 2, row["blur_sigma"])
        if row["noise_std"] is not None:
            image = image + row["noise_std"] * top * counter_normals(row["noise_seed"], image.shape)
        if row["contrast"] is not None:
            image = image * row["contrast"] + row["brightness"] * top
        image = np.clip(image, 0.0, top)
        if dtype.kind == "u":
            image = np.rint(image)
        yield {
            **row,
            "image": np.ascontiguousarray(image.astype(dtype)).tobytes(),
            "mask": np.ascontiguousarray(mask.astype(np.uint8)).tobytes(),
        }

    return one


def augment_patches(
    patches: DataFrame,
    spec: AugmentSpec | None = None,
    *,
    seed: int,
    hook: Callable | None = None,
) -> DataFrame:
    """Augmented patch rows of unchanged size and type; image and mask share their geometry.

    ``hook`` is an optional user function ``(image, mask, row) -> (image, mask)`` that runs before
    the drawn steps.
    """
    spec = spec or AugmentSpec()
    drawn = draw_parameters(patches.select(*PATCH_SCHEMA.names), spec, seed)
    schema = drawn.schema
    kernel = flat_map(_augment(spec.elastic_sigma, spec.elastic_alpha, hook), schema)
    return drawn.mapInArrow(kernel, schema)
