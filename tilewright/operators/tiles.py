"""Cutting images into tile rows and putting labels back into image coordinates.

One image row in, many tile rows out, in one narrow stage: no shuffle. After that a tile is the
unit of work, so no row grows with the size of the image.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.blocks import (
    BLOCK_SCHEMA,
    IMAGE_SCHEMA,
    TILE_SCHEMA,
    flat_map,
    packed,
    pixels,
)


def axis_grid(size: int, tile: int, stride: int) -> tuple[int, int]:
    """Tile count and padding before, for one axis of an overlapping grid. No pixels make no tile."""
    if size == 0:
        return 0, 0
    count = 1 if size <= tile else -(-(size - tile) // stride) + 1
    total = max((count - 1) * stride + tile - size, 0)
    return count, total // 2


def axis_reflection(size: int, before: int, length: int) -> np.ndarray:
    """Source index for each padded position: mirrored, edge not repeated."""
    if size == 1:
        return np.zeros(length, dtype=np.intp)
    folded = np.mod(np.arange(length) - before, 2 * (size - 1))
    return np.where(folded < size, folded, 2 * (size - 1) - folded)


def _cutter(tile: int, stride: int):
    def cut(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        image = pixels(row)
        height, width = image.shape[:2]
        rows, top = axis_grid(height, tile, stride)
        cols, left = axis_grid(width, tile, stride)
        source_y = axis_reflection(height, top, (rows - 1) * stride + tile)
        source_x = axis_reflection(width, left, (cols - 1) * stride + tile)
        for i in range(rows):
            band = image[source_y[i * stride : i * stride + tile]]
            for j in range(cols):
                piece = band[:, source_x[j * stride : j * stride + tile]]
                yield {
                    "image_id": row["image_id"],
                    "tile_y": i,
                    "tile_x": j,
                    "y0": i * stride,
                    "x0": j * stride,
                    "image_height": height,
                    "image_width": width,
                    "rows": rows,
                    "cols": cols,
                    "tile": tile,
                    "stride": stride,
                    "pad_top": top,
                    "pad_left": left,
                    **packed(piece),
                }

    return cut


def cut_overlapping(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """Tiles at multiples of ``stride``, with reflect padding so that the last tile fits."""
    if tile < 1 or not 1 <= stride <= tile:
        raise ValueError(f"need 1 <= stride <= tile, got tile {tile}, stride {stride}")
    return images.select(*IMAGE_SCHEMA.names).mapInArrow(
        flat_map(_cutter(tile, stride), TILE_SCHEMA), TILE_SCHEMA
    )


# A region is scored by one task as a whole: its canvas has at most so many pixels a side (one tile
# at least), and as many tiles a side, or four times as many as share a pixel.
REGION_SIDE = 1024
REGION_TILES = 16


def region_tiles(tile: int, stride: int) -> int:
    """Tiles along one side of a region."""
    wanted = max(REGION_TILES, 4 * -(-tile // stride))
    return max(1, min(wanted, (REGION_SIDE - tile) // stride + 1))


def _region_cutter(tile: int, stride: int):
    step = region_tiles(tile, stride)

    def cut(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        image = pixels(row)
        height, width = image.shape[:2]
        rows, top = axis_grid(height, tile, stride)
        cols, left = axis_grid(width, tile, stride)
        source_y = axis_reflection(height, top, (rows - 1) * stride + tile)
        source_x = axis_reflection(width, left, (cols - 1) * stride + tile)
        for i in range(0, rows, step):
            band = image[source_y[i * stride : (min(i + step, rows) - 1) * stride + tile]]
            for j in range(0, cols, step):
                piece = band[:, source_x[j * stride : (min(j + step, cols) - 1) * stride + tile]]
                yield {
                    "image_id": row["image_id"],
                    "tile_y": i,
                    "tile_x": j,
                    "y0": i * stride,
                    "x0": j * stride,
                    "image_height": height,
                    "image_width": width,
                    "rows": rows,
                    "cols": cols,
                    "tile": tile,
                    "stride": stride,
                    "pad_top": top,
                    "pad_left": left,
                    **packed(piece),
                }

    return cut


def cut_regions(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """Regions of neighbouring tiles of ``cut_overlapping``: their canvas in one row, whose
    ``tile_y, tile_x`` are those of the first tile.

    Tiles of a region share their pixels, so a row is about as large as what it shows.
    """
    if tile < 1 or not 1 <= stride <= tile:
        raise ValueError(f"need 1 <= stride <= tile, got tile {tile}, stride {stride}")
    return images.select(*IMAGE_SCHEMA.names).mapInArrow(
        flat_map(_region_cutter(tile, stride), TILE_SCHEMA), TILE_SCHEMA
    )


def cut_tiles(images: DataFrame, tile: int) -> DataFrame:
    """Tiles side by side. A step of one tile pads to the next multiple, half on each side."""
    return cut_overlapping(images, tile, tile)


def _crop(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
    y0, x0 = row["y0"] - row["pad_top"], row["x0"] - row["pad_left"]
    top, left = max(0, -y0), max(0, -x0)
    bottom = min(row["height"], row["image_height"] - y0)
    right = min(row["width"], row["image_width"] - x0)
    if top >= bottom or left >= right:
        return
    yield {
        "image_id": row["image_id"],
        "tile_y": row["tile_y"],
        "tile_x": row["tile_x"],
        "y0": y0 + top,
        "x0": x0 + left,
        **packed(pixels(row)[top:bottom, left:right]),
    }


def crop_tiles(tiles: DataFrame) -> DataFrame:
    """Drop the padding: blocks of non-overlapping tiles in image coordinates."""
    return tiles.select(*TILE_SCHEMA.names).mapInArrow(flat_map(_crop, BLOCK_SCHEMA), BLOCK_SCHEMA)


def tile_spans(size: int, tile: int) -> list[tuple[int, int]]:
    """Ranges of one axis that side-by-side tiles cover once their padding is dropped."""
    count, before = axis_grid(size, tile, tile)
    return [(max(0, i * tile - before), min(size, (i + 1) * tile - before)) for i in range(count)]


SIZED_SCHEMA = T.StructType([*BLOCK_SCHEMA.fields, *(T.StructField(c, T.IntegerType()) for c in ("image_height", "image_width"))])


def cut_blocks(images: DataFrame, tile: int, *, sized: bool = False) -> DataFrame:
    """``crop_tiles(cut_tiles(...))`` in one step, for rows that need no padding in between.

    ``sized`` adds ``image_height`` and ``image_width``.
    """
    schema = SIZED_SCHEMA if sized else BLOCK_SCHEMA

    def cut(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        image = pixels(row)
        across = tile_spans(image.shape[1], tile)
        for i, (top, bottom) in enumerate(tile_spans(image.shape[0], tile)):
            for j, (left, right) in enumerate(across):
                yield {
                    "image_id": row["image_id"],
                    "tile_y": i,
                    "tile_x": j,
                    "y0": top,
                    "x0": left,
                    "image_height": image.shape[0],
                    "image_width": image.shape[1],
                    **packed(image[top:bottom, left:right]),
                }

    return images.select(*IMAGE_SCHEMA.names).mapInArrow(flat_map(cut, schema), schema)


def coverage(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """``image_id, area, covered`` per image, 0 where it has no block. ``sizes``: image_id, height, width."""
    covered = blocks.groupBy("image_id").agg(
        F.sum(F.col("height").cast("bigint") * F.col("width")).alias("covered")
    )
    area = (F.col("height").cast("bigint") * F.col("width")).alias("area")
    return sizes.select("image_id", area).join(covered, "image_id", "left").fillna(0, ["covered"])


def incomplete_images(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Images whose blocks do not add up to their area."""
    return coverage(blocks, sizes).filter(~F.col("area").eqNullSafe(F.col("covered")))


def _paste(key, table):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from tilewright.functions.blocks import batched, iter_rows

    blocks = list(iter_rows(iter(table.to_batches())))
    height = max(b["y0"] + b["height"] for b in blocks)
    width = max(b["x0"] + b["width"] for b in blocks)
    whole = table.column("_whole")[0].as_py() if "_whole" in table.column_names else {"height": height, "width": width}
    area = sum(b["height"] * b["width"] for b in blocks)
    if whole is None or (whole["height"], whole["width"]) != (height, width) or area != height * width:
        raise ValueError(f"{key[0].as_py()}: blocks of {area} pixels do not make up {whole or (height, width)}")
    first = pixels(blocks[0])
    canvas = np.zeros((height, width, *first.shape[2:]), dtype=first.dtype)
    for block in blocks:
        y, x = block["y0"], block["x0"]
        canvas[y : y + block["height"], x : x + block["width"]] = pixels(block)
    row = {"image_id": key[0].as_py(), **packed(canvas)}
    schema = to_arrow_schema(IMAGE_SCHEMA)
    return pa.Table.from_batches(batched(iter([row]), schema), schema=schema)


def assemble_images(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Whole pictures again, for export to image files only; a gap is an error.

    ``sizes`` (image_id, height, width) says how large a picture is; without it, a picture ends
    with its last blocks. A group is the blocks of one picture, so it is as large as the file that
    will be written.
    """
    if sizes is not None:
        blocks = blocks.join(sizes.select("image_id", F.struct("height", "width").alias("_whole")), "image_id", "left")
    return blocks.groupBy("image_id").applyInArrow(_paste, IMAGE_SCHEMA)
