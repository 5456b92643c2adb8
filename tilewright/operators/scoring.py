"""Running a user's predictor over tile rows.

The predictor is any picklable function on numpy batches. It is shipped once per task; rows flow
through in Arrow batches and are handed over in mini-batches of equal shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from tilewright.functions.blocks import (
    BLOCK_SCHEMA,
    CODE_COUNTS,
    IMAGE_SCHEMA,
    TILE_SCHEMA,
    batched,
    count_codes,
    flat_map,
    iter_rows,
    packed,
    pixels,
)
from tilewright.operators.confusion import split_codes
from tilewright.operators.stitching import PIECE_SCHEMA, merge_pieces, tile_pieces
from tilewright.operators.tiles import (
    axis_grid,
    axis_reflection,
    crop_tiles,
    cut_regions,
    cut_tiles,
)

Predictor = Callable[[np.ndarray], np.ndarray]


def as_bytes(labels: np.ndarray) -> np.ndarray:
    """Labels as uint8; one that does not fit is an error instead of another class."""
    if labels.dtype != np.uint8 and labels.size and (labels.min() < 0 or labels.max() > 255):
        raise ValueError(f"labels from {labels.min()} to {labels.max()} do not fit into a byte")
    return labels.astype(np.uint8)


def _scored(predict: Predictor, batch_size: int, as_labels: bool):
    arrow_schema = to_arrow_schema(TILE_SCHEMA)

    def flush(waiting: list[dict[str, Any]]) -> Iterator[dict[str, Any]]:
        result = _predicted(predict, [pixels(r) for r in waiting], 3 if as_labels else 4)
        for row, scored in zip(waiting, result, strict=True):
            yield {**row, **packed(as_bytes(scored) if as_labels else scored)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict[str, Any]]:
            waiting: list[dict[str, Any]] = []
            kind = None
            for row in iter_rows(batches):
                this = (row["height"], row["width"], row["channels"], row["dtype"])
                if waiting and (this != kind or len(waiting) >= batch_size):
                    yield from flush(waiting)
                    waiting = []
                kind = this
                waiting.append(row)
            if waiting:
                yield from flush(waiting)

        return batched(rows(), arrow_schema)

    return run


def score_tiles(
    tiles: DataFrame, predict: Predictor, *, batch_size: int = 4, as_labels: bool
) -> DataFrame:
    """Replace tile pixels with labels (uint8) or logits (float32, one channel per class)."""
    return tiles.select(*TILE_SCHEMA.names).mapInArrow(
        _scored(predict, batch_size, as_labels), TILE_SCHEMA
    )


def _label_blocks(
    image: np.ndarray, predict: Predictor, tile: int, batch_size: int
) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """``tile_y, tile_x, y0, x0, labels`` of side-by-side tiles, a line of tiles at a time."""
    height, width = image.shape[:2]
    rows, top = axis_grid(height, tile, tile)
    cols, left = axis_grid(width, tile, tile)
    source_y = axis_reflection(height, top, rows * tile)
    source_x = axis_reflection(width, left, cols * tile)
    for i in range(rows):
        strip = image[source_y[i * tile : (i + 1) * tile]][:, source_x]
        pieces = [strip[:, j * tile : (j + 1) * tile] for j in range(cols)]
        y0, y1 = max(0, i * tile - top), min(height, (i + 1) * tile - top)
        for at in range(0, cols, batch_size):
            labels = as_bytes(_predicted(predict, pieces[at : at + batch_size], 3))
            for j, tile_labels in enumerate(labels, start=at):
                x0, x1 = max(0, j * tile - left), min(width, (j + 1) * tile - left)
                shift_y, shift_x = top - i * tile, left - j * tile
                part = tile_labels[y0 + shift_y : y1 + shift_y, x0 + shift_x : x1 + shift_x]
                yield i, j, y0, x0, part


def predict_labels(
    images: DataFrame, predict: Predictor, *, tile: int, batch_size: int = 4, by_tile: bool = False
) -> DataFrame:
    """Label blocks from side-by-side tiles (the evaluation path).

    An image row is cut, scored and cropped where it was read. ``by_tile`` deals the tiles of
    every image out to all tasks first.
    """
    if by_tile:
        dealt = cut_tiles(images, tile).repartition("image_id", "tile_y", "tile_x")
        return crop_tiles(score_tiles(dealt, predict, batch_size=batch_size, as_labels=True))

    def label(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        for i, j, y0, x0, part in _label_blocks(pixels(row), predict, tile, batch_size):
            yield {
                "image_id": row["image_id"],
                "tile_y": i,
                "tile_x": j,
                "y0": y0,
                "x0": x0,
                **packed(part),
            }

    return images.select(*IMAGE_SCHEMA.names).mapInArrow(
        flat_map(label, BLOCK_SCHEMA), BLOCK_SCHEMA
    )


def count_pairs(pairs: DataFrame, predict: Predictor, *, tile: int, batch_size: int = 4) -> DataFrame:
    """``image_id, gt, pred, n`` for image rows with a ``mask`` column, counted in place."""

    def codes(row: dict[str, Any]) -> np.ndarray:
        image = pixels(row)
        mask = np.frombuffer(row["mask"], dtype=np.uint8).reshape(image.shape[:2])
        found = np.empty(mask.shape, dtype=np.uint8)
        for _, _, y0, x0, part in _label_blocks(image, predict, tile, batch_size):
            found[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]] = part
        return (mask.astype(np.int64) * 256 + found).ravel()

    counted = pairs.select(*IMAGE_SCHEMA.names, "mask").mapInArrow(count_codes(codes), CODE_COUNTS)
    return split_codes(counted)


def _band_lines(
    strips: Iterable[np.ndarray], predict: Predictor, tile: int, stride: int, batch_size: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Score strips of canvas from top to bottom, each as high as a tile and a stride below the
    one before: ``line, logits of its tiles, sums, counts``.

    Only the band of canvas that the current line of tiles touches is held, so the memory is
    tile x width x classes, whatever the height. Its first ``stride`` lines are complete.
    """
    band = count = None
    for i, strip in enumerate(strips):
        cols = (strip.shape[1] - tile) // stride + 1
        pieces = [strip[:, j * stride : j * stride + tile] for j in range(cols)]
        logits = np.concatenate(
            [_predicted(predict, pieces[at : at + batch_size], 4) for at in range(0, cols, batch_size)]
        )
        if band is None:
            band = np.zeros((tile, strip.shape[1], logits.shape[-1]), dtype=np.float32)
            count = np.zeros((tile, strip.shape[1], 1), dtype=np.float32)
        for j in range(cols):
            band[:, j * stride : j * stride + tile] += logits[j]
            count[:, j * stride : j * stride + tile] += 1
        yield i, logits, band, count
        band[: tile - stride], count[: tile - stride] = band[stride:].copy(), count[stride:].copy()
        band[tile - stride :], count[tile - stride :] = 0, 0


def _band_stitcher(predict: Predictor, tile: int, stride: int, batch_size: int):
    """Cut, score and average one image row from top to bottom, a band at a time."""

    def stitch(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        image = pixels(row)
        if not image.size:
            return
        height, width = image.shape[:2]
        rows, top = axis_grid(height, tile, stride)
        cols, left = axis_grid(width, tile, stride)
        source_y = axis_reflection(height, top, (rows - 1) * stride + tile)
        source_x = axis_reflection(width, left, (cols - 1) * stride + tile)
        strips = (image[source_y[i * stride : i * stride + tile]][:, source_x] for i in range(rows))
        for i, _, band, count in _band_lines(strips, predict, tile, stride, batch_size):
            ready = stride if i + 1 < rows else tile
            first, last = max(i * stride, top), min(i * stride + ready, top + height)
            if first < last:
                lines = slice(first - i * stride, last - i * stride)
                part = (band[lines] / count[lines])[:, left : left + width]
                yield {
                    "image_id": row["image_id"],
                    "tile_y": i,
                    "tile_x": 0,
                    "y0": first - top,
                    "x0": 0,
                    **packed(as_bytes(np.argmax(part, axis=-1))),
                }

    return stitch


def _region_stitcher(predict: Predictor, batch_size: int):
    """Score one region and decide what only its own tiles cover; the rest stays logits."""

    def own(first: int, n: int, count: int, tile: int, stride: int, low: int, size: int):
        """The range of one axis, on the canvas and inside the picture, that no other tile covers."""
        start = (first - 1) * stride + tile if first else 0
        stop = (first + n) * stride if first + n < count else (count - 1) * stride + tile
        return max(start, low), min(stop, low + size)

    def stitch(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        canvas = pixels(row)
        tile, stride, y0, x0 = row["tile"], row["stride"], row["y0"], row["x0"]
        lines, across = ((side - tile) // stride + 1 for side in canvas.shape[:2])
        top, bottom = own(row["tile_y"], lines, row["rows"], tile, stride, row["pad_top"], row["image_height"])
        left, right = own(row["tile_x"], across, row["cols"], tile, stride, row["pad_left"], row["image_width"])
        found = np.empty((max(0, bottom - top), max(0, right - left)), dtype=np.uint8)
        strips = (canvas[i * stride : i * stride + tile] for i in range(lines))
        for i, logits, band, count in _band_lines(strips, predict, tile, stride, batch_size):
            begin = y0 + i * stride
            ready = stride if i + 1 < lines else tile
            first, last = max(begin, top), min(begin + ready, bottom)
            if first < last and found.size:
                at = np.s_[first - begin : last - begin, left - x0 : right - x0]
                found[first - top : last - top] = as_bytes(np.argmax(band[at] / count[at], axis=-1))
            for j, scored in enumerate(logits):
                placed = {
                    **row,
                    "tile_y": row["tile_y"] + i,
                    "tile_x": row["tile_x"] + j,
                    "y0": begin,
                    "x0": x0 + j * stride,
                }
                yield from tile_pieces(placed, scored, (top, bottom, left, right))
        if found.size:
            yield {
                "image_id": row["image_id"],
                "tile_y": row["tile_y"],
                "tile_x": row["tile_x"],
                "y0": top - row["pad_top"],
                "x0": left - row["pad_left"],
                "cover": 1,
                **packed(found),
            }

    return stitch


def _predicted(predict: Predictor, pieces: list[np.ndarray], dims: int) -> np.ndarray:
    """One mini-batch through the predictor: labels (3 dimensions) or float logits (4)."""
    stack = np.stack(pieces)
    if stack.ndim == 3:
        stack = stack[..., np.newaxis]
    result = np.asarray(predict(stack))
    if result.shape[:3] != stack.shape[:3] or result.ndim != dims:
        raise ValueError(f"predictor returned shape {result.shape} for a batch of {stack.shape}")
    return result.astype(np.float32) if dims == 4 else result


def predict_stitched(
    images: DataFrame,
    predict: Predictor,
    *,
    tile: int,
    overlap: float,
    batch_size: int = 4,
    by_tile: bool = False,
) -> DataFrame:
    """Label blocks from overlapping tiles with averaged logits (the inference path).

    An image row is scored and averaged where it was read, without a shuffle. ``by_tile`` instead
    deals the tiles of every image out to all tasks, in regions of neighbours, for a few huge images
    on many cores. A region averages its own tiles; only the logits on its rim, which tiles of other
    regions cover too, are shuffled and averaged afterwards.
    """
    stride = max(1, round(tile * (1 - overlap)))
    if by_tile:
        regions = cut_regions(images, tile, stride).repartition("image_id", "tile_y", "tile_x")
        return merge_pieces(
            regions.mapInArrow(flat_map(_region_stitcher(predict, batch_size), PIECE_SCHEMA), PIECE_SCHEMA)
        )
    return images.select(*IMAGE_SCHEMA.names).mapInArrow(
        flat_map(_band_stitcher(predict, tile, stride, batch_size), BLOCK_SCHEMA), BLOCK_SCHEMA
    )
