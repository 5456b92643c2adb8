"""Exact confusion matrices and the scores read off them.

Pixels are counted once, per image. Everything else (coarser grains, object class, scores,
means over images) is computed from those few rows per image.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.blocks import CODE_COUNTS, count_codes

# Class names in class order, and the epsilon of the scores.
CLASS_NAMES = ("background", "loose cell", "aggregate")
EPSILON = 1e-6

OUT_OF_RANGE = "n_out_of_range"


def cell(gt: int, pred: int) -> str:
    return f"c_{gt}_{pred}"


def cells(num_classes: int) -> list[str]:
    return [cell(g, p) for g in range(num_classes) for p in range(num_classes)]


def count_pixels(
    pixels: DataFrame, by: Sequence[str], num_classes: int, n: str | None = None
) -> DataFrame:
    """Wide confusion matrix per group: ``c_<gt>_<pred>`` columns, zero where nothing fell.

    ``pixels`` has ``gt, pred``; with ``n`` that column holds counts instead of single pixels.
    Labels outside the classes are counted apart instead of landing in a wrong cell. One
    shuffle: the matrix of a group is one row of partial sums per task.
    """
    weight = n or "1L"
    sums = [
        F.expr(f"sum(if(gt = {g} and pred = {p}, {weight}, 0L))").alias(cell(g, p))
        for g in range(num_classes)
        for p in range(num_classes)
    ]
    top = num_classes - 1
    strange = F.expr(
        f"sum(if(gt between 0 and {top} and pred between 0 and {top}, 0L, {weight}))"
    ).alias(OUT_OF_RANGE)
    return pixels.groupBy(*by).agg(*sums, strange)


def _pair_codes(row: dict[str, Any]) -> np.ndarray:
    """Truth and prediction of a pixel as one number: 256 * truth + prediction."""
    gt = np.frombuffer(row["gt"], dtype=np.uint8)
    pred = np.frombuffer(row["pred"], dtype=np.uint8)
    if gt.size != pred.size:
        raise ValueError(f"{row['image_id']}: {gt.size} truth pixels, {pred.size} predicted")
    return gt.astype(np.int64) * 256 + pred


def align_blocks(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Put truth and prediction blocks of the same rectangle side by side.

    A block without a partner is an error: picture and mask differ in size, or one is missing.
    """
    keys = ["image_id", "tile_y", "tile_x"]
    both = truth.select(*keys, F.col("data").alias("gt")).join(
        predicted.select(*keys, F.col("data").alias("pred")), keys, "full_outer"
    )

    def present(side: str, name: str):
        message = F.concat(F.lit(f"no {name} block for "), F.concat_ws(" ", *keys))
        return F.when(F.col(side).isNull(), F.raise_error(message).cast("binary")).otherwise(F.col(side))

    return both.select(*keys, present("gt", "truth").alias("gt"), present("pred", "predicted").alias("pred"))


def reject_out_of_range(wide: DataFrame) -> DataFrame:
    """The same matrices; an image with labels outside the classes is an error."""
    message = F.concat(F.lit("labels outside the classes in "), F.col("image_id"), F.lit(": "), F.col(OUT_OF_RANGE), F.lit(" pixels"))
    return wide.withColumn(
        OUT_OF_RANGE, F.when(F.col(OUT_OF_RANGE) > 0, F.raise_error(message).cast("bigint")).otherwise(F.col(OUT_OF_RANGE))
    )


def split_codes(counted: DataFrame) -> DataFrame:
    """``image_id, gt, pred, n`` from codes 256 * truth + prediction."""
    return counted.select(
        "image_id",
        F.expr("cast(code div 256 as int)").alias("gt"),
        F.expr("cast(code % 256 as int)").alias("pred"),
        "n",
    )


def count_blocks(aligned: DataFrame) -> DataFrame:
    """``image_id, gt, pred, n`` from byte blocks, not yet added up over tasks."""
    return split_codes(
        aligned.select("image_id", "gt", "pred").mapInArrow(count_codes(_pair_codes), CODE_COUNTS)
    )


def long_matrix(wide: DataFrame, by: Sequence[str], num_classes: int) -> DataFrame:
    """Full K x K grid per group as rows ``gt, pred, n``."""
    entries = ", ".join(
        f"struct({g} as gt, {p} as pred, {cell(g, p)} as n)"
        for g in range(num_classes)
        for p in range(num_classes)
    )
    return wide.select(*by, F.expr(f"inline(array({entries}))"))


def _total(names: Sequence[str]) -> str:
    return "(" + (" + ".join(names) or "0L") + ")"


def object_cell(g: int, p: int, num_classes: int) -> str:
    """SQL for one cell of background (class 0) against object (any other class)."""
    return _total(
        [
            cell(a, b)
            for a in range(num_classes)
            for b in range(num_classes)
            if (a > 0) == bool(g) and (b > 0) == bool(p)
        ]
    )


def object_matrix(wide: DataFrame, num_classes: int) -> DataFrame:
    """Add ``o_<g>_<p>``: the matrix collapsed to background against object."""
    return wide.select(
        "*",
        *[
            F.expr(object_cell(g, p, num_classes)).alias(f"o_{g}_{p}")
            for g in (0, 1)
            for p in (0, 1)
        ],
    )


def dice_sql(eps: float = EPSILON) -> str:
    """Dice from exact counts; a class that is nowhere scores 1."""
    return (
        "if(tp + fp + fn = 0, 1D, (2D * cast(tp as double) + {e}) / "
        "(2D * cast(tp as double) + fp + fn + {e}))"
    ).format(e=f"{eps!r}D")


def iou_sql(eps: float = EPSILON) -> str:
    return (
        "if(tp + fp + fn = 0, 1D, (cast(tp as double) + {e}) / (cast(tp as double) + fp + fn + {e}))"
    ).format(e=f"{eps!r}D")


def class_name(class_id: int) -> str:
    return CLASS_NAMES[class_id] if class_id < len(CLASS_NAMES) else f"class_{class_id}"


def class_scores(
    wide: DataFrame, by: Sequence[str], num_classes: int, *, with_object: bool = True, eps: float = EPSILON
) -> DataFrame:
    """Rows ``class, tp, fp, fn, dice, iou`` per group, with the object class last."""
    entries = []
    for c in range(num_classes):
        others = [o for o in range(num_classes) if o != c]
        fp, fn = _total([cell(o, c) for o in others]), _total([cell(c, o) for o in others])
        entries.append((class_name(c), cell(c, c), fp, fn))
    if with_object:
        tp, fp, fn = (object_cell(*at, num_classes) for at in ((1, 1), (0, 1), (1, 0)))
        entries.append(("object", tp, fp, fn))
    structs = ", ".join(
        f"struct('{name}' as class, {tp} as tp, {fp} as fp, {fn} as fn)" for name, tp, fp, fn in entries
    )
    rows = wide.select(*by, F.expr(f"inline(array({structs}))"))
    return rows.select("*", F.expr(dice_sql(eps)).alias("dice"), F.expr(iou_sql(eps)).alias("iou"))


def direct_scores(
    pixels: DataFrame, by: Sequence[str], num_classes: int, *, eps: float = EPSILON
) -> DataFrame:
    """Scores straight from labels: intersection, predicted area and true area per class."""
    aggs = []
    for c in range(num_classes):
        for label, hit in (("both", f"gt = {c} and pred = {c}"), ("pred", f"pred = {c}"), ("gt", f"gt = {c}")):
            aggs.append(F.expr(f"count_if({hit})").alias(f"{label}_{c}"))
    structs = ", ".join(
        f"struct('{class_name(c)}' as class, both_{c} as intersection, pred_{c} as pred_area, gt_{c} as gt_area)"
        for c in range(num_classes)
    )
    rows = pixels.groupBy(*by).agg(*aggs).select(*by, F.expr(f"inline(array({structs}))"))
    e = f"{eps!r}D"
    return rows.select(
        "*",
        F.expr(
            f"if(pred_area + gt_area = 0, 1D, (2D * cast(intersection as double) + {e}) / "
            f"(pred_area + gt_area + {e}))"
        ).alias("dice"),
        F.expr(
            f"if(pred_area + gt_area = 0, 1D, (cast(intersection as double) + {e}) / "
            f"(pred_area + gt_area - intersection + {e}))"
        ).alias("iou"),
    )


def grains(per_image: DataFrame, num_classes: int) -> DataFrame:
    """Matrices at three grains from one row per image: overall, magnification, image.

    ``per_image`` has ``magnification, image_id`` and the cells. Adds ``grain`` and ``n_images``.
    """
    columns = [*cells(num_classes), OUT_OF_RANGE]
    return (
        per_image.groupingSets(
            [[], ["magnification"], ["magnification", "image_id"]], "magnification", "image_id"
        )
        .agg(
            F.grouping_id().alias("_g"),
            F.count(F.lit(1)).alias("n_images"),
            *[F.sum(c).cast("bigint").alias(c) for c in columns],
        )
        .withColumn(
            "grain",
            F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "magnification").otherwise("image"),
        )
        .drop("_g")
    )


def named_grains(per_image: DataFrame, num_classes: int) -> DataFrame:
    """``grains`` with one name per row in ``group``."""
    return grains(per_image, num_classes).withColumn(
        "group",
        F.when(F.col("grain") == "overall", "overall")
        .when(F.col("grain") == "magnification", F.col("magnification"))
        .otherwise(F.col("image_id")),
    )


def report(per_image: DataFrame, num_classes: int = 3) -> DataFrame:
    """Flat report ``grain, group, class, tp, fp, fn, dice, iou, n_images, n_out_of_range``.

    Pixels counted in ``n_out_of_range`` are in no cell and so in no score.
    """
    named = named_grains(per_image, num_classes)
    return class_scores(named, ["grain", "group", "n_images", OUT_OF_RANGE], num_classes).select(
        "grain", "group", "class", "tp", "fp", "fn", "dice", "iou", "n_images", OUT_OF_RANGE
    )


def image_score_stats(per_image: DataFrame, num_classes: int = 3) -> DataFrame:
    """Mean and population deviation of the per-image scores, per magnification and class."""
    scores = class_scores(per_image, ["magnification", "image_id"], num_classes)
    return scores.groupBy("magnification", "class").agg(
        F.avg("dice").alias("mean_dice"),
        F.stddev_pop("dice").alias("std_dice"),
        F.avg("iou").alias("mean_iou"),
        F.stddev_pop("iou").alias("std_iou"),
        F.count(F.lit(1)).alias("n_images"),
    )


def row_sums(wide: DataFrame, areas: DataFrame, num_classes: int) -> DataFrame:
    """Row sums of each matrix next to the class counts of its mask, and whether they agree.

    ``areas`` has ``image_id, class_0..``. An image on one side only does not agree.
    """
    classes = range(num_classes)
    sums = [
        F.expr(_total([cell(g, p) for p in classes])).alias(f"sum_{g}") for g in classes
    ]
    same = " and ".join(f"sum_{g} <=> class_{g}" for g in classes)
    joined = wide.select("image_id", *sums).join(
        areas.select("image_id", *[f"class_{g}" for g in classes]), "image_id", "full_outer"
    )
    return joined.withColumn("complete", F.expr(same))


def row_sum_mismatches(wide: DataFrame, areas: DataFrame, num_classes: int) -> DataFrame:
    """Images whose matrix does not add up to their mask; no rows means all is counted."""
    return row_sums(wide, areas, num_classes).filter("not complete")
