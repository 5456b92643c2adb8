"""Registered queries over pixels, tiles and patches, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import geometry, pixels
from tilewright.functions.blocks import BLOCK_SCHEMA, flat_map
from tilewright.functions.blocks import pixels as unpack
from tilewright.operators import (
    annotation,
    augment,
    batches,
    confusion,
    intensity,
    losses,
    overlays,
    patches,
    scoring,
    stitching,
    tiles,
)
from tilewright.plans import evaluation, training_data
from tilewright.plans import standins as s
from tilewright.sources import reports, synthetic

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


# --- evaluation over a pixel table ------------------------------------------------------------


def _per_image(spark, sf_dir):
    """One matrix per image of the lineitem pixels: the only pass over the pixel table."""
    return s.name_images(confusion.count_pixels(s.lineitem_pixels(spark, sf_dir), ["image_key"], 3))


SQL_SCORES = """
(CASE WHEN tp + fp + fn = 0 THEN 1e0 ELSE (2e0 * tp + 1e-6) / (2e0 * tp + fp + fn + 1e-6) END) AS dice,
(CASE WHEN tp + fp + fn = 0 THEN 1e0 ELSE (CAST(tp AS DOUBLE) + 1e-6) / (CAST(tp AS DOUBLE) + fp + fn + 1e-6) END) AS iou"""

SQL_CLASSES = """
k AS (SELECT unnest(['background', 'loose cell', 'aggregate', 'object']) AS class,
             unnest([[0], [1], [2], [1, 2]]) AS ids)"""


def _sql_counts(source: str, by: str) -> str:
    """tp, fp, fn per class of ``source`` rows (gt, pred), grouped by ``by``."""
    return f"""SELECT {by}, class,
       count(*) FILTER (list_contains(ids, gt) AND list_contains(ids, pred)) AS tp,
       count(*) FILTER (NOT list_contains(ids, gt) AND list_contains(ids, pred) AND gt BETWEEN 0 AND 2) AS fp,
       count(*) FILTER (list_contains(ids, gt) AND NOT list_contains(ids, pred) AND pred BETWEEN 0 AND 2) AS fn,
       count(*) FILTER (NOT (gt BETWEEN 0 AND 2 AND pred BETWEEN 0 AND 2)) AS oor
       FROM {source}, k GROUP BY {by}, class"""


def _sql_report(source: str, extra: str = "") -> str:
    return f"""WITH {s.SQL_LINEITEM_PIXELS}, {extra}{SQL_CLASSES},
i AS ({_sql_counts(source, 'magnification, image_id')}),
g AS (SELECT CASE WHEN GROUPING(magnification) = 1 THEN 'overall' WHEN GROUPING(image_id) = 1 THEN 'magnification' ELSE 'image' END AS grain,
             CASE WHEN GROUPING(magnification) = 1 THEN 'overall' WHEN GROUPING(image_id) = 1 THEN magnification ELSE image_id END AS "group",
             class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
             CAST(sum(oor) AS BIGINT) AS n_out_of_range, count(*) AS n_images
      FROM i GROUP BY GROUPING SETS ((class), (class, magnification), (class, magnification, image_id)))"""


SQL_REPORT = _sql_report("px")


@query(f"{SQL_REPORT} SELECT grain, \"group\", class, tp, fp, fn, {SQL_SCORES}, n_images, n_out_of_range FROM g")
def seg_report(spark, sf_dir):
    """The report at three grains (flagship)."""
    return confusion.report(_per_image(spark, sf_dir))


@query(
    f"{_sql_report('strange', 'strange AS (SELECT magnification, image_id, gt + 1 AS gt, pred FROM px), ')} "
    f"SELECT grain, \"group\", class, tp, fp, fn, {SQL_SCORES}, n_images, n_out_of_range FROM g"
)
def strange_labels(spark, sf_dir):
    """Masks that hold class 3: those pixels are in no score and are reported."""
    pixels_ = s.lineitem_pixels(spark, sf_dir).withColumn("gt", F.col("gt") + 1)
    return confusion.report(s.name_images(confusion.count_pixels(pixels_, ["image_key"], 3)))


@query(f"{SQL_REPORT} SELECT \"group\", class, {SQL_SCORES}, n_images, n_out_of_range FROM g WHERE grain <> 'image'")
def metrics_table(spark, sf_dir):
    """The flat table of the metrics file."""
    return reports.metrics_table(confusion.report(_per_image(spark, sf_dir)))


@query(
    f"""WITH {s.SQL_LINEITEM_PIXELS}, grid AS (SELECT unnest([0,0,0,1,1,1,2,2,2]) AS gt, unnest([0,1,2,0,1,2,0,1,2]) AS pred),
im AS (SELECT image_id, gt, pred FROM (SELECT DISTINCT image_id FROM px), grid),
n AS (SELECT image_id, gt, pred, count(*) AS n FROM px GROUP BY 1, 2, 3)
SELECT image_id, gt, pred, coalesce(n, 0) AS n FROM im LEFT JOIN n USING (image_id, gt, pred)"""
)
def confusion_matrix(spark, sf_dir):
    """Exact 3 x 3 matrix per image, zero cells included."""
    return confusion.long_matrix(_per_image(spark, sf_dir), ["image_id"], 3)


@query(
    f"""WITH {s.SQL_LINEITEM_PIXELS} SELECT image_id,
count(*) FILTER (gt = 0 AND pred = 0) AS o_0_0, count(*) FILTER (gt = 0 AND pred > 0) AS o_0_1,
count(*) FILTER (gt > 0 AND pred = 0) AS o_1_0, count(*) FILTER (gt > 0 AND pred > 0) AS o_1_1
FROM px GROUP BY 1"""
)
def confusion_object(spark, sf_dir):
    """A10: background against object."""
    wide = confusion.object_matrix(_per_image(spark, sf_dir), 3)
    return wide.select("image_id", "o_0_0", "o_0_1", "o_1_0", "o_1_1")


@query(
    f"""WITH {s.SQL_LINEITEM_PIXELS}
SELECT gt, CASE gt WHEN 0 THEN 'background' WHEN 1 THEN 'loose cell' ELSE 'aggregate' END AS truth,
count(*) FILTER (pred = 0) AS background, count(*) FILTER (pred = 1) AS "loose cell",
count(*) FILTER (pred = 2) AS aggregate FROM px GROUP BY gt"""
)
def confusion_table(spark, sf_dir):
    """The matrix with a row per true class."""
    return reports.matrix_table(_per_image(spark, sf_dir), 3)


@query(
    f"""WITH {s.SQL_LINEITEM_PIXELS}, {SQL_CLASSES},
i AS ({_sql_counts('px', 'magnification, image_id')}), sc AS (SELECT *, {SQL_SCORES} FROM i)
SELECT magnification, class, {s.sql_rounded('avg(dice)')} AS mean_dice, {s.sql_rounded('stddev_pop(dice)')} AS std_dice,
{s.sql_rounded('avg(iou)')} AS mean_iou, {s.sql_rounded('stddev_pop(iou)')} AS std_iou, count(*) AS n_images
FROM sc GROUP BY 1, 2"""
)
def image_score_stats(spark, sf_dir):
    """Mean and deviation over images."""
    stats = confusion.image_score_stats(_per_image(spark, sf_dir))
    names = ("mean_dice", "std_dice", "mean_iou", "std_iou")
    return stats.select(
        "magnification", "class", *[s.rounded(F.col(n)).alias(n) for n in names], "n_images"
    )


@query(
    f"""WITH {s.SQL_LINEITEM_PIXELS}, c AS (SELECT unnest([0, 1, 2]) AS id, unnest(['background', 'loose cell', 'aggregate']) AS class),
a AS (SELECT magnification, class, count(*) FILTER (gt = id AND pred = id) AS intersection,
             count(*) FILTER (pred = id) AS pred_area, count(*) FILTER (gt = id) AS gt_area FROM px, c GROUP BY 1, 2)
SELECT *, (2e0 * intersection + 1e-6) / (pred_area + gt_area + 1e-6) AS dice,
       (CAST(intersection AS DOUBLE) + 1e-6) / (pred_area + gt_area - intersection + 1e-6) AS iou FROM a"""
)
def direct_scores(spark, sf_dir):
    """Scores straight from labels."""
    named = s.lineitem_pixels(spark, sf_dir).withColumn(
        "magnification",
        F.when(F.col("image_key") % 3 == 0, "4x").when(F.col("image_key") % 3 == 1, "10x").otherwise("unknown"),
    )
    return confusion.direct_scores(named, ["magnification"], 3)


@query(
    f"""WITH b AS (SELECT quality AS gt, 1 - toxic AS pred FROM labels),
k AS (SELECT unnest([0, 1]) AS id, unnest(['background', 'loose cell']) AS class),
c AS (SELECT class, count(*) FILTER (gt = id AND pred = id) AS tp, count(*) FILTER (gt <> id AND pred = id) AS fp,
             count(*) FILTER (gt = id AND pred <> id) AS fn FROM b, k GROUP BY 1)
SELECT *, {SQL_SCORES} FROM c"""
)
def binary_scores(spark, sf_dir):
    """A8 with two classes: quality against 1 - toxic."""
    rows = s.table(spark, sf_dir, "labels").select(
        F.col("quality").alias("gt"), (1 - F.col("toxic")).alias("pred")
    )
    wide = confusion.count_pixels(rows, [], 2)
    return confusion.class_scores(wide, [], 2, with_object=False)


@query(
    f"""WITH {s.SQL_LINEITEM_PIXELS}, a AS (SELECT image_id, count(*) FILTER (gt = 0) AS n0, count(*) FILTER (gt = 1) AS n1,
count(*) FILTER (gt = 2) AS n2 FROM px GROUP BY 1)
SELECT image_id, n0 AS sum_0, n1 AS sum_1, n2 AS sum_2, n0 AS class_0, n1 AS class_1, n2 AS class_2, TRUE AS complete FROM a"""
)
def row_sum_check(spark, sf_dir):
    """Matrix row sums next to the mask's own class counts."""
    area = s.lineitem_pixels(spark, sf_dir).groupBy("image_key", F.col("gt").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    areas = s.name_images(annotation.class_counts(area, "image_key", (0, 1, 2)))
    return confusion.row_sums(_per_image(spark, sf_dir), areas, 3)


@query(
    f"""WITH {s.SQL_LINEITEM_PIXELS} SELECT image_id, CASE WHEN gt = 0 AND pred = 0 THEN 'TN' WHEN gt = pred THEN 'TP'
WHEN pred > gt THEN 'FP' ELSE 'FN' END AS category, count(*) AS n FROM px GROUP BY 1, 2"""
)
def error_categories(spark, sf_dir):
    """Error pixels per image."""
    counts = overlays.error_counts(s.lineitem_pixels(spark, sf_dir), ["image_key"])
    return s.name_images(counts).select("image_id", "category", "n")


@query(
    """WITH p AS (SELECT l_suppkey AS image_key, l_linenumber % 4 AS raw FROM lineitem)
SELECT image_key, raw, CASE raw WHEN 3 THEN 2 ELSE raw END AS label, count(*) AS n FROM p GROUP BY 1, 2, 3"""
)
def class_remap(spark, sf_dir):
    """Merge class 3 into 2, keep the rest."""
    raw = s.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_key"), (F.col("l_linenumber") % 4).alias("raw")
    )
    counted = raw.groupBy("image_key", "raw").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("label", pixels.remap_class(F.col("raw"), {3: 2}))


# --- documents as pictures: blocks, tiles, stitching ------------------------------------------

TILE = 24
STITCH_TILE, STITCH_OVERLAP = 16, 0.25
STITCH_STRIDE = 12


def _doc_truth(spark, sf_dir):
    """Masks of the document pictures: value modulo 4, class 3 merged into 2."""
    return intensity.remap_masks(
        s.document_images(spark, sf_dir), {v: min(v % 4, 2) for v in range(256)}
    )


def positional_labels(batch: np.ndarray) -> np.ndarray:
    """A predictor that depends on the place in the tile, so misplaced tiles show."""
    gray = batch[..., 0].astype(np.int64)
    rows = np.arange(gray.shape[1])[np.newaxis, :, np.newaxis]
    cols = np.arange(gray.shape[2])[np.newaxis, np.newaxis, :]
    return (gray + rows + 2 * cols) % 3


def positional_logits(batch: np.ndarray) -> np.ndarray:
    """Whole-number logits of three classes that differ between overlapping tiles."""
    gray = batch[..., 0].astype(np.int64)[..., np.newaxis]
    rows = np.arange(gray.shape[1])[np.newaxis, :, np.newaxis, np.newaxis]
    cols = np.arange(gray.shape[2])[np.newaxis, np.newaxis, :, np.newaxis]
    classes = np.arange(3)[np.newaxis, np.newaxis, np.newaxis, :]
    return ((7 * gray + 3 * rows + 5 * cols * classes + classes) % 11).astype(np.float32)


BLOCK_SUMS = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("tile_y", T.IntegerType()),
        T.StructField("tile_x", T.IntegerType()),
        T.StructField("y0", T.IntegerType()),
        T.StructField("x0", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("weighted", T.LongType()),
    ]
)


def _sum_block(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
    block = unpack(row).astype(np.int64)
    y = np.arange(row["y0"], row["y0"] + block.shape[0], dtype=np.int64)[:, np.newaxis]
    x = np.arange(row["x0"], row["x0"] + block.shape[1], dtype=np.int64)[np.newaxis, :]
    yield {
        **{k: row[k] for k in ("image_id", "tile_y", "tile_x", "y0", "x0")},
        "n": block.size,
        "total": int(block.sum()),
        "weighted": int((block * (31 * y + 17 * x + 1)).sum()),
    }


def block_sums(blocks):
    """Pixel count, sum and place-weighted sum per block."""
    return blocks.select(*BLOCK_SCHEMA.names).mapInArrow(flat_map(_sum_block, BLOCK_SUMS), BLOCK_SUMS)


SQL_DOC_GRID = f"""
pad AS (SELECT image_id, h, CAST((-h % {TILE} + {TILE}) % {TILE} AS INT) AS ph, {-64 % TILE} AS pw FROM doc_bytes),
grid AS (SELECT image_id, ph // 2 AS top, pw // 2 AS lft FROM pad)"""


@query(
    f"""WITH {s.SQL_DOC_PIXELS}, {SQL_DOC_GRID},
p AS (SELECT image_id, least(v % 4, 2) AS gt, (v + (y + top) % {TILE} + 2 * ((x + lft) % {TILE})) % 3 AS pred
      FROM doc_px JOIN grid USING (image_id))
SELECT image_id, gt, pred, count(*) AS n FROM p GROUP BY 1, 2, 3"""
)
def block_confusion(spark, sf_dir):
    """Tiles dealt out, scored, cropped, joined with mask blocks, counted."""
    images = s.document_images(spark, sf_dir)
    predicted = scoring.predict_labels(
        images, positional_labels, tile=TILE, batch_size=64, by_tile=True
    )
    truth = tiles.cut_blocks(_doc_truth(spark, sf_dir), TILE)
    counted = confusion.count_blocks(confusion.align_blocks(truth, predicted))
    return counted.groupBy("image_id", "gt", "pred").agg(F.sum("n").cast("bigint").alias("n"))


SQL_EVALUATE = f"""WITH {s.SQL_DOC_PIXELS}, {SQL_DOC_GRID}, {SQL_CLASSES},
p AS (SELECT image_id, {s.sql_magnification('image_id')} AS magnification, least(v % 4, 2) AS gt,
             (v + (y + top) % {TILE} + 2 * ((x + lft) % {TILE})) % 3 AS pred FROM doc_px JOIN grid USING (image_id)),
q AS (SELECT image_id, magnification, gt, pred, count(*) AS n FROM p GROUP BY ALL),
i AS (SELECT magnification, image_id, class,
       coalesce(sum(n) FILTER (list_contains(ids, gt) AND list_contains(ids, pred)), 0) AS tp,
       coalesce(sum(n) FILTER (NOT list_contains(ids, gt) AND list_contains(ids, pred)), 0) AS fp,
       coalesce(sum(n) FILTER (list_contains(ids, gt) AND NOT list_contains(ids, pred)), 0) AS fn
       FROM q, k GROUP BY ALL),
g AS (SELECT CASE WHEN GROUPING(magnification) = 1 THEN 'overall' WHEN GROUPING(image_id) = 1 THEN 'magnification' ELSE 'image' END AS grain,
             CASE WHEN GROUPING(magnification) = 1 THEN 'overall' WHEN GROUPING(image_id) = 1 THEN magnification ELSE image_id END AS "group",
             class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
             count(*) AS n_images
      FROM i GROUP BY GROUPING SETS ((class), (class, magnification), (class, magnification, image_id)))
SELECT grain, "group", class, tp, fp, fn, {SQL_SCORES}, n_images, CAST(0 AS BIGINT) AS n_out_of_range FROM g"""


@query(SQL_EVALUATE)
def evaluate_tiles(spark, sf_dir):
    """score, join and report in one job."""
    per_image = evaluation.evaluate_images(
        s.document_images(spark, sf_dir), _doc_truth(spark, sf_dir), positional_labels, tile=TILE, batch_size=64
    )
    return confusion.report(per_image)


@query(SQL_EVALUATE)
def evaluate_pairs(spark, sf_dir):
    """F4 for rows that hold image and mask: scored and counted in place."""
    images, masks = s.document_images(spark, sf_dir), _doc_truth(spark, sf_dir)
    per_image = evaluation.evaluate_pairs(
        patches.pair_pixels(images, masks), positional_labels, tile=TILE, batch_size=64
    )
    return confusion.report(per_image)


@query(
    f"""WITH {s.SQL_DOC_PIXELS}, c AS (SELECT image_id, least(v % 4, 2) AS gt FROM doc_px)
SELECT image_id, count(*) FILTER (gt = 0) AS class_0, count(*) FILTER (gt = 1) AS class_1,
count(*) FILTER (gt = 2) AS class_2, count(*) FILTER (gt = 3) AS class_3, count(*) AS total_pixels FROM c GROUP BY 1"""
)
def mask_class_counts(spark, sf_dir):
    """A1, P8 on mask blocks: remapped, counted where they are."""
    return annotation.class_counts(annotation.label_counts(_doc_truth(spark, sf_dir)))


SQL_REFLECT = "CASE WHEN {n} = 1 THEN 0 ELSE CASE WHEN ({p} - {b}) % (2 * ({n} - 1)) + CASE WHEN ({p} - {b}) % (2 * ({n} - 1)) < 0 THEN 2 * ({n} - 1) ELSE 0 END < {n} THEN ({p} - {b}) % (2 * ({n} - 1)) + CASE WHEN ({p} - {b}) % (2 * ({n} - 1)) < 0 THEN 2 * ({n} - 1) ELSE 0 END ELSE 2 * ({n} - 1) - (({p} - {b}) % (2 * ({n} - 1)) + CASE WHEN ({p} - {b}) % (2 * ({n} - 1)) < 0 THEN 2 * ({n} - 1) ELSE 0 END) END END"


def _sql_tile_sums(tile: int, stride: int, overlapping: bool) -> str:
    """Sums per tile in SQL: tile grid, padded positions, mirrored source pixels."""
    if overlapping:
        rows = f"CASE WHEN h <= {tile} THEN 1 ELSE CAST(ceil((h - {tile}) / {stride}e0) AS INT) + 1 END"
        cols = f"CASE WHEN 64 <= {tile} THEN 1 ELSE CAST(ceil((64 - {tile}) / {stride}e0) AS INT) + 1 END"
    else:
        rows, cols = f"CAST(ceil(h / {tile}e0) AS INT)", f"CAST(ceil(64 / {tile}e0) AS INT)"
    return f"""WITH {s.SQL_DOC_PIXELS},
g AS (SELECT image_id, h, {rows} AS nr, {cols} AS nc FROM doc_bytes),
g2 AS (SELECT *, greatest((nr - 1) * {stride} + {tile} - h, 0) // 2 AS top,
              greatest((nc - 1) * {stride} + {tile} - 64, 0) // 2 AS lft FROM g),
ry AS (SELECT image_id, h, nc, top, lft, ty, ty * {stride} + i AS py
       FROM (SELECT *, unnest(range({tile})) AS i FROM (SELECT *, unnest(range(nr)) AS ty FROM g2))),
ry2 AS (SELECT image_id, ty, py, {SQL_REFLECT.format(n='h', p='py', b='top')} AS y FROM ry),
rx AS (SELECT DISTINCT nc, lft FROM g2),
rx2 AS (SELECT tx, tx * {stride} + j AS px, {SQL_REFLECT.format(n='64', p=f'(tx * {stride} + j)', b='lft')} AS x
        FROM (SELECT *, unnest(range({tile})) AS j FROM (SELECT *, unnest(range(nc)) AS tx FROM rx)))
SELECT image_id, CAST(ty AS INT) AS tile_y, CAST(tx AS INT) AS tile_x, CAST(ty * {stride} AS INT) AS y0,
       CAST(tx * {stride} AS INT) AS x0, count(*) AS n, CAST(sum(v) AS BIGINT) AS total,
       CAST(sum(v * (31 * py + 17 * px + 1)) AS BIGINT) AS weighted
FROM ry2 JOIN doc_px USING (image_id, y) JOIN rx2 USING (x) GROUP BY ALL"""


@query(_sql_tile_sums(TILE, TILE, False))
def reflect_tiles(spark, sf_dir):
    """Side-by-side tiles with mirrored padding."""
    return block_sums(tiles.cut_tiles(s.document_images(spark, sf_dir), TILE))


@query(_sql_tile_sums(STITCH_TILE, STITCH_STRIDE, True))
def overlapping_tiles(spark, sf_dir):
    """Overlapping tile grid."""
    return block_sums(tiles.cut_overlapping(s.document_images(spark, sf_dir), STITCH_TILE, STITCH_STRIDE))


@query(
    f"""WITH {s.SQL_DOC_PIXELS} SELECT image_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total,
CAST(sum(v * (31 * y + 17 * x + 1)) AS BIGINT) AS weighted FROM doc_px GROUP BY 1"""
)
def tile_roundtrip(spark, sf_dir):
    """Cut and cropped back; the sums are those of the untouched picture."""
    blocks = tiles.crop_tiles(tiles.cut_tiles(s.document_images(spark, sf_dir), TILE))
    return block_sums(blocks).groupBy("image_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("n", "total", "weighted")]
    )


@query(
    f"""WITH {s.SQL_DOC_PIXELS} SELECT image_id, count(*) AS area, count(*) AS covered FROM doc_px GROUP BY 1"""
)
def tile_coverage(spark, sf_dir):
    """The area of every picture with pixels and what its blocks cover."""
    images = s.document_images(spark, sf_dir).filter("height > 0")
    return tiles.coverage(tiles.crop_tiles(tiles.cut_tiles(images, TILE)), images)


SQL_STITCH = f"""WITH {s.SQL_DOC_PIXELS},
g AS (SELECT image_id, CASE WHEN h <= {STITCH_TILE} THEN 1 ELSE CAST(ceil((h - {STITCH_TILE}) / {STITCH_STRIDE}e0) AS INT) + 1 END AS nr,
             h FROM doc_bytes),
g2 AS (SELECT image_id, nr, 5 AS nc, greatest((nr - 1) * {STITCH_STRIDE} + {STITCH_TILE} - h, 0) // 2 AS top,
              (4 * {STITCH_STRIDE} + {STITCH_TILE} - 64) // 2 AS lft FROM g),
p AS (SELECT image_id, y, x, v, nr, nc, y + top AS py, x + lft AS px FROM doc_px JOIN g2 USING (image_id)),
c AS (SELECT *, unnest(range(greatest(0, CAST(ceil((py - {STITCH_TILE - 1}) / {STITCH_STRIDE}e0) AS INT)), least(nr - 1, py // {STITCH_STRIDE}) + 1)) AS ty FROM p),
c2 AS (SELECT *, unnest(range(greatest(0, CAST(ceil((px - {STITCH_TILE - 1}) / {STITCH_STRIDE}e0) AS INT)), least(nc - 1, px // {STITCH_STRIDE}) + 1)) AS tx FROM c),
l AS (SELECT image_id, y, x, count(*) AS n,
        sum((7 * v + 3 * (py - {STITCH_STRIDE} * ty) + 0) % 11) AS a0,
        sum((7 * v + 3 * (py - {STITCH_STRIDE} * ty) + 5 * (px - {STITCH_STRIDE} * tx) + 1) % 11) AS a1,
        sum((7 * v + 3 * (py - {STITCH_STRIDE} * ty) + 10 * (px - {STITCH_STRIDE} * tx) + 2) % 11) AS a2
      FROM c2 GROUP BY 1, 2, 3),
lab AS (SELECT image_id, y, x, CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS label FROM l)
SELECT image_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS total,
       CAST(sum(label * (31 * y + 17 * x + 1)) AS BIGINT) AS weighted FROM lab GROUP BY 1"""


@query(SQL_STITCH)
def stitch_in_place(spark, sf_dir):
    """Every picture scored with overlap and averaged where it was read."""
    blocks = scoring.predict_stitched(
        s.document_images(spark, sf_dir), positional_logits, tile=STITCH_TILE, overlap=STITCH_OVERLAP, batch_size=64
    )
    return block_sums(blocks).groupBy("image_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("n", "total", "weighted")]
    )


@query(SQL_STITCH)
def stitch_blocks(spark, sf_dir):
    """Tiles dealt out to all tasks, averaged in block form after a shuffle."""
    blocks = scoring.predict_stitched(
        s.document_images(spark, sf_dir), positional_logits, tile=STITCH_TILE, overlap=STITCH_OVERLAP, batch_size=64, by_tile=True
    )
    return block_sums(blocks).groupBy("image_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("n", "total", "weighted")]
    )


@query()
def stitch_argmax(spark, sf_dir):
    """The long form on embedding pictures."""
    tile, stride, count = 4, 3, 3
    base = s.vector_pixels(spark, sf_dir)
    before = 1  # three tiles of 4 at step 3 span 10, so the 8 pixels are padded by one each side
    py, px = F.col("y") + before, F.col("x") + before

    def covering(position):
        return F.sequence(
            geometry.first_covering_tile(position, tile, stride),
            geometry.last_covering_tile(position, F.lit(count), stride),
        )

    spread = base.withColumn("ty", F.explode(covering(py))).withColumn("tx", F.explode(covering(px)))
    i, j = F.col("y") + before - stride * F.col("ty"), F.col("x") + before - stride * F.col("tx")
    logits = spread.select(
        "image_id",
        "y",
        "x",
        F.posexplode(
            F.array(*[((7 * F.col("v") + 3 * i + 5 * j * c + c) % 11).cast("double") for c in range(3)])
        ).alias("class", "logit"),
    )
    return stitching.stitch_long(logits)


ORACLES["stitch_argmax"] = f"""WITH {s.SQL_VECTOR_PIXELS},
c AS (SELECT image_id, y, x, v, unnest(range(greatest(0, CAST(ceil((y + 1 - 3) / 3e0) AS INT)), least(2, (y + 1) // 3) + 1)) AS ty FROM vec_px),
c2 AS (SELECT *, unnest(range(greatest(0, CAST(ceil((x + 1 - 3) / 3e0) AS INT)), least(2, (x + 1) // 3) + 1)) AS tx FROM c),
l AS (SELECT image_id, y, x, count(*) AS cover,
  sum((7 * v + 3 * (y + 1 - 3 * ty)) % 11) AS a0,
  sum((7 * v + 3 * (y + 1 - 3 * ty) + 5 * (x + 1 - 3 * tx) + 1) % 11) AS a1,
  sum((7 * v + 3 * (y + 1 - 3 * ty) + 10 * (x + 1 - 3 * tx) + 2) % 11) AS a2 FROM c2 GROUP BY 1, 2, 3)
SELECT image_id, y, x, CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS label, cover FROM l"""


# --- intensities ------------------------------------------------------------------------------


@query(
    f"""WITH {s.SQL_DOC_PIXELS} SELECT image_id, {s.sql_rounded('quantile_cont(CAST(v AS DOUBLE), 1e-2)')} AS p_low,
{s.sql_rounded('quantile_cont(CAST(v AS DOUBLE), 99e-2)')} AS p_high FROM doc_px GROUP BY 1"""
)
def block_percentiles(spark, sf_dir):
    """Exact percentiles through a histogram per block."""
    blocks = tiles.cut_blocks(s.document_images(spark, sf_dir), TILE)
    limits = intensity.block_percentiles(blocks)
    return limits.select("image_id", s.rounded(F.col("p_low")).alias("p_low"), s.rounded(F.col("p_high")).alias("p_high"))


SQL_NORMALISED = f"""WITH {s.SQL_VECTOR_PIXELS},
q AS (SELECT image_id, {s.sql_rounded('quantile_cont(CAST(v AS DOUBLE), 1e-2)')} AS lo, {s.sql_rounded('quantile_cont(CAST(v AS DOUBLE), 99e-2)')} AS hi FROM vec_px GROUP BY 1),
n AS (SELECT image_id, y, x, v, CASE WHEN hi <= lo THEN 0e0 ELSE (greatest(least(CAST(v AS DOUBLE), hi), lo) - lo) / (hi - lo) END AS scaled
      FROM vec_px JOIN q USING (image_id))"""


def _normalised(spark, sf_dir):
    base = s.vector_pixels(spark, sf_dir)
    counts = base.groupBy("image_id", F.col("v").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # The last bit of an interpolated percentile differs between engines; six decimals do not.
    limits = intensity.percentiles(counts).select(
        "image_id", *[s.rounded(F.col(c)).alias(c) for c in ("p_low", "p_high")]
    )
    return base.join(limits, "image_id").withColumn(
        "scaled", pixels.normalise(F.col("v").cast("double"), F.col("p_low"), F.col("p_high"))
    )


@query(
    f"{SQL_NORMALISED} SELECT image_id, y, x, {s.sql_rounded('scaled')} AS scaled, "
    "CAST(floor(greatest(least(scaled * 255e0, 255e0), 0e0)) AS INT) AS gray FROM n"
)
def percentile_norm(spark, sf_dir):
    """Normalised pixels and their bytes."""
    return _normalised(spark, sf_dir).select(
        "image_id", "y", "x", s.rounded(F.col("scaled")).alias("scaled"), pixels.quantise(F.col("scaled")).alias("gray")
    )


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS},
q AS (SELECT image_id, quantile_cont(CAST(v AS DOUBLE), 1e-2) AS lo, quantile_cont(CAST(v AS DOUBLE), 99e-2) AS hi FROM vec_px GROUP BY 1),
n AS (SELECT image_id, CASE WHEN hi <= lo THEN 0e0 ELSE (greatest(least(CAST(v AS DOUBLE), hi), lo) - lo) / (hi - lo) END AS scaled
      FROM vec_px JOIN q USING (image_id)), b AS (SELECT image_id, CAST(floor(greatest(least(CAST(CAST(scaled AS FLOAT) AS DOUBLE) * 255e0, 255e0), 0e0)) AS INT) AS g FROM n)
SELECT image_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS total FROM b GROUP BY 1"""
)
def normalised_images(spark, sf_dir):
    """P11, P12, P15 on image rows: normalise, gray, to bytes; no shuffle before the sums."""
    prepared = intensity.prepare_images(s.vector_images(spark, sf_dir), "grayscale")
    counts = annotation.label_counts(intensity.to_bytes(prepared))
    return counts.groupBy("image_id").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum(F.col("n") * F.col("label")).cast("bigint").alias("total")
    )


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS}, c AS (SELECT image_id, y, x, v AS r, (v * 2 + x) % 256 AS g, (v * 3 + y) % 256 AS b FROM vec_px)
SELECT image_id, y, x, {s.sql_rounded('r * 299e-3 + g * 587e-3 + b * 114e-3')} AS gray, r || ',' || r || ',' || r AS rgb FROM c"""
)
def channels(spark, sf_dir):
    """Luminance of three channels, gray repeated to three."""
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    gray = pixels.to_gray([v, (v * 2 + x) % 256, (v * 3 + y) % 256])
    rgb = F.array_join(pixels.to_rgb([v]).cast("array<string>"), ",")
    return s.vector_pixels(spark, sf_dir).select("image_id", "y", "x", s.rounded(gray).alias("gray"), rgb.alias("rgb"))


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS}, c AS (SELECT image_id, y, x, v, v % 3 AS cls FROM vec_px),
k AS (SELECT *, CASE cls WHEN 2 THEN 255 ELSE 0 END AS red, CASE cls WHEN 0 THEN 0 ELSE 255 END AS green FROM c)
SELECT image_id, y, x, CAST(round_even(v * 5e-1 + red * 5e-1, 0) AS INT) AS tint_red,
CAST(round_even(v * 5e-1 + green * 5e-1, 0) AS INT) AS tint_green, CAST(round_even(v * 5e-1, 0) AS INT) AS tint_blue,
CAST(floor(CASE cls WHEN 1 THEN 255 ELSE 0 END * 4e-1 + v * 6e-1) AS INT) AS viewer_red,
CAST(floor(CASE cls WHEN 2 THEN 255 ELSE 0 END * 4e-1 + v * 6e-1) AS INT) AS viewer_green, CAST(floor(0 * 4e-1 + v * 6e-1) AS INT) AS viewer_blue FROM k"""
)
def overlay_tint(spark, sf_dir):
    """Class colours over raw gray, in both blends."""
    v, label = F.col("v"), F.col("v") % 3
    colour = pixels.class_colour(label)
    viewer = pixels.class_colour(label, pixels.VIEWER_COLOURS)
    return s.vector_pixels(spark, sf_dir).select(
        "image_id",
        "y",
        "x",
        pixels.tint(v, colour[0]).alias("tint_red"),
        pixels.tint(v, colour[1]).alias("tint_green"),
        pixels.tint(v, colour[2]).alias("tint_blue"),
        *[pixels.tint_viewer(v, viewer[c]).alias(f"viewer_{name}") for c, name in enumerate(("red", "green", "blue"))],
    )


# --- logits and losses ------------------------------------------------------------------------

LOGITS = ("l0", "l1", "l2", "l3")
WEIGHTS = (0.1, 1.0, 1.0, 2.0)

SQL_SOFT = f"""WITH {s.SQL_VECTOR_LOGITS},
m AS (SELECT *, greatest(l0, l1, l2, l3) AS t FROM logit),
z AS (SELECT *, exp(l0 - t) + exp(l1 - t) + exp(l2 - t) + exp(l3 - t) AS z FROM m),
f AS (SELECT *, exp(l0 - t) / z AS p0, exp(l1 - t) / z AS p1, exp(l2 - t) / z AS p2, exp(l3 - t) / z AS p3,
      -(CASE target WHEN 0 THEN l0 WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l3 END - t - ln(z)) *
       CASE target WHEN 0 THEN 1e-1 WHEN 3 THEN 2e0 ELSE 1e0 END AS ce FROM z)"""


@query(
    f"""{SQL_SOFT} SELECT vec_id, p, CASE WHEN l0 >= l1 AND l0 >= l2 AND l0 >= l3 THEN 0 WHEN l1 >= l2 AND l1 >= l3 THEN 1
WHEN l2 >= l3 THEN 2 ELSE 3 END AS label, {", ".join(f"{s.sql_rounded(f'p{c}')} AS p{c}, {s.sql_rounded(f'l{c} - t - ln(z)')} AS log{c}, CASE WHEN target = {c} THEN 1 ELSE 0 END AS hot{c}" for c in range(4))} FROM f"""
)
def softmax_argmax(spark, sf_dir):
    """Softmax, log-softmax, one-hot and argmax per pixel."""
    columns = [F.col(n) for n in LOGITS]
    return s.vector_logits(spark, sf_dir).select(
        "vec_id",
        "p",
        pixels.argmax(F.array(*columns)).alias("label"),
        *[s.rounded(pixels.softmax(columns)[c]).alias(f"p{c}") for c in range(4)],
        *[s.rounded(pixels.log_softmax(columns)[c]).alias(f"log{c}") for c in range(4)],
        *[pixels.one_hot(F.col("target"), 4)[c].alias(f"hot{c}") for c in range(4)],
    )


def _sql_loss(by: str, source: str = "f") -> str:
    classes = range(4)
    sums = ", ".join(
        f"sum(CASE WHEN target = {c} THEN p{c} ELSE 0e0 END) AS i{c}, "
        f"sum(p{c} * p{c} + CASE WHEN target = {c} THEN 1e0 ELSE 0e0 END) AS d{c}"
        for c in classes
    )
    dice = " + ".join(f"(2e0 * i{c} + 1e-6) / (d{c} + 1e-6)" for c in classes)
    return f"""a AS (SELECT {by}, count(*) AS n_pixels, avg(ce) AS ce_loss, {sums} FROM {source} GROUP BY {by}),
loss AS (SELECT {by}, n_pixels, 1e0 - ({dice}) / 4e0 AS dice_loss, ce_loss,
         7e-1 * (1e0 - ({dice}) / 4e0) + 3e-1 * ce_loss AS loss FROM a)"""


@query(
    f"""{SQL_SOFT}, {_sql_loss('image_id')}
SELECT image_id, n_pixels, {s.sql_rounded('dice_loss')} AS dice_loss, {s.sql_rounded('ce_loss')} AS ce_loss,
{s.sql_rounded('loss')} AS loss FROM loss"""
)
def segmentation_losses(spark, sf_dir):
    """Soft Dice, weighted cross-entropy and their sum per image."""
    values = losses.segmentation_loss(
        s.vector_logits(spark, sf_dir), ["image_id"], LOGITS, class_weights=WEIGHTS, dice_weight=0.7, ce_weight=0.3
    )
    names = ("dice_loss", "ce_loss", "loss")
    return values.select("image_id", "n_pixels", *[s.rounded(F.col(n)).alias(n) for n in names])


@query(
    f"""{SQL_SOFT},
o AS (SELECT vec_id, (row_number() OVER (ORDER BY md5('3:' || vec_id), vec_id) - 1) // 32 AS batch_id,
             row_number() OVER (ORDER BY md5('3:' || vec_id), vec_id) AS rn, count(*) OVER () AS n FROM embeddings),
fb AS (SELECT f.*, batch_id, CASE WHEN l0 >= l1 AND l0 >= l2 AND l0 >= l3 THEN 0 WHEN l1 >= l2 AND l1 >= l3 THEN 1 WHEN l2 >= l3 THEN 2 ELSE 3 END AS pred
       FROM f JOIN o USING (vec_id) WHERE rn <= (n // 32) * 32), {_sql_loss('batch_id', 'fb')},
dk AS (SELECT batch_id, c, (2e0 * count(*) FILTER (target = c AND pred = c) + 1e-6) /
       (count(*) FILTER (target = c) + count(*) FILTER (pred = c) + 1e-6) AS d FROM fb, (SELECT unnest([0,1,2,3]) AS c) GROUP BY 1, 2),
db AS (SELECT batch_id, avg(d) AS mean_dice FROM dk GROUP BY 1)
SELECT {s.sql_rounded('avg(loss)')} AS loss, {s.sql_rounded('avg(mean_dice)')} AS mean_dice, count(*) AS n_batches
FROM loss JOIN db USING (batch_id)"""
)
def batch_losses(spark, sf_dir):
    """Loss and Dice per batch of 32 pictures, then the mean over batches."""
    keys = batches.assign_batches(s.table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"], 32, seed=3)
    rows = s.vector_logits(spark, sf_dir).join(keys.select("vec_id", "batch_id"), "vec_id")
    loss = losses.segmentation_loss(
        rows, ["batch_id"], LOGITS, class_weights=WEIGHTS, dice_weight=0.7, ce_weight=0.3
    )
    labels = rows.select(
        "batch_id", F.col("target").alias("gt"), pixels.argmax(F.array(*LOGITS)).alias("pred")
    )
    dice = confusion.direct_scores(labels, ["batch_id"], 4).groupBy("batch_id").agg(F.avg("dice").alias("mean_dice"))
    means = batches.mean_of_batches(loss.join(dice, "batch_id"), ["loss", "mean_dice"])
    return means.select(s.rounded(F.col("loss")).alias("loss"), s.rounded(F.col("mean_dice")).alias("mean_dice"), "n_batches")


# --- geometry in columns ----------------------------------------------------------------------


@query(
    f"""WITH b AS (SELECT p_partkey, p_size AS n, p_partkey % 97 / 1e2 AS overlap, CAST(p_partkey % 40 AS INT) AS pos FROM part)
SELECT p_partkey, CAST(greatest(1, round_even(n * (1e0 - overlap), 0)) AS INT) AS stride,
(32 - n % 32) % 32 AS total, ((32 - n % 32) % 32) // 2 AS before,
CASE WHEN n <= 16 THEN 1 ELSE CAST(ceil((n - 16) / 12e0) AS INT) + 1 END AS tiles,
CAST({SQL_REFLECT.format(n='n', p='pos', b='(((32 - n % 32) % 32) // 2)')} AS INT) AS source FROM b"""
)
def tile_geometry(spark, sf_dir):
    """Stride, padding and mirrored index per row."""
    n = F.col("p_size")
    total = geometry.multiple_padding(n, 32)
    before = geometry.pad_before(total)
    return s.table(spark, sf_dir, "part").select(
        "p_partkey",
        geometry.stride_for(n, (F.col("p_partkey") % 97) / F.lit(100.0)).alias("stride"),
        total.alias("total"),
        before.alias("before"),
        geometry.grid_count(n, 16, 12).alias("tiles"),
        geometry.reflect_index((F.col("p_partkey") % 40).cast("int"), before, n).alias("source"),
    )


# --- patches ----------------------------------------------------------------------------------

PATCH, PER_IMAGE, RATIO, MIN_SHARE = 4, 8, 0.8, 0.5


def _vector_masks(spark, sf_dir):
    """Masks of embedding pictures: gray above 150 is foreground."""
    return intensity.remap_masks(s.vector_images(spark, sf_dir), {v: int(v > 150) for v in range(256)})


def _candidates(spark, sf_dir, object_ratio=None):
    return patches.score_candidates(
        _vector_masks(spark, sf_dir), patch=PATCH, per_image=PER_IMAGE, min_object_fraction=MIN_SHARE, seed=11, object_ratio=object_ratio
    )


SQL_CANDIDATES = f"""WITH {s.SQL_VECTOR_PIXELS},
att AS (SELECT image_id, a, md5('11:' || image_id || ':' || a) AS k
        FROM (SELECT {s.SQL_VECTOR_NAME} AS image_id, unnest(range(1000)) AS a FROM embeddings)),
org AS (SELECT image_id, CAST(a AS INT) AS attempt, CAST({s.sql_draw('k', 0)} % 5 AS INT) AS y0, CAST({s.sql_draw('k', 1)} % 5 AS INT) AS x0 FROM att),
fgp AS (SELECT image_id, oy AS y0, ox AS x0, sum(CASE WHEN v > 150 THEN 1 ELSE 0 END) AS fg
        FROM vec_px, (SELECT unnest(range(5)) AS oy), (SELECT unnest(range(5)) AS ox)
        WHERE y BETWEEN oy AND oy + 3 AND x BETWEEN ox AND ox + 3 GROUP BY 1, 2, 3),
cand AS (SELECT image_id, attempt, o.y0, o.x0, CAST(fg AS DOUBLE) / 16e0 AS fg_fraction,
                CAST(fg AS DOUBLE) / 16e0 > 5e-1 AS is_object FROM org o JOIN fgp USING (image_id, y0, x0))"""


@query(f"{SQL_CANDIDATES} SELECT * FROM cand")
def patch_candidates(spark, sf_dir):
    """A thousand random positions per mask with their foreground share."""
    return _candidates(spark, sf_dir)


SQL_SELECTED = f"""{SQL_CANDIDATES},
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, is_object ORDER BY attempt) AS o FROM cand),
pk AS (SELECT *, md5('11:pick:' || image_id || ':' || attempt) AS k FROM r WHERE o <= CASE WHEN is_object THEN 6 ELSE 2 END),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k, attempt) AS rank, count(*) OVER (PARTITION BY image_id) AS have FROM pk),
ex AS (SELECT image_id, have, slot, {s.sql_draw("md5('11:extra:' || image_id || ':' || slot)")} % have + 1 AS rank
       FROM (SELECT DISTINCT image_id, have, unnest(range(have + 1, {PER_IMAGE + 1})) AS slot FROM rk)),
sel AS (SELECT image_id, attempt, y0, x0, fg_fraction, is_object, CAST(rank AS INT) AS patch_id, FALSE AS repeated FROM rk
        UNION ALL SELECT rk.image_id, attempt, y0, x0, fg_fraction, is_object, CAST(slot AS INT), TRUE
        FROM ex JOIN rk ON rk.image_id = ex.image_id AND rk.rank = ex.rank)"""


@query(f"{SQL_SELECTED} SELECT * FROM sel")
def patch_quota(spark, sf_dir):
    """Eight patches per picture by quota, short picks filled up with repeats."""
    return patches.select_patches(_candidates(spark, sf_dir, RATIO), per_image=PER_IMAGE, object_ratio=RATIO, seed=11)


PATCH_SUMS = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("patch_id", T.IntegerType()),
        T.StructField("image_sum", T.LongType()),
        T.StructField("mask_sum", T.LongType()),
    ]
)


def _sum_patch(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
    image = np.frombuffer(row["image"], dtype=row["dtype"]).astype(np.int64).reshape(row["patch"], -1)
    mask = np.frombuffer(row["mask"], dtype=np.uint8).astype(np.int64).reshape(row["patch"], -1)
    weights = np.arange(1, image.size + 1, dtype=np.int64).reshape(image.shape)
    yield {
        "image_id": row["image_id"],
        "patch_id": row["patch_id"],
        "image_sum": int((image * weights).sum()),
        "mask_sum": int((mask * weights).sum()),
    }


def patch_sums(table):
    """Place-weighted sums of image and mask bytes per patch."""
    return table.select("image_id", "patch_id", "patch", "dtype", "image", "mask").mapInArrow(
        flat_map(_sum_patch, PATCH_SUMS), PATCH_SUMS
    )


def _patch_table(spark, sf_dir):
    return patches.build_patches(
        s.vector_images(spark, sf_dir),
        _vector_masks(spark, sf_dir),
        patch=PATCH,
        per_image=PER_IMAGE,
        object_ratio=RATIO,
        min_object_fraction=MIN_SHARE,
        seed=11,
    )


@query(
    f"""{SQL_SELECTED} SELECT image_id, patch_id, CAST(sum(v * (4 * (y - y0) + x - x0 + 1)) AS BIGINT) AS image_sum,
CAST(sum(CASE WHEN v > 150 THEN 4 * (y - y0) + x - x0 + 1 ELSE 0 END) AS BIGINT) AS mask_sum
FROM sel JOIN vec_px USING (image_id) WHERE y BETWEEN y0 AND y0 + 3 AND x BETWEEN x0 AND x0 + 3 GROUP BY 1, 2"""
)
def patch_crops(spark, sf_dir):
    """The pixels of the chosen patches."""
    return patch_sums(_patch_table(spark, sf_dir))


# --- augmentation -----------------------------------------------------------------------------


def _picture_patches(spark, sf_dir):
    """Embedding pictures as 8 x 8 patches."""
    pairs = patches.pair_pixels(s.vector_images(spark, sf_dir), _vector_masks(spark, sf_dir))
    return pairs.select(
        "image_id",
        F.lit(1).alias("patch_id"),
        F.lit(0).alias("y0"),
        F.lit(0).alias("x0"),
        F.lit(0.0).alias("fg_fraction"),
        F.lit(False).alias("is_object"),
        F.lit(8).alias("patch"),
        "channels",
        "dtype",
        F.col("data").alias("image"),
        "mask",
    )


TURNS_ONLY = augment.AugmentSpec(
    elastic_probability=0.0,
    scale_probability=0.0,
    blur_probability=0.0,
    noise_probability=0.0,
    brightness_contrast_probability=0.0,
)

SQL_TURNS = f"""WITH {s.SQL_VECTOR_PIXELS},
names AS (SELECT DISTINCT image_id FROM vec_px),
d AS (SELECT image_id, {s.sql_uniform("md5('5:flip_h:' || image_id || ':1')")} < 5e-1 AS fh,
             {s.sql_uniform("md5('5:flip_v:' || image_id || ':1')")} < 5e-1 AS fv,
             CASE WHEN {s.sql_uniform("md5('5:rotate:' || image_id || ':1')")} < 5e-1
                  THEN {s.sql_draw("md5('5:rotate:' || image_id || ':1')", 1)} % 4 ELSE 0 END AS k FROM names),
f AS (SELECT image_id, v, k, CASE WHEN fh THEN 7 - x ELSE x END AS x, CASE WHEN fv THEN 7 - y ELSE y END AS y
      FROM vec_px JOIN d USING (image_id)),
o AS (SELECT image_id, v, CASE k WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y WHEN 3 THEN x ELSE y END AS y,
             CASE k WHEN 1 THEN y WHEN 2 THEN 7 - x WHEN 3 THEN 7 - y ELSE x END AS x FROM f)"""


@query(
    f"""{SQL_TURNS} SELECT image_id, 1 AS patch_id, CAST(sum(v * (8 * y + x + 1)) AS BIGINT) AS image_sum,
CAST(sum(CASE WHEN v > 150 THEN 8 * y + x + 1 ELSE 0 END) AS BIGINT) AS mask_sum FROM o GROUP BY 1"""
)
def flip_rotate_patches(spark, sf_dir):
    """Seeded flips and quarter turns of image and mask together."""
    return patch_sums(augment.augment_patches(_picture_patches(spark, sf_dir), TURNS_ONLY, seed=5))


@query(f"{SQL_TURNS} SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v FROM o")
def flip_rotate(spark, sf_dir):
    """U2, U3 on a pixel table: coordinates move, values stay."""
    base = s.vector_pixels(spark, sf_dir).withColumn("patch_id", F.lit(1))
    drawn = augment.draw_parameters(base, TURNS_ONLY, 5)
    y, x = augment.turned_position(
        F.col("y"), F.col("x"), 8, F.col("flip_h"), F.col("flip_v"), F.col("quarter_turns")
    )
    return drawn.select("image_id", y.alias("y"), x.alias("x"), "v")


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS}, d AS (SELECT *, md5('5:jitter:' || image_id || ':1') AS k FROM vec_px),
j AS (SELECT image_id, y, x, v, CASE WHEN {s.sql_uniform('k')} < 5e-1 THEN
 greatest(least(v * (1e0 + (-3e-1 + {s.sql_uniform('k', 1)} * 6e-1)) + (-3e-1 + {s.sql_uniform('k', 2)} * 6e-1) * 255e0, 255e0), 0e0)
 ELSE CAST(v AS DOUBLE) END AS value FROM d)
SELECT image_id, y, x, {s.sql_rounded('value')} AS value FROM j"""
)
def jitter(spark, sf_dir):
    """U8: brightness and contrast on a pixel table."""
    base = s.vector_pixels(spark, sf_dir).withColumn("patch_id", F.lit(1))
    drawn = augment.draw_parameters(base, augment.AugmentSpec(), 5)
    v = F.col("v").cast("double")
    changed = F.when(
        F.col("contrast").isNull(), v
    ).otherwise(augment.jittered(v, F.col("contrast"), F.col("brightness"), 255.0))
    return drawn.select("image_id", "y", "x", s.rounded(changed).alias("value"))


@query()
def augmented_patch_table(spark, sf_dir):
    """The training patch table of a split, every step switched on as published."""
    table = training_data.patch_table(
        s.vector_images(spark, sf_dir),
        _vector_masks(spark, sf_dir),
        patch=PATCH,
        per_image=PER_IMAGE,
        object_ratio=RATIO,
        min_object_fraction=MIN_SHARE,
        seed=11,
        augment=augment.AugmentSpec(),
    )
    return patch_sums(table)


# --- synthetic pictures, one per row of a table -----------------------------------------------


@query(
    """WITH p AS (SELECT 'part_' || p_partkey AS image_id, p_size AS h, unnest(range(p_size)) AS y FROM part)
SELECT image_id, count(*) FILTER (b = 0) * 6 AS class_0, count(*) FILTER (b = 1) * 6 AS class_1,
count(*) FILTER (b = 2) * 6 AS class_2, count(*) FILTER (b = 3) * 6 AS class_3, count(*) * 6 AS total_pixels
FROM (SELECT image_id, ((y + 1) * 4 - 1) // h AS b FROM p) GROUP BY 1"""
)
def synthetic_stripes(spark, sf_dir):
    """A stripe mask per part, as tall as its size."""
    sizes = s.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("image_id"),
        F.col("p_size").alias("height"),
        F.lit(6).alias("width"),
    )
    return annotation.class_counts(annotation.label_counts(synthetic.stripe_masks(sizes)))


@query(
    """WITH p AS (SELECT 'part_' || p_partkey AS image_id, p_size AS h, unnest(range(p_size)) AS y FROM part)
SELECT image_id, CAST(y AS INT) AS y, CAST(((y + 1) * 4 - 1) // h AS INT) AS label FROM p"""
)
def stripe_rows(spark, sf_dir):
    """S17 in columns: the class of every image row."""
    rows = s.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("image_id"),
        F.col("p_size").alias("h"),
        F.explode(F.sequence(F.lit(0), F.col("p_size") - 1)).alias("y"),
    )
    return rows.select("image_id", "y", synthetic.stripe_label(F.col("y"), F.col("h"), (0, 1, 2, 3)).alias("label"))


BLOB_SIDE, BLOB_SCALE = 64, 0.125


def _blobs(spark, sf_dir):
    index = s.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"))
    drawn = synthetic.draw_circles(
        synthetic.named(index), height=BLOB_SIDE, width=BLOB_SIDE, seed=42, scale=BLOB_SCALE
    )
    return synthetic.paint_pairs(drawn)


SQL_BLOBS = f"""WITH nm AS (SELECT 'synth_' || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END
  || CASE s_suppkey % 2 WHEN 0 THEN '_4x' ELSE '_10x' END AS image_id, s_suppkey % 2 = 0 AS small FROM supplier),
st AS (SELECT *, unnest(range(10)) AS step FROM nm),
kk AS (SELECT *, md5('42:' || image_id || ':' || step) AS k FROM st),
ci AS (SELECT image_id, step, CASE WHEN step < 4 THEN 2 ELSE 1 END AS label,
  {s.sql_draw('k', 0)} % CASE WHEN step < 4 THEN 40 ELSE 44 END + CASE WHEN step < 4 THEN 12 ELSE 10 END AS cy,
  {s.sql_draw('k', 1)} % CASE WHEN step < 4 THEN 40 ELSE 44 END + CASE WHEN step < 4 THEN 12 ELSE 10 END AS cx,
  CASE WHEN step < 4 THEN CASE WHEN small THEN {s.sql_draw('k', 2)} % 3 + 5 ELSE {s.sql_draw('k', 2)} % 6 + 10 END
       ELSE CASE WHEN small THEN {s.sql_draw('k', 2)} % 3 + 1 ELSE {s.sql_draw('k', 2)} % 4 + 4 END END AS r FROM kk),
g AS (SELECT y, x FROM (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x)),
hit AS (SELECT image_id, y, x, arg_max(label, step) AS label FROM ci, g
        WHERE (y - cy) * (y - cy) + (x - cx) * (x - cx) <= r * r GROUP BY 1, 2, 3),
n AS (SELECT image_id, count(*) FILTER (label = 1) AS c1, count(*) FILTER (label = 2) AS c2 FROM hit GROUP BY 1)"""


@query(
    f"{SQL_BLOBS} SELECT image_id, 4096 - c1 - c2 AS class_0, c1 AS class_1, c2 AS class_2, "
    "CAST(0 AS BIGINT) AS class_3, CAST(4096 AS BIGINT) AS total_pixels FROM n"
)
def synthetic_blobs(spark, sf_dir):
    """A blob picture per supplier; pixels per class of its mask."""
    masks = synthetic.masks_of(_blobs(spark, sf_dir))
    return annotation.class_counts(annotation.label_counts(masks))


@query(
    f"""{SQL_BLOBS}, c AS (SELECT unnest(['background', 'loose cell', 'aggregate', 'object']) AS class, unnest([0, 1, 2, 3]) AS id),
t AS (SELECT CAST(sum(c1) AS BIGINT) AS c1, CAST(sum(c2) AS BIGINT) AS c2, count(*) AS n_images FROM n)
SELECT 'overall' AS "group", class, 1e0 AS dice, 1e0 AS iou, n_images FROM c, t"""
)
def blob_evaluation(spark, sf_dir):
    """Cutting raw grays at the band ends finds every blob, so all scores are 1."""
    pairs = _blobs(spark, sf_dir)
    per_image = evaluation.evaluate_pairs(pairs, synthetic.threshold_labels, tile=32, batch_size=16)
    return confusion.report(per_image).filter("grain = 'overall'").select("group", "class", "dice", "iou", "n_images")
