"""Registered queries that go through files: written from the tables, read back, checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import naming
from tilewright.operators import annotation, catalogue, intensity, splits, training_log
from tilewright.plans import evaluation, inference, onboarding, training_data
from tilewright.plans import registry_pixels as px
from tilewright.plans import registry_tables as tb
from tilewright.plans import standins as s
from tilewright.session import scratch_path
from tilewright.sources import (
    images,
    metadata,
    reports,
    runs,
    split_lists,
    synthetic,
)
from tilewright.streaming import catalogue as stream

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


# --- image files ------------------------------------------------------------------------------


def _raw_folder(spark: SparkSession, sf_dir: str, keep: str = "true") -> str:
    """Embedding pictures as PNG files."""
    folder = scratch_path(spark, "raw")
    images.write_png(s.vector_images(spark, sf_dir).filter(keep), folder)
    return folder


def _mixed_folder(spark: SparkSession, sf_dir: str) -> str:
    """The same with every tenth name in capitals and every tenth file not an image."""
    folder = scratch_path(spark, "mixed")
    files = images.encode_images(s.vector_images(spark, sf_dir))
    number = F.regexp_extract("name", r"vec_(\d+)", 1).cast("int") % 10
    bare = naming.stem(F.col("name"))
    name = (
        F.when(number == 8, F.concat(bare, F.lit(".PNG")))
        .when(number == 9, F.concat(bare, F.lit(".txt")))
        .otherwise(F.col("name"))
    )
    images.write_files(files.withColumn("name", name), folder)
    return folder


SQL_VECTORS = f"""vec AS (SELECT vec_id, {s.SQL_VECTOR_NAME} AS image_id FROM embeddings)"""


@query(
    f"""WITH {SQL_VECTORS} SELECT image_id, image_id || CASE WHEN vec_id % 10 = 8 THEN '.PNG' ELSE '.png' END AS name,
{s.sql_magnification('image_id')} AS magnification FROM vec WHERE vec_id % 10 <> 9"""
)
def image_scan(spark, sf_dir):
    """Supported files of a folder."""
    files = images.require_images(images.scan_images(spark, _mixed_folder(spark, sf_dir)))
    return files.select("image_id", "name", naming.magnification(F.col("name")).alias("magnification"))


@query(f"WITH {SQL_VECTORS} SELECT image_id || '.txt' AS name FROM vec WHERE vec_id % 10 = 9")
def skipped_files(spark, sf_dir):
    """Files that are not images."""
    return images.skipped_files(spark, _mixed_folder(spark, sf_dir)).select("name")


@query(
    f"""WITH {SQL_VECTORS} SELECT image_id, 8 AS height, 8 AS width, 1 AS channels, 'uint8' AS dtype, NULL AS error
FROM vec WHERE vec_id % 10 <> 9"""
)
def header_scan(spark, sf_dir):
    """Size and number type from the header."""
    return images.scan_headers(spark, _mixed_folder(spark, sf_dir)).drop("path")


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS} SELECT image_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total,
CAST(sum(v * (31 * y + 17 * x + 1)) AS BIGINT) AS weighted FROM vec_px GROUP BY 1"""
)
def image_decode(spark, sf_dir):
    """Gray PNG files written and decoded."""
    decoded = images.decode_masks(spark, _raw_folder(spark, sf_dir))
    blocks = decoded.select(
        "*", *[F.lit(0).alias(c) for c in ("tile_y", "tile_x", "y0", "x0")]
    )
    return px.block_sums(blocks).select("image_id", "n", "total", "weighted")


def _colour_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digits(v, i):
        x, y = i % 8, F.floor(i / F.lit(8)).cast("int")
        return F.concat(
            *[F.lpad(F.hex(c), 2, "0") for c in (v, (v * 2 + x) % 256, (v * 3 + y) % 256)]
        )

    return s.vector_grays(spark, sf_dir).select(
        "image_id",
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(3).alias("channels"),
        F.lit("uint8").alias("dtype"),
        F.unhex(F.array_join(F.transform("grays", digits), "")).alias("data"),
    )


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS}, c AS (SELECT image_id, v AS r, (v * 2 + x) % 256 AS g, (v * 3 + y) % 256 AS b FROM vec_px)
SELECT image_id, count(*) AS n, CAST(sum(round_even(r * 299e-3 + g * 587e-3 + b * 114e-3, 0)) AS BIGINT) AS total FROM c GROUP BY 1"""
)
def colour_decode(spark, sf_dir):
    """Colour PNG files decoded as red-green-blue and turned gray."""
    folder = scratch_path(spark, "colour")
    images.write_png(_colour_images(spark, sf_dir), folder)
    gray = intensity.convert_channels(images.decode_images(spark, folder), "grayscale")
    return annotation.label_counts(gray).groupBy("image_id").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum(F.col("n") * F.col("label")).cast("bigint").alias("total")
    )


# --- metadata files ---------------------------------------------------------------------------


def _metadata_folder(spark: SparkSession, sf_dir: str) -> str:
    """Lines ``image,magnification,condition`` in part order, some of them bad."""
    folder = scratch_path(spark, "metadata")
    key = F.col("p_partkey")
    name = F.concat(F.lit("p_"), (key - key % 3).cast("string"), F.lit("_4x.png"))
    line = (
        F.when(key % 23 == 0, name)
        .when(key % 29 == 0, F.concat(F.lit(" ,4x,"), "p_type"))
        .when(key % 31 == 0, F.concat(name, F.lit(",20x,"), "p_type"))
        .when(key % 37 == 0, F.lit("   "))
        .otherwise(
            F.concat(name, F.when(key % 2 == 0, F.lit(", 4x ,")).otherwise(F.lit(",10x,")), "p_type", F.lit(" "), key.cast("string"))
        )
    )
    lines = s.table(spark, sf_dir, "part").orderBy("p_partkey").select(line.alias("image,magnification,condition"))
    lines.write.option("sep", "\u0001").option("quote", "").option("emptyValue", "").csv(
        folder, header=True
    )
    return folder


SQL_METADATA = """
ln AS (SELECT p_partkey, 'p_' || (p_partkey - p_partkey % 3) || '_4x' AS st, p_type,
  CASE WHEN p_partkey % 23 = 0 THEN 'short' WHEN p_partkey % 29 = 0 THEN 'blank' WHEN p_partkey % 31 = 0 THEN 'value'
       WHEN p_partkey % 37 = 0 THEN 'empty' ELSE 'good' END AS kind FROM part)"""


@query(
    f"""WITH {SQL_METADATA}, g AS (SELECT st AS image_id, max(p_partkey) AS k FROM ln WHERE kind = 'good' GROUP BY 1)
SELECT image_id, image_id || '.png' AS image, CASE k % 2 WHEN 0 THEN '4x' ELSE '10x' END AS magnification,
       p_type || ' ' || k AS condition FROM g JOIN ln ON p_partkey = k"""
)
def metadata_strict(spark, sf_dir):
    """Clean rows of a metadata file, the last row per stem."""
    clean, _ = metadata.read_metadata_strict(spark, _metadata_folder(spark, sf_dir))
    return clean


@query(
    f"""WITH {SQL_METADATA} SELECT CASE kind WHEN 'short' THEN 'malformed row: ' || st || '.png' WHEN 'blank' THEN 'empty image name'
ELSE 'invalid magnification ''20x'' for image ''' || st || '.png''' END AS error FROM ln WHERE kind IN ('short', 'blank', 'value')"""
)
def metadata_errors(spark, sf_dir):
    """Bad lines of a metadata file."""
    _, errors = metadata.read_metadata_strict(spark, _metadata_folder(spark, sf_dir))
    return errors.select("error")


@query(
    f"""WITH {tb.SQL_MERGE} SELECT * FROM existing
UNION ALL SELECT * FROM arrived WHERE image NOT IN (SELECT image FROM existing)"""
)
def metadata_versions(spark, sf_dir):
    """A stored table is read, merged and stored as its next version."""
    folder = scratch_path(spark, "catalogue")
    metadata.write_metadata(tb._existing(spark, sf_dir), folder)
    existing = metadata.read_metadata_lenient(spark, metadata.latest_version(spark, folder))
    merged = catalogue.merge_metadata(existing, tb._arrived(spark, sf_dir))
    stored = metadata.write_metadata(merged, folder, mode="update")
    return metadata.read_metadata_lenient(spark, stored)


# --- split lists ------------------------------------------------------------------------------


@query(f"WITH {tb._sql_split(tb.SQL_DOC_META)} SELECT split, image_id FROM assigned")
def split_lists_stored(spark, sf_dir):
    """Lists written, size-checked, read back and leak-checked."""
    folder = scratch_path(spark, "splits")
    split_lists.write_splits(splits.assign_splits(tb._doc_metadata(spark, sf_dir)), folder)
    return split_lists.read_splits(spark, folder).select("split", "image_id")


# --- quality control on files -----------------------------------------------------------------


def _odd_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks with values 0..4 where 4 is invalid; every twentieth has another shape."""
    masks = intensity.remap_masks(
        s.vector_images(spark, sf_dir), {v: (v // 50) % 5 for v in range(256)}
    )
    odd = F.regexp_extract("image_id", r"vec_(\d+)", 1).cast("int") % 20 == 0
    return masks.withColumn("height", F.when(odd, 4).otherwise(8)).withColumn(
        "width", F.when(odd, 16).otherwise(8)
    )


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS}, m AS (SELECT image_id, v // 50 % 5 AS c FROM vec_px),
w AS (SELECT image_id AS image, count(*) FILTER (c <= 3) AS total_pixels, count(*) FILTER (c = 0) AS class_0, count(*) FILTER (c = 1) AS class_1,
  count(*) FILTER (c = 2) AS class_2, count(*) FILTER (c = 3) AS class_3, bool_or(c = 4) AS bad FROM m GROUP BY 1)
SELECT image, total_pixels, class_0, class_1, class_2, class_3, nullif(concat_ws('; ',
  CASE WHEN CAST(regexp_extract(image, 'vec_([0-9]+)', 1) AS INT) % 20 = 0 THEN 'shape mismatch: raw (8, 8) vs mask (4, 16)' END,
  CASE WHEN bad THEN 'invalid mask values [4]' END), '') AS violations FROM w"""
)
def qc_files(spark, sf_dir):
    """The QC report of two folders, written and read back."""
    raw, masks = _raw_folder(spark, sf_dir), scratch_path(spark, "masks")
    images.write_png(_odd_masks(spark, sf_dir), masks)
    out = scratch_path(spark, "qc")
    reports.write_qc_report(onboarding.quality_report(spark, raw, masks), out)
    schema = "image string, total_pixels bigint, class_0 bigint, class_1 bigint, class_2 bigint, class_3 bigint, violations string"
    return spark.read.schema(schema).csv(out, header=True)


# --- evaluation and inference on files --------------------------------------------------------


def _mask_folder(spark: SparkSession, sf_dir: str) -> str:
    """Masks 0..3 by gray value, moved a little against the cuts of the predictor."""
    folder = scratch_path(spark, "masks")
    cut = {v: (v >= 90) + (v >= 170) + (v >= 230) for v in range(256)}
    images.write_png(intensity.remap_masks(s.vector_images(spark, sf_dir), cut), folder)
    return folder


SQL_FILE_EVALUATION = f"""WITH {s.SQL_VECTOR_PIXELS}, {px.SQL_CLASSES},
{tb._sql_split(f"meta AS (SELECT image_id, {s.sql_magnification('image_id')} AS magnification, '' AS condition FROM (SELECT {s.SQL_VECTOR_NAME} AS image_id FROM embeddings))")},
p AS (SELECT v2.image_id, {s.sql_magnification('v2.image_id')} AS magnification,
             CASE WHEN v >= 170 THEN 2 WHEN v >= 90 THEN 1 ELSE 0 END AS gt, CASE WHEN v >= 180 THEN 2 WHEN v >= 100 THEN 1 ELSE 0 END AS pred
      FROM vec_px v2 JOIN assigned a ON a.image_id = v2.image_id AND split = 'test'),
i AS ({px._sql_counts('p', 'magnification, image_id')}),
g AS (SELECT CASE WHEN GROUPING(magnification) = 1 THEN 'overall' ELSE magnification END AS "group",
             class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) AS n_images
      FROM i GROUP BY GROUPING SETS ((class), (class, magnification)))
SELECT "group", class, {px.SQL_SCORES}, n_images, CAST(0 AS BIGINT) AS n_out_of_range FROM g"""


def _split_lists(spark: SparkSession, raw: str) -> str:
    """Split lists of the pictures of a folder, by magnification."""
    lists = scratch_path(spark, "splits")
    names = images.stored_scan(spark, raw).select(
        "image_id", naming.magnification(F.col("path")).alias("magnification"), F.lit("").alias("condition")
    )
    split_lists.write_splits(splits.assign_splits(names), lists)
    return lists


def _evaluated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, masks = _raw_folder(spark, sf_dir), _mask_folder(spark, sf_dir)
    lists = _split_lists(spark, raw)
    return evaluation.evaluate_split(
        spark,
        raw,
        masks,
        lists,
        "test",
        synthetic.threshold_labels,
        tile=5,
        class_mapping={0: 0, 1: 1, 2: 2, 3: 2},
        batch_size=32,
        normalise=False,
    )


@query(SQL_FILE_EVALUATION)
def evaluate_files(spark, sf_dir):
    """Files to report, through the stored metrics table."""
    out = scratch_path(spark, "evaluation")
    reports.write_evaluation(_evaluated_files(spark, sf_dir), out)
    return spark.read.schema(
        "group string, class string, dice double, iou double, n_images bigint, n_out_of_range bigint"
    ).csv(f"{out}/metrics_csv", header=True)


@query(
    f"""{px.SQL_SELECTED},
{tb._sql_split(f"meta AS (SELECT DISTINCT image_id, {s.sql_magnification('image_id')} AS magnification, '' AS condition FROM vec_px)")}
SELECT sel.image_id, patch_id, CAST(sum(v * (4 * (y - y0) + x - x0 + 1)) AS BIGINT) AS image_sum,
CAST(sum(CASE WHEN v > 150 THEN 4 * (y - y0) + x - x0 + 1 ELSE 0 END) AS BIGINT) AS mask_sum
FROM sel JOIN vec_px ON vec_px.image_id = sel.image_id JOIN assigned ON assigned.image_id = sel.image_id AND split = 'train'
WHERE y BETWEEN y0 AND y0 + 3 AND x BETWEEN x0 AND x0 + 3 GROUP BY 1, 2""".replace("r AS (SELECT *, row_number() OVER (PARTITION BY stratum", "rr AS (SELECT *, row_number() OVER (PARTITION BY stratum").replace("ELSE 'test' END AS split FROM r)", "ELSE 'test' END AS split FROM rr)")
)
def training_patches(spark, sf_dir):
    """The patch table of the training split, from files."""
    raw, masks = _raw_folder(spark, sf_dir), scratch_path(spark, "masks")
    images.write_png(px._vector_masks(spark, sf_dir), masks)
    lists = _split_lists(spark, raw)
    table = training_data.split_patch_table(
        spark,
        raw,
        masks,
        lists,
        "train",
        normalise=False,
        patch=px.PATCH,
        per_image=px.PER_IMAGE,
        object_ratio=px.RATIO,
        min_object_fraction=px.MIN_SHARE,
        seed=11,
    )
    return px.patch_sums(table)


@query(
    f"""{px.SQL_REPORT}, sc AS (SELECT grain, "group", class, {px.SQL_SCORES}, n_images FROM g),
pi AS (SELECT i.magnification, class, {px.SQL_SCORES} FROM i),
st AS (SELECT magnification, avg(dice) AS m, stddev_pop(dice) AS d FROM pi WHERE class = 'object' GROUP BY 1),
cm AS (SELECT 'overall' AS grain, 'overall' AS "group", gt, pred FROM px UNION ALL SELECT 'magnification', magnification, gt, pred FROM px
       UNION ALL SELECT 'image', image_id, gt, pred FROM px),
mx AS (SELECT grain, "group", {', '.join(f'count(*) FILTER (gt = {g} AND pred = {p}) AS c_{g}_{p}' for g in range(3) for p in range(3))} FROM cm GROUP BY 1, 2)
SELECT sc.grain, sc."group", n_images, max(dice) FILTER (class = 'background') AS dice_0, max(dice) FILTER (class = 'loose cell') AS dice_1,
       max(dice) FILTER (class = 'aggregate') AS dice_2, max(dice) FILTER (class = 'object') AS object_dice,
       {s.sql_rounded('max(m)')} AS mean_object_dice, {s.sql_rounded('max(d)')} AS std_object_dice,
       {', '.join(f'any_value(c_{g}_{p}) AS c_{g}_{p}' for g in range(3) for p in range(3))},
       any_value(c_0_0) AS o_0_0, any_value(c_0_1 + c_0_2) AS o_0_1, any_value(c_1_0 + c_2_0) AS o_1_0,
       any_value(c_1_1 + c_1_2 + c_2_1 + c_2_2) AS o_1_1
FROM sc JOIN mx USING (grain, "group") LEFT JOIN st ON sc.grain = 'magnification' AND sc."group" = st.magnification GROUP BY 1, 2, 3"""
)
def metrics_json(spark, sf_dir):
    """The nested report, written as JSON lines and read back."""
    out = scratch_path(spark, "evaluation")
    reports.write_evaluation(px._per_image(spark, sf_dir), out)
    schema = (
        "grain string, group string, dice array<double>, object_dice double, n_images bigint, "
        "confusion_matrix array<array<bigint>>, confusion_matrix_object array<array<bigint>>, "
        "per_image struct<mean_object_dice: double, std_object_dice: double>"
    )
    return spark.read.schema(schema).json(f"{out}/metrics_json").select(
        "grain",
        "group",
        "n_images",
        *[F.col("dice")[c].alias(f"dice_{c}") for c in range(3)],
        "object_dice",
        s.rounded(F.col("per_image.mean_object_dice")).alias("mean_object_dice"),
        s.rounded(F.col("per_image.std_object_dice")).alias("std_object_dice"),
        *[F.col("confusion_matrix")[g][p].alias(f"c_{g}_{p}") for g in range(3) for p in range(3)],
        *[F.col("confusion_matrix_object")[g][p].alias(f"o_{g}_{p}") for g in (0, 1) for p in (0, 1)],
    )


SQL_PREDICTED = f"""WITH {s.SQL_VECTOR_PIXELS}, p AS (SELECT image_id, y, x, v, CASE WHEN v >= 180 THEN 2 WHEN v >= 100 THEN 1 ELSE 0 END AS label FROM vec_px)"""


def _predicted(spark: SparkSession, sf_dir: str) -> str:
    store = scratch_path(spark, "inference")
    inference.predict_folder(
        spark,
        _raw_folder(spark, sf_dir),
        synthetic.threshold_logits,
        tile=5,
        overlap=0.4,
        batch_size=32,
        normalise=False,
        store=store,
        export=True,
    )
    return store


@query(f"{SQL_PREDICTED} SELECT image_id, label, count(*) AS n FROM p GROUP BY 1, 2")
def predict_files(spark, sf_dir):
    """A folder scored with overlap, exported as PNG masks, read back."""
    return annotation.label_counts(images.decode_masks(spark, f"{_predicted(spark, sf_dir)}/predictions"))


@query(
    f"""{SQL_PREDICTED}, c AS (SELECT image_id, round_even(v * 5e-1 + CASE label WHEN 2 THEN 255 ELSE 0 END * 5e-1, 0) AS r,
 round_even(v * 5e-1 + CASE label WHEN 0 THEN 0 ELSE 255 END * 5e-1, 0) AS g, round_even(v * 5e-1, 0) AS b FROM p)
SELECT image_id, CAST(sum(r) + 1000 * sum(g) + 1000000 * sum(b) AS BIGINT) AS code FROM c GROUP BY 1"""
)
def prediction_overlays(spark, sf_dir):
    """Overlay files of a scored folder, read back."""
    overlays = images.decode_images(spark, f"{_predicted(spark, sf_dir)}/overlays")
    digits = F.hex("data")
    places = F.sequence(F.lit(0), F.lit(63))

    def total(channel: int):
        at = lambda i: F.conv(digits.substr(6 * i + 2 * channel + 1, F.lit(2)), 16, 10).cast("bigint")
        return F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, i: acc + at(i))

    return overlays.select("image_id", (total(0) + 1000 * total(1) + 1_000_000 * total(2)).alias("code"))


# --- training logs and artifacts --------------------------------------------------------------


@query(
    """WITH e AS (SELECT user_id, event_id AS epoch, value, event_id % 3 AS m FROM events)
SELECT CAST(user_id AS VARCHAR) AS run, CAST(epoch AS INT) AS epoch, c AS class, value / (c + 1) AS dice
FROM e, (SELECT unnest([0, 1, 2]) AS c)"""
)
def training_log_long(spark, sf_dir):
    """A log written as CSV, read by column name, in long form."""
    folder = scratch_path(spark, "log")
    value = F.col("value")
    log = s.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("epoch"),
        (value / F.lit(2.0)).alias("dice_class_1"),
        value.alias("train_loss"),
        (value / F.lit(1.0)).alias("dice_class_0"),
        (value / F.lit(3.0)).alias("dice_class_2"),
    )
    log.write.csv(folder, header=True)
    return training_log.class_scores_long(runs.read_training_log(spark, folder), ["run", "epoch"])


@query("SELECT 'seg-' || s_nationkey AS config, count(*) AS n_runs FROM supplier GROUP BY 1")
def artifact_files(spark, sf_dir):
    """Artifact files found under run folders, counted per config."""
    folder = scratch_path(spark, "runs")
    # A run's stamp is a date and six digits; larger numbers go on with the next date.
    stamp = F.format_string("%08d_%06d", 20240101 + F.expr("s_suppkey div 1000000"), F.col("s_suppkey") % 1_000_000)
    files = s.table(spark, sf_dir, "supplier").select(
        F.concat(
            F.lit("seg-"), F.col("s_nationkey").cast("string"), F.lit("_"), stamp, F.lit("/" + runs.BEST_ARTIFACT)
        ).alias("name"),
        F.encode("s_name", "UTF-8").alias("content"),
    )
    images.write_files(files, folder)
    return runs.newest_per_config(runs.artifact_listing(spark, folder)).select("config", "n_runs")


# --- whole jobs -------------------------------------------------------------------------------


@query(
    f"""WITH {tb._sql_split(f"meta AS (SELECT image_id, {s.sql_magnification('image_id')} AS magnification, '' AS condition FROM (SELECT vec_id, {s.SQL_VECTOR_NAME} AS image_id FROM embeddings) WHERE vec_id % 3 <> 2)")}
SELECT split, magnification, cond AS condition, count(*) AS n FROM assigned
GROUP BY GROUPING SETS ((split), (split, magnification), (split, cond))"""
)
def onboarding_files(spark, sf_dir):
    """From folders to checked split lists."""
    named = "image_id like '%x'"
    raw = _raw_folder(spark, sf_dir, named)
    masks = _raw_folder(spark, sf_dir, named)
    table, lists = scratch_path(spark, "catalogue"), scratch_path(spark, "splits")
    onboarding.update_metadata(spark, raw, table)
    return onboarding.make_splits(spark, raw, masks, metadata.latest_version(spark, table), lists)


@query(
    f"""WITH {SQL_VECTORS} SELECT image_id || '.png' AS image, CASE vec_id % 2 WHEN 0 THEN '10x' ELSE
CASE WHEN {s.sql_magnification('image_id')} = 'unknown' THEN '' ELSE {s.sql_magnification('image_id')} END END AS magnification,
CASE vec_id % 2 WHEN 0 THEN 'by hand' ELSE '' END AS condition FROM vec"""
)
def incremental_catalogue(spark, sf_dir):
    """Files arriving in two lots are merged into a table that was started by hand."""
    raw, table, mark = (scratch_path(spark, n) for n in ("raw", "catalogue", "progress"))
    pictures = s.vector_images(spark, sf_dir)
    number = F.regexp_extract("image_id", r"vec_(\d+)", 1).cast("int")
    by_hand = pictures.filter(number % 2 == 0).select(
        F.concat("image_id", F.lit(".png")).alias("image"), F.lit("10x").alias("magnification"), F.lit("by hand").alias("condition")
    )
    metadata.write_metadata(by_hand, table)
    images.write_png(pictures.filter(number % 3 == 0), raw)
    stream.ingest_new_images(spark, raw, table, mark)
    images.write_png(pictures.filter(number % 3 != 0), raw)
    return stream.ingest_new_images(spark, raw, table, mark)
