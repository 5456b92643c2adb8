"""Image-shaped views of the driver's tables, in Spark and in the SQL used to check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import draws

DOC_WIDTH = 64
VECTOR_SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suffix(key: Column) -> Column:
    """Magnification suffix by key: a third each of 4x, 10x and none."""
    return F.when(key % 3 == 0, "_4x").when(key % 3 == 1, "_10x").otherwise("")


def sql_suffix(key: str) -> str:
    return f"CASE {key} % 3 WHEN 0 THEN '_4x' WHEN 1 THEN '_10x' ELSE '' END"


def sql_magnification(name: str) -> str:
    """Magnification of a name without extension."""
    return (
        f"CASE WHEN suffix({name}, '_4x') THEN '4x' WHEN suffix({name}, '_10x') THEN '10x' "
        "ELSE 'unknown' END"
    )


def sql_draw(key: str, word: int = 0) -> str:
    """32-bit word of a digest, as in ``draws.draw_integer``."""
    return f"CAST('0x' || substr({key}, {1 + 8 * word}, 8) AS BIGINT)"


def sql_uniform(key: str, word: int = 0) -> str:
    return f"(CAST({sql_draw(key, word)} AS DOUBLE) / 4294967296e0)"


def spread(rows: DataFrame) -> DataFrame:
    """Deal out a scan that has fewer splits than there are cores; larger scans stay as read.

    Array work takes far longer per byte than reading, and one small file is one split.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


# --- pixels out of lineitem: one row is one pixel of the image of its supplier ---------------


def lineitem_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_key, gt, pred``."""
    rows = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    return rows.select(
        F.col("l_suppkey").alias("image_key"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("gt"),
        (F.floor("l_quantity").cast("int") % 3).alias("pred"),
    )


def name_images(df: DataFrame) -> DataFrame:
    """Replace ``image_key`` by ``image_id`` and ``magnification``, after aggregation."""
    key = F.col("image_key")
    return df.select(
        F.concat(F.lit("img_"), key.cast("string"), suffix(key), F.lit(".png")).alias("image_id"),
        F.when(key % 3 == 0, "4x").when(key % 3 == 1, "10x").otherwise("unknown").alias("magnification"),
        *[c for c in df.columns if c != "image_key"],
    )


SQL_LINEITEM_PIXELS = f"""
px AS (
  SELECT 'img_' || l_suppkey || {sql_suffix('l_suppkey')} || '.png' AS image_id,
         CASE l_suppkey % 3 WHEN 0 THEN '4x' WHEN 1 THEN '10x' ELSE 'unknown' END AS magnification,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS gt,
         CAST(floor(l_quantity) AS INT) % 3 AS pred
  FROM lineitem)"""


# --- pictures out of documents: the bytes of a text, 64 to a row, blank-padded ----------------


def document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rows of whole texts: ``doc_<id>_4x`` and so on, as tall as the text is long.

    An empty text is a picture without pixels; a null text is no picture.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null")).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), suffix(F.col("doc_id"))).alias("image_id"),
        F.encode("text", "UTF-8").alias("_bytes"),
    )
    height = F.ceil(F.length("_bytes") / F.lit(DOC_WIDTH)).cast("int")
    return docs.select(
        "image_id",
        height.alias("height"),
        F.lit(DOC_WIDTH).alias("width"),
        F.lit(1).alias("channels"),
        F.lit("uint8").alias("dtype"),
        F.rpad("_bytes", height * DOC_WIDTH, b"\x20").alias("data"),
    )


SQL_DOC_PIXELS = f"""
doc_bytes AS (
  SELECT 'doc_' || doc_id || {sql_suffix('doc_id')} AS image_id,
         CAST(ceil(octet_length(encode(text)) / 64e0) AS INT) AS h,
         hex(encode(text)) AS hx
  FROM documents),
doc_lists AS (SELECT image_id, h, regexp_extract_all(rpad(hx, h * 128, '20'), '..') AS l FROM doc_bytes),
doc_px AS (
  SELECT image_id, h, CAST(i // 64 AS INT) AS y, CAST(i % 64 AS INT) AS x, CAST('0x' || b AS INT) AS v
  FROM (SELECT image_id, h, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS i FROM doc_lists))"""


# --- pictures out of embeddings: 64 numbers as 8 x 8 gray values ------------------------------


def gray_value(number: Column) -> Column:
    """An embedding number as a gray value 0..255."""
    scaled = (number.cast("double") + F.lit(0.32)) / F.lit(0.64)
    return F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) * F.lit(255.0)).cast("int")


SQL_GRAY = (
    "CAST(floor(least(greatest((CAST({0} AS DOUBLE) + 32e-2) / 64e-2, 0e0), 1e0) * 255e0) AS INT)"
)


def vector_name() -> Column:
    return F.concat(F.lit("vec_"), F.col("vec_id").cast("string"), suffix(F.col("vec_id")))


SQL_VECTOR_NAME = f"'vec_' || vec_id || {sql_suffix('vec_id')}"


def vector_grays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, image_id, label, grays``: one row per picture, 64 gray values in an array."""
    return spread(table(spark, sf_dir, "embeddings")).select(
        "vec_id", vector_name().alias("image_id"), "label", F.transform("embedding", gray_value).alias("grays")
    )


def vector_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, label, y, x, v``."""
    return (
        vector_grays(spark, sf_dir)
        .select("image_id", "label", F.posexplode("grays").alias("i", "v"))
        .select(
            "image_id",
            "label",
            F.floor(F.col("i") / F.lit(VECTOR_SIDE)).cast("int").alias("y"),
            (F.col("i") % VECTOR_SIDE).alias("x"),
            "v",
        )
    )


def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pictures as image rows; the bytes are put together from their hex digits."""
    digits = F.transform("grays", lambda v: F.lpad(F.hex(v), 2, "0"))
    return vector_grays(spark, sf_dir).select(
        "image_id",
        F.lit(VECTOR_SIDE).alias("height"),
        F.lit(VECTOR_SIDE).alias("width"),
        F.lit(1).alias("channels"),
        F.lit("uint8").alias("dtype"),
        F.unhex(F.array_join(digits, "")).alias("data"),
    )


SQL_VECTOR_PIXELS = f"""
vec_px AS (
  SELECT image_id, label, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, {SQL_GRAY.format('e')} AS v
  FROM (SELECT {SQL_VECTOR_NAME} AS image_id, label, unnest(embedding) AS e,
               generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


def vector_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 numbers as 16 pixels of 4 logits: ``vec_id, image_id, p, l0..l3, target``."""
    numbers = table(spark, sf_dir, "embeddings").select(
        "vec_id", vector_name().alias("image_id"), "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p")
    )
    return numbers.select(
        "vec_id",
        "image_id",
        "p",
        *[F.col("embedding")[F.col("p") * 4 + c].cast("double").alias(f"l{c}") for c in range(4)],
        ((F.col("label") + F.col("p")) % 4).cast("int").alias("target"),
    )


SQL_VECTOR_LOGITS = f"""
logit AS (
  SELECT vec_id, image_id, p,
         CAST(embedding[p * 4 + 1] AS DOUBLE) AS l0, CAST(embedding[p * 4 + 2] AS DOUBLE) AS l1,
         CAST(embedding[p * 4 + 3] AS DOUBLE) AS l2, CAST(embedding[p * 4 + 4] AS DOUBLE) AS l3,
         CAST((label + p) % 4 AS INT) AS target
  FROM (SELECT vec_id, {SQL_VECTOR_NAME} AS image_id, label, embedding,
               CAST(unnest(range(16)) AS INT) AS p FROM embeddings))"""


def rounded(value: Column) -> Column:
    """Six decimals, written so that both engines do the same arithmetic."""
    return F.floor(value * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def sql_rounded(value: str) -> str:
    return f"floor(({value}) * 1e6 + 5e-1) / 1e6"


def sql_key(seed: int | str, *parts: str) -> str:
    """SQL twin of ``draws.draw_key``."""
    return "md5(" + " || ':' || ".join([f"'{seed}'", *parts]) + ")"


__all__ = ["draws", "table"]
