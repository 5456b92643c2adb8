"""Catalogue tables: pairing, consistency checks, metadata rows and merges.

Inputs are key tables (names, paths), never pixels. Duplicates are reduced by partial
aggregation before rows are shuffled, so a stem that fills a third of a table is harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import naming
from tilewright.operators.skew import salted_join


def one_file_per_stem(files: DataFrame) -> DataFrame:
    """The last path in sort order per stem, and how many files shared it."""
    return files.groupBy("image_id").agg(
        F.max("path").alias("path"), F.count(F.lit(1)).alias("n_files")
    )


def pair_files(raw: DataFrame, masks: DataFrame) -> DataFrame:
    """One row per mask file with a raw file of the same stem.

    ``raw`` and ``masks`` have ``image_id, path``. Mask duplicates stay; ``duplicate_stem`` says
    that a side held more than one file.
    """
    lookup = one_file_per_stem(raw).select(
        "image_id", F.col("path").alias("raw_path"), F.col("n_files").alias("n_raw")
    )
    mask_counts = masks.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_mask"))
    sides = lookup.join(mask_counts, "image_id")
    return salted_join(
        masks.select("image_id", F.col("path").alias("mask_path")), sides, "image_id"
    ).select(
        "image_id",
        "raw_path",
        "mask_path",
        ((F.col("n_raw") > 1) | (F.col("n_mask") > 1)).alias("duplicate_stem"),
    )


def has_pairs(raw: DataFrame, masks: DataFrame) -> bool:
    """Whether any stem is on both sides."""
    keys = raw.select("image_id").distinct()
    return not masks.select("image_id").distinct().join(keys, "image_id", "left_semi").isEmpty()


def presence(raw: DataFrame, masks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per stem: is it among the raw files, the masks, the metadata rows?"""
    flags = ("in_raw", "in_mask", "in_metadata")

    def side(df: DataFrame, flag: str) -> DataFrame:
        return df.select("image_id", *[F.lit(name == flag).alias(name) for name in flags])

    everything = (
        side(raw, "in_raw")
        .unionByName(side(masks, "in_mask"))
        .unionByName(side(metadata, "in_metadata"))
    )
    return everything.groupBy("image_id").agg(*[F.bool_or(f).alias(f) for f in flags])


ISSUES = ("metadata_without_files", "raw_without_mask", "mask_without_raw")


def consistency_issues(raw: DataFrame, masks: DataFrame, metadata: DataFrame) -> DataFrame:
    """All mismatches at once: ``issue, image_id, in_raw, in_mask``.

    Issues are ``metadata_without_files``, ``raw_without_mask`` and ``mask_without_raw``; one stem
    can show up under two of them.
    """
    found = F.array_compact(
        F.array(
            F.when(
                F.col("in_metadata") & ~(F.col("in_raw") & F.col("in_mask")),
                F.lit("metadata_without_files"),
            ),
            F.when(F.col("in_raw") & ~F.col("in_mask"), F.lit("raw_without_mask")),
            F.when(F.col("in_mask") & ~F.col("in_raw"), F.lit("mask_without_raw")),
        )
    )
    return presence(raw, masks, metadata).select(
        F.explode(found).alias("issue"), "image_id", "in_raw", "in_mask"
    )


def raise_on_issues(issues: DataFrame, shown: int = 1000) -> None:
    """Stop with a message that counts the issues of each kind and names their stems, in order.

    The message is for a person, so it names at most ``shown`` of a kind; ``issues`` has all.
    """
    lines = []
    for kind in ISSUES:
        found = issues.filter(F.col("issue") == kind)
        names = found.orderBy("image_id").select("image_id", "in_raw", "in_mask").take(shown)
        if names:
            each = [f"{r['image_id']} (raw {r['in_raw']}, mask {r['in_mask']})" if kind == ISSUES[0] else r["image_id"] for r in names]
            lines.append(f"{kind}: {found.count()}: {', '.join(each)}")
    if lines:
        raise ValueError("raw files, masks and metadata do not agree\n" + "\n".join(lines))


def split_members(pairs: DataFrame, split: DataFrame) -> DataFrame:
    """Pairs whose stem is in the split."""
    return pairs.join(split.select("image_id").distinct(), "image_id", "left_semi")


def missing_members(split: DataFrame, raw: DataFrame, masks: DataFrame) -> DataFrame:
    """Stems of the split that lack a raw file or a mask, with what is missing."""
    names = split.select("image_id").distinct()
    have_raw = raw.select("image_id").distinct().withColumn("has_raw", F.lit(True))
    have_mask = masks.select("image_id").distinct().withColumn("has_mask", F.lit(True))
    joined = names.join(have_raw, "image_id", "left").join(have_mask, "image_id", "left")
    return joined.filter(F.col("has_raw").isNull() | F.col("has_mask").isNull()).select(
        "image_id",
        F.col("has_raw").isNull().alias("missing_raw"),
        F.col("has_mask").isNull().alias("missing_mask"),
    )


def resolve_magnification(names: DataFrame, table: DataFrame | None, name: str = "name") -> DataFrame:
    """Add ``magnification``: the metadata table wins over the file name, else ``unknown``.

    ``table`` is unique per ``image_id``.
    """
    parsed = naming.magnification(F.col(name))
    if table is None:
        return names.withColumn("magnification", parsed)
    lookup = table.select("image_id", F.col("magnification").alias("_listed"))
    keyed = names.withColumn("image_id", naming.stem(F.col(name)))
    return (
        salted_join(keyed, lookup, "image_id", "left")
        .withColumn("magnification", F.coalesce("_listed", parsed))
        .drop("_listed", "image_id")
        .select(*names.columns, "magnification")
    )


def metadata_rows(files: DataFrame, name: str = "name") -> DataFrame:
    """A metadata row per file: magnification from the name or empty, condition empty."""
    return files.select(
        F.col(name).alias("image"),
        naming.magnification_or(F.col(name), "").alias("magnification"),
        F.lit("").alias("condition"),
    )


def unrecognised(rows: DataFrame) -> DataFrame:
    """Rows that need a magnification by hand."""
    return rows.filter(F.col("magnification") == "")


def merge_metadata(existing: DataFrame, new: DataFrame, recency: Column | None = None) -> DataFrame:
    """Existing rows win, unseen images are added; ``added`` tells them apart.

    Repeated images among the existing rows: the one with the largest ``recency`` wins.
    """
    old = existing.select(
        "image", "magnification", "condition",
        F.lit(1).alias("_side"),
        (recency if recency is not None else F.lit(0)).cast("bigint").alias("_age"),
    )
    fresh = new.select(
        "image", "magnification", "condition", F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_age")
    )
    best = F.max_by(F.struct("magnification", "condition"), F.struct("_side", "_age"))
    return (
        old.unionByName(fresh)
        .groupBy("image")
        .agg(best.alias("_row"), F.max("_side").alias("_side"))
        .select(
            "image",
            F.col("_row.magnification").alias("magnification"),
            F.col("_row.condition").alias("condition"),
            (F.col("_side") == 0).alias("added"),
        )
    )


def stale_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Images of the existing table that are no longer there."""
    return (
        existing.select("image").distinct().join(new.select("image").distinct(), "image", "left_anti")
    )


def magnification_counts(rows: DataFrame) -> DataFrame:
    label = F.coalesce(F.nullif(naming.strip("magnification"), F.lit("")), F.lit("unspecified"))
    return rows.groupBy(label.alias("magnification")).agg(F.count(F.lit(1)).alias("n"))


def run_summary(merged: DataFrame) -> DataFrame:
    """Rows written and rows added of a merge, with the images to fix by hand."""
    return merged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("added").alias("added"),
        F.count_if(F.col("added") & (F.col("magnification") == "")).alias("need_magnification"),
    )
