"""Metadata tables as text files: strict and lenient readers, versioned writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import naming
from tilewright.session import child_names, path_exists


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value``; lines count from 1 and blank ones count too.

    A file may be read in several pieces. Lines are numbered inside their piece, and the lines of
    the pieces before it are added; only one row per piece is brought together.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_piece"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    pieces = lines.groupBy("file", "_piece").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy("file").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.join(pieces, ["file", "_piece"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value"
    )


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).head()
    return [h.strip() for h in first["value"].split(",")] if first else []


def _name_column(header: list[str]) -> int:
    if "magnification" in header:
        for name in ("image", "image_name"):
            if name in header:
                return header.index(name)
    raise ValueError(
        f"metadata needs the columns 'image' (or 'image_name') and 'magnification', got {header}"
    )


def read_metadata_strict(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Clean rows and errors of a metadata file, or of a folder of files with a header each.

    Clean: ``image_id, image, magnification, condition`` with the last row per stem. Errors:
    ``file, line_no, error``. Values are split at every comma; there is no quoting.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no metadata file at {path}")
    header = _header(spark, path)
    name_at, magnification_at = _name_column(header), header.index("magnification")
    condition_at = header.index("condition") if "condition" in header else None
    needed = max(name_at, magnification_at, condition_at or 0, 1)

    numbered = numbered_lines(spark, path)
    own = F.transform(F.split("value", ","), naming.strip)
    other = numbered.filter((F.col("line_no") == 1) & (own != F.array(*map(F.lit, header)))).select("file", "value").head()
    if other:
        raise ValueError(f"{other['file']} has the header {other['value']!r}, another file has {header}")
    lines = numbered.filter((F.col("line_no") > 1) & (naming.strip("value") != ""))
    parts = F.split(naming.strip("value"), ",")
    rows = lines.select("file", "line_no", "value", parts.alias("_parts"))
    whole = F.size("_parts") > needed
    cell = lambda at: naming.strip(F.get("_parts", F.lit(at)))
    parsed = rows.select(
        "file",
        "line_no",
        F.when(whole, cell(name_at)).alias("image"),
        F.when(whole, cell(magnification_at)).alias("magnification"),
        (F.when(whole, cell(condition_at)) if condition_at is not None else F.lit(None).cast("string"))
        .alias("condition"),
        F.when(~whole, F.concat(F.lit("malformed row: "), naming.strip("value"))).alias("_short"),
    )
    bad_value = ~F.col("magnification").isin(*naming.MAGNIFICATIONS)
    checked = parsed.withColumn(
        "error",
        F.coalesce(
            F.col("_short"),
            F.when(F.col("image") == "", F.lit("empty image name")),
            F.when(
                bad_value,
                F.concat(
                    F.lit("invalid magnification '"),
                    F.col("magnification"),
                    F.lit("' for image '"),
                    F.col("image"),
                    F.lit("'"),
                ),
            ),
        ),
    )
    errors = checked.filter("error is not null").select("file", "line_no", "error")
    latest = F.max_by(
        F.struct("image", "magnification", "condition"), F.struct("file", "line_no")
    ).alias("_row")
    clean = (
        checked.filter("error is null")
        .groupBy(naming.stem(F.col("image")).alias("image_id"))
        .agg(latest)
        .select("image_id", "_row.image", "_row.magnification", "_row.condition")
    )
    return clean, errors


def raise_on_errors(errors: DataFrame) -> None:
    """Stop at the first bad line, with the number of bad lines."""
    found = errors.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("line_no", "error")).alias("first"),
    ).head()
    if found["n"]:
        first = found["first"]
        raise ValueError(f"{found['n']} bad row(s); row {first['line_no']}: {first['error']}")


def read_metadata_lenient(spark: SparkSession, path: str) -> DataFrame:
    """All named rows with trimmed values; any magnification is kept, so hand edits survive."""
    table = spark.read.csv(path, header=True, inferSchema=False)
    columns = {
        name: naming.strip(F.coalesce(F.col(name), F.lit(""))) if name in table.columns else F.lit("")
        for name in ("image", "magnification", "condition")
    }
    return table.select(*[c.alias(n) for n, c in columns.items()]).filter("image <> ''")


VERSION = "version="


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions of a table folder, oldest first."""
    names = [n for n in child_names(spark, folder) if n.startswith(VERSION)]
    return sorted(
        int(n[len(VERSION) :]) for n in names if path_exists(spark, f"{folder}/{n}/_SUCCESS")
    )


def latest_version(spark: SparkSession, folder: str) -> str | None:
    found = versions(spark, folder)
    return f"{folder}/{VERSION}{found[-1]}" if found else None


def write_metadata(
    rows: DataFrame, folder: str, *, mode: str = "refuse", version: int | None = None
) -> str:
    """Write ``image, magnification, condition`` sorted by image, as the next version.

    ``refuse`` stops when a version exists; ``force`` and ``update`` add one. Readers take the
    latest complete version, so a table can be rewritten from itself.
    """
    if mode not in ("refuse", "force", "update"):
        raise ValueError(f"mode must be refuse, force or update, got {mode!r}")
    spark = rows.sparkSession
    found = versions(spark, folder)
    if found and mode == "refuse":
        raise FileExistsError(f"metadata already exists in {folder}")
    number = version if version is not None else (found[-1] + 1 if found else 0)
    target = f"{folder}/{VERSION}{number}"
    (
        rows.select("image", "magnification", "condition")
        .orderBy("image")
        .write.mode("overwrite")
        .csv(target, header=True, emptyValue="")
    )
    return target
