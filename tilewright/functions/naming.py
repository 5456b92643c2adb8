"""File-name expressions: stem, magnification and condition clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two recognised magnifications and the extensions of supported images.
MAGNIFICATIONS = ("4x", "10x")
UNKNOWN = "unknown"
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]+$", "$1")


def extension(path: Column) -> Column:
    """Lower-case suffix without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def is_supported_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def magnification_or(path: Column, default: str) -> Column:
    """The magnification the stem ends with (case-sensitive), else ``default``."""
    name = stem(path)
    expr = F
    for value in MAGNIFICATIONS:
        expr = expr.when(name.endswith(f"_{value}"), value)
    return expr.otherwise(default)


def magnification(path: Column) -> Column:
    return magnification_or(path, UNKNOWN)


def condition_label(condition: Column) -> Column:
    """Trimmed condition; null and blank become ``unknown``."""
    return F.coalesce(F.nullif(strip(condition), F.lit("")), F.lit(UNKNOWN))


def strip(value: Column | str) -> Column:
    """``value`` without white space of any kind at its ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
