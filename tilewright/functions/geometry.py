"""Tile arithmetic as column expressions (integers throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: Column | int) -> Column:
    """Floor division of non-negative integers."""
    return F.floor(a / b).cast("int")


def stride_for(tile: Column, overlap: Column) -> Column:
    """Step between tiles for an overlap fraction: half-even rounding, at least 1."""
    return F.greatest(F.lit(1), F.rint(tile * (F.lit(1.0).cast("double") - overlap)).cast("int"))


def grid_count(size: Column, tile: int, stride: int) -> Column:
    """Number of overlapping tiles along one axis."""
    return F.when(size <= tile, F.lit(1)).otherwise(
        F.ceil((size - tile) / F.lit(stride)).cast("int") + 1
    )


def multiple_padding(size: Column, tile: int) -> Column:
    """Padding up to a multiple of the tile."""
    return F.pmod(-size, F.lit(tile)).cast("int")


def minimum_padding(size: Column, patch: int) -> Column:
    """Padding up to one patch."""
    return F.greatest(F.lit(patch) - size, F.lit(0)).cast("int")


def pad_before(total: Column) -> Column:
    """The smaller half goes before."""
    return _div(total, 2)


def reflect_index(position: Column, before: Column, size: Column) -> Column:
    """Source index of a padded position, mirrored without repeating the edge."""
    period = F.lit(2) * (size - 1)
    folded = F.pmod(position - before, F.greatest(period, F.lit(1)))
    return (
        F.when(size == 1, F.lit(0))
        .when(folded < size, folded)
        .otherwise(period - folded)
        .cast("int")
    )


def first_covering_tile(position: Column, tile: int, stride: int) -> Column:
    """Lowest grid index whose tile contains a padded position."""
    return F.greatest(
        F.lit(0), F.ceil((position - (tile - 1)) / F.lit(stride)).cast("int")
    )


def last_covering_tile(position: Column, count: Column, stride: int) -> Column:
    """Highest grid index whose tile contains a padded position."""
    return F.least(count - 1, _div(position, stride))
