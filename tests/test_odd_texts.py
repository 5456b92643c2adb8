"""Queries over document pictures where some texts are empty or null, against their SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from test_registry import plain

from tilewright.operators import scoring, tiles
from tilewright.plans.registry import ORACLES, QUERIES
from tilewright.plans.registry_pixels import positional_labels, positional_logits

TEXTS = ["", "one short line", None, "two é\n" * 40, "", "x" * 64, None, "a longer text of several tiles. " * 70, ""]
NAMES = [
    "block_confusion",
    "mask_class_counts",
    "block_percentiles",
    "stripe_objects",
    "mixed_objects",
    "evaluate_pairs",
    "evaluate_tiles",
    "overlapping_tiles",
    "reflect_tiles",
    "stitch_blocks",
    "tile_coverage",
    "stitch_in_place",
    "tile_roundtrip",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_with_empty_and_null_texts(spark, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        cursor = con.execute(ORACLES[name])
        places = [[c[0] for c in cursor.description].index(c) for c in columns]
        expected = sorted(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())
    assert expected and sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == expected


@pytest.mark.parametrize("shape", [(0, 64), (5, 0), (0, 0)])
def test_a_picture_without_pixels_has_no_tiles(image_rows, shape):
    rows = image_rows({"none": np.zeros(shape, np.uint8), "one": np.ones((5, 7), np.uint8)})
    stitched = (scoring.predict_stitched(rows, positional_logits, tile=4, overlap=0.25, by_tile=by) for by in (False, True))
    labelled = (scoring.predict_labels(rows, positional_labels, tile=4, by_tile=by) for by in (False, True))
    for cut in (tiles.cut_tiles(rows, 4), tiles.cut_overlapping(rows, 4, 3), tiles.cut_blocks(rows, 4), *stitched, *labelled):
        assert {r["image_id"] for r in cut.select("image_id").collect()} == {"one"}
    assert tiles.incomplete_images(tiles.cut_blocks(rows, 4), rows).count() == 0
