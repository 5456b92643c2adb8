"""Chosen files are opened by tasks; the driver holds no list of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameReader
from test_files import save, save_tiff

from tilewright.plans.loading import load_split
from tilewright.sources import images

RNG = np.random.default_rng(5)
NAMES = ("plain_4x.png", "a b+%41[1]{x}_4x.png", "é_10x.PNG")


def write(folder, names=NAMES):
    arrays = {name: RNG.integers(0, 256, (6, 9), dtype=np.uint8) for name in names}
    for name, array in arrays.items():
        save(folder / name, array)
    return arrays


def rows(df):
    return sorted((r["path"], r["image_id"], r["height"], r["width"], r["channels"], r["dtype"], r["data"] and bytes(r["data"])) for r in df.collect())


@pytest.mark.parametrize("odd", [False, True])
def test_chosen_files_decode_as_in_their_folders(spark, tmp_path, odd):
    """Plain PNGs alone, and together with files that only the image source reads, or none can."""
    for folder in ("one", "two"):
        write(tmp_path / folder)
        (tmp_path / folder / "unlisted.png").write_bytes(b"no image")
        if odd:
            save_tiff(spark, tmp_path / folder / f"t {folder}%_4x.tif", RNG.integers(0, 256, (4, 7), dtype=np.uint8))
            (tmp_path / folder / "broken.png").write_bytes(b"no image")
    folders = [str(tmp_path / f) for f in ("one", "two")]
    chosen = images.scan_images(spark, folders).filter("image_id <> 'unlisted'")
    expected = rows(images.decode_images(spark, folders).filter("image_id <> 'unlisted'"))
    assert len(expected) == (10 if odd else 6) and rows(images.decode_chosen(spark, chosen)) == expected


def test_no_chosen_files(spark, tmp_path):
    write(tmp_path / "one")
    assert images.decode_chosen(spark, images.scan_images(spark, str(tmp_path / "one")).filter("false")).count() == 0


def test_the_driver_gets_no_list_of_paths(spark, tmp_path, monkeypatch):
    arrays = write(tmp_path / "raw")
    for name in arrays:
        save(tmp_path / "masks" / name, np.zeros((6, 9), np.uint8))
    for name, text in (("train", "".join(n.rpartition(".")[0] + "\n" for n in NAMES)), ("val", ""), ("test", "")):
        (tmp_path / "lists").mkdir(exist_ok=True)
        (tmp_path / "lists" / f"{name}.txt").write_text(text)
    load = DataFrameReader.load

    def folders_only(self, path=None, *args, **options):
        assert isinstance(path, str)
        return load(self, path, *args, **options)

    def never(*_):
        raise AssertionError("rows were brought to the driver")

    monkeypatch.setattr(DataFrameReader, "load", folders_only)
    monkeypatch.setattr(DataFrame, "toLocalIterator", never)
    pictures, masks = load_split(spark, *(str(tmp_path / f) for f in ("raw", "masks", "lists")), "train", normalise=False)
    assert {r["image_id"]: bytes(r["data"]) for r in pictures.collect()} == {n.rpartition(".")[0]: a.tobytes() for n, a in arrays.items()}
    assert masks.count() == len(arrays)


def test_a_chosen_file_that_is_gone_is_an_error(spark, tmp_path):
    write(tmp_path / "one")
    chosen = spark.createDataFrame([(f"file:{tmp_path}/one/gone.png",)], "path string")
    with pytest.raises(Exception, match="gone.png"):
        images.decode_chosen(spark, chosen)


def test_a_listing_is_not_kept(spark, tmp_path):
    """Names are stored, so that no later step refers to the listing on the driver."""
    arrays = write(tmp_path / "raw")
    (tmp_path / "raw" / "notes.txt").write_text("no image")
    stored = images.stored_scan(spark, str(tmp_path / "raw"))
    assert "binaryFile" not in stored._jdf.queryExecution().toString()
    assert sorted(stored.collect()) == sorted(images.scan_images(spark, str(tmp_path / "raw")).select("image_id", "path").collect())
    assert stored.count() == len(arrays)
