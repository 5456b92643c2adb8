from __future__ import annotations

import io
import os
import time

import numpy as np
import pytest

from tilewright.operators import annotation, confusion, splits
from tilewright.plans import evaluation, inference, onboarding, training_data
from tilewright.sources import images, metadata, reports, runs, split_lists, synthetic
from tilewright.streaming import catalogue as stream


def save(path, array):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(images.encode_png(array))


def save_tiff(spark, path, array, compression=None):
    """A gray TIFF through the JVM's own writer."""
    jvm = spark.sparkContext._jvm
    path.parent.mkdir(parents=True, exist_ok=True)
    h, w = array.shape
    kind = {"uint8": 10, "uint16": 11}[array.dtype.name]
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    raster = image.getRaster()
    for y in range(h):
        for x in range(w):
            raster.setSample(x, y, 0, int(array[y, x]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    param = writer.getDefaultWriteParam()
    if compression:
        param.setCompressionMode(2)  # explicit
        param.setCompressionType(compression)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    out.close()
    writer.dispose()


def float_tiff(array):
    """A minimal uncompressed float32 TIFF."""
    import struct

    h, w = array.shape
    body = array.astype("<f4").tobytes()
    tags = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(body)), (339, 3, 3)]
    out = io.BytesIO()
    out.write(b"II*\x00" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)))
    for tag, kind, value in tags:
        out.write(struct.pack("<HHII", tag, kind, 1, value))
    out.write(struct.pack("<I", 0))
    return out.getvalue()


RNG = np.random.default_rng(11)


def test_decode_formats_and_odd_names(spark, arrays, tmp_path):
    gray = RNG.integers(0, 256, (12, 9), dtype=np.uint8)
    colour = RNG.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    save(tmp_path / "117 - 9d+b 3T3_10x.png", gray)
    save(tmp_path / "colour%20.PNG", colour)
    save_tiff(spark, tmp_path / "plain.tif", gray)
    save_tiff(spark, tmp_path / "packed.TIFF", gray, "LZW")
    (tmp_path / "notes.txt").write_text("no image")
    (tmp_path / "broken.png").write_bytes(b"\x89PNG not really")
    decoded = images.decode_images(spark, str(tmp_path))
    got = arrays(decoded.filter("data is not null"))
    assert set(got) == {"117 - 9d+b 3T3_10x", "colour%20", "plain", "packed"}
    for name in ("117 - 9d+b 3T3_10x", "plain", "packed"):
        assert (got[name] == gray).all()
    assert (got["colour%20"] == colour).all()
    assert [r["image_id"] for r in decoded.filter("data is null").collect()] == ["broken"]
    listed = {r["path"] for r in images.scan_images(spark, str(tmp_path)).collect()}
    assert {r["path"] for r in decoded.collect()} == listed
    assert [r["name"] for r in images.skipped_files(spark, str(tmp_path)).collect()] == ["notes.txt"]


def test_headers(spark, tmp_path):
    save(tmp_path / "a.png", RNG.integers(0, 256, (4, 6), dtype=np.uint8))
    save_tiff(spark, tmp_path / "deep.tif", RNG.integers(0, 65536, (4, 6)).astype(np.uint16))
    (tmp_path / "f.tiff").write_bytes(float_tiff(np.ones((3, 5))))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    got = {r["image_id"]: (r["height"], r["width"], r["channels"], r["dtype"]) for r in images.scan_headers(spark, str(tmp_path)).collect()}
    assert got == {"a": (4, 6, 1, "uint8"), "deep": (4, 6, 1, "uint16"), "f": (3, 5, 1, "float32"), "bad": (None,) * 4}


def test_empty_folder_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        images.require_images(images.scan_images(spark, str(tmp_path)))


def test_quality_report(spark, tmp_path):
    raw, masks = tmp_path / "raw", tmp_path / "masks"
    stripes = np.repeat(np.arange(4, dtype=np.uint8), 4)[:, np.newaxis].repeat(8, 1)
    for name in ("good", "shape", "value", "lzw", "kind", "colour", "broken"):
        save(raw / f"{name}.png", RNG.integers(0, 256, (16, 8), dtype=np.uint8))
    save(raw / "alone.png", stripes)
    save(masks / "good.png", stripes)
    save(masks / "shape.png", stripes[:, :4].copy())
    bad = stripes.copy()
    bad[0, 0] = 4
    save(masks / "value.png", bad)
    bad[0, 1] = 5
    save_tiff(spark, masks / "lzw.tif", bad, "LZW")
    (masks / "kind.tiff").write_bytes(float_tiff(stripes))
    save(masks / "colour.png", np.zeros((16, 8, 3), np.uint8))
    (masks / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    report = onboarding.quality_report(spark, str(raw), str(masks))
    rows = {r["image_id"]: r for r in report.collect()}
    assert set(rows) == {"good", "shape", "value", "lzw", "kind", "colour", "broken"}
    assert rows["good"]["violations"] == [] and rows["good"]["total_pixels"] == 128
    assert [rows["good"][f"class_{c}"] for c in range(4)] == [32] * 4
    assert rows["shape"]["violations"] == ["shape mismatch: raw (16, 8) vs mask (16, 4)"]
    assert rows["value"]["violations"] == ["invalid mask values [4]"] and rows["value"]["total_pixels"] == 127
    assert rows["lzw"]["violations"] == ["invalid mask values [4, 5]"]
    assert rows["kind"]["violations"] == ["mask dtype float32 != uint8"]
    assert rows["colour"]["violations"][0].startswith("mask read error") and rows["colour"]["total_pixels"] == 0
    assert rows["broken"]["violations"][0].startswith("mask read error")
    result = annotation.verdict(report).head()
    assert (result["n_pairs"], result["n_failed"], result["passed"]) == (7, 6, False)
    reports.write_qc_report(report, str(tmp_path / "qc"))
    text = spark.read.csv(str(tmp_path / "qc"), header=True)
    assert text.columns == ["image", "total_pixels", "class_0", "class_1", "class_2", "class_3", "violations"]


def test_quality_report_without_pairs(spark, tmp_path):
    for side in ("raw", "masks"):
        (tmp_path / side).mkdir()
    report = onboarding.quality_report(spark, str(tmp_path / "raw"), str(tmp_path / "masks"))
    assert annotation.verdict(report).head()["passed"]


def blob_folders(spark, tmp_path, n=4):
    pairs = synthetic.paint_pairs(synthetic.draw_circles(synthetic.synthetic_names(spark, n), height=96, width=96, seed=5, scale=0.18))
    raw, masks = str(tmp_path / "raw"), str(tmp_path / "masks")
    images.write_png(pairs, raw)
    images.write_png(synthetic.masks_of(pairs), masks)
    return raw, masks


def test_onboarding_and_evaluation(spark, tmp_path):
    raw, masks = blob_folders(spark, tmp_path, 14)
    table, lists = str(tmp_path / "table"), str(tmp_path / "lists")
    assert onboarding.update_metadata(spark, raw, table).count() == 0
    summary = onboarding.make_splits(spark, raw, masks, metadata.latest_version(spark, table), lists)
    sizes = {r["split"]: r["n"] for r in summary.filter("magnification is null and condition is null").collect()}
    assert sizes == {"train": 10, "val": 2, "test": 2}
    per_image = evaluation.evaluate_split(spark, raw, masks, lists, "test", synthetic.threshold_labels, tile=40, normalise=False)
    flat = confusion.report(per_image).collect()
    assert {r["grain"] for r in flat} == {"overall", "magnification", "image"}
    assert all(r["dice"] == 1.0 and r["iou"] == 1.0 for r in flat)
    out = str(tmp_path / "out")
    reports.write_evaluation(per_image, out)
    assert spark.read.csv(f"{out}/metrics_csv", header=True).columns == ["group", "class", "dice", "iou", "n_images", "n_out_of_range"]
    matrix = spark.read.csv(f"{out}/confusion_matrix", header=True, inferSchema=True).collect()
    assert [r["truth"] for r in matrix] == ["background", "loose cell", "aggregate"]
    assert sum(sum(r[1:]) for r in matrix) == 2 * 96 * 96
    assert spark.read.json(f"{out}/metrics_json").count() == 1 + 2 + 2
    os.remove(os.path.join(raw, sorted(os.listdir(raw))[0]))
    for split in ("train", "val", "test"):
        try:
            evaluation.evaluate_split(spark, raw, masks, lists, split, synthetic.threshold_labels, tile=40)
        except FileNotFoundError as gap:
            assert "lack files" in str(gap)
            break
    else:
        raise AssertionError("the missing file went unnoticed")


def test_inconsistent_folders_stop_the_split(spark, tmp_path):
    raw, masks = blob_folders(spark, tmp_path, 4)
    table = str(tmp_path / "table")
    onboarding.update_metadata(spark, raw, table)
    os.remove(os.path.join(masks, "synth_000_4x.png"))
    with pytest.raises(ValueError, match="raw_without_mask: 1: synth_000_4x"):
        onboarding.make_splits(spark, raw, masks, metadata.latest_version(spark, table), str(tmp_path / "lists"))


def test_predict_folder(spark, arrays, tmp_path):
    raw, masks = blob_folders(spark, tmp_path, 2)
    store = str(tmp_path / "store")
    inference.predict_folder(spark, raw, synthetic.threshold_logits, tile=32, overlap=0.25, normalise=False, store=store, export=True)
    truth, found = arrays(images.decode_masks(spark, masks)), arrays(images.decode_masks(spark, f"{store}/predictions"))
    assert set(truth) == set(found)
    for name, mask in truth.items():
        assert (found[name] == mask).all()
    pictures, overlays = arrays(images.decode_images(spark, raw)), arrays(images.decode_images(spark, f"{store}/overlays"))
    name = "synth_000_4x"
    back = truth[name] == 0
    assert (overlays[name][back] == np.rint(pictures[name][back] / 2)[:, np.newaxis]).all()


def test_unreadable_image_stops_inference(spark, tmp_path):
    save(tmp_path / "a.png", np.zeros((4, 4), np.uint8))
    (tmp_path / "b.png").write_bytes(b"no picture")
    with pytest.raises(Exception, match="cannot decode"):
        inference.predict_folder(spark, str(tmp_path), synthetic.threshold_logits, tile=4).collect()


def test_training_table(spark, tmp_path):
    raw, masks = blob_folders(spark, tmp_path, 3)
    table = training_data.patch_table(images.decode_images(spark, raw), images.decode_masks(spark, masks), patch=32, per_image=5, seed=1)
    table.write.parquet(str(tmp_path / "patches"))
    stored = spark.read.parquet(str(tmp_path / "patches"))
    assert stored.count() == 15
    index = training_data.batch_index(stored, 4, seed=9)
    assert index.count() == 12 and index.select("batch_id").distinct().count() == 3


def test_synthetic_splits_and_evaluation(spark):
    assigned = synthetic.synthetic_splits(spark, 20, seed=7).collect()
    sizes = {}
    for r in assigned:
        sizes.setdefault(r["image_id"][-3:], []).append(r["split"])
    for names in sizes.values():
        assert [names.count(n) for n in splits.SPLIT_NAMES] == [7, 2, 1]
    per_image = evaluation.evaluate_synthetic(spark, "val", synthetic.threshold_labels, tile=128, n_images=8)
    flat = confusion.report(per_image).filter("grain = 'overall'").collect()
    assert {r["class"] for r in flat} >= {"background", "object"} and all(r["dice"] == 1.0 for r in flat)


def test_mixed_circles(spark):
    names = synthetic.synthetic_names(spark, 2)
    seen = set()
    for seed in range(20):
        drawn = synthetic.draw_mixed_circles(names, height=200, width=220, seed=seed)
        for r in synthetic.paint_pairs(drawn).collect():
            labels = set(bytes(r["mask"]))
            assert 0 in labels and labels <= {0, 1, 2, 3} and len(labels) > 1
            seen |= labels
    assert seen == {0, 1, 2, 3}


def test_artifacts(spark, tmp_path):
    for i, run in enumerate(("base_20240101_000000", "base_20240102_000000", "tiny_20240103_000000")):
        path = tmp_path / "runs" / run / runs.BEST_ARTIFACT
        path.parent.mkdir(parents=True)
        path.write_bytes(b"x")
        stamp = time.time() - (100 if i == 1 else 1000)
        os.utime(path, (stamp, stamp))
    folder = str(tmp_path / "runs")
    assert "base_20240102" in runs.resolve_artifact(spark, folder, "base")
    assert "tiny_20240103" in runs.resolve_artifact(spark, folder, "tiny")
    run_dir = f"{folder}/base_20240101_000000"
    assert runs.resolve_artifact(spark, folder, "base", run_dir=run_dir).startswith(run_dir)
    for missing in ({"config": "none"}, {"config": "base", "run_dir": folder}, {"config": "base", "artifact": "/no/such"}):
        with pytest.raises(FileNotFoundError):
            runs.resolve_artifact(spark, folder, **missing)


def test_incremental_catalogue(spark, tmp_path):
    raw, table, mark = tmp_path / "raw", str(tmp_path / "table"), str(tmp_path / "mark")
    raw.mkdir()
    by_hand = spark.createDataFrame([("first_4x.png", "4x", "ctrl")], "image string, magnification string, condition string")
    metadata.write_metadata(by_hand, table)
    for name in ("first_4x", "second_10x"):
        save(raw / f"{name}.png", np.zeros((2, 2), np.uint8))
    stream.ingest_new_images(spark, str(raw), table, mark)
    save(raw / "third.png", np.zeros((2, 2), np.uint8))
    (raw / "skip.txt").write_text("x")
    got = {r["image"]: (r["magnification"], r["condition"]) for r in stream.ingest_new_images(spark, str(raw), table, mark).collect()}
    assert got == {"first_4x.png": ("4x", "ctrl"), "second_10x.png": ("10x", ""), "third.png": ("", "")}
    again = {r["image"] for r in stream.ingest_new_images(spark, str(raw), table, mark).collect()}
    assert again == set(got)
    # A hand edit between two runs stays, also for a stream with a new checkpoint folder.
    edited = metadata.read_metadata_lenient(spark, metadata.latest_version(spark, table)).replace({"": "edited"}, subset=["condition"])
    metadata.write_metadata(edited, table, mode="update")
    before = metadata.versions(spark, table)
    for checkpoint in (mark, str(tmp_path / "other mark")):
        save(raw / f"{len(checkpoint)}_4x.png", np.zeros((2, 2), np.uint8))
        got = {r["image"]: r["condition"] for r in stream.ingest_new_images(spark, str(raw), table, checkpoint).collect()}
        assert got["second_10x.png"] == got["third.png"] == "edited" and f"{len(checkpoint)}_4x.png" in got
    assert set(before) < set(metadata.versions(spark, table))


def test_a_repeated_batch_keeps_later_edits(spark, tmp_path):
    table, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    (tmp_path / "mark").mkdir()
    (tmp_path / "mark" / "metadata").write_text('{"id": "q1"}')
    batch = spark.createDataFrame([("/r/a_4x.png", "a_4x.png")], "path string, name string")
    merge = stream._merge_batch(table, mark)
    merge(batch, 0)
    edit = spark.createDataFrame([("a_4x.png", "4x", "hand")], "image string, magnification string, condition string")
    metadata.write_metadata(edit, table, mode="update")
    merge(batch, 0)
    rows = metadata.read_metadata_lenient(spark, metadata.latest_version(spark, table)).collect()
    assert [tuple(r) for r in rows] == [("a_4x.png", "4x", "hand")]


def zero_labels(batch):
    return np.zeros(batch.shape[:3], np.uint8)


def test_unequal_sizes_are_an_error(spark, image_rows):
    picture, mask = image_rows({"a_4x": np.zeros((8, 16), np.uint8)}), image_rows({"a_4x": np.zeros((8, 8), np.uint8)})
    for left, right in ((picture, mask), (mask, picture)):
        with pytest.raises(Exception, match="block for a_4x|truth pixels"):
            evaluation.evaluate_images(left, right, zero_labels, tile=8).collect()


def test_labels_outside_the_classes(spark, image_rows, tmp_path):
    picture, mask = image_rows({"a_4x": np.zeros((8, 8), np.uint8)}), image_rows({"a_4x": np.full((8, 8), 3, np.uint8)})
    with pytest.raises(Exception, match="outside the classes"):
        evaluation.evaluate_images(picture, mask, zero_labels, tile=8).collect()
    wide = evaluation.evaluate_images(picture, mask, zero_labels, tile=8, allow_out_of_range=True)
    assert {r["n_out_of_range"] for r in confusion.report(wide).collect()} == {64}
    with pytest.raises(Exception, match="fit into a byte"):
        evaluation.evaluate_images(picture, mask, lambda b: np.full(b.shape[:3], 256), tile=8, allow_out_of_range=True).collect()


def test_the_predictor_runs_once_per_tile(spark, image_rows, tmp_path):
    picture, mask = image_rows({"a_4x": np.zeros((8, 16), np.uint8)}), image_rows({"a_4x": np.zeros((8, 16), np.uint8)})
    calls = tmp_path / "calls"

    def counted(batch):
        with calls.open("a") as out:
            out.write("x" * len(batch))
        return np.zeros(batch.shape[:3], np.uint8)

    reports.write_evaluation(evaluation.evaluate_images(picture, mask, counted, tile=8), str(tmp_path / "out"))
    assert calls.read_text() == "xx"
    document = spark.read.json(f"{tmp_path}/out/metrics_json").filter("grain = 'overall'").head()
    assert document["confusion_matrix"] == [[128, 0, 0], [0, 0, 0], [0, 0, 0]] and document["confusion_matrix_object"] == [[128, 0], [0, 0]]
    assert document["class_names"] == ["background", "loose cell", "aggregate"]


def test_deep_files_are_an_error_and_unlisted_ones_are_not_opened(spark, tmp_path):
    raw, masks = str(tmp_path / "raw"), str(tmp_path / "masks")
    save_tiff(spark, tmp_path / "raw" / "a_4x.tif", np.full((8, 8), 1100, np.uint16))
    save(tmp_path / "raw" / "b_4x.png", np.zeros((8, 8), np.uint8))
    (tmp_path / "raw" / "broken_4x.png").write_bytes(b"no picture")
    for name in ("a_4x", "b_4x"):
        save(tmp_path / "masks" / f"{name}.png", np.zeros((8, 8), np.uint8))
    for name, text in (("train", "b_4x\n"), ("val", "a_4x\n"), ("test", "")):
        (tmp_path / "lists").mkdir(exist_ok=True)
        (tmp_path / "lists" / f"{name}.txt").write_text(text)
    args = (spark, raw, masks, str(tmp_path / "lists"))
    assert evaluation.evaluate_split(*args, "train", zero_labels, tile=8).head()["c_0_0"] == 64
    with pytest.raises(ValueError, match="8 bits"):
        evaluation.evaluate_split(*args, "val", zero_labels, tile=8)


def test_split_membership_is_checked_on_reading(spark, tmp_path):
    (tmp_path / "train.txt").write_text("a\nb\n")
    (tmp_path / "val.txt").write_text("b\nc\n")
    (tmp_path / "test.txt").write_text("")
    with pytest.raises(ValueError, match="b"):
        split_lists.read_splits(spark, str(tmp_path))
    assert split_lists.read_splits(spark, str(tmp_path), check=False).count() == 4
    assert splits.SPLIT_NAMES == ("train", "val", "test")


def test_synthetic_pictures_stand_in(spark, tmp_path):
    for name in ("raw", "masks"):
        (tmp_path / name).mkdir()
    args = (spark, str(tmp_path / "raw"), str(tmp_path / "masks"), str(tmp_path / "lists"), "test", synthetic.threshold_labels)
    rows = confusion.report(evaluation.evaluate_or_synthetic(*args, tile=128)).filter("grain = 'overall'").collect()
    assert rows and all(r["dice"] == 1.0 for r in rows)
    # Options hold for synthetic pictures too: two classes after merging, and one more than there are.
    merged = confusion.report(evaluation.evaluate_or_synthetic(*args[:-1], two_classes, tile=128, class_mapping={2: 1}, batch_size=2, normalise=False, num_classes=4), 4)
    scores = {r["class"]: r for r in merged.filter("grain = 'overall'").collect()}
    assert all(r["dice"] == 1.0 for r in scores.values()) and scores["aggregate"]["tp"] == 0 < scores["loose cell"]["tp"]


def two_classes(batch):
    return (synthetic.threshold_labels(batch) > 0).astype(np.uint8)


def test_any_white_space_is_trimmed(spark, tmp_path):
    (tmp_path / "train.txt").write_text("\ta \n \t\n")
    assert [r["image_id"] for r in split_lists.read_split(spark, str(tmp_path), "train").collect()] == ["a"]
    (tmp_path / "m.csv").write_text("image,magnification,condition\nb_4x.png,4x\t,c\n")
    rows, errors = metadata.read_metadata_strict(spark, str(tmp_path / "m.csv"))
    assert errors.count() == 0 and rows.count() == 1


def test_files_of_one_folder_have_one_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("image,magnification\na_4x.png,4x\n")
    (tmp_path / "b.csv").write_text("image, magnification\nb_4x.png,4x\n")
    assert metadata.read_metadata_strict(spark, str(tmp_path))[0].count() == 2
    (tmp_path / "c.csv").write_text("magnification,image\n4x,c_4x.png\n")
    with pytest.raises(ValueError, match="header"):
        metadata.read_metadata_strict(spark, str(tmp_path))


def test_store_names_for_arrow():
    from tilewright.session import arrow_uri

    assert arrow_uri("s3a://bucket/a b:c") == "s3://bucket/a b:c"
    assert arrow_uri("abfs://c@h/x") == "abfss://c@h/x" and arrow_uri("gcs://b/x") == "gs://b/x"
    assert arrow_uri("file:/tmp/x") == "file:/tmp/x" and arrow_uri("hdfs://n/x") == "hdfs://n/x"


def test_many_small_files_make_few_tasks(spark, tmp_path):
    """A partition to a file, but four tasks a core; the same files and pixels as before."""
    rng = np.random.default_rng(3)
    arrays = {f"p{i}_4x": rng.integers(0, 256, (5, 3), dtype=np.uint8) for i in range(90)}
    for name, array in arrays.items():
        (tmp_path / f"{name}.png").write_bytes(images.encode_png(array))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        for files in (images.scan_images(spark, str(tmp_path)), images.scan_headers(spark, str(tmp_path)), images.decode_images(spark, str(tmp_path))):
            assert files.rdd.getNumPartitions() <= 16
            assert files.count() == 90
        (tmp_path / "none.png").write_bytes(b"no image")
        decoded = images.decode_images(spark, str(tmp_path))
        assert decoded.rdd.getNumPartitions() <= 16
        rows = {r["image_id"]: r["data"] for r in decoded.collect()}
        assert rows.pop("none") is None and {k: bytes(v) for k, v in rows.items()} == {k: v.tobytes() for k, v in arrays.items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_plain_png():
    """Lines as they are, against the pixel before and against the line above; nothing else."""
    import struct
    import zlib

    def png(lines, width, height, depth=8, colour=2, lace=0, extra=b""):
        chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
        head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, lace)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    image = np.random.default_rng(4).integers(0, 256, (4, 5, 3), dtype=np.uint8)
    left = np.concatenate([image[:, :1], np.diff(image.astype(int), axis=1) % 256], axis=1).astype(np.uint8)
    above = np.concatenate([image[:1], np.diff(image.astype(int), axis=0) % 256]).astype(np.uint8)
    lines = b"".join(bytes([k]) + (image, left, above)[k][y].tobytes() for y, k in enumerate((2, 1, 2, 0)))
    whole = png(lines, 5, 4)
    assert (images.plain_png(whole) == image).all() and (images.plain_png(images.encode_png(image[..., 0])) == image[..., 0]).all()
    for other in (png(lines, 5, 4, depth=16), png(lines, 5, 4, colour=3), png(lines, 5, 4, lace=1), png(lines, 5, 3), png(b"\x04" + lines[1:], 5, 4), png(lines, 5, 4, extra=struct.pack(">I", 0) + b"tRNS" + bytes(4)), whole[:-20], whole[:9], b"", b"no image at all"):
        assert images.plain_png(other) is None
