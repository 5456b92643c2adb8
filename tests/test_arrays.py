from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry, pixels
from tilewright.functions.blocks import TILE_SCHEMA
from tilewright.operators import augment, batches, intensity, losses, ordering, patches, scoring, stitching, tiles
from tilewright.sources import synthetic


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


@pytest.mark.parametrize(("tile", "overlap", "stride"), [(128, 0.15, 109), (100, 0.0, 100), (100, 0.99, 1), (10, 0.25, 8), (10, 0.35, 6)])
def test_stride(spark, tile, overlap, stride):
    assert one(spark, geometry.stride_for(F.lit(tile), F.lit(overlap)))[0] == stride
    assert max(1, round(tile * (1 - overlap))) == stride


@pytest.mark.parametrize(("n", "before", "after"), [(1, 2, 3), (2, 1, 4), (5, 3, 4), (4, 9, 11), (7, 0, 0)])
def test_reflection_equals_numpy(spark, n, before, after):
    expected = np.pad(np.arange(n), (before, after), mode="reflect") if n > 1 else np.zeros(n + before + after, int)
    got = (
        spark.range(n + before + after)
        .select(geometry.reflect_index(F.col("id").cast("int"), F.lit(before), F.lit(n)).alias("i"), "id")
        .orderBy("id")
        .collect()
    )
    assert [r["i"] for r in got] == expected.tolist()
    assert tiles.axis_reflection(n, before, n + before + after).tolist() == expected.tolist()


def test_pixel_expressions(spark):
    c = F.lit
    assert one(spark, pixels.remap_class(c(3), {0: 0, 1: 1, 2: 2, 3: 2}), pixels.remap_class(c(9), {3: 2}))[:] == (2, 9)
    assert one(spark, pixels.quantise(c(0.999)), pixels.quantise(c(2.0)), pixels.quantise(c(-1.0)))[:] == (254, 255, 0)
    assert one(spark, pixels.argmax(F.array(c(1.0), c(3.0), c(3.0))))[0] == 1
    categories = {(0, 0): "TN", (1, 1): "TP", (0, 2): "FP", (1, 2): "FP", (2, 1): "FN", (2, 0): "FN"}
    for (gt, pred), name in categories.items():
        assert one(spark, pixels.error_category(c(gt), c(pred)))[0] == name
    assert one(spark, pixels.error_colour(c(7), c(0), c(0)), pixels.error_colour(c(7), c(1), c(2)))[:] == ([7, 7, 7], [255, 0, 0])
    assert one(spark, pixels.tint(c(5), c(0)), pixels.tint(c(7), c(0)))[:] == (2, 4)
    with pytest.raises(ValueError):
        pixels.to_gray([c(1), c(2)])


@pytest.mark.parametrize("shape", [(256, 256), (200, 310), (128, 128), (5, 7), (1, 3), (180, 250, 3)])
def test_tile_round_trip(image_rows, pasted, shape):
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    cut = tiles.cut_tiles(image_rows({"a": image}), 64)
    assert {(r["height"], r["width"]) for r in cut.collect()} == {(64, 64)}
    assert (pasted(tiles.crop_tiles(cut))["a"] == image).all()


@pytest.mark.parametrize("shape", [(20, 31), (64, 64), (5, 7), (1, 3)])
@pytest.mark.parametrize("by_tile", [False, True])
def test_labels_are_those_of_the_tiles(image_rows, pasted, shape, by_tile):
    """The place in the tile reaches the predictor the same way on both paths."""
    image = np.random.default_rng(3).integers(0, 256, shape, dtype=np.uint8)

    def predict(batch):
        i, j = np.mgrid[0 : batch.shape[1], 0 : batch.shape[2]]
        return (batch[..., 0].astype(int) + i + 2 * j) % 5

    got = pasted(scoring.predict_labels(image_rows({"a": image}), predict, tile=8, by_tile=by_tile))["a"]
    top, left = (-shape[0] % 8) // 2, (-shape[1] % 8) // 2
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    assert (got == (image.astype(int) + (y + top) % 8 + 2 * ((x + left) % 8)) % 5).all()
    blocks = tiles.cut_blocks(image_rows({"a": image}), 8)
    assert (pasted(blocks)["a"] == image).all()
    assert sorted(blocks.collect()) == sorted(tiles.crop_tiles(tiles.cut_tiles(image_rows({"a": image}), 8)).collect())


def test_tiles_match_numpy_padding(image_rows, arrays):
    image = np.random.default_rng(2).integers(0, 256, (10, 13), dtype=np.uint8)
    cut = tiles.cut_tiles(image_rows({"a": image}), 4).collect()
    padded = np.pad(image, ((1, 1), (1, 2)), mode="reflect")
    for r in cut:
        expected = padded[r["y0"] : r["y0"] + 4, r["x0"] : r["x0"] + 4]
        assert (np.frombuffer(bytes(r["data"]), np.uint8).reshape(4, 4) == expected).all()
    assert len(cut) == 12


def test_small_image_is_one_tile(image_rows):
    rows = tiles.cut_overlapping(image_rows({"a": np.ones((32, 32), np.uint8)}), 64, 48).collect()
    assert [(r["y0"], r["x0"], r["height"], r["width"]) for r in rows] == [(0, 0, 64, 64)]


def test_incomplete_images(image_rows):
    images = image_rows({"a": np.ones((9, 9), np.uint8), "b": np.ones((4, 4), np.uint8)})
    blocks = tiles.crop_tiles(tiles.cut_tiles(images, 4))
    assert tiles.incomplete_images(blocks, images).count() == 0
    gap = blocks.filter("not (image_id = 'a' and tile_y = 1 and tile_x = 1)")
    assert [r["image_id"] for r in tiles.incomplete_images(gap, images).collect()] == ["a"]


def test_assemble(image_rows, arrays):
    image = np.random.default_rng(4).integers(0, 256, (70, 33, 3), dtype=np.uint8)
    got = arrays(tiles.assemble_images(tiles.crop_tiles(tiles.cut_tiles(image_rows({"a": image}), 16))))
    assert (got["a"] == image).all()


def test_missing_blocks_are_an_error(spark, image_rows):
    blocks = tiles.cut_blocks(image_rows({"a": np.ones((32, 32), np.uint8)}), 16)
    sizes = spark.createDataFrame([("a", 32, 32)], "image_id string, height int, width int")
    assert tiles.assemble_images(blocks, sizes).count() == 1
    with pytest.raises(Exception, match="do not make up"):
        tiles.assemble_images(blocks.filter("tile_y = 0 or tile_x = 0")).collect()
    with pytest.raises(Exception, match="do not make up"):
        tiles.assemble_images(blocks.filter("tile_y = 0"), sizes).collect()


def brute_stitch(image, predict, tile, stride):
    """Canvas accumulation on one whole picture."""
    rows, top = tiles.axis_grid(image.shape[0], tile, stride)
    cols, left = tiles.axis_grid(image.shape[1], tile, stride)
    ph, pw = (rows - 1) * stride + tile, (cols - 1) * stride + tile
    padded = np.pad(image, ((top, ph - top - image.shape[0]), (left, pw - left - image.shape[1])), mode="reflect")
    total, count = None, np.zeros((ph, pw, 1), np.float32)
    for i in range(rows):
        for j in range(cols):
            at = np.s_[i * stride : i * stride + tile, j * stride : j * stride + tile]
            logits = predict(padded[at][np.newaxis, ..., np.newaxis])[0].astype(np.float32)
            total = np.zeros((ph, pw, logits.shape[-1]), np.float32) if total is None else total
            total[at] += logits
            count[at] += 1
    return np.argmax(total / count, -1)[top : top + image.shape[0], left : left + image.shape[1]]


def rough_logits(batch):
    rng_like = np.sin(batch.astype(np.float64) * np.array([0.7, 1.3, 2.1]) + np.arange(batch.shape[2])[None, None, :, None])
    return rng_like.astype(np.float32)


@pytest.mark.parametrize("shape", [(128, 128), (100, 150), (50, 50), (20, 17)])
@pytest.mark.parametrize(("tile", "overlap"), [(64, 0.25), (16, 0.6), (16, 0.0)])
@pytest.mark.parametrize("by_tile", [False, True])
def test_stitch_equals_whole_canvas(image_rows, pasted, shape, tile, overlap, by_tile):
    image = np.random.default_rng(5).integers(0, 256, shape, dtype=np.uint8)
    got = pasted(scoring.predict_stitched(image_rows({"a": image}), rough_logits, tile=tile, overlap=overlap, by_tile=by_tile))
    stride = max(1, round(tile * (1 - overlap)))
    assert got["a"].shape == shape
    assert (got["a"] == brute_stitch(image, rough_logits, tile, stride)).all()


def test_regions_ship_only_rims_as_logits(image_rows, pasted):
    """Four regions of at most 16 x 16 tiles: few blocks, each in place, the crossing of rims too."""
    images = {name: np.random.default_rng(8).integers(0, 256, shape, dtype=np.uint8) for name, shape in {"a": (300, 220), "b": (1, 230), "c": (196, 196), "d": (197, 196, 3)}.items()}
    single = image_rows({k: v for k, v in images.items() if v.ndim == 2})
    blocks = scoring.predict_stitched(single, rough_logits, tile=16, overlap=0.25, by_tile=True).cache()
    got = pasted(blocks)
    for name in ("a", "b", "c"):
        assert (got[name] == brute_stitch(images[name], rough_logits, 16, 12)).all()
    counts = {r["image_id"]: r["count"] for r in blocks.groupBy("image_id").count().collect()}
    # Single rectangles of "a" would be about 47 x 35, of "c" 31 x 31.
    assert counts["a"] < 250 and counts["c"] == 1
    colour = image_rows({"d": images["d"]})
    by_tile, in_place = (pasted(scoring.predict_stitched(colour, lambda b: rough_logits(b[..., :1]) + b[..., 1:2], tile=16, overlap=0.25, by_tile=t))["d"] for t in (True, False))
    assert (by_tile == in_place).all()


def test_two_tile_average(spark):
    """Tile 0 votes class 0, tile 1 votes class 1; the tie in the middle goes to class 0."""
    rows = []
    for j in range(2):
        logits = np.zeros((4, 4, 2), np.float32)
        logits[..., j] = 1.0
        base = dict(image_id="a", tile_y=0, tile_x=j, y0=0, x0=2 * j, height=4, width=4, channels=2, dtype="float32", data=logits.tobytes(), image_height=4, image_width=6, rows=1, cols=2, tile=4, stride=2, pad_top=0, pad_left=0)
        rows.append(tuple(base[n] for n in TILE_SCHEMA.names))
    canvas = np.full((4, 6), 9)
    for r in stitching.stitch_tiles(spark.createDataFrame(rows, TILE_SCHEMA)).collect():
        canvas[r["y0"] : r["y0"] + r["height"], r["x0"] : r["x0"] + r["width"]] = np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"])
    assert (canvas[:, :4] == 0).all() and (canvas[:, 4:] == 1).all()


def test_missing_tile_is_an_error(image_rows):
    cut = tiles.cut_overlapping(image_rows({"a": np.ones((30, 30), np.uint8)}), 16, 8)
    scored = scoring.score_tiles(cut, rough_logits, as_labels=False).filter("not (tile_y = 1 and tile_x = 1)")
    with pytest.raises(Exception, match="tiles arrived"):
        stitching.stitch_tiles(scored).collect()


def test_predictor_shape_is_checked(image_rows):
    images = image_rows({"a": np.ones((8, 8), np.uint8)})
    with pytest.raises(Exception, match="predictor returned shape"):
        scoring.predict_labels(images, lambda b: b, tile=4).collect()


def test_normalise(image_rows, arrays):
    rng = np.random.default_rng(6)
    images = {"gray": rng.integers(0, 256, (40, 30), dtype=np.uint8), "flat": np.full((5, 5), 9, np.uint8), "rgb": rng.integers(0, 256, (20, 20, 3), dtype=np.uint8), "deep": rng.integers(0, 65536, (9, 9)).astype(np.uint16)}
    df = image_rows(images)
    got = arrays(intensity.normalise_images(df))
    for name, image in images.items():
        lo, hi = np.percentile(image.astype(float), [1, 99])
        expected = np.zeros(image.shape) if hi <= lo else (np.clip(image, lo, hi) - lo) / (hi - lo)
        assert np.allclose(got[name], expected, atol=1e-6) and got[name].dtype == np.float32
    blocks = tiles.crop_tiles(tiles.cut_tiles(df.filter("image_id <> 'rgb'"), 7))
    limits = {r["image_id"]: (r["p_low"], r["p_high"]) for r in intensity.block_percentiles(blocks).collect()}
    for name in ("gray", "flat", "deep"):
        assert limits[name] == pytest.approx(tuple(np.percentile(images[name].astype(float), [1, 99])))
    scaled = intensity.normalise_blocks(blocks, intensity.block_percentiles(blocks))
    assert scaled.count() == blocks.count()


def test_channels(image_rows, arrays):
    rgb = np.random.default_rng(7).random((6, 5, 3)).astype(np.float32)
    df = image_rows({"c": rgb, "g": rgb[..., 0].copy()})
    gray = arrays(intensity.convert_channels(df, "grayscale"))
    assert np.allclose(gray["c"], rgb @ np.array([0.299, 0.587, 0.114]), atol=1e-6) and (gray["g"] == rgb[..., 0]).all()
    assert arrays(intensity.convert_channels(df, "rgb"))["g"].shape == (6, 5, 3)
    with pytest.raises(ValueError):
        intensity.convert_channels(df, "cmyk")


def test_remap_masks(image_rows, arrays):
    mask = np.array([[0, 1, 2], [3, 2, 1]], np.uint8)
    got = arrays(intensity.remap_masks(image_rows({"m": mask}), {0: 0, 1: 1, 2: 2, 3: 2}))
    assert got["m"].tolist() == [[0, 1, 2], [2, 2, 1]]


LOGIT = "l0 double, l1 double, target int"


def test_soft_dice(spark):
    rows = [(10.0, -10.0, t) for t in (0, 1, 0, 0)]
    got = losses.segmentation_loss(spark.createDataFrame(rows, LOGIT), [], ["l0", "l1"], eps=0.0).head()
    assert got["dice_loss"] == pytest.approx(4 / 7, abs=1e-6)


def test_cross_entropy_and_combination(spark):
    rows = [(0.0, 0.0, 0), (0.0, 0.0, 0), (1.0, 0.0, 0), (0.0, 1.0, 1)]
    df = spark.createDataFrame(rows, LOGIT)
    got = losses.segmentation_loss(df, [], ["l0", "l1"], dice_weight=0.7, ce_weight=0.3).head()
    assert got["ce_loss"] == pytest.approx((2 * math.log(2) + 2 * (math.log(1 + math.e) - 1)) / 4)
    assert got["loss"] == pytest.approx(0.7 * got["dice_loss"] + 0.3 * got["ce_loss"])
    weighted = losses.segmentation_loss(df, [], ["l0", "l1"], class_weights=[0.1, 2.0]).head()
    pixel = [math.log(2) * 0.1] * 2 + [(math.log(1 + math.e) - 1) * w for w in (0.1, 2.0)]
    assert weighted["ce_loss"] == pytest.approx(sum(pixel) / 4)


def square_pair(image_rows):
    mask = np.zeros((256, 256), np.uint8)
    mask[64:192, 64:192] = 1
    image = np.random.default_rng(8).random((256, 256)).astype(np.float32)
    return image_rows({"s": image}), image_rows({"s": mask}), image, mask


def test_patch_quota(spark, image_rows):
    images, masks, image, mask = square_pair(image_rows)
    args = dict(patch=64, per_image=100, object_ratio=0.8, min_object_fraction=0.05, seed=42)
    rows = patches.build_patches(images, masks, **args).collect()
    assert sorted(r["patch_id"] for r in rows) == list(range(1, 101))
    assert 0.75 <= sum(r["is_object"] for r in rows) / 100 <= 0.85
    for r in rows:
        at = np.s_[r["y0"] : r["y0"] + 64, r["x0"] : r["x0"] + 64]
        assert (np.frombuffer(bytes(r["mask"]), np.uint8).reshape(64, 64) == mask[at]).all()
        assert (np.frombuffer(bytes(r["image"]), np.float32).reshape(64, 64) == image[at]).all()
        assert r["fg_fraction"] == (mask[at] > 0).mean() and r["is_object"] == (r["fg_fraction"] > 0.05)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = patches.build_patches(images, masks, **args).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(again) == sorted(rows)


@pytest.mark.parametrize("ratio", [0.0, 0.8, 1.0])
def test_only_pickable_candidates_leave_a_mask(spark, image_rows, ratio):
    masks = image_rows({n: (np.random.default_rng(i).random((60, 50)) < p).astype(np.uint8) for i, (n, p) in enumerate({"some": 0.05, "none": 0.0, "all": 1.0}.items())})
    options = dict(patch=32, per_image=10, min_object_fraction=0.05, seed=1)
    every = patches.score_candidates(masks, **options)
    few = patches.score_candidates(masks, **options, object_ratio=ratio)
    assert every.count() == 3000 and few.count() <= 30
    pick = lambda c: sorted(map(tuple, patches.select_patches(c, per_image=10, object_ratio=ratio, seed=1).collect()))
    assert pick(few) == pick(every)


def test_short_pick_is_filled_with_repeats(image_rows):
    """No background exists, so only the object quota is filled and the rest repeats it."""
    masks = image_rows({"s": np.ones((40, 20), np.uint8)})
    candidates = patches.score_candidates(masks, patch=32, per_image=10, min_object_fraction=0.05, seed=1)
    assert candidates.count() == 1000
    rows = patches.select_patches(candidates, per_image=10, object_ratio=0.8, seed=1).collect()
    assert sorted(r["patch_id"] for r in rows) == list(range(1, 11))
    assert sum(r["repeated"] for r in rows) == 2 and all(r["is_object"] for r in rows)


def test_mismatched_pair_is_an_error(image_rows):
    pair = patches.pair_pixels(image_rows({"a": np.ones((4, 4), np.uint8)}), image_rows({"a": np.ones((4, 5), np.uint8)}))
    with pytest.raises(Exception, match="differ in size"):
        pair.collect()


def as_patches(image_rows, image, mask):
    pair = patches.pair_pixels(image_rows({"a": image}), image_rows({"a": mask}))
    return pair.select("image_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("patch_id"), F.lit(0).alias("y0"), F.lit(0).alias("x0"), F.lit(0.0).alias("fg_fraction"), F.lit(True).alias("is_object"), F.lit(image.shape[0]).alias("patch"), "channels", "dtype", F.col("data").alias("image"), "mask")


@pytest.mark.parametrize("shape", [(32, 32), (32, 32, 3)])
def test_augmentation_keeps_shape_and_classes(image_rows, shape):
    rng = np.random.default_rng(9)
    image = rng.random(shape).astype(np.float32)
    mask = rng.integers(0, 3, (32, 32)).astype(np.uint8)
    spec = augment.AugmentSpec(elastic_probability=1.0, blur_probability=1.0, noise_probability=1.0)
    table = as_patches(image_rows, image, mask)
    first = augment.augment_patches(table, spec, seed=3).orderBy("patch_id").collect()
    again = augment.augment_patches(table.repartition(5), spec, seed=3).orderBy("patch_id").collect()
    assert first == again
    for r in first:
        out = np.frombuffer(bytes(r["image"]), np.float32)
        assert out.size == image.size and 0 <= out.min() and out.max() <= 1
        assert set(np.frombuffer(bytes(r["mask"]), np.uint8)) <= {0, 1, 2}
    assert len({bytes(r["image"]) for r in first}) == 12


def test_zoom_out_mirrors_instead_of_black(image_rows):
    spec = augment.AugmentSpec(flip_probability=0, rotate90_probability=0, elastic_probability=0, scale_probability=1, scale_range=(0.5, 0.5), blur_probability=0, noise_probability=0, brightness_contrast_probability=0)
    table = as_patches(image_rows, np.full((128, 128), 200, np.uint8), np.ones((128, 128), np.uint8))
    row = augment.augment_patches(table, spec, seed=42).head()
    assert (np.frombuffer(bytes(row["image"]), np.uint8) == 200).all() and (np.frombuffer(bytes(row["mask"]), np.uint8) == 1).all()


def test_scale_range_needs_two_values():
    with pytest.raises(ValueError):
        augment.AugmentSpec(scale_range=(0.5,))


def test_hook_runs_first(image_rows):
    spec = augment.AugmentSpec(*[0.0] * 2, elastic_probability=0, scale_probability=0, blur_probability=0, noise_probability=0, brightness_contrast_probability=0)
    table = as_patches(image_rows, np.full((8, 8), 5, np.uint8), np.zeros((8, 8), np.uint8))
    row = augment.augment_patches(table, spec, seed=1, hook=lambda i, m, r: (i * 2, m + 1)).head()
    assert set(bytes(row["image"])) == {10} and set(bytes(row["mask"])) == {1}


@pytest.mark.parametrize("seed", [None, 5])
def test_batches(spark, seed):
    df = spark.range(103).withColumnRenamed("id", "k")
    rows = batches.assign_batches(df, ["k"], 10, seed=seed).collect()
    assert len(rows) == 100 and len({r["k"] for r in rows}) == 100
    assert {(r["batch_id"], r["slot"]) for r in rows} == {(b, s) for b in range(10) for s in range(10)}
    if seed is None:
        assert all(r["k"] == r["batch_id"] * 10 + r["slot"] for r in rows)


def test_ranks_with_one_hot_group(spark):
    """A third of the rows in one group, null groups included, ranked over several chunks."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        F.expr("id * 7919 % 3001").alias("o"),
        "id",
    )
    local = {}
    for r in df.collect():
        local.setdefault(r["g"], []).append(r["o"])
    places = {g: {o: i for i, o in enumerate(sorted(v), 1)} for g, v in local.items()}
    for n in (None, 7):
        ranked = ordering.ordered_rank(df, ["g"], ["o"], partitions=n).collect()
        assert len(ranked) == 3000
        assert all(r["rn"] == places[r["g"]][r["o"]] for r in ranked)
    hashed = ordering.hash_rank(df.withColumn("h", F.md5(F.col("id").cast("string"))), ["g"], "h", ["id"]).collect()
    for g, values in local.items():
        mine = sorted((r for r in hashed if r["g"] == g), key=lambda r: r["h"])
        assert [r["rn"] for r in mine] == list(range(1, len(values) + 1))
        assert {r["group_size"] for r in mine} == {len(values)}


def test_stripes_and_blobs(spark, arrays):
    sizes = spark.createDataFrame([("a", 10, 3), ("b", 2, 2)], "image_id string, height int, width int")
    got = arrays(synthetic.stripe_masks(sizes))
    assert got["a"][:, 0].tolist() == [0, 0, 1, 1, 1, 2, 2, 3, 3, 3]
    names = [r["image_id"] for r in synthetic.synthetic_names(spark, 8).orderBy("idx").collect()]
    assert names[:3] == ["synth_000_4x", "synth_001_10x", "synth_002_4x"] and len(names) == 8
    pairs = synthetic.synthetic_dataset(spark, 2)
    again = sorted(tuple(r) for r in synthetic.synthetic_dataset(spark, 2).repartition(2).collect())
    rows = pairs.collect()
    assert sorted(tuple(r) for r in rows) == again
    for r in rows:
        raw, mask = np.frombuffer(bytes(r["data"]), np.uint8), np.frombuffer(bytes(r["mask"]), np.uint8)
        assert set(np.unique(mask)) == {0, 1, 2} and raw.size == 512 * 512
        for label, (low, high) in ((0, (0, 80)), (1, (120, 180)), (2, (180, 255))):
            assert low <= raw[mask == label].min() and raw[mask == label].max() < high


def test_counter_draws():
    """Each number depends on seed, stream and place only, and they spread evenly."""
    from tilewright.functions.draws import COUNTER_STEP, MIX, STREAM_STEP, counter_normals, counter_uniforms

    def by_hand(seed, stream, i):
        x = ((seed ^ stream * STREAM_STEP) & 0xFFFFFFFF) + i * COUNTER_STEP & 0xFFFFFFFF
        for _ in range(2):
            x = (x ^ x >> 16) * MIX & 0xFFFFFFFF
        return ((x ^ x >> 16) + 0.5) / 2**32

    for seed, stream in ((0, 0), (7, 1), (2**32 - 1, 3)):
        u = counter_uniforms(seed, stream, (40, 50))
        assert [u.ravel()[i] for i in (0, 1, 1999)] == [by_hand(seed, stream, i) for i in (0, 1, 1999)]
        assert np.array_equal(counter_uniforms(seed, stream, (2, 50)), u[:2])
        assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03 and abs(u.std() - 12**-0.5) < 0.02
    z = counter_normals(11, (200, 200))
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs((abs(z) < 1.96).mean() - 0.95) < 0.01
