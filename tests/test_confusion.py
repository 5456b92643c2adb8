from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import confusion


def matrix_rows(spark, matrices):
    """One wide row per ``(magnification, image_id)``."""
    k = len(next(iter(matrices.values())))
    names = confusion.cells(k)
    rows = [
        (mag, image, *[int(v) for line in m for v in line], 0) for (mag, image), m in matrices.items()
    ]
    schema = "magnification string, image_id string, " + ", ".join(f"{n} bigint" for n in names) + f", {confusion.OUT_OF_RANGE} bigint"
    return spark.createDataFrame(rows, schema)


def scores(df):
    return {(r["group"], r["class"]): r for r in df.collect()}


PUBLISHED = [[145127942, 351148, 2236410], [70879, 434604, 426133], [61393, 728261, 723742]]


def test_published_matrix(spark):
    got = scores(confusion.report(matrix_rows(spark, {("10x", "a"): PUBLISHED})).filter("grain = 'overall'"))
    expected = {
        "background": (0.9907165342721889, 0.9816038485855575),
        "loose cell": (0.35541286106790715, 0.21611068982274406),
        "aggregate": (0.29542413067314066, 0.1733123975232461),
        "object": (0.6297188273878666, 0.45955446223312146),
    }
    for name, (dice, iou) in expected.items():
        assert got[("overall", name)]["dice"] == pytest.approx(dice, abs=1e-15)
        assert got[("overall", name)]["iou"] == pytest.approx(iou, abs=1e-15)
    assert sum(map(sum, PUBLISHED)) == 150160512


def test_counts_and_zero_cells(spark):
    pixels = spark.createDataFrame([(0, 0), (1, 0), (0, 0), (0, 0)], "gt int, pred int")
    wide = confusion.count_pixels(pixels, [], 3)
    long = {(r["gt"], r["pred"]): r["n"] for r in confusion.long_matrix(wide, [], 3).collect()}
    assert long == {(g, p): {(0, 0): 3, (1, 0): 1}.get((g, p), 0) for g in range(3) for p in range(3)}
    got = {r["class"]: r for r in confusion.class_scores(confusion.count_pixels(pixels, [], 2), [], 2, eps=0.0, with_object=False).collect()}
    assert got["background"]["dice"] == 6 / 7 and got["background"]["iou"] == 3 / 4
    assert got["loose cell"]["dice"] == 0 and got["loose cell"]["iou"] == 0


def test_labels_out_of_range_are_counted_apart(spark):
    pixels = spark.createDataFrame([(0, 3), (7, 1), (1, 1)], "gt int, pred int")
    row = confusion.count_pixels(pixels, [], 3).head()
    assert row[confusion.OUT_OF_RANGE] == 2 and row["c_1_1"] == 1 and row["c_1_0"] == 0


@pytest.mark.parametrize("k", [2, 3])
def test_empty_classes_score_one(spark, k):
    pixels = spark.createDataFrame([(0, 0)] * 4, "gt int, pred int")
    for r in confusion.class_scores(confusion.count_pixels(pixels, [], k), [], k).collect():
        assert r["dice"] == r["iou"] == 1.0


def test_predicted_but_absent_is_about_zero(spark):
    pixels = spark.createDataFrame([(0, 1)] * 4, "gt int, pred int")
    for r in confusion.class_scores(confusion.count_pixels(pixels, [], 2), [], 2, with_object=False).collect():
        assert r["dice"] < 1e-5 and r["iou"] < 1e-5


def test_object_collapse(spark):
    wide = confusion.object_matrix(matrix_rows(spark, {("4x", "a"): [[60, 2, 1], [3, 5, 1], [2, 1, 4]]}), 3).head()
    assert [wide[f"o_{g}_{p}"] for g in (0, 1) for p in (0, 1)] == [60, 3, 5, 11]


def test_foreground_swap_keeps_object(spark):
    gt = np.zeros((8, 8), int)
    gt[0, 0], gt[0, 1] = 1, 2
    pred = gt.copy()
    pred[0, 0], pred[0, 1] = 2, 1
    rows = [(int(a), int(b)) for a, b in zip(gt.ravel(), pred.ravel(), strict=True)]
    wide = confusion.count_pixels(spark.createDataFrame(rows, "gt int, pred int"), [], 3)
    got = {r["class"]: r for r in confusion.class_scores(wide, [], 3).collect()}
    assert got["object"]["dice"] == got["object"]["iou"] == 1.0


def test_one_missed_pixel(spark):
    rows = [(1, 0)] + [(0, 0)] * 63
    wide = confusion.count_pixels(spark.createDataFrame(rows, "gt int, pred int"), [], 3)
    got = {r["class"]: r for r in confusion.class_scores(wide, [], 3).collect()}
    assert got["background"]["dice"] == pytest.approx(126 / 127, abs=1e-8)
    assert got["object"]["dice"] < 1e-5


def test_counts_stay_exact_beyond_float_range(spark):
    pixels = spark.range(20971520).select(F.lit(0).alias("gt"), F.lit(0).alias("pred"))
    assert confusion.count_pixels(pixels, [], 3).head()["c_0_0"] == 20971520


def test_confusion_scores_equal_direct_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(p)) for g, p in rng.integers(0, 3, (500, 2))]
    pixels = spark.createDataFrame(rows, "gt int, pred int")
    a = {r["class"]: (r["dice"], r["iou"]) for r in confusion.class_scores(confusion.count_pixels(pixels, [], 3), [], 3, with_object=False).collect()}
    b = {r["class"]: (r["dice"], r["iou"]) for r in confusion.direct_scores(pixels, [], 3).collect()}
    assert a == b


def test_grains_and_image_stats(spark):
    matrices = {
        ("4x", "a_4x"): [[5, 1, 0], [0, 3, 1], [0, 0, 2]],
        ("4x", "b_4x"): [[9, 0, 0], [1, 1, 0], [0, 1, 1]],
        ("10x", "c_10x"): [[4, 0, 1], [0, 0, 0], [2, 0, 3]],
    }
    wide = matrix_rows(spark, matrices)
    flat = scores(confusion.report(wide))
    assert len(flat) == (1 + 2 + 3) * 4
    pooled = np.array(matrices[("4x", "a_4x")]) + np.array(matrices[("4x", "b_4x")])
    tp = pooled[1, 1]
    fp, fn = pooled[:, 1].sum() - tp, pooled[1].sum() - tp
    assert flat[("4x", "loose cell")]["dice"] == pytest.approx((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6))
    assert flat[("4x", "loose cell")]["n_images"] == 2 and flat[("overall", "object")]["n_images"] == 3
    stats = {(r["magnification"], r["class"]): r for r in confusion.image_score_stats(wide).collect()}
    values = [flat[("a_4x", "aggregate")]["dice"], flat[("b_4x", "aggregate")]["dice"]]
    assert stats[("4x", "aggregate")]["mean_dice"] == pytest.approx(np.mean(values))
    assert stats[("4x", "aggregate")]["std_dice"] == pytest.approx(np.std(values))
    assert stats[("10x", "object")]["std_dice"] == 0.0


def test_row_sum_check_finds_a_gap(spark):
    wide = matrix_rows(spark, {("4x", "a"): [[2, 0, 0], [0, 1, 0], [0, 0, 1]]})
    good = spark.createDataFrame([("a", 2, 1, 1)], "image_id string, class_0 bigint, class_1 bigint, class_2 bigint")
    assert confusion.row_sum_mismatches(wide, good, 3).count() == 0
    assert confusion.row_sum_mismatches(wide, good.withColumn("class_0", F.lit(3).cast("bigint")), 3).count() == 1
