"""Writing QC and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import confusion


def write_qc_report(report: DataFrame, folder: str) -> None:
    """CSV ``image, total_pixels, class_0..class_3, violations``; messages joined by ``; ``."""
    (
        report.select(
            F.col("image_id").alias("image"),
            "total_pixels",
            "class_0",
            "class_1",
            "class_2",
            "class_3",
            F.array_join("violations", "; ").alias("violations"),
        )
        .orderBy("image")
        .write.mode("overwrite")
        .csv(folder, header=True, emptyValue="")
    )


def metrics_table(report: DataFrame) -> DataFrame:
    """The flat report without single images: ``group, class, dice, iou, n_images`` and
    the pixels outside the classes."""
    return report.filter("grain <> 'image'").select(
        "group", "class", "dice", "iou", "n_images", confusion.OUT_OF_RANGE
    )


def matrix_table(wide: DataFrame, num_classes: int) -> DataFrame:
    """One row per true class, one column per predicted class."""
    by_class = confusion.long_matrix(wide, [], num_classes)
    names = [confusion.class_name(c) for c in range(num_classes)]
    sums = [
        F.sum(F.when(F.col("pred") == c, F.col("n"))).cast("bigint").alias(name)
        for c, name in enumerate(names)
    ]
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("gt") + 1).alias("truth")
    return by_class.groupBy("gt").agg(*sums).select("gt", label, *names)


def nested_metrics(per_image: DataFrame, num_classes: int = 3) -> DataFrame:
    """The report as JSON lines, one per overall, magnification and image: ``grain, group, json``.

    Scores are arrays in class order, matrices arrays of rows. Magnifications also carry means and deviations over their
    images. A document per group keeps the size of a row independent of the number of images.
    """
    by = ["grain", "group", "n_images", confusion.OUT_OF_RANGE, "matrix", "matrix_object"]
    classes = range(num_classes)
    named = confusion.object_matrix(confusion.named_grains(per_image, num_classes), num_classes).withColumns(
        {
            "matrix": F.array(*[F.array(*[F.col(confusion.cell(g, p)) for p in classes]) for g in classes]),
            "matrix_object": F.array(*[F.array(F.col(f"o_{g}_0"), F.col(f"o_{g}_1")) for g in (0, 1)]),
        }
    )
    flat = confusion.class_scores(named, by, num_classes)
    order = F.array(*[F.lit(confusion.class_name(c)) for c in range(num_classes)])

    def ordered(value: str):
        by_name = F.map_from_entries(F.collect_list(F.struct("class", value)))
        return by_name.alias(f"_{value}")

    stats = confusion.image_score_stats(per_image, num_classes)
    stat_names = ("mean_dice", "std_dice", "mean_iou", "std_iou")
    stat_rows = stats.groupBy("magnification").agg(*[ordered(s) for s in stat_names])
    groups = flat.groupBy(*by).agg(ordered("dice"), ordered("iou"))
    joined = groups.join(
        stat_rows,
        (groups["grain"] == "magnification") & (groups["group"] == stat_rows["magnification"]),
        "left",
    )

    def in_order(column: str):
        return F.transform(order, lambda name: F.try_element_at(F.col(column), name))

    def of_object(column: str):
        return F.try_element_at(F.col(column), F.lit("object"))

    over_images = F.when(
        F.col("grain") == "magnification",
        F.struct(
            *[in_order(f"_{s}").alias(s) for s in stat_names],
            *[of_object(f"_{s}").alias(s.replace("_", "_object_")) for s in stat_names],
        ),
    )
    document = F.to_json(
        F.struct(
            "grain",
            "group",
            in_order("_dice").alias("dice"),
            in_order("_iou").alias("iou"),
            of_object("_dice").alias("object_dice"),
            of_object("_iou").alias("object_iou"),
            "n_images",
            confusion.OUT_OF_RANGE,
            order.alias("class_names"),
            F.col("matrix").alias("confusion_matrix"),
            F.col("matrix_object").alias("confusion_matrix_object"),
            over_images.alias("per_image"),
        )
    )
    return joined.select("grain", "group", document.alias("json"))


def write_evaluation(per_image: DataFrame, folder: str, num_classes: int = 3) -> None:
    """Outputs under ``folder``: per_image, metrics_csv, metrics_json and the two matrices.

    The matrices per image are stored first and everything else is read off them, so a predictor
    behind ``per_image`` runs once.
    """
    per_image.write.mode("overwrite").parquet(f"{folder}/per_image")
    per_image = per_image.sparkSession.read.parquet(f"{folder}/per_image")
    flat = confusion.report(per_image, num_classes)
    metrics_table(flat).orderBy("group", "class").write.mode("overwrite").csv(
        f"{folder}/metrics_csv", header=True
    )
    nested_metrics(per_image, num_classes).select(F.col("json").alias("value")).write.mode(
        "overwrite"
    ).text(f"{folder}/metrics_json")
    matrix_table(per_image, num_classes).orderBy("gt").drop("gt").write.mode("overwrite").csv(
        f"{folder}/confusion_matrix", header=True
    )
    binary = confusion.object_matrix(per_image, num_classes).agg(
        *[F.sum(f"o_{g}_{p}").cast("bigint").alias(f"o_{g}_{p}") for g in (0, 1) for p in (0, 1)]
    )
    object_rows = binary.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("truth"),
                        F.col(f"o_{g}_0").alias("background"),
                        F.col(f"o_{g}_1").alias("object"),
                    )
                    for g, name in enumerate(("background", "object"))
                ]
            )
        )
    )
    object_rows.write.mode("overwrite").csv(f"{folder}/confusion_matrix_object", header=True)
