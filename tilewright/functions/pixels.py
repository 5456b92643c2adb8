"""Per-pixel column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display colours per class, as (red, green, blue).
CLASS_COLOURS = {0: (0, 0, 0), 1: (0, 255, 0), 2: (255, 255, 0)}
# Colours of the batch viewer, which shows the four classes before merging.
VIEWER_COLOURS = {0: (0, 0, 0), 1: (255, 0, 0), 2: (0, 255, 0), 3: (0, 0, 255)}
# Error colours, as (red, green, blue).
FALSE_POSITIVE_COLOUR = (255, 0, 0)
FALSE_NEGATIVE_COLOUR = (0, 0, 255)
# Luminance weights for red, green and blue.
LUMINANCE = (0.299, 0.587, 0.114)


def double(value: float) -> Column:
    return F.lit(float(value)).cast("double")


def remap_class(label: Column, mapping: Mapping[int, int]) -> Column:
    """Replace class ids; ids without an entry stay as they are."""
    pairs = [F.lit(int(v)) for item in sorted(mapping.items()) for v in item]
    if not pairs:
        return label
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label)


def to_gray(channels: Sequence[Column]) -> Column:
    """One channel passes, three become luminance, anything else is an error."""
    if len(channels) == 1:
        return channels[0]
    if len(channels) == 3:
        red, green, blue = channels
        return (
            red * double(LUMINANCE[0]) + green * double(LUMINANCE[1]) + blue * double(LUMINANCE[2])
        )
    raise ValueError(f"cannot turn {len(channels)} channels into gray")


def to_rgb(channels: Sequence[Column]) -> Column:
    """Array of red, green, blue; gray is repeated."""
    if len(channels) == 3:
        return F.array(*channels)
    gray = to_gray(channels)
    return F.array(gray, gray, gray)


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(value, high), low)


def normalise(value: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1] between two percentiles; a flat image becomes zero."""
    return F.when(high <= low, double(0.0)).otherwise((clip(value, low, high) - low) / (high - low))


def quantise(value: Column) -> Column:
    """[0, 1] to 0..255, cut off rather than rounded."""
    return F.floor(clip(value * double(255.0), double(0.0), double(255.0))).cast("int")


def error_category(gt: Column, pred: Column) -> Column:
    """TN, TP, FP or FN per pixel.

    Two foreground classes mixed up touch both classes; the larger class decides, so it is FP
    when the prediction is the larger and FN when the truth is.
    """
    return (
        F.when((gt == 0) & (pred == 0), "TN")
        .when(gt == pred, "TP")
        .when(pred > gt, "FP")
        .otherwise("FN")
    )


def class_colour(label: Column, colours: Mapping[int, tuple[int, int, int]] = CLASS_COLOURS) -> Column:
    """Array of red, green, blue for a class; unknown classes are black."""
    expr = F
    for class_id, rgb in sorted(colours.items()):
        expr = expr.when(label == class_id, F.array(*[F.lit(v) for v in rgb]))
    return expr.otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))


def error_colour(raw: Column, gt: Column, pred: Column) -> Column:
    """Raw gray for TN, class colour for TP, fixed colours for FP and FN."""
    category = error_category(gt, pred)
    return (
        F.when(category == "TN", F.array(raw, raw, raw))
        .when(category == "TP", class_colour(gt))
        .when(category == "FP", F.array(*[F.lit(v) for v in FALSE_POSITIVE_COLOUR]))
        .otherwise(F.array(*[F.lit(v) for v in FALSE_NEGATIVE_COLOUR]))
    )


def tint(raw: Column, colour: Column) -> Column:
    """Half raw, half colour, rounded half to even."""
    return F.rint(raw * double(0.5) + colour * double(0.5)).cast("int")


def tint_viewer(raw: Column, colour: Column, alpha: float = 0.4) -> Column:
    """``alpha`` colour over raw, cut off."""
    return F.floor(colour * double(alpha) + raw * double(1 - alpha)).cast("int")


def one_hot(label: Column, num_classes: int) -> Column:
    return F.array(*[(label == c).cast("int") for c in range(num_classes)])


def argmax(values: Column) -> Column:
    """Position of the largest value; ties go to the lowest position."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Sequence[Column]) -> list[Column]:
    """Softmax over a short list of columns, kept as plain columns for code generation."""
    top = F.greatest(*values)
    scaled = [F.exp(v - top) for v in values]
    total = sum(scaled[1:], scaled[0])
    return [s / total for s in scaled]


def log_softmax(values: Sequence[Column]) -> list[Column]:
    top = F.greatest(*values)
    scaled = [F.exp(v - top) for v in values]
    total = sum(scaled[1:], scaled[0])
    return [v - top - F.log(total) for v in values]


def class_weight(label: Column, weights: Sequence[float]) -> Column:
    return F.element_at(F.array(*[double(w) for w in weights]), (label + 1).cast("int"))
