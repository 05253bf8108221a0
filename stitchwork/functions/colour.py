"""Colour: CIELab, palette snapping, harmony, named samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.rules import garments as G


def _linear(channel: Column) -> Column:
    v = channel.cast("double") / 255.0
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def _root(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """sRGB 0-255 to CIELab, D65 white."""
    r, g, b = _linear(r), _linear(g), _linear(b)
    x = _root((r * 0.4124 + g * 0.3576 + b * 0.1805) / 0.95047)
    y = _root(r * 0.2126 + g * 0.7152 + b * 0.0722)
    z = _root((r * 0.0193 + g * 0.1192 + b * 0.9505) / 1.08883)
    return y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0


def anchor_lab(rgb: tuple[int, int, int]) -> tuple[float, float, float]:
    """The same conversion for a fixed palette anchor, folded to a literal."""
    lin = [((v / 255.0 + 0.055) / 1.055) ** 2.4 if v / 255.0 > 0.04045 else v / 255.0 / 12.92 for v in rgb]
    rows = [((0.4124, 0.3576, 0.1805), 0.95047), ((0.2126, 0.7152, 0.0722), 1.0), ((0.0193, 0.1192, 0.9505), 1.08883)]
    x, y, z = (sum(w * c for w, c in zip(weights, lin)) / white for weights, white in rows)
    x, y, z = (math.cbrt(t) if t > 0.008856 else 7.787 * t + 16.0 / 116.0 for t in (x, y, z))
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def snap_to_palette(l: Column, a: Column, b: Column) -> Column:
    """Nearest anchor in Lab, earlier anchors win ties.

    The palette has ten anchors, so it is a literal array inside the
    projection: no join, no shuffle.
    """
    options = []
    for order, (name, rgb) in enumerate(G.PALETTE.items()):
        pl, pa, pb = anchor_lab(rgb)
        distance = (l - pl) * (l - pl) + (a - pa) * (a - pa) + (b - pb) * (b - pb)
        options.append(F.struct(distance.alias("d"), F.lit(order).alias("o"), F.lit(name).alias("n")))
    return F.array_min(F.array(*options))["n"]


def with_palette_name(df: DataFrame, r: Column, g: Column, b: Column, name: str) -> DataFrame:
    """Add the palette name of an RGB triple.

    The Lab triple is a column of its own first: inlined, it would be
    repeated for every anchor.
    """
    l, a, bb = rgb_to_lab(r, g, b)
    staged = df.withColumns({"_l": l, "_a": a, "_b": bb})
    snapped = F.when(F.col("_l").isNotNull(), snap_to_palette(F.col("_l"), F.col("_a"), F.col("_b")))
    return staged.withColumn(name, snapped).drop("_l", "_a", "_b")


def harmony(a: Column, b: Column) -> Column:
    pair = F.array(*[F.lit(v) for v in G.CLASHING])
    return (F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "harmonious")
            .when(a.isin(G.NEUTRALS) | b.isin(G.NEUTRALS), "neutral_pair")
            .when(F.array_contains(pair, a) & F.array_contains(pair, b), "clashing").otherwise("harmonious"))


def sample_name(r: Column, g: Column, b: Column) -> Column:
    """Spoken colour name of a mean sample, channels in 0..1."""
    brightness = (r + g + b) / 3
    spread = F.greatest(F.abs(r - g), F.abs(g - b), F.abs(r - b))
    return (F.when(brightness < 0.20, "Dark / Black").when(brightness > 0.82, "Light / White")
            .when(spread < 0.08, "Neutral Grey")
            .when((r > g) & (r > b), F.when(g > 0.5, "Warm Amber").otherwise("Warm Red / Burgundy"))
            .when((g > r) & (g > b), "Olive / Green")
            .when((b > r) & (b > g), F.when(r > 0.4, "Purple / Violet").otherwise("Navy / Blue"))
            .otherwise("Neutral"))
