"""Landmark ratios, box expansion, capture-framing verdicts, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centroid(points: Column) -> Column:
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[f])
    n = F.size(points)
    return F.when(n > 0, F.struct((total("x") / n).alias("x"), (total("y") / n).alias("y"))).otherwise(
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def landmark_signature(df: DataFrame, name: str = "signature") -> DataFrame:
    """Six ratios over the eye distance; null when the eyes coincide or a part is missing.

    Input: left_eye, right_eye, nose, lips, contour (arrays of x, y), box_width, box_height.
    """
    centers = df.withColumns({f"_{p}": centroid(F.col(p)) for p in ("left_eye", "right_eye", "nose", "lips")})
    le, re, n, m = (F.col(f"_{p}") for p in ("left_eye", "right_eye", "nose", "lips"))
    staged = centers.withColumns({
        "_eyes": distance(le, re),
        "_middle": F.struct(((le["x"] + re["x"]) / 2).alias("x"), ((le["y"] + re["y"]) / 2).alias("y")),
        "_xs": F.transform("lips", lambda p: p["x"]), "_outline": F.coalesce(F.size("contour"), F.lit(0)) > 0})
    eyes, middle, contour = F.col("_eyes"), F.col("_middle"), F.col("contour")
    first, last = F.try_element_at(contour, F.lit(1)), F.try_element_at(contour, F.lit(-1))
    part = lambda c: F.try_divide(c, eyes)
    ratios = F.array(
        part(distance(middle, n)), part(distance(middle, m)),
        F.when(F.col("_outline"), part(distance(n, last))).otherwise(1.2),
        part(F.array_max("_xs") - F.array_min("_xs")),
        F.when(F.col("_outline"), part(distance(first, last))).otherwise(2.0),
        F.col("box_height") / F.greatest(F.lit(0.01), F.col("box_width")))
    complete = (F.col("left_eye").isNotNull() & F.col("right_eye").isNotNull() & F.col("nose").isNotNull()
                & F.col("lips").isNotNull())
    return staged.select(*df.columns, F.when(complete & (eyes > 0.01), ratios).alias(name))


def square_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column,
                margin: float = 0.35) -> tuple[Column, Column, Column]:
    """Expand a normalised bottom-left box by a margin, clamp, then square it in pixels."""
    low_x, low_y = F.greatest(F.lit(0.0), x - w * margin), F.greatest(F.lit(0.0), y - h * margin)
    high_x, high_y = F.least(F.lit(1.0), x + w + w * margin), F.least(F.lit(1.0), y + h + h * margin)
    crop_x, crop_y = low_x * width, (1.0 - high_y) * height
    crop_w, crop_h = (high_x - low_x) * width, (high_y - low_y) * height
    side = F.greatest(crop_w, crop_h)
    left = F.greatest(F.lit(0.0), F.least(width - side, crop_x + crop_w / 2.0 - side / 2.0))
    top = F.greatest(F.lit(0.0), F.least(height - side, crop_y + crop_h / 2.0 - side / 2.0))
    return left, top, F.least(side, F.least(width - left, height - top))


def margin_crop(x: Column, y: Column, w: Column, h: Column, width: Column,
                height: Column) -> tuple[Column, Column, Column, Column]:
    """Inference crop: the longer side times 1.35 around the centre, clamped at the origin."""
    fw, fh = w * width, h * height
    side = F.greatest(fw, fh) * 1.35
    cx, cy = x * width + fw * 0.5, (1.0 - y - h) * height + fh * 0.5
    return (F.greatest(F.lit(0.0), cx - side * 0.5), F.greatest(F.lit(0.0), cy - side * 0.5),
            F.least(width, side), F.least(height, side))


def framing_message(mode: Column, face_h: Column, cx: Column, cy: Column, quality: Column, neck_x: Column,
                    neck_y: Column, root_x: Column, neck_conf: Column, root_conf: Column, ankle_l_conf: Column,
                    ankle_r_conf: Column, auto: bool = True) -> Column:
    """First message that applies; ``cy`` and ``neck_y`` keep their own axes (top-down, bottom-up)."""
    q = F.coalesce(quality, F.lit(0.6))
    ready = (lambda text: F.lit("Hold steady...") if auto else F.lit(text))
    grooming = (F.when(face_h.isNull(), "Position face inside oval")
                .when(q < 0.35, "Lighting too dark — face light source")
                .when(face_h < 0.22, "Move closer to fill oval").when(face_h > 0.68, "Step back slightly")
                .when((F.abs(cx - 0.5) > 0.14) | (F.abs(cy - 0.44) > 0.16), "Center face inside oval")
                .otherwise(ready("Perfect alignment")))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    body = neck_conf.isNotNull() | root_conf.isNotNull() | ankle_l_conf.isNotNull() | ankle_r_conf.isNotNull()
    aligned = ((none(neck_conf) > 0.25) & (none(root_conf) > 0.25)
               & F.coalesce(F.abs(neck_x - root_x) < 0.05, F.lit(False)))
    ankles = (none(ankle_l_conf) > 0.2) | (none(ankle_r_conf) > 0.2)
    outfit = (F.when(~body, "Step into silhouette guide")
              .when((none(neck_conf) > 0.25) & (neck_y > 0.90), "Step back to show head")
              .when(~ankles, "Step back to show shoes").when(~aligned, "Align upright in silhouette")
              .otherwise(ready("Full body aligned")))
    return F.when(mode == "grooming", grooming).otherwise(outfit)


def star(position: int, score: Column) -> Column:
    stars = score / 10.0 * 5.0
    return (F.when(F.lit(float(position)) <= stars, "star.fill")
            .when(F.lit(position - 0.5) <= stars, "star.leadinghalf.filled").otherwise("star"))
