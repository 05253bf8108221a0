"""Pixel measurement of decoded images as one Arrow-batched job.

Spark partitions the images; NumPy measures one image at a time inside a
task. Only the measured numbers leave the task, never pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.functions.colour import harmony, sample_name, with_palette_name
from stitchwork.functions.text import fixed
from stitchwork.operators import pixel_kernels
from stitchwork.operators.pixel_kernels import MEASURES, measure_one
from stitchwork.rules import garments as G

# Executors receive the kernels with the task, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(pixel_kernels)

_RGB = ["r", "g", "b"]
SCHEMA = ("readable boolean, width int, height int, white_corners boolean, "
          + ", ".join(f"{m} double" for m in MEASURES))
SAMPLE_RECT = (0.35, 0.45, 0.65, 0.70)


def measure(images: DataFrame, key: str = "filename") -> DataFrame:
    """Measurements per image row with columns key, height, width, nChannels, data.

    Keep ``spark.sql.execution.arrow.maxRecordsPerBatch`` small (tens of
    rows) for megapixel images: a batch is decoded pixels.
    """
    torso, legs, rect = G.TORSO_BAND, G.LEGS_BAND, SAMPLE_RECT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{key: k, **measure_one(int(h), int(w), int(c), d, torso, legs, rect)} for k, h, w, c, d in zip(
                batch[key], batch["height"], batch["width"], batch["nChannels"], batch["data"])]
            yield pd.DataFrame(rows, columns=[key, "readable", "width", "height", "white_corners", *MEASURES])

    slim = images.select(key, "height", "width", "nChannels", "data")
    kind = images.schema[key].dataType.simpleString()
    return slim.mapInPandas(run, f"{key} {kind}, {SCHEMA}")


def with_color_names(measured: DataFrame) -> DataFrame:
    """Palette names and the spoken sample name, JVM-side from the measured centres."""
    out = measured
    for part in ("upper", "lower"):
        out = with_palette_name(out, *[F.col(f"{part}_{c}") for c in _RGB], f"measured_{part}_color")
    r, g, b = (F.col(f"sample_{c}") for c in _RGB)
    return out.withColumn("sample_color", F.when(r.isNotNull(), sample_name(r, g, b)))


def qa_reasons(category, laplacian, brightness, bottom_std):
    """Failing pixel gates of one image as an array of reasons."""
    low, high = G.BRIGHTNESS_RANGE
    t = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    return F.array_compact(F.array(
        F.when(laplacian < G.MIN_BLUR_VARIANCE, t("blurry(var=", fixed(laplacian, 1), ")")),
        F.when(~brightness.between(low, high), t("brightness_out_of_range(", fixed(brightness, 0), ")")),
        F.when(category.endswith("Outfit") & (bottom_std < G.FEET_BAND_STD_MIN),
               t("possible_cropped_feet(std=", fixed(bottom_std, 1), ")"))))


def qa_rows(labels: DataFrame, measured: DataFrame, key: str = "filename") -> DataFrame:
    """Annotate label rows with measured colours and QA; no row is ever dropped.

    A label without an image is ``image_file_missing``, one whose image did
    not decode is ``unreadable_image``; both fail.
    """
    m = measured.select(key, "readable", "laplacian", "brightness", "bottom_std", "measured_upper_color",
                        "measured_lower_color")
    j = labels.join(m, key, "left")
    outfit = F.col("category").endswith("Outfit") & F.coalesce("readable", F.lit(False))
    upper, lower = F.col("measured_upper_color"), F.col("measured_lower_color")
    asked = F.coalesce("requested_lower_color", F.lit(""))
    match = lambda a, b: F.coalesce(a == b, F.lit(False))
    reasons = qa_reasons(F.col("category"), F.col("laplacian"), F.col("brightness"), F.col("bottom_std"))
    text = (F.when(F.col("readable").isNull(), "image_file_missing").when(~F.col("readable"), "unreadable_image")
            .otherwise(F.array_join(reasons, ";")))
    return j.select(
        *labels.columns, F.when(outfit, upper).alias("measured_upper_color"),
        F.when(outfit, lower).alias("measured_lower_color"),
        F.when(outfit, match(upper, F.col("requested_upper_color")).cast("int")).alias("color_match_upper"),
        F.when(outfit, (~asked.isin("", "none") & match(lower, asked)).cast("int")).alias("color_match_lower"),
        F.when(outfit, harmony(upper, lower)).alias("color_harmony"), (text == "").cast("int").alias("qa_pass"),
        text.alias("qa_reasons"), F.col("readable").isNull().alias("image_missing"))
