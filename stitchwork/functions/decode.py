"""Prediction decoding, calibration, losses, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stitchwork.functions.text import half_even, literals
from stitchwork.rules.advice import SIGNATURE_WEIGHTS

LOW_CONFIDENCE = 0.45
CALIBRATED_SCORE = 7.2


def argmax(probs: Column) -> Column:
    """Zero-based position of the largest entry, the first on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def runner_up(probs: Column) -> Column:
    """Zero-based position of the second in descending order; on ties the higher position comes first."""
    ranked = F.transform(probs, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    return F.try_element_at(F.sort_array(ranked, asc=False), F.lit(2))["i"]


def decode_head(probs: Column, classes: list[str] | None = None) -> Column:
    """Top class, confidence, low-confidence flag, runner-up and distribution of one head."""
    top, second = argmax(probs), runner_up(probs)
    confidence = F.array_max(probs)
    name = lambda i: (i.cast("string") if classes is None
                      else F.coalesce(F.try_element_at(literals(classes), i + 1), i.cast("string")))
    parts = [top.alias("top_index"), name(top).alias("prediction"), half_even(confidence, 3).alias("confidence"),
             (confidence < LOW_CONFIDENCE).alias("is_low_confidence"), name(second).alias("runner_up"),
             half_even(F.try_element_at(probs, second + 1), 3).alias("runner_up_confidence")]
    if classes is not None:
        size = F.least(F.size(probs), F.lit(len(classes)))
        parts.append(F.map_from_arrays(F.slice(literals(classes), F.lit(1), size),
                                       F.transform(F.slice(probs, F.lit(1), size), lambda p: half_even(p, 3)))
                     .alias("distribution"))
    return F.struct(*parts)


def active_defect(category: Column, attrs: dict[str, Column], variant: str = "script") -> Column:
    """Any flaw that keeps a look out of the top tier; the app checks fewer fields."""
    flag = lambda f: F.coalesce(attrs[f].cast("int"), F.lit(0)) > 0 if f in attrs else F.lit(False)
    is_ = lambda f, v: F.coalesce(attrs[f] == v, F.lit(False)) if f in attrs else F.lit(False)
    style = F.coalesce(attrs["facial_hair_style"], F.lit("clean_shaven")) if "facial_hair_style" in attrs else F.lit(
        "clean_shaven")
    if variant == "app":
        raw_style = attrs.get("facial_hair_style", F.lit(None).cast("string"))
        not_shaven = F.coalesce(raw_style != "clean_shaven", F.lit(True))
        grooming = (is_("hair_styled", "0") | flag("hair_untidy") | (is_("facial_hair_groomed", "0") & not_shaven))
        outfit = flag("fabric_wrinkled") | flag("styling_sloppy") | flag("footwear_worn")
    else:
        grooming = ((~style.isin("clean_shaven", "none") & is_("facial_hair_groomed", "0"))
                    | is_("hair_styled", "0") | flag("hair_untidy") | flag("skin_neglected")
                    | flag("eyebrows_unkempt") | flag("makeup_uneven"))
        outfit = flag("fabric_wrinkled") | flag("styling_sloppy") | flag("footwear_worn") | flag("fit_baggy")
    return F.when(category.contains("Grooming"), grooming).otherwise(outfit)


def calibrate(score: Column, defect: Column) -> Column:
    return F.when(defect & (score >= 7.5), CALIBRATED_SCORE).otherwise(score)


def tier_name(score: Column, variant: str = "script") -> Column:
    lowest = "1_Needs_Improvement" if variant == "script" else "1_NeedsImprovement"
    return F.when(score >= 7.5, "3_Polished").when(score >= 5.0, "2_Average").otherwise(lowest)


def tier_label(score: Column) -> Column:
    return (F.when(score >= 7.5, "Polished & Sharp").when(score >= 5.0, "Average / Baseline Everyday")
            .otherwise("Needs Improvement / Poor Execution"))


def ordinal_text(index: Column) -> Column:
    return F.element_at(literals(["Absent", "Mild / Present", "Severe"]), F.least(index, F.lit(2)).cast("int") + 1)


def yes_no_text(prediction: Column) -> Column:
    return (F.when(prediction == "1", "Yes / Sharp").when(prediction == "0", "No").otherwise(prediction))


def smooth_l1(predicted: Column, target: Column) -> Column:
    gap = F.abs(predicted - target)
    return F.when(gap < 1.0, gap * gap * 0.5).otherwise(gap - 0.5)


def cross_entropy(logits: Column, target: Column) -> Column:
    """log-sum-exp minus the target logit, shifted by the maximum."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
    return F.log(total) + top - F.element_at(logits, target.cast("int") + 1).cast("double")


def boundary_weight(target: Column, weight: float) -> Column:
    return F.when((target < 5.0) | (target > 8.5), weight).otherwise(1.0)


def signature_similarity(a: Column, b: Column, weights: list[float] | None = None) -> Column:
    """1 - 2.5 * mean weighted L1 gap, clamped to 0..1."""
    weights = weights or SIGNATURE_WEIGHTS
    gaps = F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))),
                      literals(weights), lambda d, w: d * w)
    mean = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x) / float(len(weights))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - mean * 2.5))
