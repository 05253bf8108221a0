"""Label values: scores, targets, masks, severities, file names, corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stitchwork.functions.text import half_even, literals, lookup
from stitchwork.rules import garments as G

FILENAME_PATTERN = r"^\d{5,}_(.+?)_(flaw_severe|flaw_mild|average|polished)\.png$"


def rescale_score(score: Column) -> Column:
    """Scores on a 20-point scale are halved, then everything is clamped to 1..10."""
    halved = F.when((score > 10.0) & (score <= 20.0), score / 2.0).otherwise(score)
    return F.when(score.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(10.0), halved)))


def tier_midpoint(tier: Column) -> Column:
    return half_even(lookup(tier, {t: (lo + hi) / 2.0 for t, (lo, hi) in G.REAL_TIER_RANGES.items()}), 1)


def score_or_midpoint(annotated: Column, mapped: Column, tier: Column) -> Column:
    return F.coalesce(annotated, mapped, tier_midpoint(tier))


def encode_target(field: dict, raw: Column) -> Column:
    """Raw label text to a training target; unknown classes fall to 0."""
    if field["type"] == "regression":
        return raw.try_cast("double")
    if field["type"] == "ordinal":
        return raw.try_cast("double").cast("int").cast("double")
    position = F.array_position(literals(field["classes"]), F.coalesce(raw, F.lit("")))
    return F.greatest(position - 1, F.lit(0)).cast("double")


def default_blank(field: dict, raw: Column) -> Column:
    blank = F.coalesce(raw, F.lit("")) == ""
    return F.when(blank, 0.0).otherwise(encode_target(field, raw))


def target_and_mask(field: dict, value: Column, score: Column) -> tuple[Column, Column]:
    """Score is always supervised; a class head only where its value is a known class."""
    if field["name"] == "score":
        return score, F.lit(1.0)
    if field["type"] == "categorical":
        position = F.coalesce(F.array_position(literals(field["classes"]), value), F.lit(0))
        known = position > 0
        return F.when(known, (position - 1).cast("double")).otherwise(0.0), F.when(known, 1.0).otherwise(0.0)
    return F.lit(0.0), F.lit(0.0)


def severity(tier: Column) -> Column:
    return lookup(tier, G.SEVERITY)


def positive(tier: Column) -> Column:
    return F.when(tier == "polished", 1).otherwise(0)


def formality_tier(mean: Column) -> Column:
    return (F.when(mean < 1.0, "casual").when(mean < 2.0, "smart_casual").when(mean < 2.75, "business")
            .otherwise("formal"))


def mean_worn(formalities: list[Column]) -> Column:
    """Mean over the worn slots; a null slot is not worn."""
    worn = F.array_compact(F.array(*formalities))
    return F.aggregate(worn, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(worn)


def task_filename(index: Column, category: Column, tier: Column) -> Column:
    return F.format_string("%05d_%s_%s.png", index, category, tier)


def filename_index(name: Column) -> Column:
    """Index before the first underscore: five digits, more from 100,000 on."""
    return F.regexp_extract(name, r"^(\d{5,})_", 1).try_cast("bigint")


def filename_category(name: Column) -> Column:
    found = F.regexp_extract(name, FILENAME_PATTERN, 1)
    return F.when(found != "", found)


def filename_tier(name: Column) -> Column:
    found = F.regexp_extract(name, FILENAME_PATTERN, 2)
    return F.when(found != "", found)


def content_key(content: Column) -> Column:
    """Short display name of a content. Equality is decided on ``content_digest``."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def content_digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def pooled_tier_counts(total: Column) -> dict[str, Column]:
    """1/6, 1/6, 1/3, 1/3 of a total; the remainder goes to average."""
    base = F.floor(total / 6).cast("long")
    return {"flaw_severe": base, "flaw_mild": base, "average": total - base * 4, "polished": base * 2}
