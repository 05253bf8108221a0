"""Demographic, tier and stream routing; quality gates; label canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stitchwork.functions.text import clean_lower, contains_any, fixed, synonyms
from stitchwork.rules import routing as R


def resolve_demographic(gender: Column, age: Column) -> Column:
    g, a = clean_lower(gender), clean_lower(age)
    prefix = F.when(contains_any(g, R.FEMALE_WORDS), "Women").otherwise("Men")
    suffix = (F.when(contains_any(a, R.YOUNG_WORDS), "Under_35")
              .when(contains_any(a, R.OLD_WORDS), "Over_50").otherwise("35_to_50"))
    return F.concat_ws("_", prefix, suffix)


def tier_from_score(score: Column) -> Column:
    return (F.when(score >= 7.5, "3_Polished").when(score < 5.0, "1_Needs_Improvement")
            .otherwise("2_Average"))


def resolve_tier(text: Column, score: Column, variant: str = "sorter") -> Column:
    """Tier text first, score as the fallback.

    The batch variant has no "average" words, so a middling text falls
    through to the score.
    """
    t = F.replace(clean_lower(text), F.lit(" "), F.lit("_"))
    out = (F.when(contains_any(t, R.TIER_LOW_WORDS), "1_Needs_Improvement")
           .when(contains_any(t, R.TIER_HIGH_WORDS), "3_Polished"))
    if variant == "sorter":
        out = out.when(contains_any(t, R.TIER_MID_WORDS), "2_Average")
    return out.otherwise(tier_from_score(score))


def resolve_stream(focus: Column, shot: Column, path: Column, variant: str = "sorter") -> Column:
    sorter = variant == "sorter"
    path_words = R.SORTER_FACE_PATH_WORDS if sorter else R.BATCH_FACE_PATH_WORDS
    shot_words = R.SORTER_SHOT_WORDS if sorter else R.BATCH_SHOT_WORDS
    face = (contains_any(F.lower(path), path_words)
            | contains_any(clean_lower(focus), R.FACE_FOCUS_WORDS)
            | contains_any(clean_lower(shot), shot_words))
    return F.when(face, "Face_Grooming").otherwise("Outfit")


def heuristic_reason(size: Column, width: Column, height: Column, laplacian: Column) -> Column:
    """First failing quality reason, or ``ok``. A null width means unreadable."""
    short, long = F.least(width, height), F.greatest(width, height)
    aspect = long / F.greatest(short, F.lit(1))
    return (F.when(F.coalesce(size, F.lit(0)) == 0, "empty_file_0bytes")
            .when(width.isNull() | height.isNull(), "unreadable")
            .when(short < R.MIN_EDGE_PX, F.concat(F.lit("too_small_"), short.cast("string"), F.lit("px")))
            .when(aspect > R.MAX_ASPECT, F.concat(F.lit("bad_aspect_ratio_"), fixed(aspect, 2)))
            .when(laplacian < R.MIN_LAPLACIAN, F.concat(F.lit("blurry_laplacian_"), fixed(laplacian, 1)))
            .otherwise("ok"))


def passes_heuristic(size: Column, width: Column, height: Column, laplacian: Column) -> Column:
    """Whether ``heuristic_reason`` is ``ok``: the gates alone, no text. For filters, which the optimizer copies."""
    short, long = F.least(width, height), F.greatest(width, height)
    fails = ((F.coalesce(size, F.lit(0)) == 0) | width.isNull() | height.isNull() | (short < R.MIN_EDGE_PX)
             | (long / F.greatest(short, F.lit(1)) > R.MAX_ASPECT) | F.coalesce(laplacian < R.MIN_LAPLACIAN, F.lit(False)))
    return ~F.coalesce(fails, F.lit(False))


def framing_reason(width: Column, height: Column, min_width: Column, min_height: Column, orientation: Column,
                   white_corners: Column, laplacian: Column, min_aspect: Column | None = None,
                   max_aspect: Column | None = None, blur: float = R.MIN_LAPLACIAN) -> Column:
    """Per-query framing gate; null when the image passes."""
    aspect = height / width.cast("double")

    def bound(override: Column | None, which: int) -> Column:
        default = F.when(orientation == "portrait", R.ASPECT_WINDOWS["portrait"][which]).otherwise(
            R.ASPECT_WINDOWS["square"][which])
        if override is None:
            return default
        # A zero override means "not set", like a missing one.
        return F.coalesce(F.when(override != 0, override), default)

    low, high = bound(min_aspect, 0), bound(max_aspect, 1)
    portrait, square = orientation == "portrait", orientation == "square"
    return (F.when(width.isNull() | height.isNull(), "corrupt_or_unreadable")
            .when((width < min_width) | (height < min_height),
                  F.concat(F.lit("too_small_"), width.cast("string"), F.lit("x"), height.cast("string"),
                           F.lit("_need_"), min_width.cast("string"), F.lit("x"), min_height.cast("string")))
            .when(portrait & (aspect < low), F.concat(F.lit("outfit_not_full_body_aspect_"), fixed(aspect, 2),
                                                      F.lit("_need_ge_"), fixed(low, 2)))
            .when(portrait & (aspect > high), F.concat(F.lit("extreme_vertical_aspect_"), fixed(aspect, 2)))
            .when(portrait & white_corners, "pure_white_isolated_flatlay_or_cutout")
            .when(square & ((aspect < low) | (aspect > high)),
                  F.concat(F.lit("grooming_not_square_portrait_aspect_"), fixed(aspect, 2), F.lit("_need_"),
                           fixed(low, 2), F.lit("-"), fixed(high, 2)))
            .when(laplacian < blur, F.concat(F.lit("blurry_laplacian_"), fixed(laplacian, 1),
                                             F.lit(f"_below_{blur}"))))


def look_status(reason: Column, judged: Column, is_look: Column) -> Column:
    """Disposition of one record, cheapest gate first."""
    return (F.when(reason != "ok", F.concat(F.lit("rejected_heuristic_"), reason))
            .when(~judged, "rejected_vlm_failed")
            .when(~F.coalesce(is_look, F.lit(False)), "rejected_not_human")
            .otherwise("sorted"))


def reject_folder(status: Column) -> Column:
    return (F.when(status.startswith("rejected_heuristic"), "blurry_or_low_res")
            .when(status == "rejected_vlm_failed", "vlm_failed")
            .when(status == "rejected_not_human", "non_human_or_flatlay")
            .when(status == "rejected_routing_failed", "routing_failed")
            .when(status == "rejected", "quarantined_from_training"))


def canonical_garments(upper: Column, mid: Column, lower: Column, footwear: Column,
                       variant: str = "sorter") -> dict[str, Column]:
    """Judge spellings onto class names.

    The three slots are rewritten in order: a jacket in the upper slot may
    fill the mid slot, and trousers in the (new) mid slot may fill the lower
    one, so later steps read the earlier results.
    """
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    u = clean_lower(upper)
    jacket = u.isin(R.UPPER_JACKET_SPELLINGS)
    mid_1 = F.when(jacket & (blank(mid) | (mid == "none")), "blazer").otherwise(mid)
    upper_1 = F.when(jacket, "dress_shirt").otherwise(synonyms(u, R.UPPER_SYNONYMS, upper))
    m = clean_lower(mid_1)
    trousers = m.isin(R.MID_TROUSER_SPELLINGS)
    lower_1 = F.when(trousers & blank(lower), "tailored_trousers").otherwise(lower)
    mid_2 = (F.when(trousers, "none").when(m.isin(R.MID_JACKET_SPELLINGS), "blazer").otherwise(mid_1))
    table = dict(R.LOWER_SYNONYMS)
    if variant == "batch":
        table["tailored_trousers"] = table["tailored_trousers"] + R.BATCH_EXTRA_TROUSER_SPELLINGS
    return {
        "upper_type": upper_1,
        "mid_type": mid_2,
        "lower_type": synonyms(clean_lower(lower_1), table, lower_1),
        "footwear_type": synonyms(clean_lower(footwear), R.FOOTWEAR_SYNONYMS, footwear),
    }


def canonical_hair_styled(value: Column) -> Column:
    return F.when(value.isin("true", "1"), "1").when(value.isin("false", "0"), "0").otherwise(value)


def canonical_facial_hair(value: Column) -> Column:
    v = clean_lower(value)
    return (F.when(contains_any(v, ["shaven", "clean"]) | (v == "none"), "clean_shaven")
            .when(v.contains("stubble"), "stubble")
            .when(v.contains("beard"), F.when(v.contains("short"), "short_beard").otherwise("full_beard"))
            .otherwise(value))


def canonical_for_training(field: str, value: Column) -> Column:
    """The training loader's table: every value lower-cased, null stays null."""
    v = F.lower(F.btrim(value))
    out = None
    for spelling, target in R.LOADER_SYNONYMS.get(field, {}).items():
        out = F.when(v == spelling, target) if out is None else out.when(v == spelling, target)
    return v if out is None else out.otherwise(v)


def input_size(category: Column) -> tuple[Column, Column]:
    grooming = F.lower(category).contains("grooming")
    return (F.when(grooming, R.GROOMING_INPUT_SIZE[0]).otherwise(R.OUTFIT_INPUT_SIZE[0]),
            F.when(grooming, R.GROOMING_INPUT_SIZE[1]).otherwise(R.OUTFIT_INPUT_SIZE[1]))
