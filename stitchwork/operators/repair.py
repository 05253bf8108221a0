"""Judge answers to label edits: corrections and salvage plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.functions.labels import positive, severity
from stitchwork.rules import garments as G

# Edited columns per correction bucket.
TIER_BUCKETS = {"facial_hair_texture": ("facial_hair_untidy", "facial_hair_groomed"),
                "eyebrows": ("eyebrows_unkempt", "eyebrows_groomed"),
                "skin_condition": ("skin_neglected", "skin_healthy"),
                "makeup": ("makeup_uneven", "makeup_flawless"),
                "fabric_wrinkled_miss": ("fabric_wrinkled", "fabric_crisp")}
PATTERN_BUCKETS = ["pattern_miss", "pattern_solid_bleed"]
STYLE_BUCKETS = ["facial_hair_style_miss", "clean_shaven_residual"]
FOOTWEAR = sorted({c for who in ("man", "woman") for c in G.classes_of(who, "footwear")})


def _edit(column: str, value: Column) -> Column:
    return F.struct(F.lit(column).alias("column"), value.cast("string").alias("new_value"))


def _style_edits() -> Column:
    style, tier = F.col("actual_style"), F.col("actual_tier")
    shaven = style == "clean_shaven"
    bearded = style.isin(G.FACIAL_HAIR_STYLES[1:]) & tier.isin(G.TIERS)
    return (F.when(shaven, F.array(_edit("facial_hair_style", style), _edit("facial_hair_untidy", F.lit(0)),
                                   _edit("facial_hair_groomed", F.lit(0))))
            .when(bearded, F.array(_edit("facial_hair_style", style), _edit("facial_hair_untidy", severity(tier)),
                                   _edit("facial_hair_groomed", positive(tier)))))


def edits_for(bucket: str) -> Column:
    """Array of (column, new_value) of one judged row, null or empty when unusable."""
    tier = F.col("actual_tier")
    if bucket in PATTERN_BUCKETS:
        ok = lambda c: F.when(F.col(c).isin(G.PATTERNS), _edit(c, F.col(c)))
        return F.array_compact(F.array(ok("upper_pattern"), ok("lower_pattern")))
    if bucket in TIER_BUCKETS:
        bad, good = TIER_BUCKETS[bucket]
        return F.when(tier.isin(G.TIERS), F.array(_edit(bad, severity(tier)), _edit(good, positive(tier))))
    if bucket == "hair_length_grooming":
        value = F.col("actual_hair_length")
        return F.when(value.isin(G.HAIR_LENGTHS), F.array(_edit("hair_length", value)))
    if bucket in ("footwear_type_men", "footwear_type_women"):
        value = F.col("actual_footwear_type")
        return F.when(value.isin(FOOTWEAR), F.array(_edit("footwear_type", value)))
    if bucket in STYLE_BUCKETS:
        return _style_edits()
    if bucket == "fit_miss":
        way = F.col("actual_direction")
        level = lambda side: F.when(way == side, severity(tier)).otherwise(0)
        return F.when(way.isin("baggy", "tight", "neutral") & tier.isin(G.TIERS), F.array(
            _edit("fit_baggy", level("baggy")), _edit("fit_tight", level("tight")),
            _edit("fit_tailored", positive(tier))))
    raise ValueError(f"{bucket} has no correction rule")


def edits_by_bucket(bucket: Column, buckets: list[str]) -> Column:
    """The edits of the bucket a row is in; of a salvage those of the copy, which a false alarm doesn't get."""
    found = lambda b: (F.when(F.col("actual_style") != "clean_shaven", _style_edits()) if b == "clean_shaven_salvage"
                       else edits_for(b))
    return F.coalesce(*[F.when(bucket == b, found(b)) for b in buckets])


def corrections(judged: DataFrame, bucket: str) -> DataFrame:
    """Long (filename, column, new_value) of the usable answers."""
    return judged.select("filename", F.explode(edits_for(bucket)).alias("_e")).select(
        "filename", "_e.column", "_e.new_value")


def skipped(judged: DataFrame, bucket: str) -> DataFrame:
    usable = F.coalesce(F.size(edits_for(bucket)), F.lit(0)) > 0
    return judged.agg(F.count_if(usable).alias("usable"), F.count_if(~usable).alias("skipped"))


def salvage_plan(judged: DataFrame) -> DataFrame:
    """no_op for a false alarm, salvage for a clear other style, discard for the rest."""
    style = F.col("actual_style")
    clear = style.isin(G.FACIAL_HAIR_STYLES[1:]) & F.col("actual_tier").isin(G.TIERS)
    action = (F.when(style == "clean_shaven", "no_op").when(F.coalesce(clear, F.lit(False)), "salvage")
              .otherwise("discard"))
    return judged.withColumn("action", action)


def salvage_edits(planned: DataFrame) -> DataFrame:
    return planned.where(F.col("action") == "salvage").select(
        "filename", F.explode(_style_edits()).alias("_e")).select("filename", "_e.column", "_e.new_value")
