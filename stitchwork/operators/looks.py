"""Rule scoring of a look, merging of two evaluations, suggestion lists, old-record defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.functions.advice import canonical_occasion, isolate_domain_app
from stitchwork.functions.text import contains_any, first_rule, literals, lookup
from stitchwork.rules import advice as A


def _suggestion(category: str, icon: str, color: str, title: str, text: str, effort: str) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(icon).alias("icon"), F.lit(color).alias("color"),
                    F.lit(title).alias("title"), F.lit(text).alias("recommendation"), F.lit(effort).alias("effort"),
                    F.lit(0.5).alias("impact"))


def headline(score: Column) -> Column:
    out = None
    for floor, name in A.HEADLINES:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.otherwise(A.HEADLINE_DEFAULT)


def _profile(occasion: Column, which: int) -> Column:
    return lookup(occasion, {k: v[which] for k, v in A.OCCASION_PROFILES.items()})


def _seen(classes: Column, words: list[str], above: float) -> Column:
    return F.exists(classes, lambda c: contains_any(F.lower(c["label"]), words) & (c["confidence"] > above))


def potential(score: Column, suggestions: Column, floor: float = 0.0) -> Column:
    """Score plus the impact of the first five suggestions, capped at 9.8."""
    impact = F.aggregate(F.slice(suggestions, 1, 5), F.lit(0.0), lambda acc, s: acc + s["impact"])
    return F.least(F.lit(9.8), score + F.greatest(F.lit(floor), impact))


def analyze(looks: DataFrame) -> DataFrame:
    """Score one look per row from detections.

    Input columns: occasion, face_w, face_h, quality, neck_x, root_x,
    neck_conf, root_conf, classes (array of label, confidence), color.
    A null face or quality means none was detected.
    """
    t = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    lit = lambda c: F.coalesce(c, F.lit(False))
    occasion, face = F.col("occasion"), F.col("face_h").isNotNull()
    name = _profile(occasion, 0)
    quality = F.coalesce("quality", F.lit(0.7))
    clarity = F.when(F.col("quality").isNotNull(), F.floor(quality * 100)).otherwise(70).cast("int")
    bright, soft = quality >= 0.65, (quality < 0.65) & (quality >= 0.45)
    dim = quality < 0.45
    ratio = F.col("face_h") / F.greatest(F.lit(0.01), F.col("face_w"))
    long_face, round_face = lit(ratio > 1.35), lit(ratio < 1.15)
    body = lit((F.col("neck_conf") > 0.3) & (F.col("root_conf") > 0.3))
    upright = body & lit(F.abs(F.col("neck_x") - F.col("root_x")) < 0.04)
    lean = body & ~upright
    classes = F.coalesce("classes", F.array().cast("array<struct<label:string,confidence:double>>"))
    beard, eyewear = _seen(classes, A.BEARD_CLASSES, 0.25), _seen(classes, A.EYEWEAR_CLASSES, 0.3)
    formal, casual_seen = _seen(classes, A.FORMAL_CLASSES, 0.25), _seen(classes, A.CASUAL_CLASSES, 0.25)
    casual = ~formal & casual_seen
    expected = occasion.isin(A.FORMAL_OCCASIONS)
    under = casual & expected
    penalty = _profile(occasion, 4) * 0.4
    plus = lambda cond, amount: F.when(cond, amount).otherwise(0.0)

    base = (_profile(occasion, 1) + plus(bright, 0.4) - plus(dim, 0.5) + plus(upright, 0.5)
            + plus(formal, 0.5) + plus(formal & expected, 0.3) - F.when(under, penalty).otherwise(0.0))
    posture = F.when(upright, 8.2).when(lean, 6.2).otherwise(_profile(occasion, 2))
    fit = (F.when(formal, 8.4).when(under, F.greatest(F.lit(5.8), 6.8 - penalty * 0.5)).when(casual, 7.6)
           .otherwise(7.2))
    groom = F.lit(7.5) + plus(bright, 0.6) - plus(dim, 0.8) + plus(beard, 0.3)
    color = F.coalesce("color", F.lit("Neutral tone"))
    dark = contains_any(color, ["Dark", "Black", "Navy"])
    light = ~dark & contains_any(color, ["Light", "White"])
    pct = clarity.cast("string")

    good = F.array_compact(F.array(
        t("Evaluated against ", name, " standards (baseline: ", F.format_string("%.1f", _profile(occasion, 1)), "/10)."),
        F.when(bright, t("Well-lit portrait with minimal shadow and crisp sharpness (", pct, "% clarity).")),
        F.when(face, "Clear face detection with well-centered framing."),
        F.when(upright, "Upright, aligned posture projects confidence and authority."),
        F.when(~long_face & ~round_face,
               "Balanced oval face shape – most hairstyles and frame shapes suit your proportions well."),
        F.when(eyewear, "Eyewear detected – adds structure and visual interest to the eye region."),
        F.when(formal, "Structured, formal attire with a strong collar and lapel outline."),
        F.when(formal & expected, t("Outfit is well-matched for the occasion (", name, ").")),
        F.when(casual & ~expected, t("Relaxed, appropriate casual outfit for ", name, ".")),
        F.when(dark, t("Dark ", F.lower(color), " top creates high contrast against skin tones, sharpening facial features.")),
        F.when(light, "Light/white top reflects flattering illumination toward the face, brightening the overall look.")))
    bad = F.array_compact(F.array(
        F.when(soft, t("Lighting slightly flat or soft – ideal clarity score is 65%+, yours is ", pct, "%.")),
        F.when(dim, t("Poor lighting conditions — photo appears dark or backlit (", pct, "% clarity). Reshoot near natural light.")),
        F.when(~face, "No clear face detected – ensure your face is visible and well-framed."),
        F.when(lean, "Slight postural lean detected – shoulders appear uneven."),
        F.when(round_face, "Round/Square face shape benefits from vertical height – avoid flat, wide hair styles."),
        F.when(under, t("Casual outfit may be underdressed for ", name, ". Consider adding a blazer."))))
    bad = F.when(F.size(bad) == 0, F.array(F.lit(
        "No major issues detected – see the 5-min tweaks below for polishing details."))).otherwise(bad)
    s = _suggestion
    suggestions = F.array_compact(F.array(
        F.when(soft, s("Lighting", "sun.max.fill", "yellow", "Face a Natural Light Source",
                       "Turn toward a window or soft lamp at 45° to your face. Avoid harsh overhead or direct sunlight.",
                       "10 sec")),
        F.when(dim, s("Lighting", "sun.max.fill", "yellow", "Move to Better Light Immediately",
                      "Face a window or turn on a lamp behind your phone. Avoid backlighting.", "15 sec")),
        F.when(~upright, s("Posture & Angle", "figure.walk", "teal", "Straighten Posture & Roll Shoulders",
                           "Pull shoulder blades gently down and back, lifting chest slightly for a confident silhouette.",
                           "5 sec")),
        F.when(~upright, s("Angle", "arrow.triangle.2.circlepath", "teal", "Turn Shoulders 15° for Depth",
                           "Rotate body slightly while keeping face forward for a slimmer, more dynamic silhouette.",
                           "5 sec")),
        F.when(face, s("Chin & Jawline", "arrow.up.and.down.and.sparkles", "green",
                       "Extend Chin Forward & Slightly Down",
                       "Push ears slightly forward and lower chin ~5° to sharpen the jawline and remove under-chin softness.",
                       "5 sec")),
        F.when(round_face, s("Hairstyle", "comb.fill", "orange", "Add Height on Top or High Part",
                             "A higher side part or slight volume on top creates an elongating effect.", "1 min")),
        F.when(long_face, s("Hairstyle", "comb.fill", "orange", "Keep Sides Full, Avoid Extra Height",
                            "Side volume and textured layers balance an elongated face.", "1 min")),
        F.when(beard, s("Beard Lineup", "scissors", "brown", "Define Neckline Two Fingers Above Adam's Apple",
                        "A sharp, clean neckline at this height instantly sculpts the jawline.", "2 mins"))
        .otherwise(s("Grooming", "comb.fill", "orange", "Tame Flyaways with Matte Paste",
                     "A pea-sized amount of matte paste keeps your silhouette sharp under bright light.", "30 sec")),
        F.when(eyewear, s("Glasses Position", "eyeglasses", "blue", "Align Bridge: Pupils in Upper Lens Third",
                          "Slide frames slightly up so your pupils sit in the upper third of each lens.", "10 sec")),
        F.when(formal, s("Collar & Lapel", "tshirt.fill", "purple", "Straighten Collar Points & Center Lapels",
                         "Check that shirt collar points lie flat under jacket lapels without curling.", "30 sec")),
        F.when(formal, s("Shirt Tuck", "arrow.down.to.line", "purple", "Tuck Shirt Neatly (Military Tuck)",
                         "Pinch excess fabric at the side seams and fold backward before buckling your belt.", "30 sec")),
        F.when(formal, s("Accessories", "watch.analog", "blue", "Align Watch & Cuff Length",
                         "Show 1/4 to 1/2 inch of shirt cuff below your jacket sleeve.", "10 sec")),
        F.when(under, s("Outfit Upgrade", "tshirt.fill", "red", "Add a Blazer or Structured Jacket",
                        "A navy or grey blazer over almost any outfit instantly elevates the look by 2–3 points.",
                        "2 mins")),
        F.when(casual & ~expected, s("Casual Layering", "tshirt.fill", "purple", "Layer for Depth & Dimension",
                                     "An open overshirt or unzipped jacket adds visual structure and broadens the shoulder frame.",
                                     "2 mins")),
        F.when(~formal & ~casual_seen, s("Outfit Framing", "tshirt.fill", "purple", "Check Neckline & Shoulder Fit",
                                         "Ensure your top's neckline sits clean and the shoulders align to your actual shoulder line.",
                                         "1 min"))))
    clamp = lambda c: F.least(F.lit(9.8), F.greatest(F.lit(5.5), c))
    scored = looks.select("*", F.greatest(F.lit(6.5), F.least(F.lit(9.8), base)).alias("score"),
                          suggestions.alias("suggestions"))
    return scored.select(
        "*", potential(F.col("score"), F.col("suggestions")).alias("potential_score"),
        headline(F.col("score")).alias("headline"), good.alias("good_points"), bad.alias("bad_points"),
        F.when(long_face, "Elongated / Oblong").when(round_face, "Round / Square").otherwise("Balanced Oval")
        .alias("face_shape"),
        clarity.alias("lighting_score"), clamp(posture).alias("posture_score"), clamp(fit).alias("fit_score"),
        clamp(groom).alias("grooming_score"),
        F.when(upright, "Aligned spine & upright shoulders").when(lean, "Slight lateral lean / slouch")
        .otherwise("Balanced posture").alias("posture_note"),
        F.when(formal, "Collar aligned & crisp lapels").when(under, "Relaxed / under-structured")
        .when(casual, "Clean casual fit").otherwise("Standard proportion").alias("fit_note"),
        F.when(formal & expected, "Executive & Formal").when(under, "Too informal for occasion")
        .when(casual, "Versatile Everyday").otherwise("Cohesive color palette").alias("style_note"))


def tweak_impact(category: Column) -> Column:
    return first_rule(F.lower(category), A.TWEAK_IMPACT, A.TWEAK_IMPACT_DEFAULT)


def tweak_icon(category: Column) -> Column:
    return first_rule(F.lower(category), A.TWEAK_ICONS, A.TWEAK_ICON_DEFAULT)


def tweak_color(category: Column) -> Column:
    return first_rule(F.lower(category), A.TWEAK_COLORS, A.TWEAK_COLOR_DEFAULT)


def _merge_points(primary: Column, local: Column, keep: int) -> Column:
    """Primary points, then local ones whose first 20 characters open no point taken so far."""
    start = F.coalesce(primary, F.array().cast("array<string>"))
    merged = F.aggregate(local, start, lambda acc, p: F.when(
        F.exists(acc, lambda q: q.startswith(F.substring(p, 1, 20))), acc).otherwise(F.concat(acc, F.array(p))))
    return F.slice(merged, 1, keep)


def merge_evaluations(rows: DataFrame) -> DataFrame:
    """Judge evaluation (``judge`` struct) over the local one (``local`` struct).

    judge: score, headline, sharpness, formality, occasion_match, good_points, improvement_points,
    tweaks (array of category, title, recommendation, effort), posture_note, fit_note, style_note.
    """
    judge, local = F.col("judge"), F.col("local")
    tweaks = F.transform(judge["tweaks"], lambda w: F.struct(
        w["category"].alias("category"), tweak_icon(w["category"]).alias("icon"),
        tweak_color(w["category"]).alias("color"), w["title"].alias("title"),
        w["recommendation"].alias("recommendation"), w["effort"].alias("effort"),
        tweak_impact(w["category"]).alias("impact")))
    taken = F.transform(judge["tweaks"], lambda w: F.lower(w["category"]))
    others = F.filter(local["suggestions"], lambda x: ~F.array_contains(taken, F.lower(x["category"])))
    combined = F.concat(tweaks, F.slice(others, 1, 2))
    return rows.select(
        *[c for c in rows.columns if c not in ("judge", "local")], judge["score"].alias("score"),
        potential(judge["score"], combined, floor=0.4).alias("potential_score"), judge["headline"].alias("headline"),
        _merge_points(judge["good_points"], local["good_points"], 4).alias("good_points"),
        _merge_points(judge["improvement_points"], local["bad_points"], 4).alias("bad_points"),
        F.slice(combined, 1, 6).alias("suggestions"), judge["sharpness"].alias("posture_score"),
        judge["formality"].alias("fit_score"), judge["occasion_match"].alias("grooming_score"),
        judge["posture_note"].alias("posture_note"), judge["fit_note"].alias("fit_note"),
        judge["style_note"].alias("style_note"))


def suggest(rows: DataFrame) -> DataFrame:
    """Suggestion list from prediction attributes.

    Input columns: category, occasion, score and the attribute columns the
    rules read; a null attribute matches no rule.
    """
    col = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    is_ = lambda c, v: F.coalesce(col(c).cast("string") == v, F.lit(False))
    level = lambda c: F.coalesce(col(c).cast("int"), F.lit(0)) > 0
    category, score = F.col("category"), F.col("score")
    grooming = category.contains("Grooming")
    dinner = canonical_occasion(F.col("occasion"), "app").contains("Dinner")
    canvas = F.coalesce(col("footwear_type").cast("string").contains("canvas"), F.lit(False))
    groom_lines = F.array_compact(F.array(
        F.when(is_("hair_styled", "0"), A.SUGGEST_HAIR_STYLED), F.when(level("hair_untidy"), A.SUGGEST_HAIR_UNTIDY),
        F.when(is_("facial_hair_groomed", "0"), A.SUGGEST_BEARD),
        F.when(is_("eyebrows_groomed", "0"), A.SUGGEST_EYEBROWS), F.when(score >= 8.0, A.SUGGEST_HYDRATE)))
    outfit_lines = F.array_compact(F.array(
        F.when(level("fabric_wrinkled"), A.SUGGEST_STEAM), F.when(level("footwear_worn"), A.SUGGEST_FOOTWEAR),
        F.when(is_("upper_type", "plain_crewneck_tee") & dinner, A.SUGGEST_LAYER), F.when(canvas, A.SUGGEST_SWAP),
        F.when(score >= 8.0, A.SUGGEST_BREAK)))
    candidates = F.when(grooming, groom_lines).otherwise(outfit_lines)
    staged = rows.withColumn("_lines", isolate_domain_app(category, candidates, score))

    def shape(line: Column, i: Column) -> Column:
        low = F.lower(line)
        group = F.coalesce(first_rule(low, A.SUGGESTION_GROUPS, None),
                           F.when(grooming, "Grooming Polish").otherwise("Outfit Silhouette"))
        return F.struct(group.alias("category"),
                        F.coalesce(lookup(group, A.SUGGESTION_ICONS), F.lit("sparkle")).alias("icon"),
                        first_rule(low, A.SUGGESTION_TITLES, A.SUGGESTION_TITLE_DEFAULT).alias("title"),
                        line.alias("recommendation"),
                        F.concat((i * 2 + 2).cast("string"), F.lit(" min")).alias("effort"), F.lit(0.4).alias("impact"))
    return staged.withColumn("suggestions", F.transform("_lines", shape)).drop("_lines")


def look_defaults(looks: DataFrame) -> DataFrame:
    """Fill what old look records lack, from their score."""
    s = F.col("score")
    fill = {"potential_score": F.least(F.lit(9.8), s + 0.8), "posture_score": s * 0.9, "fit_score": s * 0.95,
            "grooming_score": s * 0.92, "posture_note": F.lit("Balanced posture"),
            "fit_note": F.lit("Good proportion"), "style_note": F.lit("Cohesive look")}
    return looks.withColumns({c: F.coalesce(F.col(c), d) if c in looks.columns else d for c, d in fill.items()})


def default_tags(occasion: Column) -> Column:
    return lookup(occasion, {k: literals(v) for k, v in A.DEFAULT_TAGS.items()})
