"""Photo and portrait classifiers, and coded demographics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.functions.text import contains_any, has_word, literals
from stitchwork.rules import photos as P


def classify_descriptions(df: DataFrame, description: str, name: str = "category") -> DataFrame:
    """Add the portrait class of a description, null for low quality text.

    Single words are found in one cut of the text into words; only phrases
    need a pattern, and only where their letters occur at all.
    """
    single = {n: [w for w in words.split("|") if w.isalnum()] for n, words in P.DESCRIPTION_FLAGS.items()}
    phrases = {n: [w for w in words.split("|") if not w.isalnum()] for n, words in P.DESCRIPTION_FLAGS.items()}
    every = sorted({w for ws in single.values() for w in ws})

    def flag_of(n: str) -> Column:
        hit = F.arrays_overlap("_hits", literals(single[n])) if single[n] else F.lit(False)
        if not phrases[n]:
            return hit
        return hit | (contains_any("_t", phrases[n]) & has_word(F.col("_t"), "|".join(phrases[n])))

    cut = F.split("_t", "[^\\p{L}\\p{M}\\p{N}\\p{Pc}]+")
    staged = (df.withColumn("_t", F.lower(description)).withColumn("_hits", F.array_intersect(cut, literals(every)))
              .withColumns({**{f"_{n}": flag_of(n) for n in P.DESCRIPTION_FLAGS},
                            "_elder": contains_any("_t", ["senior", "elderly"])}))
    flag = {n: F.col(f"_{n}") for n in P.DESCRIPTION_FLAGS}
    old = flag["gray"] | F.col("_elder")
    men = (F.when(old, "face_men_o50_distinguished")
           .when(flag["mature"], F.when(flag["beard"], "face_men_35_50_beard")
                 .when(flag["bald"], "face_men_35_50_balding").when(flag["formal"], "face_men_35_50_formal")
                 .otherwise("face_men_35_50_portrait"))
           .when(flag["beard"], "face_men_u35_beard_styled").when(flag["bald"], "face_men_u35_hair_thinning")
           .when(flag["styled"] & flag["smile"], "face_men_u35_hair_styled")
           .when(flag["formal"], "face_men_u35_formal").when(flag["smile"], "face_men_u35_smile_clean")
           .otherwise("face_men_u35_portrait_neutral"))
    women = (F.when(old, "face_women_o50_distinguished")
             .when(flag["mature"], F.when(flag["formal"] | flag["makeup"], "face_women_35_50_polished")
                   .otherwise("face_women_35_50_portrait"))
             .when(flag["makeup"] & flag["styled"], "face_women_u35_polished_glam")
             .when(flag["styled"] & flag["formal"], "face_women_u35_formal")
             .when(flag["styled"], "face_women_u35_hair_styled")
             .when(flag["smile"], "face_women_u35_smile_natural").otherwise("face_women_u35_portrait_neutral"))
    category = (F.when(contains_any("_t", P.LOW_QUALITY_PHRASES), None)
                .when(flag["male"] & ~flag["female"], men).when(flag["female"] & ~flag["male"], women)
                .when(flag["glasses"], "face_portrait_eyeglasses").when(flag["formal"], "face_portrait_formal")
                .otherwise("face_portrait_general"))
    return staged.select(*df.columns, category.alias(name))


def coded_demographic(age: Column, gender: Column) -> Column:
    """Class of coded age and gender; the two youngest codes give null."""
    who = F.when(gender == 0, "men").otherwise("women")
    band = F.when(age.isin(2, 3), "u35").when(age.isin(4, 5), "35_50").when(age.isin(6, 7, 8), "o50")
    return F.concat(F.lit("face_"), who, F.lit("_"), band, F.lit("_average_candid"))


def code_name(code: Column, names: list[str]) -> Column:
    """Name of a code, the code's own text when unknown."""
    inside = (code >= 0) & (code < len(names))
    return F.when(inside, F.try_element_at(literals(names), (code + 1).cast("int"))).otherwise(code.cast("string"))


def _shared(terms: list[str]) -> Column:
    return F.size(F.array_intersect("keywords", literals(terms)))


def plausible_size(photos: DataFrame) -> DataFrame:
    """The numeric gates alone, on stored columns: they reach the scan, before keywords are joined."""
    c = F.col
    ratio = F.coalesce(F.when(~F.isnan("aspect"), c("aspect")), F.lit(1.0))
    sized = ((F.coalesce("width", F.lit(0)) == 0) | (F.coalesce("height", F.lit(0)) == 0)
             | ((c("width") >= P.PHOTO_MIN_EDGE) & (c("height") >= P.PHOTO_MIN_EDGE)))
    return photos.where(ratio.between(*P.PHOTO_ASPECT_RANGE) & sized)


def photo_facts(photos: DataFrame) -> DataFrame:
    """Relevance facts per photo; ``category`` is null where the photo is rejected.

    Input: description, keywords (distinct lower-case array), aspect, width,
    height. Counts and text tests become columns first, so each scans the
    text once.
    """
    c = F.col
    every = sorted(set(P.MALE_TERMS + P.FEMALE_TERMS + P.FACE_TERMS + P.FASHION_TERMS + P.POSTURE_TERMS))
    counted = photos.withColumn("_d", F.lower("description")).withColumns({
        "_neg": _shared(P.EXCLUDED_TERMS), "_pos": _shared(every), "_nf": _shared(P.FACE_TERMS),
        "_ns": _shared(P.FASHION_TERMS), "_np": _shared(P.POSTURE_TERMS), "_nm": _shared(P.MALE_TERMS),
        "_nw": _shared(P.FEMALE_TERMS), "_nh": _shared(P.HUMAN_TERMS),
        "_tf": contains_any("_d", P.FACE_PHRASES), "_ts": contains_any("_d", P.FASHION_PHRASES),
        "_tp": contains_any("_d", P.POSTURE_PHRASES)})
    facts = counted.withColumns({
        "is_male": (c("_nm") > 0) | contains_any("_d", P.MALE_PHRASES),
        "is_female": (c("_nw") > 0) | contains_any("_d", P.FEMALE_PHRASES),
        "is_face": (c("_nf") > 0) | c("_tf"), "is_fashion": (c("_ns") > 0) | c("_ts"),
        "is_posture": (c("_np") > 0) | c("_tp"),
        "aspect_ratio": F.coalesce(F.when(~F.isnan("aspect"), c("aspect")), F.lit(1.0))})
    human = (c("_nh") > 0) | contains_any("_d", P.HUMAN_PHRASES)
    small = (F.coalesce("width", F.lit(0)) != 0) & (F.coalesce("height", F.lit(0)) != 0) & (
        (c("width") < P.PHOTO_MIN_EDGE) | (c("height") < P.PHOTO_MIN_EDGE))
    # Cheap numeric gates come before the text scans.
    rejected = ((c("aspect_ratio") < P.PHOTO_ASPECT_RANGE[0]) | (c("aspect_ratio") > P.PHOTO_ASPECT_RANGE[1]) | small
                | ((c("_neg") > 0) & ((c("_neg") >= 2) | (c("_pos") == 0)))
                | ~(c("is_face") | c("is_fashion") | c("is_posture")) | ~human | contains_any("_d", P.NEGATIVE_PHRASES))

    def gendered(who: str) -> Column:
        return (F.when(c("is_fashion") & ~c("is_face"), f"unsplash_{who}_fashion")
                .when(c("is_face") & ~c("is_fashion"), f"unsplash_{who}_grooming")
                .when(c("_ns") >= c("_nf"), f"unsplash_{who}_fashion").otherwise(f"unsplash_{who}_grooming"))

    category = (F.when(c("is_male") & ~c("is_female"), gendered("men"))
                .when(c("is_female") & ~c("is_male"), gendered("women"))
                .when(c("is_face"), "unsplash_face_grooming").when(c("is_posture"), "unsplash_posture_and_fit")
                .otherwise("unsplash_general_fashion"))
    score = (c("_nf") * 2 + c("_ns") * 2 + c("_np") + F.when(c("_ts"), 3).otherwise(0)
             + F.when(c("_tf"), 3).otherwise(0) + F.when(c("is_male") | c("is_female"), 1).otherwise(0))
    return facts.select(*photos.columns, F.when(~rejected, category).alias("category"), score.alias("relevance_score"),
                        "is_male", "is_female", "is_face", "is_fashion", "is_posture", "aspect_ratio")
