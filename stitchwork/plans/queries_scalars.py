"""Catalog section: projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stitchwork.functions import advice, colour, decode, geometry, labels, portraits, routing, text, urls
from stitchwork.operators import filters, generate, looks as look_ops, repair, sets
from stitchwork.plans import standins as S
from stitchwork.plans.registry import (
    q, query, sql_has, sql_in, sql_list, sql_map, sql_pick, sql_rules, sql_synonyms, table)
from stitchwork.rules import advice as A
from stitchwork.rules import garments as G
from stitchwork.rules import photos as P
from stitchwork.rules import routing as R

c = F.col


def _low(x: str) -> str:
    return f"lower(trim(coalesce({x}, '')))"


# ---- canonical labels -----------------------------------------------------------------------

def _canonical_sql(variant: str) -> str:
    lower = dict(R.LOWER_SYNONYMS)
    if variant == "batch":
        lower["tailored_trousers"] = lower["tailored_trousers"] + R.BATCH_EXTRA_TROUSER_SPELLINGS
    jackets = sql_in(R.UPPER_JACKET_SPELLINGS)
    return f"""
WITH a AS (SELECT * FROM {S.ANNOTATIONS}),
s1 AS (SELECT *, CASE WHEN {_low('upper')} IN {jackets} THEN 'dress_shirt'
         ELSE {sql_synonyms(_low('upper'), R.UPPER_SYNONYMS, 'upper')} END AS upper_type,
       CASE WHEN {_low('upper')} IN {jackets} AND coalesce(mid, '') IN ('', 'none') THEN 'blazer' ELSE mid END AS mid1 FROM a),
s2 AS (SELECT *, CASE WHEN {_low('mid1')} IN {sql_in(R.MID_TROUSER_SPELLINGS)} THEN 'none'
         WHEN {_low('mid1')} IN {sql_in(R.MID_JACKET_SPELLINGS)} THEN 'blazer' ELSE mid1 END AS mid_type,
       CASE WHEN {_low('mid1')} IN {sql_in(R.MID_TROUSER_SPELLINGS)} AND coalesce(lower, '') = '' THEN 'tailored_trousers'
         ELSE lower END AS lower1 FROM s1)
SELECT id, upper_type, mid_type, {sql_synonyms(_low('lower1'), lower, 'lower1')} AS lower_type,
  {sql_synonyms(_low('shoes'), R.FOOTWEAR_SYNONYMS, 'shoes')} AS footwear_type,
  CASE WHEN hair IN ('true', '1') THEN '1' WHEN hair IN ('false', '0') THEN '0' ELSE hair END AS hair_styled,
  CASE WHEN contains({_low('beard')}, 'shaven') OR contains({_low('beard')}, 'clean') OR {_low('beard')} = 'none' THEN 'clean_shaven'
    WHEN contains({_low('beard')}, 'stubble') THEN 'stubble'
    WHEN contains({_low('beard')}, 'beard') THEN CASE WHEN contains({_low('beard')}, 'short') THEN 'short_beard' ELSE 'full_beard' END
    ELSE beard END AS facial_hair_style FROM s2"""


def _canonical(spark, sf, variant):
    slots = routing.canonical_garments(c("upper"), c("mid"), c("lower"), c("shoes"), variant)
    return S.annotations(spark, sf).select(
        "id", *[v.alias(k) for k, v in slots.items()], routing.canonical_hair_styled(c("hair")).alias("hair_styled"),
        routing.canonical_facial_hair(c("beard")).alias("facial_hair_style"))


@query("p03_canonical_labels_sorter", _canonical_sql("sorter"))
def p03(spark, sf):
    return _canonical(spark, sf, "sorter")


@query("p04_canonical_labels_batch", _canonical_sql("batch"))
def p04(spark, sf):
    return _canonical(spark, sf, "batch")


_LOADER = {"upper_type": "upper", "mid_type": "mid", "lower_type": "lower", "footwear_type": "shoes",
           "formality": "tier_text", "hair_styled": "hair", "hair_length": "shot", "facial_hair_style": "beard",
           "makeup_style": "focus"}


@query("p05_canonical_labels_loader", "SELECT id, " + ", ".join(
    f"CASE {' '.join(f'WHEN lower(trim({src})) = {q(k)} THEN {q(v)}' for k, v in R.LOADER_SYNONYMS.get(f, {'~': '~'}).items())} "
    f"ELSE lower(trim({src})) END AS {f}" for f, src in _LOADER.items()) + f" FROM {S.ANNOTATIONS}")
def p05(spark, sf):
    return S.annotations(spark, sf).select(
        "id", *[routing.canonical_for_training(f, c(src)).alias(f) for f, src in _LOADER.items()])


# ---- routing --------------------------------------------------------------------------------

_DEMOGRAPHIC = (f"CASE WHEN {sql_has(_low('gender'), R.FEMALE_WORDS)} THEN 'Women' ELSE 'Men' END || '_' || "
                f"CASE WHEN {sql_has(_low('age'), R.YOUNG_WORDS)} THEN 'Under_35' "
                f"WHEN {sql_has(_low('age'), R.OLD_WORDS)} THEN 'Over_50' ELSE '35_to_50' END")
_TIER_BY_SCORE = ("CASE WHEN overall >= 7.5 THEN '3_Polished' WHEN overall < 5.0 THEN '1_Needs_Improvement' "
                  "ELSE '2_Average' END")
_TT = f"replace({_low('tier_text')}, ' ', '_')"
_TIER_SORTER = (f"CASE WHEN {sql_has(_TT, R.TIER_LOW_WORDS)} THEN '1_Needs_Improvement' "
                f"WHEN {sql_has(_TT, R.TIER_HIGH_WORDS)} THEN '3_Polished' "
                f"WHEN {sql_has(_TT, R.TIER_MID_WORDS)} THEN '2_Average' ELSE {_TIER_BY_SCORE} END")
_TIER_BATCH = (f"CASE WHEN {sql_has(_TT, R.TIER_LOW_WORDS)} THEN '1_Needs_Improvement' "
               f"WHEN {sql_has(_TT, R.TIER_HIGH_WORDS)} THEN '3_Polished' ELSE {_TIER_BY_SCORE} END")


def _stream_sql(path_words, shot_words):
    return (f"CASE WHEN {sql_has('lower(path)', path_words)} OR {sql_has(_low('focus'), R.FACE_FOCUS_WORDS)} "
            f"OR {sql_has(_low('shot'), shot_words)} THEN 'Face_Grooming' ELSE 'Outfit' END")


_STREAM_SORTER = _stream_sql(R.SORTER_FACE_PATH_WORDS, R.SORTER_SHOT_WORDS)
_STREAM_BATCH = _stream_sql(R.BATCH_FACE_PATH_WORDS, R.BATCH_SHOT_WORDS)
HEURISTIC_SQL = """CASE WHEN size = 0 THEN 'empty_file_0bytes'
  WHEN least(width, height) < 480 THEN 'too_small_' || least(width, height) || 'px'
  WHEN greatest(width, height)::DOUBLE / least(width, height) > 2.5
    THEN 'bad_aspect_ratio_' || printf('%.2f', greatest(width, height)::DOUBLE / least(width, height))
  WHEN laplacian < 60.0 THEN 'blurry_laplacian_' || printf('%.1f', laplacian) ELSE 'ok' END"""


@query("p06_resolve_demographic", f"SELECT id, {_DEMOGRAPHIC} AS demographic FROM {S.ANNOTATIONS}")
def p06(spark, sf):
    return S.annotations(spark, sf).select("id", routing.resolve_demographic(c("gender"), c("age")).alias("demographic"))


@query("p07_resolve_tier_sorter", f"SELECT id, {_TIER_SORTER} AS tier FROM {S.ANNOTATIONS}")
def p07(spark, sf):
    return S.annotations(spark, sf).select("id", routing.resolve_tier(c("tier_text"), c("overall")).alias("tier"))


@query("p08_resolve_tier_batch", f"SELECT id, {_TIER_BATCH} AS tier FROM {S.ANNOTATIONS}")
def p08(spark, sf):
    return S.annotations(spark, sf).select(
        "id", routing.resolve_tier(c("tier_text"), c("overall"), "batch").alias("tier"))


@query("p09_resolve_stream", f"SELECT id, {_STREAM_SORTER} AS sorter, {_STREAM_BATCH} AS batch FROM {S.ANNOTATIONS}")
def p09(spark, sf):
    args = (c("focus"), c("shot"), c("path"))
    return S.annotations(spark, sf).select("id", routing.resolve_stream(*args).alias("sorter"),
                                           routing.resolve_stream(*args, "batch").alias("batch"))


# ---- scores, targets, severities ------------------------------------------------------------

_RESCALED = ("CASE WHEN overall IS NOT NULL THEN greatest(1.0, least(10.0, CASE WHEN overall > 10.0 AND overall <= 20.0 "
             "THEN overall / 2.0 ELSE overall END)) END")


@query("p10_score_rescale", f"SELECT id, ({_RESCALED})::DOUBLE AS score FROM {S.ANNOTATIONS}")
def p10(spark, sf):
    return S.annotations(spark, sf).select("id", labels.rescale_score(c("overall")).alias("score"))


@query("p11_score_fallback", f"""
SELECT d.doc_id, coalesce(CASE WHEN l.quality IS NOT NULL AND d.doc_id % 3 <> 0 THEN l.quality * 4 + 3.5 END,
  CASE WHEN d.doc_id % 4 = 0 THEN (d.n_chars % 91 + 10) / 10.0 END,
  {sql_map(sql_pick(R.AESTHETIC_TIERS, 'd.doc_id'), {'1_Needs_Improvement': 2.0, '2_Average': 5.0, '3_Polished': 8.5})})::DOUBLE AS score
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def p11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    annotated = F.when(c("doc_id") % 3 != 0, c("quality") * 4 + 3.5)
    mapped = F.when(c("doc_id") % 4 == 0, (c("n_chars") % 91 + 10) / F.lit(10.0))
    return j.select("doc_id", labels.score_or_midpoint(annotated, mapped, text.pick(R.AESTHETIC_TIERS, c("doc_id")))
                    .alias("score"))


_FORMALITY = {"name": "formality", "type": "categorical", "classes": G.FORMALITY_CLASSES}
_RAW_CLASSES = ["casual", "formal", "gala", "business", None, "smart_casual", ""]


@query("p12_encode_target", f"""SELECT p_partkey, (p_partkey % 91 / 10.0)::DOUBLE AS regression,
  trunc(p_partkey % 30 / 10.0)::DOUBLE AS ordinal,
  greatest(coalesce(list_position({sql_list(G.FORMALITY_CLASSES)}, {sql_pick(_RAW_CLASSES, 'p_partkey')}), 0) - 1, 0)::DOUBLE AS categorical
  FROM part""")
def p12(spark, sf):
    k = c("p_partkey")
    return table(spark, sf, "part").select(
        k, labels.encode_target({"type": "regression"}, ((k % 91) / F.lit(10.0)).cast("string")).alias("regression"),
        labels.encode_target({"type": "ordinal"}, ((k % 30) / F.lit(10.0)).cast("string")).alias("ordinal"),
        labels.encode_target(_FORMALITY, text.pick(_RAW_CLASSES, k)).alias("categorical"))


@query("p13_severity_positive", f"""SELECT id, {sql_map('tier', G.SEVERITY)} AS severity,
  CASE WHEN tier = 'polished' THEN 1 ELSE 0 END AS positive FROM {S.LABELS}""")
def p13(spark, sf):
    return S.label_rows(spark, sf).select("id", labels.severity(c("tier")).alias("severity"),
                                          labels.positive(c("tier")).alias("positive"))


@query("p14_formality_tier", """
WITH m AS (SELECT p_partkey, (p_partkey % 4 + p_size % 4
    + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey // 4 % 4 END
    + CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size // 3 % 4 END)::DOUBLE
  / (2 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END) AS mean FROM part)
SELECT p_partkey, mean AS mean_formality, CASE WHEN mean < 1.0 THEN 'casual' WHEN mean < 2.0 THEN 'smart_casual'
  WHEN mean < 2.75 THEN 'business' ELSE 'formal' END AS formality FROM m""")
def p14(spark, sf):
    k, s = c("p_partkey"), c("p_size")
    mean = labels.mean_worn([k % 4, F.when(k % 3 != 0, F.floor(k / 4) % 4), s.cast("long") % 4,
                             F.when(s % 5 != 0, F.floor(s / 3) % 4)])
    return table(spark, sf, "part").select(k, mean.alias("mean_formality"), labels.formality_tier(mean).alias("formality"))


# ---- colour ---------------------------------------------------------------------------------

@query("p15_color_harmony", f"""SELECT id, CASE WHEN upper IS NULL OR lower IS NULL THEN 'unknown' WHEN upper = lower THEN 'harmonious'
  WHEN upper IN {sql_in(G.NEUTRALS)} OR lower IN {sql_in(G.NEUTRALS)} THEN 'neutral_pair'
  WHEN (upper = 'red' AND lower = 'green') OR (upper = 'green' AND lower = 'red') THEN 'clashing' ELSE 'harmonious' END AS harmony
  FROM {S.COLORS}""")
def p15(spark, sf):
    return S.colors(spark, sf).select("id", colour.harmony(c("upper"), c("lower")).alias("harmony"))


def _lin(ch):
    return (f"CASE WHEN {ch} / 255.0::DOUBLE > 0.04045 THEN pow(({ch} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) "
            f"ELSE {ch} / 255.0::DOUBLE / 12.92 END")


def _f(t):
    return f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116.0 END"


_LAB = f"""
WITH l AS (SELECT id, ({_lin('r')})::DOUBLE AS r, ({_lin('g')})::DOUBLE AS g, ({_lin('b')})::DOUBLE AS b FROM {S.COLORS}),
x AS (SELECT id, (r*0.4124::DOUBLE+g*0.3576::DOUBLE+b*0.1805::DOUBLE)/0.95047::DOUBLE AS x,
  r*0.2126::DOUBLE+g*0.7152::DOUBLE+b*0.0722::DOUBLE AS y,
  (r*0.0193::DOUBLE+g*0.1192::DOUBLE+b*0.9505::DOUBLE)/1.08883::DOUBLE AS z FROM l),
f AS (SELECT id, ({_f('x')})::DOUBLE AS fx, ({_f('y')})::DOUBLE AS fy, ({_f('z')})::DOUBLE AS fz FROM x),
lab AS (SELECT id, 116*fy-16 AS l, 500*(fx-fy) AS a, 200*(fy-fz) AS b FROM f)"""


@query("p16_srgb_to_lab", _LAB + " SELECT id, round(l, 4) AS l, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b FROM lab")
def p16(spark, sf):
    l, a, b = colour.rgb_to_lab(c("r"), c("g"), c("b"))
    return S.colors(spark, sf).select("id", F.round(l, 4).alias("l"), (F.round(a, 4) + F.lit(0.0)).alias("a"),
                                      (F.round(b, 4) + F.lit(0.0)).alias("b"))


_ANCHORS = ", ".join(f"({i}, {q(n)}, {l!r}::DOUBLE, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (n, (l, a, b)) in enumerate(
    (n, colour.anchor_lab(rgb)) for n, rgb in G.PALETTE.items()))
SNAP_SQL = _LAB + f""", p(ord, name, pl, pa, pb) AS (VALUES {_ANCHORS}),
d AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY (l-pl)*(l-pl)+(a-pa)*(a-pa)+(b-pb)*(b-pb), ord) AS rn FROM lab, p)
SELECT id, name AS color FROM d WHERE rn = 1"""


@query("p17_snap_to_palette", SNAP_SQL)
def p17(spark, sf):
    return colour.with_palette_name(S.colors(spark, sf), c("r"), c("g"), c("b"), "color").select("id", "color")


@query("p18_sample_color_name", f"""
WITH s AS (SELECT id, r/255.0::DOUBLE AS r, g/255.0::DOUBLE AS g, b/255.0::DOUBLE AS b FROM {S.COLORS})
SELECT id, CASE WHEN (r+g+b)/3 < 0.20 THEN 'Dark / Black' WHEN (r+g+b)/3 > 0.82 THEN 'Light / White'
  WHEN greatest(abs(r-g), abs(g-b), abs(r-b)) < 0.08 THEN 'Neutral Grey'
  WHEN r > g AND r > b THEN CASE WHEN g > 0.5 THEN 'Warm Amber' ELSE 'Warm Red / Burgundy' END
  WHEN g > r AND g > b THEN 'Olive / Green'
  WHEN b > r AND b > g THEN CASE WHEN r > 0.4 THEN 'Purple / Violet' ELSE 'Navy / Blue' END ELSE 'Neutral' END AS name FROM s""")
def p18(spark, sf):
    ch = [c(x) / F.lit(255.0) for x in "rgb"]
    return S.colors(spark, sf).select("id", colour.sample_name(*ch).alias("name"))


# ---- URLs -----------------------------------------------------------------------------------

@query("p19_unescape_url", f"""
SELECT page_id, page_url || '?a=1&b=' || page_id || '''&lt;&amp;é=x=y©=1&unknown;' AS url FROM {S.URLS}""")
def p19(spark, sf):
    raw = F.concat(F.lit(" "), c("page_url"), F.lit("?a=1&amp;b="), c("page_id").cast("string"),
                   F.lit("&#39;&amp;lt;&#38;amp;&eacute;&#61;x&#x3D;y&copy=1&unknown; "))
    return S.urls(spark, sf).select("page_id", urls.unescape_url(raw).alias("url"))


def _safe(u):
    return f"NOT {sql_has(f'lower({u})', R.BLOCKED_URL_WORDS)}"


_MARKED_HTML = ("html || '<a m=\"&quot;murl&quot;:&quot;http://img.example/' || page_id || '%20a.jpg&quot;\">'"
                " || '<img src=\"https://cdn.example/p' || page_id || '.png\"> https://gstatic.com/x.jpg"
                " &quot;murl&quot;:&quot;http://img.example/vector.png&quot; https://cdn.example/p' || page_id || '.png'")


@query("p22_harvest_media_urls", f"""
WITH h AS (SELECT page_id, {_MARKED_HTML} AS html FROM {S.URLS}),
m AS (SELECT page_id, 'marked' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(html, '&quot;murl&quot;:&quot;(http[^&]+)&quot;', 1), lambda x: url_decode(x)))) AS url FROM h),
l AS (SELECT page_id, 'link' AS kind, unnest(list_distinct(regexp_extract_all(html, 'https?://[^"''\\s<>\\\\]+?\\.(?:jpg|jpeg|png|webp)'))) AS url FROM h)
SELECT page_id, kind, url FROM m WHERE {_safe('url')}
UNION ALL SELECT page_id, kind, url FROM l WHERE NOT contains(url, 'google.com') AND NOT contains(url, 'gstatic.com') AND {_safe('url')}""")
def p22(spark, sf):
    p = c("page_id").cast("string")
    html = F.concat(c("html"), F.lit('<a m="&quot;murl&quot;:&quot;http://img.example/'), p,
                    F.lit('%20a.jpg&quot;"><img src="https://cdn.example/p'), p,
                    F.lit('.png"> https://gstatic.com/x.jpg &quot;murl&quot;:&quot;http://img.example/vector.png&quot; '
                          'https://cdn.example/p'), p, F.lit(".png"))
    pages = S.urls(spark, sf).select("page_id", F.array(
        F.struct(F.lit("marked").alias("kind"), urls.harvest_marked(html).alias("u")),
        F.struct(F.lit("link").alias("kind"), urls.harvest_links(html).alias("u"))).alias("found"))
    kinds = pages.select("page_id", F.explode("found").alias("f"))
    return kinds.select("page_id", "f.kind", F.explode("f.u").alias("url"))


@query("p23_content_key", "SELECT doc_id, left(sha256(text), 16) AS short_key, sha256(text) AS full_key FROM documents")
def p23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", labels.content_key(c("text")).alias("short_key"),
                                                F.sha2(c("text").cast("binary"), 256).alias("full_key"))


@query("p24_parse_task_filename", f"SELECT id, id AS index, category, tier FROM {S.LABELS}")
def p24(spark, sf):
    n = c("filename")
    return S.label_rows(spark, sf).select("id", labels.filename_index(n).alias("index"),
                                          labels.filename_category(n).alias("category"), labels.filename_tier(n).alias("tier"))


_CODED = """SELECT c_custkey, CASE WHEN age IN (2,3) THEN 'u35' WHEN age IN (4,5) THEN '35_50' WHEN age IN (6,7,8) THEN 'o50' END AS band,
  age, gender, race FROM (SELECT c_custkey, c_custkey % 10 AS age, c_nationkey % 2 AS gender, c_custkey % 8 AS race FROM customer)"""


def _name_sql(code, names):
    return f"CASE WHEN {code} < {len(names)} THEN ({sql_list(names)})[{code} + 1] ELSE {code}::VARCHAR END"


@query("p25_coded_demographic", f"""SELECT c_custkey, 'face_' || CASE WHEN gender = 0 THEN 'men' ELSE 'women' END || '_' || band || '_average_candid' AS category,
  {_name_sql('age', P.AGE_NAMES)} AS age_name, {_name_sql('gender', P.GENDER_NAMES)} AS gender_name,
  {_name_sql('race', P.RACE_NAMES)} AS race_name FROM ({_CODED}) WHERE band IS NOT NULL""")
def p25(spark, sf):
    k = c("c_custkey")
    rows = table(spark, sf, "customer").select(k, (k % 10).alias("age"), (c("c_nationkey") % 2).alias("gender"),
                                               (k % 8).alias("race"))
    return rows.select(k, portraits.coded_demographic(c("age"), c("gender")).alias("category"),
                       portraits.code_name(c("age"), P.AGE_NAMES).alias("age_name"),
                       portraits.code_name(c("gender"), P.GENDER_NAMES).alias("gender_name"),
                       portraits.code_name(c("race"), P.RACE_NAMES).alias("race_name")).where(c("category").isNotNull())


def _flag(name):
    words = P.DESCRIPTION_FLAGS[name].replace("'", "''")
    return f"regexp_matches(t, '(^|[^\\pL\\pN_\\pM])(?:{words})($|[^\\pL\\pN_\\pM])')"


DESCRIPTION_SQL = f"""
WITH t AS (SELECT photo_id, lower(description) AS t FROM {S.PHOTOS}),
f AS (SELECT photo_id, t, {', '.join(f'{_flag(n)} AS f_{n}' for n in P.DESCRIPTION_FLAGS)} FROM t),
g AS (SELECT *, f_gray OR contains(t, 'senior') OR contains(t, 'elderly') AS f_old FROM f)
SELECT photo_id, CASE WHEN {sql_has('t', P.LOW_QUALITY_PHRASES)} THEN NULL
 WHEN f_male AND NOT f_female THEN CASE WHEN f_old THEN 'face_men_o50_distinguished'
   WHEN f_mature THEN CASE WHEN f_beard THEN 'face_men_35_50_beard' WHEN f_bald THEN 'face_men_35_50_balding'
     WHEN f_formal THEN 'face_men_35_50_formal' ELSE 'face_men_35_50_portrait' END
   WHEN f_beard THEN 'face_men_u35_beard_styled' WHEN f_bald THEN 'face_men_u35_hair_thinning'
   WHEN f_styled AND f_smile THEN 'face_men_u35_hair_styled' WHEN f_formal THEN 'face_men_u35_formal'
   WHEN f_smile THEN 'face_men_u35_smile_clean' ELSE 'face_men_u35_portrait_neutral' END
 WHEN f_female AND NOT f_male THEN CASE WHEN f_old THEN 'face_women_o50_distinguished'
   WHEN f_mature THEN CASE WHEN f_formal OR f_makeup THEN 'face_women_35_50_polished' ELSE 'face_women_35_50_portrait' END
   WHEN f_makeup AND f_styled THEN 'face_women_u35_polished_glam' WHEN f_styled AND f_formal THEN 'face_women_u35_formal'
   WHEN f_styled THEN 'face_women_u35_hair_styled' WHEN f_smile THEN 'face_women_u35_smile_natural'
   ELSE 'face_women_u35_portrait_neutral' END
 WHEN f_glasses THEN 'face_portrait_eyeglasses' WHEN f_formal THEN 'face_portrait_formal' ELSE 'face_portrait_general' END AS category
FROM g"""


@query("p26_classify_description", DESCRIPTION_SQL)
def p26(spark, sf):
    rows = portraits.classify_descriptions(S.photos(spark, sf).select("photo_id", "description"), "description")
    return rows.select("photo_id", "category")


def _count_in(terms):
    return f"len(list_intersect(kws, {sql_list(sorted(set(terms)))}))"


_POSITIVE = P.MALE_TERMS + P.FEMALE_TERMS + P.FACE_TERMS + P.FASHION_TERMS + P.POSTURE_TERMS


def _gendered_sql(who):
    return (f"CASE WHEN is_fashion AND NOT is_face THEN 'unsplash_{who}_fashion' WHEN is_face AND NOT is_fashion THEN "
            f"'unsplash_{who}_grooming' WHEN n_fashion >= n_face THEN 'unsplash_{who}_fashion' ELSE 'unsplash_{who}_grooming' END")


PHOTO_FACTS_SQL = f"""
k AS (SELECT photo_id, list(DISTINCT lower(trim(keyword))) AS kws FROM {S.KEYWORDS} WHERE lower(trim(keyword)) IN {sql_in(S.PHOTO_VOCABULARY)} GROUP BY 1),
b AS (SELECT p.*, lower(description) AS d, coalesce(kws, []::VARCHAR[]) AS kws FROM {S.PHOTOS} p LEFT JOIN k USING (photo_id)),
n AS (SELECT *, {_count_in(P.EXCLUDED_TERMS)} AS n_neg, {_count_in(_POSITIVE)} AS n_pos, {_count_in(P.FACE_TERMS)} AS n_face,
  {_count_in(P.FASHION_TERMS)} AS n_fashion, {_count_in(P.POSTURE_TERMS)} AS n_posture,
  {sql_has('d', P.FACE_PHRASES)} AS t_face, {sql_has('d', P.FASHION_PHRASES)} AS t_fashion, {sql_has('d', P.POSTURE_PHRASES)} AS t_posture,
  {_count_in(P.MALE_TERMS)} > 0 OR {sql_has('d', P.MALE_PHRASES)} AS is_male,
  {_count_in(P.FEMALE_TERMS)} > 0 OR {sql_has('d', P.FEMALE_PHRASES)} AS is_female,
  {_count_in(P.HUMAN_TERMS)} > 0 OR {sql_has('d', P.HUMAN_PHRASES)} AS human FROM b),
m AS (SELECT *, n_face > 0 OR t_face AS is_face, n_fashion > 0 OR t_fashion AS is_fashion, n_posture > 0 OR t_posture AS is_posture FROM n),
facts AS (SELECT photo_id, lang, source, is_male, is_female, is_face, is_fashion, is_posture,
  CASE WHEN is_male AND NOT is_female THEN {_gendered_sql('men')} WHEN is_female AND NOT is_male THEN {_gendered_sql('women')}
    WHEN is_face THEN 'unsplash_face_grooming' WHEN is_posture THEN 'unsplash_posture_and_fit' ELSE 'unsplash_general_fashion' END AS category,
  (n_face * 2 + n_fashion * 2 + n_posture + CASE WHEN t_fashion THEN 3 ELSE 0 END + CASE WHEN t_face THEN 3 ELSE 0 END
    + CASE WHEN is_male OR is_female THEN 1 ELSE 0 END)::INT AS relevance_score FROM m
  WHERE NOT {sql_has('d', P.NEGATIVE_PHRASES)} AND NOT (n_neg > 0 AND (n_neg >= 2 OR n_pos = 0)) AND human
    AND aspect >= 0.35 AND aspect <= 2.6 AND width >= 480 AND height >= 480 AND (is_face OR is_fashion OR is_posture))"""


def qualified_photos(spark, sf):
    from stitchwork.operators import joins
    sets_ = joins.keyword_sets(S.keyword_rows(spark, sf), "photo_id", "keyword", S.PHOTO_VOCABULARY)
    photos = joins.with_keywords(portraits.plausible_size(S.photos(spark, sf)), sets_, "photo_id")
    return filters.keep(portraits.photo_facts(photos), c("category").isNotNull())


@query("p27_photo_relevance", f"WITH {PHOTO_FACTS_SQL} SELECT photo_id, category, relevance_score, is_male, is_female, is_face, is_fashion, is_posture FROM facts")
def p27(spark, sf):
    return qualified_photos(spark, sf).select("photo_id", "category", "relevance_score", "is_male", "is_female",
                                              "is_face", "is_fashion", "is_posture")


# ---- occasions and advice -------------------------------------------------------------------

_OCC_RAW = ["", "first date", "Coding interview at a club", "board meeting", "xyz", " Night Out ", "Business Meeting",
            "office party", "creative design review", "weekend errands", "gym session", "wedding guest", "bbq", "brunch",
            "Casual Everyday", "Date Night", "tech talk", "Formal Event", None]


def _occasion_input(spark, sf):
    k = c("conv_id") * 8 + c("turn")
    return table(spark, sf, "conversations").select(
        k.alias("id"), F.concat(F.coalesce(text.pick(_OCC_RAW, k), F.lit("")),
                                F.when(k % 5 == 0, F.concat(F.lit(" "), c("text"))).otherwise("")).alias("raw"))


_OCC_SQL = f"""SELECT conv_id * 8 + turn AS id, lower(trim(coalesce({sql_pick(_OCC_RAW, 'conv_id * 8 + turn')}, '') ||
  CASE WHEN (conv_id * 8 + turn) % 5 = 0 THEN ' ' || text ELSE '' END)) AS t FROM conversations"""
_EXACT = "CASE " + " ".join(f"WHEN t = {q(o.lower())} THEN {q(o)}" for o in A.OCCASIONS) + " END"


@query("p28_canonical_occasion", f"""WITH o AS ({_OCC_SQL}) SELECT id,
  coalesce({_EXACT}, {sql_rules('t', A.OCCASION_RULES, A.DEFAULT_OCCASION)}) AS script,
  {sql_rules('t', A.APP_OCCASION_RULES, A.DEFAULT_OCCASION)} AS app FROM o""")
def p28(spark, sf):
    return _occasion_input(spark, sf).select("id", advice.canonical_occasion(c("raw")).alias("script"),
                                             advice.canonical_occasion(c("raw"), "app").alias("app"))


_LINES = "list_filter(list_transform(string_split(trim(text, ' ' || chr(10) || chr(13) || chr(9)), chr(10)), lambda x: trim(x, ' ' || chr(10) || chr(13) || chr(9))), lambda x: x <> '')"


def _own(words, pattern="[a-z]+"):
    # A run of plain letters counts as a word only between non-word characters.
    return (f"list_filter(ls, lambda x: NOT list_has_any(list_transform(regexp_extract_all(regexp_replace(lower(x), "
            f"'[\\pL\\pN_]*[^\\PLa-z][\\pL\\pN_]*|[\\pL_]*[\\pN_][\\pL\\pN_]*', ' ', 'g'), '{pattern}'), lambda w: w), {sql_list(words)}))")


def _app_own(words):
    return (f"list_filter(ls, lambda x: NOT list_has_any(regexp_extract_all(lower(x), '[\\pL\\pM\\pN]+'), {sql_list(words)}))")


def _fb(tbl):
    both = lambda who: f"CASE WHEN score >= 7.5 THEN {sql_list(tbl[(who, True)])} ELSE {sql_list(tbl[(who, False)])} END"
    return (f"CASE WHEN category = 'Men_Grooming' THEN {both('men')} WHEN category = 'Women_Grooming' THEN {both('women')} "
            f"ELSE {both('outfit')} END")


@query("p29_domain_isolation", f"""
WITH a AS (SELECT id, category, score, {_LINES} AS ls FROM {S.ADVICE}),
k AS (SELECT *, CASE WHEN ends_with(category, 'Grooming') THEN {_own(A.OUTFIT_WORDS)} ELSE {_own(A.GROOMING_WORDS)} END AS kept,
  CASE WHEN ends_with(category, 'Grooming') THEN {_app_own(A.APP_OUTFIT_WORDS)} ELSE {_app_own(A.APP_GROOMING_WORDS)} END AS kept_app,
  {_fb(A.FALLBACK_LINES)} AS fb, {_fb(A.APP_FALLBACK_LINES)} AS fb_app FROM a)
SELECT id, array_to_string(CASE WHEN len(kept) < 2 THEN list_concat(kept, fb[1:2 - len(kept)]) ELSE kept END, chr(10)) AS script,
  array_to_string((CASE WHEN len(kept_app) < 2 THEN list_concat(kept_app, fb_app) ELSE kept_app END)[1:4], chr(10)) AS app FROM k""")
def p29(spark, sf):
    a = S.advice(spark, sf)
    lines = F.filter(F.transform(F.split(text.strip(c("text")), "\n"), text.strip), lambda x: x != "")
    return a.select("id", advice.isolate_domain(c("category"), c("text"), c("score")).alias("script"),
                    F.array_join(advice.isolate_domain_app(c("category"), lines, c("score")), "\n").alias("app"))


def _defect_sql():
    def worst(fields):
        return f"(list_sort([{', '.join(f'{{s: -coalesce({f}, 0), o: {i}, n: {q(f)}}}' for i, f in enumerate(fields))}]))[1]"
    men, women = A.GROOMING_DEFECTS + [A.MEN_DEFECT], A.GROOMING_DEFECTS + [A.WOMEN_DEFECT]
    return (f"CASE WHEN category = 'Men_Grooming' THEN {worst(men)} WHEN category = 'Women_Grooming' THEN {worst(women)} "
            f"ELSE {worst(A.OUTFIT_DEFECTS)} END")


def defect_row():
    return {f: c(f) for f in A.OUTFIT_DEFECTS + A.GROOMING_DEFECTS + [A.MEN_DEFECT, A.WOMEN_DEFECT]}


@query("p30_priority_defect", f"""WITH d AS (SELECT id, {_defect_sql()} AS w FROM {S.LABELS})
SELECT id, CASE WHEN w.s < 0 THEN w.n END AS defect FROM d""")
def p30(spark, sf):
    return S.label_rows(spark, sf).select("id", advice.priority_defect(c("category"), defect_row()).alias("defect"))


def _tag_row():
    return {**defect_row(), **{f: c(f) for f in ("upper_pattern", "lower_pattern", "facial_hair_style", "makeup_style", "score")},
        "upper_type": F.lit("polo_shirt"), "mid_type": F.when(c("id") % 2 == 0, "blazer").otherwise("none"),
        "lower_type": F.when(c("id") % 5 == 0, "none").otherwise("chino_pants"), "footwear_type": F.lit("slides"),
        "formality": F.lit(None).cast("string"), "fit_tailored": c("id") % 2, "fabric_crisp": c("cust") % 2,
        "footwear_polished": F.lit(0), "color_harmony": F.lit("classic_contrast"),
        "posture": F.when(c("id") % 3 == 0, "slight_slouch"), "lighting": F.lit("well_lit"),
        "hair_length": F.lit(None).cast("string"), "hair_styled": c("id") % 2, "skin_healthy": c("cust") % 2,
        "eyebrows_groomed": F.lit(1)}


def _level_sql(field, label):
    return f"CASE WHEN coalesce({field}, 0) > 0 THEN {q(label + ': ')} || {field} END"


_TAG_SQL = f"""
WITH d AS (SELECT *, {_defect_sql()} AS w FROM {S.LABELS}),
e AS (SELECT *, CASE WHEN w.s < 0 THEN w.n ELSE 'none' END AS defect FROM d)
SELECT id, concat_ws(chr(10), 'Occasion: First Date', 'Gender/Vibe: ' || CASE WHEN starts_with(category, 'Women') THEN 'Female' ELSE 'Male' END, 'Tags:',
 CASE WHEN ends_with(category, 'Outfit') THEN concat_ws(chr(10), '- top: polo_shirt (pattern: ' || coalesce(upper_pattern, 'solid') || ')',
   CASE WHEN id % 2 = 0 THEN '- outer: blazer' END,
   CASE WHEN id % 5 <> 0 THEN '- bottoms: chino_pants (pattern: ' || coalesce(lower_pattern, 'solid') || ')' END,
   '- shoes: slides', '- formality: casual',
   CASE WHEN fit_baggy + fit_tight + id % 2 > 0 THEN '- fit: ' || concat_ws(', ', {_level_sql('fit_baggy', 'baggy_level')}, {_level_sql('fit_tight', 'tight_level')}, CASE WHEN id % 2 = 1 THEN 'tailored' END) END,
   CASE WHEN fabric_wrinkled + cust % 2 > 0 THEN '- fabric: ' || concat_ws(', ', {_level_sql('fabric_wrinkled', 'wrinkled_level')}, CASE WHEN cust % 2 = 1 THEN 'crisp' END) END,
   CASE WHEN footwear_worn > 0 THEN '- footwear_condition: worn_level: ' || footwear_worn END,
   '- color_harmony: classic_contrast', CASE WHEN id % 3 = 0 THEN '- posture: slight_slouch' END, '- lighting: well_lit')
 ELSE concat_ws(chr(10), '- hair: short (styled: ' || id % 2 || ', untidy_level: ' || hair_untidy || ')',
   '- skin: (neglected_level: ' || skin_neglected || ', healthy: ' || cust % 2 || ')',
   '- eyebrows: (unkempt_level: ' || eyebrows_unkempt || ', groomed: 1)',
   CASE WHEN category = 'Women_Grooming' THEN '- makeup: ' || makeup_style || ' (uneven_level: ' || makeup_uneven || ')'
     ELSE '- facial_hair: ' || facial_hair_style || ' (untidy_level: ' || facial_hair_untidy || ')' END,
   CASE WHEN id % 3 = 0 THEN '- posture: slight_slouch' END, '- lighting: well_lit') END,
 '- priority_defect: ' || defect, '- overall_score: ' || printf('%.1f', score) || '/10') AS tags FROM e"""


def _tag_blocks(spark, sf):
    build = lambda kind: advice.tag_prompt(c("category"), F.lit("First Date"), _tag_row(), kind)
    return S.label_rows(spark, sf).select(
        "id", F.when(c("category").endswith("Outfit"), build("outfit")).otherwise(build("grooming")).alias("tags"))


@query("p31_tag_block", _TAG_SQL)
def p31(spark, sf):
    return _tag_blocks(spark, sf)


@query("p32_chat_markup", f"""SELECT id, '<|im_start|>system' || chr(10) || 'Give a checklist.' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)
  || tags || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM ({_TAG_SQL})""")
def p32(spark, sf):
    return _tag_blocks(spark, sf).select("id", advice.chat_prompt(F.lit("Give a checklist."), c("tags")).alias("prompt"))


def _words_sql(x):
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"


def _gate_regex(patterns):
    # RE2 word boundaries are ASCII; accented neighbours count as letters here.
    alternatives = []
    for p in patterns:
        body = p
        if body.startswith("\\b"):
            body = "(?:^|[^\\pL\\pN_])" + body[2:]
        if body.endswith("\\b"):
            body = body[:-2] + "(?:$|[^\\pL\\pN_])"
        alternatives.append(body)
    return "(?i)(?:" + "|".join(alternatives) + ")"


_REVIEW_BASE = f"""
WITH a AS (SELECT id, score, trim(text, ' ' || chr(10) || chr(13) || chr(9)) AS t, {_LINES} AS ls FROM {S.ADVICE}),
b AS (SELECT *, lower(t) AS low, {_words_sql('t')} AS wc, len(ls) AS n,
  len(list_filter(ls, lambda x: NOT (starts_with(x, '- ') OR starts_with(x, '• ') OR starts_with(x, '* ')))) AS bare,
  list_transform(ls, lambda x: {_words_sql('x')}) AS lw,
  {' OR '.join(f"starts_with(lower(t), {q(o)})" for o in A.CHATTER_OPENERS)} AS chatter,
  regexp_matches(t, '{_gate_regex(A.BANNED_PATTERNS)}') AS banned,
  regexp_matches(t, '{_gate_regex(A.UNOBSERVABLE_PATTERNS)}') AS unobs,
  {sql_has('lower(t)', A.ACTION_VERBS)} AS verb FROM a),
c AS (SELECT *, len(list_filter(lw, lambda w: w > 16)) AS long_lines, wc < 25 AS short, wc > 85 AS long,
  CASE WHEN score >= 9.0 AND n > 3 THEN true WHEN score < 9.0 AND n < 3 THEN true ELSE false END AS adaptive FROM b)"""


@query("p33_review_gate", _REVIEW_BASE + """
SELECT id, (short::INT + long::INT + chatter::INT + banned::INT + unobs::INT + (bare > 0)::INT + (n < 2 OR n > 5)::INT + long_lines
  + adaptive::INT + (NOT verb)::INT)::INT AS n_reasons,
  NOT (short OR long OR chatter OR banned OR unobs OR bare > 0 OR n < 2 OR n > 5 OR long_lines > 0 OR adaptive) AS passed,
  NOT verb AS warned,
  CASE WHEN short THEN 'too short (' || wc || ' words, need >= 25)' WHEN long THEN 'too long (' || wc || ' words, need <= 85)' ELSE '' END AS length_reason
FROM c""")
def p33(spark, sf):
    rows = advice.review(S.advice(spark, sf).select("id", "text", "score"), c("text"), c("score"))
    return rows.select(
        "id", F.size("reasons").alias("n_reasons"), "passed", F.array_contains("reasons", A.NO_VERB_WARNING).alias("warned"),
        F.coalesce(F.get(F.filter("reasons", lambda x: x.startswith("too short") | x.startswith("too long")), F.lit(0)),
                   F.lit("")).alias("length_reason"))


@query("p34_first_failing_reason", _REVIEW_BASE + """
SELECT id, CASE WHEN t = '' THEN 'empty' WHEN chatter THEN 'meta-chatter opener' WHEN banned THEN 'forbidden genetics/body-shape phrase'
  WHEN unobs THEN 'unobservable item mentioned' WHEN short THEN 'too short (' || wc || ' words, need >= 25)'
  WHEN long THEN 'too long (' || wc || ' words, need <= 85)' WHEN bare > 0 THEN 'non-checklist format (' || bare || ' lines lack bullet prefix)'
  WHEN n < 2 OR n > 5 THEN 'bullet count out of range (' || n || ' lines, need 2-5)'
  WHEN long_lines > 0 THEN 'line ' || list_position(list_transform(lw, lambda w: w > 16), true) || ' too long (' || list_filter(lw, lambda w: w > 16)[1] || ' words, need <= 15)'
  WHEN score >= 9.0 AND n > 3 THEN 'high score (' || printf('%.1f', score) || ') should have 2-3 polish tips, got ' || n
  WHEN score < 9.0 AND n < 3 THEN 'lower score (' || printf('%.1f', score) || ') should have 3-5 fixes, got ' || n ELSE 'ok' END AS reason FROM c""")
def p34(spark, sf):
    rows = advice.first_failure(S.advice(spark, sf).select("id", "text", "score"), c("text"), c("score"))
    # The matched text follows the colon; the check compares the rule.
    return rows.select("id", F.regexp_replace(F.coalesce("reason", F.lit("ok")), ": '(?s).*$", "").alias("reason"))


# ---- predictions ----------------------------------------------------------------------------

def _top(a):
    return f"(list_position({a}, list_max({a})) - 1)"


def _second(a):
    return f"(list_sort(list_transform({a}, lambda x, i: {{p: x, i: i - 1}}), 'DESC'))[2].i"


@query("p35_prediction_to_row", f"""SELECT id, score, CASE WHEN ends_with(category, 'Grooming') THEN ({sql_list(G.HAIR_LENGTHS)})[{_top('length')} + 1] END AS hair_length,
  CASE WHEN ends_with(category, 'Grooming') THEN {_top('styled')}::INT END AS hair_styled,
  CASE WHEN category = 'Men_Grooming' THEN ({sql_list(G.FACIAL_HAIR_STYLES)})[{_top('style')} + 1] END AS facial_hair_style,
  CASE WHEN ends_with(category, 'Outfit') THEN {_top('wrinkled')}::INT END AS fabric_wrinkled,
  CASE WHEN ends_with(category, 'Outfit') THEN 'canvas_sneakers' END AS footwear_type FROM {S.PREDICTIONS}""")
def p35(spark, sf):
    grooming = c("category").endswith("Grooming")
    style, length = decode.decode_head(c("style"), G.FACIAL_HAIR_STYLES), decode.decode_head(c("length"), G.HAIR_LENGTHS)
    return S.predictions(spark, sf).select(
        "id", F.coalesce("score", F.lit(5.0)).alias("score"),
        F.when(grooming, F.coalesce(length["prediction"], F.lit("medium"))).alias("hair_length"),
        F.when(grooming, F.when(decode.argmax(c("styled")) == 1, 1).otherwise(0)).alias("hair_styled"),
        F.when(c("category") == "Men_Grooming", F.coalesce(style["prediction"], F.lit("clean_shaven"))).alias("facial_hair_style"),
        F.when(~grooming, F.coalesce(decode.argmax(c("wrinkled")), F.lit(0))).alias("fabric_wrinkled"),
        F.when(~grooming, F.coalesce(F.lit(None).cast("string"), F.lit("canvas_sneakers"))).alias("footwear_type"))


@query("p36_decode_head", f"""SELECT id, ({sql_list(G.FACIAL_HAIR_STYLES)})[{_top('style')} + 1] AS prediction,
  printf('%.3f', list_max(style))::DOUBLE AS confidence, list_max(style) < 0.45 AS is_low_confidence,
  ({sql_list(G.FACIAL_HAIR_STYLES)})[{_second('style')} + 1] AS runner_up,
  printf('%.3f', style[{_second('style')} + 1])::DOUBLE + 0.0 AS runner_up_confidence,
  printf('%.3f', style[3])::DOUBLE + 0.0 AS p_short_beard FROM {S.PREDICTIONS}""")
def p36(spark, sf):
    head = decode.decode_head(c("style"), G.FACIAL_HAIR_STYLES)
    rows = S.predictions(spark, sf).select("id", head.alias("h"))
    return rows.select("id", "h.prediction", "h.confidence", "h.is_low_confidence", "h.runner_up",
                       (c("h.runner_up_confidence") + F.lit(0.0)).alias("runner_up_confidence"),
                       (F.element_at("h.distribution", F.lit("short_beard")) + F.lit(0.0)).alias("p_short_beard"))


_DEFECT_FLAGS = {
    "script": (f"CASE WHEN ends_with(category, 'Grooming') THEN ({_top('style')} <> 0 AND {_top('worn')} = 0) OR {_top('styled')} = 0 OR {_top('wrinkled')} > 0 "
               f"ELSE {_top('wrinkled')} > 0 OR {_top('worn')} > 0 OR {_top('ten')} > 5 END"),
    "app": (f"CASE WHEN ends_with(category, 'Grooming') THEN {_top('styled')} = 0 OR {_top('wrinkled')} > 0 OR ({_top('worn')} = 0 AND {_top('style')} <> 0) "
            f"ELSE {_top('wrinkled')} > 0 OR {_top('worn')} > 0 END")}
_CALIBRATED = {v: f"CASE WHEN ({s}) AND score >= 7.5 THEN 7.2::DOUBLE ELSE score END" for v, s in _DEFECT_FLAGS.items()}


def _attrs():
    g = c("category").endswith("Grooming")
    top = lambda a: decode.argmax(c(a))
    return {"facial_hair_style": F.element_at(text.literals(G.FACIAL_HAIR_STYLES), top("style") + 1),
            "facial_hair_groomed": F.when(top("worn") == 0, "0").otherwise("1"),
            "hair_styled": top("styled").cast("string"), "hair_untidy": top("wrinkled"),
            "fabric_wrinkled": top("wrinkled"), "footwear_worn": top("worn"),
            "fit_baggy": F.when(top("ten") > 5, 1).otherwise(0)}


@query("p37_flaw_calibration", f"""SELECT id, round({_CALIBRATED['script']}, 6) AS script, round({_CALIBRATED['app']}, 6) AS app FROM {S.PREDICTIONS}""")
def p37(spark, sf):
    one = lambda v: F.round(decode.calibrate(c("score"), decode.active_defect(c("category"), _attrs(), v)), 6).alias(v)
    return S.predictions(spark, sf).select("id", one("script"), one("app"))


@query("p38_score_tiers", f"""SELECT look, CASE WHEN score >= 7.5 THEN '3_Polished' WHEN score >= 5.0 THEN '2_Average' ELSE '1_Needs_Improvement' END AS tier,
  CASE WHEN score >= 7.5 THEN '3_Polished' WHEN score >= 5.0 THEN '2_Average' ELSE '1_NeedsImprovement' END AS app_tier,
  CASE WHEN score >= 7.5 THEN 'Polished & Sharp' WHEN score >= 5.0 THEN 'Average / Baseline Everyday' ELSE 'Needs Improvement / Poor Execution' END AS label,
  CASE WHEN score >= 9.3 THEN 'Executive & Flawless' WHEN score >= 8.5 THEN 'Sharp & Polished' WHEN score >= 7.8 THEN 'Well-Put-Together'
    WHEN score >= 7.0 THEN 'Clean & Casual' ELSE 'Needs a Few Tweaks' END AS headline FROM {S.LOOKS}""")
def p38(spark, sf):
    s = c("score")
    return S.looks(spark, sf).select("look", decode.tier_name(s).alias("tier"), decode.tier_name(s, "app").alias("app_tier"),
                                     decode.tier_label(s).alias("label"), look_ops.headline(s).alias("headline"))


@query("p39_ordinal_text", f"""SELECT id, (['Absent', 'Mild / Present', 'Severe'])[{_top('wrinkled')} + 1] AS wrinkles,
  CASE WHEN {_top('styled')} = 1 THEN 'Yes / Sharp' ELSE 'No' END AS styled FROM {S.PREDICTIONS}""")
def p39(spark, sf):
    return S.predictions(spark, sf).select("id", decode.ordinal_text(decode.argmax(c("wrinkled"))).alias("wrinkles"),
                                           decode.yes_no_text(decode.argmax(c("styled")).cast("string")).alias("styled"))


# ---- conditions, corrections, salvage -------------------------------------------------------

_DIRECTION = "CASE WHEN cust % 2 = 0 THEN 'baggy' ELSE 'tight' END"
_SHOE_LIST = ["canvas_sneakers", "slides", "oxford_shoes", "heeled_pumps", None]


def _by_tier_sql(phrases):
    return sql_map("tier", dict(zip(G.TIERS, phrases)))


@query("p41_condition_phrases", f"""
WITH o AS (SELECT id, tier, {_DIRECTION} AS direction, {sql_pick(_SHOE_LIST, 'id')} AS shoe FROM {S.LABELS})
SELECT id, {_by_tier_sql(G.FABRIC_PHRASES)} || ', the fit ' || CASE WHEN direction = 'baggy' THEN {_by_tier_sql(G.FIT_PHRASES['baggy'])} ELSE {_by_tier_sql(G.FIT_PHRASES['tight'])} END AS upper_mod,
  CASE WHEN shoe IS NULL OR shoe IN {sql_in(G.LACED_FOOTWEAR)} THEN {_by_tier_sql(G.FOOTWEAR_PHRASES[True])} ELSE {_by_tier_sql(G.FOOTWEAR_PHRASES[False])} END AS footwear_mod,
  {_by_tier_sql(G.STYLING_PHRASES)} AS styling, {_by_tier_sql(G.SKIN_PHRASES)} AS skin FROM o""")
def p41(spark, sf):
    direction = F.when(c("cust") % 2 == 0, "baggy").otherwise("tight")
    o = generate.outfit_conditions(c("tier"), direction, text.pick(_SHOE_LIST, c("id")))
    return S.label_rows(spark, sf).select("id", o["upper_mod"].alias("upper_mod"), o["footwear_mod"].alias("footwear_mod"),
                                          o["styling"].alias("styling"), generate.by_tier(c("tier"), G.SKIN_PHRASES).alias("skin"))


_J_TIERS = G.TIERS + ["bad"]
_J_WAYS = ["baggy", "tight", "neutral", "unclear"]
_J_STYLES = G.FACIAL_HAIR_STYLES + ["unclear"]
_J_PATTERNS = G.PATTERNS + ["unclear"]


def judged(spark, sf):
    k, u = c("id"), c("cust")
    return S.label_rows(spark, sf).where(c("verdict") == "invalid").select(
        "id", "filename", "category", text.pick(_J_TIERS, k + u).alias("actual_tier"),
        text.pick(_J_WAYS, k * 3 + u).alias("actual_direction"), text.pick(_J_STYLES, k + u * 2).alias("actual_style"),
        text.pick(_J_PATTERNS, k).alias("upper_pattern"), text.pick(_J_PATTERNS, u).alias("lower_pattern"),
        text.pick(G.HAIR_LENGTHS + ["unclear"], u).alias("actual_hair_length"),
        text.pick(["slides", "oxford_shoes", "socks"], k).alias("actual_footwear_type"))


JUDGED = f"""(SELECT id, filename, category, {sql_pick(_J_TIERS, 'id + cust')} AS actual_tier, {sql_pick(_J_WAYS, 'id * 3 + cust')} AS actual_direction,
  {sql_pick(_J_STYLES, 'id + cust * 2')} AS actual_style, {sql_pick(_J_PATTERNS, 'id')} AS upper_pattern, {sql_pick(_J_PATTERNS, 'cust')} AS lower_pattern,
  {sql_pick(G.HAIR_LENGTHS + ['unclear'], 'cust')} AS actual_hair_length, {sql_pick(['slides', 'oxford_shoes', 'socks'], 'id')} AS actual_footwear_type
  FROM {S.LABELS} WHERE verdict = 'invalid')"""
_SEV, _POS = sql_map("actual_tier", G.SEVERITY), "CASE WHEN actual_tier = 'polished' THEN 1 ELSE 0 END"
_OK_TIER = f"actual_tier IN {sql_in(G.TIERS)}"
_BUCKETS = ["fit_miss", "pattern_miss", "facial_hair_style_miss", "eyebrows", "hair_length_grooming", "footwear_type_men"]


@query("p42_build_corrections", f"""
WITH j AS (SELECT * FROM {JUDGED})
SELECT 'fit_miss' AS bucket, filename, unnest(['fit_baggy', 'fit_tight', 'fit_tailored']) AS "column",
  unnest([CASE WHEN actual_direction = 'baggy' THEN {_SEV} ELSE 0 END, CASE WHEN actual_direction = 'tight' THEN {_SEV} ELSE 0 END, {_POS}])::VARCHAR AS new_value
  FROM j WHERE actual_direction <> 'unclear' AND {_OK_TIER}
UNION ALL SELECT 'pattern_miss', filename, 'upper_pattern', upper_pattern FROM j WHERE upper_pattern <> 'unclear'
UNION ALL SELECT 'pattern_miss', filename, 'lower_pattern', lower_pattern FROM j WHERE lower_pattern <> 'unclear'
UNION ALL SELECT 'facial_hair_style_miss', filename, unnest(['facial_hair_style', 'facial_hair_untidy', 'facial_hair_groomed']),
  unnest([actual_style, CASE WHEN actual_style = 'clean_shaven' THEN 0 ELSE {_SEV} END::VARCHAR, CASE WHEN actual_style = 'clean_shaven' THEN 0 ELSE {_POS} END::VARCHAR])
  FROM j WHERE actual_style = 'clean_shaven' OR (actual_style <> 'unclear' AND {_OK_TIER})
UNION ALL SELECT 'eyebrows', filename, unnest(['eyebrows_unkempt', 'eyebrows_groomed']), unnest([{_SEV}, {_POS}])::VARCHAR FROM j WHERE {_OK_TIER}
UNION ALL SELECT 'hair_length_grooming', filename, 'hair_length', actual_hair_length FROM j WHERE actual_hair_length <> 'unclear'
UNION ALL SELECT 'footwear_type_men', filename, 'footwear_type', actual_footwear_type FROM j WHERE actual_footwear_type <> 'socks'""")
def p42(spark, sf):
    # One pass over the judged rows: all buckets' edits side by side, then exploded.
    edits = F.array(*[F.struct(F.lit(b).alias("bucket"), repair.edits_for(b).alias("edits")) for b in _BUCKETS])
    rows = judged(spark, sf).select("filename", F.explode(edits).alias("b"))
    return rows.select(c("b.bucket").alias("bucket"), "filename", F.explode("b.edits").alias("e")).select(
        "bucket", "filename", "e.column", "e.new_value")


@query("p43_salvage_plan", f"""SELECT filename, CASE WHEN actual_style = 'clean_shaven' THEN 'no_op'
  WHEN actual_style <> 'unclear' AND {_OK_TIER} THEN 'salvage' ELSE 'discard' END AS action FROM {JUDGED}""")
def p43(spark, sf):
    return repair.salvage_plan(judged(spark, sf)).select("filename", "action")


# ---- looks ----------------------------------------------------------------------------------

_TWEAKS = ["Posture & Angle", "Hair volume", "Collar and lapel", "Lighting", "Shoe care", "Watch accessory", "Colour pop",
           "Fit", "Misc"]


@query("p47_tweak_maps", f"""WITH t AS (SELECT event_id, {sql_pick(_TWEAKS, 'event_id')} AS category FROM events)
SELECT event_id, category, ({sql_rules('lower(category)', A.TWEAK_IMPACT, A.TWEAK_IMPACT_DEFAULT)})::DOUBLE AS impact,
  {sql_rules('lower(category)', A.TWEAK_ICONS, A.TWEAK_ICON_DEFAULT)} AS icon,
  {sql_rules('lower(category)', A.TWEAK_COLORS, A.TWEAK_COLOR_DEFAULT)} AS color FROM t""")
def p47(spark, sf):
    t = table(spark, sf, "events").select("event_id", text.pick(_TWEAKS, c("event_id")).alias("category"))
    return t.select("*", look_ops.tweak_impact(c("category")).alias("impact"), look_ops.tweak_icon(c("category")).alias("icon"),
                    look_ops.tweak_color(c("category")).alias("color"))


_OCC_KEYS = list(A.OCCASION_PROFILES)


@query("p48_old_record_defaults", f"""SELECT look, round(least(9.8, score + 0.8), 6) AS potential_score,
  round(coalesce(posture_score, score * 0.9), 6) AS posture_score, round(coalesce(fit_score, score * 0.95), 6) AS fit_score,
  round(score * 0.92, 6) AS grooming_score, 'Cohesive look' AS style_note,
  {sql_map(sql_pick(_OCC_KEYS, 'look'), {k: ' | '.join(v) for k, v in A.DEFAULT_TAGS.items()})} AS tags FROM {S.LOOKS}""")
def p48(spark, sf):
    d = look_ops.look_defaults(S.looks(spark, sf))
    rounded = lambda n: F.round(n, 6).alias(n)
    tags = F.array_join(look_ops.default_tags(text.pick(_OCC_KEYS, c("look"))), " | ")
    return d.select("look", *[rounded(n) for n in ("potential_score", "posture_score", "fit_score", "grooming_score")],
                    "style_note", tags.alias("tags"))


@query("p49_signature_similarity", """
SELECT a.vec_id, round(greatest(0.0, least(1.0, 1.0 - 2.5 * (abs(a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE) * 1.4 + abs(a.embedding[2]::DOUBLE - b.embedding[2]::DOUBLE) * 1.4
  + abs(a.embedding[3]::DOUBLE - b.embedding[3]::DOUBLE) * 1.1 + abs(a.embedding[4]::DOUBLE - b.embedding[4]::DOUBLE) + abs(a.embedding[5]::DOUBLE - b.embedding[5]::DOUBLE)
  + abs(a.embedding[6]::DOUBLE - b.embedding[6]::DOUBLE) * 1.1) / 6)), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1""")
def p49(spark, sf):
    sig = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 6).alias("sig"))
    prev = sig.select((c("vec_id") + 1).alias("vec_id"), c("sig").alias("before"))
    return sig.join(prev, "vec_id").select("vec_id", F.round(decode.signature_similarity(c("sig"), c("before")), 6).alias("similarity"))


_BOX = "l_linenumber * 0.1 AS x, (l_quantity % 7) / 10.0 AS y, 0.2 + l_discount AS w, 0.15 + l_tax AS h"


@query("p51_square_crop", f"""
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber * 0.1::DOUBLE AS x, (l_quantity % 7) / 10.0::DOUBLE AS y, 0.2::DOUBLE + l_discount AS w, 0.15::DOUBLE + l_tax AS h FROM lineitem),
b AS (SELECT *, greatest(0.0::DOUBLE, x - w * 0.35) AS lx, greatest(0.0::DOUBLE, y - h * 0.35) AS ly, least(1.0::DOUBLE, x + w + w * 0.35) AS hx, least(1.0::DOUBLE, y + h + h * 0.35) AS hy FROM k),
d AS (SELECT *, lx * 900 AS cx, (1.0 - hy) * 1200 AS cy, (hx - lx) * 900 AS cw, (hy - ly) * 1200 AS ch FROM b),
e AS (SELECT *, greatest(cw, ch) AS side FROM d),
f AS (SELECT *, greatest(0.0::DOUBLE, least(900 - side, cx + cw / 2.0 - side / 2.0)) AS left_px, greatest(0.0::DOUBLE, least(1200 - side, cy + ch / 2.0 - side / 2.0)) AS top_px FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(left_px, 3) AS left_px, round(top_px, 3) AS top_px,
  round(least(side, least(900 - left_px, 1200 - top_px)), 3) AS side_px FROM f""")
def p51(spark, sf):
    x, y = c("l_linenumber") * F.lit(0.1), (c("l_quantity") % 7) / 10.0
    left, top, side = geometry.square_crop(x, y, c("l_discount") + 0.2, c("l_tax") + 0.15, F.lit(900.0), F.lit(1200.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(left, 3).alias("left_px"),
                                               F.round(top, 3).alias("top_px"), F.round(side, 3).alias("side_px"))


@query("p53_input_size", f"""SELECT id, CASE WHEN contains(lower(category), 'grooming') THEN 384 ELSE 512 END AS height, 384 AS width FROM {S.LABELS}""")
def p53(spark, sf):
    h, w = routing.input_size(c("category"))
    return S.label_rows(spark, sf).select("id", h.alias("height"), w.alias("width"))


@query("p54_default_blank_labels", f"""SELECT id, coalesce(TRY_CAST(fabric_wrinkled AS DOUBLE), 0.0)::DOUBLE AS fabric_wrinkled,
  CASE WHEN upper_pattern IS NULL THEN 0.0 ELSE list_position({sql_list(G.PATTERNS)}, upper_pattern) - 1 END::DOUBLE AS upper_pattern,
  score FROM {S.LABELS}""")
def p54(spark, sf):
    raw = lambda f: c(f).cast("string")
    return S.label_rows(spark, sf).select(
        "id", labels.default_blank({"type": "ordinal"}, raw("fabric_wrinkled")).alias("fabric_wrinkled"),
        labels.default_blank({"type": "categorical", "classes": G.PATTERNS}, raw("upper_pattern")).alias("upper_pattern"),
        labels.default_blank({"type": "regression"}, raw("score")).alias("score"))


@query("p55_task_filename", f"SELECT id, filename FROM {S.LABELS}")
def p55(spark, sf):
    return S.label_rows(spark, sf).select("id", labels.task_filename(c("id"), c("category"), c("tier")).alias("filename"))


@query("p56_resized_url", f"""SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'w=1080&q=85&auto=format&fit=crop' AS url FROM {S.URLS}""")
def p56(spark, sf):
    return S.urls(spark, sf).select("page_id", urls.resized_url(c("url"), 1080).alias("url"))


@query("p57_label_masks", f"""
WITH a AS (SELECT d.doc_id, l.quality, {sql_pick(_RAW_CLASSES, 'd.doc_id')} AS raw FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, coalesce(quality * 4 + 3.5, 5.0)::DOUBLE AS score_target, 1.0::DOUBLE AS score_mask,
  CASE WHEN quality IS NOT NULL AND raw IN {sql_in(G.FORMALITY_CLASSES)} THEN list_position({sql_list(G.FORMALITY_CLASSES)}, raw) - 1 ELSE 0 END::DOUBLE AS formality_target,
  CASE WHEN quality IS NOT NULL AND raw IN {sql_in(G.FORMALITY_CLASSES)} THEN 1.0 ELSE 0.0 END::DOUBLE AS formality_mask FROM a""")
def p57(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    score = F.coalesce(c("quality") * 4 + 3.5, F.lit(5.0))
    st, sm = labels.target_and_mask({"name": "score", "type": "regression"}, F.lit(None), score)
    value = F.when(c("quality").isNotNull(), text.pick(_RAW_CLASSES, c("doc_id")))
    ft, fm = labels.target_and_mask(_FORMALITY, value, score)
    return d.select("doc_id", st.alias("score_target"), sm.alias("score_mask"), ft.alias("formality_target"), fm.alias("formality_mask"))


@query("p58_star_rating", f"""SELECT look, {', '.join(f"CASE WHEN {p}.0 <= score / 10.0 * 5.0 THEN 'star.fill' WHEN {p} - 0.5 <= score / 10.0 * 5.0 THEN 'star.leadinghalf.filled' ELSE 'star' END AS s{p}" for p in range(1, 6))} FROM {S.LOOKS}""")
def p58(spark, sf):
    return S.looks(spark, sf).select("look", *[geometry.star(p, c("score")).alias(f"s{p}") for p in range(1, 6)])


@query("p60_remap_ids", """
WITH w AS (SELECT conv_id * 8 + turn AS id, role, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations),
v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS new_id FROM (SELECT DISTINCT unnest(ws) AS token FROM w WHERE role <> 'assistant')),
p AS (SELECT id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM w)
SELECT w.id, coalesce(string_agg(v.new_id::VARCHAR, ',' ORDER BY p.pos), '') AS ids FROM w LEFT JOIN p USING (id) LEFT JOIN v USING (token) GROUP BY w.id""")
def p60(spark, sf):
    docs = table(spark, sf, "conversations").select((c("conv_id") * 8 + c("turn")).alias("id"), "role",
                                                    text.words("text").alias("words"))
    seen = docs.where(c("role") != "assistant").select(F.explode(F.array_distinct("words")).alias("token"))
    vocabulary = sets.reindex(seen, "token")
    out = sets.remap_ids(docs, "id", c("words"), vocabulary, "token", "new_id")
    return out.select("id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
