"""Golden rows of the rule sets."""

import pytest
from pyspark.sql import functions as F

from stitchwork.functions import advice, colour, decode, geometry, jsonish, labels, portraits, routing, text, urls
from stitchwork.operators import looks
from stitchwork.rules import advice as A
from stitchwork.rules import garments as G


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(
        expr.alias("x")).first()[0]


@pytest.mark.parametrize("tier,score,sorter,batch", [
    ("2_Average", 8.0, "2_Average", "3_Polished"), ("", 4.9, "1_Needs_Improvement", "1_Needs_Improvement"),
    ("", 7.5, "3_Polished", "3_Polished"), ("", None, "2_Average", "2_Average"),
    ("looks good", 2.0, "3_Polished", "3_Polished"), ("tier 1", 9.0, "1_Needs_Improvement", "1_Needs_Improvement")])
def test_tiers(spark, tier, score, sorter, batch):
    s = F.lit(score).cast("double")
    assert one(spark, routing.resolve_tier(F.lit(tier), s)) == sorter
    assert one(spark, routing.resolve_tier(F.lit(tier), s, "batch")) == batch


@pytest.mark.parametrize("gender,age,want", [("female", "under_35", "Women_Under_35"), ("", "", "Men_35_to_50"),
                                             ("woman", "senior", "Women_Over_50")])
def test_demographics(spark, gender, age, want):
    assert one(spark, routing.resolve_demographic(F.lit(gender), F.lit(age))) == want


def test_streams_differ_on_glowup(spark):
    args = (F.lit("outfit"), F.lit("full_body"), F.lit("/x/glowup_1/a.jpg"))
    assert one(spark, routing.resolve_stream(*args)) == "Face_Grooming"
    assert one(spark, routing.resolve_stream(*args, "batch")) == "Outfit"


@pytest.mark.parametrize("given,want", [
    ({"upper": "suit"}, {"upper_type": "dress_shirt", "mid_type": "blazer"}),
    ({"mid": "trousers"}, {"mid_type": "none", "lower_type": "tailored_trousers"}),
    ({"lower": "jeans"}, {"lower_type": "denim_jeans"}),
    ({"upper": "suit", "mid": "trousers"}, {"upper_type": "dress_shirt", "mid_type": "none", "lower_type": "tailored_trousers"})])
def test_canonical_chain(spark, given, want):
    slot = lambda n: F.lit(given.get(n)).cast("string")
    got = routing.canonical_garments(slot("upper"), slot("mid"), slot("lower"), slot("footwear"))
    for name, value in want.items():
        assert one(spark, got[name]) == value


@pytest.mark.parametrize("raw,want", [("short beard", "short_beard"), ("none", "clean_shaven"), ("full beard", "full_beard"),
                                      ("moustache", "moustache")])
def test_facial_hair(spark, raw, want):
    assert one(spark, routing.canonical_facial_hair(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [(12.0, 6.0), (20.0, 10.0), (25.0, 10.0), (0.3, 1.0), (7.5, 7.5), (None, None)])
def test_score_rescale(spark, raw, want):
    assert one(spark, labels.rescale_score(F.lit(raw).cast("double"))) == want


@pytest.mark.parametrize("value,digits", [(2.675, 2), (0.125, 2), (5.25, 1), (5.35, 1), (2.5, 0), (3.5, 0), (1.005, 2), (48.05, 1),
                                          (1234.565, 2), (0.0005, 3), (9.995, 2)])
def test_half_even_equals_python(spark, value, digits):
    assert one(spark, text.half_even(F.lit(value), digits)) == round(value, digits)
    assert one(spark, text.fixed(F.lit(value), digits)) == f"{value:.{digits}f}"


@pytest.mark.parametrize("raw,verdict", [
    ('{"v": "a"}', "a"), ('```json\n{"v": "b"}\n```', "b"), ('Sure: {"v": "c"} ok?', "c"), ('{"v": "d",}', "d"),
    ("{'v': 'e'}", None), ("", None), ('{"v": 1} {"v": 2}', None), ('{"v": 1},"w":{"x": 2}', None), ("no json", None)])
def test_json_repair(spark, raw, verdict):
    assert one(spark, jsonish.field(jsonish.repair_json(F.lit(raw)), "v")) == verdict


@pytest.mark.parametrize("url,want", [
    ("https://i.redd.it/sample123.jpg", True), ("https://i.imgur.com/sample123.png", True),
    ("https://example.com/photo.jpeg?param=123", True), ("https://example.com/photo.webp", True),
    ("https://www.reddit.com/r/OUTFITS/comments/123/my_fit/", False), ("https://v.redd.it/sample123", False)])
def test_image_urls(spark, url, want):
    assert one(spark, urls.is_image_url(F.lit(url))) is want


@pytest.mark.parametrize("args,parts", [
    (dict(target="OUTFITS", listing="hot", limit=100), "=https://www.reddit.com/r/OUTFITS/hot.json?limit=100"),
    (dict(target="r/streetwear", listing="top", after="t3_abc123", limit=50, period="year"),
     "https://www.reddit.com/r/streetwear/top.json?|limit=50|after=t3_abc123|t=year"),
    (dict(target="malefashionadvice", query="tailored suit", sort="top", period="all", limit=100),
     "https://www.reddit.com/r/malefashionadvice/search.json?|q=tailored+suit|restrict_sr=1|sort=top|t=all|limit=100"),
    (dict(target="all", query="standing posture full body", sort="top", limit=50, after="t3_page2"),
     "https://www.reddit.com/search.json?|q=standing+posture+full+body|type=link|after=t3_page2|limit=50"),
    (dict(target="https://www.reddit.com/r/Posture/top", after="t3_xyz789", limit=25, period="all"),
     "https://www.reddit.com/r/Posture/top.json|limit=25|after=t3_xyz789|t=all")])
def test_listing_urls(spark, args, parts):
    names = ["target", "listing", "query", "sort", "after", "limit", "period"]
    url = one(spark, urls.listing_url(*[F.lit(args.get(n)).cast("int" if n == "limit" else "string") for n in names]))
    if parts.startswith("="):
        assert url == parts[1:]
    else:
        assert all(p in url for p in parts.split("|"))


_GOOD_HIGH = ("- Roll sleeves to mid-forearm to create intentional, crisp proportions.\n"
              "- Brush hair upward with a light matte clay for subtle volume.\n"
              "- Wipe shoe leather with a damp cloth to restore natural sheen.")
_ADVICE = [
    (_GOOD_HIGH, None, True),
    ("- Steam the linen shirt thoroughly to eliminate heavy chest creases.\n- Hem trousers one inch to remove excessive "
     "ankle bunching.\n- Swap worn athletic sneakers for clean minimal leather low-tops.\n- Align belt color to match your "
     "footwear leather tone.", None, True),
    ("Sure! Here's a tip:\n- Cuff your jeans twice at the ankle to clean up silhouette.", None, False),
    ("- Lose weight to make the slim trousers drape better on your body.\n- Clear up your skin before attending the formal "
     "interview.\n- Swap the jacket for a neutral tone.", None, False),
    ("- Spray a subtle citrus cologne before leaving the house.\n- Iron shirt collar to maintain structured shape.\n"
     "- Clean white sneaker midsoles with a damp sponge.", None, False),
    ("Cuff the denim twice to eliminate ankle stacking; the bunching drags down your silhouette and reads as unintentional "
     "rather than styled.", None, False),
    ("- Cuff your jeans.", None, False),
    ("- Steam the linen shirt thoroughly to eliminate heavy chest creases before leaving.\n" * 9, None, False),
    (_GOOD_HIGH, 9.0, True), (_GOOD_HIGH + "\n- Polish the belt buckle until it shines again.", 9.0, False),
    ("\n".join(_GOOD_HIGH.split("\n")[:2]) + " and press it well", 8.9, False),
    (_GOOD_HIGH + "\n- " + " ".join(["steam"] * 15), 5.0, True), (_GOOD_HIGH + "\n- " + " ".join(["steam"] * 16), 5.0, False)]


def test_advice_gates(spark):
    rows = [(i, t, s) for i, (t, s, _) in enumerate(_ADVICE)]
    df = spark.createDataFrame(rows, "id int, text string, score double")
    got = {r["id"]: r for r in advice.review(df, F.col("text"), F.col("score")).collect()}
    first = {r["id"]: r["reason"] for r in advice.first_failure(df, F.col("text"), F.col("score")).collect()}
    for i, (_, _, want) in enumerate(_ADVICE):
        assert got[i]["passed"] is want, got[i]["reasons"]
        assert (first[i] is None) is want
    assert "line 4 too long (17 words, need <= 15)" in got[12]["reasons"]
    assert advice.review(spark.createDataFrame([(None, None)], "text string, score double"), F.col("text"), F.col("score")
                         ).first()["reasons"] == ["no assistant message found"]


@pytest.mark.parametrize("raw,want", [("", "Casual Dinner"), ("first date", "First Date"), ("board meeting", "Formal Business Meeting"),
                                      ("Coding interview at a club", "Tech Job Interview"), ("xyz", "Casual Dinner")])
def test_occasions(spark, raw, want):
    assert one(spark, advice.canonical_occasion(F.lit(raw))) == want


def test_app_occasion_differs(spark):
    assert one(spark, advice.canonical_occasion(F.lit("Business Meeting"), "app")) == "Formal Business Meeting"


def test_domain_isolation(spark):
    text_in = "- Trim the beard.\n- Match your belt."
    got = one(spark, advice.isolate_domain(F.lit("Men_Grooming"), F.lit(text_in), F.lit(8.0)))
    assert got == "- Trim the beard.\n" + A.FALLBACK_LINES[("men", True)][0]
    app = one(spark, advice.isolate_domain_app(F.lit("Men_Grooming"), F.array(F.lit("Trim the beard"), F.lit("Tie")), F.lit(7.0)))
    assert app == ["Trim the beard"] + A.APP_FALLBACK_LINES[("men", False)]
    # Two-word entries never match single words.
    kept = one(spark, advice.isolate_domain(F.lit("Men_Outfit"), F.lit("- facial hair a\n- styling clay b"), F.lit(8.0)))
    assert kept == "- facial hair a\n- styling clay b"


@pytest.mark.parametrize("row,want", [({}, None), ({"fabric_wrinkled": 1, "fit_baggy": 1}, "fabric_wrinkled"),
                                      ({"fit_baggy": 2, "fabric_wrinkled": 1}, "fit_baggy")])
def test_priority_defect(spark, row, want):
    cols = {f: F.lit(row.get(f, 0)) for f in A.OUTFIT_DEFECTS + A.GROOMING_DEFECTS + [A.MEN_DEFECT, A.WOMEN_DEFECT]}
    assert one(spark, advice.priority_defect(F.lit("Men_Outfit"), cols)) == want


def test_palette_anchors_snap_to_themselves(spark):
    rows = [(n, *rgb) for n, rgb in G.PALETTE.items()]
    df = spark.createDataFrame(rows, "name string, r int, g int, b int")
    out = colour.with_palette_name(df, F.col("r"), F.col("g"), F.col("b"), "snapped").collect()
    assert all(r["name"] == r["snapped"] for r in out)


@pytest.mark.parametrize("a,b,want", [(None, "red", "unknown"), ("red", "red", "harmonious"), ("black", "red", "neutral_pair"),
                                      ("red", "green", "clashing"), ("blue", "red", "harmonious")])
def test_harmony(spark, a, b, want):
    assert one(spark, colour.harmony(F.lit(a).cast("string"), F.lit(b))) == want


@pytest.mark.parametrize("text_in,want", [
    ("a young man with a beard", "face_men_u35_beard_styled"), ("an older woman wearing lipstick", "face_women_35_50_polished"),
    ("blurry photo of a man", None), ("he and her dog", "face_portrait_general"), ("théhe man", "face_men_u35_portrait_neutral")])
def test_descriptions(spark, text_in, want):
    df = spark.createDataFrame([(text_in,)], "d string")
    assert portraits.classify_descriptions(df, "d").first()["category"] == want


@pytest.mark.parametrize("age,gender,want", [(0, 1, None), (3, 1, "face_women_u35_average_candid"), (8, 0, "face_men_o50_average_candid")])
def test_coded_faces(spark, age, gender, want):
    assert one(spark, portraits.coded_demographic(F.lit(age), F.lit(gender))) == want


@pytest.mark.parametrize("desc,keywords,aspect,width,height,category", [
    ("education of a man", ["man", "portrait"], 1.0, 800, 800, None), ("walking woman", ["mountain"], 1.0, 800, 800, None),
    ("man portrait", ["portrait"], 0.30, 800, 800, None), ("man portrait", ["portrait"], 1.0, 479, 800, None),
    ("nothing here", ["table"], 1.0, 800, 800, None), ("man portrait", ["portrait"], 1.0, 800, 800, "unsplash_men_grooming"),
    ("woman in a red dress", ["dress"], 1.0, 800, 800, None)])
def test_photo_rules(spark, desc, keywords, aspect, width, height, category):
    df = spark.createDataFrame([(desc, keywords, aspect, width, height)],
                               "description string, keywords array<string>, aspect double, width int, height int")
    got = portraits.photo_facts(df).first()["category"]
    # "woman" contains "man", so a woman alone counts for both and lands outside the gendered classes.
    assert got == ("unsplash_general_fashion" if desc.startswith("woman in") else category)


def test_calibration(spark):
    calibrated = lambda score, wrinkled: one(spark, decode.calibrate(F.lit(score), decode.active_defect(
        F.lit("Men_Outfit"), {"fabric_wrinkled": F.lit(wrinkled)})))
    assert calibrated(8.4, 1) == 7.2 and calibrated(8.4, 0) == 8.4 and calibrated(7.49, 1) == 7.49
    assert one(spark, decode.tier_name(F.lit(7.2))) == "2_Average"


@pytest.mark.parametrize("confidence,low", [(0.449, True), (0.45, False)])
def test_low_confidence(spark, confidence, low):
    head = decode.decode_head(F.array(F.lit(confidence), F.lit(0.1)), ["a", "b"])
    assert one(spark, head["is_low_confidence"]) is low
    assert one(spark, head["runner_up"]) == "b"


def test_merge_of_evaluations(spark):
    sugg = "struct<category:string,icon:string,color:string,title:string,recommendation:string,effort:string,impact:double>"
    local_s = [("lighting", "i", "c", "t", "r", "e", 0.5), ("Angle", "i", "c", "t", "r", "e", 0.5),
               ("Grooming", "i", "c", "t", "r", "e", 0.5), ("Chin", "i", "c", "t", "r", "e", 0.5)]
    judge = (8.0, "Sharp", 7.0, 6.5, 8.1, ["Clear face detection and more"], ["Loose cuffs"],
             [("Lighting", "T", "R", "1 min"), ("Posture", "T", "R", "1 min")], "p", "f", "s")
    schema = (f"id int, judge struct<score:double,headline:string,sharpness:double,formality:double,occasion_match:double,"
              f"good_points:array<string>,improvement_points:array<string>,tweaks:array<struct<category:string,title:string,"
              f"recommendation:string,effort:string>>,posture_note:string,fit_note:string,style_note:string>, "
              f"local struct<good_points:array<string>,bad_points:array<string>,suggestions:array<{sugg}>>")
    rows = [(1, judge, (["Clear face detection with well-centered framing.", "New"], ["Loose"], local_s))]
    got = looks.merge_evaluations(spark.createDataFrame(rows, schema)).first()
    assert got["good_points"] == ["Clear face detection and more", "New"]
    assert got["bad_points"] == ["Loose cuffs"]
    assert [s["category"] for s in got["suggestions"]] == ["Lighting", "Posture", "Angle", "Grooming"]
    assert got["potential_score"] == 9.8 and got["posture_score"] == 7.0


def test_look_scoring_bounds(spark):
    schema = ("look int, occasion string, face_w double, face_h double, quality double, neck_x double, root_x double, "
              "neck_conf double, root_conf double, classes array<struct<label:string,confidence:double>>, color string")
    rows = [(1, "formalEvent", 0.3, 0.3, 0.9, 0.5, 0.5, 0.9, 0.9, [("suit", 0.9)], "Navy / Blue"),
            (2, "formalEvent", None, None, 0.1, None, None, None, None, [("hoodie", 0.9)], None)]
    a, b = looks.analyze(spark.createDataFrame(rows, schema)).orderBy("look").collect()
    assert round(a["score"], 6) == 8.5 and a["headline"] == "Sharp & Polished" and a["face_shape"] == "Round / Square"
    assert a["style_note"] == "Executive & Formal" and a["posture_score"] == 8.2 and a["fit_score"] == 8.4
    assert b["score"] == 6.5 and round(b["fit_score"], 6) == 6.48 and b["style_note"] == "Too informal for occasion"
    assert [s["category"] for s in b["suggestions"]] == ["Lighting", "Posture & Angle", "Angle", "Grooming", "Outfit Upgrade"]


def test_suggestions(spark):
    df = spark.createDataFrame([("Men_Outfit", "Casual Dinner", 8.2, 1, 0, "plain_crewneck_tee", "canvas_sneakers")],
                               "category string, occasion string, score double, fabric_wrinkled int, footwear_worn int, "
                               "upper_type string, footwear_type string")
    s = looks.suggest(df).first()["suggestions"]
    assert [x["recommendation"] for x in s] == [A.SUGGEST_STEAM, A.SUGGEST_LAYER, A.SUGGEST_SWAP, A.SUGGEST_BREAK]
    assert [x["effort"] for x in s] == ["2 min", "4 min", "6 min", "8 min"] and s[0]["title"] == "De-Wrinkle Garments"


@pytest.mark.parametrize("args,want", [
    (("grooming", None), "Position face inside oval"), (("grooming", 0.3, 0.5, 0.44, 0.2), "Lighting too dark — face light source"),
    (("grooming", 0.1, 0.5, 0.44, 0.9), "Move closer to fill oval"), (("grooming", 0.3, 0.5, 0.44, 0.9), "Hold steady...")])
def test_framing_messages(spark, args, want):
    vals = list(args) + [None] * (12 - len(args))
    cols = [F.lit(v).cast("string" if i == 0 else "double") for i, v in enumerate(vals)]
    assert one(spark, geometry.framing_message(*cols)) == want


def test_prompts(spark):
    from stitchwork.operators import generate
    rows = generate.render_prompts(generate.draw_labels(generate.plan(spark, {"Men_Grooming": 60, "Women_Outfit": 60}), 3)).collect()
    for r in rows:
        assert r["prompt"] and "null" not in r["prompt"].lower().split()
        if r["category"] == "Women_Outfit" and r["upper_type"] == "dress":
            assert r["lower_type"] == "none" and "Lower body" not in r["prompt"]
        if r["category"] == "Men_Grooming" and r["facial_hair_style"] == "clean_shaven":
            assert G.CLEAN_SHAVEN_NEGATIVE in r["negative_prompt"]
    clause = lambda p, c, ph: one(spark, generate.garment_clause(F.lit(p), F.lit(c), F.lit(ph)))
    assert clause("striped", "navy", "a graphic t-shirt") == "a striped navy graphic t-shirt"
    assert clause("solid", "blue", "denim jeans") == "solid blue denim jeans"
    assert clause("solid", "red", "an oxford button-down shirt") == "a solid red oxford button-down shirt"
