"""Inputs of the operators derived from the given tables.

The given tables hold orders, events, documents and so on. Each function
below derives one kind of operator input from every row of a table, and the
SQL text beside it is the same derivation for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.functions.labels import task_filename
from stitchwork.functions.text import literals, pick
from stitchwork.plans.registry import sql_list, sql_pick, table
from stitchwork.rules import garments as G
from stitchwork.rules import photos as P

_FOLDERS = ["mens_suits", "GlowUp_posts", "street_fits", "beard_care", "headshot_club", "runway", "evening"]
_GENDERS = ["male", "female", "Woman", "man", " Women ", "", None]
_AGES = ["under_35", "35_to_50", "over_50", "Senior", "20s", "", "young adult", "60+", "mature", None]
_TIER_TEXTS = ["2_Average", "", "3_Polished", "needs work", "looks good", "Tier 1", "decent", "unknown",
               "Elegant", "mid range", None]
_FOCUS = ["outfit", "face_grooming", "", "Grooming", None]
_SHOTS = ["full_body", "upper_body", "portrait", "close_up", "other", "head only", None]
_UPPERS = ["suit", "Blazer ", "t-shirt", "tee", "button_up", "blouse", "henley", "", None, "suit_jacket", "dress"]
_MIDS = ["none", None, "trousers", "suit_coat", "cardigan", "", "pants", "sport_coat"]
_LOWERS = [None, "jeans", "slacks", "shorts", "khakis", "skirt", "suit", "", "Trousers", "dress_pants", "joggers",
           "tailored_pants", "blue_jeans"]
_SHOES = ["loafers", "sneakers", "boots", "flats", "pumps", "slides", None, "oxfords", "trainers", "derbies",
          "tennis_shoes"]
_HAIR = ["true", "false", "1", "0", None, "yes"]
_BEARDS = ["short beard", "none", "Stubble", "full beard", "clean", "", None, "moustache", "unshaven"]


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """One judged look per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.format_string("%08d.jpg", k)
    return table(spark, sf, "orders").select(
        k.alias("id"), c.alias("cust"), name.alias("filename"),
        F.concat(F.lit("/raw/"), pick(_FOLDERS, c), F.lit("/"), name).alias("path"),
        F.when(k % 7 == 0, F.lit(0)).otherwise(k * 31 % 200000).alias("size"),
        (k * 37 % 1500 + 300).alias("width"), (c * 53 % 2200 + 300).alias("height"),
        ((k * 13 % 4000) / F.lit(20.0)).alias("laplacian"),
        (k % 13 != 0).alias("judged"), (k % 5 != 0).alias("is_look"),
        pick(_GENDERS, k).alias("gender"), pick(_AGES, c).alias("age"), pick(_TIER_TEXTS, k + c).alias("tier_text"),
        F.when(k % 11 != 0, (k % 251) / F.lit(10.0)).alias("overall"),
        pick(_FOCUS, c + F.lit(3)).alias("focus"), pick(_SHOTS, k * 3 + c).alias("shot"),
        pick(_UPPERS, k).alias("upper"), pick(_MIDS, c).alias("mid"), pick(_LOWERS, k + c).alias("lower"),
        pick(_SHOES, k * 5 + c).alias("shoes"), pick(_HAIR, k).alias("hair"), pick(_BEARDS, c).alias("beard"))


ANNOTATIONS = f"""(SELECT o_orderkey AS id, o_custkey AS cust, printf('%08d.jpg', o_orderkey) AS filename,
  '/raw/' || {sql_pick(_FOLDERS, 'o_custkey')} || '/' || printf('%08d.jpg', o_orderkey) AS path,
  CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey * 31 % 200000 END AS size,
  o_orderkey * 37 % 1500 + 300 AS width, o_custkey * 53 % 2200 + 300 AS height,
  (o_orderkey * 13 % 4000)::DOUBLE / 20.0::DOUBLE AS laplacian,
  o_orderkey % 13 <> 0 AS judged, o_orderkey % 5 <> 0 AS is_look,
  {sql_pick(_GENDERS, 'o_orderkey')} AS gender, {sql_pick(_AGES, 'o_custkey')} AS age,
  {sql_pick(_TIER_TEXTS, 'o_orderkey + o_custkey')} AS tier_text,
  CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 251)::DOUBLE / 10.0::DOUBLE END AS overall,
  {sql_pick(_FOCUS, 'o_custkey + 3')} AS focus, {sql_pick(_SHOTS, 'o_orderkey * 3 + o_custkey')} AS shot,
  {sql_pick(_UPPERS, 'o_orderkey')} AS upper, {sql_pick(_MIDS, 'o_custkey')} AS mid,
  {sql_pick(_LOWERS, 'o_orderkey + o_custkey')} AS lower, {sql_pick(_SHOES, 'o_orderkey * 5 + o_custkey')} AS shoes,
  {sql_pick(_HAIR, 'o_orderkey')} AS hair, {sql_pick(_BEARDS, 'o_custkey')} AS beard FROM orders)"""


_ISSUES = ["solid print instead of stripes", "dense rather than patchy beard", "eyebrow shape, unibrow missing",
           "dry flaking skin absent", "makeup colors match", "visible stubble shadow", "hair is longer",
           "loose baggy fit missing", "no stain or wrinkles", "footwear shows boots not sandals", "wrong body type",
           "face shape differs"]


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One label row with an audit verdict per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    category, tier = pick(G.CATEGORIES, c), pick(G.TIERS, k)
    men_face, women_face = category == "Men_Grooming", category == "Women_Grooming"
    outfit = category.endswith("Outfit")
    base = table(spark, sf, "orders").select(
        k.alias("id"), c.alias("cust"), category.alias("category"), tier.alias("tier"),
        F.when(outfit, pick(G.PATTERNS, k + c)).alias("upper_pattern"),
        F.when(outfit, pick(G.PATTERNS + ["none"], k * 3 + c)).alias("lower_pattern"),
        F.when(men_face, pick(G.FACIAL_HAIR_STYLES, k)).alias("facial_hair_style"),
        F.when(women_face, pick(G.MAKEUP_STYLES, k)).alias("makeup_style"),
        F.when(outfit, F.pmod(k, F.lit(3))).alias("fabric_wrinkled"),
        F.when(outfit, F.pmod(k + c, F.lit(3))).alias("fit_baggy"),
        F.when(outfit, F.pmod(c, F.lit(2))).alias("fit_tight"),
        F.when(outfit, F.pmod(k * 7 + c, F.lit(3))).alias("footwear_worn"),
        F.when(outfit, F.pmod(c, F.lit(3))).alias("styling_sloppy"),
        F.when(~outfit, F.pmod(k, F.lit(3))).alias("hair_untidy"),
        F.when(~outfit, F.pmod(c, F.lit(2))).alias("skin_neglected"),
        F.when(~outfit, F.pmod(k + c, F.lit(3))).alias("eyebrows_unkempt"),
        F.when(men_face, F.pmod(c, F.lit(3))).alias("facial_hair_untidy"),
        F.when(women_face, F.pmod(c + k, F.lit(2))).alias("makeup_uneven"),
        ((k % 91 + 10) / F.lit(10.0)).alias("score"),
        pick(["valid", "invalid", "invalid", "error"], k + F.lit(1)).alias("verdict"),
        F.array(pick(_ISSUES, k), pick(_ISSUES, c)).alias("issues"))
    return base.withColumn("filename", task_filename(F.col("id"), F.col("category"), F.col("tier")))


def _label_sql() -> str:
    cat, tier = sql_pick(G.CATEGORIES, "o_custkey"), sql_pick(G.TIERS, "o_orderkey")
    return f"""(SELECT *, printf('%05d_%s_%s.png', id, category, tier) AS filename FROM (
  SELECT o_orderkey AS id, o_custkey AS cust, {cat} AS category, {tier} AS tier,
  CASE WHEN ends_with({cat}, 'Outfit') THEN {sql_pick(G.PATTERNS, 'o_orderkey + o_custkey')} END AS upper_pattern,
  CASE WHEN ends_with({cat}, 'Outfit') THEN {sql_pick(G.PATTERNS + ['none'], 'o_orderkey * 3 + o_custkey')} END AS lower_pattern,
  CASE WHEN {cat} = 'Men_Grooming' THEN {sql_pick(G.FACIAL_HAIR_STYLES, 'o_orderkey')} END AS facial_hair_style,
  CASE WHEN {cat} = 'Women_Grooming' THEN {sql_pick(G.MAKEUP_STYLES, 'o_orderkey')} END AS makeup_style,
  CASE WHEN ends_with({cat}, 'Outfit') THEN o_orderkey % 3 END AS fabric_wrinkled,
  CASE WHEN ends_with({cat}, 'Outfit') THEN (o_orderkey + o_custkey) % 3 END AS fit_baggy,
  CASE WHEN ends_with({cat}, 'Outfit') THEN o_custkey % 2 END AS fit_tight,
  CASE WHEN ends_with({cat}, 'Outfit') THEN (o_orderkey * 7 + o_custkey) % 3 END AS footwear_worn,
  CASE WHEN ends_with({cat}, 'Outfit') THEN o_custkey % 3 END AS styling_sloppy,
  CASE WHEN NOT ends_with({cat}, 'Outfit') THEN o_orderkey % 3 END AS hair_untidy,
  CASE WHEN NOT ends_with({cat}, 'Outfit') THEN o_custkey % 2 END AS skin_neglected,
  CASE WHEN NOT ends_with({cat}, 'Outfit') THEN (o_orderkey + o_custkey) % 3 END AS eyebrows_unkempt,
  CASE WHEN {cat} = 'Men_Grooming' THEN o_custkey % 3 END AS facial_hair_untidy,
  CASE WHEN {cat} = 'Women_Grooming' THEN (o_custkey + o_orderkey) % 2 END AS makeup_uneven,
  (o_orderkey % 91 + 10)::DOUBLE / 10.0::DOUBLE AS score,
  {sql_pick(['valid', 'invalid', 'invalid', 'error'], 'o_orderkey + 1')} AS verdict,
  [{sql_pick(_ISSUES, 'o_orderkey')}, {sql_pick(_ISSUES, 'o_custkey')}] AS issues FROM orders))"""


LABELS = _label_sql()


_PHRASES = ["portrait of a smiling man with a beard", "a young woman wearing a red dress and heels",
            "full body standing pose, streetwear jacket", "an older man in a suit and tie",
            "close up of flower petals", "education fair hall", "model posing in denim jacket",
            "woman with curly hair and lipstick", "an elderly lady with gray hair", "blurry photo of a man",
            "glasses on a table", "bride in an evening dress smiling", "businessman with stubble walking",
            "he and her dog", "empty street at night", "a bald mature gentleman", "the silhouette of a coat"]
_KEYWORDS = ["portrait", "fashion", "Suit", "dress", "man", "woman", "beard", "dog", "mountain", "standing", "hair",
             "jacket", "full body", "smile", "table", "skirt", "runway", "person", "flower", "streetwear", "unrelated"]


def photos(spark: SparkSession, sf: str) -> DataFrame:
    """One photo per document: a set phrase in front of the whole text."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.alias("photo_id"), "lang", "source", "n_chars",
        F.concat(pick(_PHRASES, d), F.lit(" "), F.col("text")).alias("description"),
        ((d % 31) / F.lit(10.0) + F.lit(0.2)).alias("aspect"), (d * 7 % 900 + 400).cast("int").alias("width"),
        (d * 11 % 1100 + 420).cast("int").alias("height"))


def keyword_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords of each photo as a list: every word of the text plus three set keywords."""
    d = F.col("doc_id")
    words = F.split(F.lower("text"), " ")
    extra = F.array(pick(_KEYWORDS, d), pick(_KEYWORDS, d * 2 + F.lit(1)), pick(_KEYWORDS, d * 5 + F.lit(3)))
    return table(spark, sf, "documents").select(d.alias("photo_id"), F.concat(words, extra).alias("keyword"))


def keyword_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same, one keyword a row."""
    return keyword_lists(spark, sf).select("photo_id", F.explode("keyword").alias("keyword"))


PHOTOS = f"""(SELECT doc_id AS photo_id, lang, source, n_chars, {sql_pick(_PHRASES, 'doc_id')} || ' ' || text AS description,
  (doc_id % 31)::DOUBLE / 10.0::DOUBLE + 0.2::DOUBLE AS aspect, doc_id * 7 % 900 + 400 AS width,
  doc_id * 11 % 1100 + 420 AS height FROM documents)"""
KEYWORDS = f"""(SELECT doc_id AS photo_id, unnest(list_concat(string_split(lower(text), ' '),
  [{sql_pick(_KEYWORDS, 'doc_id')}, {sql_pick(_KEYWORDS, 'doc_id * 2 + 1')}, {sql_pick(_KEYWORDS, 'doc_id * 5 + 3')}])) AS keyword
  FROM documents)"""
PHOTO_VOCABULARY = sorted(set(P.EXCLUDED_TERMS + P.HUMAN_TERMS + P.MALE_TERMS + P.FEMALE_TERMS + P.FACE_TERMS
                              + P.FASHION_TERMS + P.POSTURE_TERMS))


_ADVICE_EXTRA = ["", "\n- Steam the shirt before leaving.", "\n- Spray a subtle citrus cologne.",
                 "\n- Lose weight to improve the drape.", "\nkeep the belt aligned with the shoes",
                 "\n- Trim the beard neckline and add pomade."]


def advice(spark: SparkSession, sf: str) -> DataFrame:
    """Chat turns as checklists: every sentence of a turn becomes a bullet."""
    k = F.col("conv_id") * 8 + F.col("turn")
    body = F.concat(F.lit("- "), F.replace(F.col("text"), F.lit(". "), F.lit(".\n- ")))
    opener = F.when(k % 9 == 0, "Sure! ").otherwise("")
    return table(spark, sf, "conversations").select(
        k.alias("id"), "conv_id", "turn", "role",
        F.concat(opener, body, pick(_ADVICE_EXTRA, k)).alias("text"), ((k % 101) / F.lit(10.0)).alias("score"),
        pick(G.CATEGORIES, k).alias("category"))


ADVICE = f"""(SELECT conv_id * 8 + turn AS id, conv_id, turn, role,
  CASE WHEN (conv_id * 8 + turn) % 9 = 0 THEN 'Sure! ' ELSE '' END || '- ' || replace(text, '. ', '.' || chr(10) || '- ')
  || replace({sql_pick([e.replace(chr(10), '~~') for e in _ADVICE_EXTRA], 'conv_id * 8 + turn')}, '~~', chr(10)) AS text,
  ((conv_id * 8 + turn) % 101)::DOUBLE / 10.0::DOUBLE AS score, {sql_pick(G.CATEGORIES, 'conv_id * 8 + turn')} AS category
  FROM conversations)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Heads cut from each embedding: 5 styles, 4 lengths, a binary and three ordinals."""
    e = lambda start, n: F.transform(F.slice("embedding", start, n), lambda x: x.cast("double"))
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("id"), F.col("label").cast("long").alias("label"), pick(G.CATEGORIES, v).alias("category"),
        pick(G.TIERS, v + F.lit(1)).alias("true_tier"),
        e(1, 5).alias("style"), e(6, 4).alias("length"), e(10, 2).alias("styled"), e(12, 3).alias("wrinkled"),
        e(15, 3).alias("worn"), e(18, 10).alias("ten"),
        (F.element_at("embedding", 64).cast("double") * 4.0 + 7.0).alias("score"),
        ((v * 7 % 91 + 10) / F.lit(10.0)).alias("score_true"), F.when(v % 4 != 0, 1.0).otherwise(0.0).alias("mask"))


PREDICTIONS = f"""(SELECT vec_id AS id, label::BIGINT AS label, {sql_pick(G.CATEGORIES, 'vec_id')} AS category,
  {sql_pick(G.TIERS, 'vec_id + 1')} AS true_tier, embedding[1:5]::DOUBLE[] AS style, embedding[6:9]::DOUBLE[] AS length,
  embedding[10:11]::DOUBLE[] AS styled, embedding[12:14]::DOUBLE[] AS wrinkled, embedding[15:17]::DOUBLE[] AS worn,
  embedding[18:27]::DOUBLE[] AS ten, embedding[64]::DOUBLE * 4.0::DOUBLE + 7.0::DOUBLE AS score,
  (vec_id * 7 % 91 + 10)::DOUBLE / 10.0::DOUBLE AS score_true,
  CASE WHEN vec_id % 4 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM embeddings)"""


def looks(spark: SparkSession, sf: str) -> DataFrame:
    """One look per event; the user is the session, the value gives the score in cents."""
    cents = F.rint(F.col("value") * 100).cast("long")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("look"), "ts", "event_type",
        ((cents % 91 + 10) / F.lit(10.0)).alias("score"),
        F.when(F.col("event_id") % 3 != 0, (cents % 81 + 20) / F.lit(10.0)).alias("posture_score"),
        F.when(F.col("event_id") % 4 != 0, (cents % 71 + 25) / F.lit(10.0)).alias("fit_score"))


LOOKS = """(SELECT user_id AS session, event_id AS look, ts, event_type,
  (round_even(value * 100, 0)::BIGINT % 91 + 10)::DOUBLE / 10.0::DOUBLE AS score,
  CASE WHEN event_id % 3 <> 0 THEN (round_even(value * 100, 0)::BIGINT % 81 + 20)::DOUBLE / 10.0::DOUBLE END AS posture_score,
  CASE WHEN event_id % 4 <> 0 THEN (round_even(value * 100, 0)::BIGINT % 71 + 25)::DOUBLE / 10.0::DOUBLE END AS fit_score
  FROM events)"""


def shard_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in three shards; every tenth row appears again in the next shard."""
    k = F.col("o_orderkey")
    base = table(spark, sf, "orders").select(
        k.alias("pos"), F.format_string("%05d.png", k).alias("filename"), (k % 3).alias("shard"),
        F.when(k % 97 != 0, k).alias("index"), F.col("o_custkey").alias("value"))
    again = base.where(F.col("pos") % 10 == 0).withColumn("shard", F.col("shard") + 1).withColumn(
        "value", F.col("value") + 1)
    return base.unionByName(again)


_SHARD_BASE = """SELECT o_orderkey AS pos, printf('%05d.png', o_orderkey) AS filename, o_orderkey % 3 AS shard,
  CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey END AS index, o_custkey AS value FROM orders"""
SHARDS = f"""({_SHARD_BASE} UNION ALL
  SELECT pos, filename, shard + 1, index, value + 1 FROM ({_SHARD_BASE}) WHERE pos % 10 = 0)"""


def colors(spark: SparkSession, sf: str) -> DataFrame:
    """One RGB triple and two colour names per part."""
    k, names = F.col("p_partkey"), list(G.PALETTE)
    return table(spark, sf, "part").select(
        k.alias("id"), (k * 7 % 256).alias("r"), (k * 13 % 256).alias("g"), (k * 29 % 256).alias("b"),
        pick(names + [None], k).alias("upper"), pick(names + [None], k * 3 + F.col("p_size")).alias("lower"))


COLORS = f"""(SELECT p_partkey AS id, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b,
  {sql_pick(list(G.PALETTE) + [None], 'p_partkey')} AS upper,
  {sql_pick(list(G.PALETTE) + [None], 'p_partkey * 3 + p_size')} AS lower FROM part)"""


_URL_TAILS = ["photo.JPG?x=1", "gallery/index.html", "vector-art.png", "a/b.webp#f", "mannequin.jpeg", "file.gif;v=2",
              "clip.mp4", "look.png"]


def urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs and image links derived from them."""
    p = F.col("page_id")
    return table(spark, sf, "pages").select(
        p.alias("page_id"), "html", F.col("url").alias("page_url"),
        F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/"), pick(_URL_TAILS, p)).alias("url"))


URLS = f"""(SELECT page_id, html, url AS page_url,
  regexp_replace(url, '/+$', '') || '/' || {sql_pick(_URL_TAILS, 'page_id')} AS url FROM pages)"""
