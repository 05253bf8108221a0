"""Catalog section: set operations, sampling, generation, batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from stitchwork.functions import text
from stitchwork.operators import generate, joins, sets
from stitchwork.operators.filters import unprocessed
from stitchwork.plans import standins as S
from stitchwork.plans.queries_aggregates import VOCAB_SQL, retained_vocabulary
from stitchwork.plans.queries_joins import _SALVAGE_SQL, salvaged
from stitchwork.plans.registry import (
    q, query, sql_choice, sql_draw_number, sql_in, sql_list, sql_map, sql_pick, sql_uniform, sql_weigh, table)
from stitchwork.rules import advice as A
from stitchwork.rules import garments as G
from stitchwork.rules import photos as P

c = F.col


@query("u01_shard_union", f"SELECT shard, count(*) AS n, sum(value)::BIGINT AS total FROM {S.SHARDS} GROUP BY shard")
def u01(spark, sf):
    rows = S.shard_rows(spark, sf)
    merged = sets.union_shards([rows.where(c("shard") == i) for i in range(4)])
    return merged.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("u02_novel_urls", """WITH f AS (SELECT user_id AS cat, event_id AS pos, 'u' || (event_id * 7 % 900) AS url FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY cat, pos) AS rn FROM f)
SELECT cat, pos, url FROM r WHERE rn = 1 AND url NOT IN (SELECT 'u' || doc_id FROM labels)""")
def u02(spark, sf):
    found = table(spark, sf, "events").select(c("user_id").alias("cat"), c("event_id").alias("pos"),
                                              F.concat(F.lit("u"), (c("event_id") * 7 % 900).cast("string")).alias("url"))
    seen = table(spark, sf, "labels").select(F.concat(F.lit("u"), c("doc_id").cast("string")).alias("url"))
    return sets.novel_urls(found, seen, "url", [c("cat"), c("pos")])


_HOSTS = [h for h, _, _ in G.HOST_SLICES]
_OWNER = "CASE " + " ".join(f"WHEN o_orderkey >= {a} AND o_orderkey < {b} THEN '{h}'" for h, a, b in G.HOST_SLICES) + " END"


@query("u03_missing_markers", f"""SELECT h AS host, o_orderkey AS item FROM orders, (SELECT unnest({sql_list(_HOSTS)}) AS h)
  WHERE NOT coalesce({_OWNER} = h, false) AND NOT (h = 'vast1' AND o_orderkey % 3 = 0)""")
def u03(spark, sf):
    done = table(spark, sf, "orders").select(c("o_orderkey").alias("item"))
    sent = done.where(c("item") % 3 == 0).select(F.lit("vast1").alias("host"), "item")
    own = joins.slice_of(c("item"), G.HOST_SLICES) == c("host")
    return sets.missing_for(done, _HOSTS, sent, "host", "item", own)


@query("u04_set_intersections", f"""WITH k AS (SELECT photo_id, list(DISTINCT lower(trim(keyword))) AS ks FROM {S.KEYWORDS} WHERE lower(trim(keyword)) IN {sql_in(S.PHOTO_VOCABULARY)} GROUP BY 1)
SELECT photo_id, len(list_intersect(ks, {sql_list(P.FASHION_TERMS)}))::INT AS fashion, len(list_intersect(ks, {sql_list(P.EXCLUDED_TERMS)}))::INT AS excluded FROM k""")
def u04(spark, sf):
    k = joins.keyword_sets(S.keyword_rows(spark, sf), "photo_id", "keyword", S.PHOTO_VOCABULARY)
    n = lambda terms: F.size(F.array_intersect("keywords", text.literals(terms)))
    return k.select("photo_id", n(P.FASHION_TERMS).alias("fashion"), n(P.EXCLUDED_TERMS).alias("excluded"))


@query("u05_vocabulary_union", f"SELECT token FROM {VOCAB_SQL}")
def u05(spark, sf):
    return retained_vocabulary(spark, sf)


@query("u06_append_salvage", f"""SELECT id, filename, facial_hair_style, facial_hair_untidy FROM {S.LABELS} WHERE category = 'Men_Grooming' UNION ALL ({_SALVAGE_SQL})""")
def u06(spark, sf):
    rows, extra = salvaged(spark, sf)
    return rows.unionByName(extra)


@query("u07_replay_mixture", """WITH r AS (SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / 22) AS batch FROM documents),
n AS (SELECT floor(count(*) / 22) AS b FROM documents), m AS (SELECT floor(count(*) / 10) AS cyc FROM embeddings),
s AS (SELECT vec_id, floor((row_number() OVER (ORDER BY vec_id) - 1) / 10) AS blk FROM embeddings)
SELECT batch::BIGINT AS batch, 'real' AS origin, doc_id AS id FROM r, n WHERE batch < b
UNION ALL SELECT step, 'synthetic', vec_id FROM (SELECT unnest(range(0, b::BIGINT)) AS step FROM n), m, s WHERE blk < cyc AND step % cyc = blk""")
def u07(spark, sf):
    real = table(spark, sf, "documents").select(c("doc_id").alias("id"))
    synth = table(spark, sf, "embeddings").select(c("vec_id").alias("id"))
    return sets.replay_mixture(real, synth, [c("id")], [c("id")], 32, 0.3).select("batch", "origin", "id")


@query("u08_chunks", "SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk FROM orders) GROUP BY chunk")
def u08(spark, sf):
    rows = sets.chunks(table(spark, sf, "orders").select("o_orderkey"), [c("o_orderkey")], 500)
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("u09_resolution_batches", f"""WITH t AS (SELECT id, CASE WHEN ends_with(category, 'Grooming') THEN '1024x1024' ELSE '768x1024' END AS res FROM {S.LABELS}),
b AS (SELECT *, (row_number() OVER (PARTITION BY res ORDER BY id) - 1) // 16 AS batch FROM t),
g AS (SELECT res, batch, count(*) AS n, max(id) AS filled, min(id) AS frm FROM b GROUP BY res, batch)
SELECT res, batch, n, n < 16 AS is_remainder, CASE WHEN n < 16 THEN min(frm) OVER (PARTITION BY res) ELSE filled END AS emit_at FROM g""")
def u09(spark, sf):
    t = S.label_rows(spark, sf).select("id", text.lookup(c("category"), G.RESOLUTION).alias("res"))
    return sets.batch_index(sets.keyed_batches(t, "res", [c("id")], 16), "res", "id", 16)


@query("u10_tier_allocation", """SELECT o_orderpriority, count(*) // 6 AS flaw_severe, count(*) // 6 AS flaw_mild, count(*) - count(*) // 6 * 4 AS average, count(*) // 6 * 2 AS polished FROM orders GROUP BY 1""")
def u10(spark, sf):
    from stitchwork.functions.labels import pooled_tier_counts
    n = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return n.select("o_orderpriority", *[v.alias(k) for k, v in pooled_tier_counts(c("n")).items()])


_PLAN_SQL = f"""(WITH n AS (SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT category, unnest([0, 1, 2, 3]) AS ord, unnest({sql_list(G.TIERS)}) AS tier, unnest([n // 6, n // 6, n - n // 6 * 4, n // 6 * 2]) AS size FROM n),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY category, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t)
SELECT category, tier, unnest(range(start, start + size)) AS index FROM s)"""


def planned(spark, sf):
    n = table(spark, sf, "orders").groupBy(c("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return generate.plan_from_counts(n, "category", "n")


@query("u11_plan", f"SELECT category, tier, index FROM {_PLAN_SQL}")
def u11(spark, sf):
    return planned(spark, sf)


def drawn(spark, sf, seed=2026):
    """Label rows drawn for every order: the order key is the task index."""
    tasks = S.label_rows(spark, sf).select(c("id").alias("index"), "category", "tier", "filename")
    return generate.draw_labels(tasks, seed)


_DRAWN_FIELDS = ["score", "target", "direction", "background", "lighting", "framing", "upper_pattern", "upper_color",
                 *(f"{s}:{d}" for s in ("upper", "mid", "lower", "footwear") for d in ("band", "item"))]


def _slot_sql(slot: str) -> str:
    def pool(gender):
        entries = G.POOLS[(gender, slot)]
        near = " ".join(f"WHEN {level} THEN " + sql_weigh(f"u_{slot}_item", [n for n, _, f in entries if abs(f - level) <= 1],
                                                          [3.0 if f == level else 1.0 for _, _, f in entries if abs(f - level) <= 1])
                        for level in range(4))
        return f"CASE WHEN u_{slot}_band < 0.75 THEN CASE target {near} END ELSE {sql_choice(f'u_{slot}_item', [n for n, _, _ in entries])} END"
    return f"CASE WHEN starts_with(category, 'Women') THEN {pool('woman')} ELSE {pool('man')} END"


def _worth_sql(slot: str, garment: str) -> str:
    worth = {g: sql_map(garment, {n: f for n, _, f in G.POOLS[(g, slot)]}) for g in ("man", "woman")}
    return f"CASE WHEN starts_with(category, 'Women') THEN {worth['woman']} ELSE {worth['man']} END"


def _color_sql(draw: str, garment: str) -> str:
    cases = " ".join(f"WHEN {q(n)} THEN {sql_choice(draw, allowed)}" for n, allowed in G.GARMENT_COLORS.items())
    return f"CASE {garment} {cases} ELSE {sql_choice(draw, list(G.PALETTE))} END"


DRAWN_SQL = f"""(WITH d AS (SELECT id AS index, category, tier, ends_with(category, 'Outfit') AS outfit,
  {', '.join(f"{sql_uniform(f'2026:{f}', 'id')} AS u_{f.replace(':', '_')}" for f in _DRAWN_FIELDS)} FROM {S.LABELS}),
t AS (SELECT *, floor(u_target * 4)::INT AS target FROM d),
p AS (SELECT *, CASE WHEN outfit THEN {_slot_sql('upper')} END AS upper_type, CASE WHEN outfit THEN {_slot_sql('mid')} END AS mid_type,
  CASE WHEN outfit THEN {_slot_sql('lower')} END AS lower_draw, CASE WHEN outfit THEN {_slot_sql('footwear')} END AS footwear_type FROM t),
g AS (SELECT *, CASE WHEN upper_type = 'dress' THEN 'none' ELSE lower_draw END AS lower_type FROM p),
w AS (SELECT *, list_filter([{_worth_sql('upper', 'upper_type')}, CASE WHEN mid_type <> 'none' THEN {_worth_sql('mid', 'mid_type')} END,
  {_worth_sql('lower', 'lower_type')}, {_worth_sql('footwear', 'footwear_type')}], lambda x: x IS NOT NULL) AS worths FROM g),
f AS (SELECT *, list_sum(worths)::DOUBLE / len(worths) AS mean FROM w)
SELECT index, category, tier, upper_type, mid_type, lower_type, footwear_type,
  CASE WHEN outfit THEN CASE WHEN mean < 1 THEN 'casual' WHEN mean < 2 THEN 'smart_casual' WHEN mean < 2.75 THEN 'business' ELSE 'formal' END END AS formality,
  CASE WHEN outfit THEN {sql_weigh('u_upper_pattern', ['solid', 'striped', 'checked', 'printed'], [0.55, 0.16, 0.15, 0.14])} END AS upper_pattern,
  CASE WHEN outfit THEN {_color_sql('u_upper_color', 'upper_type')} END AS requested_upper_color,
  CASE WHEN outfit THEN CASE WHEN u_direction < 0.5 THEN 'baggy' ELSE 'tight' END END AS fit_direction,
  printf('%.1f', CASE tier WHEN 'flaw_severe' THEN 1.0::DOUBLE + u_score * 1.0::DOUBLE WHEN 'flaw_mild' THEN 2.1::DOUBLE + u_score * (3.0::DOUBLE - 2.1::DOUBLE)
    WHEN 'average' THEN 4.0::DOUBLE + u_score * 2.0::DOUBLE ELSE 7.0::DOUBLE + u_score * 3.0::DOUBLE END)::DOUBLE AS score,
  {sql_choice('u_background', [k for k, _ in G.BACKGROUNDS])} AS requested_background, {sql_choice('u_lighting', [k for k, _ in G.LIGHTING])} AS requested_lighting,
  {sql_choice('u_framing', [k for k, _ in G.FRAMING])} AS requested_framing FROM f)"""


@query("u12_weighted_draw", f"SELECT upper_pattern, count(*) AS n FROM {DRAWN_SQL} WHERE upper_pattern IS NOT NULL GROUP BY 1")
def u12(spark, sf):
    rows = drawn(spark, sf).where(c("upper_pattern").isNotNull())
    return rows.groupBy("upper_pattern").agg(F.count(F.lit(1)).alias("n"))


@query("u13_coherent_outfits", f"SELECT index, category, upper_type, mid_type, lower_type, footwear_type, formality FROM {DRAWN_SQL} WHERE ends_with(category, 'Outfit')")
def u13(spark, sf):
    return drawn(spark, sf).where(c("category").endswith("Outfit")).select(
        "index", "category", "upper_type", "mid_type", "lower_type", "footwear_type", "formality")


@query("u14_uniform_draws", f"""SELECT index, tier, score, requested_background, requested_lighting, requested_framing, requested_upper_color, fit_direction
FROM {DRAWN_SQL}""")
def u14(spark, sf):
    return drawn(spark, sf).select("index", "tier", "score", "requested_background", "requested_lighting",
                                   "requested_framing", "requested_upper_color", "fit_direction")


_COMBOS = [(cat, t) for t in G.TIERS for cat in G.CATEGORIES]


@query("u15_stratified_contexts", f"""SELECT conv_id * 8 + turn AS id, {sql_pick([x for x, _ in _COMBOS], 'conv_id * 8 + turn')} AS category,
  {sql_pick([t for _, t in _COMBOS], 'conv_id * 8 + turn')} AS tier FROM conversations""")
def u15(spark, sf):
    rows = table(spark, sf, "conversations").select((c("conv_id") * 8 + c("turn")).alias("id"))
    return generate.advice_contexts(rows, "id", 42).select("id", "category", "tier")


@query("u16_rejection_search", f"SELECT index, category, tier, mid_type FROM {DRAWN_SQL} WHERE mid_type = 'hoodie' ORDER BY index LIMIT 25")
def u16(spark, sf):
    """First 25 order keys, in order, whose drawn outfit has a hoodie."""
    return drawn(spark, sf).where(c("mid_type") == "hoodie").orderBy("index").limit(25).select("index", "category", "tier", "mid_type")


@query("u17_grid_sampler", f"""SELECT p_brand, category, tier, s AS sample_idx FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest({sql_list(G.CATEGORIES)}) AS category),
  (SELECT unnest({sql_list(G.TIERS)}) AS tier), (SELECT unnest(range(0, 3)::INT[]) AS s)""")
def u17(spark, sf):
    return generate.sample_grid(table(spark, sf, "part").select("p_brand").distinct(), {"category": G.CATEGORIES, "tier": G.TIERS}, 3)


@query("u18_seeded_sample", f"SELECT doc_id, lang FROM documents ORDER BY {sql_draw_number(17, 'doc_id')}, doc_id LIMIT 100")
def u18(spark, sf):
    return sets.sample_rows(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 17, 100)


@query("u18b_seeded_sample_large", f"""SELECT line FROM (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS line FROM lineitem)
  ORDER BY {sql_draw_number(29, 'line')}, line LIMIT 12000""")
def u18b(spark, sf):
    lines = table(spark, sf, "lineitem").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("line")).distinct()
    return sets.sample_rows(lines, "line", 29, 12_000)


@query("u19_ordered_split", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor((SELECT count(*) FROM documents) * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM documents""")
def u19(spark, sf):
    return sets.ordered_split(table(spark, sf, "documents").select("doc_id"), [c("doc_id")], 0.9)


@query("u19b_random_split", f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {sql_draw_number(5, 'doc_id')}, doc_id)
  <= greatest(1, floor((SELECT count(*) FROM documents) * 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM documents""")
def u19b(spark, sf):
    return sets.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 5)


@query("u20_reconstruction_check", f"""WITH l AS (SELECT id, filename FROM {S.LABELS}), r AS (SELECT id, CASE WHEN id % 1000 = 7 THEN 'broken' ELSE filename END AS filename FROM l)
(SELECT id, filename, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)) UNION ALL (SELECT id, filename, 'right' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l))""")
def u20(spark, sf):
    rows = S.label_rows(spark, sf).select("id", "filename")
    rebuilt = rows.withColumn("filename", F.when(c("id") % 1000 == 7, "broken").otherwise(c("filename")))
    return sets.differences(rows, rebuilt)


@query("u21_tier_independence", f"SELECT tier, requested_lighting, count(*) AS n FROM {DRAWN_SQL} GROUP BY ALL")
def u21(spark, sf):
    return drawn(spark, sf).groupBy("tier", "requested_lighting").agg(F.count(F.lit(1)).alias("n"))


_POOL_ROWS = [(g, s, n) for (g, s), pool in G.POOLS.items() for n, _, _ in pool]


@query("u22_garment_vocabulary", f"""SELECT g AS gender, n AS garment, count(o_orderkey) AS orders_seen FROM (VALUES {', '.join(sorted({f"({q(g)}, {q(n)})" for g, _, n in _POOL_ROWS if n != 'none'}))}) v(g, n)
  LEFT JOIN orders ON {sql_pick(['man', 'woman'], 'o_custkey')} = g AND {sql_pick(sorted({n for _, _, n in _POOL_ROWS}), 'o_orderkey')} = n GROUP BY g, n""")
def u22(spark, sf):
    names = sorted({n for _, _, n in _POOL_ROWS})
    pairs = F.array(*[F.struct(F.lit(g).alias("gender"), F.lit(n).alias("garment")) for g, _, n in _POOL_ROWS])
    vocabulary = spark.range(1).select(F.explode(pairs).alias("p")).select("p.*").where(c("garment") != "none").distinct()
    seen = table(spark, sf, "orders").select(text.pick(["man", "woman"], c("o_custkey")).alias("gender"),
                                             text.pick(names, c("o_orderkey")).alias("garment"))
    n = seen.groupBy("gender", "garment").agg(F.count(F.lit(1)).alias("orders_seen"))
    return vocabulary.join(n, ["gender", "garment"], "left").select("gender", "garment", F.coalesce("orders_seen", F.lit(0)).alias("orders_seen"))
