"""Catalog section: end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stitchwork.functions import decode, text
from stitchwork.operators import aggregates as AG
from stitchwork.operators import history, sets
from stitchwork.plans import jobs
from stitchwork.plans import standins as S
from stitchwork.plans.queries_aggregates import _RECALL_SQL
from stitchwork.plans.queries_filters import BUCKETS_SQL, LOG_SQL
from stitchwork.plans.queries_scalars import (
    _DEMOGRAPHIC, _OK_TIER, _POS, _REVIEW_BASE, _SEV, _STREAM_SORTER, _TIER_SORTER, _canonical_sql, DESCRIPTION_SQL, JUDGED, PHOTO_FACTS_SQL,
    judged)
from stitchwork.plans.queries_sources import _listing_pages, text_images
from stitchwork.plans.landing import fresh_folder
from stitchwork.plans.registry import q, query, sql_draw_number, sql_list, sql_map, sql_pick, table
from stitchwork.rules import garments as G
from stitchwork.rules import routing as R
from stitchwork.sources import writers

c = F.col


@query("q01_qualify_and_route", f"""SELECT id, filename, status, CASE WHEN status = 'sorted' THEN {_STREAM_SORTER} || '/' || {_DEMOGRAPHIC} || '/' || {_TIER_SORTER}
  WHEN starts_with(status, 'rejected_heuristic') THEN 'blurry_or_low_res' WHEN status = 'rejected_vlm_failed' THEN 'vlm_failed' ELSE 'non_human_or_flatlay' END AS destination
  FROM {LOG_SQL} WHERE id NOT IN (SELECT doc_id FROM labels)""")
def q01(spark, sf):
    done = table(spark, sf, "labels").select(c("doc_id").alias("id"))
    return jobs.qualify_and_route(S.annotations(spark, sf), done, "id").select("id", "filename", "status", "destination")


_ANSWER_FIELDS = ["is_look", "gender", "age", "tier_text", "overall", "focus", "shot", "upper", "mid", "lower", "shoes", "hair", "beard"]


def _raw_answers(spark, sf):
    """The judge's answers as it writes them: plain, fenced, inside prose, with a trailing comma, or no object at all."""
    rows, k = S.annotations(spark, sf), c("id")
    body = F.to_json(F.struct(*_ANSWER_FIELDS))
    comma = F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(", }"))
    answer = (F.when(~c("judged"), F.when(k % 2 == 0, "I cannot judge this image.").otherwise('{"is_look": tr'))
              .when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
              .when(k % 4 == 2, F.concat(F.lit("Here it is:\n"), comma, F.lit("\nAnything else?"))).otherwise(comma))
    return rows.select("id", answer.alias("answer"))


_CANONICAL = ["upper_type", "mid_type", "lower_type", "footwear_type", "hair_styled", "facial_hair_style"]


@query("q01b_qualify_from_answers", f"""WITH l AS (SELECT *, status = 'sorted' AS ok FROM {LOG_SQL} WHERE id NOT IN (SELECT doc_id FROM labels)), k AS ({_canonical_sql('sorter')})
SELECT l.id, l.filename, l.status, CASE WHEN ok THEN 'sorted' WHEN starts_with(status, 'rejected_heuristic') THEN 'blurry_or_low_res'
    WHEN status = 'rejected_vlm_failed' THEN 'vlm_failed' ELSE 'non_human_or_flatlay' END AS status_group,
  CASE WHEN ok THEN {_STREAM_SORTER} ELSE 'none' END AS stream, CASE WHEN ok THEN {_DEMOGRAPHIC} ELSE 'none' END AS demographic, CASE WHEN ok THEN {_TIER_SORTER} ELSE 'none' END AS tier,
  {', '.join(f'CASE WHEN ok THEN k.{x} END AS {x}' for x in _CANONICAL)} FROM l JOIN k USING (id)""")
def q01b(spark, sf):
    """Raw answers to a routed dataset on disk, read back."""
    done = table(spark, sf, "labels").select(c("doc_id").alias("id"))
    items = S.annotations(spark, sf).select("id", "filename", "path", "size", "width", "height", "laplacian")
    folder = fresh_folder(spark, "qualified")
    writers.write_routed(jobs.qualify_answers(items, _raw_answers(spark, sf), done, "id"), folder)
    return spark.read.parquet(folder).select("id", "filename", "status", "status_group", "stream", "demographic", "tier", *_CANONICAL)


@query("q01c_run_counters", f"""SELECT count(*) FILTER (WHERE status = 'sorted') AS qualified, count(*) FILTER (WHERE status = 'rejected_not_human') AS not_human,
  count(*) FILTER (WHERE starts_with(status, 'rejected_heuristic')) AS heuristic, count(*) FILTER (WHERE status = 'rejected_vlm_failed') AS judge_failed,
  count(*) FILTER (WHERE status = 'rejected_routing_failed') AS routing_failed FROM {LOG_SQL} WHERE id NOT IN (SELECT doc_id FROM labels)""")
def q01c(spark, sf):
    done = table(spark, sf, "labels").select(c("doc_id").alias("id"))
    items = S.annotations(spark, sf).select("id", "filename", "path", "size", "width", "height", "laplacian")
    return AG.status_summary(jobs.qualify_answers(items, _raw_answers(spark, sf), done, "id"))


@query("q02_photo_curation", f"""WITH {PHOTO_FACTS_SQL},
r AS (SELECT photo_id, category, relevance_score, row_number() OVER (PARTITION BY category ORDER BY relevance_score DESC, photo_id) AS class_rank FROM facts)
SELECT photo_id, category, relevance_score, class_rank::INT AS class_rank FROM r WHERE class_rank <= 50""")
def q02(spark, sf):
    return jobs.curate_photos(S.photos(spark, sf), S.keyword_rows(spark, sf), S.PHOTO_VOCABULARY, 50)


@query("q03_balanced_ingestion", f"""WITH k AS ({DESCRIPTION_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY photo_id) AS rn FROM k WHERE category IS NOT NULL)
SELECT photo_id, category FROM r WHERE rn <= 30 ORDER BY photo_id LIMIT 200""")
def q03(spark, sf):
    return jobs.balanced_ingestion(S.photos(spark, sf), "photo_id", 30, 200)


@query("q04_label_table_coverage")
def q04(spark, sf):
    tasks = S.label_rows(spark, sf).select(c("id").alias("index"), "category", "tier", "filename")
    return jobs.label_table(tasks, 2026)[1]


@query("q05_merge_and_verify", f"""WITH m AS (SELECT filename, value, row_number() OVER (PARTITION BY filename ORDER BY shard, pos) AS rn FROM {S.SHARDS}),
l AS (SELECT filename, value FROM m WHERE rn = 1), e AS (SELECT printf('%05d.png', o_orderkey) AS filename, o_custkey AS value FROM orders)
(SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM e)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM l))
UNION ALL SELECT filename, count(*), 'duplicates' FROM m WHERE rn > 1 GROUP BY filename""")
def q05(spark, sf):
    expected = table(spark, sf, "orders").select(F.format_string("%05d.png", "o_orderkey").alias("filename"), c("o_custkey").alias("value"))
    _, duplicates, gaps = jobs.merge_and_verify(S.shard_rows(spark, sf), "filename", [c("shard"), c("pos")], expected)
    n = duplicates.groupBy("filename").agg(F.count(F.lit(1)).alias("value")).withColumn("side", F.lit("duplicates"))
    return gaps.unionByName(n)


@query("q06_audit_and_repair", f"""WITH l AS (SELECT * FROM {S.LABELS}), b AS (SELECT filename FROM ({BUCKETS_SQL}) WHERE bucket = 'fit_miss'),
f AS (SELECT filename, CASE WHEN actual_direction = 'baggy' THEN {_SEV} ELSE 0 END AS nb, CASE WHEN actual_direction = 'tight' THEN {_SEV} ELSE 0 END AS nt
  FROM {JUDGED} WHERE actual_direction <> 'unclear' AND {_OK_TIER} AND filename IN (SELECT filename FROM b))
SELECT filename, 'fit_baggy' AS "column", l.fit_baggy::VARCHAR AS old_value, nb::VARCHAR AS new_value FROM l JOIN f USING (filename) WHERE l.fit_baggy <> nb
UNION ALL SELECT filename, 'fit_tight', l.fit_tight::VARCHAR, nt::VARCHAR FROM l JOIN f USING (filename) WHERE l.fit_tight <> nt""")
def q06(spark, sf):
    return jobs.audit_and_repair(S.label_rows(spark, sf), judged(spark, sf), "fit_miss", ["fit_baggy", "fit_tight"])["diff"]


_TIER_EDITS = {"facial_hair_texture": ("facial_hair_untidy", "facial_hair_groomed"), "eyebrows": ("eyebrows_unkempt", "eyebrows_groomed"),
               "skin_condition": ("skin_neglected", "skin_healthy"), "makeup": ("makeup_uneven", "makeup_flawless"),
               "fabric_wrinkled_miss": ("fabric_wrinkled", "fabric_crisp")}
_BEARD = f"actual_style NOT IN ('clean_shaven', 'unclear') AND {_OK_TIER}"
_OLD_COLUMNS = ["upper_pattern", "lower_pattern", "facial_hair_style", "makeup_style", "fabric_wrinkled", "fit_baggy", "fit_tight", "footwear_worn",
                "styling_sloppy", "hair_untidy", "skin_neglected", "eyebrows_unkempt", "facial_hair_untidy", "makeup_uneven"]


def _edits_sql() -> str:
    """bucket, filename, column, new_value of every bucket."""
    row = lambda bucket, column, value, where: (f"SELECT '{bucket}' AS bucket, filename, '{column}' AS \"column\", ({value})::VARCHAR AS new_value "  # noqa: E731
                                                f"FROM {JUDGED} WHERE {where}")
    parts = [row(b, x, x, f"{x} <> 'unclear'") for b in ("pattern_miss", "pattern_solid_bleed") for x in ("upper_pattern", "lower_pattern")]
    parts += [row(b, x, v, _OK_TIER) for b, pair in _TIER_EDITS.items() for x, v in zip(pair, (_SEV, _POS))]
    parts += [row("hair_length_grooming", "hair_length", "actual_hair_length", "actual_hair_length <> 'unclear'")]
    parts += [row(b, "footwear_type", "actual_footwear_type", "actual_footwear_type <> 'socks'") for b in ("footwear_type_men", "footwear_type_women")]
    for b in ("facial_hair_style_miss", "clean_shaven_residual", "clean_shaven_salvage"):
        parts += [row(b, x, v, _BEARD) for x, v in (("facial_hair_style", "actual_style"), ("facial_hair_untidy", _SEV), ("facial_hair_groomed", _POS))]
    for b in ("facial_hair_style_miss", "clean_shaven_residual"):
        parts += [row(b, x, v, "actual_style = 'clean_shaven'")
                  for x, v in (("facial_hair_style", "actual_style"), ("facial_hair_untidy", "0"), ("facial_hair_groomed", "0"))]
    level = lambda way: f"CASE WHEN actual_direction = '{way}' THEN {_SEV} ELSE 0 END"
    parts += [row("fit_miss", x, v, f"actual_direction <> 'unclear' AND {_OK_TIER}")
              for x, v in (("fit_baggy", level("baggy")), ("fit_tight", level("tight")), ("fit_tailored", _POS))]
    return " UNION ALL ".join(parts)


@query("q06b_audit_and_repair_all", f"""WITH e AS ({_edits_sql()}), b AS (SELECT filename, bucket FROM ({BUCKETS_SQL})),
o AS (SELECT filename, unnest({sql_list(_OLD_COLUMNS)}) AS "column", unnest([{', '.join(f'{x}::VARCHAR' for x in _OLD_COLUMNS)}]) AS old_value FROM {S.LABELS})
SELECT bucket, filename, "column", old_value, new_value FROM b JOIN e USING (filename, bucket) LEFT JOIN o USING (filename, "column")
WHERE coalesce(old_value, 'None') <> new_value""")
def q06b(spark, sf):
    return jobs.audit_and_repair_all(S.label_rows(spark, sf), judged(spark, sf))


@query("q07_pixel_qa")
def q07(spark, sf):
    name = F.format_string("%05d.png", "doc_id")
    images = text_images(spark, sf).withColumn("filename", name).drop("doc_id")
    labels = table(spark, sf, "documents").select(
        name.alias("filename"), text.pick(G.CATEGORIES, c("doc_id")).alias("category"),
        text.pick(list(G.PALETTE), c("doc_id")).alias("requested_upper_color"), text.pick(list(G.PALETTE), c("doc_id") * 3).alias("requested_lower_color"))
    return jobs.pixel_qa(labels, images)


_FIELDS = [{"name": "score", "type": "regression"}, {"name": "upper_pattern", "type": "categorical", "classes": G.PATTERNS},
           {"name": "fabric_wrinkled", "type": "ordinal"}]


@query("q08_training_set", f"""WITH s AS (SELECT l.id, {sql_pick(R.AESTHETIC_TIERS, 'l.id')} AS tier, l.upper_pattern, l.fabric_wrinkled, a.overall
  FROM {S.LABELS} l LEFT JOIN {S.ANNOTATIONS} a USING (id) WHERE l.id % 10 <> 0),
t AS (SELECT id, coalesce(CASE WHEN overall IS NOT NULL THEN greatest(1.0, least(10.0, CASE WHEN overall > 10 AND overall <= 20 THEN overall / 2.0 ELSE overall END)) END,
  {sql_map('tier', {'1_Needs_Improvement': 2.0, '2_Average': 5.0, '3_Polished': 8.5})})::DOUBLE AS score_target, upper_pattern,
  row_number() OVER (ORDER BY {sql_draw_number(11, 'id')}, id) AS place FROM s)
SELECT id, round(score_target, 6) AS score_target, CASE WHEN upper_pattern IS NULL THEN 0 ELSE list_position(['solid', 'striped', 'checked', 'printed'], upper_pattern) - 1 END::DOUBLE AS pattern_target,
  (upper_pattern IS NOT NULL)::INT::DOUBLE AS pattern_mask, CASE WHEN place <= greatest(1, floor((SELECT count(*) FROM s) * 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM t""")
def q08(spark, sf):
    samples = S.label_rows(spark, sf).select("id", text.pick(R.AESTHETIC_TIERS, c("id")).alias("tier"), "upper_pattern", "fabric_wrinkled",
                                             F.when(c("id") % 10 == 0, "0").otherwise(" 1").alias("qa_pass"))
    rows = jobs.training_set(samples, S.annotations(spark, sf).select("id", "overall"), "id", _FIELDS)
    return rows.select("id", F.round("score_target", 6).alias("score_target"), c("upper_pattern_target").alias("pattern_target"),
                       c("upper_pattern_mask").cast("double").alias("pattern_mask"), "split")


@query("q09_evaluation_report", f"""WITH {_RECALL_SQL}
SELECT 'mae' AS metric, '' AS key, round(avg(abs(score - score_true)) FILTER (WHERE mask > 0), 5) AS value FROM {S.PREDICTIONS}
UNION ALL SELECT 'rmse', '', round(sqrt(avg((score - score_true) ** 2) FILTER (WHERE mask > 0)), 5) FROM {S.PREDICTIONS}
UNION ALL SELECT 'mean_predicted', true_tier, round(avg(score), 5) FROM {S.PREDICTIONS} GROUP BY true_tier
UNION ALL SELECT 'recall', class::VARCHAR, round(recall, 5) FROM x""")
def q09(spark, sf):
    rep = jobs.evaluation_report(S.predictions(spark, sf), decode.argmax(c("ten")).cast("long"), c("label"), c("mask"))
    row = lambda df, metric, key, value: df.select(F.lit(metric).alias("metric"), key.alias("key"), F.round(value, 5).alias("value"))
    return sets.union_shards([
        row(rep["errors"], "mae", F.lit(""), c("score_mae")), row(rep["errors"], "rmse", F.lit(""), c("score_rmse")),
        row(rep["calibration"], "mean_predicted", c("true_tier"), c("mean_predicted")),
        row(rep["recall"], "recall", c("class").cast("string"), c("recall"))])


@query("q10_advice_qa", _REVIEW_BASE + f""", v AS (SELECT t, NOT (short OR long OR chatter OR banned OR unobs OR bare > 0 OR n < 2 OR n > 5 OR long_lines > 0 OR adaptive) AS p FROM c),
w AS (SELECT list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS words FROM v WHERE p),
k AS (SELECT DISTINCT unnest(words) AS w FROM w UNION SELECT unnest({sql_list(__import__('stitchwork.functions.advice', fromlist=['x']).vocabulary_floor())}))
SELECT 'counter' AS kind, 'total' AS item, (SELECT count(*) FROM v)::DOUBLE AS n UNION ALL SELECT 'counter', 'passed', (SELECT count(*) FROM v WHERE p)::DOUBLE
UNION ALL SELECT 'counter', 'hard_failed', (SELECT count(*) FROM v WHERE NOT p)::DOUBLE
UNION ALL SELECT 'length', 'examples', count(*)::DOUBLE FROM w UNION ALL SELECT 'length', 'max_len', max(least(len(words), 512))::DOUBLE FROM w
UNION ALL SELECT 'length', 'avg_supervised', round(avg(len(words)), 6)::DOUBLE FROM w UNION ALL SELECT 'length', 'truncated', (count(*) FILTER (WHERE len(words) >= 512))::DOUBLE FROM w
UNION ALL SELECT 'word', w, 1.0::DOUBLE FROM k""")
def q10(spark, sf):
    out = jobs.advice_qa(S.advice(spark, sf))

    def long(rows, kind, names):
        pairs = F.array(*[F.struct(F.lit(n).alias("item"), F.round(c(n).cast("double"), 6).alias("n")) for n in names])
        return rows.select(F.lit(kind).alias("kind"), F.inline(pairs))
    words_ = out["vocabulary"]
    return sets.union_shards([
        long(out["counters"], "counter", ["total", "passed", "hard_failed"]),
        long(out["lengths"], "length", ["examples", "max_len", "avg_supervised", "truncated"]),
        words_.select(F.lit("word").alias("kind"), c(words_.columns[0]).alias("item"), F.lit(1.0).alias("n"))])


_OCC_RAW = ["first date", "board meeting", "gym", "", "wedding guest"]


@query("q11_score_tag_advise", f"""
WITH a AS (SELECT l.*, {sql_pick(_OCC_RAW, 'l.id')} AS raw FROM {S.LABELS} l WHERE ends_with(category, 'Outfit')),
k AS (SELECT *, CASE WHEN (fabric_wrinkled > 0 OR styling_sloppy > 0 OR footwear_worn > 0 OR fit_baggy > 0) AND score >= 7.5 THEN 7.2::DOUBLE ELSE score END AS cal FROM a)
SELECT id, {sql_map('raw', {'first date': 'First Date', 'board meeting': 'Formal Business Meeting', 'gym': 'Gym / Athleisure', '': 'Casual Dinner', 'wedding guest': 'Summer Wedding'})} AS occasion,
  cal AS calibrated, CASE WHEN cal >= 7.5 THEN '3_Polished' WHEN cal >= 5.0 THEN '2_Average' ELSE '1_Needs_Improvement' END AS tier,
  CASE WHEN greatest(fabric_wrinkled, fit_baggy, fit_tight, footwear_worn, styling_sloppy) = 0 THEN 'none'
    WHEN fabric_wrinkled = greatest(fabric_wrinkled, fit_baggy, fit_tight, footwear_worn, styling_sloppy) THEN 'fabric_wrinkled'
    WHEN fit_baggy = greatest(fabric_wrinkled, fit_baggy, fit_tight, footwear_worn, styling_sloppy) THEN 'fit_baggy'
    WHEN fit_tight = greatest(fabric_wrinkled, fit_baggy, fit_tight, footwear_worn, styling_sloppy) THEN 'fit_tight'
    WHEN footwear_worn = greatest(fabric_wrinkled, fit_baggy, fit_tight, footwear_worn, styling_sloppy) THEN 'footwear_worn' ELSE 'styling_sloppy' END AS priority_defect,
  CASE WHEN id % 2 = 0 THEN '- Hem the trousers.' || chr(10) || '- Swap the shoes.' ELSE '- Hem the trousers.' || chr(10) ||
    CASE WHEN cal >= 7.5 THEN '• Ensure garments remain crisp and unwrinkled throughout the occasion.' ELSE '• Steam or iron garments to eliminate wrinkles and sharpen the silhouette.' END END AS advice FROM k""")
def q11(spark, sf):
    rows = S.label_rows(spark, sf).where(c("category").endswith("Outfit"))
    rows = rows.withColumns({"occasion": text.pick(_OCC_RAW, c("id")),
                             "advice": F.when(c("id") % 2 == 0, "- Hem the trousers.\n- Swap the shoes.").otherwise("- Hem the trousers.\n- Trim the beard.")})
    return jobs.advise(rows).drop("tier_label")


def _worst_sql(fields: list[str]) -> str:
    top = f"greatest({', '.join(fields)})"
    return f"CASE WHEN {top} = 0 THEN 'none' {' '.join(f'WHEN {x} = {top} THEN {chr(39)}{x}{chr(39)}' for x in fields)} END"


def _topped_sql(high: str, low: str) -> str:
    return f"CASE WHEN cal >= 7.5 THEN '{high}' ELSE '{low}' END"


_FACE = ["hair_untidy", "skin_neglected", "eyebrows_unkempt"]
_MEN_LINES = [_topped_sql("• Apply a lightweight matte styling cream or clay to tame any subtle flyaways.",
                          "• Tidy up the neckline and sideburns with a trimmer to sharpen your profile."),
              _topped_sql("• Keep facial hair line precisely defined and moisturize skin for a healthy finish.",
                          "• Work a dab of pomade or styling paste into hair for intentional shape and hold.")]
_WOMEN_LINES = [_topped_sql("• Smooth hairline flyaways with a light finishing serum or edge brush.",
                            "• Brush and shape eyebrows, setting them lightly with a brow gel."),
                _topped_sql("• Set brows with a clear brow gel and apply a nourishing lip balm for a polished glow.",
                            "• Style hair to reduce flyaways and add clean texture or volume.")]
_FACE_ADVICE = lambda two: f"CASE WHEN id % 2 = 0 THEN {two[0]} || chr(10) || {two[1]} ELSE '- Trim the beard.' || chr(10) || {two[0]} END"


@query("q11b_score_tag_advise_all", f"""
WITH a AS (SELECT l.*, {sql_pick(_OCC_RAW, 'l.id')} AS raw FROM {S.LABELS} l),
k AS (SELECT *, CASE WHEN score >= 7.5 AND CASE WHEN ends_with(category, 'Grooming') THEN hair_untidy > 0 OR skin_neglected > 0 OR eyebrows_unkempt > 0 OR coalesce(makeup_uneven, 0) > 0
  ELSE fabric_wrinkled > 0 OR styling_sloppy > 0 OR footwear_worn > 0 OR fit_baggy > 0 END THEN 7.2::DOUBLE ELSE score END AS cal FROM a)
SELECT id, {sql_map('raw', {'first date': 'First Date', 'board meeting': 'Formal Business Meeting', 'gym': 'Gym / Athleisure', '': 'Casual Dinner', 'wedding guest': 'Summer Wedding'})} AS occasion,
  cal AS calibrated, CASE WHEN cal >= 7.5 THEN '3_Polished' WHEN cal >= 5.0 THEN '2_Average' ELSE '1_Needs_Improvement' END AS tier,
  CASE category WHEN 'Men_Grooming' THEN {_worst_sql(_FACE + ['facial_hair_untidy'])} WHEN 'Women_Grooming' THEN {_worst_sql(_FACE + ['makeup_uneven'])}
    ELSE {_worst_sql(['fabric_wrinkled', 'fit_baggy', 'fit_tight', 'footwear_worn', 'styling_sloppy'])} END AS priority_defect,
  CASE category WHEN 'Men_Grooming' THEN {_FACE_ADVICE(_MEN_LINES)} WHEN 'Women_Grooming' THEN {_FACE_ADVICE(_WOMEN_LINES)}
    ELSE CASE WHEN id % 2 = 0 THEN '- Hem the trousers.' || chr(10) || '- Swap the shoes.' ELSE '- Hem the trousers.' || chr(10) ||
      {_topped_sql('• Ensure garments remain crisp and unwrinkled throughout the occasion.', '• Steam or iron garments to eliminate wrinkles and sharpen the silhouette.')} END END AS advice FROM k""")
def q11b(spark, sf):
    rows = S.label_rows(spark, sf).withColumns(
        {"occasion": text.pick(_OCC_RAW, c("id")),
         "advice": F.when(c("id") % 2 == 0, "- Hem the trousers.\n- Swap the shoes.").otherwise("- Hem the trousers.\n- Trim the beard.")})
    return jobs.advise(rows).drop("tier_label")


@query("q12_session_mart", f"""SELECT session, count(*) AS looks, round(avg(score), 6) AS average_score, max(score) AS best_score,
  round(arg_max(score, {{t: ts, k: look}}) - arg_min(score, {{t: ts, k: look}}), 6) AS score_change FROM {S.LOOKS} GROUP BY session HAVING count(*) >= 2""")
def q12(spark, sf):
    facts, change = jobs.session_mart(S.looks(spark, sf))
    return facts.join(change, "session").select("session", "looks", F.round("average_score", 6).alias("average_score"), "best_score",
                                                F.round("score_change", 6).alias("score_change"))


@query("q13_fleet_report", """WITH e AS (SELECT user_id AS host, event_id, ts, event_type, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
m AS (SELECT *, event_type <> 'error' AND n > coalesce(max(CASE WHEN event_type <> 'error' THEN n END) OVER (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved FROM e),
h AS (SELECT host, max(n)::BIGINT AS done, max(CASE WHEN moved THEN ts END) AS progress_at FROM m GROUP BY host),
t AS (SELECT o_custkey AS host, count(*) AS target, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT host, done, progress_at, target AS slice_target, target - f AS slice_remaining, round(f * 100.0 / target, 6)::DOUBLE AS slice_pct FROM h LEFT JOIN t USING (host)""")
def q13(spark, sf):
    tasks = table(spark, sf, "orders").select(c("o_custkey").alias("host"), "o_orderstatus")
    report = jobs.fleet_report(history.progress_checks(spark, sf), 12.0, tasks, c("o_orderstatus") == "F")
    return report.select("host", "done", "progress_at", "slice_target", "slice_remaining", F.round("slice_pct", 6).alias("slice_pct"))


def _claims_sql(limit: int) -> str:
    """One category after the other: its first free URLs, up to the limit."""
    steps, taken = [], "SELECT NULL AS url WHERE false"
    for k in range(4):
        steps.append(f"c{k} AS (SELECT {k} AS category, url, pos FROM f WHERE cat = {k} AND url NOT IN ({taken}) ORDER BY pos LIMIT {limit})")
        taken = " UNION ALL ".join(f"SELECT url FROM c{i}" for i in range(k + 1))
    return ", ".join(steps)


_URLS_SQL = """WITH u AS (SELECT o_orderkey % 4 AS cat, 'i' || o_custkey AS url, o_orderkey * 2 AS pos, o_custkey FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey % 4, 'q' || o_custkey, o_orderkey * 2, o_custkey FROM orders WHERE o_orderkey % 5 = 2
  UNION ALL SELECT o_orderkey % 4, 'p' || o_custkey, o_orderkey * 2 + 1, o_custkey FROM orders WHERE o_orderkey % 5 = 2
  UNION ALL SELECT o_orderkey % 4, 't' || o_custkey, o_orderkey * 2, o_custkey FROM orders WHERE o_orderkey % 5 = 3),
f AS (SELECT cat, url, min(pos) AS pos FROM u WHERE NOT (starts_with(url, 'i') AND o_custkey % 3 = 0) GROUP BY cat, url),"""


@query("q14_url_inventory", f"""{_URLS_SQL}
{_claims_sql(250)}
SELECT category::BIGINT AS category, count(*) AS urls, max(pos) // 2 AS last_page, count(*) < 250 AS thin
FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) GROUP BY category""")
def q14(spark, sf):
    known = table(spark, sf, "customer").where(c("c_custkey") % 3 == 0).select(
        F.concat(F.lit("https://i.example/"), c("c_custkey").cast("string"), F.lit(".jpg?a=1&b=2")).alias("url"))
    return jobs.url_inventory(_listing_pages(spark, sf), c("page") % 4, 250, 250, known)


@query("q14b_inventory_until_target", f"""{_URLS_SQL}
{_claims_sql(250)},
n AS (SELECT category, count(*) AS n FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) GROUP BY category),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 600 AS served FROM n)
SELECT category::BIGINT AS category, served, CASE WHEN served THEN n ELSE 0 END AS urls FROM r""")
def q14b(spark, sf):
    known = table(spark, sf, "customer").where(c("c_custkey") % 3 == 0).select(
        F.concat(F.lit("https://i.example/"), c("c_custkey").cast("string"), F.lit(".jpg?a=1&b=2")).alias("url"))
    return jobs.url_inventory_until(_listing_pages(spark, sf), c("page") % 4, 250, 600, known)


@query("q15_variant_comparison", """WITH p AS (SELECT l_partkey, l_quantity / 10.0 AS la, l_quantity / 10.0 + l_tax AS lb, l_linenumber + 20 AS ta, l_linenumber + 21 AS tb FROM lineitem)
SELECT count(*) AS pairs, round(avg(la), 5) AS a_latency, round(avg(lb), 5) AS b_latency, round(sum(ta) / sum(la), 5) AS a_tokens_per_sec, round(sum(tb) / sum(lb), 5) AS b_tokens_per_sec,
  1.0::DOUBLE AS words_delta, count(*) FILTER (WHERE l_partkey % 3 = l_partkey % 5) AS identical, 0::BIGINT AS a_repetitions, count(*) FILTER (WHERE l_partkey % 7 = 0) AS b_repetitions FROM p""")
def q15(spark, sf):
    k = c("l_partkey")
    v = lambda latency, tokens, mod, rep: F.struct(latency.alias("latency"), tokens.alias("tokens"), tokens.alias("words"),
                                                   (k % mod).cast("string").alias("text"), rep.alias("repetition"))
    rows = table(spark, sf, "lineitem").select(
        v(c("l_quantity") / 10.0, c("l_linenumber") + 20, 3, F.lit(False)).alias("a"),
        v(c("l_quantity") / 10.0 + c("l_tax"), c("l_linenumber") + 21, 5, k % 7 == 0).alias("b"))
    out = jobs.compare_variants(rows)
    r = [n for n in out.columns if "latency" in n or "sec" in n]
    return out.withColumns({n: F.round(n, 5) for n in r})
