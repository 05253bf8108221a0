"""Catalog section: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stitchwork.functions import labels, routing, text, urls
from stitchwork.operators import filters, sets
from stitchwork.plans import standins as S
from stitchwork.plans.queries_scalars import HEURISTIC_SQL
from stitchwork.plans.registry import query, sql_has, sql_in, sql_pick, table
from stitchwork.rules import routing as R

c = F.col


@query("f01_heuristic_gate", f"SELECT id, {HEURISTIC_SQL} AS reason FROM {S.ANNOTATIONS}")
def f01(spark, sf):
    return S.annotations(spark, sf).select(
        "id", routing.heuristic_reason(c("size"), c("width"), c("height"), c("laplacian")).alias("reason"))


_SHAPES = ["portrait", "square", "any"]


@query("f02_framing_gate", f"""
WITH a AS (SELECT id, width, height, laplacian, {sql_pick(_SHAPES, 'id')} AS o, id % 17 = 0 AS white,
  CASE WHEN id % 4 = 0 THEN 0.9 END AS lo, CASE WHEN id % 6 = 0 THEN 1.4 END AS hi FROM {S.ANNOTATIONS}),
b AS (SELECT *, height::DOUBLE / width AS asp, coalesce(lo, CASE WHEN o = 'portrait' THEN 1.2 ELSE 0.65 END)::DOUBLE AS mn,
  coalesce(hi, CASE WHEN o = 'portrait' THEN 2.5 ELSE 1.85 END)::DOUBLE AS mx FROM a)
SELECT id, CASE WHEN width < 500 OR height < 600 THEN 'too_small_' || width || 'x' || height || '_need_500x600'
  WHEN o = 'portrait' AND asp < mn THEN 'outfit_not_full_body_aspect_' || printf('%.2f', asp) || '_need_ge_' || printf('%.2f', mn)
  WHEN o = 'portrait' AND asp > mx THEN 'extreme_vertical_aspect_' || printf('%.2f', asp)
  WHEN o = 'portrait' AND white THEN 'pure_white_isolated_flatlay_or_cutout'
  WHEN o = 'square' AND (asp < mn OR asp > mx) THEN 'grooming_not_square_portrait_aspect_' || printf('%.2f', asp) || '_need_' || printf('%.2f', mn) || '-' || printf('%.2f', mx)
  WHEN laplacian < 60.0 THEN 'blurry_laplacian_' || printf('%.1f', laplacian) || '_below_60.0' END AS reason FROM b""")
def f02(spark, sf):
    reason = routing.framing_reason(
        c("width"), c("height"), F.lit(500), F.lit(600), text.pick(_SHAPES, c("id")), c("id") % 17 == 0, c("laplacian"),
        F.when(c("id") % 4 == 0, 0.9), F.when(c("id") % 6 == 0, 1.4))
    return S.annotations(spark, sf).select("id", reason.alias("reason"))


@query("f03_url_blocklist", f"SELECT page_id, url FROM {S.URLS} WHERE NOT {sql_has('lower(url)', R.BLOCKED_URL_WORDS)}")
def f03(spark, sf):
    return S.urls(spark, sf).where(urls.url_is_safe(c("url"))).select("page_id", "url")


@query("f04_direct_image_url", f"""SELECT page_id, url FROM {S.URLS}
  WHERE regexp_matches(lower(regexp_replace(url, '[?#;].*$', '')), '\\.(jpg|jpeg|png|webp|gif)$')""")
def f04(spark, sf):
    return S.urls(spark, sf).where(urls.is_image_url(c("url"))).select("page_id", "url")


@query("f07_size_gate", """SELECT doc_id, strlen(text) >= 10000 AS keep_download, strlen(text) > 5000 AS existing,
  strlen(text) > 3000 AS existing_coded FROM documents""")
def f07(spark, sf):
    size = F.octet_length("text")
    return table(spark, sf, "documents").select(
        "doc_id", (size >= R.MIN_DOWNLOAD_BYTES).alias("keep_download"), (size > R.KEEP_EXISTING_BYTES).alias("existing"),
        (size > R.KEEP_EXISTING_BYTES_CODED).alias("existing_coded"))


@query("f08_resume_unprocessed", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def f08(spark, sf):
    return filters.unprocessed(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


_QA = "CASE WHEN quality = 1 AND toxic = 0 THEN '1' WHEN toxic = 1 THEN ' 1 ' ELSE '0' END"


@query("f09_usable_labels", f"SELECT doc_id, 'qa_processed' AS source FROM labels WHERE trim({_QA}) = '1' UNION ALL SELECT doc_id, 'raw_generated' FROM labels")
def f09(spark, sf):
    q = F.when((c("quality") == 1) & (c("toxic") == 0), "1").when(c("toxic") == 1, " 1 ").otherwise("0")
    rows = table(spark, sf, "labels").select("doc_id", q.alias("qa_pass"))
    return sets.union_shards([filters.usable_labels(rows, s).select("doc_id", F.lit(s).alias("source"))
                              for s in ("qa_processed", "raw_generated")])


_CATS = ["face_men_u35_average_candid", "face_women_u35_average_candid", "face_men_o50_average_candid"]


@query("f10_category_alias", f"""WITH k AS (SELECT c_custkey, {sql_pick(_CATS, 'c_custkey')} AS category FROM customer)
SELECT c_custkey, category FROM k WHERE category = 'face_men_u35_average_candid'""")
def f10(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", text.pick(_CATS, c("c_custkey")).alias("category"))
    return filters.in_category(rows, "category", "Men_U35", prefix="face_", suffix="_average_candid")


@query("f11_catalog_filter", """SELECT p_partkey, stream, tier, category FROM (SELECT p_partkey, p_brand AS category,
  CASE WHEN p_partkey % 2 = 0 THEN 'Outfit' ELSE 'Face_Grooming' END AS stream, p_type AS tier FROM part)
  WHERE stream = 'Outfit' AND tier = 'PROMO' AND category IN ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12') ORDER BY p_partkey LIMIT 25""")
def f11(spark, sf):
    catalog = table(spark, sf, "part").select(
        "p_partkey", c("p_brand").alias("category"), c("p_type").alias("tier"),
        F.when(c("p_partkey") % 2 == 0, "Outfit").otherwise("Face_Grooming").alias("stream"))
    return filters.catalog_rows(catalog, "Outfit", "PROMO", ["Brand#1", "Brand#2", "Brand#11", "Brand#12"], 25, [c("p_partkey")])


@query("f12_text_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(THE RE|der un|que la)[a-z]*n')")
def f12(spark, sf):
    return filters.text_matches(table(spark, sf, "documents"), "text", "(THE RE|der un|que la)[a-z]*n").select("doc_id")


@query("f13_attribute_value", f"SELECT id, filename FROM {S.LABELS} WHERE facial_hair_style = 'clean_shaven' AND category = 'Men_Grooming'")
def f13(spark, sf):
    return S.label_rows(spark, sf).where((c("facial_hair_style") == "clean_shaven") & (c("category") == "Men_Grooming")).select("id", "filename")


BUCKETS_SQL = f"WITH a AS (SELECT *, lower(array_to_string(issues, ' ')) AS it FROM {S.LABELS} WHERE verdict = 'invalid') " + \
    " UNION ALL ".join(f"SELECT id, filename, '{b}' AS bucket FROM a WHERE ({p}) AND {sql_has('it', k)}" for b, p, k in filters.ISSUE_BUCKETS)


@query("f14_issue_buckets", BUCKETS_SQL)
def f14(spark, sf):
    return filters.issue_buckets(S.label_rows(spark, sf)).select("id", "filename", "bucket")


@query("f15_target_whitelist", """SELECT b.item_id, t.doc_id FROM benchmark b JOIN documents t ON t.doc_id = b.item_id""")
def f15(spark, sf):
    targets = table(spark, sf, "benchmark").select(c("item_id").alias("doc_id"))
    tasks = table(spark, sf, "documents").select("doc_id")
    return filters.resolve_targets(targets, tasks, "doc_id").select(c("doc_id").alias("item_id"), "doc_id")


@query("f16_shard_filter", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3")
def f16(spark, sf):
    return filters.shard(table(spark, sf, "orders"), c("o_orderkey"), 7, 3).select("o_orderkey")


@query("f17_position_slice", """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders)
SELECT o_orderkey, pos FROM p WHERE pos >= 100 AND pos < 900""")
def f17(spark, sf):
    from stitchwork.operators.ordered import global_row_number
    placed = global_row_number(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"),
                               [c("o_orderdate"), c("o_orderkey")], "n").select("o_orderkey", (c("n") - 1).alias("pos"))
    return filters.position_slice(placed, "pos", 100, 900)


STATUS_SQL = f"""CASE WHEN reason <> 'ok' THEN 'rejected_heuristic_' || reason WHEN NOT judged THEN 'rejected_vlm_failed'
  WHEN NOT is_look THEN 'rejected_not_human' ELSE 'sorted' END"""
LOG_SQL = f"(SELECT *, {STATUS_SQL} AS status FROM (SELECT *, {HEURISTIC_SQL} AS reason FROM {S.ANNOTATIONS}))"


def status_log(spark, sf):
    reason = routing.heuristic_reason(c("size"), c("width"), c("height"), c("laplacian"))
    return S.annotations(spark, sf).withColumn("reason", reason).withColumn(
        "status", routing.look_status(c("reason"), c("judged"), c("is_look")))


@query("f18_look_status", f"SELECT id, status FROM {LOG_SQL}")
def f18(spark, sf):
    return status_log(spark, sf).select("id", "status")


@query("f19_qa_passed", f"SELECT id FROM {S.ADVICE} WHERE CASE WHEN id % 3 = 0 THEN false WHEN id % 3 = 1 THEN true END IS NOT FALSE")
def f19(spark, sf):
    flag = F.when(c("id") % 3 == 0, False).when(c("id") % 3 == 1, True)
    return filters.qa_passed(S.advice(spark, sf), flag).select("id")


@query("f20_trainable_fields", f"""SELECT filename, upper_pattern, lower_pattern, facial_hair_style, makeup_style, fabric_wrinkled, fit_baggy, fit_tight,
  footwear_worn, styling_sloppy, hair_untidy, skin_neglected, eyebrows_unkempt, facial_hair_untidy, makeup_uneven, score FROM {S.LABELS}""")
def f20(spark, sf):
    """Only the trainable columns of the label rows survive; provenance columns are pruned before the scan."""
    from stitchwork.sources.readers import trainable_fields
    from stitchwork.rules import garments as G
    keep = {f["name"] for cat in G.CATEGORIES for f in trainable_fields(G.label_schema(cat))}
    rows = S.label_rows(spark, sf)
    return rows.select("filename", *[n for n in rows.columns if n in keep])
