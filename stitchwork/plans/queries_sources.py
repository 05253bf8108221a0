"""Catalog section: sources, sinks, JSON repair, listings, request lines, pixels, looks, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from stitchwork.functions import geometry, jsonish, labels as L, routing, text, urls
from stitchwork.operators import generate, looks as look_ops, pixels, sets
from stitchwork.plans import standins as S
from stitchwork.plans.landing import fresh_folder
from stitchwork.plans.queries_aggregates import ROUTED_SQL, routed
from stitchwork.plans.queries_filters import LOG_SQL, status_log
from stitchwork.plans.queries_scalars import _words_sql
from stitchwork.plans.registry import q, query, sql_in, sql_list, sql_map, sql_pick, table
from stitchwork.rules import advice as A
from stitchwork.rules import garments as G
from stitchwork.sources import readers, writers
from stitchwork.streaming import flows, state

c = F.col


# ---- sources --------------------------------------------------------------------------------

@query("s03_tolerant_json_lines", "SELECT event_id, (props->>'k')::INT AS k FROM events WHERE event_id % 50 <> 0")
def s03(spark, sf):
    raw = F.when(c("event_id") % 50 == 0, F.concat(F.lit('{"k": '), c("props"))).otherwise(c("props"))
    rows = table(spark, sf, "events").select("event_id", raw.alias("props"))
    return readers.parse_json_column(rows, "props", "k int, _corrupt string").where(c("_corrupt").isNull()).select("event_id", "k")


@query("s04_json_map_of_lists", "SELECT o_orderpriority AS category, unnest(['u' || o_orderkey, 'v' || o_custkey]) AS url, unnest([0, 1])::INT AS position FROM orders")
def s04(spark, sf):
    folder = fresh_folder(spark, "json-map")
    doc = F.concat(F.lit('{"'), c("o_orderpriority"), F.lit('": ["u'), c("o_orderkey").cast("string"), F.lit('", "v'),
                   c("o_custkey").cast("string"), F.lit('"]}'))
    # Each landed line is one such document.
    table(spark, sf, "orders").select(doc.alias("value")).write.text(folder)
    return readers.json_map_rows(spark.read.text(folder))


@query("s05_manifest", f"SELECT filename, 'p ' || id AS prompt, category, tier, id AS seed, id::VARCHAR AS k FROM {S.LABELS}")
def s05(spark, sf):
    rows = S.label_rows(spark, sf)
    entry = F.struct(F.concat(F.lit("p "), c("id").cast("string")).alias("prompt"), "category", "tier", c("id").alias("seed"),
                     F.create_map(F.lit("k"), c("id").cast("string")).alias("row"))
    docs = rows.select(F.to_json(F.create_map(c("filename"), entry)).alias("value"))
    return readers.manifest_rows(docs).select("filename", "prompt", "category", "tier", "seed", c("row")["k"].alias("k"))


@query("s14_prompt_variants", "SELECT 'v' || p_partkey AS variant, unnest(['prompt_append', 'extra_negative']) AS key, unnest([p_name, p_type]) AS text FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'v' || p_partkey, 'prompt_append', p_name FROM part WHERE p_partkey % 3 = 0")
def s14(spark, sf):
    k = c("p_partkey")
    inner = F.create_map(F.lit("prompt_append"), c("p_name"), F.lit("extra_negative"), F.when(k % 3 == 0, "").otherwise(c("p_type")))
    docs = table(spark, sf, "part").select(F.to_json(F.create_map(F.concat(F.lit("v"), k.cast("string")), inner)).alias("value"))
    return readers.variant_rows(docs)


@query("s16_listing_pages", "SELECT o_orderkey AS page, 3 AS posts FROM orders")
def s16(spark, sf):
    return _listing_pages(spark, sf).select("page", F.size("data.children").alias("posts"))


@query("s18_catalog_defaults", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS query, CASE WHEN p_partkey % 2 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'hot' END END AS listing,
  'top' AS sort, 'all' AS time, CASE WHEN p_partkey % 5 = 0 THEN p_size ELSE 40 END AS "limit" FROM part""")
def s18(spark, sf):
    k, none = c("p_partkey"), F.lit(None).cast("string")
    rows = table(spark, sf, "part").select(
        k, F.when(k % 2 == 0, c("p_name")).otherwise("").alias("query"), F.when(k % 3 == 0, "new").alias("listing"), none.alias("sort"),
        none.alias("time"), none.alias("description"), F.when(k % 5 == 0, c("p_size")).alias("limit"))
    return readers.catalog_defaults(rows).select("p_partkey", "query", "listing", "sort", "time", "limit")


@query("f05_video_posts", "SELECT page_id FROM pages WHERE page_id % 4 = 0 OR page_id % 5 = 1 OR page_id % 7 = 2")
def f05(spark, sf):
    return _posts(spark, sf).where(urls.is_video(c("post"))).select("page_id")


@query("f06_removed_posts", "SELECT page_id FROM pages WHERE page_id % 6 = 0 OR page_id % 9 = 1 OR page_id % 11 = 2")
def f06(spark, sf):
    return _posts(spark, sf).where(urls.is_gone(c("post"))).select("page_id")


def _posts(spark, sf):
    p = c("page_id")
    return table(spark, sf, "pages").select(p, F.struct(
        F.when(p % 4 == 0, True).when(p % 3 == 0, False).alias("is_video"), F.when(p % 5 == 1, "hosted:video").alias("post_hint"),
        F.when(p % 7 == 2, "YouTube.com").otherwise("i.redd.it").alias("domain"), F.when(p % 6 == 0, "moderator").alias("removed_by_category"),
        F.when(p % 9 == 1, "[removed]").otherwise("text").alias("selftext"), F.when(p % 11 == 2, "[deleted]").alias("title")).alias("post"))


@query("k01_append_log", "SELECT o_orderstatus, 2 * count(*) AS n FROM orders GROUP BY 1")
def k01(spark, sf):
    folder = fresh_folder(spark, "log")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    writers.append_log(rows, folder)
    writers.append_log(rows, folder)
    log = readers.json_lines(spark, folder, "o_orderkey long, o_orderstatus string")
    return log.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("k06_audit_report", f"""SELECT count(*)::BIGINT AS sample_size, count(*) FILTER (WHERE verdict = 'valid')::BIGINT AS valid, count(*) FILTER (WHERE verdict = 'invalid')::BIGINT AS invalid,
  count(*) FILTER (WHERE id % 3 = 0)::BIGINT AS body_type_match_failed, count(*) FILTER (WHERE cust % 5 = 0)::BIGINT AS face_match_failed,
  count(*) FILTER (WHERE id % 7 = 0)::BIGINT AS attribute_match_failed, count(*) FILTER (WHERE cust % 11 = 0)::BIGINT AS severe_anatomy_defect_failed FROM {S.LABELS}""")
def k06(spark, sf):
    from stitchwork.operators.aggregates import audit_summary
    v = S.label_rows(spark, sf).select(
        "verdict", (c("id") % 3 != 0).alias("body_type_match"), (c("cust") % 5 != 0).alias("face_match"),
        (c("id") % 7 != 0).alias("attribute_match"), (c("cust") % 11 == 0).alias("severe_anatomy_defect"))
    report = writers.audit_report(audit_summary(v, 28000), "judge")
    j = lambda path: F.get_json_object("value", path).cast("long")
    return report.select(j("$.sample_size").alias("sample_size"), *[j(f"$.summary.{n}").alias(n) for n in (
        "valid", "invalid", "body_type_match_failed", "face_match_failed", "attribute_match_failed", "severe_anatomy_defect_failed")])


@query("s06_labels_csv", f"SELECT filename, category, tier, score, upper_pattern, fit_baggy::INT AS fit_baggy, hair_untidy::INT AS hair_untidy FROM {S.LABELS}")
def s06(spark, sf):
    out = []
    for category in G.CATEGORIES:
        folder = fresh_folder(spark, "labels-csv")
        writers.write_labels(S.label_rows(spark, sf).where(c("category") == category), folder, category)
        rows = readers.labels_csv(spark, folder, category)
        out.append(rows.select("filename", "category", "tier", "score", *[
            (c(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n)
            for n, kind in (("upper_pattern", "string"), ("fit_baggy", "int"), ("hair_untidy", "int"))]))
    return sets.union_shards(out)


@query("s07_shards_with_provenance", f"SELECT shard, count(*) AS n, count(DISTINCT filename) AS files FROM {S.SHARDS} GROUP BY shard")
def s07(spark, sf):
    folder = fresh_folder(spark, "shards")
    S.shard_rows(spark, sf).select("filename", "value", "shard").write.partitionBy("shard").option("header", True).csv(folder)
    rows = readers.shards(spark, f"{folder}/shard=*/*.csv").select("filename", c("_metadata.file_path").alias("from"))
    number = F.regexp_extract("from", r"shard=(\d+)", 1).cast("long")
    return rows.groupBy(number.alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("filename").alias("files"))


@query("s08_tsv_pruned", "SELECT c_custkey::VARCHAR AS photo_id, c_name AS keyword FROM customer")
def s08(spark, sf):
    folder = fresh_folder(spark, "tsv")
    (table(spark, sf, "customer").select(c("c_custkey").alias("photo_id"), c("c_name").alias("keyword"), "c_acctbal")
     .write.option("header", True).option("sep", "\t").csv(f"{folder}/keywords.tsv"))
    return readers.tsv(spark, folder, ["keywords.tsv000", "keywords.tsv", "keywords.csv"], ["photo_id", "keyword"])


@query("s09_parquet_image_shards", "SELECT doc_id, strlen(text) AS bytes FROM documents WHERE doc_id % 11 <> 0")
def s09(spark, sf):
    folder = fresh_folder(spark, "image-shards")
    data = F.when(c("doc_id") % 11 != 0, c("text").cast("binary"))
    rows = table(spark, sf, "documents").select("doc_id", F.struct(data.alias("bytes"), F.format_string("%05d.jpg", "doc_id").alias("path")).alias("image"))
    rows.where(c("doc_id") % 2 == 0).write.parquet(f"{folder}/a")
    rows.where(c("doc_id") % 2 == 1).write.parquet(f"{folder}/b")
    return readers.parquet_shards(spark, [f"{folder}/a", f"{folder}/b"]).select("doc_id", F.octet_length("image.bytes").alias("bytes"))


@query("s09b_shard_ledger", """WITH d AS (SELECT 'shard' || (doc_id % 6) AS shard, count(*) AS n, count(*) FILTER (WHERE doc_id % 11 <> 0) AS good FROM documents GROUP BY 1)
SELECT shard, n AS expected, CASE shard WHEN 'shard2' THEN 0 WHEN 'shard4' THEN n - (SELECT count(*) FROM documents WHERE doc_id % 6 = 4 AND doc_id % 5 = 0) ELSE n END AS read,
  CASE shard WHEN 'shard2' THEN 0 WHEN 'shard4' THEN good - (SELECT count(*) FROM documents WHERE doc_id % 6 = 4 AND doc_id % 5 = 0 AND doc_id % 11 <> 0) ELSE good END AS usable,
  CASE shard WHEN 'shard2' THEN 'failed' WHEN 'shard4' THEN 'partial' ELSE 'complete' END AS status FROM d
UNION ALL SELECT 'shard9', 7, 0, 0, 'missing'""")
def s09b(spark, sf):
    folder = fresh_folder(spark, "image-shards")
    data = F.when(c("doc_id") % 11 != 0, c("text").cast("binary"))
    rows = table(spark, sf, "documents").select("doc_id", F.struct(data.alias("bytes"), F.format_string("%05d.jpg", "doc_id").alias("path")).alias("image"))
    shard = F.concat(F.lit("shard"), (c("doc_id") % 6).cast("string"))
    listed = rows.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("rows"))
    # Shards 0 and 1 leave their number to the footers, 2 is broken, 4 has lost rows, 9 was never delivered.
    manifest = (listed.withColumn("rows", F.when(~c("shard").isin("shard0", "shard1"), c("rows")))
                .unionByName(spark.createDataFrame([("shard9", 7)], "shard string, rows long")))
    for k in (0, 1, 3, 4, 5):
        rows.where((c("doc_id") % 6 == k) & ~((c("doc_id") % 6 == 4) & (c("doc_id") % 5 == 0))).write.parquet(f"{folder}/shard{k}")
    rows.where(c("doc_id") % 6 == 2).select(F.concat(F.lit("PAR1 broken "), c("doc_id").cast("string"))).write.text(f"{folder}/shard2")
    ledger = readers.shard_ledger(spark, folder, manifest, rows.schema, F.octet_length("image.bytes") > 0)
    return ledger.select("shard", "expected", "read", "usable", "status")


@query("s10_seen_lines", "SELECT DISTINCT url AS line FROM pages")
def s10(spark, sf):
    folder = fresh_folder(spark, "lines")
    pad = F.when(c("page_id") % 2 == 0, F.concat(F.lit("  "), c("url"), F.lit(" \t"))).otherwise(c("url"))
    lines = table(spark, sf, "pages").select(F.explode(F.array(pad, F.lit("  "))).alias("value"))
    lines.write.text(folder)
    return readers.text_lines(spark, folder).distinct()


@query("s11_partition_tree", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def s11(spark, sf):
    folder = fresh_folder(spark, "tree")
    table(spark, sf, "documents").select("doc_id", "lang", "source").hint("rebalance", "lang", "source").write.partitionBy("lang", "source").parquet(folder)
    return spark.read.parquet(folder).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


_VERDICTS = ["valid", "invalid"]
_BODY = "'{\"verdict\": \"' || " + sql_pick(_VERDICTS, "event_id") + " || '\", \"k\": ' || event_id || '}'"


def _answer(spark, sf):
    e = c("event_id")
    body = F.concat(F.lit('{"verdict": "'), text.pick(_VERDICTS, e), F.lit('", "k": '), e.cast("string"))
    comma = F.concat(body, F.lit(", }"))
    plain = F.concat(body, F.lit("}"))
    kind = e % 6
    fence = lambda x: F.concat(F.lit("```json\n"), x, F.lit("\n```"))
    answer = (F.when(kind == 0, plain).when(kind == 1, fence(plain)).when(kind == 2, F.concat(F.lit("Here: "), plain, F.lit(" done")))
              .when(kind == 3, fence(comma)).when(kind == 4, F.concat(plain, F.lit(" and "), plain)).otherwise("{'verdict': 'valid'}"))
    return table(spark, sf, "events").select("event_id", answer.alias("answer"))


@query("p01_json_repair", f"SELECT event_id, CASE WHEN event_id % 6 <= 3 THEN {sql_pick(_VERDICTS, 'event_id')} END AS verdict, CASE WHEN event_id % 6 <= 3 THEN event_id END AS k FROM events")
def p01(spark, sf):
    rows = _answer(spark, sf).select("event_id", jsonish.repair_json(c("answer")).alias("v"))
    return rows.select("event_id", jsonish.field(c("v"), "verdict").alias("verdict"), jsonish.field(c("v"), "k", "bigint").alias("k"))


@query("p02_fenced_json", f"SELECT event_id, CASE WHEN event_id % 6 <= 1 THEN {sql_pick(_VERDICTS, 'event_id')} END AS verdict FROM events")
def p02(spark, sf):
    return _answer(spark, sf).select("event_id", jsonish.field(jsonish.parse_verdict(c("answer")), "verdict").alias("verdict"))


@query("s13_batch_predictions", f"""SELECT 'f' || event_id AS key, CASE WHEN event_id % 6 <= 3 AND event_id % 10 <> 0 THEN {sql_pick(_VERDICTS, 'event_id')} END AS verdict,
  CASE WHEN event_id % 6 <= 3 AND event_id % 10 <> 0 THEN NULL ELSE 'parse_failure' END AS error FROM events""")
def s13(spark, sf):
    part = F.struct(F.array(F.struct(F.struct(F.array(F.struct(c("answer").alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    line = F.when(c("event_id") % 10 == 0, F.to_json(F.struct(F.concat(F.lit("f"), c("event_id").cast("string")).alias("key")))).otherwise(
        F.to_json(F.struct(F.concat(F.lit("f"), c("event_id").cast("string")).alias("key"), part.alias("response"))))
    out = readers.batch_predictions(_answer(spark, sf).select(line.alias("value")))
    return out.select("key", jsonish.field(c("result"), "verdict").alias("verdict"), "error")


@query("p20_listing_urls", """SELECT o_orderkey AS page, CASE o_orderkey % 5 WHEN 0 THEN unnest(['https://i.example/' || o_custkey || '.jpg?a=1&b=2']) WHEN 1 THEN NULL
  WHEN 2 THEN 'https://p.example/' || o_custkey || '.png?x=1&y=2' WHEN 3 THEN 'https://t.example/' || o_custkey || '.jpg?w=9&s=1' END AS url FROM orders WHERE o_orderkey % 5 IN (0, 2, 3)
  UNION ALL SELECT o_orderkey, 'https://q.example/' || o_custkey || '.gif' FROM orders WHERE o_orderkey % 5 = 2""")
def p20(spark, sf):
    return readers.listing_urls(_listing_pages(spark, sf), c("page")).select("page", "url")


def _listing_pages(spark, sf):
    """A listing page per order: direct link, removed post, gallery, preview, video, with a repeat of the first kind."""
    k, u = c("o_orderkey"), c("o_custkey").cast("string")
    t = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    direct = t('{"id":"a","url":"https://i.example/', u, '.jpg?a=1&amp;b=2"}')
    removed = t('{"id":"b","title":"[deleted]","url":"https://i.example/', u, '.jpg"}')
    gallery = t('{"id":"c","is_gallery":true,"gallery_data":{"items":[{"media_id":"m2"},{"media_id":"m1"},{"media_id":"bad"}]},"media_metadata":{'
                '"m1":{"status":"valid","s":{"u":"https://p.example/', u, '.png?x=1&amp;y=2"}},"bad":{"status":"failed"},'
                '"m2":{"status":"valid","s":{},"p":[{"u":"https://s.example/small.png"},{"u":"https://q.example/', u, '.gif"}]}}}')
    preview = t('{"id":"d","url":"https://blog.example/a","preview":{"images":[{"source":{"url":"https://t.example/', u, '.jpg?w=9&amp;s=1"}}]}}')
    video = t('{"id":"e","is_video":true,"url":"https://i.example/', u, '.jpg"}')
    post = F.when(k % 5 == 0, direct).when(k % 5 == 1, removed).when(k % 5 == 2, gallery).when(k % 5 == 3, preview).otherwise(video)
    page = t('{"data":{"after":"', k.cast("string"), '","children":[{"kind":"t3","data":', post, '},{"kind":"t3","data":', post,
             '},{"kind":"t1","data":', direct, '}]}}')
    folder = fresh_folder(spark, "listing-pages")
    table(spark, sf, "orders").select(page.alias("value")).write.text(folder)
    return readers.listing_pages(spark, folder).withColumn("page", c("data.after").cast("long"))


@query("p21_listing_request_url", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'https://www.reddit.com/r/Fit/top.json?limit=' || p_size || CASE WHEN p_partkey % 5 = 0 THEN '&after=t3_x' ELSE '' END || '&q=' || replace(p_name, ' ', '+') || '&t=all'
  WHEN p_partkey % 4 = 2 THEN 'https://www.reddit.com/r/' || p_type || '/hot.json?limit=' || p_size || CASE WHEN p_partkey % 5 = 0 THEN '&after=t3_x' ELSE '' END
  ELSE 'https://www.reddit.com' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '/r/' || p_type END || '/search.json?q=' || replace(p_name, ' ', '+') || '&limit=' || p_size || '&sort=top&t=all'
    || CASE WHEN p_partkey % 5 = 0 THEN '&after=t3_x' ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN '&type=link' ELSE '&restrict_sr=1' END END AS url FROM part""")
def p21(spark, sf):
    k = c("p_partkey")
    target = F.when(k % 4 == 3, "https://www.reddit.com/r/Fit/top").when(k % 4 == 0, "all").otherwise(F.concat(F.lit("r/"), c("p_type")))
    none = F.lit(None).cast("string")
    url = urls.listing_url(target, none, F.when(k % 4 != 2, c("p_name")), none, F.when(k % 5 == 0, "t3_x"), c("p_size"), F.lit("all"))
    return table(spark, sf, "part").select("p_partkey", url.alias("url"))


@query("s17_catalog_normalize", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'reddit_' || p_type WHEN 1 THEN p_brand ELSE p_name END AS category,
  CASE p_partkey % 3 WHEN 0 THEN 'r/' || p_type ELSE p_type END AS subreddit, CASE WHEN p_partkey % 3 = 1 THEN p_name END AS query FROM part""")
def s17(spark, sf):
    k = c("p_partkey")
    obj = lambda **f: F.to_json(F.struct(*[v.alias(n) for n, v in f.items()]))
    line = (F.when(k % 3 == 0, F.concat(F.lit('"r/'), c("p_type"), F.lit('"')))
            .when(k % 3 == 1, obj(category=c("p_brand"), subreddit=c("p_type"), query=c("p_name")))
            .otherwise(obj(folder=c("p_name"), target=c("p_type"))))
    rows = table(spark, sf, "part").select("p_partkey", line.alias("value"))
    cat = readers.catalog_columns(c("value"))
    return rows.select("p_partkey", *[cat[n].alias(n) for n in ("category", "subreddit", "query")])


# ---- sinks ----------------------------------------------------------------------------------

@query("k02_routed_write", f"""SELECT CASE WHEN status = 'sorted' THEN 'sorted' WHEN starts_with(status, 'rejected_heuristic') THEN 'blurry_or_low_res' WHEN status = 'rejected_vlm_failed' THEN 'vlm_failed' ELSE 'non_human_or_flatlay' END AS status_group,
  coalesce(r.stream, 'none') AS stream, coalesce(r.demographic, 'none') AS demographic, coalesce(r.tier, 'none') AS tier, count(*) AS n FROM {LOG_SQL} l LEFT JOIN {ROUTED_SQL} r USING (id) GROUP BY ALL""")
def k02(spark, sf):
    folder = fresh_folder(spark, "routed")
    ok = c("status") == "sorted"
    log = status_log(spark, sf)
    rows = log.select("id", "filename", F.when(ok, "sorted").otherwise(routing.reject_folder(c("status"))).alias("status_group"),
                      F.when(ok, routing.resolve_stream(c("focus"), c("shot"), c("path"))).alias("stream"),
                      F.when(ok, routing.resolve_demographic(c("gender"), c("age"))).alias("demographic"),
                      F.when(ok, routing.resolve_tier(c("tier_text"), c("overall"))).alias("tier"))
    writers.write_routed(rows, folder)
    return spark.read.parquet(folder).groupBy("status_group", "stream", "demographic", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("k03_schema_ordered_labels", f"""SELECT filename, score::VARCHAR AS score, CASE WHEN ends_with(category, 'Outfit') THEN fabric_wrinkled ELSE hair_untidy END::VARCHAR AS condition,
  CASE WHEN ends_with(category, 'Outfit') THEN '' ELSE 'no column' END AS requested_hair_desc FROM {S.LABELS}""")
def k03(spark, sf):
    out = []
    for category in G.CATEGORIES:
        rows = writers.label_columns(S.label_rows(spark, sf).where(c("category") == category), category)
        condition = "fabric_wrinkled" if category.endswith("Outfit") else "hair_untidy"
        hair = c("requested_hair_desc") if "requested_hair_desc" in rows.columns else F.lit("no column")
        out.append(rows.select("filename", "score", c(condition).alias("condition"), hair.alias("requested_hair_desc")))
    return sets.union_shards(out)


@query("k04_versioned_snapshot", f"SELECT id, filename, score FROM {S.LABELS}")
def k04(spark, sf):
    folder = fresh_folder(spark, "snapshot")
    rows = S.label_rows(spark, sf).select("id", "filename", "score")
    writers.publish(rows.where(c("id") % 2 == 0), folder, write=True, version="9")
    writers.publish(rows, folder, write=True, version="10")
    return writers.read_published(spark, folder)


@query("k04b_dry_run_diff", f"""SELECT id, 'tier' AS "column", tier AS old_value, tier || '!' AS new_value FROM {S.LABELS} WHERE id % 3 = 0""")
def k04b(spark, sf):
    folder = fresh_folder(spark, "snapshot")
    rows = S.label_rows(spark, sf).select("id", "filename", "tier")
    writers.publish(rows, folder, write=True, version="1")
    edited = rows.withColumn("tier", F.when(c("id") % 3 == 0, F.concat("tier", F.lit("!"))).otherwise(c("tier")))
    return writers.preview(edited, folder, "id")


@query("k09_request_lines", """SELECT '{"key":"d' || doc_id || '","request":{"contents":[{"role":"user","parts":[{"inline_data":{"mime_type":"image/png","data":"' || base64(encode(text)) || '"}},{"text":"Classify doc ' || doc_id || '"}]}],"system_instruction":{"parts":[{"text":"Be strict."}]},"generation_config":{"temperature":0.1,"response_mime_type":"application/json"}}}' AS value FROM documents""")
def k09(spark, sf):
    d = c("doc_id").cast("string")
    return writers.request_lines(table(spark, sf, "documents"), F.concat(F.lit("d"), d), c("text").cast("binary"),
                                 F.concat(F.lit("Classify doc "), d), "image/png", F.lit("Be strict."))


# ---- prompts, sequences, geometry -----------------------------------------------------------

@query("p40_prompts")
def p40(spark, sf):
    from stitchwork.plans.queries_sets import drawn
    return generate.render_prompts(drawn(spark, sf)).select("index", "prompt", "negative_prompt", "resolution")


@query("p50_landmark_signature", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT vec_id, e, (e[1]+e[3])/2 AS lx, (e[2]+e[4])/2 AS ly, (e[5]+e[7])/2 AS rx, (e[6]+e[8])/2 AS ry, e[9] AS nx, e[10] AS ny, (e[11]+e[13])/2 AS mx, (e[12]+e[14])/2 AS my FROM e),
d AS (SELECT *, sqrt((lx-rx)*(lx-rx)+(ly-ry)*(ly-ry)) AS ed, (lx+rx)/2 AS cx, (ly+ry)/2 AS cy FROM m)
SELECT vec_id, round(sqrt((cx-nx)*(cx-nx)+(cy-ny)*(cy-ny))/ed, 6) AS nose, round(sqrt((cx-mx)*(cx-mx)+(cy-my)*(cy-my))/ed, 6) AS mouth,
  round(sqrt((nx-e[17])*(nx-e[17])+(ny-e[18])*(ny-e[18]))/ed, 6) AS chin, round((greatest(e[11], e[13])-least(e[11], e[13]))/ed, 6) AS width,
  round(sqrt((e[15]-e[17])*(e[15]-e[17])+(e[16]-e[18])*(e[16]-e[18]))/ed, 6) AS jaw, 2.5::DOUBLE AS aspect FROM d WHERE ed > 0.01""")
def p50(spark, sf):
    at = lambda i: F.element_at("embedding", i).cast("double")
    pts = lambda *starts: F.array(*[F.struct(at(i).alias("x"), at(i + 1).alias("y")) for i in starts])
    faces = table(spark, sf, "embeddings").select(
        "vec_id", pts(1, 3).alias("left_eye"), pts(5, 7).alias("right_eye"), pts(9).alias("nose"), pts(11, 13).alias("lips"),
        pts(15, 17).alias("contour"), F.lit(0.4).alias("box_width"), F.lit(1.0).alias("box_height"))
    rows = geometry.landmark_signature(faces, "s").where(c("s").isNotNull())
    names = ["nose", "mouth", "chin", "width", "jaw", "aspect"]
    return rows.select("vec_id", *[F.round(F.element_at("s", i + 1), 6).alias(n) for i, n in enumerate(names)])


@query("p52_framing_message", """
WITH k AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey % 2 = 0 AS grooming, l_quantity / 60.0 AS fh, 0.3 + l_discount * 4 AS cx, 0.3 + l_tax * 4 AS cy, (l_suppkey % 20) / 20.0 AS ql,
  0.5::DOUBLE AS nx, (l_suppkey % 10) / 9.5 AS ny, 0.5 + l_discount AS rx, CASE WHEN l_orderkey % 9 = 0 THEN 0.1 ELSE 0.8 END AS nc, 0.8 AS rc, (l_partkey % 5) / 10.0 AS al FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN grooming THEN CASE WHEN ql < 0.35 THEN 'Lighting too dark — face light source' WHEN fh < 0.22 THEN 'Move closer to fill oval' WHEN fh > 0.68 THEN 'Step back slightly'
   WHEN abs(cx - 0.5) > 0.14 OR abs(cy - 0.44) > 0.16 THEN 'Center face inside oval' ELSE 'Hold steady...' END
 ELSE CASE WHEN nc > 0.25 AND ny > 0.90 THEN 'Step back to show head' WHEN al <= 0.2 THEN 'Step back to show shoes' WHEN NOT (nc > 0.25 AND abs(nx - rx) < 0.05) THEN 'Align upright in silhouette' ELSE 'Hold steady...' END END AS message FROM k""")
def p52(spark, sf):
    f = lambda v: F.lit(v)
    msg = geometry.framing_message(
        F.when(c("l_partkey") % 2 == 0, "grooming").otherwise("outfit"), c("l_quantity") / 60.0, c("l_discount") * 4 + 0.3,
        c("l_tax") * 4 + 0.3, (c("l_suppkey") % 20) / f(20.0), f(0.5), (c("l_suppkey") % 10) / f(9.5), c("l_discount") + 0.5,
        F.when(c("l_orderkey") % 9 == 0, 0.1).otherwise(0.8), f(0.8), (c("l_partkey") % 5) / f(10.0), f(None).cast("double"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", msg.alias("message"))


@query("p59_supervised_spans", f"""WITH n AS (SELECT conv_id * 8 + turn AS id, {_words_sql('text')} AS n FROM conversations),
k AS (SELECT id, n, least(n, n // 3 + 5) AS pre FROM n)
SELECT id, least(n, 512)::INT AS length, greatest(least(n, 512) - pre, 0)::INT AS supervised FROM k""")
def p59(spark, sf):
    words = text.words("text")
    ids = F.transform(words, lambda w: F.abs(F.xxhash64(w)) % 50000)
    pre = F.least(F.size("ids"), F.floor(F.size("ids") / 3) + 5).cast("int")
    rows = table(spark, sf, "conversations").select((c("conv_id") * 8 + c("turn")).alias("id"), ids.alias("ids"))
    from stitchwork.functions.sequences import mask_prefix
    masked = rows.select("id", mask_prefix(c("ids"), pre, A.MAX_SEQUENCE).alias("m"))
    return masked.select("id", F.size("m.input_ids").alias("length"), F.size(F.filter("m.labels", lambda x: x != -100)).alias("supervised"))


# ---- looks ----------------------------------------------------------------------------------

_CLASSES = ["suit jacket", "hoodie", "beard man", "sunglasses", "denim", "tree", "t-shirt"]
_OCC = list(A.OCCASION_PROFILES)
_COLORS = ["Navy / Blue", "Light / White", "Olive / Green", None]


def detections(spark, sf):
    e = c("event_id")
    cls = F.array(*[F.struct(text.pick(_CLASSES, e * m + a).alias("label"), ((e % d + 1) / F.lit(float(d))).alias("confidence"))
                    for m, a, d in ((1, 0, 5), (3, 1, 4))])
    return table(spark, sf, "events").select(
        e.alias("look"), text.pick(_OCC, e).alias("occasion"), F.when(e % 7 != 0, 0.3).alias("face_w"),
        F.when(e % 7 != 0, (e % 5) * 0.06 + 0.27).alias("face_h"), F.when(e % 11 != 0, (e % 100) / F.lit(100.0)).alias("quality"),
        F.lit(0.5).alias("neck_x"), ((e % 8) * 0.01 + 0.5).alias("root_x"), F.when(e % 13 != 0, 0.9).alias("neck_conf"),
        F.lit(0.9).alias("root_conf"), cls.alias("classes"), text.pick(_COLORS, e).alias("color"))


def _seen_sql(words, above):
    one = lambda lab, conf: "(" + " OR ".join(f"contains({lab}, {q(w)})" for w in words) + f") AND {conf} > {above}"
    return f"(({one('l1', 'c1')}) OR ({one('l2', 'c2')}))"


def _prof(i):
    return sql_map("occ", {k: v[i] for k, v in A.OCCASION_PROFILES.items()})


LOOK_SCORE_SQL = f"""
WITH k AS (SELECT event_id AS look, {sql_pick(_OCC, 'event_id')} AS occ, CASE WHEN event_id % 11 <> 0 THEN (event_id % 100)::DOUBLE / 100.0::DOUBLE ELSE 0.7 END AS ql,
  event_id % 13 <> 0 AS body, (event_id % 8) * 0.01 AS dx, {sql_pick(_CLASSES, 'event_id')} AS l1, {sql_pick(_CLASSES, 'event_id * 3 + 1')} AS l2,
  (event_id % 5 + 1) / 5.0 AS c1, (event_id % 4 + 1) / 4.0 AS c2 FROM events),
f AS (SELECT *, ql >= 0.65 AS bright, ql < 0.45 AS dim, body AND dx < 0.0399 AS upright, body AND dx >= 0.0399 AS lean, {_seen_sql(A.BEARD_CLASSES, 0.25)} AS beard,
  {_seen_sql(A.FORMAL_CLASSES, 0.25)} AS formal, {_seen_sql(A.CASUAL_CLASSES, 0.25)} AS cas, occ IN {sql_in(A.FORMAL_OCCASIONS)} AS expected FROM k),
g AS (SELECT *, cas AND NOT formal AS casual, cas AND NOT formal AND expected AS under, {_prof(4)} * 0.4 AS pen FROM f),
s AS (SELECT *, ({_prof(1)} + CASE WHEN bright THEN 0.4 ELSE 0 END - CASE WHEN dim THEN 0.5 ELSE 0 END + CASE WHEN upright THEN 0.5 ELSE 0 END + CASE WHEN formal THEN 0.5 ELSE 0 END
  + CASE WHEN formal AND expected THEN 0.3 ELSE 0 END - CASE WHEN under THEN pen ELSE 0 END)::DOUBLE AS base FROM g)
SELECT look, round(greatest(6.5, least(9.8, base)), 4) AS score, (CASE WHEN upright THEN 8.2 WHEN lean THEN 6.2 ELSE {_prof(2)} END)::DOUBLE AS posture_score,
  round((CASE WHEN formal THEN 8.4 WHEN under THEN greatest(5.8, 6.8 - pen * 0.5) WHEN casual THEN 7.6 ELSE 7.2 END)::DOUBLE, 4) AS fit_score,
  round((7.5 + CASE WHEN bright THEN 0.6 ELSE 0 END - CASE WHEN dim THEN 0.8 ELSE 0 END + CASE WHEN beard THEN 0.3 ELSE 0 END)::DOUBLE, 4) AS grooming_score,
  CASE WHEN formal AND expected THEN 'Executive & Formal' WHEN under THEN 'Too informal for occasion' WHEN casual THEN 'Versatile Everyday' ELSE 'Cohesive color palette' END AS style_note FROM s"""


@query("p44_look_scoring", LOOK_SCORE_SQL)
def p44(spark, sf):
    a = look_ops.analyze(detections(spark, sf))
    r = lambda n: F.round(n, 4).alias(n)
    return a.select("look", r("score"), "posture_score", r("fit_score"), r("grooming_score"), "style_note")


@query("p45_merge_evaluations")
def p45(spark, sf):
    a = look_ops.analyze(detections(spark, sf))
    tweaks = F.array(*[F.struct(F.lit(x).alias("category"), F.lit("Title").alias("title"), F.lit("Do it").alias("recommendation"),
                                F.lit("1 min").alias("effort")) for x in ("Lighting", "Hair volume")])
    judge = F.struct((c("look") % 50 / F.lit(10.0) + 4.5).alias("score"), F.lit("Sharp").alias("headline"), F.lit(7.0).alias("sharpness"),
                     F.lit(6.5).alias("formality"), F.lit(8.0).alias("occasion_match"),
                     F.array(F.lit("Clear face detection and more")).alias("good_points"), F.array(F.lit("Loose cuffs")).alias("improvement_points"),
                     tweaks.alias("tweaks"), F.lit("p").alias("posture_note"), F.lit("f").alias("fit_note"), F.lit("s").alias("style_note"))
    rows = a.select("look", judge.alias("judge"), F.struct("good_points", "bad_points", "suggestions").alias("local"))
    m = look_ops.merge_evaluations(rows)
    return m.select("look", "score", F.round("potential_score", 6).alias("potential_score"), F.array_join("good_points", "|").alias("good"),
                    F.array_join("bad_points", "|").alias("bad"), F.array_join(F.transform("suggestions", lambda s: s["category"]), "|").alias("suggestions"))


@query("p46_suggestions", f"""WITH l AS (SELECT *, ends_with(category, 'Outfit') AS outfit FROM {S.LABELS}),
n AS (SELECT id, list_filter([CASE WHEN hair_untidy > 0 THEN {q(A.SUGGEST_HAIR_UNTIDY)} END, CASE WHEN NOT outfit AND score >= 8.0 THEN {q(A.SUGGEST_HYDRATE)} END, CASE WHEN fabric_wrinkled > 0 THEN {q(A.SUGGEST_STEAM)} END, CASE WHEN footwear_worn > 0 THEN {q(A.SUGGEST_FOOTWEAR)} END, CASE WHEN outfit AND score >= 8.0 THEN {q(A.SUGGEST_BREAK)} END], lambda x: x IS NOT NULL) AS ls,
  CASE WHEN category = 'Men_Grooming' THEN CASE WHEN score >= 7.5 THEN {sql_list(A.APP_FALLBACK_LINES[('men', True)])} ELSE {sql_list(A.APP_FALLBACK_LINES[('men', False)])} END
  WHEN category = 'Women_Grooming' THEN CASE WHEN score >= 7.5 THEN {sql_list(A.APP_FALLBACK_LINES[('women', True)])} ELSE {sql_list(A.APP_FALLBACK_LINES[('women', False)])} END WHEN score >= 7.5 THEN {sql_list(A.APP_FALLBACK_LINES[('outfit', True)])} ELSE {sql_list(A.APP_FALLBACK_LINES[('outfit', False)])} END AS fb FROM l)
SELECT id, array_to_string((CASE WHEN len(ls) < 2 THEN list_concat(ls, fb) ELSE ls END)[1:4], '|') AS lines FROM n""")
def p46(spark, sf):
    rows = S.label_rows(spark, sf).withColumn("occasion", F.lit("Date Night"))
    return look_ops.suggest(rows).select("id", F.array_join(F.transform("suggestions", lambda s: s["recommendation"]), "|").alias("lines"))


# ---- pixels ---------------------------------------------------------------------------------

def text_images(spark, sf):
    """Whole texts as pixels: rows of 32 three-channel pixels, the last row filled up with black."""
    height = F.greatest(F.ceil(F.octet_length("text") / 96), F.lit(1)).cast("int")
    fill = F.unhex(F.repeat(F.lit("00"), height * 96 - F.octet_length("text")))
    return table(spark, sf, "documents").select(
        c("doc_id"), height.alias("height"), F.lit(32).alias("width"), F.lit(3).alias("nChannels"),
        F.concat(c("text").cast("binary"), fill).alias("data"))


@query("x01_pixel_measures")
def x01(spark, sf):
    m = pixels.with_color_names(pixels.measure(text_images(spark, sf), "doc_id"))
    return m.select("doc_id", "width", "height", "white_corners", F.round("laplacian", 4).alias("laplacian"), F.round("brightness", 4).alias("brightness"),
                    F.round("bottom_std", 4).alias("bottom_std"), "measured_upper_color", "measured_lower_color", "sample_color")


@query("x05_qa_rows", f"""WITH m AS (SELECT id, id % 13 <> 0 AS has, id % 17 <> 0 AS readable, (id * 7 % 900) / 10.0 AS lap, (id * 3 % 256)::DOUBLE AS bri, (id * 11 % 300) / 20.0 AS bot,
  category, {sql_pick(list(G.PALETTE), 'id')} AS up, {sql_pick(list(G.PALETTE), 'cust')} AS rq FROM {S.LABELS})
SELECT id, (CASE WHEN has AND readable AND lap >= 40 AND bri BETWEEN 35 AND 225 AND NOT (ends_with(category, 'Outfit') AND bot < 8) THEN 1 ELSE 0 END)::INT AS qa_pass,
  CASE WHEN NOT has THEN 'image_file_missing' WHEN NOT readable THEN 'unreadable_image' ELSE concat_ws(';', CASE WHEN lap < 40 THEN 'blurry(var=' || printf('%.1f', lap::DOUBLE) || ')' END,
    CASE WHEN NOT bri BETWEEN 35 AND 225 THEN 'brightness_out_of_range(' || printf('%.0f', bri) || ')' END,
    CASE WHEN ends_with(category, 'Outfit') AND bot < 8 THEN 'possible_cropped_feet(std=' || printf('%.1f', bot::DOUBLE) || ')' END) END AS qa_reasons,
  CASE WHEN has AND readable AND ends_with(category, 'Outfit') THEN (up = rq)::INT END AS color_match_upper FROM m""")
def x05(spark, sf):
    i = c("id")
    names = list(G.PALETTE)
    labels = S.label_rows(spark, sf).select("id", "category", "filename", text.pick(names, c("cust")).alias("requested_upper_color"),
                                            F.lit("none").alias("requested_lower_color"))
    measured = S.label_rows(spark, sf).where(i % 13 != 0).select(
        "filename", (i % 17 != 0).alias("readable"), ((i * 7 % 900) / F.lit(10.0)).alias("laplacian"), (i * 3 % 256).cast("double").alias("brightness"),
        ((i * 11 % 300) / F.lit(20.0)).alias("bottom_std"), text.pick(names, i).alias("measured_upper_color"), text.pick(names, i).alias("measured_lower_color"))
    return pixels.qa_rows(labels, measured).select("id", "qa_pass", "qa_reasons", "color_match_upper")


# ---- streams --------------------------------------------------------------------------------

def _stream(spark, sf, name, columns):
    """A given table as a file stream, be it one file or a folder of them."""
    schema = table(spark, sf, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    rows = flows.landed(spark, f"{sf}/{name}.parquet", schema) if folder else flows.landed(spark, sf, schema, glob=f"{name}.parquet")
    return rows.select(*columns)


@query("t01_stream_route", "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'rejected_short' ELSE 'sorted' END AS status, lang FROM documents")
def t01(spark, sf):
    out, ckpt = fresh_folder(spark, "stream-out"), fresh_folder(spark, "stream-ckpt")
    rows = _stream(spark, sf, "documents", ["doc_id", "n_chars", "lang"])
    routed_rows = rows.select("doc_id", F.when(c("n_chars") < 100, "rejected_short").otherwise("sorted").alias("status"), "lang")
    flows.to_files(routed_rows, out, ckpt, ["status", "lang"]).awaitTermination()
    return spark.read.schema("doc_id long, status string, lang string").parquet(out)


@query("t02_stream_url_dedup", "SELECT DISTINCT 'u' || (event_id * 7 % 900) AS url FROM events")
def t02(spark, sf):
    out, ckpt = fresh_folder(spark, "stream-out"), fresh_folder(spark, "stream-ckpt")
    rows = _stream(spark, sf, "events", ["event_id"]).select(F.concat(F.lit("u"), (c("event_id") * 7 % 900).cast("string")).alias("url"))
    flows.to_files(flows.distinct_urls(rows), out, ckpt).awaitTermination()
    return spark.read.schema("url string").parquet(out)


@query("t03_stream_quota", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 30")
def t03(spark, sf):
    out, ckpt = fresh_folder(spark, "stream-out"), fresh_folder(spark, "stream-ckpt")
    rows = _stream(spark, sf, "documents", ["doc_id", "lang"])
    flows.quota_stream(rows, "lang", 30, [c("doc_id")], out, ckpt).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "lang")


@query("t04_stream_host_health", """WITH e AS (SELECT user_id AS host, event_id, event_type <> 'error' AS up, event_id // 400 AS n FROM events),
d AS (SELECT host, up, n - coalesce(max(CASE WHEN up THEN n END) OVER (PARTITION BY host ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS delta FROM e)
SELECT host::VARCHAR AS host, CASE WHEN NOT up THEN 'UNREACHABLE' WHEN delta > 0 THEN 'RUNNING' ELSE 'STOPPED' END AS status, count(*) AS checks,
  sum(CASE WHEN up THEN delta ELSE 0 END)::BIGINT AS gained FROM d GROUP BY 1, 2""")
def t04(spark, sf):
    out, ckpt = fresh_folder(spark, "stream-out"), fresh_folder(spark, "stream-ckpt")
    up = c("event_type") != "error"
    rows = _stream(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"]).select(
        c("user_id").cast("string").alias("host"), F.lit(1).cast("long").alias("instance_id"), c("ts").cast("timestamp").alias("ts"),
        up.alias("reachable"), F.floor(c("event_id") / 400).alias("count"), F.lit(1 << 40).alias("target"))
    with state.rocksdb(spark):
        flows.to_files(state.host_health(rows, destroy=False), out, ckpt).awaitTermination()
    done = spark.read.schema(state.HEALTH_SCHEMA).parquet(out)
    return done.groupBy("host", "status").agg(F.count(F.lit(1)).alias("checks"), F.sum("delta").alias("gained"))


@query("t04b_stream_silent_hosts", """WITH e AS (SELECT user_id::VARCHAR AS host, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next, max(ts) OVER () AS latest FROM events)
SELECT host, ts + INTERVAL 30 HOUR AS ts, 'SILENT' AS status FROM e WHERE coalesce(next, latest) - ts >= INTERVAL 30 HOUR""")
def t04b(spark, sf):
    out, ckpt = fresh_folder(spark, "stream-out"), fresh_folder(spark, "stream-ckpt")
    rows = _stream(spark, sf, "events", ["event_id", "ts", "user_id"]).select(
        c("user_id").cast("string").alias("host"), F.lit(1).cast("long").alias("instance_id"), c("ts").cast("timestamp").alias("ts"),
        F.lit(True).alias("reachable"), c("event_id").alias("count"), F.lit(1 << 40).alias("target"))
    with state.rocksdb(spark):
        flows.to_files(state.host_health(rows, destroy=False, silent_hours=30.0), out, ckpt).awaitTermination()
    done = spark.read.schema(state.HEALTH_SCHEMA).parquet(out).where("status = 'SILENT'")
    return done.select("host", c("ts").cast("timestamp_ntz").alias("ts"), "status")


@query("t06b_stream_timed_hold", """WITH g AS (SELECT user_id::VARCHAR AS session, event_id, ts, event_type <> 'error' AS ok, max(ts) OVER () AS latest FROM events),
r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY ts, event_id) AS run, lead(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS next FROM g),
h AS (SELECT session, run, min(ts) AS since, max(coalesce(next, latest)) AS until FROM r WHERE ok GROUP BY session, run)
SELECT session, min(since) + INTERVAL 1 DAY AS fired_at FROM h WHERE until - since >= INTERVAL 1 DAY GROUP BY session""")
def t06b(spark, sf):
    out, ckpt = fresh_folder(spark, "stream-out"), fresh_folder(spark, "stream-ckpt")
    rows = _stream(spark, sf, "events", ["ts", "user_id", "event_type"]).select(
        c("user_id").cast("string").alias("session"), c("ts").cast("timestamp").alias("ts"), (c("event_type") != "error").alias("ok"), F.lit(True).alias("auto"))
    with state.rocksdb(spark):
        flows.to_files(state.hold_steady_timed(rows, 86400.0), out, ckpt).awaitTermination()
    return spark.read.schema("session string, fired_at timestamp").parquet(out).select("session", c("fired_at").cast("timestamp_ntz").alias("fired_at"))


@query("t05_stream_delta", "SELECT h AS host, doc_id AS item FROM documents, (SELECT unnest(['a', 'b', 'c']) AS h) WHERE NOT (h = 'a' AND doc_id % 2 = 0)")
def t05(spark, sf):
    out, ckpt = fresh_folder(spark, "stream-out"), fresh_folder(spark, "stream-ckpt")
    rows = _stream(spark, sf, "documents", ["doc_id"]).select(F.explode(F.array("doc_id", "doc_id")).alias("item"))
    own = (c("host") == "a") & (c("item") % 2 == 0)
    flows.to_files(flows.unsent(rows, ["a", "b", "c"], "item", own=own), out, ckpt).awaitTermination()
    return spark.read.schema("item long, host string").parquet(out)


@query("t07b_stream_chunk_ledger", """SELECT doc_id % 8 AS chunk, count(*) AS rows, sum(doc_id)::BIGINT AS ids FROM labels GROUP BY 1""")
def t07b(spark, sf):
    out, ckpt = fresh_folder(spark, "stream-out"), fresh_folder(spark, "stream-ckpt")
    landed = fresh_folder(spark, "chunks")
    rows = table(spark, sf, "labels").select((c("doc_id") % 8).alias("chunk"), "doc_id")
    schema = "chunk long, doc_id long, file string"
    for k in range(3):  # the second and third landing bring back chunks that are done
        again = rows.where(c("chunk") <= (3, 5, 7)[k]).withColumn("file", F.lit(f"landing{k}"))
        again.write.mode("append").parquet(landed)
        flows.merge_results(flows.landed(spark, landed, schema), out, ckpt, "chunk", "file").awaitTermination()
    return spark.read.schema(schema).parquet(out).groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("ids"))


@query("t07_stream_merge", "SELECT doc_id, quality FROM labels")
def t07(spark, sf):
    out, ckpt = fresh_folder(spark, "stream-out"), fresh_folder(spark, "stream-ckpt")
    flows.merge_results(_stream(spark, sf, "labels", ["doc_id", "quality"]), out, ckpt).awaitTermination()
    return flows.merged_results(spark, out, "doc_id").select("doc_id", "quality")
