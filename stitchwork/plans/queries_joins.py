"""Catalog section: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stitchwork.functions import labels as L
from stitchwork.functions import text
from stitchwork.functions import colour
from stitchwork.operators import aggregates, filters, joins, keywords, nearest, repair
from stitchwork.plans import standins as S
from stitchwork.plans.queries_filters import BUCKETS_SQL
from stitchwork.plans.queries_scalars import (
    _LAB, _OK_TIER, _POS, _SEV, JUDGED, SNAP_SQL, judged, p17)
from stitchwork.plans.registry import q, query, sql_in, sql_list, sql_pick, table
from stitchwork.rules import advice as A
from stitchwork.rules import garments as G
from stitchwork.rules import photos as P

c = F.col


@query("j01_keyword_sets", f"""WITH k AS (SELECT photo_id, list_sort(list(DISTINCT lower(trim(keyword)))) AS ks FROM {S.KEYWORDS}
  WHERE keyword IS NOT NULL GROUP BY 1)
SELECT photo_id, coalesce(array_to_string(ks, '|'), '') AS keywords FROM {S.PHOTOS} LEFT JOIN k USING (photo_id)""")
def j01(spark, sf):
    sets = joins.keyword_sets(S.keyword_lists(spark, sf), "photo_id", "keyword")
    photos = joins.with_keywords(S.photos(spark, sf).select("photo_id"), sets, "photo_id")
    return photos.select("photo_id", F.array_join(F.array_sort("keywords"), "|").alias("keywords"))


@query("j02_annotations_images", f"""WITH i AS (SELECT 'img/' || printf('%05d', doc_id) || CASE WHEN doc_id % 5 = 0 THEN '_x' ELSE '' END || '.jpg' AS path, text FROM documents)
SELECT l.doc_id, l.quality, strlen(i.text) AS bytes FROM i JOIN labels l
  ON TRY_CAST(regexp_replace(regexp_replace(i.path, '^.*/', ''), '\\.[^.]*$', '') AS BIGINT) = l.doc_id""")
def j02(spark, sf):
    path = F.concat(F.lit("img/"), F.format_string("%05d", "doc_id"), F.when(c("doc_id") % 5 == 0, "_x").otherwise(""), F.lit(".jpg"))
    images = table(spark, sf, "documents").select(path.alias("path"), F.octet_length("text").alias("bytes"))
    stem = F.regexp_replace(joins.basename(c("path")), r"\.[^.]*$", "")
    keyed = images.select(stem.try_cast("bigint").alias("doc_id"), "bytes").where(c("doc_id").isNotNull())
    return keyed.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "quality", "bytes")


@query("j03_labels_files", f"""SELECT l.id, CASE WHEN d.doc_id IS NULL THEN 'image_file_missing' ELSE 'found' END AS state
  FROM {S.LABELS} l LEFT JOIN documents d ON d.doc_id = l.id""")
def j03(spark, sf):
    files = table(spark, sf, "documents").select(c("doc_id").alias("id"), F.lit(True).alias("found"))
    return S.label_rows(spark, sf).select("id").join(files, "id", "left").select(
        "id", F.when(c("found").isNull(), "image_file_missing").otherwise("found").alias("state"))


@query("j04_tasks_on_disk", f"""SELECT category, count(*) FILTER (WHERE d.doc_id IS NOT NULL)::BIGINT AS rows_to_write,
  count(*) FILTER (WHERE d.doc_id IS NULL)::BIGINT AS missing FROM {S.LABELS} l LEFT JOIN documents d ON d.doc_id = l.id GROUP BY category""")
def j04(spark, sf):
    tasks = S.label_rows(spark, sf).select("id", "category")
    disk = table(spark, sf, "documents").select(c("doc_id").alias("id"))
    have = tasks.join(disk, "id", "left_semi").select("category", F.lit(1).alias("h"))
    lack = tasks.join(disk, "id", "left_anti").select("category", F.lit(0).alias("h"))
    return have.union(lack).groupBy("category").agg(F.count_if(c("h") == 1).alias("rows_to_write"),
                                                    F.count_if(c("h") == 0).alias("missing"))


@query("j05_audit_tasks", f"""SELECT l.id, t.o_totalprice AS price FROM {S.LABELS} l JOIN orders t
  ON l.verdict = 'invalid' AND l.id = t.o_orderkey""")
def j05(spark, sf):
    audit = S.label_rows(spark, sf).where(c("verdict") == "invalid").select("id", L.filename_index(c("filename")).alias("o_orderkey"))
    return audit.where(c("o_orderkey").isNotNull()).join(table(spark, sf, "orders"), "o_orderkey").select("id", c("o_totalprice").alias("price"))


@query("j06_samples_annotations", """SELECT d.doc_id, coalesce(l.quality, CASE WHEN e.label IS NOT NULL THEN e.label % 2 END, -1)::INT AS score
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def j06(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    first = table(spark, sf, "labels").select("doc_id", "quality")
    second = table(spark, sf, "embeddings").select(c("vec_id").alias("doc_id"), (c("label") % 2).alias("second"))
    return d.join(first, "doc_id", "left").join(second, "doc_id", "left").select(
        "doc_id", F.coalesce("quality", "second", F.lit(-1)).cast("int").alias("score"))


@query("j07_nearest_anchor", SNAP_SQL)
def j07(spark, sf):
    return p17(spark, sf)


def _lab_sql(name: str, rows: str) -> str:
    """Lab of a table's id, r, g, b at four digits."""
    start = _LAB.index("WITH l AS") + len("WITH ")
    text = _LAB[start:].replace(S.COLORS, rows).replace("lab AS (", f"{name} AS (")
    for inner in ("l", "x", "f"):
        text = text.replace(f"{inner} AS (SELECT id", f"{name}_{inner} AS (SELECT id").replace(f" FROM {inner})", f" FROM {name}_{inner})")
    return text.replace("116*fy-16 AS l, 500*(fx-fy) AS a, 200*(fy-fz) AS b", "round(116*fy-16, 4) AS l, round(500*(fx-fy), 4) AS a, round(200*(fy-fz), 4) AS b")


_POINTS = "(SELECT o_orderkey AS id, o_orderkey * 11 % 256 AS r, o_custkey * 5 % 256 AS g, (o_orderkey + o_custkey) % 256 AS b FROM orders)"
_ANCHORS = "(SELECT p_partkey AS id, p_partkey * 7 % 250 AS r, p_partkey * 13 % 240 AS g, p_size * 5 % 256 AS b FROM part)"


@query("j07b_nearest_in_palette_table", f"""WITH {_lab_sql('pt', _POINTS)}, {_lab_sql('an', _ANCHORS)}
SELECT pt.id, arg_min(an.id, {{'d': (pt.l - an.l) * (pt.l - an.l) + (pt.a - an.a) * (pt.a - an.a) + (pt.b - an.b) * (pt.b - an.b), 'o': an.id}}) AS anchor
FROM pt, an GROUP BY pt.id""")
def j07b(spark, sf):
    def lab(df, id, r, g, b):
        return df.select(c(id).alias("id"), *[F.round(x, 4).alias(n) for x, n in zip(colour.rgb_to_lab(r, g, b), "lab")])
    k, u = c("o_orderkey"), c("o_custkey")
    points = lab(table(spark, sf, "orders"), "o_orderkey", k * 11 % 256, u * 5 % 256, (k + u) % 256)
    p = c("p_partkey")
    anchors = lab(table(spark, sf, "part"), "p_partkey", p * 7 % 250, p * 13 % 240, c("p_size") * 5 % 256)
    return nearest.nearest_anchor(points, anchors.withColumn("anchor", c("id")), ["l", "a", "b"], "id", "anchor").select("id", "anchor")


_RULES = [("benchmark", "eval"), ("the", "english"), ("der ", "german"), ("que", "french"), ("el ", "spanish")]


@query("j08_keyword_rules", f"""SELECT doc_id, CASE {' '.join(f"WHEN contains(lower(text), {q(k)}) THEN {q(t)}" for k, t in _RULES)} END AS rule FROM documents""")
def j08(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joins.first_matching_rule(F.lower("text"), _RULES).alias("rule"))


@query("j08b_keyword_rule_table", r"""WITH w AS (SELECT DISTINCT item_id, string_split(lower(text), ' ') AS ws FROM benchmark),
k AS (SELECT DISTINCT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS keyword FROM w),
r AS (SELECT keyword, md5(keyword) AS ord FROM k WHERE keyword <> '' UNION ALL SELECT '', 'z'),
t AS MATERIALIZED (SELECT doc_id, lower(text) AS x FROM documents),
h AS (SELECT doc_id, arg_min(keyword, ord) AS rule FROM t JOIN r ON contains(x, keyword) GROUP BY doc_id)
SELECT doc_id, rule FROM documents LEFT JOIN h USING (doc_id)""")
def j08b(spark, sf):
    ws = F.split(F.lower("text"), " ")
    pairs = F.transform(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get("ws", i + 1)))
    keyword = table(spark, sf, "benchmark").select(ws.alias("ws")).select(F.explode(F.concat("ws", pairs)).alias("keyword")).distinct()
    rules = (keyword.where(c("keyword") != "").select("keyword", F.md5(c("keyword").cast("binary")).alias("order"), c("keyword").alias("rule"))
             .unionByName(spark.createDataFrame([("", "z", "")], "keyword string, order string, rule string")))
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return keywords.first_rule(docs, rules, "doc_id", "text", target="rule").select("doc_id", "rule")


@query("j09_conditions_tasks", f"SELECT id, condition FROM {S.LABELS}, (SELECT unnest(['baseline', 'negative', 'emphatic']) AS condition) WHERE verdict = 'invalid'")
def j09(spark, sf):
    return joins.each_of(S.label_rows(spark, sf).where(c("verdict") == "invalid").select("id"), "condition", ["baseline", "negative", "emphatic"])


@query("j10_host_slices", """WITH h AS (SELECT s_suppkey, s_suppkey * 150 AS lo, s_suppkey * 150 + (s_suppkey % 7) * 60 AS hi FROM supplier)
SELECT o_orderkey, s_suppkey FROM orders JOIN h ON o_orderkey >= lo AND o_orderkey < hi""")
def j10(spark, sf):
    ranges = table(spark, sf, "supplier").select("s_suppkey", (c("s_suppkey") * 150).alias("lo"),
                                                 (c("s_suppkey") * 150 + (c("s_suppkey") % 7) * 60).alias("hi"))
    return joins.range_join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", ranges, "lo", "hi", 200).select(
        "o_orderkey", "s_suppkey")


@query("j10b_ranges_of_any_length", """WITH h AS (SELECT s_suppkey, s_suppkey * 97 - 500 AS lo,
  s_suppkey * 97 - 500 + CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 37 WHEN 3 THEN 1025 ELSE 40 END + CASE WHEN s_suppkey <= 3 THEN 1000000000 ELSE 0 END AS hi FROM supplier)
SELECT o_orderkey, s_suppkey FROM orders JOIN h ON o_orderkey >= lo AND o_orderkey < hi""")
def j10b(spark, sf):
    k, lo = c("s_suppkey"), c("s_suppkey") * 97 - 500
    length = F.element_at(F.array(*map(F.lit, (1, 0, 37, 1025, 40))), (k % 5).cast("int") + 1) + F.when(k <= 3, 1_000_000_000).otherwise(0)
    ranges = table(spark, sf, "supplier").select("s_suppkey", lo.alias("lo"), (lo + length).alias("hi"))
    return joins.dyadic_join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", ranges, "lo", "hi").select("o_orderkey", "s_suppkey")


FIT_EDITS_SQL = f"""f AS (SELECT id, filename, CASE WHEN actual_direction = 'baggy' THEN {_SEV} ELSE 0 END AS n_baggy,
  CASE WHEN actual_direction = 'tight' THEN {_SEV} ELSE 0 END AS n_tight FROM {JUDGED} WHERE ends_with(category, 'Outfit') AND actual_direction <> 'unclear' AND {_OK_TIER})"""


def fit_corrections(spark, sf):
    rows = judged(spark, sf).where(c("category").endswith("Outfit"))
    return repair.corrections(rows, "fit_miss").where(c("column") != "fit_tailored")


@query("j11_apply_corrections", f"""WITH l AS (SELECT * FROM {S.LABELS}), {FIT_EDITS_SQL}
SELECT filename, 'fit_baggy' AS "column", l.fit_baggy::VARCHAR AS old_value, n_baggy::VARCHAR AS new_value FROM l JOIN f USING (filename) WHERE l.fit_baggy <> n_baggy
UNION ALL SELECT filename, 'fit_tight', l.fit_tight::VARCHAR, n_tight::VARCHAR FROM l JOIN f USING (filename) WHERE l.fit_tight <> n_tight""")
def j11(spark, sf):
    rows = S.label_rows(spark, sf).select("id", "filename", "fit_baggy", "fit_tight")
    return joins.apply_corrections(rows, fit_corrections(spark, sf), ["fit_baggy", "fit_tight"])[1]


@query("j11b_patched_labels", f"""WITH l AS (SELECT * FROM {S.LABELS}), {FIT_EDITS_SQL}
SELECT l.id, coalesce(n_baggy, l.fit_baggy) AS fit_baggy, coalesce(n_tight, l.fit_tight) AS fit_tight FROM l LEFT JOIN f USING (filename)""")
def j11b(spark, sf):
    rows = S.label_rows(spark, sf).select("id", "filename", "fit_baggy", "fit_tight")
    return joins.apply_corrections(rows, fit_corrections(spark, sf), ["fit_baggy", "fit_tight"])[0].drop("filename")


@query("j11c_last_answer_once", f"""WITH l AS (SELECT * FROM {S.LABELS}),
r AS (SELECT id * 2 AS row, filename, fit_baggy, fit_tight FROM l UNION ALL SELECT id * 2 + 1, filename, fit_baggy, fit_tight FROM l WHERE id % 4 = 0)
SELECT row, filename, CASE WHEN row % 2 = 0 AND id % 3 <> 2 THEN CASE WHEN id % 3 = 0 THEN id % 3 ELSE 9 END ELSE r.fit_baggy END AS fit_baggy,
  CASE WHEN row % 2 = 0 AND id % 3 = 1 THEN id % 2 ELSE r.fit_tight END AS fit_tight FROM r JOIN l USING (filename)""")
def j11c(spark, sf):
    """Every file has two answers, '10' before '9' in some; files listed twice take theirs once."""
    rows = S.label_rows(spark, sf).select("id", "filename", "fit_baggy", "fit_tight")
    two = rows.select((c("id") * 2).alias("row"), "filename", "fit_baggy", "fit_tight").union(
        rows.where(c("id") % 4 == 0).select(c("id") * 2 + 1, "filename", "fit_baggy", "fit_tight"))

    def answer(place, column, value, which):
        return rows.where(which).select("filename", F.lit(place).alias("position"), F.lit(column).alias("column"),
                                        value.cast("string").alias("new_value"))
    third, first = c("id") % 3, F.lit(10)
    edits = (answer(1, "fit_baggy", first, third != 2).union(answer(1, "fit_tight", first, third != 2))
             .union(answer(2, "fit_baggy", third, third == 0)).union(answer(2, "fit_baggy", F.lit(9), third == 1))
             .union(answer(2, "fit_tight", c("id") % 2, third == 1)))
    return joins.apply_corrections(two, edits, ["fit_baggy", "fit_tight"], order=["row"], position="position")[0]


@query("j12_rollback_paths", """WITH log AS (SELECT o_orderkey AS pos, '/raw/' || o_orderstatus || '/' || (o_orderkey % 900) || '.jpg' AS file,
  '/train/' || (o_orderkey % 900) || '.jpg' AS destination FROM orders),
last AS (SELECT regexp_replace(destination, '^.*/', '') AS name, arg_max(file, pos) AS original FROM log GROUP BY 1)
SELECT name, coalesce(original, 'recovered_untracked/' || name) AS restored, original IS NOT NULL AS tracked
FROM (SELECT (p_partkey * 3) || '.jpg' AS name FROM part) LEFT JOIN last USING (name)""")
def j12(spark, sf):
    k = c("o_orderkey")
    name = F.concat((k % 900).cast("string"), F.lit(".jpg"))
    log = table(spark, sf, "orders").select(
        k.alias("pos"), F.concat(F.lit("/raw/"), c("o_orderstatus"), F.lit("/"), name).alias("file"),
        F.concat(F.lit("/train/"), name).alias("destination"))
    files = table(spark, sf, "part").select(F.concat((c("p_partkey") * 3).cast("string"), F.lit(".jpg")).alias("name"))
    return joins.rollback_paths(files, log, "pos")


_SALVAGE_SQL = f"""SELECT l.id, 'salvage_' || l.filename AS filename, j.actual_style AS facial_hair_style, ({_SEV})::BIGINT AS facial_hair_untidy
  FROM {S.LABELS} l JOIN {JUDGED} j ON j.id = l.id WHERE l.category = 'Men_Grooming' AND actual_style NOT IN ('clean_shaven', 'unclear') AND {_OK_TIER}"""


def salvaged(spark, sf):
    rows = S.label_rows(spark, sf).where(c("category") == "Men_Grooming").select("id", "filename", "facial_hair_style", "facial_hair_untidy")
    plan = repair.salvage_plan(judged(spark, sf).where(c("category") == "Men_Grooming"))
    return rows, joins.salvage_rows(rows, repair.salvage_edits(plan), ["facial_hair_style", "facial_hair_untidy"])


@query("j13_salvage_rows", _SALVAGE_SQL)
def j13(spark, sf):
    return salvaged(spark, sf)[1]


_STYLES = ["short_beard", "beard", "stubble", "full_beard", None, "moustache"]


@query("j14_paired_comparison", f"""
WITH a AS (SELECT vec_id AS id, (label * 1.5)::DOUBLE AS score, {sql_pick(_STYLES, 'vec_id')} AS upper_type, {sql_pick(_STYLES, 'vec_id * 5 + label')} AS formality FROM embeddings),
b AS (SELECT vec_id AS id, (vec_id % 10)::DOUBLE AS score, {sql_pick(_STYLES, 'vec_id + label')} AS upper_type, {sql_pick(_STYLES, 'vec_id')} AS formality FROM embeddings WHERE vec_id % 6 <> 0)
SELECT a.id, a.score - b.score AS score_delta,
  CASE WHEN contains(coalesce(a.upper_type, 'N/A'), coalesce(b.upper_type, 'N/A')) OR contains(coalesce(b.upper_type, 'N/A'), coalesce(a.upper_type, 'N/A')) THEN 'match' ELSE 'diverged' END AS upper_type_status,
  CASE WHEN coalesce(a.formality, 'N/A') = coalesce(b.formality, 'N/A') THEN 'match' ELSE 'diverged' END AS formality_status
FROM a LEFT JOIN b USING (id)""")
def j14(spark, sf):
    v = c("vec_id")
    e = table(spark, sf, "embeddings")
    ours = e.select(v.alias("id"), (c("label") * 1.5).alias("score"), text.pick(_STYLES, v).alias("upper_type"),
                    text.pick(_STYLES, v * 5 + c("label")).alias("formality"))
    theirs = e.where(v % 6 != 0).select(v.alias("id"), (v % 10).cast("double").alias("score"),
                                        text.pick(_STYLES, v + c("label")).alias("upper_type"), text.pick(_STYLES, v).alias("formality"))
    return joins.compare_predictions(ours, theirs, "id", ["upper_type"], ["formality"])


@query("j15_before_after", f"""SELECT look, round(score - lag(score) OVER w, 6) AS score_delta,
  round(coalesce(posture_score, score * 0.9) - lag(coalesce(posture_score, score * 0.9)) OVER w, 6) AS posture_delta FROM {S.LOOKS}
  WINDOW w AS (PARTITION BY session ORDER BY ts, look)""")
def j15(spark, sf):
    from stitchwork.operators.looks import look_defaults
    from stitchwork.operators.ordered import running
    rows = look_defaults(S.looks(spark, sf)).select("session", "look", "ts", "score", "posture_score")
    out = running(rows, ["session"], [c("ts"), c("look")], {"s": ("lag", c("score")), "p": ("lag", c("posture_score"))})
    return out.select("look", F.round(c("score") - c("s"), 6).alias("score_delta"),
                      F.round(c("posture_score") - c("p"), 6).alias("posture_delta"))


@query("j16_whitelist_report", """WITH t AS (SELECT k, count(*) AS n FROM (SELECT item_id * 3 AS k FROM benchmark UNION ALL SELECT item_id * 3 FROM benchmark WHERE item_id % 4 = 0 UNION ALL SELECT -1 - item_id FROM benchmark WHERE item_id < 3) GROUP BY 1)
SELECT coalesce(t.k, d.doc_id) AS doc_id, coalesce(n, 0)::BIGINT AS listed, CASE WHEN n IS NULL THEN 'not_targeted' WHEN d.doc_id IS NULL THEN 'not_in_task_list'
  WHEN n > 1 THEN 'duplicate' ELSE 'resolved' END AS status FROM t FULL JOIN documents d ON d.doc_id = t.k""")
def j16(spark, sf):
    i = c("item_id")
    b = table(spark, sf, "benchmark")
    targets = (b.select((i * 3).alias("doc_id")).union(b.where(i % 4 == 0).select(i * 3))
               .union(b.where(i < 3).select(-i - 1)))
    return filters.target_status(targets, table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("j17_known_hashes", """WITH k AS (SELECT sha256(text) AS key, doc_id FROM documents)
SELECT key, min(doc_id) AS doc_id FROM k WHERE key NOT IN (SELECT key FROM k JOIN labels USING (doc_id)) GROUP BY key""")
def j17(spark, sf):
    from stitchwork.operators.sets import novel_urls
    d = table(spark, sf, "documents").select(L.content_digest(c("text")).alias("key"), "doc_id")
    indexed = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return novel_urls(d, indexed, "key", [c("doc_id")]).select("key", "doc_id")


@query("j18_dimension_decode", """SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation, r_name AS region FROM customer
  LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def j18(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"), "left")
    return table(spark, sf, "customer").join(n, c("c_nationkey") == c("n_nationkey"), "left").select(
        "c_custkey", F.coalesce("n_name", c("c_nationkey").cast("string")).alias("nation"), c("r_name").alias("region"))
