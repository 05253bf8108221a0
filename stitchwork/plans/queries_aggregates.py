"""Catalog section: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stitchwork.functions import advice, decode, portraits, text
from stitchwork.operators import aggregates as AG
from stitchwork.operators import joins
from stitchwork.operators.filters import keep
from stitchwork.plans import standins as S
from stitchwork.plans.queries_filters import LOG_SQL, status_log
from stitchwork.plans.queries_scalars import (
    _CALIBRATED, _DEMOGRAPHIC, _REVIEW_BASE, _STREAM_SORTER, _TIER_SORTER, _attrs, _top, _words_sql, DESCRIPTION_SQL)
from stitchwork.plans.registry import q, query, sql_list, sql_pick, table
from stitchwork.functions import routing
from stitchwork.rules import advice as A
from stitchwork.rules import garments as G
from stitchwork.rules import routing as R

c = F.col

_DIMS = {"stream": R.STREAMS, "demographic": R.DEMOGRAPHICS, "tier": R.AESTHETIC_TIERS}


def routed(spark, sf):
    gates = routing.passes_heuristic(c("size"), c("width"), c("height"), c("laplacian"))
    sorted_rows = S.annotations(spark, sf).where(gates & c("judged") & c("is_look"))
    return sorted_rows.select(
        "id", routing.resolve_stream(c("focus"), c("shot"), c("path")).alias("stream"),
        routing.resolve_demographic(c("gender"), c("age")).alias("demographic"),
        routing.resolve_tier(c("tier_text"), c("overall")).alias("tier"))


ROUTED_SQL = f"(SELECT id, {_STREAM_SORTER} AS stream, {_DEMOGRAPHIC} AS demographic, {_TIER_SORTER} AS tier FROM {LOG_SQL} WHERE status = 'sorted')"


@query("a01_distribution_grid", f"""
WITH g AS (SELECT stream, demographic, tier FROM (SELECT unnest({sql_list(R.STREAMS)}) AS stream), (SELECT unnest({sql_list(R.DEMOGRAPHICS)}) AS demographic), (SELECT unnest({sql_list(R.AESTHETIC_TIERS)}) AS tier)),
n AS (SELECT g.*, count(r.id) AS n FROM g LEFT JOIN {ROUTED_SQL} r USING (stream, demographic, tier) GROUP BY ALL)
SELECT coalesce(stream, 'ALL') AS stream, coalesce(demographic, 'ALL') AS demographic, coalesce(tier, 'ALL') AS tier, sum(n)::BIGINT AS n
FROM n GROUP BY GROUPING SETS ((stream, demographic, tier), (stream), ())""")
def a01(spark, sf):
    return AG.with_subtotals(AG.grid_counts(routed(spark, sf), _DIMS), list(_DIMS))


@query("a02_status_summary", f"""SELECT count(*) FILTER (WHERE status = 'sorted') AS qualified, count(*) FILTER (WHERE status = 'rejected_not_human') AS not_human,
  count(*) FILTER (WHERE starts_with(status, 'rejected_heuristic')) AS heuristic, count(*) FILTER (WHERE status = 'rejected_vlm_failed') AS judge_failed,
  count(*) FILTER (WHERE status = 'rejected_routing_failed') AS routing_failed FROM {LOG_SQL}""")
def a02(spark, sf):
    return AG.status_summary(status_log(spark, sf))


@query("a02b_status_histogram", f"SELECT status, count(*) AS n FROM {LOG_SQL} GROUP BY status")
def a02b(spark, sf):
    return AG.status_histogram(status_log(spark, sf))


_COVER = ["upper_pattern", "facial_hair_style", "makeup_style", "fabric_wrinkled"]


@query("a03_class_coverage", f"""SELECT category, field, value, count(*) AS n, count(*) < 250 AS thin FROM (
  {' UNION ALL '.join(f"SELECT category, '{f}' AS field, {f}::VARCHAR AS value FROM {S.LABELS}" for f in _COVER)}) WHERE value IS NOT NULL GROUP BY ALL""")
def a03(spark, sf):
    return AG.class_coverage(S.label_rows(spark, sf), _COVER)


@query("a03b_coverage_gate", f"""WITH v AS (SELECT count(*) < 250 AS thin FROM (
  {' UNION ALL '.join(f"SELECT category, '{f}' AS field, {f}::VARCHAR AS value FROM {S.LABELS}" for f in _COVER)}) WHERE value IS NOT NULL GROUP BY category, field, value)
SELECT count(*) AS classes, count(*) FILTER (WHERE thin) AS thin_classes, NOT bool_or(thin) AS clear FROM v""")
def a03b(spark, sf):
    return AG.coverage_gate(AG.class_coverage(S.label_rows(spark, sf), _COVER))


@query("a04_qa_pass_rate", """WITH n AS (SELECT count(*) AS total, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE quality = 1) AS passed FROM documents LEFT JOIN labels l USING (doc_id))
SELECT total, missing, passed, total - missing AS scored, passed / (total - missing) AS pass_rate, passed / (total - missing) < 0.85 AS warn FROM n""")
def a04(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return AG.qa_rates(d, F.coalesce(c("quality") == 1, F.lit(False)), c("quality").isNull())


@query("a05_binding_rates", f"""WITH b AS (SELECT CASE WHEN id % 9 <> 0 THEN (id % 4 <> 0)::INT END AS u, CASE WHEN coalesce(lower, '') NOT IN ('', 'none') THEN (id % 3 <> 0)::INT END AS l FROM {S.COLORS}),
n AS (SELECT sum(u) AS us, count(u) AS un, sum(l) AS ls, count(l) AS ln FROM b)
SELECT us / un AS upper_rate, ls / ln AS lower_rate, (us + ls) / (un + ln) AS combined_rate, CASE WHEN (us + ls) / (un + ln) >= 0.70 THEN 'PASS' ELSE 'FAIL' END AS gate FROM n""")
def a05(spark, sf):
    i = c("id")
    rows = S.colors(spark, sf).select(F.when(i % 9 != 0, (i % 4 != 0).cast("int")).alias("color_match_upper"),
                                      (i % 3 != 0).cast("int").alias("color_match_lower"), c("lower").alias("requested_lower_color"))
    return AG.binding_rates(rows)


@query("a06_audit_summary", f"""WITH n AS (SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'valid') AS valid, count(*) FILTER (WHERE verdict = 'invalid') AS invalid,
  count(*) FILTER (WHERE verdict = 'error') AS errors, count(*) FILTER (WHERE id % 3 = 0) AS body_type_match_failed, count(*) FILTER (WHERE id % 5 = 0) AS face_match_failed,
  count(*) FILTER (WHERE id % 7 = 0 AND id % 2 = 0) AS attribute_match_failed, count(*) FILTER (WHERE cust % 50 = 0) AS severe_anatomy_defect_failed FROM {S.LABELS})
SELECT *, round(valid * 100.0 / total, 6)::DOUBLE AS valid_pct, round(invalid * 100.0 / total, 6)::DOUBLE AS invalid_pct, round(errors * 100.0 / total, 6)::DOUBLE AS error_pct,
  round_even((1 - valid::DOUBLE / total) * 28000, 0)::BIGINT AS projected_invalid FROM n""")
def a06(spark, sf):
    i = c("id")
    v = S.label_rows(spark, sf).select("verdict", (i % 3 != 0).alias("body_type_match"), (i % 5 != 0).alias("face_match"),
                                       F.when(i % 2 == 0, i % 7 != 0).alias("attribute_match"), (c("cust") % 50 == 0).alias("severe_anatomy_defect"))
    out = AG.audit_summary(v, 28000)
    return out.withColumns({n: F.round(n, 6) for n in ("valid_pct", "invalid_pct", "error_pct")})


@query("a07_evaluation", f"""SELECT count(*) FILTER (WHERE mask > 0) AS n, round(avg(abs(score - score_true)) FILTER (WHERE mask > 0), 6) AS score_mae,
  round(sqrt(avg((score - score_true) * (score - score_true)) FILTER (WHERE mask > 0)), 6) AS score_rmse FROM {S.PREDICTIONS}""")
def a07(spark, sf):
    out = AG.score_errors(S.predictions(spark, sf), c("score"), c("score_true"), c("mask"))
    return out.withColumns({n: F.round(n, 6) for n in ("score_mae", "score_rmse")})


@query("a07b_head_accuracy", f"""SELECT round(avg(CASE WHEN mask > 0 THEN ({_top('ten')} = label)::INT END), 6) AS ten,
  round(avg(CASE WHEN mask > 0 THEN ({_top('style')} = label % 5)::INT END), 6) AS style, NULL::DOUBLE AS idle FROM {S.PREDICTIONS}""")
def a07b(spark, sf):
    heads = {"ten": (decode.argmax(c("ten")), c("label"), c("mask")),
             "style": (decode.argmax(c("style")), c("label") % 5, c("mask")),
             "idle": (decode.argmax(c("style")), c("label"), F.lit(0.0))}
    return AG.head_accuracy(S.predictions(spark, sf), heads).select(*[F.round(h, 6).alias(h) for h in heads])


_CE = "ln(list_sum(list_transform({a}, lambda x: exp(x - list_max({a}))))) + list_max({a}) - {a}[{t} + 1]"


@query("a08_masked_loss", f"""
WITH r AS (SELECT mask, CASE WHEN abs(score - score_true) < 1 THEN 0.5 * (score - score_true) ** 2 ELSE abs(score - score_true) - 0.5 END
    * CASE WHEN score_true < 5.0 OR score_true > 8.5 THEN 2.5 ELSE 1.0 END AS s,
  {_CE.format(a='ten', t='label')} AS t, {_CE.format(a='style', t='(label % 5)')} AS y FROM {S.PREDICTIONS}),
h AS (SELECT sum(s)::DOUBLE / count(*) AS score, sum(t * mask) / greatest(sum(mask), 1.0) AS ten, sum(y * mask) / greatest(sum(mask), 1.0) AS style FROM r)
SELECT round(score, 6) AS score, round(ten, 6) AS ten, round(style, 6) AS style, round(score + 0.3 * ten + 0.5 * style, 6) AS total_loss FROM h""")
def a08(spark, sf):
    raw = decode.smooth_l1(c("score"), c("score_true")) * decode.boundary_weight(c("score_true"), 2.5)
    heads = {"score": (raw, F.lit(1.0), 1.0), "ten": (decode.cross_entropy(c("ten"), c("label")), c("mask"), 0.3),
             "style": (decode.cross_entropy(c("style"), c("label") % 5), c("mask"), 0.5)}
    out = AG.masked_loss(S.predictions(spark, sf), heads)
    return out.select(*[F.round(n, 6).alias(n) for n in out.columns])


@query("a09_calibration_by_tier", f"""SELECT true_tier, round(avg(score), 6) AS mean_predicted, count(*) AS n,
  {'CASE true_tier ' + ' '.join(f"WHEN '{t}' THEN {lo}" for t, (lo, _) in G.SCORE_BANDS.items()) + ' END'}::DOUBLE AS band_low,
  {'CASE true_tier ' + ' '.join(f"WHEN '{t}' THEN {hi}" for t, (_, hi) in G.SCORE_BANDS.items()) + ' END'}::DOUBLE AS band_high FROM {S.PREDICTIONS} GROUP BY true_tier""")
def a09(spark, sf):
    return AG.calibration_by_tier(S.predictions(spark, sf), "true_tier", "score").withColumn("mean_predicted", F.round("mean_predicted", 6))


_RECALL_SQL = f"""
p AS (SELECT label AS t, {_top('ten')}::BIGINT AS p FROM {S.PREDICTIONS}),
r AS (SELECT t AS class, count(*) AS n_true, (SELECT count(*) FROM p b WHERE b.p = a.t) AS n_predicted, count(*) FILTER (WHERE a.p = a.t) AS n_hit FROM p a GROUP BY t),
x AS (SELECT *, n_hit / n_true AS recall, n_predicted = 0 AS collapsed, n_predicted > 0 AND n_hit / n_true < 0.5 AS weak FROM r)"""


@query("a10_class_recall", f"WITH {_RECALL_SQL} SELECT * FROM x")
def a10(spark, sf):
    return AG.class_recall(S.predictions(spark, sf), c("label"), decode.argmax(c("ten")).cast("long"))


@query("a10b_worst_class", f"WITH {_RECALL_SQL} SELECT arg_min(class, {{r: recall, c: class}}) AS class, min(recall) AS recall FROM x WHERE weak")
def a10b(spark, sf):
    return AG.worst_class(a10(spark, sf))


@query("a11_class_allocation", f"""SELECT category, count(*) AS available, least(count(*), 50)::BIGINT AS allocated FROM ({DESCRIPTION_SQL}) WHERE category IS NOT NULL GROUP BY category""")
def a11(spark, sf):
    rows = portraits.classify_descriptions(S.photos(spark, sf).select("description"), "description")
    return AG.allocation(keep(rows, c("category").isNotNull()), "category", 50)


@query("a12_prefix_counts", f"""WITH k AS (SELECT string_split(CASE WHEN o_orderkey % 9 = 0 THEN 'solo' ELSE {sql_pick(['men_u35_suit', 'women_o50_chic', 'face_men_u35', 'posture_check'], 'o_orderkey')} END, '_') AS p FROM orders)
SELECT p[1] || '_' || coalesce(p[2], '') AS prefix, count(*) AS n FROM k GROUP BY 1""")
def a12(spark, sf):
    k = c("o_orderkey")
    rows = table(spark, sf, "orders").select(F.when(k % 9 == 0, "solo").otherwise(
        text.pick(["men_u35_suit", "women_o50_chic", "face_men_u35", "posture_check"], k)).alias("category"))
    return AG.prefix_counts(rows, "category")


@query("a13_session_stats", f"""SELECT session, count(*) AS looks, round(avg(score), 6) AS average_score, arg_max(look, {{s: score, t: -epoch_us(ts), k: -look}}) AS best_look, max(score) AS best_score,
  arg_min(look, {{t: ts, k: look}}) AS first_look, arg_min(score, {{t: ts, k: look}}) AS first_score, arg_max(look, {{t: ts, k: look}}) AS latest_look, arg_max(score, {{t: ts, k: look}}) AS latest_score
  FROM {S.LOOKS} GROUP BY session""")
def a13(spark, sf):
    out = AG.session_stats(S.looks(spark, sf), "session", c("score"), [c("ts"), c("look")], c("look"))
    return out.withColumn("average_score", F.round("average_score", 6))


@query("a14_sequence_stats", f"""WITH n AS (SELECT {_words_sql('text')} AS n, role FROM conversations),
k AS (SELECT least(n + 12, 512) AS len, CASE WHEN role = 'assistant' THEN least(n + 12, 512) - 12 ELSE 0 END AS sup FROM n)
SELECT count(*) AS examples, min(len) AS min_len, max(len) AS max_len, round(avg(len), 6) AS avg_len, min(sup) AS min_supervised, max(sup) AS max_supervised, round(avg(sup), 6) AS avg_supervised,
  count(*) FILTER (WHERE len >= 512) AS truncated, count(*) FILTER (WHERE sup = 0) AS zero_supervised FROM k""")
def a14(spark, sf):
    length = F.least(text.word_count("text") + 12, F.lit(A.MAX_SEQUENCE)).cast("long")
    rows = table(spark, sf, "conversations").select(length.alias("len"), "role")
    sup = F.when(c("role") == "assistant", c("len") - 12).otherwise(0)
    out = AG.sequence_stats(rows, c("len"), sup, A.MAX_SEQUENCE)
    return out.withColumns({"avg_len": F.round("avg_len", 6), "avg_supervised": F.round("avg_supervised", 6)})


VOCAB_SQL = f"""(SELECT DISTINCT unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS token FROM conversations WHERE (conv_id * 8 + turn) % 5 <> 0
  UNION SELECT unnest({sql_list(advice.vocabulary_floor())}))"""


def retained_vocabulary(spark, sf):
    kept = table(spark, sf, "conversations").where((c("conv_id") * 8 + c("turn")) % 5 != 0)
    return AG.vocabulary(kept, c("text"), advice.vocabulary_floor())


@query("a15_retained_vocabulary", f"SELECT token, row_number() OVER (ORDER BY token) - 1 AS new_id FROM {VOCAB_SQL}")
def a15(spark, sf):
    from stitchwork.operators.sets import reindex
    return reindex(retained_vocabulary(spark, sf), "token")


@query("a16_progress_by_slice", f"""WITH t AS (SELECT CASE {' '.join(f"WHEN o_orderkey >= {a} AND o_orderkey < {b} THEN '{n}'" for n, a, b in G.HOST_SLICES)} END AS host, o_orderstatus = 'F' AS done FROM orders)
SELECT host, count(*) AS target, count(*) FILTER (WHERE done) AS done, count(*) FILTER (WHERE NOT done) AS remaining, round(count(*) FILTER (WHERE done) * 100.0 / count(*), 6)::DOUBLE AS pct FROM t WHERE host IS NOT NULL GROUP BY host""")
def a16(spark, sf):
    rows = table(spark, sf, "orders").select(joins.slice_of(c("o_orderkey"), G.HOST_SLICES).alias("host"), (c("o_orderstatus") == "F").alias("done"))
    return AG.progress(rows, "host", c("done")).withColumn("pct", F.round("pct", 6))


@query("a17_matched_labels", "SELECT count(*) AS samples, count(l.quality) AS score_matched, count(*) FILTER (WHERE l.quality = 1 OR l.toxic = 1) AS any_attribute FROM documents LEFT JOIN labels l USING (doc_id)")
def a17(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.agg(F.count(F.lit(1)).alias("samples"), F.count("quality").alias("score_matched"),
                 F.count_if((c("quality") == 1) | (c("toxic") == 1)).alias("any_attribute"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"]


@query("a18_counts_with_zeros", f"""SELECT s AS status, p AS priority, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s), (SELECT unnest({sql_list(_PRIORITIES)}) AS p)
  LEFT JOIN orders ON o_orderstatus = s AND o_orderpriority = p GROUP BY ALL""")
def a18(spark, sf):
    o = table(spark, sf, "orders").select(c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority"))
    return AG.grid_counts(o, {"status": ["F", "O", "P", "X"], "priority": _PRIORITIES})


@query("a19_duplicate_report", f"""WITH r AS (SELECT filename, shard, row_number() OVER w AS rn, first_value(shard) OVER w AS kept FROM {S.SHARDS} WINDOW w AS (PARTITION BY filename ORDER BY shard, pos))
SELECT filename, kept, shard AS dropped FROM r WHERE rn > 1""")
def a19(spark, sf):
    return AG.duplicate_report(S.shard_rows(spark, sf), "filename", "shard", [c("shard"), c("pos")])


@query("a20_review_counters", _REVIEW_BASE + """, v AS (SELECT NOT (short OR long OR chatter OR banned OR unobs OR bare > 0 OR n < 2 OR n > 5 OR long_lines > 0 OR adaptive) AS p, NOT verb AS w FROM c)
SELECT count(*) AS total, count(*) FILTER (WHERE p) AS passed, count(*) FILTER (WHERE p AND w) AS warned, count(*) FILTER (WHERE NOT p) AS hard_failed,
  count(*) FILTER (WHERE NOT p) / count(*) > 0.10 AS alert FROM v""")
def a20(spark, sf):
    rows = advice.review(S.advice(spark, sf).select("text", "score"), c("text"), c("score"))
    return AG.review_counters(rows, c("passed"), F.array_contains("reasons", A.NO_VERB_WARNING))


@query("a21_event_sets", "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def a21(spark, sf):
    sets = joins.keyword_sets(table(spark, sf, "events"), "user_id", "event_type")
    return sets.select("user_id", F.array_join(F.array_sort("keywords"), "|").alias("kinds"))


@query("a22_population_depletion", """SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 0 OR toxic = 1) AS wrong, count(*) FILTER (WHERE quality = 0 OR toxic = 1) / count(*) AS wrong_share,
  CASE WHEN count(*) FILTER (WHERE quality = 0 OR toxic = 1) = 0 THEN 'keep' WHEN count(*) FILTER (WHERE quality = 0 OR toxic = 1) / count(*) >= 0.4 THEN 'regenerate' ELSE 'relabel' END AS action
  FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def a22(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return AG.depletion(rows, "source", (c("quality") == 0) | (c("toxic") == 1), 0.4)


@query("a23_failure_disposition", f"""SELECT CASE WHEN cust % 50 = 0 THEN 'defect' WHEN id % 5 = 0 THEN 'identity_only' WHEN facial_hair_style = 'clean_shaven' THEN 'salvage'
  WHEN upper_pattern IS NOT NULL THEN 'relabel' ELSE 'residual' END AS bucket, count(*) AS n FROM {S.LABELS} WHERE verdict = 'invalid' GROUP BY 1""")
def a23(spark, sf):
    rows = S.label_rows(spark, sf).where(c("verdict") == "invalid")
    return AG.disposition(rows, c("id") % 5 == 0, c("facial_hair_style") == "clean_shaven", c("upper_pattern").isNotNull(), c("cust") % 50 == 0)


@query("a24_best_epoch", """SELECT user_id, min(value) AS best_value, arg_min(epoch, {v: value, e: epoch}) AS best_epoch, max(epoch) AS epochs
  FROM (SELECT user_id, value, event_id AS epoch FROM events) GROUP BY user_id""")
def a24(spark, sf):
    return AG.best_epoch(table(spark, sf, "events").select("user_id", "value", c("event_id").alias("epoch")), "user_id", "value", "epoch")


@query("a25_balance_shares", f"SELECT category, tier, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM {S.LABELS} GROUP BY category, tier")
def a25(spark, sf):
    return AG.shares(S.label_rows(spark, sf), ["category", "tier"]).withColumn("pct", F.round("pct", 6))


_IMPACTS = [0.6, 0.5, 0.4, 0.5, 0.3, 0.7]


@query("a26_potential_score", f"""WITH i AS (SELECT look, score, list_transform(range(0, look % 8), lambda x: ({sql_list(_IMPACTS)})[((look + x) % 6) + 1]) AS imp FROM {S.LOOKS})
SELECT look, round(least(9.8, score + coalesce(list_sum(imp[1:5])::DOUBLE, 0.0)), 6) AS potential FROM i""")
def a26(spark, sf):
    from stitchwork.operators.looks import potential
    n = (c("look") % 8).cast("int")
    sugg = F.transform(F.slice(F.sequence(F.lit(0), F.lit(7)), F.lit(1), n), lambda x: F.struct(
        text.pick(_IMPACTS, c("look") + x).alias("impact")))
    return S.looks(spark, sf).select("look", F.round(potential(c("score"), sugg), 6).alias("potential"))


@query("a27_thin_sources", "SELECT source, lang, count(*) AS found, count(*) < 10 AS near_exhausted FROM documents GROUP BY source, lang")
def a27(spark, sf):
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("found"))
    return n.withColumn("near_exhausted", c("found") < 10)


@query("a28_first_comparable_session", f"SELECT session, looks FROM (SELECT session, count(*) AS looks, min(ts) AS started FROM {S.LOOKS} GROUP BY session) WHERE looks >= 2 ORDER BY started DESC, session LIMIT 1")
def a28(spark, sf):
    s = S.looks(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("looks"), F.min("ts").alias("started"))
    return s.where(c("looks") >= 2).orderBy(c("started").desc(), "session").limit(1).select("session", "looks")
