"""Catalog section: windows, ranking, limits, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from stitchwork.functions import decode, portraits, text
from stitchwork.operators import aggregates, history, sets
from stitchwork.operators.ordered import first_per_key, first_rows, running
from stitchwork.plans import standins as S
from stitchwork.plans.queries_scalars import PHOTO_FACTS_SQL, _second, qualified_photos
from stitchwork.plans.registry import query, sql_list, sql_pick, table, sql_draw_number
from stitchwork.rules import garments as G

c = F.col


@query("w01_keep_first_dedup", f"""SELECT filename, shard, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY shard, pos) AS rn FROM {S.SHARDS}) WHERE rn = 1""")
def w01(spark, sf):
    return first_per_key(S.shard_rows(spark, sf), ["filename"], [c("shard"), c("pos")]).select("filename", "shard", "pos", "value")


@query("w02_log_dedup", f"""WITH main AS (SELECT * FROM {S.SHARDS} WHERE shard = 0), oth AS (SELECT *, row_number() OVER (PARTITION BY index ORDER BY shard, pos) AS rn FROM {S.SHARDS} WHERE shard > 0)
SELECT pos, shard, index, value FROM main UNION ALL SELECT pos, shard, index, value FROM oth WHERE index IS NULL OR (rn = 1 AND index NOT IN (SELECT index FROM main WHERE index IS NOT NULL))""")
def w02(spark, sf):
    log = S.shard_rows(spark, sf).select("pos", "shard", "index", "value")
    return sets.merge_main_and_shards(log.where(c("shard") == 0), log.where(c("shard") > 0), "index", [c("shard"), c("pos")])


@query("w03_quota_then_limit", """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 40 ORDER BY doc_id LIMIT 120""")
def w03(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sets.quota_then_limit(d, "lang", 40, [c("doc_id")], 120)


@query("w04_top_per_category", f"""WITH {PHOTO_FACTS_SQL},
r AS (SELECT photo_id, category, relevance_score, row_number() OVER (PARTITION BY category ORDER BY relevance_score DESC, photo_id) AS class_rank, min(photo_id) OVER (PARTITION BY category) AS seen FROM facts)
SELECT photo_id, category, relevance_score, class_rank::INT AS class_rank FROM r WHERE class_rank <= 25 ORDER BY relevance_score DESC, seen, class_rank LIMIT 60""")
def w04(spark, sf):
    rows = qualified_photos(spark, sf).select("photo_id", "category", "relevance_score")
    return sets.top_by_score(rows, "category", "relevance_score", [c("photo_id")], 25, 60)


def _stop_sql(target):
    return f"""WITH k AS (SELECT o_custkey AS cat, count(*) AS found, o_custkey % 6 AS existing, 4 + o_custkey % 9 AS own FROM orders GROUP BY o_custkey),
e AS (SELECT *, least(10, own) AS lim, CASE WHEN existing >= least(10, own) THEN 0 ELSE least(found, least(10, own) - existing) END AS take FROM k),
r AS (SELECT *, coalesce(sum(take) OVER (ORDER BY cat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, (SELECT sum(existing) FROM k) AS initial FROM e)
SELECT cat, lim AS effective_limit, before_ + CASE WHEN {target} <= initial THEN 0 ELSE initial END < {target} AS served,
  CASE WHEN before_ + CASE WHEN {target} <= initial THEN 0 ELSE initial END < {target} THEN take ELSE 0 END AS new_rows FROM r"""


def _stop(spark, sf, target):
    k = c("o_custkey")
    cats = table(spark, sf, "orders").groupBy(k.alias("cat")).agg(F.count(F.lit(1)).alias("found")).select(
        "cat", "found", (c("cat") % 6).alias("existing"), (c("cat") % 9 + 4).alias("own"))
    return sets.cumulative_stop(cats, [c("cat")], "found", "existing", "own", 10, target).select("cat", "effective_limit", "served", "new_rows")


@query("w05_cumulative_stop_session", _stop_sql(150))
def w05(spark, sf):
    return _stop(spark, sf, 150)


@query("w05b_cumulative_stop_total", _stop_sql(100000))
def w05b(spark, sf):
    return _stop(spark, sf, 100000)


@query("w06_runner_up", f"SELECT id, {_second('ten')}::INT AS runner_up, round(ten[{_second('ten')} + 1], 6) + 0.0 AS p FROM {S.PREDICTIONS}")
def w06(spark, sf):
    second = decode.runner_up(c("ten"))
    return S.predictions(spark, sf).select("id", second.alias("runner_up"), (F.round(F.element_at("ten", second + 1), 6) + F.lit(0.0)).alias("p"))


@query("w07_stall_report", """WITH e AS (SELECT user_id AS host, event_id, ts, event_type <> 'error' AS up, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
d AS (SELECT *, CASE WHEN up THEN n - coalesce(max(CASE WHEN up THEN n END) OVER (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS delta FROM e),
p AS (SELECT *, last_value(CASE WHEN up AND delta > 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY host ORDER BY ts, event_id) AS progress_at, last_value(CASE WHEN up AND delta > 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY host ORDER BY ts, event_id) AS progress_id FROM d),
q AS (SELECT *, first_value(ts) OVER (PARTITION BY host, progress_id ORDER BY CASE WHEN up AND delta > 0 THEN 1 ELSE 0 END, ts, event_id) AS since FROM p)
SELECT host, event_id, delta::BIGINT AS delta, progress_at, CASE WHEN up AND delta > 0 THEN NULL ELSE since END AS stalled_since,
  NOT (up AND delta > 0) AND date_diff('microsecond', since, ts) >= 43200000000 AS alert FROM q""")
def w07(spark, sf):
    return history.stall_report(history.progress_checks(spark, sf), hours=12.0).select(
        "host", "event_id", "delta", "progress_at", "stalled_since", "alert")


@query("w08_early_stopping", """WITH h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events),
b AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM h),
l AS (SELECT *, max(CASE WHEN best IS NULL OR value < best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS improved_at FROM b)
SELECT run, min(epoch) FILTER (WHERE epoch - improved_at >= 5)::BIGINT AS stop_epoch FROM l GROUP BY run""")
def w08(spark, sf):
    e = table(spark, sf, "events").select(c("user_id").alias("run"), "ts", "event_id", "value")
    return history.early_stop(e, "run", [c("ts"), c("event_id")], "value", patience=5)


@query("w09_shuffled_positions", f"SELECT id, filename, row_number() OVER (ORDER BY {sql_draw_number(7, 'id')}, id) - 1 AS position FROM {S.LABELS}")
def w09(spark, sf):
    return sets.shuffled_positions(S.label_rows(spark, sf).select("id", "filename"), "id", seed=7)


@query("w10_dense_reindex", "SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS new_id FROM (SELECT DISTINCT p_name FROM part)")
def w10(spark, sf):
    return sets.reindex(table(spark, sf, "part"), "p_name")


@query("w11_top_listing", "SELECT source, lang, count(*) AS n, max(n_chars) AS top FROM documents GROUP BY source, lang ORDER BY n DESC, source, lang LIMIT 20")
def w11(spark, sf):
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("top"))
    return n.orderBy(c("n").desc(), "source", "lang").limit(20)


@query("w12_first_n", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def w12(spark, sf):
    return first_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [(c("o_orderdate"), "asc"), (c("o_orderkey"), "asc")], 100)


@query("w12b_first_n_large", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20000")
def w12b(spark, sf):
    """More rows than one task should hold: the n-th key is found first, and filters the table."""
    order = [(c("l_shipdate"), "desc")] + [(c(k), "asc") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return first_rows(table(spark, sf, "lineitem"), order, 20_000).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("w13_session_upsert_delete", """WITH s AS (SELECT conv_id AS id, count(*) AS looks, min(turn) AS v FROM conversations GROUP BY conv_id),
u AS (SELECT id, looks + 1 AS looks, 99 AS v FROM s WHERE id % 3 = 0 UNION ALL SELECT id + 1000000000, looks, 98 FROM s WHERE id % 10 = 0)
SELECT id, looks, v FROM (SELECT * FROM s WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT * FROM u) WHERE id % 4 <> 1""")
def w13(spark, sf):
    s = table(spark, sf, "conversations").groupBy(c("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("looks"), F.min("turn").alias("v"))
    changes = s.where(c("id") % 3 == 0).select("id", (c("looks") + 1).alias("looks"), F.lit(99).cast("long").alias("v")).union(
        s.where(c("id") % 10 == 0).select(c("id") + 1000000000, "looks", F.lit(98).cast("long")))
    merged = sets.upsert(s, changes, "id")
    return sets.delete(merged, merged.where(c("id") % 4 == 1), "id")


@query("w14_log_tail", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def w14(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "event_type").orderBy(c("ts").desc(), c("event_id").desc()).limit(50)


@query("t06_hold_steady", """WITH g AS (SELECT user_id AS session, event_id, ts, event_type <> 'error' AS ok FROM events),
r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY ts, event_id) AS run FROM g),
h AS (SELECT *, min(ts) OVER (PARTITION BY session, run) AS since FROM r WHERE ok)
SELECT session, min(ts) AS fired_at FROM h WHERE date_diff('microsecond', since, ts) >= 86400000000 GROUP BY session""")
def t06(spark, sf):
    e = table(spark, sf, "events").select(c("user_id").alias("session"), "event_id", "ts", (c("event_type") != "error").alias("ok"))
    return history.hold_steady(e, "session", "ts", [c("ts"), c("event_id")], c("ok"), seconds=86400.0)
