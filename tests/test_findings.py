"""Inputs on which earlier versions went wrong, and plans that must stay bounded."""

import html

import pytest
from pyspark.sql import functions as F

from stitchwork import session
from stitchwork.functions import labels, routing, text, urls
from stitchwork.operators import joins, ordered, sets
from stitchwork.rules import garments as G
from stitchwork.rules import photos as P
from stitchwork.rules import routing as R
from stitchwork.sources import writers


def test_file_index_of_any_length(spark):
    keys = [7, 99_999, 100_000, 12_345_678, 3_000_000_000]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select(
        "k", labels.task_filename(F.col("k"), F.lit("Men_Outfit"), F.lit("average")).alias("name"))
    got = rows.select("k", labels.filename_index(F.col("name")).alias("i"), labels.filename_category(F.col("name")).alias("c"),
                      labels.filename_tier(F.col("name")).alias("t")).collect()
    assert [(r.k, r.k, "Men_Outfit", "average") for r in got] == [tuple(r) for r in got]
    assert spark.sql("SELECT '1234_Men_Outfit_average.png' AS n").select(labels.filename_index(F.col("n"))).first()[0] is None


def test_unescape_equals_the_standard(spark):
    cases = ["&#38;amp;", "a&eacute;b", "x&#61;1", "x&#x3D;1", "&copy=1", "&copy1", "&notit;", "&notin;", "&unknown;", "&", "&;", "&#;",
             "&#xZ;", "&#0;", "&#128;", "&#x80;", "&#150;", "&#55296;", "&#1114112;", "&#99999999999999;", "&#11;", "&#13;", "&#xFFFE;",
             "&#128512;", "&amp;amp;lt;", "a&ltb", "&NotEqualTilde;", "&quot&quot;", "plain?a=1&b=2", "&#x1F600", "&fjlig;", "&#1;x"]
    got = spark.createDataFrame([(i, "." + x + ".") for i, x in enumerate(cases)], "i int, u string").select(
        "i", urls.unescape_url(F.col("u")).alias("u")).collect()
    assert {cases[r.i]: r.u for r in got} == {x: html.unescape("." + x + ".") for x in cases}


def test_versions_by_time_and_dry_run(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    writers.publish(rows, root, write=True, version="9")
    writers.publish(rows.withColumn("v", F.lit("z")), root, write=True, version="10")
    assert writers.current_version(spark, root) == "10"
    diff = writers.preview(spark.createDataFrame([(1, "z"), (3, "n")], "id long, v string"), root, "id")
    assert sorted(map(tuple, diff.collect())) == [(2, "v", "z", None), (3, "v", None, "n")]


def test_last_answer_replaces_the_earlier_one(spark):
    rows = spark.createDataFrame([(1, "f", "0", "0"), (2, "f", "0", "0"), (3, "g", "5", "5")], "row int, filename string, a string, b string")
    edits = spark.createDataFrame([("f", 1, "a", "10"), ("f", 1, "b", "7"), ("f", 2, "a", "9"), ("h", 1, "a", "1")],
                                  "filename string, position int, column string, new_value string")
    patched, diff, unmatched = joins.apply_corrections(rows, edits, ["a", "b"], order=["row"], position="position")
    assert sorted(map(tuple, patched.collect())) == [(1, "f", "9", "0"), (2, "f", "0", "0"), (3, "g", "5", "5")]
    assert [tuple(r) for r in diff.collect()] == [("f", "a", "0", "9")] and [r.filename for r in unmatched.collect()] == ["h"]


def test_gates_agree_with_reasons(spark):
    values = [None, 0, 1, 223, 224, 400, 1200, 5000]
    rows = spark.createDataFrame([(s, w, h, lap) for s in (None, 0, 9) for w in values for h in values for lap in (None, 10.0, 60.0, 99.0)],
                                 "s int, w int, h int, lap double")
    args = [F.col(x) for x in ("s", "w", "h", "lap")]
    wrong = rows.where((routing.heuristic_reason(*args) == "ok") != routing.passes_heuristic(*args)).collect()
    assert not wrong


def test_draws_are_uniform_and_independent(spark):
    n = 200_000
    rows = spark.range(n).select(text.uniform("1:a", "id").alias("a"), text.uniform("1:b", "id").alias("b"), "id")
    cells = rows.groupBy(F.floor(F.col("a") * 10).alias("x"), F.floor(F.col("b") * 10).alias("y")).count().collect()
    assert len(cells) == 100 and sum((r["count"] - n / 100) ** 2 / (n / 100) for r in cells) < 160  # chi-square, 99 degrees
    assert abs(rows.agg(F.corr("a", "b")).first()[0]) < 0.01
    following = rows.alias("l").join(rows.alias("r"), F.col("l.id") + 1 == F.col("r.id"))
    assert abs(following.agg(F.corr("l.a", "r.a")).first()[0]) < 0.01
    assert rows.select("a").distinct().count() == n


def test_one_cut_serves_chained_features(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), "id")
    first = ordered.running(rows, ["k"], [F.col("id")], {"n": ("sum", F.lit(1))}, ranges=6, keep_ranges=True)
    second = ordered.running(first, ["k"], [F.col("id")], {"m": ("prior_max", F.col("n"))})
    plan = second._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan  # what follows the cut reads the cut
    assert second.where((F.col("n") > 1) & (F.col("m") != F.col("n") - 1)).count() == 0
    sizes = [r["count"] for r in ordered.with_ranges(rows, [F.col("k"), F.col("id")], rows_per_range=250).groupBy(ordered.RANGE).count().collect()]
    assert len(sizes) >= 20 and max(sizes) < 1000


def test_hot_tokens_are_salted_by_their_frequency(spark):
    docs = spark.createDataFrame([(i, ["the", f"w{i}", "the", "none"]) for i in range(300)], "d long, t array<string>")
    words = spark.createDataFrame([("the", 1), *((f"w{i}", i + 2) for i in range(300))], "token string, new_id long")
    for salt_rows in (10, 10**6):
        got = sets.remap_ids(docs, "d", F.col("t"), words, "token", "new_id", salt_rows=salt_rows).collect()
        assert all(r.ids == [1, r.d + 2, 1] for r in got) and len(got) == 300


def test_clusters_need_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_constants_by_hand():
    assert set(G.CATEGORIES) == {"Women_Outfit", "Men_Outfit", "Women_Grooming", "Men_Grooming"}
    assert G.TIERS == ["flaw_severe", "flaw_mild", "average", "polished"]
    assert G.PATTERNS == ["solid", "striped", "checked", "printed"]
    assert {k: len(v) for k, v in G.POOLS.items()} == {
        ("man", "upper"): 12, ("man", "mid"): 6, ("man", "lower"): 10, ("man", "footwear"): 8,
        ("woman", "upper"): 12, ("woman", "mid"): 6, ("woman", "lower"): 10, ("woman", "footwear"): 8}
    assert len(R.DEMOGRAPHICS) == 6 and len(R.AESTHETIC_TIERS) == 3 and set(R.STREAMS) == {"Outfit", "Face_Grooming"}
    assert "fashion" in P.FASHION_TERMS


def test_whole_audit_and_advice_cover_all_buckets_and_rows(spark, sf_dir):
    from stitchwork.operators import filters
    from stitchwork.plans import catalog
    from stitchwork.plans import standins as S
    rows = S.label_rows(spark, sf_dir)
    advised = catalog.QUERIES["q11b_score_tag_advise_all"](spark, sf_dir)
    assert advised.count() == rows.count() > catalog.QUERIES["q11_score_tag_advise"](spark, sf_dir).count()
    found = {r.bucket for r in filters.issue_buckets(rows).select("bucket").distinct().collect()}
    diff = catalog.QUERIES["q06b_audit_and_repair_all"](spark, sf_dir)
    assert {r.bucket for r in diff.select("bucket").distinct().collect()} == found and len(found) > 1


def test_routed_write_holds_no_rows_for_a_sort(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id", "CASE WHEN id % 5 = 0 THEN 'sorted' ELSE 'vlm_failed' END AS status_group",
                                          "CASE WHEN id % 5 = 0 THEN concat('s', id % 3) END AS stream", "CAST(NULL AS STRING) AS demographic", "'t' AS tier")
    key, store = "spark.sql.maxConcurrentOutputFileWriters", spark.sparkContext._jsc.sc().statusStore()
    none, quantiles = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    listed = lambda: [x for found in [store.stageList(none, False, False, quantiles, none)] for x in map(found.apply, range(found.size()))]
    seen, before = {s.stageId() for s in listed()}, spark.conf.get(key, None)
    writers.write_routed(rows, str(tmp_path / "routed"))
    assert spark.conf.get(key, None) == before
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    wrote = [s for s in listed() if s.stageId() not in seen and s.outputBytes() > 0]
    assert wrote and all(s.peakExecutionMemory() == 0 for s in wrote)
    back = spark.read.parquet(str(tmp_path / "routed")).groupBy("status_group", "stream", "demographic", "tier").count()
    assert sorted(map(tuple, back.collect())) == [("sorted", "s0", "none", "t", 1334), ("sorted", "s1", "none", "t", 1333),
                                                  ("sorted", "s2", "none", "t", 1333), ("vlm_failed", "none", "none", "t", 16_000)]
