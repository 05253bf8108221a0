"""Joins against tables of anchors, rules and ranges, and the shard ledger, against plain versions."""

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from stitchwork.operators import joins, keywords, nearest
from stitchwork.plans import catalog
from stitchwork.sources import readers


def _plain_nearest(point, anchors):
    if any(x is None or math.isnan(x) for x in point):
        return None
    usable = [(sum((x - y) ** 2 for x, y in zip(point, a[1:4])), a[0], a[4]) for a in anchors
              if all(y is not None and not math.isnan(y) for y in a[1:4])]
    return min(usable)[2] if usable else None


@pytest.mark.parametrize("shape", ["spread", "clusters", "line", "one", "none"])
def test_nearest_anchor(spark, shape):
    r = random.Random(shape)
    draw = {"spread": lambda: [round(r.uniform(-50, 50), 1) for _ in range(3)],
            "clusters": lambda: [r.choice((0.0, 1_000.0)) + r.randrange(4) for _ in range(3)],
            "line": lambda: [float(r.randrange(300)), 5.0, 5.0], "one": lambda: [3.0, 4.0, 5.0], "none": lambda: [math.nan, 1.0, 1.0]}[shape]
    anchors = [(i, *draw(), f"a{i}") for i in range(200)] + [(900, None, 1.0, 1.0, "null"), (901, math.nan, 1.0, 1.0, "nan")]
    points = [draw() for _ in range(100)] + [[r.uniform(-2_000, 3_000) for _ in range(3)] for _ in range(60)] + [[0.5, 0.5, 0.5]] * 80
    points += [list(a[1:4]) for a in anchors[:20]] + [[None, 1.0, 1.0], [math.nan, 1.0, 2.0]]
    # Each anchor has a twin of a later order at its place: the first must win.
    twins = [(i + 1_000, *a[1:4], f"twin{i}") for i, a in enumerate(anchors)]
    r.shuffle(twins)
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "id int, x double, y double, z double")
    a = spark.createDataFrame(anchors + twins, "ord int, x double, y double, z double, name string")
    got = {row["id"]: row["name"] for row in nearest.nearest_anchor(p.repartition(5), a.repartition(3), ["x", "y", "z"], "ord", "name").collect()}
    assert got == {i: _plain_nearest(x, anchors + twins) for i, x in enumerate(points)}


@pytest.mark.parametrize("most", [0, 100_000])
@pytest.mark.parametrize("vocabulary", [None, ["a", "b c", "it's"]])
def test_keyword_lists_equal_rows(spark, monkeypatch, most, vocabulary):
    monkeypatch.setattr(joins, "MOST_BROADCAST", most)
    r = random.Random(5)
    draw = lambda n: [r.choice([" A", "a", "b c ", "B c", "", "it's", "É", None, "w1", "w2"]) for _ in range(n)]
    lists = [(i, draw(r.randrange(9))) for i in range(40)] + [(7, draw(5)) for _ in range(60)] + [(None, draw(4)), (None, draw(4)), (90, None), (91, [None]), (92, [])]
    df = spark.createDataFrame(lists, "id int, k array<string>").repartition(4)
    rows = df.select("id", F.explode("k").alias("k"))
    found = [sorted(((x["id"], sorted(x["keywords"])) for x in joins.keyword_sets(t, "id", "k", vocabulary).collect()), key=str) for t in (df, rows)]
    assert found[0] == found[1] and len(found[0]) > 20
    single = df.where("id > 7 AND id < 40")
    assert {x["id"] for x in joins.keyword_sets(single, "id", "k").collect()} == {i for i, k in lists[8:40] if any(w is not None for w in k)}


def test_keyword_lists_are_not_shuffled_as_rows(spark, sf_dir):
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    listed = lambda: [x for found in [store.stageList(none, False, False, quantiles, none)] for x in map(found.apply, range(found.size()))]
    seen = {s.stageId() for s in listed()}
    photos = len(catalog.QUERIES["j01_keyword_sets"](spark, sf_dir).collect())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert sum(s.shuffleWriteRecords() for s in listed() if s.stageId() not in seen) <= 4 * photos


def test_coordinates_are_calculated_once_a_row(spark, monkeypatch):
    plans, settle = [], nearest.settle
    monkeypatch.setattr(nearest, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    rows = spark.range(60).selectExpr("cast(id AS int) AS id", "cbrt(id) AS x", "cbrt(id + 1) AS y")
    got = nearest.nearest_anchor(rows, rows.where("id % 10 = 0").withColumn("name", F.col("id")), ["x", "y"], "id", "name")
    assert sum(r["name"] == r["id"] for r in got.collect()) == 6
    assert any("CBRT" in p for p in plans) and not any("Filter" in line and "CBRT" in line for p in plans for line in p.splitlines())


def test_nearest_of_empty_tables(spark):
    schema = "id int, x double, y double"
    some, none = spark.createDataFrame([(1, 1.0, 2.0)], schema), spark.createDataFrame([], schema)
    anchor = some.withColumn("name", F.lit("a"))
    assert nearest.nearest_anchor(some, anchor.where("id > 5"), ["x", "y"], "id", "name").collect()[0]["name"] is None
    assert nearest.nearest_anchor(none, anchor, ["x", "y"], "id", "name").count() == 0


@pytest.mark.parametrize("most", [0, 100_000])
def test_first_rule(spark, monkeypatch, most):
    monkeypatch.setattr(keywords, "MOST_BROADCAST", most)
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcé😀 ") for _ in range(n))
    rules = [(i, word(r.choice((1, 2, 3, 4, 6, 9))), f"t{i}") for i in range(400)] + [(3, None, "never"), (5, "ab", "z"), (5, "ab", "a")]
    texts = [(i % 37 if i % 9 else None, word(r.choice((0, 1, 2, 5, 40)))) for i in range(150)] + [(1, None), (None, None), (2, ""), (2, "ab"), (2, "ab")]

    def plain(text, usable):
        hits = [(o, t) for o, k, t in usable if text is not None and k is not None and k in text]
        return min(hits)[1] if hits else None
    df = spark.createDataFrame(texts, "id int, text string").repartition(4)
    for usable in (rules, rules + [(99, "", "empty")], [(1, "", "only")], [(1, None, "x")]):
        table = spark.createDataFrame(usable, "order int, keyword string, target string")
        got = sorted(((x["id"], x["text"], x["target"]) for x in keywords.first_rule(df, table, "id", "text").collect()), key=str)
        assert got == sorted(((i, t, plain(t, usable)) for i, t in texts), key=str)
    assert keywords.first_rule(df, spark.createDataFrame([], "order int, keyword string, target string"), "id", "text").where("target IS NOT NULL").count() == 0
    assert keywords.first_rule(df.where("false"), table, "id", "text").count() == 0


def test_rules_meet_texts_by_equality_only(spark):
    table = spark.createDataFrame([(i, f"word{i}", "t") for i in range(50)], "order int, keyword string, target string")
    df = spark.createDataFrame([(1, "a word7 here")], "id int, text string")
    plan = keywords.first_rule(df, table, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_of_a_small_table_are_not_gathered(spark):
    table = spark.createDataFrame([(i, f"w{i % 90}", f"t{i}") for i in range(200)], "order int, keyword string, target string")
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 90, 90))) for i in range(300)], "id int, text string")
    found = keywords.first_rule(df, table, "id", "text")
    plan = found.select("id", "target")._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "Python" not in plan and not any("Exchange hash" in x and "_g#" in x for x in plan.splitlines())
    # "w1" is also in "w10" to "w19".
    assert {r["id"]: r["target"] for r in found.collect()} == {
        i: f"t{min(k for k in range(90) if any(str(w).startswith(str(k)) for w in range(i % 90, 90)))}" for i in range(300)}


def test_rules_beyond_the_first_and_texts_with_other_bytes(spark, monkeypatch):
    monkeypatch.setattr(keywords, "TRIED_FIRST", 64)
    rules = [(i, f"zz{i:03d}", f"t{i}") for i in range(150)] + [(200, "é😀", "wide")]
    table = spark.createDataFrame(rules, "order int, keyword string, target string")
    df = spark.sql("""SELECT 1 AS id, CAST(X'41FFAB' AS STRING) AS text UNION ALL SELECT 2, CAST(concat(X'E282', encode('zz149', 'UTF-8'), X'FF') AS STRING)
        UNION ALL SELECT 3, 'xzz148zz149' UNION ALL SELECT 4, 'aé😀' UNION ALL SELECT 5, 'zz' UNION ALL SELECT 6, 'zz099 zz070'""")
    got = {r["id"]: r["target"] for r in keywords.first_rule(df, table, "id", "text").collect()}
    assert got == {1: None, 2: "t149", 3: "t148", 4: "wide", 5: None, 6: "t70"}


def test_dyadic_join(spark):
    r = random.Random(8)
    ranges = [(i, s := r.randrange(-1_000, 1_000), s + r.choice((-3, 0, 1, 2, 7, 64, 1_000, 10**9, 2**40))) for i in range(120)]
    ranges += [(900, -2**40, 2**40), (901, None, 5), (902, 5, None), (903, 7, 8)]
    points = [r.randrange(-1_200, 2_500) for _ in range(200)] + [2**39, -2**39, 7, 7, None]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "id int, at long")
    q = spark.createDataFrame(ranges, "rid int, lo long, hi long")
    got = sorted((x["id"], x["rid"]) for x in joins.dyadic_join(p, "at", q, "lo", "hi").collect())
    assert got == sorted((i, k) for i, x in enumerate(points) for k, s, e in ranges if None not in (x, s, e) and s <= x < e)
    assert joins.dyadic_join(p, "at", q.where("rid = 901"), "lo", "hi").count() == 0


def test_shard_ledger(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "id long, image struct<bytes:binary,path:string>"
    rows = spark.range(40).select("id", F.struct(F.when(F.col("id") % 4 != 0, F.lit("x" * 900).cast("binary")).alias("bytes"), F.lit("p").alias("path")).alias("image"))
    for name in ("ok one", "short", "long", "extra", "cut"):
        rows.coalesce(1).write.parquet(f"{root}/{name}")
    rows.where("false").write.parquet(f"{root}/empty")
    rows.select(F.lit("not parquet")).write.text(f"{root}/broken")
    from pathlib import Path
    file = next(Path(f"{root}/cut").glob("part*.parquet"))  # the columns are overwritten, the footer stays
    data = bytearray(file.read_bytes())
    data[4:len(data) - int.from_bytes(data[-8:-4], "little") - 8] = b"\0" * (len(data) - int.from_bytes(data[-8:-4], "little") - 12)
    file.write_bytes(bytes(data))
    (file.parent / f".{file.name}.crc").unlink()
    manifest = spark.createDataFrame([("ok one", None), ("short", 50), ("long", 30), ("cut", None), ("empty", 0), ("broken", None), ("gone", 9)],
                                     "shard string, rows long")
    got = {r["shard"]: (r["files"] > 0, r["expected"], r["read"], r["usable"], r["status"])
           for r in readers.shard_ledger(spark, root, manifest, schema, F.octet_length("image.bytes") > 0).collect()}
    assert got == {"ok one": (True, 40, 40, 30, "complete"), "short": (True, 50, 40, 30, "partial"), "long": (True, 30, 40, 30, "excess"),
                   "extra": (True, 40, 40, 30, "unlisted"), "cut": (True, 40, 0, 0, "failed"), "empty": (True, 0, 0, 0, "complete"),
                   "broken": (True, None, 0, 0, "failed"), "gone": (False, 9, 0, 0, "missing")}
