"""First rows without a single task, differences by fingerprints, numbered publication."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from stitchwork.operators import sets
from stitchwork.operators.ordered import first_rows
from stitchwork.sources import writers


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 1.5, 2.0, 2.0, float("nan"), -0.5]), rng.choice([None, "a", "b"])) for i in range(900)]
    return spark.createDataFrame(rows, "id long, score double, name string").repartition(6).cache()


@pytest.mark.parametrize("ways", ["asc asc asc", "desc asc desc", "asc desc asc"])
@pytest.mark.parametrize("n", [1, 250, 899, 900, 5000])
def test_first_rows_equal_a_sorted_limit(scored, ways, n):
    order = list(zip([F.col("score"), F.col("name"), F.col("id")], ways.split()))
    by = [k.desc() if way == "desc" else k.asc() for k, way in order]
    got = first_rows(scored, order, n, one_task_rows=0, ranges=7)
    assert {r["id"] for r in got.collect()} == {r["id"] for r in scored.orderBy(*by).limit(n).collect()}
    assert got.count() == min(n, 900)


def test_first_rows_of_an_empty_table(scored):
    assert first_rows(scored.where("id < 0"), [(F.col("id"), "asc")], 30, one_task_rows=0, ranges=3).count() == 0


def test_first_rows_bring_no_row_into_one_task(scored):
    small = first_rows(scored, [(F.col("id"), "asc")], 20)
    large = first_rows(scored, [(F.col("id"), "asc")], 20, one_task_rows=10, ranges=4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(small)
    assert "TakeOrderedAndProject" not in plan(large) and "GlobalLimit" not in plan(large)


_ROW = "id long, name string, v double, tags array<string>, at struct<x:int,y:int>"


def _bag(df):
    return collections.Counter(map(repr, df.collect()))


@pytest.mark.parametrize("buckets", [1, 5, 1000])
def test_differences_are_those_of_multisets(spark, buckets):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.choice([None, "a", "b"]), rng.choice([None, 0.0, 1.0]),
             rng.choice([None, [], ["a", None], [None, "a"]]), rng.choice([None, (1, None), (None, 1)])) for _ in range(400)]
    changed = rows[:350] + rows[:20] + [(7, "new", None, None, None)] * 3
    a, b = spark.createDataFrame(rows, _ROW), spark.createDataFrame(changed, _ROW).repartition(3)
    got = sets.differences(a, b, buckets)
    left, right = (_bag(got.where(F.col("side") == s).drop("side")) for s in ("left", "right"))
    assert left == _bag(a) - _bag(b) and right == _bag(b) - _bag(a)


def test_nulls_that_change_places_differ(spark):
    a = spark.createDataFrame([(1, None, "a")], "id int, x string, y string")
    b = spark.createDataFrame([(1, "a", None)], "id int, x string, y string")
    assert {tuple(r) for r in sets.differences(a, b).collect()} == {(1, None, "a", "left"), (1, "a", None, "right")}
    lists = [spark.createDataFrame([(1, v)], "id int, v array<string>") for v in ([None, "a"], ["a", None])]
    assert sets.differences(*lists).count() == 2


def test_equal_tables_differ_in_nothing_and_empty_ones_too(spark):
    a = spark.range(500).withColumn("v", F.col("id") % 7)
    assert sets.differences(a, a.repartition(3)).count() == 0
    assert sets.differences(a.limit(0), a.limit(0)).count() == 0
    assert sets.differences(a, a.limit(0)).where("side = 'left'").count() == 500


def test_the_last_publication_is_current_whatever_the_clock(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    monkeypatch.setattr(writers.time, "gmtime", lambda: __import__("time").struct_time((2030, 1, 1, 0, 0, 0, 0, 1, 0)))
    ahead = writers.publish(spark.range(3), root, write=True)
    monkeypatch.setattr(writers.time, "gmtime", lambda: __import__("time").struct_time((2020, 1, 1, 0, 0, 0, 0, 1, 0)))
    behind = writers.publish(spark.range(5), root, write=True)
    assert ahead.startswith("2030") and behind.startswith("2020")
    assert writers.current_version(spark, root) == behind and writers.read_published(spark, root).count() == 5


def test_publishers_of_one_number_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    writers.publish(spark.range(1), root, write=True, version="a")
    assert [writers._claim_pointer(spark, f"{root}/_versions", 2, v) for v in ("b", "c", "d")] == [2, 3, 4]
    got = {tuple(r) for r in writers.published_versions(spark, root).collect()}
    assert got == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}


def test_an_unfinished_pointer_does_not_count(spark, tmp_path):
    root = str(tmp_path / "t")
    writers.publish(spark.range(2), root, write=True, version="a")
    for number, text in (("00000000000000000002", ""), ("00000000000000000003", "hal")):
        (tmp_path / "t" / "_versions" / number).write_text(text)
    assert writers.current_version(spark, root) == "a"
    writers.publish(spark.range(4), root, write=True, version="b")
    assert writers.current_version(spark, root) == "b" and writers.read_published(spark, root).count() == 4
