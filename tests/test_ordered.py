"""Ordered windows against plain windows and brute force, with a hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stitchwork.operators import history, sets
from stitchwork.operators.ordered import first_per_key, global_row_number, running


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}"
        rows.append((i, key, rng.randrange(500), rng.choice([None, rng.randrange(9)])))
    return spark.createDataFrame(rows, "id long, key string, at int, v int").repartition(5).cache()


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_running_equals_plain_window(hot, ranges):
    order = [F.col("at"), F.col("id")]
    features = {"s": ("sum", F.col("v")), "b": ("before", F.col("v")), "mx": ("max", F.col("v")), "mn": ("min", F.col("v")),
                "pm": ("prior_max", F.col("v")), "pn": ("prior_min", F.col("v")), "lg": ("lag", F.col("v")),
                "ld": ("lead", F.col("v")), "ls": ("last", F.col("v"))}
    got = running(hot, ["key"], order, features, ranges=ranges)
    w = Window.partitionBy("key").orderBy(*order)
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = hot.select("*", F.sum("v").over(upto).alias("s"), F.coalesce(F.sum("v").over(prior), F.lit(0)).alias("b"),
                      F.max("v").over(upto).alias("mx"), F.min("v").over(upto).alias("mn"), F.max("v").over(prior).alias("pm"),
                      F.min("v").over(prior).alias("pn"), F.lag("v").over(w).alias("lg"), F.lead("v").over(w).alias("ld"),
                      F.last("v", ignorenulls=True).over(upto).alias("ls"))
    key = lambda rows: sorted((tuple(r) for r in rows), key=lambda t: t[0])
    assert key(got.select(*want.columns).collect()) == key(want.collect())


@pytest.mark.parametrize("ranges", [1, 3, 25])
def test_global_row_number(hot, ranges):
    got = global_row_number(hot, [F.col("at"), F.col("id")], "n", ranges).select("id", "n").collect()
    want = {r["id"]: i + 1 for i, r in enumerate(sorted(hot.collect(), key=lambda r: (r["at"], r["id"])))}
    assert {r["id"]: r["n"] for r in got} == want


def test_hot_key_is_cut(hot):
    from stitchwork.operators.ordered import RANGE, with_ranges
    sizes = [r["count"] for r in with_ranges(hot, [F.col("key"), F.col("at"), F.col("id")], 20).groupBy(RANGE).count().collect()]
    assert len(sizes) > 15 and max(sizes) < 600


def test_first_per_key(hot):
    got = {r["key"]: r["id"] for r in first_per_key(hot, ["key"], [F.col("at"), F.col("id")]).collect()}
    want = {}
    for r in sorted(hot.collect(), key=lambda r: (r["at"], r["id"])):
        want.setdefault(r["key"], r["id"])
    assert got == want


def test_claim_urls_equals_serial_loop(spark):
    rng = random.Random(9)
    rows = [(f"u{rng.randrange(30)}", f"c{c}", c, p, 4 + c % 3) for c in range(6) for p in range(15)]
    found = spark.createDataFrame(rows, "url string, category string, ord int, pos int, lim int")
    got = {(r["category"], r["url"]) for r in sets.claim_urls(found, "url", "category", "ord", "pos", "lim", 6).collect()}
    taken, want = set(), set()
    for c in range(6):
        mine = 0
        for url, cat, _, _, lim in sorted((r for r in rows if r[2] == c), key=lambda r: r[3]):
            if url not in taken and mine < lim:
                taken.add(url)
                mine += 1
                want.add((cat, url))
    assert got == want


def test_hold_steady_cases(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(milliseconds=round(s * 1000))
    runs = {"short": [(0, True), (1.19, True)], "exact": [(0, True), (1.2, True), (2.0, True)],
            "broken": [(0, True), (1.0, True), (1.1, False), (1.2, True), (2.4, True)]}
    rows = [(s, i, at(x), ok) for s, r in runs.items() for i, (x, ok) in enumerate(r)]
    df = spark.createDataFrame(rows, "session string, id int, ts timestamp, ok boolean")
    got = {r["session"]: r["fired_at"] for r in history.hold_steady(df, "session", "ts", [F.col("ts"), F.col("id")], F.col("ok"), 1.2).collect()}
    assert got == {"exact": at(1.2), "broken": at(2.4)}


def test_early_stop_golden(spark):
    losses = [5.0, 4.0, 3.0, 3.5, 3.2, 3.1, 2.9, 3.0, 3.0, 3.1, 3.2, 3.3, 1.0]
    df = spark.createDataFrame([("m", i + 1, v) for i, v in enumerate(losses)], "run string, e int, v double")
    assert history.early_stop(df, "run", [F.col("e")], "v", 5).first()["stop_epoch"] == 12


def test_replay_drops_partial_batches(spark):
    real, synth = spark.range(25).withColumnRenamed("id", "r"), spark.range(5).withColumnRenamed("id", "s")
    rows = sets.replay_mixture(real, synth, [F.col("r")], [F.col("s")], 10, 0.2).collect()
    by = {}
    for r in rows:
        by.setdefault(r["batch"], []).append(r["r"] if r["origin"] == "real" else ("s", r["s"]))
    assert sorted(by) == [0, 1, 2] and all(len(v) == 10 for v in by.values())
    assert ("s", 4) not in sum(by.values(), []) and {x for x in by[2] if isinstance(x, tuple)} == {("s", 0), ("s", 1)}
