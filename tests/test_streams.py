"""Streams against their batch twins, files landed in two halves with a restart between."""

import datetime as dt
import os
import tempfile

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from stitchwork.plans import catalog
from stitchwork.streaming import flows, state

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def halves(spark, rows, schema, folder, run):
    """Land one half, run, land the other, run again from the checkpoint."""
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run().awaitTermination()


def test_route_once_across_restarts(spark, folder):
    schema = "id long, tier string"
    rows = [(i, "a" if i % 3 else "b") for i in range(40)]
    run = lambda: flows.to_files(flows.landed(spark, f"{folder}/in", schema), f"{folder}/out", f"{folder}/ckpt", ["tier"])
    halves(spark, rows, schema, folder, run)
    run().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(40))


def test_url_dedup(spark, folder):
    rows = [(f"u{i % 7}",) for i in range(30)]
    run = lambda: flows.to_files(flows.distinct_urls(flows.landed(spark, f"{folder}/in", "url string")), f"{folder}/out", f"{folder}/ckpt")
    halves(spark, rows, "url string", folder, run)
    assert sorted(r["url"] for r in spark.read.parquet(f"{folder}/out").collect()) == [f"u{i}" for i in range(7)]


def test_known_hashes(spark, folder):
    known = spark.createDataFrame([("u1",), ("u2",)], "url string")
    rows = [(f"u{i}",) for i in range(5)]
    run = lambda: flows.to_files(flows.without_known(flows.landed(spark, f"{folder}/in", "url string"), known, "url"),
                                 f"{folder}/out", f"{folder}/ckpt")
    halves(spark, rows, "url string", folder, run)
    assert sorted(r["url"] for r in spark.read.parquet(f"{folder}/out").collect()) == ["u0", "u3", "u4"]


def test_quota(spark, folder):
    schema = "id long, cat string"
    rows = [(i, "hot" if i % 4 else "cold") for i in range(60)]
    run = lambda: flows.quota_stream(flows.landed(spark, f"{folder}/in", schema), "cat", 8, [F.col("id")], f"{folder}/out", f"{folder}/ckpt")
    halves(spark, rows, schema, folder, run)
    got = sorted((r["cat"], r["id"]) for r in spark.read.parquet(f"{folder}/out").collect())
    want = sorted([("hot", i) for i in [i for i in range(60) if i % 4][:8]] + [("cold", i) for i in range(0, 32, 4)])
    assert got == want


def test_delta(spark, folder):
    rows = [(f"f{i % 10}",) for i in range(30)]
    run = lambda: flows.to_files(flows.unsent(flows.landed(spark, f"{folder}/in", "item string"), ["h1", "h2"], "item",
                                              own=(F.col("host") == "h1") & (F.col("item") == "f0")), f"{folder}/out", f"{folder}/ckpt")
    halves(spark, rows, "item string", folder, run)
    got = sorted((r["host"], r["item"]) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == sorted((h, f"f{i}") for h in ("h1", "h2") for i in range(10) if (h, i) != ("h1", 0))


def test_merge_results(spark, folder):
    schema = "key string, verdict string"
    rows = [("a", "1"), ("b", "1"), ("a", "2"), ("c", "2")]
    run = lambda: flows.merge_results(flows.landed(spark, f"{folder}/in", schema), f"{folder}/out", f"{folder}/ckpt")
    halves(spark, rows, schema, folder, run)
    got = {r["key"]: r["verdict"] for r in flows.merged_results(spark, f"{folder}/out", "key").collect()}
    assert got == {"a": "1", "b": "1", "c": "2"}


CHECKS = "host string, instance_id long, ts timestamp, reachable boolean, count long, target long"


def checks(host, *events, instance=1, target=100):
    return [(host, i or instance, T0 + dt.timedelta(minutes=m), up, n, target) for m, up, n, i in events]


def test_host_health(spark, folder):
    rows = (checks("ok", (0, True, 5, 0), (10, True, 9, 0), (39, True, 9, 0), (40, True, 12, 0))
            + checks("flat29", (0, True, 5, 0), (10, True, 5, 0), (39, True, 5, 0))
            + checks("flat30", (0, True, 5, 0), (10, True, 5, 0), (40, True, 5, 0), (50, True, 9, 0))
            + checks("down", (0, True, 5, 0), (10, False, None, 0), (40, False, None, 0))
            + checks("done", (0, True, 5, 0), (10, True, 100, 0), (20, True, 100, 0))
            + checks("swap", (0, True, 5, 0), (10, True, 5, 0), (40, True, 5, 0), (50, True, 1, 2)))
    rows.sort(key=lambda r: r[2])
    run = lambda: flows.to_files(state.host_health(flows.landed(spark, f"{folder}/in", CHECKS)), f"{folder}/out", f"{folder}/ckpt")
    halves(spark, rows, CHECKS, folder, run)
    got = {}
    for r in sorted(spark.read.parquet(f"{folder}/out").collect(), key=lambda r: r["ts"]):
        got.setdefault(r["host"], []).append((r["status"], r["event"]))
    assert got["ok"] == [("RUNNING", None), ("RUNNING", None), ("STOPPED", None), ("RUNNING", None)]
    assert got["flat29"][-1] == ("STOPPED", None)
    assert got["flat30"] == [("RUNNING", None), ("STOPPED", None), ("DESTROYED", "stalled")]
    assert got["down"] == [("RUNNING", None), ("UNREACHABLE", None), ("DESTROYED", "stalled")]
    assert got["done"] == [("RUNNING", None), ("DESTROYED", "completed")]
    assert got["swap"][-1] == ("RUNNING", None) and ("DESTROYED", "stalled") in got["swap"]


def test_hold_stream(spark, folder):
    at = lambda s: T0 + dt.timedelta(milliseconds=round(s * 1000))
    runs = {"short": [(0, 1, 1), (1.19, 1, 1)], "exact": [(0, 1, 1), (1.2, 1, 1), (3, 1, 1)],
            "broken": [(0, 1, 1), (1.0, 1, 1), (1.1, 0, 1), (1.2, 1, 1), (2.4, 1, 1)],
            "rearmed": [(0, 1, 1), (1.2, 1, 1), (1.3, 1, 0), (1.4, 1, 1), (2.7, 1, 1)]}
    rows = sorted([(s, at(x), bool(ok), bool(auto)) for s, r in runs.items() for x, ok, auto in r], key=lambda r: r[1])
    schema = "session string, ts timestamp, ok boolean, auto boolean"
    run = lambda: flows.to_files(state.hold_steady(flows.landed(spark, f"{folder}/in", schema), 1.2), f"{folder}/out", f"{folder}/ckpt")
    halves(spark, rows, schema, folder, run)
    got = sorted((r["session"], r["fired_at"]) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == sorted([("exact", at(1.2)), ("broken", at(2.4)), ("rearmed", at(1.2)), ("rearmed", at(2.7))])


def test_quota_reads_totals_only_and_stops(spark, folder):
    schema = "id long, cat string"
    run = lambda: flows.quota_stream(flows.landed(spark, f"{folder}/in", schema), "cat", 3, [F.col("id")], f"{folder}/out", f"{folder}/ckpt", ["a", "b"])
    for part in range(4):
        spark.createDataFrame([(part * 100 + i, "ab"[i % 2]) for i in range(4)] + [(part * 100 + 50, None)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run().awaitTermination()
        if part == 1:  # all classes are full now; without earlier output, only its totals can be read
            os.rename(f"{folder}/out", f"{folder}/moved")
    got = sorted(((r["cat"], r["id"]) for r in spark.read.parquet(f"{folder}/moved").collect()), key=str)
    assert got == sorted([("a", 0), ("a", 2), ("a", 100), ("b", 1), ("b", 3), ("b", 101), (None, 50), (None, 150)], key=str)
    assert not os.path.exists(f"{folder}/out")


def test_a_chunk_lands_once(spark, folder):
    schema = "chunk string, id long, file string"
    run = lambda: flows.merge_results(flows.landed(spark, f"{folder}/in", schema), f"{folder}/out", f"{folder}/ckpt", "chunk", "file")
    landings = [[("a", 1, "f1"), ("a", 2, "f1"), ("a", 1, "f2"), ("b", 3, "f2")], [("a", 1, "f3"), ("c", 4, "f3")], [("b", 3, "f4"), ("c", 4, "f4")]]
    for part in landings:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run().awaitTermination()
    got = sorted((r["chunk"], r["id"], r["file"]) for r in spark.read.schema(schema).parquet(f"{folder}/out").collect())
    assert got == [("a", 1, "f1"), ("a", 2, "f1"), ("b", 3, "f2"), ("c", 4, "f3")]
    todo = spark.createDataFrame([("a",), ("c",), ("d",)], "chunk string")
    assert [r["chunk"] for r in flows.unfinished(todo, f"{folder}/out", "chunk").collect()] == ["d"]
    assert flows.unfinished(todo, f"{folder}/nowhere", "chunk").count() == 3


def test_silent_hosts_alert(spark, folder):
    """The last event of a host is followed by silence; other hosts' checks show that time has passed."""
    rows = (checks("quiet", (0, True, 5, 0), (10, True, 6, 0)) + checks("gap", (0, True, 5, 0), (50, True, 7, 0), (90, True, 8, 0))
            + checks("stalled", (0, True, 5, 0), (20, True, 5, 0)) + checks("done", (0, True, 100, 0))
            + checks("alive", *[(m, True, 5 + m, 0) for m in range(0, 121, 10)], target=10**6))
    rows.sort(key=lambda r: r[2])
    run = lambda: flows.to_files(state.host_health(flows.landed(spark, f"{folder}/in", CHECKS), destroy=False, silent_hours=0.5), f"{folder}/out", f"{folder}/ckpt")
    halves(spark, rows, CHECKS, folder, run)
    got = {}
    for r in sorted(spark.read.parquet(f"{folder}/out").collect(), key=lambda r: r["ts"]):
        if r["status"] == "SILENT":
            got.setdefault(r["host"], []).append((int((r["ts"] - T0).total_seconds() // 60), r["event"]))
    # Progress ends a stall, so each gap of the second host alerts, the last one exactly when the clock shows it.
    assert got == {"quiet": [(40, "stalled")], "gap": [(30, "stalled"), (80, "stalled"), (120, "stalled")], "stalled": [(50, "stalled")]}
    assert "alive" not in got and "done" not in got


def test_timed_hold_fires_without_another_frame(spark, folder):
    at = lambda s: T0 + dt.timedelta(milliseconds=round(s * 1000))
    runs = {"last": [(0, 1, 1)], "short": [(0, 1, 1), (1.1, 0, 1)], "long": [(0, 1, 1), (0.5, 1, 1), (0.7, 1, 1), (5, 0, 1), (6, 1, 1)],
            "late": [(9.5, 1, 1)], "rearmed": [(0, 1, 1), (2, 1, 0), (3, 1, 1), (9, 1, 1)], "clock": [(x, 0, 1) for x in range(11)]}
    rows = sorted([(s, at(x), bool(ok), bool(auto)) for s, r in runs.items() for x, ok, auto in r], key=lambda r: r[1])
    schema = "session string, ts timestamp, ok boolean, auto boolean"
    run = lambda: flows.to_files(state.hold_steady_timed(flows.landed(spark, f"{folder}/in", schema), 1.2), f"{folder}/out", f"{folder}/ckpt")
    halves(spark, rows, schema, folder, run)
    got = sorted((r["session"], r["fired_at"]) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == sorted([("last", at(1.2)), ("long", at(1.2)), ("rearmed", at(1.2)), ("rearmed", at(4.2))])


@pytest.mark.parametrize("name", ["t01_stream_route", "t03_stream_quota", "t05_stream_delta", "t07_stream_merge"])
def test_streams_of_tables_in_several_files(spark, sf_dir, folder, name):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(f"{folder}/{table}.parquet")
    sql = catalog.ORACLES[name]
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    assert oracle.compare(catalog.QUERIES[name](spark, folder), con, sql) is None
    assert con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > 0
