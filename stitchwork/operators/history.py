"""Histories per key: progress and stalls, early stopping, hold-steady gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.operators.ordered import RANGE, running


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds between two timestamps, with or without zone."""
    return F.extract(F.lit("DAY"), end - start).cast("long") * 86_400_000_000 + (
        F.extract(F.lit("HOUR"), end - start).cast("long") * 3_600_000_000
        + F.extract(F.lit("MINUTE"), end - start).cast("long") * 60_000_000
        + (F.extract(F.lit("SECOND"), end - start) * 1_000_000).cast("long"))


def progress_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host checks from events: purchases count as finished items, errors as unreachable checks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("host"), "event_id", "ts", (F.col("event_type") != "error").alias("reachable"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long").alias("done"))
    return running(e, ["host"], [F.col("ts"), F.col("event_id")], {"count": ("sum", F.col("done"))}, keep_ranges=True)


def stall_report(checks: DataFrame, hours: float) -> DataFrame:
    """Progress since the last reachable check, stall start and alert per check.

    A reachable check above the last seen count is progress and resets the
    stall; the first check after progress that is flat or unreachable starts
    it. Input: host, event_id, ts, reachable, count.
    """
    order = [F.col("ts"), F.col("event_id")]
    seen = running(checks, ["host"], order, {
        "_before": ("prior_max", F.when(F.col("reachable"), F.col("count"))),
        "_next": ("lead", F.col("ts")), "_start": ("min", F.col("ts"))}, keep_ranges=True)
    delta = F.when(F.col("reachable"), F.col("count") - F.coalesce("_before", F.lit(0))).otherwise(0).cast("long")
    moved = seen.withColumn("delta", delta).withColumn("_moved", F.col("reachable") & (F.col("delta") > 0))
    # A stall starts at the check after the latest progress, or at the very first check.
    since = running(moved, ["host"], order, {
        "progress_at": ("last", F.when(F.col("_moved"), F.col("ts"))),
        "_since": ("last", F.when(F.col("_moved"), F.col("_next")))})
    stalled = F.when(~F.col("_moved"), F.coalesce("_since", "_start"))
    limit = int(hours * 3_600_000_000)
    return since.select(
        *[c for c in checks.columns if c != RANGE], "delta", "progress_at", stalled.alias("stalled_since"),
        F.coalesce(micros_between(stalled, F.col("ts")) >= limit, F.lit(False)).alias("alert"))


def early_stop(history: DataFrame, run: str, order: list[Column], value: str, patience: int) -> DataFrame:
    """First epoch without improvement for ``patience`` epochs, null when training never stalls."""
    rows = running(history, [run], order, {
        "epoch": ("sum", F.lit(1)), "_before": ("prior_min", F.col(value))}, keep_ranges=True)
    better = F.col("_before").isNull() | (F.col(value) < F.col("_before"))
    rows = running(rows, [run], order, {"_improved": ("last", F.when(better, F.col("epoch")))})
    return rows.groupBy(run).agg(F.min(F.when(F.col("epoch") - F.col("_improved") >= patience, F.col("epoch")))
                                 .cast("long").alias("stop_epoch"))


def hold_steady(gate: DataFrame, session: str, ts: str, order: list[Column], ok: Column, seconds: float,
                auto: Column | None = None) -> DataFrame:
    """Time at which a gate had stayed true long enough, once per session.

    With ``auto``, a row where it is false re-arms the session, so every
    armed stretch may fire once.
    """
    rows = gate.withColumn("_auto", F.lit(True) if auto is None else auto).withColumn("_ok", ok & F.col("_auto"))
    first = {"_prev": ("lag", F.col("_ok"))}
    if auto is not None:
        first["_stretch"] = ("sum", F.when(F.col("_auto"), 0).otherwise(1))
    rows = running(rows, [session], order, first, keep_ranges=True)
    opens = F.when(F.col("_ok") & ~F.coalesce("_prev", F.lit(False)), F.col(ts))
    rows = running(rows, [session], order, {"_since": ("last", opens)})
    fires = F.col("_ok") & (micros_between(F.col("_since"), F.col(ts)) >= int(seconds * 1_000_000))
    keys = [session] + (["_stretch"] if auto is not None else [])
    return rows.where(fires).groupBy(*keys).agg(F.min(ts).alias("fired_at")).select(session, "fired_at")
