"""Aggregations: grids with zero cells, coverage, audit, evaluation, history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.functions.text import literals
from stitchwork.rules import garments as G


def grid(seed: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Every combination of fixed dimension values, from the single row of ``seed``."""
    out = seed.limit(1).select(F.lit(1).alias("_one"))
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(literals(values)))
    return out.drop("_one")


def grid_counts(df: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Counts over fixed dimension values, zero cells included."""
    names = list(dims)
    counts = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return grid(df.sparkSession.range(1), dims).join(counts, names, "left").select(
        *names, F.coalesce("n", F.lit(0)).alias("n"))


def with_subtotals(cells: DataFrame, dims: list[str], value: str = "n") -> DataFrame:
    """Cells, a subtotal per first dimension, and the grand total (``ALL`` marks a rolled-up level)."""
    columns = [F.col(d) for d in dims]
    return cells.groupingSets([columns, columns[:1], []], *columns).agg(F.sum(value).alias(value)).select(
        *[F.coalesce(d, F.lit("ALL")).alias(d) for d in dims], value)


def status_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def status_summary(log: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return log.agg(is_("sorted").alias("qualified"), is_("rejected_not_human").alias("not_human"),
                   F.count_if(F.col("status").startswith("rejected_heuristic")).alias("heuristic"),
                   is_("rejected_vlm_failed").alias("judge_failed"),
                   is_("rejected_routing_failed").alias("routing_failed"))


def class_coverage(labels: DataFrame, fields: list[str], by: str = "category",
                   thin: int = G.THIN_CLASS) -> DataFrame:
    """Rows per (category, field, value) with a thin-class flag."""
    long = labels.select(by, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
        by, fields, "field", "value")
    return (long.where(F.col("value").isNotNull()).groupBy(by, "field", "value")
            .agg(F.count(F.lit(1)).alias("n")).withColumn("thin", F.col("n") < thin))


def coverage_gate(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.count(F.lit(1)).alias("classes"), F.count_if("thin").alias("thin_classes"),
                        (~F.bool_or("thin")).alias("clear"))


def qa_rates(df: DataFrame, passed: Column, missing: Column, warn_below: float = G.QA_PASS_RATE_WARN) -> DataFrame:
    """Pass rate over the rows that could be scored; zero when none could."""
    n = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(missing).alias("missing"),
               F.count_if(passed & ~missing).alias("passed"))
    scored = F.col("total") - F.col("missing")
    rate = F.when(scored > 0, F.col("passed") / F.when(scored > 0, scored)).otherwise(0.0)
    return n.select("*", scored.alias("scored"), rate.alias("pass_rate"), (rate < warn_below).alias("warn"))


def binding_rates(df: DataFrame, gate: float = G.COLOR_MATCH_GATE) -> DataFrame:
    """Colour match rates; the lower slot counts only rows that requested a colour."""
    upper = F.col("color_match_upper")
    lower_asked = ~F.coalesce("requested_lower_color", F.lit("")).isin("", "none")
    lower = F.when(lower_asked, F.col("color_match_lower"))
    sums = df.agg(F.sum(upper).alias("us"), F.count(upper).alias("un"),
                  F.sum(lower).alias("ls"), F.count(lower).alias("ln"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    pooled = F.try_divide(zero(F.col("us")) + zero(F.col("ls")), F.col("un") + F.col("ln"))
    return sums.select(F.try_divide("us", "un").alias("upper_rate"), F.try_divide("ls", "ln").alias("lower_rate"),
                       pooled.alias("combined_rate"), F.when(pooled >= gate, "PASS").otherwise("FAIL").alias("gate"))


AUDIT_CHECKS = {"body_type_match": False, "face_match": False, "attribute_match": False,
                "severe_anatomy_defect": True}


def audit_summary(verdicts: DataFrame, pool: int | Column) -> DataFrame:
    """Verdict and failure counts, percentages, and the projection on the whole pool."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    n = verdicts.agg(
        F.count(F.lit(1)).alias("total"), is_("valid").alias("valid"), is_("invalid").alias("invalid"),
        is_("error").alias("errors"),
        *[F.count_if(F.col(c) == bad).alias(f"{c}_failed") for c, bad in AUDIT_CHECKS.items()])
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.col("total"))
    pool = pool if isinstance(pool, Column) else F.lit(pool)
    projected = F.rint((1 - F.try_divide(F.col("valid"), F.col("total"))) * pool).cast("long")
    return n.select("*", share("valid").alias("valid_pct"), share("invalid").alias("invalid_pct"),
                    share("errors").alias("error_pct"), projected.alias("projected_invalid"))


def score_errors(df: DataFrame, predicted: Column, target: Column, mask: Column) -> DataFrame:
    """MAE and RMSE over supervised rows, null when there are none."""
    err = F.when(mask > 0, predicted - target)
    return df.agg(F.count(err).alias("n"), F.avg(F.abs(err)).alias("score_mae"),
                  F.sqrt(F.avg(err * err)).alias("score_rmse"))


def head_accuracy(df: DataFrame, heads: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Accuracy per head (predicted, target, mask), null for an unsupervised head."""
    return df.agg(*[F.avg(F.when(m > 0, F.when(p == t, 1.0).otherwise(0.0))).alias(name)
                    for name, (p, t, m) in heads.items()])


def masked_loss(df: DataFrame, heads: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """Masked mean per head and the weighted total; heads map to (raw loss, mask, weight)."""
    means = df.agg(*[(F.sum(raw * m) / F.greatest(F.sum(m), F.lit(1.0))).alias(name)
                     for name, (raw, m, _) in heads.items()])
    total = reduce(lambda a, b: a + b, [F.col(n) * F.lit(w) for n, (_, _, w) in heads.items()])
    return means.withColumn("total_loss", total)


def calibration_by_tier(df: DataFrame, tier: str, predicted: str) -> DataFrame:
    low = F.create_map(*[F.lit(x) for t, (lo, _) in G.SCORE_BANDS.items() for x in (t, lo)])
    high = F.create_map(*[F.lit(x) for t, (_, hi) in G.SCORE_BANDS.items() for x in (t, hi)])
    return df.groupBy(tier).agg(F.avg(predicted).alias("mean_predicted"), F.count(F.lit(1)).alias("n")).select(
        "*", F.try_element_at(low, F.col(tier)).alias("band_low"), F.try_element_at(high, F.col(tier)).alias("band_high"))


def class_recall(df: DataFrame, target: Column, predicted: Column) -> DataFrame:
    """Per true class: counts, recall, collapsed and weak flags.

    The confusion cells are counted first, so later steps only see
    (classes x classes) rows.
    """
    cells = df.groupBy(target.alias("t"), predicted.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    true = cells.groupBy(F.col("t").alias("class")).agg(
        F.sum("n").alias("n_true"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("n_hit"))
    guessed = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("n_predicted"))
    recall = F.col("n_hit") / F.col("n_true")
    out = true.join(guessed, "class", "left").withColumn("n_predicted", F.coalesce("n_predicted", F.lit(0)))
    return out.select("class", "n_true", "n_predicted", "n_hit", recall.alias("recall"),
                      (F.col("n_predicted") == 0).alias("collapsed"),
                      ((F.col("n_predicted") > 0) & (recall < 0.5)).alias("weak"))


def worst_class(recalls: DataFrame) -> DataFrame:
    return recalls.where("weak").agg(F.min_by("class", F.struct("recall", "class")).alias("class"),
                                     F.min("recall").alias("recall"))


def allocation(df: DataFrame, by: str, quota: int) -> DataFrame:
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("available")).where(F.col(by).isNotNull())
    return counts.withColumn(
        "allocated", F.least("available", F.lit(quota)).cast("long"))


def prefix_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts by the first two underscore parts; a single part keeps a trailing underscore."""
    parts = F.split(column, "_")
    prefix = F.concat(parts[0], F.lit("_"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return df.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def session_stats(looks: DataFrame, session: str, score: Column, order: list[Column], item: Column) -> DataFrame:
    """Per session: count, mean, best, first and latest look; first of equals is best."""
    at = F.struct(*order)
    best = F.struct((-score).alias("neg"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    return looks.groupBy(session).agg(
        F.count(F.lit(1)).alias("looks"), F.avg(score).alias("average_score"),
        F.min_by(item, best).alias("best_look"), F.max(score).alias("best_score"),
        F.min_by(item, at).alias("first_look"), F.min_by(score, at).alias("first_score"),
        F.max_by(item, at).alias("latest_look"), F.max_by(score, at).alias("latest_score"))


def sequence_stats(df: DataFrame, length: Column, supervised: Column, cap: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("examples"), F.min(length).alias("min_len"), F.max(length).alias("max_len"),
                  F.avg(length).alias("avg_len"), F.min(supervised).alias("min_supervised"),
                  F.max(supervised).alias("max_supervised"), F.avg(supervised).alias("avg_supervised"),
                  F.count_if(length >= cap).alias("truncated"), F.count_if(supervised == 0).alias("zero_supervised"))


def progress(tasks: DataFrame, by: str, done: Column) -> DataFrame:
    n = tasks.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("target"),
                                                         F.count_if(done).alias("done"))
    return n.select("*", (F.col("target") - F.col("done")).alias("remaining"),
                    F.coalesce(F.try_divide(F.col("done") * 100.0, F.col("target")), F.lit(0.0)).alias("pct"))


def review_counters(df: DataFrame, passed: Column, warned: Column) -> DataFrame:
    """Passed, warned and hard-failed counts with the over-ten-percent alert."""
    n = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("passed"),
               F.count_if(passed & warned).alias("warned"), F.count_if(~passed).alias("hard_failed"))
    return n.withColumn("alert", F.coalesce(F.try_divide("hard_failed", "total") > 0.10, F.lit(False)))


def depletion(labels: DataFrame, by: str, wrong: Column, regenerate_at: float) -> DataFrame:
    """Wrong share per class: relabel small shares in place, regenerate depleted classes."""
    n = labels.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong"))
    share = F.col("wrong") / F.col("n")
    return n.select("*", share.alias("wrong_share"),
                    F.when(F.col("wrong") == 0, "keep").when(share >= regenerate_at, "regenerate")
                    .otherwise("relabel").alias("action"))


def disposition(failures: DataFrame, identity_only: Column, salvage: Column, relabel: Column,
                defect: Column) -> DataFrame:
    """Every failure in exactly one bucket, by priority."""
    bucket = (F.when(defect, "defect").when(identity_only, "identity_only").when(salvage, "salvage")
              .when(relabel, "relabel").otherwise("residual"))
    return failures.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, by: list[str]) -> DataFrame:
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def duplicate_report(rows: DataFrame, key: str, source: str, order: list[Column]) -> DataFrame:
    """(key, kept source, dropped source) for every repeat after the first."""
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    slim = rows.select(key, F.col(source).alias("dropped"), at.alias("_at"))
    firsts = (slim.groupBy(key).agg(F.min_by("dropped", "_at").alias("kept"), F.min("_at").alias("_first"),
                                    F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n"))
    return slim.join(firsts, key).where(F.col("_at") != F.col("_first")).select(key, "kept", "dropped")


def best_epoch(history: DataFrame, by: str, value: str, epoch: str) -> DataFrame:
    return history.groupBy(by).agg(F.min(value).alias("best_value"),
                                   F.min_by(epoch, F.struct(value, epoch)).alias("best_epoch"),
                                   F.max(epoch).alias("epochs"))


def vocabulary(texts: DataFrame, text: Column, floor: list[str]) -> DataFrame:
    """Distinct words of the texts united with the required floor.

    Words are made distinct per row first and by partial aggregation next,
    so frequent words travel once per task.
    """
    from stitchwork.functions.text import words
    seen = texts.select(F.explode(F.array_distinct(words(text))).alias("token")).distinct()
    # A fixed list of terms from the rules, carried as one literal array.
    required = texts.sparkSession.range(1).select(F.explode(literals(floor)).alias("token"))
    return seen.union(required).distinct()
