"""Properties of the seeded generators."""

import pytest
from pyspark.sql import functions as F

from stitchwork.operators import generate
from stitchwork.rules import garments as G


@pytest.fixture(scope="module")
def labels(spark):
    return generate.draw_labels(generate.plan(spark), 2026).cache()


def test_plan_counts(spark):
    counts = {(r["category"], r["tier"]): r["count"] for r in generate.plan(spark).groupBy("category", "tier").count().collect()}
    assert counts[("Men_Grooming", "flaw_severe")] == 1000 and counts[("Men_Grooming", "polished")] == 2000
    assert counts[("Women_Outfit", "average")] == 2668 and counts[("Women_Outfit", "polished")] == 2666
    assert generate.plan(spark).where("index = 0").first()["filename"] == "00000_Men_Grooming_flaw_severe.png"


def test_draws_do_not_depend_on_partitioning(spark):
    tasks = generate.plan(spark, {"Men_Outfit": 300})
    a = generate.draw_labels(tasks.repartition(7), 1).orderBy("index").collect()
    b = generate.draw_labels(tasks.coalesce(1), 1).orderBy("index").collect()
    assert a == b


def test_label_invariants(labels):
    bad = labels.where(
        ((F.col("upper_type") == "dress") & (F.col("lower_type") != "none"))
        | ((F.col("lower_type") == "none") & (F.col("lower_pattern") != "none"))
        | ((F.col("facial_hair_style") == "clean_shaven") & (F.col("facial_hair_untidy") != 0))
        | ((F.col("fit_baggy") > 0) & (F.col("fit_tight") > 0))
        | ((F.col("tier") == "flaw_severe") & (F.col("fabric_wrinkled") != 2))
        | ((F.col("mid_type") == "none") & (F.col("requested_mid_color") != "none")))
    assert bad.count() == 0
    for tier, (lo, hi) in G.SCORE_BANDS.items():
        r = labels.where(F.col("tier") == tier).agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
        assert lo <= r["a"] and r["b"] <= hi
    for garment, colors in G.GARMENT_COLORS.items():
        assert labels.where((F.col("footwear_type") == garment) & ~F.col("requested_footwear_color").isin(colors)).count() == 0


def test_distributions(labels):
    outfits = labels.where(F.col("category").endswith("Outfit"))
    n = outfits.count()
    share = {r["upper_pattern"]: r["count"] / n for r in outfits.groupBy("upper_pattern").count().collect()}
    for name, weight in zip(G.PATTERNS, G.UPPER_PATTERN_WEIGHTS):
        assert abs(share[name] - weight) < 0.02
    assert {r[0] for r in outfits.select("formality").distinct().collect()} == set(G.FORMALITY_CLASSES)
    # Lighting says nothing about the tier.
    cells = {(r["tier"], r["requested_lighting"]): r["count"] for r in labels.groupBy("tier", "requested_lighting").count().collect()}
    totals = {}
    for (tier, _), c in cells.items():
        totals[tier] = totals.get(tier, 0) + c
    assert all(abs(c / totals[t] - 1 / 8) < 0.03 for (t, _), c in cells.items())


def test_coverage_gate(labels):
    from stitchwork.operators import aggregates as AG
    cov = AG.class_coverage(labels, ["facial_hair_style", "makeup_style", "hair_length", "formality"])
    assert AG.coverage_gate(cov).first()["clear"]


def test_contexts_and_search(spark):
    rows = generate.advice_contexts(spark.range(320), "id", 42)
    counts = {r["count"] for r in rows.groupBy("category", "tier").count().collect()}
    assert counts == {20}
    assert rows.where("category LIKE '%Grooming' AND color_harmony IS NOT NULL").count() == 0
    assert rows.where("tier = 'polished' AND posture NOT IN ('upright_aligned', 'slight_slouch')").count() == 0
    found = generate.search_tasks(spark, "Men_Outfit", G.TIERS, 100, 5, F.col("mid_type") == "hoodie", 2000).collect()
    assert len(found) == 5 and all(r["mid_type"] == "hoodie" and r["tier"] == G.TIERS[(r["index"] - 100) % 4] for r in found)
