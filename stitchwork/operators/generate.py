"""Seeded plan and label generation with per-row hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stitchwork.functions.labels import (
    formality_tier, mean_worn, pooled_tier_counts, positive, severity, task_filename)
from stitchwork.functions.text import (
    choose, half_even, literals, lookup, sql_choose, sql_value, sql_weighted, uniform, weighted)
from stitchwork.rules import advice as A
from stitchwork.rules import garments as G

_CHUNK = 100_000


def plan(spark: SparkSession, counts: dict[str, int] | None = None) -> DataFrame:
    """Every planned task: category, then tier, then count, with a running index.

    Counts are fixed numbers, so the index alone gives category and tier
    and the plan is one distributed range.
    """
    counts = counts or G.CATEGORY_COUNTS
    start, category, tier = 0, None, None
    index = F.col("id")
    for name, total in counts.items():
        base = total // 6
        sizes = {"flaw_severe": base, "flaw_mild": base, "average": total - base * 4, "polished": base * 2}
        for t, size in sizes.items():
            hit = index < start + size
            category = F.when(hit, name) if category is None else category.when(hit, name)
            tier = F.when(hit, t) if tier is None else tier.when(hit, t)
            start += size
    return spark.range(start).select(index.alias("index"), category.alias("category"), tier.alias("tier"),
                                     task_filename(index, category, tier).alias("filename"))


def plan_from_counts(counts: DataFrame, category: str, total: str) -> DataFrame:
    """The same plan for category totals that come from data.

    One row per (category, tier) carries its index range; ranges are cut
    into chunks before they are exploded, so no task or array holds more
    than one chunk.
    """
    sizes = pooled_tier_counts(F.col(total))
    per_tier = counts.select(category, F.posexplode(F.array(*[
        F.struct(F.lit(t).alias("tier"), n.alias("size")) for t, n in sizes.items()])).alias("ord", "t")).select(
        category, "ord", "t.tier", "t.size")
    # One row per class and tier: this window is bounded by the number of classes.
    order = Window.orderBy(category, "ord").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_tier.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0))).where(F.col("size") > 0)
    last = F.col("start") + F.col("size") - 1
    cut = starts.withColumn("from", F.explode(F.sequence(F.col("start"), last, F.lit(_CHUNK))))
    cut = cut.repartition("from")
    return cut.select(category, "tier", F.explode(F.sequence(
        F.col("from"), F.least(last, F.col("from") + _CHUNK - 1))).alias("index"))


def _sql_pool_pick(draw_band: str, draw_item: str, target: str, pool: list[tuple]) -> str:
    """75 % within one formality step of the target (exact hits weigh 3:1), else the whole pool."""
    cases = ""
    for level in range(4):
        band = [(n, 3.0 if f == level else 1.0) for n, _, f in pool if level - 1 <= f <= level + 1]
        cases += f" WHEN {level} THEN {sql_weighted(draw_item, [n for n, _ in band], [w for _, w in band])}"
    return (f"CASE WHEN {draw_band} < 0.75D THEN CASE {target}{cases} END "
            f"ELSE {sql_choose(draw_item, [n for n, _, _ in pool])} END")


def _pool_value(item: Column, pool: list[tuple], which: int) -> Column:
    return lookup(item, {entry[0]: entry[which] for entry in pool})


def _color_pick(draw: str, garment: str) -> Column:
    cases = "".join(f" WHEN {sql_value(n)} THEN {sql_choose(draw, allowed)}" for n, allowed in G.GARMENT_COLORS.items())
    return F.expr(f"CASE {garment}{cases} ELSE {sql_choose(draw, list(G.PALETTE))} END")


def _per_gender(category: Column, build) -> Column:
    women = category.startswith("Women")
    return F.when(women, build("woman")).otherwise(build("man"))


def _keyed_choice(draw: str, pairs: list[tuple]) -> Column:
    """Key chosen uniformly."""
    return choose(draw, [k for k, _ in pairs])


def score_in_band(draw: Column, tier: Column) -> Column:
    low = lookup(tier, {t: lo for t, (lo, _) in G.SCORE_BANDS.items()})
    high = lookup(tier, {t: hi for t, (_, hi) in G.SCORE_BANDS.items()})
    return half_even(low + draw * (high - low), 1)


_DRAWS = (["score", "target", "direction", "hair_length", "facial", "makeup", "background", "lighting", "framing", "age",
           "ethnicity", "build", "face", "upper_pattern", "lower_pattern", "upper_color", "mid_color", "lower_color",
           "footwear_color", "outfit_hair"]
          + [f"{s}:{d}" for s in ("upper", "mid", "lower", "footwear") for d in ("band", "item")])


def draw_labels(tasks: DataFrame, seed: int) -> DataFrame:
    """Label columns of every task, each drawn from (seed, field, index) only.

    The result is the same on any partitioning and after any retry, and a
    row never depends on its neighbours.
    """
    # Every draw is a column first, so the rules below read columns instead of repeating hashes.
    tasks_in, tasks = tasks, tasks.select("*", *[
        uniform(f"{seed}:{f}", "index").alias(f"_u_{f.replace(':', '_')}") for f in _DRAWS])
    u = lambda field: f"_u_{field.replace(':', '_')}"
    category, tier = F.col("category"), F.col("tier")
    grooming = category.endswith("Grooming")
    outfit_only = lambda c: F.when(~grooming, c)
    grooming_only = lambda c: F.when(grooming, c)
    men = grooming & category.startswith("Men")
    women = grooming & category.startswith("Women")

    staged = tasks.select(
        "*", score_in_band(F.col(u("score")), tier).alias("score"),
        severity(tier).alias("_sev"), positive(tier).alias("_pos"),
        F.floor(F.col(u("target")) * 4).cast("int").alias("_target"),
        F.when(F.col(u("direction")) < 0.5, "baggy").otherwise("tight").alias("fit_direction"),
        choose(u("hair_length"), G.HAIR_LENGTHS).alias("_hair"),
        choose(u("facial"), G.FACIAL_HAIR_STYLES).alias("_facial"), choose(u("makeup"), G.MAKEUP_STYLES).alias("_makeup"),
        _keyed_choice(u("background"), G.BACKGROUNDS).alias("_background"),
        _keyed_choice(u("lighting"), G.LIGHTING).alias("_lighting"),
        _keyed_choice(u("framing"), G.FRAMING).alias("_framing"),
        choose(u("age"), G.IDENTITY["age"]).alias("identity_age"),
        choose(u("ethnicity"), G.IDENTITY["ethnicity"]).alias("identity_ethnicity"),
        _per_gender(category, lambda g: choose(u("build"), G.BUILDS[g])).alias("identity_build"),
        _per_gender(category, lambda g: choose(u("face"), G.FACE_SHAPES[g])).alias("identity_face"))
    slot = lambda s: _per_gender(category, lambda g: F.expr(_sql_pool_pick(
        u(f"{s}:band"), u(f"{s}:item"), "_target", G.POOLS[(g, s)])))
    dressed = staged.select(
        "*", outfit_only(slot("upper")).alias("upper_type"), outfit_only(slot("mid")).alias("mid_type"),
        outfit_only(slot("lower")).alias("_lower"), outfit_only(slot("footwear")).alias("footwear_type"))
    # A dress replaces the lower slot.
    dressed = dressed.withColumn("lower_type", F.when(F.col("upper_type") == "dress", "none").otherwise(F.col("_lower")))

    worth = lambda c, s: _per_gender(category, lambda g: _pool_value(F.col(c), G.POOLS[(g, s)], 2))
    mean = mean_worn([worth("upper_type", "upper"), F.when(F.col("mid_type") != "none", worth("mid_type", "mid")),
                      worth("lower_type", "lower"), worth("footwear_type", "footwear")])
    dressed = dressed.withColumn("_mean", F.when(~grooming, mean))
    no_lower = F.col("lower_type") == "none"
    sev, pos = F.col("_sev"), F.col("_pos")
    baggy = F.col("fit_direction") == "baggy"
    text = lambda c: c.cast("string")
    return dressed.select(
        *tasks_in.columns, "score",
        grooming_only(sev).alias("hair_untidy"), grooming_only(text(pos)).alias("hair_styled"),
        grooming_only(F.col("_hair")).alias("hair_length"), grooming_only(sev).alias("skin_neglected"),
        grooming_only(text(pos)).alias("skin_healthy"), grooming_only(sev).alias("eyebrows_unkempt"),
        grooming_only(text(pos)).alias("eyebrows_groomed"),
        F.when(men, F.col("_facial")).alias("facial_hair_style"),
        F.when(men, F.when(F.col("_facial") == "clean_shaven", 0).otherwise(sev)).alias("facial_hair_untidy"),
        F.when(men, F.when(F.col("_facial") == "clean_shaven", "0").otherwise(text(pos))).alias("facial_hair_groomed"),
        F.when(women, F.col("_makeup")).alias("makeup_style"),
        F.when(women, F.when(F.col("_makeup") == "none", 0).otherwise(sev)).alias("makeup_uneven"),
        F.when(women, F.when(F.col("_makeup") == "none", "0").otherwise(text(pos))).alias("makeup_flawless"),
        "upper_type",
        outfit_only(weighted(u("upper_pattern"), G.PATTERNS, G.UPPER_PATTERN_WEIGHTS)).alias("upper_pattern"),
        "mid_type", "lower_type",
        outfit_only(F.when(no_lower, "none").otherwise(
            weighted(u("lower_pattern"), G.PATTERNS, G.LOWER_PATTERN_WEIGHTS))).alias("lower_pattern"),
        "footwear_type", outfit_only(formality_tier(F.col("_mean"))).alias("formality"),
        outfit_only(F.when(baggy, sev).otherwise(0)).alias("fit_baggy"),
        outfit_only(F.when(~baggy, sev).otherwise(0)).alias("fit_tight"),
        outfit_only(text(pos)).alias("fit_tailored"), outfit_only(sev).alias("fabric_wrinkled"),
        outfit_only(text(pos)).alias("fabric_crisp"), outfit_only(sev).alias("footwear_worn"),
        outfit_only(text(pos)).alias("footwear_polished"), outfit_only(sev).alias("styling_sloppy"),
        outfit_only(text(pos)).alias("styling_sharp"),
        outfit_only(_color_pick(u("upper_color"), "upper_type")).alias("requested_upper_color"),
        outfit_only(F.when(F.col("mid_type") == "none", "none").otherwise(
            _color_pick(u("mid_color"), "mid_type"))).alias("requested_mid_color"),
        outfit_only(F.when(no_lower, "none").otherwise(
            _color_pick(u("lower_color"), "lower_type"))).alias("requested_lower_color"),
        outfit_only(_color_pick(u("footwear_color"), "footwear_type")).alias("requested_footwear_color"),
        F.col("_background").alias("requested_background"), F.col("_lighting").alias("requested_lighting"),
        F.col("_framing").alias("requested_framing"),
        outfit_only(choose(u("outfit_hair"), G.OUTFIT_HAIR)).alias("requested_hair_desc"),
        F.when(~grooming, F.col("fit_direction")).alias("fit_direction"),
        "identity_age", "identity_ethnicity", "identity_build", "identity_face")


# ---- prompt text ---------------------------------------------------------------------------

def by_tier(tier: Column, phrases: list[str]) -> Column:
    return lookup(tier, dict(zip(G.TIERS, phrases)))


def without_article(phrase: Column) -> Column:
    return F.regexp_replace(phrase, "^an? ", "")


def garment_clause(pattern: Column, color: Column, phrase: Column) -> Column:
    """``a striped navy shirt``; nouns that come without an article stay without one."""
    clause = F.concat_ws(" ", pattern, color, without_article(phrase))
    return F.when(phrase.rlike("^an? "), F.concat(F.lit("a "), clause)).otherwise(clause)


def plain_clause(color: Column, phrase: Column) -> Column:
    return F.concat(F.lit("a "), color, F.lit(" "), without_article(phrase))


def outfit_conditions(tier: Column, direction: Column, footwear: Column) -> dict[str, Column]:
    """Condition phrases by tier, fit direction and laces."""
    fabric = by_tier(tier, G.FABRIC_PHRASES)
    fit = F.when(direction == "baggy", by_tier(tier, G.FIT_PHRASES["baggy"])).otherwise(
        by_tier(tier, G.FIT_PHRASES["tight"]))
    lower = F.when(tier == "flaw_severe", G.LOWER_SEVERE_FABRIC_PHRASE).otherwise(fabric)
    laced = footwear.isNull() | footwear.isin(G.LACED_FOOTWEAR)
    return {"upper_mod": F.concat(fabric, F.lit(", the fit "), fit),
            "lower_mod": F.concat(lower, F.lit(", the fit "), fit), "mid_mod": by_tier(tier, G.MID_PHRASES),
            "footwear_mod": F.when(laced, by_tier(tier, G.FOOTWEAR_PHRASES[True])).otherwise(
                by_tier(tier, G.FOOTWEAR_PHRASES[False])),
            "styling": by_tier(tier, G.STYLING_PHRASES)}


def grooming_conditions(category: Column, tier: Column, hair_length: Column, facial: Column,
                        makeup: Column) -> dict[str, Column]:
    hair = _per_gender(category, lambda g: by_tier(tier, G.HAIR_PHRASES[g]))
    return {
        "hair": F.concat_ws(", ", lookup(hair_length, G.HAIR_LENGTH_WORDS), hair),
        "facial": F.when(facial == "clean_shaven", "completely clean-shaven with smooth, even skin").otherwise(
            F.concat_ws(", ", lookup(facial, G.FACIAL_HAIR_WORDS), by_tier(tier, G.FACIAL_HAIR_PHRASES))),
        "makeup": F.when(makeup == "none", "no makeup, a bare face").otherwise(
            F.concat_ws(", ", lookup(makeup, G.MAKEUP_WORDS), by_tier(tier, G.MAKEUP_PHRASES))),
        "skin": by_tier(tier, G.SKIN_PHRASES), "eyebrows": by_tier(tier, G.EYEBROW_PHRASES)}


def render_prompts(labels: DataFrame) -> DataFrame:
    """Prompt, negative prompt and resolution from drawn label rows."""
    category, tier = F.col("category"), F.col("tier")
    women = category.startswith("Women")
    person = F.when(women, "woman").otherwise("man")
    t = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    identity = t(F.col("identity_age"), " ", F.col("identity_ethnicity"), " ", person, ", ", F.col("identity_build"),
                 ", ", F.col("identity_face"))
    setting = t("Setting: ", lookup(F.col("requested_background"), dict(G.BACKGROUNDS)), ", ",
                lookup(F.col("requested_lighting"), dict(G.LIGHTING)), ", ",
                lookup(F.col("requested_framing"), dict(G.FRAMING)), ".")
    # Phrases become columns before they are joined into prompts.
    names = list(labels.columns)
    labels = labels.withColumns({"_identity": identity, "_setting": setting})
    identity, setting = F.col("_identity"), F.col("_setting")
    severe = tier == "flaw_severe"
    g = grooming_conditions(category, tier, F.col("hair_length"), F.col("facial_hair_style"), F.col("makeup_style"))
    labels = labels.withColumns({f"_g_{k}": v for k, v in g.items()})
    g = {k: F.col(f"_g_{k}") for k in g}
    brows = F.when(severe, t(g["eyebrows"], " ", G.EYEBROWS_SEVERE_POSITIVE)).otherwise(g["eyebrows"])
    makeup = F.when(severe & (F.col("makeup_style") != "none"), t(g["makeup"], " ", G.MAKEUP_SEVERE_POSITIVE)).otherwise(
        g["makeup"])
    third = F.when(women, t("Makeup: ", makeup, ".")).otherwise(t("Facial hair: ", g["facial"], "."))
    facing = "facing the camera directly, looking at the camera."
    grooming_prompt = F.concat_ws(
        "\n", t("A head-and-shoulders portrait photograph of a ", identity, ", " + facing), F.lit(facing),
        t("Hair: ", g["hair"], "."), third, t("Skin: ", g["skin"], "."), t("Eyebrows: ", brows, "."), setting,
        F.lit("Photorealistic candid photograph, natural skin texture, sharp focus, "
              "85mm lens, head and shoulders in frame."))

    phrase = lambda c, s: _per_gender(category, lambda who: _pool_value(F.col(c), G.POOLS[(who, s)], 1))
    o = outfit_conditions(tier, F.col("fit_direction"), F.col("footwear_type"))
    spoken = {f"_s_{s}": phrase(f"{s}_type", s) for s in ("upper", "mid", "lower", "footwear")}
    labels = labels.withColumns({**{f"_o_{k}": v for k, v in o.items()}, **spoken})
    o = {k: F.col(f"_o_{k}") for k in o}
    phrase = lambda c, s: F.col(f"_s_{s}")
    body = t("body proportions unchanged from their natural ", F.col("identity_build"),
             " figure, not slimmer or heavier than that")
    outfit_prompt = F.concat_ws(
        "\n", t("A full-body photograph of a ", identity, ", ", body, ", with ", F.col("requested_hair_desc"),
                ", standing facing the camera with the whole body from head to shoes visible."),
        t("Upper body: wearing ", garment_clause(F.col("upper_pattern"), F.col("requested_upper_color"),
                                                 phrase("upper_type", "upper")), ", ", o["upper_mod"], "."),
        F.when(F.col("mid_type") != "none", t("Outer layer: wearing ", plain_clause(
            F.col("requested_mid_color"), phrase("mid_type", "mid")), ", ", o["mid_mod"], ".")),
        F.when(F.col("lower_type") != "none", t("Lower body: wearing ", garment_clause(
            F.col("lower_pattern"), F.col("requested_lower_color"), phrase("lower_type", "lower")), ", ",
            o["lower_mod"], ".")),
        t("Footwear: ", F.col("requested_footwear_color"), " ", without_article(phrase("footwear_type", "footwear")),
          ", ", o["footwear_mod"], "."),
        t("Overall styling: ", o["styling"], "."), setting,
        F.lit("Photorealistic candid photograph, natural skin texture, sharp focus, 85mm lens, full body in frame."))
    extra = F.concat_ws(
        ", ", F.lit(G.NEGATIVE_PROMPT),
        F.when(category.endswith("Grooming") & severe, G.SKIN_SEVERE_NEGATIVE),
        F.when(F.col("facial_hair_style") == "clean_shaven", G.CLEAN_SHAVEN_NEGATIVE),
        F.when((F.col("upper_pattern") == "solid") | (F.col("lower_pattern") == "solid"), G.SOLID_NEGATIVE))
    return labels.select(
        *names, F.when(category.endswith("Grooming"), grooming_prompt).otherwise(outfit_prompt).alias("prompt"),
        extra.alias("negative_prompt"), lookup(category, G.RESOLUTION).alias("resolution"))


# ---- advice contexts, searches, grids ------------------------------------------------------

def advice_contexts(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Sixteen strata in rotation (tier outer, category inner) with tier-dependent signals."""
    combos = [(c, t) for t in G.TIERS for c in G.CATEGORIES]
    at = (F.pmod(F.col(key), F.lit(len(combos))) + 1).cast("int")
    draws = ["occasion", "posture", "lighting", "harmony"]
    staged = rows.select(
        "*", F.element_at(literals([c for c, _ in combos]), at).alias("category"),
        F.element_at(literals([t for _, t in combos]), at).alias("tier"),
        *[uniform(f"{seed}:{d}", key).alias(f"_u_{d}") for d in draws])

    def signal(table: dict, draw: str) -> Column:
        cases = "".join(f" WHEN {sql_value(t)} THEN {sql_weighted(draw, [v for v, _ in o], [w for _, w in o])}"
                        for t, o in table.items())
        return F.expr(f"CASE tier{cases} END")
    lights = A.LIGHTING_WEIGHTS
    return staged.select(
        *rows.columns, "category", "tier", choose("_u_occasion", A.OCCASIONS).alias("occasion"),
        signal(A.POSTURE_WEIGHTS, "_u_posture").alias("posture"),
        weighted("_u_lighting", [v for v, _ in lights], [w for _, w in lights]).alias("lighting"),
        F.when(F.col("category").endswith("Outfit"), signal(A.HARMONY_WEIGHTS, "_u_harmony")).alias("color_harmony"))


def search_tasks(spark: SparkSession, category: str, tiers: list[str], seed: int, count: int, predicate: Column,
                 block: int = 200_000, give_up: int | None = None) -> DataFrame:
    """First ``count`` seeds whose drawn row satisfies the predicate, tiers in rotation.

    The predicate may use every drawn column, and ``prompt`` too. Seeds are
    searched in blocks of doubling size until enough are found. A predicate
    that nothing satisfies would never end, so ``give_up`` seeds at most are
    tried; finding fewer raises.
    """
    start, found = seed, None
    while True:
        base = spark.range(start, start + block).select(
            F.col("id").alias("index"), F.lit(category).alias("category"),
            F.element_at(literals(tiers), (F.pmod(F.col("id") - seed, F.lit(len(tiers))) + 1).cast("int")).alias("tier"))
        hits = render_prompts(draw_labels(base, 0)).where(predicate)
        found = hits if found is None else found.unionByName(hits)
        first = found.orderBy("index").limit(count)
        n = first.count()
        if n == count:
            return first
        start, block = start + block, 2 * block
        if give_up is not None and start - seed >= give_up:
            raise ValueError(f"{n} of {count} seeds found among {start - seed}")


def sample_grid(seed_rows: DataFrame, dims: dict[str, list], per_cell: int, sample: str = "sample_idx") -> DataFrame:
    """``per_cell`` rows for every combination of fixed dimension values."""
    out = seed_rows
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(literals(values)))
    return out.withColumn(sample, F.explode(F.sequence(F.lit(0), F.lit(per_cell - 1))))
