"""Row filters: resume, usable labels, catalogs, issue buckets, targets, shards, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.functions.text import contains_any


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on expensive computed columns where they are.

    A plain filter is pushed below the projection that computes its columns,
    which copies their whole expressions into the condition and evaluates
    them again. A projection with a partition id is not crossed. Cheap
    conditions on stored columns belong in a plain ``where``, which does
    reach the scan.
    """
    pinned = df.withColumn("_pin", F.spark_partition_id())
    return pinned.where(condition & (F.col("_pin") >= 0)).drop("_pin")


def unprocessed(items: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Resume: rows whose key is in no processed log or tree."""
    return items.join(processed.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def usable_labels(labels: DataFrame, source: str) -> DataFrame:
    """Measured labels keep passed rows only; raw labels pass through."""
    if source != "qa_processed" or "qa_pass" not in labels.columns:
        return labels
    return labels.where(F.trim(F.coalesce(F.col("qa_pass").cast("string"), F.lit(""))) == "1")


def in_category(df: DataFrame, column: str, selected: str | None, prefix: str = "", suffix: str = "") -> DataFrame:
    """``all``, the full name, or the name without its prefix (and suffix)."""
    if not selected or selected.lower() == "all":
        return df
    full = F.lower(column)
    bare = F.replace(full, F.lit(prefix), F.lit("")) if prefix else full
    aliases = [full, bare] + ([F.replace(bare, F.lit(suffix), F.lit(""))] if suffix else [])
    return df.where(F.lit(selected.lower()).isin(*aliases))


def catalog_rows(df: DataFrame, stream: str = "all", tier: str = "all", categories: list[str] | None = None,
                 first: int | None = None, order: list[Column] | None = None) -> DataFrame:
    if stream != "all":
        df = df.where(F.col("stream") == stream)
    if tier != "all":
        df = df.where(F.col("tier") == tier)
    if categories:
        df = df.where(F.col("category").isin(categories))
    if first:
        df = df.orderBy(*order).limit(first)
    return df


def text_matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).rlike("(?i)" + pattern))


# Issue buckets: name, predicate on the label row (SQL text), keywords in the joined issues.
_SEVERE_GROOMING = "category IN ('Men_Grooming', 'Women_Grooming') AND tier = 'flaw_severe'"
_BEARDED = "coalesce(facial_hair_style, '') NOT IN ('', 'clean_shaven')"
_SHAVEN = "facial_hair_style = 'clean_shaven'"
_OUTFIT = "category IN ('Men_Outfit', 'Women_Outfit')"
ISSUE_BUCKETS = [
    ("pattern_miss", "upper_pattern = 'printed' OR lower_pattern = 'printed'",
     ["pattern", "print", "solid", "plain", "graphic"]),
    ("facial_hair_texture", _BEARDED,
     ["patchy", "texture", "dense rather than patchy", "uneven facial hair", "facial hair"]),
    ("eyebrows", _SEVERE_GROOMING, ["eyebrow", "unibrow"]),
    ("skin_condition", _SEVERE_GROOMING, ["dry", "flak"]),
    ("makeup", "category = 'Women_Grooming' AND tier = 'flaw_severe' "
               "AND coalesce(makeup_style, '') NOT IN ('', 'none')", ["makeup"]),
    ("clean_shaven_salvage", _SHAVEN, ["stubble", "beard", "mustache", "shadow", "unshaven", "facial hair"]),
    ("clean_shaven_residual", _SHAVEN,
     ["stubble", "beard", "mustache", "moustache", "shadow", "unshaven", "facial hair"]),
    ("pattern_solid_bleed", "upper_pattern = 'solid' OR lower_pattern = 'solid'",
     ["pattern", "patterned", "plaid", "checked", "striped", "printed", "graphic"]),
    ("hair_length_grooming", "category IN ('Men_Grooming', 'Women_Grooming')", ["hair"]),
    ("facial_hair_style_miss", _BEARDED, ["beard", "moustache", "stubble", "clean-shaven", "clean shaven"]),
    ("fit_miss", _OUTFIT, ["loose", "baggy", "tight", "snug", "straining"]),
    ("fabric_wrinkled_miss", _OUTFIT, ["stain", "wrinkl", "crease", "coin"]),
    ("footwear_type_men", "category = 'Men_Outfit'",
     ["footwear", "sandals", "sneaker", "boots", "flip flop", "desert boot", "dress shoe", "oxford"]),
    ("footwear_type_women", "category = 'Women_Outfit'",
     ["footwear", "sandals", "sneaker", "boots", "flats", "heels", "pumps", "flip flop"]),
]


def issue_buckets(audited: DataFrame, rules: list[tuple] = ISSUE_BUCKETS) -> DataFrame:
    """One row per (invalid item, bucket it falls in); an item may fall in several.

    ``audited`` has the label row, ``verdict`` and ``issues`` (array).
    """
    text = F.lower(F.array_join(F.coalesce("issues", F.array().cast("array<string>")), " "))
    hits = [F.when(F.expr(predicate) & contains_any(F.col("_issue_text"), keywords), bucket)
            for bucket, predicate, keywords in rules]
    return (audited.where(F.col("verdict") == "invalid").withColumn("_issue_text", text)
            .withColumn("bucket", F.explode(F.array_compact(F.array(*hits)))).drop("_issue_text"))


def target_status(targets: DataFrame, tasks: DataFrame, key: str = "filename") -> DataFrame:
    """Both-sided match report of a target list against the task list."""
    listed = targets.groupBy(key).agg(F.count(F.lit(1)).alias("listed"))
    known = tasks.select(key).distinct().withColumn("known", F.lit(True))
    status = (F.when(F.col("listed").isNull(), "not_targeted").when(F.col("known").isNull(), "not_in_task_list")
              .when(F.col("listed") > 1, "duplicate").otherwise("resolved"))
    return listed.join(known, key, "full_outer").select(key, F.coalesce("listed", F.lit(0)).alias("listed"),
                                                        status.alias("status"))


def resolve_targets(targets: DataFrame, tasks: DataFrame, key: str = "filename") -> DataFrame:
    """Tasks of a target list; any duplicate or unknown target refuses the whole list."""
    bad = (target_status(targets, tasks, key).where(F.col("status").isin("duplicate", "not_in_task_list"))
           .groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("example")).collect())
    if bad:
        detail = ", ".join(f"{r['n']} {r['status']} (first: {r['example']})" for r in bad)
        raise ValueError(f"target list refused: {detail}")
    return tasks.join(targets.select(key), key, "left_semi")


def shard(df: DataFrame, index: Column, count: int, number: int) -> DataFrame:
    return df.where(F.pmod(index, F.lit(count)) == number)


def position_slice(df: DataFrame, position: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Positions in [start, end); an open end takes everything."""
    if start is not None:
        df = df.where(F.col(position) >= start)
    if end is not None:
        df = df.where(F.col(position) < end)
    return df


def qa_passed(df: DataFrame, flag: Column) -> DataFrame:
    """Drop examples marked as failed; an absent mark passes."""
    return df.where(F.coalesce(flag, F.lit(True)))
