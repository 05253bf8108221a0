"""End-to-end jobs composed from the operators.

Each job takes DataFrames and returns DataFrames; nothing runs until the
caller writes or collects a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.functions import advice as AF
from stitchwork.functions import decode, jsonish, labels as L, portraits, routing
from stitchwork.functions.text import literals, words
from stitchwork.operators import aggregates as AG
from stitchwork.operators import filters, generate, history, joins, pixels, repair, sets
from stitchwork.operators.looks import look_defaults
from stitchwork.operators.ordered import first_per_key, running
from stitchwork.rules import advice as A
from stitchwork.rules import garments as G
from stitchwork.sources import readers


def qualify_and_route(items: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Q01: resume, cheap gate, judged gate, routing.

    ``items`` has the image metrics and the judge's fields; the destination
    is the partition the row belongs to.
    """
    fresh = filters.unprocessed(items, processed, key)
    gated = fresh.withColumn("reason", routing.heuristic_reason(F.col("size"), F.col("width"), F.col("height"),
                                                                F.col("laplacian")))
    status = routing.look_status(F.col("reason"), F.col("judged"), F.col("is_look"))
    routed = gated.withColumn("status", status)
    ok = F.col("status") == "sorted"
    stream = routing.resolve_stream(F.col("focus"), F.col("shot"), F.col("path"))
    demographic = routing.resolve_demographic(F.col("gender"), F.col("age"))
    tier = routing.resolve_tier(F.col("tier_text"), F.col("overall"))
    return routed.select(
        key, "filename", "status", F.when(ok, stream).alias("stream"), F.when(ok, demographic).alias("demographic"),
        F.when(ok, tier).alias("tier"),
        F.when(ok, F.concat_ws("/", stream, demographic, tier)).otherwise(routing.reject_folder(F.col("status")))
        .alias("destination"))


def judged_fields(answers: DataFrame, key: str, text: str = "answer") -> DataFrame:
    """The judge's raw answers as columns: fences, prose around the object and trailing commas are repaired.

    ``judged`` is false where no object could be read, and all fields are null then.
    """
    value = F.col("_value")
    kinds = {"is_look": "boolean", "overall": "double"}
    parsed = answers.select(key, jsonish.repair_json(F.col(text)).alias("_value"))
    names = ["is_look", "gender", "age", "tier_text", "overall", "focus", "shot", "upper", "mid", "lower", "shoes", "hair", "beard"]
    return parsed.select(key, value.isNotNull().alias("judged"),
                         *[jsonish.field(value, n, kinds.get(n, "string")).alias(n) for n in names])


def qualify_answers(items: DataFrame, answers: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Q01 from raw answers: resume, cheap gate, repaired answers, canonical labels, routing.

    ``items`` has filename, path and the image metrics, ``answers`` one text
    per item that was judged. Answers are parsed for items only that pass the
    cheap gate; an item without one counts as not judged. The labels are null
    for whatever isn't sorted. ``status_group`` is the first folder of the destination.
    """
    fresh = filters.unprocessed(items, processed, key)
    gated = fresh.withColumn("reason", routing.heuristic_reason(F.col("size"), F.col("width"), F.col("height"),
                                                                F.col("laplacian")))
    asked = answers.join(gated.where(F.col("reason") == "ok").select(key), key, "left_semi")
    rows = gated.join(judged_fields(asked, key), key, "left").withColumn("judged", F.coalesce("judged", F.lit(False)))
    rows = rows.withColumn("status", routing.look_status(F.col("reason"), F.col("judged"), F.col("is_look")))
    ok = F.col("status") == "sorted"
    facts = {"stream": routing.resolve_stream(F.col("focus"), F.col("shot"), F.col("path")),
             "demographic": routing.resolve_demographic(F.col("gender"), F.col("age")),
             "tier": routing.resolve_tier(F.col("tier_text"), F.col("overall")),
             **routing.canonical_garments(F.col("upper"), F.col("mid"), F.col("lower"), F.col("shoes")),
             "hair_styled": routing.canonical_hair_styled(F.col("hair")),
             "facial_hair_style": routing.canonical_facial_hair(F.col("beard"))}
    group = F.when(ok, "sorted").otherwise(routing.reject_folder(F.col("status")))
    return rows.select(key, "filename", "status", group.alias("status_group"),
                       *[F.when(ok, v).alias(n) for n, v in facts.items()])


def curate_photos(photos: DataFrame, keywords: DataFrame, vocabulary: list[str], per_class: int,
                  limit: int | None = None) -> DataFrame:
    """Q02: keyword sets, relevance rules, best photos per class."""
    described = joins.with_keywords(portraits.plausible_size(photos), joins.keyword_sets(keywords, "photo_id", "keyword", vocabulary), "photo_id")
    rows = filters.keep(portraits.photo_facts(described), F.col("category").isNotNull()).select(
        "photo_id", "category", "relevance_score")
    return sets.top_by_score(rows, "category", "relevance_score", [F.col("photo_id")], per_class, limit)


def balanced_ingestion(described: DataFrame, key: str, quota: int, limit: int | None = None) -> DataFrame:
    """Q03: classify descriptions, fill class quotas in scan order."""
    rows = filters.keep(portraits.classify_descriptions(described.select(key, "description"), "description"),
                        F.col("category").isNotNull()).select(key, "category")
    return sets.quota_then_limit(rows, "category", quota, [F.col(key)], limit)


def label_table(tasks: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Q04: drawn label rows and their class coverage."""
    labels = generate.draw_labels(tasks, seed)
    fields = [f["name"] for cat in G.CATEGORIES for f in G.label_schema(cat) if f["type"] in ("categorical", "ordinal")]
    return labels, AG.class_coverage(labels, sorted(set(fields)))


def merge_and_verify(shards: DataFrame, key: str, order: list[Column], expected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q05: merged rows, duplicate report, differences from the expected rows."""
    merged = first_per_key(shards, [key], order)
    return merged, AG.duplicate_report(shards, key, "shard", order), sets.differences(merged.select(*expected.columns), expected)


def audit_and_repair(labels: DataFrame, judged: DataFrame, bucket: str, columns: list[str]) -> dict[str, DataFrame]:
    """Q06: bucket the failures, turn answers into edits, patch, report the cell diff."""
    flagged = filters.issue_buckets(labels).where(F.col("bucket") == bucket).select("filename")
    edits = repair.corrections(judged.join(flagged, "filename", "left_semi"), bucket)
    patched, diff, unmatched = joins.apply_corrections(labels, edits.where(F.col("column").isin(columns)), columns)
    return {"patched": patched, "diff": diff, "unmatched": unmatched}


def audit_and_repair_all(labels: DataFrame, judged: DataFrame, position: str = "id") -> DataFrame:
    """Q06: the cell diff of every issue bucket against the labels, in one pass.

    A column that the labels don't have counts as empty. Of repeated answers for a cell the last by ``position`` stays.
    """
    flagged = filters.issue_buckets(labels).select("filename", "bucket").distinct()
    edits = repair.edits_by_bucket(F.col("bucket"), [b for b, *_ in filters.ISSUE_BUCKETS])
    cells = (judged.join(flagged, "filename").select("filename", "bucket", position, F.explode(edits).alias("_e"))
             .groupBy("filename", "bucket", F.col("_e.column").alias("column"))
             .agg(F.max_by("_e.new_value", F.struct(position, "_e.new_value")).alias("new_value")))
    old = F.create_map(*[x for n in labels.columns if n not in ("filename", "issues")
                         for x in (F.lit(n), F.col(n).cast("string"))])
    both = cells.join(labels.select("filename", old.alias("_old")), "filename")
    both = both.select("bucket", "filename", "column", F.try_element_at("_old", F.col("column")).alias("old_value"), "new_value")
    return both.where(F.coalesce("old_value", F.lit("None")) != F.col("new_value"))


def pixel_qa(labels: DataFrame, images: DataFrame, key: str = "filename") -> DataFrame:
    """Q07: measure, name colours, annotate label rows."""
    return pixels.qa_rows(labels, pixels.with_color_names(pixels.measure(images, key)), key)


def training_set(samples: DataFrame, annotations: DataFrame, key: str, fields: list[dict],
                 source: str = "qa_processed") -> DataFrame:
    """Q08: usable labels, score fallback, masked targets and an exact random split.

    ``samples`` has tier, one raw column per field and for measured labels
    ``qa_pass``; ``annotations`` the judged score.
    """
    j = filters.usable_labels(samples, source).join(annotations.select(key, F.col("overall").alias("_overall")), key, "left")
    score = L.score_or_midpoint(L.rescale_score(F.col("_overall")), F.lit(None).cast("double"), F.col("tier"))
    cols = []
    for f in fields:
        raw = F.col(f["name"]) if f["name"] in samples.columns else F.lit(None).cast("string")
        target, mask = L.target_and_mask(f, raw, score)
        cols += [target.alias(f"{f['name']}_target"), mask.alias(f"{f['name']}_mask")]
    return sets.random_split(j.select(key, *cols), key, seed=11)


def evaluation_report(p: DataFrame, predicted: Column, target: Column, mask: Column) -> dict[str, DataFrame]:
    """Q09: errors, calibration by tier, recall per class."""
    return {"errors": AG.score_errors(p, F.col("score"), F.col("score_true"), mask),
            "calibration": AG.calibration_by_tier(p, "true_tier", "score"),
            "recall": AG.class_recall(p, target, predicted)}


def advice_qa(records: DataFrame) -> dict[str, DataFrame]:
    """Q10: annotate every answer, count outcomes, collect the retained vocabulary."""
    reviewed = AF.review(records, F.col("text"), F.col("score"))
    kept = filters.keep(reviewed, F.col("passed"))
    n = F.size(words("text")).cast("long")
    return {"reviewed": reviewed,
            "counters": AG.review_counters(reviewed, F.col("passed"), F.array_contains("reasons", A.NO_VERB_WARNING)),
            "vocabulary": AG.vocabulary(kept, F.col("text"), AF.vocabulary_floor()),
            "lengths": AG.sequence_stats(kept, F.least(n, F.lit(A.MAX_SEQUENCE)), n, A.MAX_SEQUENCE)}


def advise(predictions: DataFrame) -> DataFrame:
    """Q11: occasion, calibrated score and tier, priority defect, advice cleaned for its domain.

    Input: id, category, score, occasion, advice and the attribute columns.
    """
    attrs = {c: F.col(c) for c in predictions.columns}
    calibrated = predictions.withColumn(
        "calibrated", decode.calibrate(F.col("score"), decode.active_defect(F.col("category"), attrs)))
    row = {f: F.col(f) for f in A.OUTFIT_DEFECTS + A.GROOMING_DEFECTS + [A.MEN_DEFECT, A.WOMEN_DEFECT]
           if f in predictions.columns}
    return calibrated.select(
        "id", AF.canonical_occasion(F.col("occasion")).alias("occasion"), "calibrated",
        decode.tier_name(F.col("calibrated")).alias("tier"), decode.tier_label(F.col("calibrated")).alias("tier_label"),
        F.coalesce(AF.priority_defect(F.col("category"), row), F.lit("none")).alias("priority_defect"),
        AF.isolate_domain(F.col("category"), F.col("advice"), F.col("calibrated")).alias("advice"))


def session_mart(looks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q12: session facts and the change between a session's first and latest look."""
    full = look_defaults(looks)
    facts = AG.session_stats(full, "session", F.col("score"), [F.col("ts"), F.col("look")], F.col("look"))
    change = facts.where(F.col("looks") >= 2).select(
        "session", (F.col("latest_score") - F.col("first_score")).alias("score_change"))
    return facts, change


def fleet_report(checks: DataFrame, hours: float, tasks: DataFrame | None = None, done: Column | None = None) -> DataFrame:
    """Q13: latest state per host with its alerts, and the progress of its slice where ``tasks`` (host, ...) are given."""
    report = history.stall_report(checks, hours)
    at = F.struct("ts", "event_id")
    hosts = report.groupBy("host").agg(
        F.max("count").alias("done"), F.max_by("progress_at", at).alias("progress_at"),
        F.max_by("stalled_since", at).alias("stalled_since"), F.count_if("alert").alias("alerts"))
    if tasks is None:
        return hosts
    slices = AG.progress(tasks, "host", done).select("host", F.col("target").alias("slice_target"),
                                                     F.col("remaining").alias("slice_remaining"), F.col("pct").alias("slice_pct"))
    return hosts.join(slices, "host", "left")


def url_inventory(pages: DataFrame, category: Column, thin_below: int, limit: int,
                  existing: DataFrame | None = None) -> DataFrame:
    """Q14: image URLs of landed pages that no inventory has yet, claimed by the categories in order up to their limit.

    A URL that a full category leaves is free for the next one. Categories
    that end with fewer than ``thin_below`` URLs are flagged.
    """
    urls = readers.listing_urls(pages, F.col("page")).withColumn("category", category)
    if existing is not None:
        urls = urls.join(existing.select("url"), "url", "left_anti")
    found = urls.select("url", "category", F.col("category").alias("_order"),
                        F.struct("page", "post_pos", "url_pos").alias("_position"), F.lit(limit).alias("_limit"))
    claimed = sets.claim_urls(found, "url", "category", "_order", "_position", "_limit", limit)
    n = claimed.groupBy("category").agg(F.count(F.lit(1)).alias("urls"), F.max("_position.page").alias("last_page"))
    return n.withColumn("thin", F.col("urls") < thin_below)


def url_inventory_until(pages: DataFrame, category: Column, limit: int, target: int,
                        existing: DataFrame | None = None) -> DataFrame:
    """Q14 with a target: categories claim in order until that many new URLs are there; later ones are not served.

    A category that isn't served claims nothing, and none before it could
    have claimed otherwise, so the stop is taken after all claims.
    """
    claimed = url_inventory(pages, category, 0, limit, existing)
    counts = claimed.select("category", "urls", F.lit(0).alias("_existing"), F.lit(limit).alias("_own"))
    served = sets.cumulative_stop(counts, [F.col("category")], "urls", "_existing", "_own", limit, target)
    return served.select("category", "served", F.col("new_rows").cast("long").alias("urls"))


def compare_variants(rows: DataFrame) -> DataFrame:
    """Q15: paired deltas of two model variants (structs ``a`` and ``b``: latency, tokens, words, text, repetition)."""
    a, b = F.col("a"), F.col("b")
    speed = lambda v: F.try_divide(F.sum(v["tokens"]).cast("double"), F.sum(v["latency"]))
    return rows.agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(a["latency"]).alias("a_latency"), F.avg(b["latency"]).alias("b_latency"),
        speed(a).alias("a_tokens_per_sec"), speed(b).alias("b_tokens_per_sec"),
        F.avg(b["words"] - a["words"]).alias("words_delta"), F.count_if(a["text"] == b["text"]).alias("identical"),
        F.count_if(a["repetition"]).alias("a_repetitions"), F.count_if(b["repetition"]).alias("b_repetitions"))
