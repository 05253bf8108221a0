"""Shard union, dedup, novelty, chunks, batches, mixtures, splits, quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stitchwork.functions.text import literals, sql_draw
from stitchwork.operators.ordered import first_per_key, first_rows, global_row_number, running, top_per_key
from stitchwork.session import settle


def union_shards(shards: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def merge_logs(log: DataFrame, index: str, order: list[Column]) -> DataFrame:
    """First line per index wins; lines without an index (malformed ones too) all stay."""
    numbered = log.where(F.col(index).isNotNull())
    rest = log.where(F.col(index).isNull())
    return first_per_key(numbered, [index], order).unionByName(rest)


def merge_main_and_shards(main: DataFrame, shards: DataFrame, index: str, order: list[Column]) -> DataFrame:
    """The main log keeps every line; shard lines join it once per unseen index."""
    known = main.where(F.col(index).isNotNull()).select(index)
    fresh = merge_logs(shards, index, order)
    return main.unionByName(fresh.join(known, index, "left_anti").select(*main.columns), allowMissingColumns=True)


def novel_urls(found: DataFrame, seen: DataFrame | None, url: str, order: list[Column]) -> DataFrame:
    """First finder of each URL in scan order, minus the URLs seen before."""
    out = first_per_key(found, [url], order)
    return out if seen is None else out.join(seen.select(url), url, "left_anti")


def claim_urls(found: DataFrame, url: str, category: str, category_order: str, position: str,
               limit: str, largest_limit: int) -> DataFrame:
    """First ``limit`` free URLs per category, categories served in order.

    A URL that a full category leaves stays free for the next one, so a
    single pass is not enough. Each round, every URL asks the earliest
    category that has not refused it, and every category keeps its first
    ``limit`` askers by position; refused pairs drop out. With one common
    category order this ends in exactly the one-category-at-a-time result.
    Rounds are few: only URLs at the edge of a full category move on.

    ``largest_limit`` bounds the limits of all categories; it lets Spark cut
    a large category before its shuffle.
    """
    pairs = settle(found.groupBy(url, category).agg(
        F.min(category_order).alias(category_order), F.min(position).alias(position), F.max(limit).alias(limit)))
    while True:
        asks = first_per_key(pairs, [url], [F.col(category_order), F.col(position)])
        ranked = top_per_key(asks, [category], [F.col(position), F.col(url)], largest_limit, rank="_rank")
        kept = ranked.where(F.col("_rank") <= F.col(limit)).drop("_rank")
        refused = asks.join(kept.select(url, category), [url, category], "left_anti").select(url, category)
        remaining = settle(pairs.join(refused, [url, category], "left_anti"))
        if remaining.count() == pairs.count():
            return kept
        pairs = remaining


def missing_for(items: DataFrame, consumers: list[str], sent: DataFrame, consumer: str, item: str,
                own: Column | None = None) -> DataFrame:
    """Items each of a fixed list of consumers has not been sent; ``own`` marks items it made itself."""
    wanted = items.withColumn(consumer, F.explode(literals(consumers)))
    if own is not None:
        wanted = wanted.where(~F.coalesce(own, F.lit(False)))
    return wanted.join(sent.select(consumer, item), [consumer, item], "left_anti")


def quota_then_limit(df: DataFrame, by: str, quota: int, order: list[Column], limit: int | None = None) -> DataFrame:
    """First ``quota`` rows per class in scan order, then the first ``limit`` of what was accepted."""
    accepted = top_per_key(df, [by], order, quota)
    return accepted if limit is None else first_rows(accepted, [(o, "asc") for o in order], limit)


def top_by_score(df: DataFrame, by: str, score: str, order: list[Column], per_class: int,
                 limit: int | None = None) -> DataFrame:
    """Best ``per_class`` rows per class, then the best ``limit`` overall.

    Equal scores keep the scan order inside a class, and across classes the
    class that appeared first comes first.
    """
    best = top_per_key(df, [by], [F.col(score).desc(), *order], per_class, rank="class_rank")
    if limit is None:
        return best
    first_seen = df.groupBy(by).agg(F.min(F.struct(*order)).alias("_seen"))
    whole = [(F.col(score), "desc"), (F.col("_seen"), "asc"), (F.col("class_rank"), "asc")]
    return first_rows(best.join(first_seen, by), whole, limit).drop("_seen")


def cumulative_stop(categories: DataFrame, order: list[Column], found: str, existing: str, own_limit: str,
                    limit: int, target: int) -> DataFrame:
    """Serve categories in order until the running total reaches the target.

    A target at or below what is there already counts new rows only;
    otherwise it counts the grand total.
    """
    cap = F.least(F.lit(limit), F.coalesce(F.col(own_limit), F.lit(limit)))
    taken = F.when(F.col(existing) >= cap, F.lit(0)).otherwise(F.least(F.col(found), cap - F.col(existing)))
    initial = categories.agg(F.coalesce(F.sum(existing), F.lit(0)).alias("i")).scalar()
    rows = categories.withColumn("effective_limit", cap).withColumn("would_take", taken.cast("long"))
    rows = running(rows, [], order, {"taken_before": ("before", F.col("would_take"))})
    start = F.when(F.lit(target) <= initial, F.lit(0)).otherwise(initial)
    served = F.col("taken_before") + start < target
    return rows.select(*categories.columns, "effective_limit", served.alias("served"),
                       F.when(served, F.col("would_take")).otherwise(F.lit(0)).alias("new_rows"))


def chunks(df: DataFrame, order: list[Column], size: int, name: str = "chunk") -> DataFrame:
    """Consecutive chunks of ``size`` rows in the given unique order."""
    return (global_row_number(df, order, "_pos")
            .withColumn(name, F.floor((F.col("_pos") - 1) / size).cast("long")).drop("_pos"))


def keyed_batches(df: DataFrame, key: str, order: list[Column], size: int) -> DataFrame:
    """Batches of equal key. Full batches are emitted when they fill, remainders at the end."""
    rows = running(df, [key], order, {"_nth": ("sum", F.lit(1))})
    rows = rows.withColumn("batch", F.floor((F.col("_nth") - 1) / size).cast("long")).drop("_nth")
    return rows


def batch_index(batches: DataFrame, key: str, position: str, size: int) -> DataFrame:
    """One row per batch with its emission class and sort position."""
    per_batch = batches.groupBy(key, "batch").agg(
        F.count(F.lit(1)).alias("n"), F.max(position).alias("filled_at"), F.min(position).alias("_from"))
    first_seen = per_batch.groupBy(key).agg(F.min("_from").alias("key_seen_at"))
    remainder = F.col("n") < size
    return per_batch.join(first_seen, key).select(
        key, "batch", "n", remainder.alias("is_remainder"),
        F.when(remainder, F.col("key_seen_at")).otherwise(F.col("filled_at")).alias("emit_at"))


def replay_mixture(real: DataFrame, synthetic: DataFrame, real_order: list[Column], synthetic_order: list[Column],
                   batch_size: int, ratio: float) -> DataFrame:
    """Batches of real rows with replayed synthetic rows; the synthetic side cycles.

    Partial batches of either side are dropped. ``round`` is half-even.
    """
    synthetic_n = max(1, round(batch_size * ratio)) if ratio > 0 else 0
    real_n = batch_size - synthetic_n
    if real_n <= 0:
        raise ValueError("no room left for real rows in a batch")
    steps = real.agg(F.floor(F.count(F.lit(1)) / real_n).cast("long").alias("b")).scalar()
    placed = chunks(real, real_order, real_n, "batch").where(F.col("batch") < steps)
    placed = placed.withColumn("origin", F.lit("real"))
    if synthetic_n == 0:
        return placed
    cycle = synthetic.agg(F.floor(F.count(F.lit(1)) / synthetic_n).cast("long").alias("c")).scalar()
    blocks = chunks(synthetic, synthetic_order, synthetic_n, "_block").withColumn("_cycle", cycle).withColumn(
        "_steps", steps).where((F.col("_block") < F.col("_cycle")) & (F.col("_block") < F.col("_steps")))
    replayed = blocks.withColumn("batch", F.explode(F.sequence(F.col("_block"), F.col("_steps") - 1, F.col("_cycle"))))
    return placed.unionByName(replayed.drop("_block", "_cycle", "_steps").withColumn("origin", F.lit("synthetic")),
                              allowMissingColumns=True)


def ordered_split(df: DataFrame, order: list[Column], train_share: float, min_each: int = 0) -> DataFrame:
    """First share of the order is ``train``, the rest ``val``; optional minimum on both sides."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = F.floor(total * F.lit(train_share))
    if min_each:
        cut = F.greatest(F.lit(min_each), F.least(cut, total - min_each))
    return (global_row_number(df, order, "_pos").withColumn("_cut", cut)
            .withColumn("split", F.when(F.col("_pos") <= F.col("_cut"), "train").otherwise("val")).drop("_pos", "_cut"))


def random_split(df: DataFrame, key: str, seed: int, val_share: float = 0.2) -> DataFrame:
    """Exact shares in drawn order of a whole-number key, at least one row on the validation side."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    val = F.greatest(F.lit(1), F.floor(total * F.lit(val_share)))
    return (global_row_number(df.withColumn("_draw", F.expr(sql_draw(seed, key))), [F.col("_draw"), F.col(key)], "_pos").withColumn("_val", val)
            .withColumn("split", F.when(F.col("_pos") <= F.col("_val"), "val").otherwise("train"))
            .drop("_draw", "_pos", "_val"))


def sample_rows(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows without replacement by drawn order, equal on every partitioning."""
    return first_rows(df, [(F.expr(sql_draw(seed, key)), "asc"), (F.col(key), "asc")], n)


def _whole_row_hash(df: DataFrame, seed: int) -> Column:
    """A hash that tells nulls apart by place, which the plain one skips; nested values go in as text."""
    parts = [F.lit(seed)]
    for field in df.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            value = F.to_json(F.struct(value), {"ignoreNullFields": "false"})
        parts += [value, value.isNull()]
    return F.xxhash64(*parts)


def differences(a: DataFrame, b: DataFrame, buckets: int = 16_384) -> DataFrame:
    """Rows of either side the other lacks, as often as they are in excess; empty means an exact reconstruction.

    Rows fall into ``buckets`` by a hash of their content. Of each bucket the
    signed sums of two more 64-bit hashes and of one are compared: they don't
    depend on the order and count repeats. Only rows of buckets that differ
    are shuffled and compared by value, so equal tables exchange no rows. A
    difference escapes only if both sums agree by chance, about 2^-128 a bucket.
    Either side is read twice where anything differs.
    """
    names = a.columns
    sides = [(a, 1), (b.select(*names), -1)]

    def keyed(df: DataFrame, sign: int) -> DataFrame:
        bucket = F.pmod(_whole_row_hash(df, 0), F.lit(buckets)).cast("int")
        return df.select(*names, F.lit(sign).alias("_n"), bucket.alias("_bucket"))

    def prints(df: DataFrame, sign: int) -> DataFrame:
        signed = [(_whole_row_hash(df, seed).cast("decimal(20,0)") * sign).cast("decimal(20,0)").alias(f"_h{seed}")
                  for seed in (1, 2)]
        bucket = F.pmod(_whole_row_hash(df, 0), F.lit(buckets)).cast("int")
        return df.select(bucket.alias("_bucket"), F.lit(sign).alias("_n"), *signed)
    uneven = (reduce(DataFrame.unionByName, [prints(*s) for s in sides]).groupBy("_bucket")
              .agg(*[F.sum(c).alias(c) for c in ("_n", "_h1", "_h2")])
              .where((F.col("_n") != 0) | (F.col("_h1") != 0) | (F.col("_h2") != 0)).select("_bucket"))
    # At most one row per bucket, so the broadcast is bounded by ``buckets`` numbers.
    rows = reduce(DataFrame.unionByName, [keyed(*s) for s in sides]).join(F.broadcast(uneven), "_bucket", "left_semi")
    net = rows.groupBy(*names).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    each = net.select(*names, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"),
                      F.explode(F.sequence(F.lit(1), F.abs("_n"))).alias("_i"))
    return each.drop("_i")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changed rows replace rows of the same key; unknown keys are added."""
    return current.join(changes.select(key), key, "left_anti").select(*current.columns).unionByName(changes)


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key), key, "left_anti").select(*current.columns)


def reindex(values: DataFrame, value: str, name: str = "new_id") -> DataFrame:
    """Dense zero-based ids in value order."""
    return (global_row_number(values.select(value).distinct(), [F.col(value)], "_pos")
            .withColumn(name, F.col("_pos") - 1).drop("_pos"))


def shuffled_positions(df: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """Deterministic shuffle: zero-based position in drawn order."""
    out = df.withColumn("_draw", F.expr(sql_draw(seed, key)))
    return (global_row_number(out, [F.col("_draw"), F.col(key)], "_pos")
            .withColumn(name, F.col("_pos") - 1).drop("_draw", "_pos"))


def remap_ids(docs: DataFrame, key: str, tokens: Column, vocabulary: DataFrame, token: str, new_id: str,
              strict: bool = False, salt_rows: int = 1_000_000) -> DataFrame:
    """Token arrays to id arrays through a vocabulary table; unknown tokens vanish, or raise when strict.

    The vocabulary may outgrow a broadcast, so each document's distinct
    tokens join it by hash; a frequent token then counts once per document.
    """
    own = settle(docs.select(key, F.explode(F.array_distinct(tokens)).alias(token)))
    # A token of more than salt_rows documents is spread over as many salts as it has such shares.
    hot = (own.groupBy(token).agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") > salt_rows)
           .select(token, F.ceil(F.col("_df") / salt_rows).cast("long").alias("_salts")))
    salted = own.join(hot, token, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(key), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    wide = vocabulary.select(token, new_id).join(hot, token, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    how = "left" if strict else "inner"
    pairs = salted.join(wide, [token, "_salt"], how)
    if strict:
        known = F.when(F.col(new_id).isNull(), F.raise_error(F.concat(
            F.lit("token not in the vocabulary: "), F.col(token))).cast("long")).otherwise(F.col(new_id))
        pairs = pairs.withColumn(new_id, known)
    maps = pairs.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(token, new_id))).alias("_map"))
    ids = F.array_compact(F.transform(tokens, lambda t: F.try_element_at("_map", t)))
    return docs.join(maps, key, "left").select(
        *docs.columns, F.coalesce(ids, F.array().cast("array<long>")).alias("ids"))
