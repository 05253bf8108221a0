"""Joins: enrichment, slices, repair, rollback, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from stitchwork.functions.text import literals, sql_value
from stitchwork.session import settle

#: At most so many keys that own several lists are sent to every task; more are met by shuffle.
MOST_BROADCAST = 100_000


def keyword_sets(keywords: DataFrame, key: str, keyword: str, vocabulary: list[str] | None = None) -> DataFrame:
    """Distinct lower-case keywords per key; a key without any is left out.

    ``keyword`` is one keyword a row, or a list of them. Repeats go before the
    sets are gathered, so a set is as large as the key's distinct words. A
    vocabulary keeps only words that the caller will intersect with.

    A list becomes a set where it is, and is the set of a key that owns one
    row: nothing is shuffled for it. Only the lists of keys that own several
    rows are taken apart and gathered again like rows. The keys of lists are
    counted first, so their table is read twice.
    """
    if isinstance(keywords.schema[keyword].dataType, ArrayType):
        return _merged_lists(keywords, key, keyword, vocabulary)
    word = F.lower(F.trim(F.col(keyword)))
    rows = keywords.where(F.col(keyword).isNotNull()).select(key, word.alias("_k"))
    if vocabulary is not None:
        rows = rows.where(f"_k IN ({', '.join(sql_value(v) for v in vocabulary)})")
    return rows.distinct().groupBy(key).agg(F.collect_list("_k").alias("keywords"))


def _merged_lists(keywords: DataFrame, key: str, keyword: str, vocabulary: list[str] | None) -> DataFrame:
    present = F.filter(F.array_distinct(F.col(keyword)), lambda x: x.isNotNull())
    words = F.array_distinct(F.transform(present, lambda x: F.lower(F.trim(x))))
    if vocabulary is not None:
        words = F.array_intersect(words, literals(vocabulary).cast("array<string>"))
    # Exploded from a list of one, so that the test of its size doesn't hold the whole expression again.
    lists = keywords.select(key, F.explode(F.array(words)).alias("keywords")).where(F.size("keywords") > 0)
    several = settle(keywords.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"))
    n = several.count()
    if not n:
        return lists
    several = F.broadcast(several) if n <= MOST_BROADCAST else several
    owned = F.col(key).eqNullSafe(F.col("_key"))
    rows = lists.join(several, owned, "left_semi").select(key, F.explode("keywords").alias("_k"))
    merged = rows.distinct().groupBy(key).agg(F.collect_list("_k").alias("keywords"))
    return lists.join(several, owned, "left_anti").unionByName(merged)


def with_keywords(photos: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Left join; a photo without keywords gets the empty set."""
    empty = F.array().cast("array<string>")
    return photos.join(sets, key, "left").withColumn("keywords", F.coalesce("keywords", empty))


def slice_of(position: Column, slices: list[tuple[str, int, int]]) -> Column:
    """Owner of a position among a fixed list of [start, end) slices, null outside."""
    out = None
    for name, start, end in slices:
        inside = (position >= start) & (position < end)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def range_join(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """point in [start, end) as an equi-join on cells of ``width``.

    Each range lists the cells it touches, each point has one, so the join
    is hash-partitioned instead of nested-loop, however many ranges there
    are. Choose ``width`` near the usual range length. A range with
    start >= end holds no point.
    """
    cells = ranges.where(F.col(start) < F.col(end)).withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    located = points.withColumn("_cell", F.floor(F.col(point) / width))
    return (located.join(cells, "_cell")
            .where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_cell"))


def dyadic_join(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str) -> DataFrame:
    """point in [start, end) for integers, whatever the ranges' lengths.

    A range is cut into the largest aligned cells of power-of-two length that
    it holds: two of each length at most, so a range is never more than
    2 log2(length) rows. A point asks its one cell of every length in use.
    A range with start >= end, or without a border, holds no point.
    """
    s, e, level = F.col(start).cast("long"), F.col(end).cast("long"), F.col("_level")
    # At each level the whole cells inside are [first, after); those whose parent isn't inside are at the ends.
    first = F.expr(f"-shiftright(-CAST(`{start}` AS BIGINT), _level)")
    after = F.expr(f"shiftright(CAST(`{end}` AS BIGINT), _level)")
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
    leveled = ranges.where(s < e).withColumn("_level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(e - s)).cast("int") + 1)))
    ends = F.array(F.when(odd(first), first), F.when(odd(after), after - 1))
    cells = leveled.where(first < after).withColumn("_cell", F.explode(F.filter(ends, lambda x: x.isNotNull())))
    levels = sorted(r["_level"] for r in cells.select("_level").distinct().collect())
    if not levels:
        return points.join(ranges, F.lit(False))
    asked = points.withColumn("_level", F.explode(literals(levels))).withColumn("_cell", F.expr(f"shiftright(CAST(`{point}` AS BIGINT), _level)"))
    return asked.join(cells, ["_level", "_cell"]).drop("_level", "_cell")


def corrections_by_file(corrections: DataFrame, key: str = "filename", position: str | None = None) -> DataFrame:
    """Long (file, column, value) to one map per file.

    With ``position`` (the place of an answer) a file's last answer replaces
    its earlier ones as a whole. Without it all rows of a file are one answer,
    in which a column occurs once (of repeats the largest text stays).
    """
    answer = [key, position] if position else [key]
    single = corrections.groupBy(*answer, "column").agg(F.max("new_value").alias("new_value"))
    maps = single.groupBy(*answer).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "new_value"))).alias("edit"))
    return maps.groupBy(key).agg(F.max_by("edit", position).alias("edit")) if position else maps


def _first_row_of(labels: DataFrame, edits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Labels with their edit; a file listed twice consumes its edit on the first row only."""
    joined = labels.join(edits, key, "left")
    first = (labels.join(edits.select(key), key, "left_semi").groupBy(key)
             .agg(F.min(F.struct(*order)).alias("_first")))
    return (joined.join(first, key, "left")
            .withColumn("edit", F.when(F.struct(*order) == F.col("_first"), F.col("edit"))).drop("_first"))


def apply_corrections(labels: DataFrame, corrections: DataFrame, columns: list[str], key: str = "filename",
                      order: list[str] | None = None,
                      position: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patched labels, cell diff, unmatched files); values compare as text.

    ``order`` makes a file that is listed twice consume its edit on the first
    row only; ``position`` is the place of an answer in the corrections.
    """
    edits = corrections_by_file(corrections, key, position)
    target = _first_row_of(labels, edits, key, order) if order else labels.join(edits, key, "left")
    new = {c: F.try_element_at("edit", F.lit(c)) for c in columns}
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("old_value"), new[c].alias("new_value"))
             for c in columns]
    # A missing old value reads as the text None, so it differs from every new value but that one.
    changed = F.filter(F.array(*cells), lambda s: s["new_value"].isNotNull()
                       & (F.coalesce(s["old_value"], F.lit("None")) != s["new_value"]))
    diff = (target.where(F.col("edit").isNotNull()).select(key, F.explode(changed).alias("_d"))
            .select(key, "_d.column", "_d.old_value", "_d.new_value"))
    patched = target.select(*[F.coalesce(new[c], F.col(c).cast("string")).cast(labels.schema[c].dataType).alias(c)
                              if c in columns else F.col(c) for c in labels.columns])
    unmatched = edits.join(labels, key, "left_anti").select(key)
    return patched, diff, unmatched


def salvage_rows(labels: DataFrame, plan: DataFrame, columns: list[str], key: str = "filename",
                 order: list[str] | None = None, position: str | None = None) -> DataFrame:
    """Copies of the planned rows with their edits, under a ``salvage_`` name, ready to append."""
    edits = corrections_by_file(plan, key, position)
    target = _first_row_of(labels, edits, key, order) if order else labels.join(edits, key, "inner")
    hit = target.where(F.col("edit").isNotNull())
    edited = {c: F.coalesce(F.try_element_at("edit", F.lit(c)), F.col(c).cast("string"))
              .cast(labels.schema[c].dataType) for c in columns}
    return hit.select(*[F.concat(F.lit("salvage_"), F.col(key)).alias(key) if c == key
                        else edited.get(c, F.col(c)).alias(c) for c in labels.columns])


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def rollback_paths(files: DataFrame, log: DataFrame, position: str,
                   fallback: str = "recovered_untracked") -> DataFrame:
    """Original path of each sorted file by its last log record, a fallback folder when untracked.

    ``files`` has ``name``; ``log`` has ``destination``, ``file`` and its line position.
    """
    usable = log.where((F.coalesce("destination", F.lit("")) != "") & (F.coalesce("file", F.lit("")) != ""))
    last = usable.groupBy(basename(F.col("destination")).alias("name")).agg(
        F.max_by("file", position).alias("original"))
    lost = F.concat(F.lit(fallback + "/"), F.col("name"))
    return files.join(last, "name", "left").select(
        *files.columns, F.coalesce("original", lost).alias("restored"), F.col("original").isNotNull().alias("tracked"))


def agrees(a: Column, b: Column) -> Column:
    """Mutual substring test."""
    return a.contains(b) | b.contains(a)


def compare_predictions(ours: DataFrame, reference: DataFrame, key: str, loose: list[str],
                        strict: list[str]) -> DataFrame:
    """Per-attribute agreement and score delta; a missing reference value shows as N/A."""
    a, b = ours.alias("a"), reference.alias("b")
    cols = [F.col(f"a.{key}").alias(key), (F.col("a.score") - F.col("b.score")).alias("score_delta")]
    for name in loose + strict:
        left = F.coalesce(F.col(f"a.{name}"), F.lit("N/A"))
        right = F.coalesce(F.col(f"b.{name}"), F.lit("N/A"))
        match = agrees(left, right) if name in loose else left == right
        cols.append(F.when(match, "match").otherwise("diverged").alias(f"{name}_status"))
    return a.join(b, key, "left").select(*cols)


def first_matching_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Target of the first (keyword, target) whose keyword is inside the text."""
    hits = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in rules]),
                    lambda r: text.contains(r["k"]))
    return F.try_element_at(hits, F.lit(1))["t"]


def each_of(df: DataFrame, name: str, values: list) -> DataFrame:
    """Every row under every one of a fixed list of conditions."""
    return df.withColumn(name, F.explode(literals(values)))
