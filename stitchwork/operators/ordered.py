"""Ordered windows that no single task has to hold.

``row_number() over (order by ...)`` without a partition, or partitioned by
a key that owns a third of the rows, sends all of them to one task. Here the
rows are cut into ranges of (key, order) first: one range exchange on whole,
unique sort keys, so a hot key is cut as often as it needs. The cut rows are
written to the shared checkpoint folder with their range number, so a
recomputed partition finds the same cut. Each range runs a plain window; what
a range needs from the ones before it is a per-range total, carried over by a
join with at most one row per range.

Passes over the input: one to count, one to sample and one to write the cut.
Totals and results read the cut, also in chained calls with ``keep_ranges``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchwork.session import settle

RANGE = "_range"
#: Rows that one range, so one task, holds at most on average.
ROWS_PER_RANGE = 2_000_000
#: First rows up to this number are merged in one task, which holds that many rows of each partition in turn.
ONE_TASK_ROWS = 10_000


def _sort_key(keys: list[Column]) -> Column:
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])


def with_ranges(df: DataFrame, keys: list[Column], ranges: int | None = None,
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add the range number of each row. ``keys`` sort ascending and are unique together.

    As many ranges as the session's shuffle partitions, or more where these
    would hold over ``rows_per_range`` rows; there is no maximum.
    """
    if ranges is None:
        ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_range))
    if ranges <= 1:
        return df.withColumn(RANGE, F.lit(0))
    return settle(df.repartitionByRange(ranges, *keys).withColumn(RANGE, F.spark_partition_id()))


def global_row_number(df: DataFrame, keys: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """Dense 1-based position in the order of ``keys``, over the whole table."""
    cut = with_ranges(df, keys, ranges)
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    offsets = cut.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n")).select(
        RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = cut.withColumn("_rn", F.row_number().over(Window.partitionBy(RANGE).orderBy(*keys)))
    return (local.join(offsets, RANGE)
            .withColumn(name, (F.col("_rn") + F.col("_offset")).cast("long"))
            .drop("_rn", "_offset", RANGE))


def running(df: DataFrame, key: list[str], order: list[Column], features: dict[str, tuple[str, Column]],
            ranges: int | None = None, keep_ranges: bool = False) -> DataFrame:
    """Running features per key in the given order.

    ``features`` maps a name to (kind, column), with kinds

    - ``sum``/``max``/``min``: up to and including the row
    - ``before``: sum over the rows strictly before
    - ``prior_max``/``prior_min``: over the rows strictly before
    - ``lag``/``lead``: the previous or next row's value
    - ``last``: latest non-null value up to and including the row

    ``order`` is unique within a key. An input that already has ranges (from
    a previous call with ``keep_ranges``) is not cut again.
    """
    owned = [F.col(k) for k in key]
    cut = df if RANGE in df.columns else with_ranges(df, owned + order, ranges)
    values = {n: f"_v_{n}" for n in features}
    cut = cut.select("*", *[c.alias(values[n]) for n, (_, c) in features.items()])
    window = Window.partitionBy(RANGE, *key).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = _sort_key(order)

    local, totals, carries = [], [], []
    carry_window = Window.partitionBy(*key).orderBy(RANGE) if key else Window.orderBy(RANGE)
    before = carry_window.rowsBetween(Window.unboundedPreceding, -1)
    for n, (kind, _) in features.items():
        v, part, total = F.col(values[n]), f"_l_{n}", f"_t_{n}"
        if kind in ("sum", "before"):
            frame = upto if kind == "sum" else window.rowsBetween(Window.unboundedPreceding, -1)
            local.append(F.sum(v).over(frame).alias(part))
            totals.append(F.sum(v).alias(total))
            carries.append(F.sum(total).over(before).alias(f"_c_{n}"))
        elif kind in ("max", "min", "prior_max", "prior_min"):
            agg = F.max if kind.endswith("max") else F.min
            frame = window.rowsBetween(Window.unboundedPreceding, -1) if kind.startswith("prior") else upto
            local.append(agg(v).over(frame).alias(part))
            totals.append(agg(v).alias(total))
            carries.append(agg(total).over(before).alias(f"_c_{n}"))
        elif kind == "lag":
            local.append(F.lag(v).over(window).alias(part))
            totals.append(F.max_by(v, position).alias(total))
            carries.append(F.lag(total).over(carry_window).alias(f"_c_{n}"))
        elif kind == "lead":
            local.append(F.lead(v).over(window).alias(part))
            totals.append(F.min_by(v, position).alias(total))
            carries.append(F.lead(total).over(carry_window).alias(f"_c_{n}"))
        elif kind == "last":
            local.append(F.last(v, ignorenulls=True).over(upto).alias(part))
            totals.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(total))
            carries.append(F.last(total, ignorenulls=True).over(before).alias(f"_c_{n}"))
        else:
            raise ValueError(f"unknown kind {kind!r}")

    summary = cut.groupBy(RANGE, *key).agg(*totals)
    # Only the first and the last key of a range can reach over its edges, so at most two rows per range stay.
    spans = F.row_number().over(carry_window) > 1
    if any(kind == "lead" for kind, _ in features.values()):
        spans = spans | F.lead(F.lit(True)).over(carry_window).isNotNull()
    reach = summary.select(RANGE, *key, *carries, spans.alias("_spans")).where("_spans").drop("_spans")
    rows = cut.select("*", *local, F.row_number().over(window).alias("_rn"),
                      F.lead(F.lit(True)).over(window).isNull().alias("_end"))
    joined = rows.join(reach, [RANGE, *key], "left")

    out = {}
    for n, (kind, _) in features.items():
        part, carry = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind == "sum":
            out[n] = F.when(part.isNull() & carry.isNull(), None).otherwise(
                F.coalesce(part, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        elif kind == "before":
            out[n] = F.coalesce(part, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif kind.endswith("max"):
            out[n] = F.greatest(part, carry)
        elif kind.endswith("min"):
            out[n] = F.least(part, carry)
        elif kind == "lead":
            out[n] = F.when(F.col("_end"), carry).otherwise(part)
        elif kind == "lag":
            out[n] = F.when(F.col("_rn") == 1, carry).otherwise(part)
        else:
            out[n] = F.coalesce(part, carry)
    keep = [c for c in df.columns if c != RANGE] + ([RANGE] if keep_ranges else [])
    return joined.select(*keep, *[c.alias(n) for n, c in out.items()])


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keep-first dedup as an aggregate: map-side partials, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), _sort_key(order)).alias("_row"))
    return first.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def top_per_key(df: DataFrame, key: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per key; the limit also runs before the shuffle (window group limit)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def _reaches(order: list[tuple[Column, str]], edge: Column) -> Column:
    """Whether a row sorts before the edge or equals it; null is the least value, as in a plain sort."""
    out = F.lit(True)
    for i, (key, way) in reversed(list(enumerate(order))):
        value = edge[f"k{i}"]
        if way == "desc":
            before = F.coalesce(key > value, F.lit(False)) | (key.isNotNull() & value.isNull())
        else:
            before = F.coalesce(key < value, F.lit(False)) | (key.isNull() & value.isNotNull())
        out = before | (key.eqNullSafe(value) & out)
    return out


def first_rows(df: DataFrame, order: list[tuple[Column, str]], n: int, one_task_rows: int = ONE_TASK_ROWS,
               ranges: int | None = None) -> DataFrame:
    """The first n rows of the whole table; ``order`` pairs columns, unique together, with "asc" or "desc".

    Up to ``one_task_rows`` this is a sort with a limit. Beyond, no task holds
    the n rows: only the sort keys are cut into ranges, the range sizes tell
    which range the n-th row falls into, that range alone is ranked, and the
    n-th key then filters the table in place, without a shuffle of its rows.
    Nulls sort first ascending and last descending; a table of fewer rows comes whole. Should rows repeat
    the n-th key, all of them come.
    """
    by = [key.desc() if way == "desc" else key.asc() for key, way in order]
    if n <= one_task_rows:
        return df.orderBy(*by).limit(n)
    keys = df.select(*[key.alias(f"k{i}") for i, (key, _) in enumerate(order)])
    sort = [F.col(f"k{i}").desc() if way == "desc" else F.col(f"k{i}").asc() for i, (_, way) in enumerate(order)]
    cut = with_ranges(keys, sort, ranges)
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, of which at most one holds the n-th row.
    sizes = cut.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n")).select(
        RANGE, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    holder = sizes.where((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n)).select(RANGE, "_before")
    ranked = cut.join(holder, RANGE).withColumn("_rn", F.row_number().over(Window.partitionBy(RANGE).orderBy(*sort)))
    edge = ranked.where(F.col("_rn") + F.col("_before") == n).select(F.struct(*keys.columns)).scalar()
    return df.where(edge.isNull() | _reaches(order, edge))
