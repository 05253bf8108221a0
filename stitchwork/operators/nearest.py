"""Nearest-neighbour join against a table of anchors, by rings of grid cells."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.session import settle

#: A bound must be beaten by more than this share, so that rounding of cell borders loses no anchor.
SLACK = 1e-9


def _usable(at: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).isNotNull() & ~F.isnan(c) for c in at])


def _square(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)])


def nearest_anchor(points: DataFrame, anchors: DataFrame, at: list[str], order: str, value: str) -> DataFrame:
    """points with ``value`` of the nearest anchor (Euclidean in the double columns ``at``); of equals the least ``order``.

    Points and anchors are cut to their distinct places first, so a place that
    owns a third of the rows is searched once. Anchors are posted in grid
    cells, one anchor to a cell on average. A point starts at the cell of its
    projection into the anchors' box and asks ring after ring of cells, each an
    equi-join, until no anchor further out can be nearer: one beyond ring k is
    at least k cells from the projection, and the projection's own distance
    adds to that squared. So there are at most as many rings as the grid has
    cells along its longest side, and all but outlying points end after one or
    two. Every round is written to the checkpoint folder.

    A point with a null or NaN coordinate, and every point if there is no
    anchor, gets null. Anchors with a null or NaN coordinate are left out.
    """
    # Places are written before they are tested: a test in front would hold each coordinate's expression several times.
    unique = settle(anchors.groupBy(*at).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("_first"))).where(_usable(at))
    box = unique.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in at for f in (F.min, F.max)]).first()
    kind = anchors.schema[value].dataType
    if not box["n"]:
        return points.withColumn(value, F.lit(None).cast(kind))
    low, high = {c: box[f"min_{c}"] for c in at}, {c: box[f"max_{c}"] for c in at}
    extent = max(high[c] - low[c] for c in at)
    cell = extent / max(1.0, box["n"] ** (1 / len(at))) or 1.0
    last_ring = max(int((high[c] - low[c]) / cell) + 1 for c in at)
    cells = [f"_cell_{c}" for c in at]
    place = lambda c, x: F.floor((x - F.lit(low[c])) / F.lit(cell)).cast("int")
    posted = settle(unique.select(*[F.col(c).alias(f"_anchor_{c}") for c in at], "_first", *[place(c, F.col(c)).alias(n) for c, n in zip(at, cells)]))

    near = {c: F.least(F.greatest(F.col(c), F.lit(low[c])), F.lit(high[c])) for c in at}
    best = f"struct<d:double,f:{unique.schema['_first'].dataType.simpleString()}>"
    spots = settle(points.select(*at).distinct()).where(_usable(at))
    open_ = settle(spots.select(*at, _square([F.col(c) for c in at], [near[c] for c in at]).alias("_outside"),
                                *[place(c, near[c]).alias(f"_home_{c}") for c in at], F.lit(None).cast(best).alias("_best")))
    found, ring = [], 1
    while True:
        steps = [s for s in product(range(-ring, ring + 1), repeat=len(at)) if ring == 1 or max(map(abs, s)) == ring]
        offsets = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(at, s)]) for s in steps])
        asked = (open_.select(*at, *[f"_home_{c}" for c in at], F.explode(offsets).alias("_step"))
                 .select(*at, *[(F.col(f"_home_{c}") + F.col(f"_step.{c}")).alias(n) for c, n in zip(at, cells)]))
        distance = _square([F.col(c) for c in at], [F.col(f"_anchor_{c}") for c in at])
        nearer = (asked.join(posted, cells).groupBy(*at)
                  .agg(F.min(F.struct(distance.alias("d"), F.col("_first").alias("f"))).alias("_new")))
        bound = F.col("_outside") + F.lit((ring * cell) ** 2)
        ended = F.col("_best").isNotNull() & (F.col("_best.d") < bound * (1 - SLACK)) if ring < last_ring else F.lit(True)
        open_ = settle(open_.join(nearer, at, "left").withColumn("_best", F.least("_best", "_new").cast(best)).drop("_new")
                       .withColumn("_ended", ended))
        found.append(open_.where("_ended").select(*at, F.col("_best.f.v").alias(value)))
        open_ = open_.where("NOT _ended").drop("_ended")
        if ring >= last_ring or open_.isEmpty():
            break
        ring += 1
    answers = reduce(DataFrame.unionByName, found)
    return points.join(answers, at, "left").select(*points.columns, value)
