"""First matching rule of a table of (order, keyword, target), by an inverted index of q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchwork.session import settle

GRAM = 3
#: Texts whose grams tell which gram of a keyword is rare. The choice changes speed only.
SAMPLE_TEXTS = 2_000
#: An index of at most so many rules, and bytes of keywords, is sent to every task, so that grams aren't shuffled; a
#: larger one is joined by shuffle.
MOST_BROADCAST = 100_000
MOST_BROADCAST_BYTES = 64 << 20
#: So many of the first rules are tried on a text before its grams are taken. The choice changes speed only.
TRIED_FIRST = 256


def _grams(text: Column, sizes: list[int]) -> Column:
    """The distinct grams of these sizes. A look-ahead finds the longest ones, overlapping, in one pass; shorter ones are
    the beginnings of these and of the text's end."""
    most = max(sizes)
    longest = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * most}))."), F.lit(1)))

    def of(found: Column) -> Column:
        tail = [F.right(text, F.lit(k)) for k in range(1, most)]
        starts = F.concat(found, F.array(*tail)) if tail else found
        parts = [found if n == most else F.filter(F.transform(starts, lambda g: F.substring(g, 1, n)), lambda g: F.length(g) == n) for n in sizes]
        return F.array_distinct(F.concat(*parts)) if len(parts) > 1 else parts[0]
    return F.element_at(F.transform(F.array(longest), of), 1)


def _least_places(known: DataFrame, ranked: DataFrame, id: str, text: str, sizes: list[int]) -> DataFrame:
    """_id, _h (the text's hash) and _place: the least place of a rule that the text contains, null if there is none.

    The first rules are tried on every text; only texts without any of them are cut into grams. A text stays beside its
    grams, so rules are tested where they are met, and a number is all that is kept of them.
    """
    first = ranked.where(F.col("_place") < TRIED_FIRST).select("_place", F.col("_k").cast("binary").alias("k")).collect()
    tried = F.array(*[F.struct(F.lit(r["_place"]).cast("long").alias("p"), F.lit(bytes(r["k"])).cast("string").alias("k")) for r in sorted(first)])
    early = F.array_min(F.transform(F.filter(tried, lambda r: F.col(text).contains(r["k"])), lambda r: r["p"]))
    # Exploded from a list of one, so that it is evaluated once.
    keyed = known.select(F.col(id).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("_x"), F.explode(F.array(early)).alias("_early"))
    grams = keyed.select("*", F.explode_outer(F.when(F.col("_early").isNull(), _grams(F.col("_x"), sizes))).alias("_g"))
    met = grams.join(F.broadcast(ranked.select("_g", "_k", "_place")), "_g", "left")
    place = F.coalesce("_early", F.when(F.col("_x").contains(F.col("_k")), F.col("_place")))
    return met.select("_id", "_h", place.alias("_place")).groupBy("_id", "_h").agg(F.min("_place").alias("_place"))


def first_rule(texts: DataFrame, rules: DataFrame, id: str, text: str, order: str = "order", keyword: str = "keyword",
               target: str = "target", gram: int = GRAM) -> DataFrame:
    """texts with ``target`` of the first rule, by ``order``, whose keyword the text contains; null if there is none.

    Each rule is posted under the rarest of its grams (shorter keywords under
    themselves), texts meet it there, and ``contains`` decides among the rules
    met. So the work follows the rules that share a rare gram with a text, not
    texts times rules. An index within ``MOST_BROADCAST`` is sent to the tasks,
    and of each text only the place of its first rule is shuffled. A larger one
    meets the grams in a shuffle, and the rules met are one list per text.

    An empty keyword is in every text that isn't null, a null keyword in none.
    Texts of equal id are told apart by their content; a null id is an id.
    Of equal orders the smaller target wins. Case matters; lower both sides first.
    """
    posted = rules.where(F.length(keyword) > 0).select(F.col(order).alias("_o"), F.col(keyword).alias("_k"), F.col(target).alias("_t"),
                                                       F.least(F.length(keyword), F.lit(gram)).alias("_size"))
    sizes = sorted(r["_size"] for r in posted.select("_size").distinct().collect())
    always = rules.where(F.length(keyword) == 0).agg(F.min(F.struct(F.col(order).alias("o"), F.col(target).alias("t"))).alias("x"))
    fallback = always.first()["x"]
    best = f"struct<o:{rules.schema[order].dataType.simpleString()},t:{rules.schema[target].dataType.simpleString()}>"
    kind = rules.schema[target].dataType
    if not sizes:
        hit = F.lit(None if fallback is None else fallback["t"]).cast(kind)
        return texts.withColumn(target, F.when(F.col(text).isNotNull(), hit))
    own = F.when(F.col("_size") == sizes[0], _grams(F.col("_k"), sizes[:1]))
    for n in sizes[1:]:
        own = own.when(F.col("_size") == n, _grams(F.col("_k"), [n]))
    known = texts.where(F.col(text).isNotNull())
    common = (known.limit(SAMPLE_TEXTS).select(F.explode(_grams(F.col(text), sizes)).alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("_n")))
    choices = posted.select("_o", "_k", "_t", F.explode(own).alias("_g")).join(common, "_g", "left")
    rarest = F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_g"))
    index = settle(choices.groupBy("_o", "_k", "_t").agg(rarest.alias("_g")))
    spare = F.lit(None).cast(best)
    if fallback is not None:
        spare = F.struct(F.lit(fallback["o"]).alias("o"), F.lit(fallback["t"]).alias("t")).cast(best)
    size = index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_k").cast("long")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= MOST_BROADCAST and size["bytes"] <= MOST_BROADCAST_BYTES:
        # One task numbers the rules: no more than are broadcast.
        ranked = settle(index.withColumn("_place", F.row_number().over(Window.orderBy("_o", "_t", "_k")).cast("long") - 1))
        hits = ranked.select("_place", F.struct(F.col("_o").alias("o"), F.col("_t").alias("t")).cast(best).alias("_hit"))
        least = _least_places(known, ranked, id, text, sizes)
        # The text's hash is a column before the join, so that the join carries texts only for a caller that wants them.
        held = texts.withColumns({"_own": F.xxhash64(text), "_some": F.col(text).isNotNull()})
        placed = held.join(least, F.col(id).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_h")), "left").join(F.broadcast(hits), "_place", "left")
        chosen = F.when(F.col("_some"), F.least("_hit", spare))
        return placed.select(*texts.columns, chosen["t"].alias(target))
    keyed = known.select(F.col(id).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("_x"))
    met = (keyed.select("_id", "_h", F.explode(_grams(F.col("_x"), sizes)).alias("_g")).join(index, "_g").groupBy("_id", "_h")
           .agg(F.array_sort(F.collect_set(F.struct("_o", "_t", "_k"))).alias("_met")))
    joined = texts.join(met, F.col(id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_h")), "left")
    # A column of its own: written into the expressions below it would be evaluated for each use.
    joined = joined.withColumn("_hit", F.get(F.filter("_met", lambda r: F.col(text).contains(r["_k"])), F.lit(0)))
    found = F.when(F.col("_hit").isNotNull(), F.struct(F.col("_hit._o").alias("o"), F.col("_hit._t").alias("t")).cast(best))
    chosen = F.when(F.col(text).isNotNull(), F.least(found, spare))
    return joined.select(*texts.columns, chosen["t"].alias(target))
