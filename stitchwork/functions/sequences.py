"""Training sequences: supervised spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_prefix(ids: Column, prefix: Column, cap: int) -> Column:
    """Ids and labels; prefix labels are -100, both sides are cut to ``cap``."""
    labels = F.concat(F.array_repeat(F.lit(-100).cast("long"), prefix),
                      F.slice(ids, prefix + 1, F.greatest(F.size(ids) - prefix, F.lit(0))))
    return F.struct(F.slice(ids, 1, cap).alias("input_ids"), F.slice(labels, 1, cap).alias("labels"))
