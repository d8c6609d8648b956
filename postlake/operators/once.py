"""Work on texts done once for equal inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.plans.cut import cut

#: Bytes of keys up to which the results are broadcast; beyond that the same join is shuffled.
BROADCAST_BYTES = 2_000_000


def once(df: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns that ``work`` adds to a frame of the string columns ``keys``: every different combination
    of their values (nulls are values) goes through ``work`` once, which depends on nothing else and keeps the keys.

    Combinations are brought together before they move. A frame of many repeats costs one pass and a small join; where
    all rows differ the keys are shuffled and the work is that of all rows. For batch frames."""
    known = work(df.select(*keys).distinct())
    added = [c for c in known.columns if c not in keys]
    named = cut(known.select(*[F.col(k).alias(f"_once_{k}") for k in keys], *added))
    held = named.agg(F.sum(sum((F.coalesce(F.octet_length(f"_once_{k}"), F.lit(0)) for k in keys), F.lit(100)))).first()[0] or 0
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_once_{k}"))
    return df.join(F.broadcast(named) if held <= BROADCAST_BYTES else named, same).drop(*[f"_once_{k}" for k in keys])
