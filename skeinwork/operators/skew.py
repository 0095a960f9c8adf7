"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more rows than this. N rows hold at most N / HOT_ROWS hot keys, so 10^11 rows have
#: at most 10^5 of them: the side that is broadcast is bounded by arithmetic, not by hope.
HOT_ROWS = 1_000_000


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def hot_split_join(facts: DataFrame, dim: DataFrame, keys: list[str], rows: str, hot_rows: int = HOT_ROWS, null_safe: bool = False) -> DataFrame:
    """Inner join of many `facts` to `dim`, unique on `keys`, whose column `rows` counts the facts of each key.

    Hot keys are joined by broadcast and never shuffled, the others by shuffle. `dim` is read up to three
    times, so give a written table. `rows` is not in the result. Null keys match only if `null_safe`.
    """
    hot = dim.filter(F.col(rows) > hot_rows).drop(rows)

    def joined(f: DataFrame, d: DataFrame) -> DataFrame:
        if not null_safe:
            return f.join(d, keys)
        d2 = d.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in d.columns if c not in keys])
        on = reduce(lambda a, b: a & b, [f[k].eqNullSafe(d2[f"__{k}"]) for k in keys])
        return f.join(d2, on).drop(*[f"__{k}" for k in keys])

    if hot.isEmpty():
        return joined(facts, dim.drop(rows))
    anti = hot.select(*[F.col(k).alias(f"__{k}") for k in keys])
    cold_facts = facts.join(F.broadcast(anti), reduce(lambda a, b: a & b, [facts[k].eqNullSafe(anti[f"__{k}"]) for k in keys]), "left_anti")
    return joined(cold_facts, dim.filter(F.col(rows) <= hot_rows).drop(rows)).unionByName(joined(facts, F.broadcast(hot)))
