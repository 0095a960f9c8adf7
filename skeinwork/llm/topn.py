"""Top N items within every group by descending score bands.

Bands are ranges of the score, the first wide enough to fill most groups. They are worked off from the top: groups that
are full leave by anti-join, so the long tail of low scores is hardly touched, and in a group's boundary band the places
that are left go by exact rank over all order columns. Ranking keeps N rows of a group in every task before anything is
shuffled, so a group of any size fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.session import cut

GRID = 64


def band_edges(rows: DataFrame, group: str, score: str, n: int, widen: int = 4) -> list[float]:
    """Lower edges of all bands but the last: the first band expects twice the rows that fill all groups."""
    s = rows.agg(F.count("*").alias("rows"), F.approx_count_distinct(group).alias("groups"), F.percentile_approx(F.col(score).cast("double"), [i / GRID for i in range(1, GRID)], 1000).alias("grid")).first()
    edges, share = [], 2 * n * s["groups"] / max(1, s["rows"])
    while share < 1 and s["grid"]:
        edges.append(s["grid"][max(0, min(GRID - 2, round((1 - share) * GRID) - 1))])
        share *= widen
    return sorted(set(edges), reverse=True)


def top_n(rows: DataFrame, group: str, score: str, order: Sequence[Column], n: int = 10, edges: Sequence[float] | None = None, scanned: DataFrame | None = None) -> DataFrame:
    """The first n rows of each `group` by `order`, which must start with `score` descending and leave no ties.

    Score and group must not be null nor NaN. A group with fewer rows keeps them all; equal rows each take a place.
    `scanned`: rows with the same two columns to take the band edges from, where `rows` are costly to make; edges decide
    how much is worked off early, never what comes out. The anti-join and the ranking share one shuffle by group, and a hot
    group is full after its first band.
    """
    rows = rows.withColumn("__band", _band(score, edges if edges is not None else band_edges(rows if scanned is None else scanned, group, score, n)))
    rows = cut(rows, "bands", ["__band"])
    bands = sorted(r["__band"] for r in rows.select("__band").distinct().collect())
    ranked = Window.partitionBy(group).orderBy(*order)
    columns = [c for c in rows.columns if c != "__band"]
    done: DataFrame | None = None
    for band in bands:
        live = rows.filter(F.col("__band") == band).select(*columns)
        if done is not None:
            have = done.groupBy(group).agg(F.count("*").alias("__have"))
            live = live.join(have.filter(F.col("__have") >= n).select(group), group, "left_anti")
        live = live.withColumn("__rank", F.row_number().over(ranked)).filter(F.col("__rank") <= n)
        if done is not None:
            live = live.join(have, group, "left").filter(F.col("__rank") <= n - F.coalesce("__have", F.lit(0)))
        picked = live.select(*columns)
        if band == bands[-1]:
            return picked if done is None else done.unionByName(picked)
        picked = cut(picked, "picked")
        done = picked if done is None else done.unionByName(picked)
    return rows.select(*columns)


def _band(score: str, edges: Sequence[float]) -> Column:
    band = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        band = F.when(F.col(score) >= F.lit(edges[i]), i).otherwise(band)
    return band
