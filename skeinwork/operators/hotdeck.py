"""Filling missing values from similar records: hash-blocked nearest-neighbour hot-deck.

Donors are not compared in pairs. The distance of a recipient to a donor is the weight of the features on which they do not
agree (categories as they are, numbers in bins; a feature that is not observed agrees with nothing). Donors that agree on a
given set of features are one hash block, so a recipient's nearest donors are those of the block of the set that gives up
least and has any: `by_distance` lists the sets from near to far. Within the block the weighted majority (categories) or the
weighted median (numbers) of the donors' values is copied, and a donor that has it is named.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.operators.skew import HOT_ROWS, hot_split_join
from skeinwork.session import cut


@dataclass(frozen=True)
class Fill:
    """`value` is null where the cell is missing. Each level, near to far: feature expressions, null if not observed.
    `distances`: what each level gives up; its number if there are none."""

    name: str
    value: Column
    levels: Sequence[Sequence[Column]]
    kind: str = "category"
    weight: Column = field(default_factory=lambda: F.lit(1))
    distances: Sequence[float] = ()


def by_distance(required: Sequence[Column], optional: Sequence[tuple[Column, float]]) -> tuple[list[list[Column]], list[float]]:
    """Levels and distances for a `Fill`: all sets of the optional features with the required ones, by the weight given up."""
    sets = []
    for mask in range(1 << len(optional)):
        kept = [c for i, (c, _) in enumerate(optional) if mask >> i & 1]
        sets.append((sum(w for i, (_, w) in enumerate(optional) if not mask >> i & 1), -mask, [*required, *kept]))
    sets.sort(key=lambda x: x[:2])
    return [features for _, _, features in sets], [float(w) for w, _, _ in sets]


def binned(c: Column, width: float) -> Column:
    """A number as a block feature."""
    return F.floor(c / F.lit(width)).cast("string")


def weighted_median(values: DataFrame, by: list[str], value: str, weight: str, splits: int = 64) -> DataFrame:
    """Lower weighted median of `value` in each group, exact, however large the group.

    A sketch cuts each group into `splits` ranges, the weights of the ranges find the one that holds the median,
    and only that range is sorted. Rows of equal value are one row by then, so ties cannot swell it.
    """
    merged = values.groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    cuts = merged.groupBy(*by).agg(F.percentile_approx(value, [i / splits for i in range(1, splits)], 1000).alias("__cuts"), F.sum("__w").alias("__total"))
    ranged = merged.join(cuts, by).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    w = Window.partitionBy(*by).orderBy("__range")
    sums = ranged.groupBy(*by, "__range", "__total").agg(F.sum("__w").alias("__rw")).withColumn("__before", F.sum("__rw").over(w) - F.col("__rw"))
    there = sums.filter((F.col("__before") * 2 < F.col("__total")) & ((F.col("__before") + F.col("__rw")) * 2 >= F.col("__total"))).select(*by, "__range", "__before")
    inside = ranged.join(there, [*by, "__range"]).withColumn("__cum", F.col("__before") + F.sum("__w").over(Window.partitionBy(*by).orderBy(value)))
    return inside.filter(F.col("__cum") * 2 >= F.col("__total")).groupBy(*by).agg(F.min(value).alias(value))


def _block(features: Sequence[Column]) -> Column:
    """Null unless all features are observed. The text, not a hash of it, is the key: no collisions."""
    strings = [f.cast("string") for f in features]
    return F.when(~F.exists(F.array(*strings), lambda x: x.isNull()), F.to_json(F.array(*strings)))


def _placed(df: DataFrame, fill: Fill, **columns: Column) -> DataFrame:
    """The rows once for each level at which they have a block: level, __block and the columns."""
    named = [c.alias(n) for n, c in columns.items()]
    if len(fill.levels) == 1:
        return df.select(F.lit(1).alias("level"), _block(fill.levels[0]).alias("__block"), *named).filter(F.col("__block").isNotNull())
    every = F.array(*[F.struct(F.lit(i).alias("level"), _block(features).alias("__block")) for i, features in enumerate(fill.levels, 1)])
    return df.select(F.explode(F.filter(every, lambda x: x["__block"].isNotNull())).alias("__x"), *named).select("__x.*", *columns)


def donors(df: DataFrame, row_id: str, fill: Fill) -> DataFrame:
    """(level, __block, filled_value, donor_id, n_donors, __missing) of the blocks that have a donor and a recipient.

    donor_id: the smallest row id among the donors with the value that is copied.
    """
    key = ["level", "__block"]
    tallies = _placed(df, fill, __id=F.col(row_id), __v=fill.value, __w=fill.weight).groupBy(*key, "__v").agg(F.count("*").alias("__n"), F.sum("__w").alias("__w"), F.min("__id").alias("__donor"))
    blocks = tallies.groupBy(*key).agg(
        F.min(F.when(F.col("__v").isNotNull(), F.struct((-F.col("__w")).alias("w"), F.col("__v").alias("v"), F.col("__donor").alias("d")))).alias("__best"),
        F.sum(F.when(F.col("__v").isNotNull(), F.col("__n")).otherwise(0)).alias("n_donors"),
        F.sum(F.when(F.col("__v").isNull(), F.col("__n")).otherwise(0)).alias("__missing"),
    )
    blocks = blocks.filter((F.col("n_donors") > 0) & (F.col("__missing") > 0))
    if fill.kind == "category":
        return blocks.select(*key, F.col("__best.v").alias("filled_value"), F.col("__best.d").alias("donor_id"), "n_donors", "__missing")
    known = tallies.filter(F.col("__v").isNotNull()).join(blocks.select(*key), key, "left_semi")
    medians = weighted_median(known, key, "__v", "__w").join(known.select(*key, "__v", F.col("__donor").alias("donor_id")), [*key, "__v"])
    return blocks.drop("__best").join(medians.withColumnRenamed("__v", "filled_value"), key).select(*key, "filled_value", "donor_id", "n_donors", "__missing")


def hot_deck(df: DataFrame, row_id: str, fill: Fill, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(row_id, field_name, filled_value, level, distance, n_donors, donor_id): one row per missing cell that has a donor.

    Majority ties go to the smallest value. A recipient whose features are all unobserved, or whose blocks have no
    donor, gets no row. Rows with equal `row_id` are filled each. An empty table gives no row. All levels are worked off
    together: one pass tallies the donors, one brings each recipient its nearest level.
    """
    found = cut(donors(df, row_id, fill), "donors")
    rest = df.filter(fill.value.isNull())
    several = len(fill.levels) > 1
    if several:  # numbered in a written table, so that a lost task finds the same numbers
        names = [f"__f{i}" for i in range(len(fill.levels))]
        rest = cut(rest.select(F.col(row_id).alias("__id"), F.monotonically_increasing_id().alias("__n"), *[_block(features).alias(n) for n, features in zip(names, fill.levels, strict=True)]), "waiting")
        every = F.array(*[F.struct(F.lit(i).alias("level"), F.col(n).alias("__block")) for i, n in enumerate(names, 1)])
        waiting = rest.select("__id", "__n", F.explode(F.filter(every, lambda x: x["__block"].isNotNull())).alias("__x")).select("__id", "__n", "__x.*")
    else:
        waiting = _placed(rest, fill, __id=F.col(row_id))
    got = hot_split_join(waiting, found, ["level", "__block"], "__missing", hot_rows)
    columns = ["filled_value", "level", "n_donors", "donor_id"]
    if several:
        got = got.groupBy("__n", "__id").agg(F.min_by(F.struct(*columns), "level").alias("__x")).select("__id", "__x.*")
    distances = F.array(*[F.lit(float(x)) for x in (fill.distances or range(len(fill.levels)))])
    return got.select(F.col("__id").alias(row_id), F.lit(fill.name).alias("field_name"), "filled_value", "level", F.element_at(distances, F.col("level")).alias("distance"), "n_donors", "donor_id")
