"""Windows, ranks and positions.

Windows here always have keys. Orders over a whole table go through `positions`, which never sorts it in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLITS = 128


def _ranges(df: DataFrame, column: str) -> Column:
    """Number of the value's range among quantiles of the column; nulls are range 0."""
    cuts = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / SPLITS for i in range(1, SPLITS)], 1000).alias("c")).first()["c"] or []
    known = sorted(set(cuts))
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(float(c)) for c in known]), lambda c: c < F.col(column))), F.lit(0)) if known else F.lit(0)


def positions(df: DataFrame, order: Sequence[str], name: str = "position", descending: bool = False) -> DataFrame:
    """Dense row numbers from 1 over the whole table by ascending (or all descending) columns, the first numeric.

    Ranges of the first column are numbered apart and shifted by the rows before them: at most SPLITS offsets.
    """
    r = df.withColumn("__range", _ranges(df, order[0]))
    first = F.desc("__range") if descending else F.asc("__range")
    before = r.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy(first)) - F.col("__n")).drop("__n")
    w = Window.partitionBy("__range").orderBy(*[F.desc(c) if descending else F.asc(c) for c in order])
    out = r.withColumn("__in", F.row_number().over(w)).join(F.broadcast(before), "__range")
    return out.withColumn(name, F.col("__in") + F.col("__before")).drop("__range", "__in", "__before")


def ranks(df: DataFrame, value: str, descending: bool = True) -> DataFrame:
    """Over the whole table: `below` rows come strictly before, `equal` rows share the value, `average_rank` of them,
    `percentile` (average rank over n), `strict_percentile` (share strictly before) and `rank_scaled` ((rank - 1) / (n - 1)).

    Equal values are one row while ranking. Null values get no rank.
    """
    n = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("equal"))
    n = n.withColumn("__range", _range_of(df, value, "__v"))
    first = F.desc("__range") if descending else F.asc("__range")
    totals = n.groupBy("__range").agg(F.sum("equal").alias("__t")).withColumn("__before", F.sum("__t").over(Window.partitionBy(F.lit(0)).orderBy(first)) - F.col("__t"))
    totals = totals.join(F.broadcast(totals.agg(F.sum("__t").alias("__all")))).drop("__t")
    w = Window.partitionBy("__range").orderBy(F.desc("__v") if descending else F.asc("__v"))
    n = n.join(F.broadcast(totals), "__range").withColumn("below", F.col("__before") + F.sum("equal").over(w) - F.col("equal"))
    average = F.col("below") + (F.col("equal") + 1) / 2
    n = n.select("__v", "below", "equal", average.alias("average_rank"), (average / F.col("__all")).alias("percentile"), (F.col("below") / F.col("__all")).alias("strict_percentile"), F.try_divide(average - 1, F.col("__all") - 1).alias("rank_scaled"))
    return df.join(n, F.col(value) == F.col("__v"), "left").drop("__v")


def _range_of(df: DataFrame, value: str, column: str) -> Column:
    return _ranges(df.select(F.col(value).alias(column)), column)


def rolling(by: Sequence[str], order: Sequence[Column], rows: int, shift: int = 0) -> WindowSpec:
    """The last `rows` rows up to `shift` rows before the current one."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1) - shift, -shift)


def ewm_mean(df: DataFrame, value: str, by: Sequence[str], order: Sequence[Column], halflife: float, name: str, block: int = 512) -> DataFrame:
    """Adds the exponentially weighted mean with adjusted weights over all rows before and at each one.

    A series is cut into blocks: within a block weights are prefix sums of powers of the row's place, and of what came
    before only the last block still counts (half a thousand rows further back a weight is below the precision of a double
    unless the half-life is long, so blocks grow with it). Nulls keep their place but carry no weight.
    """
    decay = 0.5 ** (1 / halflife)
    block = max(block, int(60 * halflife))
    w = Window.partitionBy(*by)
    r = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__b", F.floor(F.col("__i") / block)).withColumn("__p", (F.col("__i") % block).cast("double"))
    ones = F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    inside = Window.partitionBy(*by, "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    # Powers run from the row's place to the middle of its block, so that none leaves the range of a double.
    grow, shrink = F.pow(F.lit(decay), block / 2 - F.col("__p")), F.pow(F.lit(decay), F.col("__p") - block / 2)
    last = w.orderBy("__b").rangeBetween(-1, -1)
    to_end = F.pow(F.lit(decay), block - 1 - F.col("__p"))
    parts = [F.sum(c * grow).over(inside) * shrink + F.coalesce(F.sum(c * to_end).over(last), F.lit(0.0)) * F.pow(F.lit(decay), F.col("__p") + 1) for c in (x, ones)]
    return r.withColumn("__s", parts[0]).withColumn("__w", parts[1]).withColumn(name, F.when(F.col("__w") > 0, F.col("__s") / F.col("__w"))).drop("__i", "__b", "__p", "__s", "__w")


def average_rank(by: Sequence[str], order: Column, peers: Sequence[str]) -> Column:
    """Rank within the group, equal values sharing the mean of their places."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(order))
    return rank + (F.count("*").over(Window.partitionBy(*by, *peers)) - 1) / F.lit(2.0)


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key; Spark keeps k a task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def positions_by(df: DataFrame, by: Sequence[str], leading: str, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Row numbers within each key by `order`, which starts with the number `leading` descending, and `<name>_of` rows.

    A key is numbered in ranges of `leading`, each shifted by the rows before it, so a key with a third of all rows is
    spread over SPLITS tasks.
    """
    r = df.withColumn("__range", _ranges(df, leading))
    n = r.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    down = Window.partitionBy(*by).orderBy(F.desc("__range"))
    n = n.select(*by, "__range", (F.sum("__n").over(down) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias(f"{name}_of"))
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    return r.withColumn("__in", inside).join(n, [*by, "__range"]).withColumn(name, F.col("__in") + F.col("__before")).drop("__range", "__in", "__before")


def tail_holdout(df: DataFrame, by: Sequence[str], leading: str, order: Sequence[Column], part: int = 5) -> DataFrame:
    """Adds `held_out`: the last max(1, n // part) rows of each key; `order` runs from last to first (see positions_by)."""
    p = positions_by(df, by, leading, order, "__p")
    return p.withColumn("held_out", F.col("__p") <= F.greatest(F.lit(1), F.floor(F.col("__p_of") / part))).drop("__p", "__p_of")


def supervised_windows(df: DataFrame, by: Sequence[str], order: Sequence[Column], features: Sequence[str], target: str, steps: int) -> DataFrame:
    """(keys, window of the `steps` rows before, target one row on); rows without a full window or a target go."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = F.collect_list(F.struct(*features)).over(w.rowsBetween(-steps, -1))
    return df.withColumn("window", x).withColumn("y", F.lead(target, 1).over(w)).filter((F.size("window") == steps) & F.col("y").isNotNull())
