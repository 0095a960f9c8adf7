"""Consolidating pairwise matches into groups by randomised contraction.

Each round every vertex hooks to the vertex of its closed neighbourhood that comes first in a hash order drawn afresh,
edges are relabelled and made distinct, and loops vanish. A constant share of the vertices goes each round whatever
the graph's shape, so chains are as quick as stars. The mappings of the rounds are then expanded from the last back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.skew import HOT_ROWS, hot_split_join
from skeinwork.session import cut, drop_cut


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _hooks(edges: DataFrame, salt: int) -> DataFrame:
    """(v, r, n): each vertex, the vertex it hooks to, and its edges. Combined before the shuffle, so hubs are cheap."""
    order = lambda c: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("v"))
    both = edges.select(F.col("u").alias("v"), F.col("v").alias("w")).unionByName(edges.select("v", F.col("u").alias("w")))
    near = both.groupBy("v").agg(F.min(order("w")).alias("best"), F.count("*").alias("n"))
    return near.select("v", F.least(F.col("best"), order("v"))["v"].alias("r"), "n")


def components(edges: DataFrame, hot_rows: int = HOT_ROWS, max_rounds: int = 200) -> DataFrame:
    """(group_id, member) of every vertex of `edges` (u, v); group_id is the smallest member.

    Null ends, loops and repeated edges are left out; a vertex with no other edge is in no group. No edges, no rows.
    """
    edges = cut(_ordered(edges.select("u", "v").dropna()), "edges")
    rounds: list[tuple[DataFrame, bool]] = []
    while not edges.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError("no end after max_rounds rounds")
        hooks = cut(_hooks(edges, 7919 * len(rounds) + 17), "hooks")
        rounds.append((hooks, not hooks.filter(F.col("n") > hot_rows).isEmpty()))
        u = hooks.select(F.col("v").alias("u"), F.col("r").alias("ru"), "n")
        v = hooks.select("v", F.col("r").alias("rv"), "n")
        if rounds[-1][1]:
            moved = hot_split_join(hot_split_join(edges, u, ["u"], "n", hot_rows), v, ["v"], "n", hot_rows)
        else:
            moved = edges.join(u.drop("n"), "u").join(v.drop("n"), "v")
        after = cut(_ordered(moved.select(F.col("ru").alias("u"), F.col("rv").alias("v"))), "edges")
        drop_cut(edges)
        edges = after
    if not rounds:
        return edges.select(F.col("u").alias("group_id"), F.col("v").alias("member"))
    labels = rounds[-1][0].select("v", F.col("r").alias("root"))
    for hooks, hot in reversed(rounds[:-1]):
        later = labels.withColumnRenamed("v", "r")
        if hot:
            ends = cut(hooks.select(F.col("v").alias("r"), "n").join(later, "r", "left").select("r", F.coalesce("root", "r").alias("root"), "n"), "ends")
            labels = hot_split_join(hooks.select("v", "r"), ends, ["r"], "n", hot_rows).select("v", "root")
        else:
            labels = hooks.select("v", "r").join(later, "r", "left").select("v", F.coalesce("root", "r").alias("root"))
    labels = cut(labels, "labels")
    names = cut(labels.groupBy("root").agg(F.min("v").alias("group_id"), F.count("*").alias("n")), "names")
    return hot_split_join(labels, names, ["root"], "n", hot_rows).select("group_id", F.col("v").alias("member"))


def shared_key_edges(rows: DataFrame, key: str, member: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (u, v) that link all members of each key through its smallest one: a star, never all pairs of a key."""
    pairs = cut(rows.select(F.col(key).alias("k"), F.col(member).alias("u")).dropna().distinct(), "pairs")
    hubs = cut(pairs.groupBy("k").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1"), "hubs")
    return hot_split_join(pairs, hubs, ["k"], "n", hot_rows).filter("u <> v").select("u", "v")
