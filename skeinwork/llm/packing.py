"""Filling fixed-capacity containers: linear grouping, few-size configurations, then best fit.

Pieces longer than an eighth of the capacity are large. Their lengths are cut into groups of equal cardinality and rounded
up to the longest of the group; column generation finds the best fractional use of configurations of so few sizes, which is
rounded down and completed. Actual documents take the places of their group by rank, which is arithmetic on a table of a few
thousand rows, so no container is ever built on the driver. The small pieces then fill what is free by best fit, in shards.
Only a table of lengths up to the capacity and their counts reaches the driver: at most `capacity` rows.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.session import cut

GROUPS = 24
SMALL = 1 / 8
#: Rows of a shard of best fit, and of a bucket in which pieces of one length are ranked.
SHARD_ROWS = 200_000


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, int, int, int]]:
    """(length, first rank in the length, pieces, group), longest first; groups are equal to one piece."""
    total = sum(counts.values())
    out, done = [], 0
    for length in sorted(counts, reverse=True):
        at = 0
        while at < counts[length]:
            group = done * groups // total
            take = min(counts[length] - at, -(-(group + 1) * total // groups) - done)
            out.append((length, at, take, group))
            at += take
            done += take
    return out


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration that fits: unbounded knapsack by dynamic programming over the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = sizes <= room
        gains = np.where(fits, values + best[room - np.where(fits, sizes, 0)], -1.0)
        i = int(gains.argmax())
        if gains[i] > best[room - 1] + 1e-12:
            best[room], last[room] = gains[i], i
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 5_000) -> list[tuple[np.ndarray, int]]:
    """(configuration, times used) that holds exactly `demand` pieces of each size."""
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = best_pattern(duals, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        move = np.linalg.solve(basis, pattern.astype(float))
        ratios = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = pattern
        x = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    else:
        warnings.warn(f"configurations still improve after {rounds} rounds", stacklevel=2)
    used = [(basis[:, j].round().astype(np.int64), int(x[j] + 1e-6)) for j in range(len(sizes))]
    left = demand.astype(np.int64).copy()
    plan = []
    for pattern, times in used:
        if times:
            times = min([times, *(left[pattern > 0] // pattern[pattern > 0])])
            left -= pattern * times
            if times:
                plan.append((pattern, int(times)))
    return plan + [(p, 1) for p in _first_fit(sizes, left, capacity)]


def _first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """What rounding down left over, less than one configuration a size, first fit by decreasing size."""
    bins: list[tuple[int, np.ndarray]] = []
    for i in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[i])):
            for k, (room, pattern) in enumerate(bins):
                if room >= sizes[i]:
                    pattern[i] += 1
                    bins[k] = (room - int(sizes[i]), pattern)
                    break
            else:
                pattern = np.zeros(len(sizes), dtype=np.int64)
                pattern[i] = 1
                bins.append((capacity - int(sizes[i]), pattern))
    return [p for _, p in bins]


def places(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """((length, first rank, last rank + 1, shift, container, times)...), containers.

    A piece of that length and rank r has the container `container + (r + shift) % times`.
    """
    if not counts:
        return [], 0
    segments = linear_groups(counts, min(groups, sum(counts.values())))
    rounded: dict[int, int] = {}
    for length, _, _, group in segments:
        rounded.setdefault(group, length)
    sizes = np.array(sorted(set(rounded.values()), reverse=True), dtype=np.int64)
    which = {g: int(np.nonzero(sizes == s)[0][0]) for g, s in rounded.items()}
    demand = np.zeros(len(sizes), dtype=np.int64)
    for _, _, n, group in segments:
        demand[which[group]] += n
    slots: list[list[tuple[int, int, int, int]]] = [[] for _ in sizes]
    container, filled = 0, np.zeros(len(sizes), dtype=np.int64)
    for pattern, times in configurations(sizes, demand, capacity):
        for i in np.nonzero(pattern)[0]:
            n = int(pattern[i]) * times
            slots[i].append((int(filled[i]), int(filled[i]) + n, container, times))
            filled[i] += n
        container += times
    out, begun = [], np.zeros(len(sizes), dtype=np.int64)
    for length, first, n, group in segments:
        i = which[group]
        low = int(begun[i])
        for a, b, base, times in slots[i]:
            f, t = max(a, low), min(b, low + n)
            if f < t:
                out.append((length, first + f - low, first + t - low, low - first - a, base, times))
        begun[i] += n
    return out, container


def _ranked(pieces: DataFrame, total: int, shard_rows: int) -> DataFrame:
    """Dense ranks of the pieces of each length, without bringing a length to one task."""
    buckets = max(1, -(-total // shard_rows))
    p = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = p.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")) - 1
    return p.withColumn("inside", inside).join(before, ["n_tokens", "bucket"]).withColumn("rank", F.col("inside") + F.col("before")).drop("inside", "before", "bucket")


def _best_fit(capacity: int, shards: int, large: int):
    def run(free: pd.DataFrame, small: pd.DataFrame) -> pd.DataFrame:
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        open_rooms = 0
        for c, room in zip(free["container"].tolist(), free["room"].tolist(), strict=True):
            by_room[room].append(c)
            open_rooms |= 1 << room
        small = small.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        shard = int(small["shard"].iloc[0]) if len(small) else 0
        new, into = 0, []
        for size in small["n_tokens"].tolist():
            fitting = open_rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                c = by_room[room].pop()
                if not by_room[room]:
                    open_rooms &= ~(1 << room)
            else:
                room, c = capacity, large + new * shards + shard
                new += 1
            into.append(c)
            by_room[room - size].append(c)
            if room > size:
                open_rooms |= 1 << (room - size)
        return pd.DataFrame({"doc_id": small["doc_id"], "piece": small["piece"], "n_tokens": small["n_tokens"], "container": into}).astype({"container": "int64"})

    return run


def pack(sizes: DataFrame, capacity: int, groups: int = GROUPS, small: float = SMALL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, container) of (doc_id, n_tokens).

    Only a document of more than `capacity` tokens is split, into full pieces and a rest. A document without tokens needs no
    room: it has one row of size 0 and a null container. doc_id must be unique. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    sizes = cut(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("size")), "sizes")
    pieces = sizes.filter("size > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1)))
    pieces = cut(pieces.select("doc_id", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).alias("n_tokens")), "pieces")
    lengths = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    limit = int(capacity * small)
    counts = {k: n for k, n in lengths.items() if k > limit}
    plan, large = places(counts, capacity, groups)
    table = spark.createDataFrame(plan, "length long, low long, high long, shift long, base long, times long")
    ranked = _ranked(pieces.filter(F.col("n_tokens") > limit), max(1, sum(counts.values())), shard_rows)
    t = F.broadcast(table)
    placed = ranked.join(t, (ranked["n_tokens"] == t["length"]) & (ranked["rank"] >= t["low"]) & (ranked["rank"] < t["high"]))
    placed = cut(placed.select("doc_id", "piece", "n_tokens", (F.col("base") + F.pmod(F.col("rank") + F.col("shift"), F.col("times"))).alias("container")), "placed")
    n_small = sum(n for k, n in lengths.items() if k <= limit)
    shards = max(1, -(-(n_small + large) // shard_rows))
    free = placed.groupBy("container").agg((F.lit(capacity) - F.sum("n_tokens")).cast("int").alias("room")).filter("room > 0").withColumn("shard", F.pmod(F.xxhash64("container"), F.lit(shards)))
    little = pieces.filter(F.col("n_tokens") <= limit).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    fitted = free.groupBy("shard").cogroup(little.groupBy("shard")).applyInPandas(_best_fit(capacity, shards, large), little.select("doc_id", "piece", "n_tokens").schema.simpleString()[7:-1].replace(":", " ") + ", container long")
    packed = placed.unionByName(fitted).withColumn("start_token", F.col("piece").cast("long") * capacity)
    none = sizes.filter("size = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("container"), F.lit(0).cast("long").alias("start_token"))
    return packed.unionByName(none).select("doc_id", "piece", "start_token", "n_tokens", "container")


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the fewest containers that could hold them, and the share of room used."""
    per = packed.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("used").alias("fullest"), F.ceil(F.sum("used") / capacity).alias("fewest_possible"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"))
