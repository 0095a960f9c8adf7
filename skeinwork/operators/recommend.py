"""Candidates, blending and re-ranking of recommendations, and their evaluation.

`recs` are (user, item, rank), `truth` is (user, item). Missing or empty truth scores 0 everywhere.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions import arrays
from skeinwork.operators.ordered import first_rows
from skeinwork.session import cut


# --- building blocks -------------------------------------------------------------------------------------------------


def exact_knn(vectors: DataFrame, key: str, vector: str, k: int, block_rows: int = 2048, metric: str = "cosine", asked: DataFrame | None = None) -> DataFrame:
    """(id, neighbor, score, rank) by cosine (or `euclid`: minus the distance) over all pairs, in blocks of about
    `block_rows`: each pair of blocks is one matrix product that keeps its k best a row, and the partial lists are merged.
    A task's memory does not grow with the table. Quadratic by nature: for collections beyond some hundred thousand vectors
    use an index. `asked`: rows of the same columns whose neighbours are wanted, all if None.
    """
    asked = vectors if asked is None else asked
    blocks = max(1, -(-vectors.count() // block_rows))
    asking = blocks if asked is vectors else max(1, -(-asked.count() // block_rows))
    slot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    left = asked.select(F.col(key).alias("id"), F.col(vector).alias("v")).withColumn("b", slot(asking)).withColumn("c", every(blocks))
    right = v.withColumn("rc", slot(blocks)).select(F.col("id").alias("rid"), F.col("v").alias("rv"), "rc", every(asking).alias("rb"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"id": [], "neighbor": [], "score": []}
        if len(a) and len(b):
            x, y = (np.stack(z).astype(np.float64) for z in (a["v"], b["rv"]))
            names, other = a["id"].to_numpy(), b["rid"].to_numpy()
            if metric == "cosine":
                x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
                s = np.round(x @ y.T, 9)
            else:
                s = np.round(-np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)), 9)
            s[names[:, None] == other[None, :]] = -np.inf
            # All that reach the k-th best; only these are sorted, ties by name.
            least = np.partition(s, -k, axis=1)[:, -k, None] if s.shape[1] > k else -np.inf
            i, j = np.nonzero((s >= least) & np.isfinite(s))
            order = np.lexsort((other[j], -s[i, j], i))
            i, j = i[order], j[order]
            top = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
            out = {"id": names[i[top]], "neighbor": other[j[top]], "score": s[i[top], j[top]]}
        return pd.DataFrame(out).astype({"score": "float64"})

    kind = dict(v.dtypes)["id"]
    part = left.groupBy("b", "c").cogroup(right.groupBy("rb", "rc")).applyInPandas(run, f"id {kind}, neighbor {kind}, score double")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "neighbor")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_products(x: np.ndarray, y: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, name, score): for each row of x its k highest inner products with rows of y to nine digits, equal ones by name.

    No row is sorted: what is above the k-th score, or below it by no more than rounding hides, is rounded and ranked.
    """
    s = x @ y.T
    least = np.partition(s, -k, axis=1)[:, -k] if k < s.shape[1] else s.min(axis=1)
    row, column = np.nonzero(s >= (least - 2e-9)[:, None])
    score, name = np.round(s[row, column], 9), names[column]
    order = np.lexsort((name, -score, row))
    row, name, score = row[order], name[order], score[order]
    first = np.searchsorted(row, row) + k > np.arange(len(row))
    return row[first], name[first], score[first]


def factor_scores(users: DataFrame, items: DataFrame, k: int, block_rows: int = 16384) -> DataFrame:
    """(user, item, score, rank): the k items of highest inner product for each user. users (user, u), items (item, v).

    Both sides are cut into blocks of about `block_rows` by hash; each pair of blocks is one matrix product on an executor
    that keeps its k best a user, and the blocks' lists are merged. Nothing passes through the driver.
    """
    kinds = dict(users.dtypes) | dict(items.dtypes)
    nu, ni = (max(1, -(-df.count() // block_rows)) for df in (users, items))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = users.select("user", "u", block("user", nu).alias("a"), every(ni).alias("b"))
    right = items.select("item", "v", block("item", ni).alias("d"), every(nu).alias("c"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"user": [], "item": [], "score": []})
        matrix, names, out = np.stack(y["v"].to_numpy()).astype(np.float64), y["item"].to_numpy(), []
        for at in range(0, len(x), 256):
            part = x.iloc[at : at + 256]
            row, name, score = best_products(np.stack(part["u"].to_numpy()).astype(np.float64), matrix, names, k)
            out.append(pd.DataFrame({"user": part["user"].to_numpy()[row], "item": name, "score": score}))
        return pd.concat(out)

    part = left.groupBy("a", "b").cogroup(right.groupBy("c", "d")).applyInPandas(run, f"user {kinds['user']}, item {kinds['item']}, score double")
    w = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_indices(values: DataFrame, column: str) -> DataFrame:
    """(column, index): 0, 1, 2 ... in the order of the values, without sorting them in one task."""
    v = values.select(column).dropna().distinct()
    spread = v.withColumn("__b", F.substring(F.sha1(F.col(column).cast("string")), 1, 2))
    n = spread.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__b")) - F.col("__n"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(column)) - 1
    return spread.withColumn("__in", inside).join(F.broadcast(n), "__b").select(column, (F.col("__in") + F.col("__before")).alias("index"))


def expand_by_neighbours(seeds: DataFrame, neighbours: DataFrame, per_seed: int = 50) -> DataFrame:
    """(user, item, hits, best) of the neighbours of each user's seeds, the user's own items left out."""
    n = neighbours.filter(F.col("rank") <= per_seed).select(F.col("movie_id").alias("item"), F.col("neighbor_id").alias("other"), "score")
    found = seeds.select("user", "item").join(n, "item").groupBy("user", F.col("other").alias("item")).agg(F.count("*").alias("hits"), F.max("score").alias("best"), F.sort_array(F.collect_list("score"), asc=False).alias("__s"))
    found = found.withColumn("mean_top10", F.aggregate(F.slice("__s", 1, 10), F.lit(0.0), lambda a, x: a + x) / F.least(F.size("__s"), F.lit(10))).drop("__s")
    return found.join(seeds.select("user", "item"), ["user", "item"], "left_anti")


def blended(content: Column, collaborative: Column, alpha: Column | float, extra: Sequence[tuple[Column, float]] = ()) -> Column:
    """alpha * content + (1 - alpha) * collaborative, plus small boosts. A missing part leaves the other at full weight."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    base = F.when(collaborative.isNull(), content).when(content.isNull(), collaborative).otherwise(a * content + (1 - a) * collaborative)
    for c, weight in extra:
        base = base + F.coalesce(c, F.lit(0.0)) * weight
    return base


def cohort_alpha(history: Column) -> Column:
    """Weight of content by the length of the user's history: none or little is known, content leads."""
    return F.when(history <= 2, 0.8).when(history <= 10, 0.6).when(history <= 100, 0.4).otherwise(0.2)


def candidate_cap(history: Column) -> Column:
    return F.when(history <= 2, 200).when(history <= 10, 500).otherwise(1000)


def most_diverse(x: np.ndarray, rel: np.ndarray, k: int, weight: float) -> list[int]:
    """Greedy maximal marginal relevance over unit vectors x: the first row of highest value is chosen, k times."""
    near, left, chosen = np.zeros(len(x)), np.ones(len(x), bool), []
    for _ in range(min(k, len(x))):
        i = int(np.where(left, weight * rel - (1 - weight) * near, -np.inf).argmax())
        chosen.append(i)
        left[i] = False
        near = np.maximum(near, x @ x[i]) if len(chosen) > 1 else x @ x[i]
    return chosen


def mmr(candidates: DataFrame, by: str, item: str, score: str, vector: str, k: int, weight: float = 0.25, pool: int = 500) -> DataFrame:
    """(by, item, rank): greedy maximal marginal relevance, weight * score - (1 - weight) * highest cosine to what is chosen.

    The pool of a user is cut to its best `pool` items first, so the greedy part has a bounded group.
    """
    kinds = dict(candidates.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, item], ascending=[False, True], kind="stable")
        x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        chosen = most_diverse(x, pdf[score].to_numpy(float), k, weight)
        return pd.DataFrame({by: pdf[by].iloc[0], item: pdf[item].to_numpy()[chosen], "rank": range(1, len(chosen) + 1)})

    top = first_rows(candidates, [by], [F.desc(score), F.asc(item)], pool)
    return top.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {item} {kinds[item]}, rank int")


def ordered_codes(values: DataFrame, column: str, partitions: int) -> DataFrame:
    """(column, code): 0, 1, 2 ... for the distinct values in their order, numbered in ranges, so no task sorts them all.

    `values` is written as it is numbered (session.cut), so that every later read sees the same codes.
    """
    place = F.monotonically_increasing_id()
    ids = cut(values.select(column).dropna().distinct().repartitionByRange(partitions, column).sortWithinPartitions(column).withColumn("__at", place), "codes")
    ids = ids.withColumns({"__range": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at")
    n = ids.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range")) - F.col("__n"))
    return ids.join(F.broadcast(n), "__range").select(column, (F.col("__in") + F.col("__before")).cast("int").alias("code"))


def item_record(slots: int, boosts: int, dims: int, single: bool) -> np.dtype:
    """One item of the file that `write_items` makes. No neighbour: -1; no votes and no vector: NaN."""
    return np.dtype([("near", "<i4", (slots,)), ("score", "<f8", (slots,)), ("popular", "<f8"), ("boosts", "<f8", (boosts,)), ("x", "<f4" if single else "<f8", (dims,))])


def write_items(items: DataFrame, path: str, record: np.dtype) -> int:
    """Write items (code, near, score, popular, boosts, x) as records of fixed size into the file `path`, which all executors
    can reach; each task writes its own items in their places. Returns their number.

    near and score: the codes and likenesses of an item's neighbours, in arrays of the same length, or null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, n = os.open(path, os.O_WRONLY), 0
        try:
            for b in batches:
                out = np.zeros(len(b), record)
                out["near"], out["x"] = -1, np.nan
                size = b.column("near").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(b)), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                out["near"][row, at] = b.column("near").flatten().to_numpy(zero_copy_only=False)
                out["score"][row, at] = b.column("score").flatten().to_numpy(zero_copy_only=False)
                out["popular"] = b.column("popular").fill_null(np.nan).to_numpy(zero_copy_only=False)
                out["boosts"] = b.column("boosts").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                known = b.column("x").is_valid().to_numpy(zero_copy_only=False)
                out["x"][known] = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(known.sum(), -1)
                for code, item in zip(b.column("code").to_pylist(), out, strict=True):
                    os.pwrite(file, item.tobytes(), code * record.itemsize)
                n += len(b)
        finally:
            os.close(file)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    n = items.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    if not n:
        os.truncate(path, record.itemsize)  # an empty file cannot be mapped
    return n


def nine_digits(x: np.ndarray) -> np.ndarray:
    """Rounded as Spark's `round(x, 9)`: halves of the shortest decimal form go away from zero."""
    t = x * 1e9
    with np.errstate(invalid="ignore"):
        out = np.rint(t) / 1e9
        doubtful = np.flatnonzero(np.isfinite(x) & ((np.abs(t - np.floor(t) - 0.5) < 1e-4) | (np.abs(t) > 1e11)))
    for i in doubtful:
        d = Decimal(repr(float(x[i])))
        out[i] = float(d.quantize(Decimal("1e-9"), ROUND_HALF_UP)) if abs(d) < 10**15 else x[i]
    return out


def mmr_of_seeds(users: DataFrame, path: str, record: np.dtype, k: int, weight: float = 0.25, pool: int = 500) -> DataFrame:
    """(user, code, rank): what `mmr` makes of the neighbours of each user's seeds, blended. users (user, alpha, seeds), seeds
    being codes of items in the file of `write_items`.

    Candidates, some hundred a user with a vector each, exist one user at a time and never travel: neighbours and vectors
    are looked up in the file, which workers map into memory. Of equal scores the lower code comes first.
    """
    kind = users.schema["user"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = np.asarray(np.memmap(path, record, mode="r"))
        for b in batches:
            size = b.column("seeds").value_lengths().to_numpy(zero_copy_only=False)
            seeds = np.split(b.column("seeds").flatten().to_numpy(zero_copy_only=False), np.cumsum(size)[:-1])
            row, code, rank = [], [], []
            for u, (alpha, own) in enumerate(zip(b.column("alpha").to_pylist(), seeds, strict=True)):
                near = items["near"][own]
                known = near >= 0
                near, content = near[known], items["score"][own][known]
                if not len(near):
                    continue
                order = np.argsort(near, kind="stable")
                near = near[order]
                first = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
                item, content = near[first], np.maximum.reduceat(content[order], first)
                popular, boosts = items["popular"][item], items["boosts"][item]
                score = np.where(np.isnan(popular), content, alpha * content + (1 - alpha) * popular)
                for j in range(boosts.shape[1]):
                    score = score + boosts[:, j]
                score = nine_digits(score)
                top = np.argsort(-score, kind="stable")[:pool]
                x = items["x"][item[top]]
                known = ~np.isnan(x[:, 0])
                top, x = top[known], x[known].astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                chosen = item[top[most_diverse(x, score[top], k, weight)]] if len(top) else top
                row.append(np.full(len(chosen), u))
                code.append(chosen)
                rank.append(np.arange(1, len(chosen) + 1))
            row, code, rank = (np.concatenate(z or [np.zeros(0)]).astype(np.int32) for z in (row, code, rank))
            yield pa.RecordBatch.from_arrays([b.column("user").take(pa.array(row)), pa.array(code), pa.array(rank)], ["user", "code", "rank"])

    return users.select("user", "alpha", "seeds").mapInArrow(run, f"user {kind}, code int, rank int")


def composite(families: Sequence[tuple[Column, float]], dims: int, seed: int = 42) -> Column:
    """One unit vector of `dims` numbers from several: each made unit length, weighted, all joined, turned by a random
    orthogonal matrix (QR of a Gaussian one; its first `dims` rows if there are fewer than the parts have together).
    A family that is null or all zero adds nothing; the families' lengths must be the same in every row."""
    weights = [w for _, w in families]

    def run(*parts: pd.Series) -> pd.Series:
        joined = []
        for part, w in zip(parts, weights, strict=True):
            known = next((np.asarray(v) for v in part if v is not None), np.zeros(1))
            x = np.stack([np.zeros(len(known)) if v is None else np.asarray(v, dtype=np.float64) for v in part])
            joined.append(w * x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1))
        every = np.concatenate(joined, axis=1)
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((every.shape[1], every.shape[1])))
        out = every @ (q * np.sign(np.diag(r)))[:, :dims]
        return pd.Series(list(out / np.where((n := np.linalg.norm(out, axis=1, keepdims=True)) > 0, n, 1)))

    return F.pandas_udf(run, "array<double>")(*[c for c, _ in families])


def attributed(recs: DataFrame, anchors: DataFrame, vectors: DataFrame, tags: DataFrame, neighbours: DataFrame, seen: DataFrame) -> DataFrame:
    """recs with what speaks for each: cosine to the user's anchor, the item's norm, its rank among the anchor's neighbours,
    genres shared with the anchor and their Jaccard overlap, share of genres new to the user. Unknown parts are null.

    anchors (user, anchor), vectors (item, x), tags (item, tags), seen (user, seen): each at most a row a key.
    """
    own = vectors.select("item", F.col("x").alias("__x")), tags.select("item", F.col("tags").alias("__t"))
    of_anchor = vectors.select(F.col("item").alias("anchor"), F.col("x").alias("__ax")), tags.select(F.col("item").alias("anchor"), F.col("tags").alias("__at"))
    near = neighbours.select(F.col("movie_id").alias("anchor"), F.col("neighbor_id").alias("item"), F.col("rank").alias("neighbour_rank"))
    r = recs.join(anchors, "user").join(own[0], "item", "left").join(own[1], "item", "left").join(of_anchor[0], "anchor", "left").join(of_anchor[1], "anchor", "left")
    r = r.join(near, ["anchor", "item"], "left").join(seen, "user", "left")
    shared = F.size(F.array_intersect("__t", "__at"))
    known = F.col("__t").isNotNull() & F.col("__at").isNotNull()
    new = F.size(F.array_except("__t", "seen"))
    return r.withColumns({"cosine": F.when(arrays.norm(F.col("__x")) * arrays.norm(F.col("__ax")) > 0, arrays.cosine(F.col("__x"), F.col("__ax"))), "item_norm": arrays.norm(F.col("__x")), "shared_genres": F.when(known, shared), "genre_jaccard": F.when(known, shared / F.size(F.array_union("__t", "__at"))), "new_genre_share": F.when(F.col("__t").isNotNull() & F.col("seen").isNotNull(), new / F.size("__t"))}).drop("__x", "__ax", "__t", "__at", "seen")


# --- evaluation ------------------------------------------------------------------------------------------------------


def per_user_metrics(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(user, recall, precision, average_precision, ndcg) of users that have both recommendations and truth.

    Average precision divides by the size of the truth; discounted gain by that of the ideal order.
    """
    t = truth.select("user", "item").distinct()
    sizes = t.groupBy("user").agg(F.count("*").alias("size"))
    hits = recs.filter(F.col("rank") <= k).join(t.withColumn("hit", F.lit(1)), ["user", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = Window.partitionBy("user").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = hits.withColumn("so_far", F.sum("hit").over(w) / F.col("rank"))
    sums = h.groupBy("user").agg(F.sum("hit").alias("hits"), F.sum(F.col("hit") * F.col("so_far")).alias("ap"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("size"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return sums.join(sizes, "user").select("user", (F.col("hits") / F.col("size")).alias("recall"), (F.col("hits") / k).alias("precision"), (F.col("ap") / F.col("size")).alias("average_precision"), (F.col("dcg") / ideal).alias("ndcg"))


def mean_metrics(per_user: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_user.groupBy(*by).agg(F.count("*").alias("users"), *[F.avg(c).alias(c) for c in ("recall", "precision", "average_precision", "ndcg")])


def coverage(recs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """One row: share of users with a recommendation and of items recommended to anyone."""
    u, i = users.select("user").distinct(), items.select("item").distinct()
    a = u.join(recs.select("user").distinct().withColumn("x", F.lit(1)), "user", "left").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("user_coverage"))
    b = i.join(recs.select("item").distinct().withColumn("x", F.lit(1)), "item", "left").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("item_coverage"))
    return a.join(b)


def list_diversity(recs: DataFrame, features: DataFrame) -> DataFrame:
    """(user, diversity): 1 - mean Jaccard overlap of all pairs of a user's list (short by nature). features (item, tags)."""
    r = recs.join(features, "item").select("user", "rank", "tags")
    lists = r.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("rank", "tags"))).alias("l"))
    a = lists.select("user", F.posexplode("l").alias("i", "x"), "l").select("user", "x", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("y"))
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect("x.tags", "y.tags")), F.size(F.array_union("x.tags", "y.tags"))), F.lit(0.0))
    return a.groupBy("user").agg((1 - F.avg(overlap)).alias("diversity"))


def overlap_at(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(user, overlap): share of the first k that two lists have in common."""
    x, y = a.filter(F.col("rank") <= k).select("user", "item"), b.filter(F.col("rank") <= k).select("user", "item")
    return x.join(y.withColumn("both", F.lit(1)), ["user", "item"], "left").groupBy("user").agg((F.count("both") / k).alias("overlap"))
