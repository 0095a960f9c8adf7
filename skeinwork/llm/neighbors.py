"""The k most similar vectors for every vector, by randomly rotated one-bit codes.

Vectors are put into cells around centroids fitted on a bounded sample. A vector's residual to its centroid is rotated at
random and kept as one bit a dimension with two correction scalars; a query's rotated residual is quantised to four bits.
And-and-popcount on packed bits then estimates every inner product of a cell without bias and with a known error bound.
Only vectors whose upper bound reaches the k-th best lower bound (and the similarity floor) are compared exactly.
Equal vectors are one vector until the very end, and large cells are worked off in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.operators.skew import HOT_ROWS, hot_split_join
from skeinwork.session import cut

#: Rows the centroids are fitted on (at 64 numbers 16 MB on the driver); every row is indexed all the same.
SAMPLE_ROWS = 65_536
#: Vectors a cell should have, and the most centroids there are (32 MB to every task). The cells follow the number of vectors
#: up to 8.4 million of them; beyond, cells grow and are worked off in blocks.
CELL_ROWS, MAX_CELLS = 128, 65_536
#: Sampled rows a centroid, where there are more centroids than the sample has a sixteenth.
SAMPLED_PER_CELL = 4
#: Inner products held at a time.
PRODUCTS = 1 << 22
#: Rows of an index block and of a query block in one task.
BLOCK_ROWS = 4_096
#: Standard errors of the estimate that the bounds allow for.
EPSILON = 2.5


def usable(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, vec, digest) of the vectors of exactly `dims` finite numbers, not all zero; each id once.

    An id with several usable vectors keeps the one that comes first in byte order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, vecs, digests = [], [], []
            for i, v in zip(pdf["id"], pdf["v"], strict=True):
                if i is None or v is None or len(v) != dims:
                    continue
                x = np.asarray(v, dtype=np.float32)
                if np.isfinite(x).all() and x.any():
                    raw = (x + np.float32(0)).tobytes()
                    ids.append(i)
                    vecs.append(raw)
                    digests.append(hashlib.blake2b(raw, digest_size=16).hexdigest())
            yield pd.DataFrame({"id": ids, "vec": vecs, "digest": digests}, dtype=object)

    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(F.size("v") == dims).mapInPandas(run, "id string, vec binary, digest string")
    return rows.groupBy("id").agg(F.min(F.struct("vec", "digest")).alias("m")).select("id", "m.vec", "m.digest")


def unit(raw: pd.Series, dims: int) -> np.ndarray:
    """Unit vectors in double precision, one a row."""
    x = np.frombuffer(b"".join(raw), dtype=np.float32).reshape(-1, dims).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unpacked(raw: Column | str) -> Column:
    """The numbers of a packed vector."""
    return F.pandas_udf(lambda s: s.map(lambda b: np.frombuffer(b, dtype=np.float32)), "array<float>")(raw)


def fit_cells(x: np.ndarray, cells: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means on the sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]].copy()
    step = max(64, PRODUCTS // cells)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + step] @ c.T).argmax(1) for i in range(0, len(x), step)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    return c


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, c: np.ndarray, rot: np.ndarray) -> dict[str, np.ndarray]:
    """Packed sign bits of the rotated unit residuals, the residual's length and the code's inner product with it."""
    res = (x - c) @ rot.T
    length = np.linalg.norm(res, axis=1)
    o = res / np.maximum(length, 1e-12)[:, None]
    return {"bits": np.packbits(o > 0, axis=1), "length": length, "fit": np.maximum(np.abs(o).sum(1) / np.sqrt(x.shape[1]), 1e-6)}


def _words(bits: np.ndarray) -> np.ndarray:
    pad = -bits.shape[1] % 8
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, pad)))).view(np.uint64)


def estimate(code: dict[str, np.ndarray], x_dot_c: np.ndarray, q: np.ndarray, c: np.ndarray, rot: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries x coded vectors) and their error bounds, from popcounts on packed bits."""
    dims = q.shape[1]
    r = (q - c) @ rot.T
    low, high = r.min(1, keepdims=True), r.max(1, keepdims=True)
    step = np.maximum(high - low, 1e-12) / 15
    u = np.clip(np.rint((r - low) / step), 0, 15).astype(np.uint8)
    words = _words(code["bits"])
    ones = np.bitwise_count(words).sum(1, dtype=np.int64)
    dot = np.zeros((len(q), len(words)), dtype=np.int32)
    for plane in range(4):
        w = _words(np.packbits((u >> plane) & 1, axis=1))
        for k in range(words.shape[1]):
            dot += np.bitwise_count(w[:, k : k + 1] & words[None, :, k]).astype(np.int32) << plane
    signed = (2 * (low * ones[None, :] + step * dot) - r.sum(1, keepdims=True)) / np.sqrt(dims)
    about = signed / code["fit"][None, :] * code["length"][None, :] + x_dot_c[None, :] + (q @ c)[:, None] - c @ c
    spread = np.sqrt(np.maximum(0, 1 - code["fit"] ** 2)) / code["fit"] * code["length"] / np.sqrt(dims - 1)
    rounding = step * code["length"][None, :] / np.sqrt(12) / code["fit"][None, :]
    return about, epsilon * (spread[None, :] * np.linalg.norm(r, axis=1)[:, None] + rounding)


def _assign(centroids: np.ndarray, dims: int, probes: int):
    rot = rotation(dims)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = unit(pdf["vec"], dims)
            n, step, found, found_sims = min(probes, len(centroids)), max(64, PRODUCTS // len(centroids)), [], []
            for at in range(0, len(x), step):
                sims = x[at : at + step] @ centroids.T
                near = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
                found.append(near)
                found_sims.append(np.take_along_axis(sims, near, 1))
            near, sims = np.concatenate(found), np.concatenate(found_sims)
            c = centroids[near[:, 0]]
            code = encode(x, c, rot)
            yield pdf.assign(cell=near[:, 0].astype(np.int32), probes=list(near.astype(np.int32)), probe_sims=list(sims), bits=[b.tobytes() for b in code["bits"]], length=code["length"], fit=code["fit"], x_dot_c=(x * c).sum(1))

    return run


def _search(centroids: np.ndarray, dims: int, k: int):
    rot = rotation(dims)

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "x": [], "sim": []}
        if len(index) and len(queries):
            c = centroids[int(index["cell"].iloc[0])]
            code = {"bits": np.frombuffer(b"".join(index["bits"]), dtype=np.uint8).reshape(len(index), -1), "length": index["length"].to_numpy(), "fit": index["fit"].to_numpy()}
            x, xd, names = unit(index["vec"], dims), index["x_dot_c"].to_numpy(), index["rep"].to_numpy()
            for at in range(0, len(queries), 512):
                part = queries.iloc[at : at + 512]
                q, own, least = unit(part["wanted"], dims), part["asker"].to_numpy(), part["least"].to_numpy()
                about, error = estimate(code, xd, q, c, rot)
                keep = about + error >= least[:, None]
                keep &= own[:, None] != names[None, :]
                if len(index) > k:
                    lower = np.where(keep, about - error, -np.inf)
                    keep &= about + error >= np.partition(lower, len(index) - k, axis=1)[:, len(index) - k, None]
                qi, xi = np.nonzero(keep)
                sim = np.round(np.einsum("ij,ij->i", q[qi], x[xi]), 6)
                good = sim >= least[qi]
                qi, xi, sim = qi[good], xi[good], sim[good]
                order = np.lexsort((names[xi].astype(str), -sim, qi))
                qi, xi, sim = qi[order], xi[order], sim[order]
                first = np.searchsorted(qi, qi, side="left")
                top = np.arange(len(qi)) - first < k
                out["q"] += list(own[qi[top]])
                out["x"] += list(names[xi[top]])
                out["sim"] += list(sim[top])
        return pd.DataFrame(out, dtype=object).astype({"sim": "float64"})

    return run


def nearest(vectors: DataFrame, key: str, vector: str, dims: int, k: int = 10, floor: float = -1.0, probes: int = 16, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, neighbor, sim): the k most similar other ids of every id with a usable vector, of at least `floor`.

    Similarity is the cosine rounded to 6 decimals; ties go to the smaller id. Unusable vectors take no part; equal
    vectors under several ids are neighbours of similarity 1. Fewer than k others: as many as there are.
    """
    spark = vectors.sparkSession
    members = cut(usable(vectors, key, vector, dims), "vectors")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).filter(F.col("r") <= k + 1)
    copies = cut(first.select("digest", "id", "r").groupBy("digest").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(members.groupBy("digest").agg(F.count("*").alias("n")), "digest").withColumn("rep", F.col("ids")[0]), "copies")
    distinct = cut(copies.select("rep").join(members.select(F.col("id").alias("rep"), "vec"), "rep"), "distinct")
    total = distinct.count()
    if not total:
        return spark.createDataFrame([], "id string, neighbor string, sim double")
    cells = max(1, min(MAX_CELLS, total // cell_rows))
    sample = distinct.orderBy(F.xxhash64("rep")).limit(max(sample_rows, SAMPLED_PER_CELL * cells)).select("vec").toPandas()["vec"]
    centroids = fit_cells(unit(sample, dims), min(cells, len(sample)))
    placed = cut(distinct.mapInPandas(_assign(centroids, dims, probes), "rep string, vec binary, cell int, probes array<int>, probe_sims array<double>, bits binary, length double, fit double, x_dot_c double"), "placed")
    # One row a cell, so at most MAX_CELLS rows, tell its widest angle and how many blocks each side of it has.
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("nx"), F.min("x_dot_c").alias("edge"))
    asks = placed.select(F.explode("probes").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("nq"))
    cells = cut(cells.join(asks, "cell"), "cells")
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))

    def searched(asked: DataFrame) -> DataFrame:
        """(q, x, sim) of (asker, wanted, least, cell, q_dot_c): a query looks only into cells that can hold a vector of its
        least similarity, whose angle to the query is at most the query's to the centroid less the cell's widest."""
        can = angle(F.col("q_dot_c")) - angle(F.col("edge")) <= angle(F.col("least")) + 1e-6
        a = asked.join(F.broadcast(cells), "cell").filter(can).withColumn("bq", slot("asker", "nq")).withColumn("bx", every("nx")).select("asker", "wanted", "least", F.col("cell").alias("probed"), "bq", "bx")
        index = placed.drop("probes", "probe_sims").join(F.broadcast(cells), "cell").withColumn("bx", slot("rep", "nx")).withColumn("bq", every("nq")).drop("nx", "nq", "edge")
        return index.groupBy("cell", "bx", "bq").cogroup(a.groupBy("probed", "bx", "bq")).applyInPandas(_search(centroids, dims, k), "q string, x string, sim double")

    # The own cell first: its k-th best is the least that another cell must offer.
    query = [F.col("rep").alias("asker"), F.col("vec").alias("wanted")]
    home = cut(searched(placed.select(*query, F.lit(float(floor)).alias("least"), "cell", F.col("x_dot_c").alias("q_dot_c"))), "home")
    kth = home.groupBy(F.col("q").alias("rep")).agg(F.when(F.count("*") >= k, F.min("sim")).alias("kth"))
    others = placed.join(kth, "rep", "left").withColumn("p", F.explode(F.expr("slice(arrays_zip(probes, probe_sims), 2, size(probes))")))
    others = others.select(*query, F.coalesce("kth", F.lit(float(floor))).alias("least"), F.col("p.probes").alias("cell"), F.col("p.probe_sims").alias("q_dot_c"))
    pairs = home.unionByName(searched(others))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "x"))).filter(F.col("r") <= k).select("q", "x", "sim")
    own = copies.filter("n > 1").select(F.col("rep").alias("q"), F.col("rep").alias("x"), F.lit(1.0).alias("sim"))
    listed = best.unionByName(own).join(copies.select(F.col("rep").alias("x"), "ids"), "x").select("q", "sim", F.explode("ids").alias("neighbor"))
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "neighbor"))).filter(F.col("r") <= k + 1)
    lists = listed.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "neighbor", "sim"))).alias("top"))
    lists = cut(lists.join(copies.select(F.col("rep").alias("q"), "digest", "n"), "q").select("digest", "n", "top"), "lists")
    out = hot_split_join(members.select("id", "digest"), lists, ["digest"], "n", hot_rows)
    others = F.slice(F.filter("top", lambda t: t["neighbor"] != F.col("id")), 1, k)
    return out.select("id", F.explode(others).alias("t")).select("id", "t.neighbor", "t.sim")


def similar_pairs(vectors: DataFrame, key: str, vector: str, dims: int, k: int = 10, least: float = 0.85, **how) -> DataFrame:
    """(a, b), a < b, of at least the similarity `least`, one among the other's k most similar."""
    near = nearest(vectors, key, vector, dims, k, least, **how)
    return near.select(F.least("id", "neighbor").alias("a"), F.greatest("id", "neighbor").alias("b")).distinct()
