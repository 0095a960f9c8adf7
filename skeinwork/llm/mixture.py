"""Mixing sources to target weights by entropy balancing.

The rates closest to the base rates (in relative entropy over tokens) that meet the token constraints are the base rates
tilted exponentially by one multiplier a constraint. Newton iterations on the convex dual find the multipliers; each needs
only sums over cells of documents with equal multipliers. Rates are capped and then rounded into whole copies so that every
source keeps its total to within a part of one document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.session import cut, drop_cut

BITS = 12
LEVELS = 3
#: Share of the mixture that sources may lack together, because they give all they have as often as they may.
SHORTFALL = 0.05
#: Softness of the shares of further columns: a multiplier of e costs this part of the share.
SOFT = 0.02
#: Base rate of a source that is used to its cap: no multiplier brings it below.
FULL = 1e30


def feasible(cells: list[tuple[str, int]], shares: dict[str, float], caps: dict[str, int], total: float | None, shortfall: float = SHORTFALL) -> dict[str, float]:
    """Tokens each source must give.

    Sources without tokens are left out and the others' shares scaled up. Without `total` it is the most at which the
    sources that are used to their caps lack at most the part `shortfall` of it together. What they lack is spread over
    the others in proportion to their shares, so that the size follows the corpus and not its smallest source.
    """
    have = {s: caps[s] * n for s, n in cells if n and shares.get(s, 0) > 0 and caps.get(s, 0) > 0}
    scale = sum(shares[s] for s in have)
    if not have:
        return {}
    share = {s: shares[s] / scale for s in have}
    most, full, full_share = sum(have.values()), 0.0, 0.0
    # Sources reach their caps in this order as the total grows; what is lacking grows with it.
    for s in sorted(have, key=lambda s: (have[s] / share[s], s)):
        if full_share > shortfall and full / (full_share - shortfall) <= have[s] / share[s]:
            most = min(most, full / (full_share - shortfall))
            break
        if shortfall == 0 and not full_share:
            most = have[s] / share[s]
            break
        full, full_share = full + have[s], full_share + share[s]
    total = most if total is None else min(total, most)
    out: dict[str, float] = {}
    while len(out) < len(have):
        free = {s: (total - sum(out.values())) * share[s] / sum(share[t] for t in have if t not in out) for s in have if s not in out}
        over = {s: float(have[s]) for s, t in free.items() if t >= have[s]}
        out |= over or free
    return out


def newton(cells: DataFrame, families: list[str], wanted: dict[tuple[str, str], float], soft: dict[tuple[str, str], float] | None = None, tolerance: float = 1e-7, max_rounds: int = 200) -> dict[tuple[str, str], float]:
    """Multipliers of (family, level) so that the cells' tilted, capped tokens meet `wanted`.

    `cells` has the families, `cap`, `base` and `tokens`. Levels without a wanted sum are not constrained; the sums of
    `soft` are met as far as that costs little (SOFT), so that they never contradict `wanted`. A step is halved until
    the dual falls. Raises if `wanted` cannot be met.
    """
    soft = soft or {}
    names = sorted(set(wanted) | set(soft))
    at = {n: i for i, n in enumerate(names)}
    goal = np.array([wanted.get(n, soft.get(n, 0.0)) for n in names])
    ridge = np.array([0.0 if n in wanted else SOFT * soft[n] for n in names])

    def dual(tilt: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and curvature: a capped cell adds to the first two only."""
        log = _tilted(families, {n: float(tilt[i]) for n, i in at.items()}) + F.log("base")
        cap = F.col("cap").cast("double")
        under = log < F.log(cap)
        rate = F.when(under, F.exp(log)).otherwise(cap)
        rows = cells.groupBy(*families).agg(F.sum(F.col("tokens") * rate).alias("now"), F.sum(F.when(under, F.col("tokens") * rate).otherwise(0.0)).alias("bend"), F.sum(F.col("tokens") * F.when(under, rate).otherwise(cap * (1 + log - F.log(cap)))).alias("value")).collect()  # a row a cell of levels
        value, gradient, curvature = float(ridge @ tilt**2 / 2 - goal @ tilt), ridge * tilt - goal, np.diag(ridge)
        for row in rows:
            mine = [at[(f, row[f])] for f in families if (f, row[f]) in at]
            value += row["value"]
            gradient[mine] += row["now"]
            curvature[np.ix_(mine, mine)] += row["bend"]
        return value, gradient, curvature

    tilt = np.zeros(len(names))
    value, gradient, curvature = dual(tilt)
    for _ in range(max_rounds):
        if np.abs(gradient / goal).max() < tolerance:
            return {n: float(tilt[at[n]]) for n in names}
        # Where every cell of a constraint is capped there is no curvature; a trace of it keeps the step finite.
        step = np.clip(np.linalg.lstsq(curvature + np.diag(1e-9 * goal), gradient, rcond=None)[0], -2, 2)
        part = 1.0
        while True:
            new = dual(tilt - part * step)
            if new[0] <= value - 1e-4 * part * float(gradient @ step) + 1e-12 * abs(value) or part < 1e-6:
                break
            part /= 2
        tilt, (value, gradient, curvature) = tilt - part * step, new
    raise RuntimeError(f"the mixture's shares cannot be met: off by {np.abs(gradient / goal).max():.2g} after {max_rounds} rounds")


def _tilted(families: list[str], tilt: dict[tuple[str, str], float]) -> Column:
    """The log of the tilt: the sum of the multipliers of a row's levels."""
    log = F.lit(0.0)
    for f in families:
        levels = [F.lit(v) for (g, level), t in sorted(tilt.items()) if g == f for v in (level, t)]
        if levels:
            log = log + F.coalesce(F.create_map(*levels)[F.col(f)], F.lit(0.0))
    return log


def _chance(doc_id: str, level: int, seed: int) -> Column:
    """Digit `level` of a number in [0, 1) drawn from the id, in base 2 ** BITS."""
    return F.shiftright(F.xxhash64(F.col(doc_id), F.lit(seed)), 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def _whole_copies(docs: DataFrame, wanted: dict[str, float], seed: int = 101) -> DataFrame:
    """docs (doc_id, source, n_tokens, rate, cap) with `copies`: the whole part of the rate, and one more for the documents
    drawn first, up to the point where the source has what it should."""
    spark = docs.sparkSession
    whole = F.floor(F.col("rate") + 1e-9).cast("int")
    d = docs.withColumn("copies", whole).withColumn("part", F.greatest(F.col("rate") - whole, F.lit(0.0)))
    digits = [_chance("doc_id", i, seed) for i in range(LEVELS)]
    order = F.when(F.col("part") > 1e-9, F.floor((digits[0] * F.lit(2.0 ** (2 * BITS)) + digits[1] * F.lit(2.0**BITS) + digits[2]) / F.col("part")).cast("long"))
    d = cut(d.withColumn("order", order), "rates")
    given = {r["source"]: r["t"] for r in d.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    gap = {s: wanted[s] - given.get(s, 0) for s in wanted}
    low, high = dict.fromkeys(wanted, 0), {r["source"]: r["m"] + 1 for r in d.filter("order is not null").groupBy("source").agg(F.max("order").alias("m")).collect()}
    live = {s for s in high if gap[s] > 0}
    while live:
        # Each round cuts the open range of every source into 2 ** BITS and keeps the one in which the gap closes.
        step = {s: max(1, -(-(high[s] - low[s]) >> BITS)) for s in live}
        open_ = spark.createDataFrame([(s, low[s], high[s], step[s]) for s in sorted(live)], "source string, low long, high long, step long")
        bins = d.join(F.broadcast(open_), "source").filter("order >= low and order < high").groupBy("source", F.floor((F.col("order") - F.col("low")) / F.col("step")).alias("bin")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
        by: dict[str, list] = {}
        for r in bins.collect():  # at most 2 ** BITS rows a source
            by.setdefault(r["source"], []).append((r["bin"], r["t"], r["n"]))
        for s in sorted(live):
            for at, t, n in sorted(by.get(s, [])):
                if t > gap[s]:
                    low[s], high[s] = low[s] + at * step[s], low[s] + (at + 1) * step[s]
                    if n == 1 or step[s] == 1:
                        live.discard(s)
                    break
                gap[s] -= t
            else:
                low[s] = high[s]
                live.discard(s)
    bounds = F.create_map(*[F.lit(v) for s in sorted(low) for v in (s, low[s])])
    d = d.withColumn("copies", F.col("copies") + F.when(F.col("order") < bounds[F.col("source")], 1).otherwise(0)).drop("part", "order")
    gaps = spark.createDataFrame([(s, float(g)) for s, g in sorted(gap.items()) if g >= 1], "source string, gap double")
    # What is missing is less than the next document drawn: the longest documents that fit, by a tally of lengths.
    spare = d.join(F.broadcast(gaps), "source").filter((F.col("copies") < F.col("cap")) & (F.col("n_tokens") <= F.col("gap")))
    tally: dict[str, list] = {}
    for r in spare.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).collect():  # at most the longest length a source
        tally.setdefault(r["source"], []).append((r["n_tokens"], r["n"]))
    picks = []
    for s, lengths in sorted(tally.items()):
        for length, n in sorted(lengths, reverse=True):
            if k := min(n, int(gap[s] // length)):
                gap[s] -= k * length
                picks.append((s, length, k))
    if not picks:
        return d
    chosen = spare.drop("gap").join(F.broadcast(spark.createDataFrame(picks, "source string, n_tokens long, k long")), ["source", "n_tokens"])
    chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy("doc_id"))).filter("r <= k").select("doc_id", F.lit(1).alias("more"))
    return d.join(chosen, "doc_id", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, families: dict[str, dict[str, float]] | None = None, shortfall: float = SHORTFALL) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies) of the documents that are used.

    docs: (doc_id, source, n_tokens), and columns of `families`; targets: (source, target_share, max_repeats), one row a
    source, read by the driver. `families` adds shares of the levels of other columns, which yield to the sources' where
    both cannot be had. `shortfall`: see `feasible`. Documents without source, without tokens or of a source without
    target are not used. doc_id must be unique.
    """
    rows = targets.select("source", "target_share", "max_repeats").dropna().collect()
    shares, caps = {r["source"]: r["target_share"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows}
    extra = sorted(families or {})
    small = docs.sparkSession.createDataFrame([(s, c) for s, c in sorted(caps.items())], "source string, cap int")
    d = docs.filter("n_tokens > 0").select("doc_id", "source", *extra, F.col("n_tokens").cast("long").alias("n_tokens")).join(F.broadcast(small), "source").select("doc_id", "source", *extra, "n_tokens", "cap")
    for f in extra:  # a level without a share is none, so that the cells are as few as the levels named
        d = d.withColumn(f, F.when(F.col(f).isin(*families[f]), F.col(f)))
    cells = cut(d.groupBy("source", *extra, "cap").agg(F.sum("n_tokens").cast("double").alias("tokens")), "cells")
    there = {r["source"]: r["t"] for r in cells.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    wanted = feasible(sorted(there.items()), shares, caps, total, shortfall)
    if not wanted:
        return d.select("doc_id", "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies")).limit(0)
    full = [s for s, t in wanted.items() if t >= caps[s] * there[s]]
    known = F.col("source").isin(*wanted)
    base = F.when(F.col("source").isin(*full), FULL).otherwise(1.0)
    goals = {("source", s): t for s, t in wanted.items() if s not in full}
    aims = {(f, level): share * sum(wanted.values()) for f in extra for level, share in families[f].items() if share > 0}
    tilt = newton(cells.filter(known).withColumn("base", base), ["source", *extra], goals, aims) if goals or aims else {}
    drop_cut(cells)
    rated = d.filter(known).withColumn("rate", F.least(F.col("cap").cast("double"), base * F.exp(_tilted(["source", *extra], tilt))))
    return _whole_copies(rated, wanted).filter("copies > 0").select("doc_id", "source", "n_tokens", "rate", "copies")


def share_report(mixture: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target source: its target share, the share of the mixture it can reach, the actual share; tokens there and
    used, documents and copies used. The reachable share is below the target where all copies of all documents are used."""
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("docs_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    there = docs.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens_there"), F.count("*").alias("docs_there"), F.max("n_tokens").alias("longest_there"))
    out = targets.select("source", "target_share", "max_repeats").join(there, "source", "left").join(used, "source", "left").fillna(0)
    whole = used.agg(F.sum("tokens_used").alias("__all"))
    part = lambda c: F.coalesce(F.try_divide(c, F.col("__all")), F.lit(0.0))
    return out.join(F.broadcast(whole)).withColumn("reachable_share", F.least("target_share", part(F.col("tokens_there") * F.col("max_repeats")))).withColumn("actual_share", part(F.col("tokens_used"))).drop("__all")
