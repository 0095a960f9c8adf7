"""Projections, null handling and joins."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# --- projections -----------------------------------------------------------------------------------------------------


def keep(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that exist, in the order asked for."""
    return df.select(*[c for c in columns if c in df.columns])


def prefixed(df: DataFrame, prefix: str, but: Sequence[str] = ()) -> DataFrame:
    return df.toDF(*[c if c in but else prefix + c for c in df.columns])


def standard_names(df: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename the first column that has one of the spellings (case ignored) of each standard name."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    out: dict[str, str] = {}
    for name, spellings in synonyms.items():
        for s in (name, *spellings):
            old = lower.get(s.lower())
            if old and old not in out:
                if old != name and name not in df.columns:
                    out[old] = name
                break
    return df.withColumnsRenamed(out)


def columns_like(df: DataFrame, *parts: str) -> list[str]:
    """Names that hold any of the parts: finds a column by its role."""
    return [c for c in df.columns if any(p in c.lower() for p in parts)]


def first_of(df: DataFrame, *candidates: str, default: str | None = None) -> Column:
    """The first non-null of the candidates that exist, else the default."""
    there = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*there, F.lit(default))


def recoded(c: Column, table: Mapping, default=None) -> Column:
    m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(m[c], default if isinstance(default, Column) else F.lit(default))


def relaxed(df: DataFrame, group: Sequence[str], stages: Sequence[Column], least: int, cap: int, order: Sequence[Column]) -> DataFrame:
    """Per group the rows of the first, strictest stage that leaves at least `least`; if none does, the last stage's.

    Stages go from strict to loose. At most `cap` rows a group, by `order`. Adds `stage`, from 1.
    """
    marks = df.withColumns({f"__s{i}": F.coalesce(s, F.lit(False)) for i, s in enumerate(stages)})
    counts = marks.groupBy(*group).agg(*[F.count_if(f"__s{i}").alias(f"__n{i}") for i in range(len(stages))])
    stage = F.lit(len(stages))
    for i in reversed(range(len(stages) - 1)):
        stage = F.when(F.col(f"__n{i}") >= least, i + 1).otherwise(stage)
    chosen = marks.join(counts.select(*group, stage.alias("stage")), list(group))
    passes = reduce(lambda a, b: a | b, [(F.col("stage") == i + 1) & F.col(f"__s{i}") for i in range(len(stages))])
    ranked = chosen.filter(passes).withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("__r") <= cap).drop("__r", *[f"__s{i}" for i in range(len(stages))])


# --- null handling ---------------------------------------------------------------------------------------------------


def fill_from_statistic(df: DataFrame, column: str, how: str, default=None) -> DataFrame:
    """Nulls become the column's `median`, `mean` or `mode` (the smallest of several), else the default."""
    stat = {"median": F.median(column), "mean": F.avg(column), "mode": F.mode(column, True)}[how]
    one = df.agg(stat.alias("__fill"))
    return df.join(F.broadcast(one)).withColumn(column, F.coalesce(F.col(column), F.col("__fill"), F.lit(default))).drop("__fill")


def filled_along(column: str, by: Sequence[str], order: Sequence[Column]) -> Column:
    """Last known value before, else the first known after."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(before, after)


def zeros_for_nulls(df: DataFrame, but: Sequence[str] = (), text: str = "0") -> DataFrame:
    """Every column: 0 for numbers, `text` for strings."""
    kinds = dict(df.dtypes)
    names = [c for c in df.columns if c not in but]
    numbers = [c for c in names if kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    strings = [c for c in names if kinds[c] == "string"]
    return df.fillna(0, numbers).fillna(text, strings)


# --- joins -----------------------------------------------------------------------------------------------------------


def suffixed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Join on shared keys; other columns of the right side that clash get the suffix."""
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), list(on), how)


def lookup_join(left: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that keeps the number of rows: the dimension's keys must be unique, else an error."""
    doubled = dimension.groupBy(*on).count().filter("count > 1").limit(1)
    if not doubled.isEmpty():
        raise ValueError(f"keys {list(on)} of the dimension are not unique")
    return suffixed_join(left, dimension, on, "left")


def join_chain(base: DataFrame, dimensions: Sequence[tuple[str, DataFrame]], on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Left joins of all dimensions, and one row with the match rate of each."""
    out = base
    for name, dim in dimensions:
        out = out.join(dim.withColumn(f"__has_{name}", F.lit(True)), list(on), "left")
    rates = out.agg(*[F.avg(F.col(f"__has_{n}").isNotNull().cast("double")).alias(n) for n, _ in dimensions])
    return out.drop(*[f"__has_{n}" for n, _ in dimensions]), rates


def sides(matches: DataFrame, home: str, away: str, others: Sequence[str]) -> DataFrame:
    """Two rows a match, (team, opponent, is_home): an OR join on home or away becomes an equi-join."""
    a = matches.select(F.col(home).alias("team"), F.col(away).alias("opponent"), F.lit(True).alias("is_home"), *others)
    b = matches.select(F.col(away).alias("team"), F.col(home).alias("opponent"), F.lit(False).alias("is_home"), *others)
    return a.unionByName(b)


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], bands: Sequence[tuple[Column, Column, float]], how: str = "inner") -> DataFrame:
    """Equal keys and |a - b| within each band; a null on either side of a band passes it."""
    cond = reduce(lambda a, b: a & b, [left[k] == right[k] for k in on])
    for a, b, width in bands:
        cond = cond & (a.isNull() | b.isNull() | (F.abs(a - b) <= width))
    return left.join(right, cond, how)


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time; left rows without one have nulls.

    Both sides go into one ordered stream per key, so nothing is multiplied: a last value over the order, no range join.
    """
    a = left.withColumn("__t", F.col(left_time)).withColumn("__side", F.lit(1))
    b = right.select(*on, F.col(right_time).alias("__t"), F.struct(F.col(right_time), *columns).alias("__r")).withColumn("__side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    return out.select(*left.columns, F.col(f"__last.{right_time}").alias(f"asof_{right_time}"), *[F.col(f"__last.{c}").alias(f"asof_{c}") for c in columns])


# --- fuzzy scores ----------------------------------------------------------------------------------------------------


def indel_ratio(a: str, b: str) -> float:
    """100 (1 - (insertions + deletions) / (length + length)): twice the longest common subsequence, bit-parallel."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    common = len(a) - v.bit_count()
    return 200.0 * common / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of the shared words against each side's words, so extra words on one side do not count."""
    x, y = set(a.split()), set(b.split())
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    one, two = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max(indel_ratio(one, two), indel_ratio(both, one) if both else 0.0, indel_ratio(both, two) if both else 0.0)


SCORES = {"ratio": indel_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio}


def fuzzy_score(a: Column, b: Column, kind: str = "token_sort") -> Column:
    """0 to 100, each distinct pair of a batch once; null if either side is."""
    of = SCORES[kind]

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            known: dict[tuple[str, str], float] = {}
            out = []
            for pair in zip(x, y, strict=True):
                if pair[0] is None or pair[1] is None:
                    out.append(None)
                else:
                    if pair not in known:
                        known[pair] = of(*pair)
                    out.append(known[pair])
            yield pd.Series(out, dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(a, b)


def blocked_fuzzy_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, year: str, kind: str = "token_set", least: float = 92, block_words: int = 2, spread: int = 1) -> DataFrame:
    """(left_id, right_id, score): best partner of each left row among those with the same first words and a near year.

    The year is spread on one side only, so the join is an equi-join. All partners of a block are scored; ties go to the
    smaller right id.
    """
    words = F.array_join(F.slice(F.split(F.trim(F.col(text)), " "), 1, block_words), " ")
    a = left.select(F.col(left_id), F.col(text).alias("__a"), words.alias("__w"), F.explode(F.sequence(F.col(year) - spread, F.col(year) + spread)).alias("__y"))
    b = right.select(F.col(right_id), F.col(text).alias("__b"), words.alias("__w"), F.col(year).alias("__y"))
    scored = a.join(b, ["__w", "__y"]).withColumn("score", fuzzy_score(F.col("__a"), F.col("__b"), kind)).filter(F.col("score") >= least)
    best = Window.partitionBy(left_id).orderBy(F.desc("score"), right_id)
    return scored.withColumn("__r", F.row_number().over(best)).filter("__r = 1").select(left_id, right_id, "score")


def cascade_match(left: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Each left row with the first source, in order, that has its key; `unresolved` if none has."""
    found = None
    for rank, (name, df) in enumerate(sources):
        part = df.select(F.col(key)).distinct().select(key, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name")).alias("__s"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(key).agg(F.min("__s")["name"].alias("__name"))
    return left.join(best, key, "left").withColumn("source", F.coalesce("__name", F.lit("unresolved"))).drop("__name")
