"""Aggregates: profiles, outliers, frequency filters, calibration, priors and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.operators.ordered import positions


def distinct_joined_back(df: DataFrame, by: Sequence[str], of: str, name: str) -> DataFrame:
    """Distinct count within the group on every row: an aggregate joined back, as no window can count distinct values."""
    return df.join(df.groupBy(*by).agg(F.countDistinct(of).alias(name)), list(by))


def top_values(df: DataFrame, by: Sequence[str], value: str, k: int, separator: str = ", ") -> DataFrame:
    """The k most frequent values of each group as one text; ties by value."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy(F.desc("__n"), F.asc(value))
    top = n.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    listed = top.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__r", value))).alias("__l"))
    return listed.select(*by, F.array_join(F.transform("__l", lambda s: s[value]), separator).alias(f"top_{value}"))


def shares(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and their share of all rows."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("__all")))).withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def profile(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """(column, n, nulls, low, high, mean, spread, q25, q50, q75) in one pass and one aggregate."""
    parts = []
    for c in numbers:
        x = F.col(c).cast("double")
        parts += [F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("spread"), F.percentile(x, 0.25).alias("q25"), F.percentile(x, 0.5).alias("q50"), F.percentile(x, 0.75).alias("q75")).alias(f"__{c}")]
    return df.agg(*parts).select(F.explode(F.array(*[f"__{c}" for c in numbers])).alias("p")).select("p.*")


def null_report(df: DataFrame) -> DataFrame:
    """(column, nulls, share) of every column in one pass."""
    one = df.agg(F.count("*").alias("__all"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
    return one.select(F.explode(cells).alias("p"), "__all").select("p.column", "p.nulls", F.try_divide("p.nulls", "__all").alias("share"))


def within_sigma(df: DataFrame, by: Sequence[str], value: str, sigmas: float = 3) -> DataFrame:
    """Rows within so many standard deviations of their group's mean; null values and groups of one row go."""
    s = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    return df.join(s, list(by)).filter(F.abs(F.col(value) - F.col("__m")) <= sigmas * F.col("__s")).drop("__m", "__s")


def within_fences(df: DataFrame, by: Sequence[str], value: str, width: float = 1.5) -> DataFrame:
    """Rows inside Tukey's fences of their group."""
    q = df.groupBy(*by).agg(F.percentile(value, 0.25).alias("__a"), F.percentile(value, 0.75).alias("__b"))
    iqr = F.col("__b") - F.col("__a")
    return df.join(q, list(by)).filter(F.col(value).between(F.col("__a") - width * iqr, F.col("__b") + width * iqr)).drop("__a", "__b")


def frequent(df: DataFrame, user: str, item: str, per_user: int = 3, per_item: int = 5) -> DataFrame:
    """Rows whose user and item each have enough rows; both are counted before either filter."""
    users = df.groupBy(user).count().filter(F.col("count") >= per_user).select(user)
    items = df.groupBy(item).count().filter(F.col("count") >= per_item).select(item)
    return df.join(users, user, "left_semi").join(items, item, "left_semi")


def errors(actual: Column, predicted: Column) -> list[Column]:
    d = predicted - actual
    return [F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d * d).alias("mse"), F.avg(F.when(actual != 0, F.abs(d / actual)) * 100).alias("mape")]


def equal_count_bins(df: DataFrame, score: str, key: str, outcome: str, bins: int) -> DataFrame:
    """Calibration over bins of equal numbers of rows by (score, key), the last taking the remainder."""
    ranked = positions(df, [score, key], "__rn")
    n = df.agg(F.greatest(F.floor(F.count("*") / bins), F.lit(1)).alias("__size"))
    b = ranked.join(F.broadcast(n)).withColumn("bin", F.least(F.floor((F.col("__rn") - 1) / F.col("__size")) + 1, F.lit(bins)))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(outcome).alias("actual"))


def equal_width_bins(df: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Calibration over bins [i/n, (i+1)/n); a probability of 1 falls out of the last."""
    b = df.withColumn("bin", F.floor(F.col(probability) * bins)).filter(F.col("bin") < bins)
    out = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(probability).alias("predicted"), F.avg(outcome).alias("actual"))
    return out.withColumn("squared_error", F.pow(F.col("predicted") - F.col("actual"), F.lit(2)))


def without_overround(df: DataFrame, by: Sequence[str], odds: str) -> DataFrame:
    """Implied probabilities scaled to 1 within the group."""
    p = 1 / F.col(odds)
    total = df.groupBy(*by).agg(F.sum(p).alias("__t"))
    return df.join(total, list(by)).withColumn("probability", p / F.col("__t")).drop("__t")


def strength_prior(df: DataFrame, rating: str, value: str, weights: tuple[float, float] = (0.7, 0.3), scale: float = 100.0) -> DataFrame:
    """Share of exp((strength - mean) / scale), strength a weighted sum of rating and value."""
    s = df.withColumn("__s", weights[0] * F.col(rating) + weights[1] * F.col(value))
    s = s.join(F.broadcast(s.agg(F.avg("__s").alias("__m")))).withColumn("__e", F.exp((F.col("__s") - F.col("__m")) / scale))
    return s.join(F.broadcast(s.agg(F.sum("__e").alias("__t")))).withColumn("prior", F.col("__e") / F.col("__t")).drop("__s", "__m", "__e", "__t")


def with_missing_members(priors: DataFrame, members: DataFrame, key: str, prior: str, factor: float = 0.5) -> DataFrame:
    """Members without a prior get `factor` of the smallest one; then all are scaled to sum to 1."""
    low = priors.agg((F.min(prior) * factor).alias(prior))
    absent = members.select(key).distinct().join(priors, key, "left_anti").join(F.broadcast(low))
    every = priors.select(key, prior).unionByName(absent.select(key, prior))
    return every.join(F.broadcast(every.agg(F.sum(prior).alias("__t")))).select(key, (F.col(prior) / F.col("__t")).alias(prior))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("__t"), F.count("*").alias("__k")))).select(label, "n", (F.col("__t") / (F.col("__k") * F.col("n"))).alias("weight"))
