"""Factorisation, classifiers, calibration, metrics, splits and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions.strings import bucket_of
from skeinwork.operators.ordered import ranks
from skeinwork.operators.recommend import exact_knn
from skeinwork.operators.sports import uniform


# --- factorisation ---------------------------------------------------------------------------------------------------


def factorise(ratings: DataFrame, rank: int = 50, regularisation: float = 0.1, rounds: int = 10, seed: int = 7):
    """Alternating least squares on (user, item, rating) with integer users and items; the model has both factors."""
    from pyspark.ml.recommendation import ALS

    als = ALS(rank=rank, regParam=regularisation, maxIter=rounds, userCol="user", itemCol="item", ratingCol="rating", seed=seed, coldStartStrategy="drop", checkpointInterval=10)
    return als.fit(ratings)


def singular_values(triples: DataFrame, columns: int, k: int) -> list[float]:
    """The k largest singular values of the sparse matrix (row, column, value), by Lanczos iterations on distributed rows."""
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    entries = triples.rdd.map(lambda r: MatrixEntry(r[0], r[1], r[2]))
    rows = CoordinateMatrix(entries, numCols=columns).toIndexedRowMatrix()
    return rows.computeSVD(k, computeU=False).s.toArray().tolist()


# --- splits and samples ----------------------------------------------------------------------------------------------


def time_split(df: DataFrame, at: str, cutoff: Column) -> DataFrame:
    return df.withColumn("part", F.when(F.col(at) < cutoff, "train").otherwise("test"))


def season_folds(df: DataFrame, season: str, first: int = 2) -> DataFrame:
    """(fold, part, ...): fold i tests on season i + first and trains on all before it. Seasons are few."""
    seasons = [r[0] for r in df.select(season).distinct().orderBy(season).collect()]
    folds = [df.filter(F.col(season) <= seasons[i]).withColumn("part", F.when(F.col(season) == seasons[i], "test").otherwise("train")).withColumn("fold", F.lit(i - first + 1)) for i in range(first, len(seasons))]
    return reduce(DataFrame.unionByName, folds)


def rolling_folds(df: DataFrame, season: str, width: int = 2) -> DataFrame:
    """As season_folds, training on the last `width` seasons only."""
    seasons = [r[0] for r in df.select(season).distinct().orderBy(season).collect()]
    folds = [df.filter(F.col(season).isin(seasons[i - width : i + 1])).withColumn("part", F.when(F.col(season) == seasons[i], "test").otherwise("train")).withColumn("fold", F.lit(i - width + 1)) for i in range(width, len(seasons))]
    return reduce(DataFrame.unionByName, folds)


def hash_split(df: DataFrame, key: str, test_percent: int = 20, salt: str = "split") -> DataFrame:
    """A random split that is the same on every run: by the key's hash bucket."""
    b = bucket_of(F.concat(F.col(key).cast("string"), F.lit(f":{salt}")))
    return df.withColumn("part", F.when(b < test_percent, "test").otherwise("train"))


def stratified_sample(df: DataFrame, stratum: str, key: str, wanted: Mapping[str, float], size: int, salt: str = "sample") -> DataFrame:
    """About `size` rows, each stratum its share; what a small stratum lacks is borrowed from the others by their shares.

    Rows are chosen in hash order of the key, so the sample is the same on every run. Strata are few; each is cut by rank
    over a hash, kept per task first.
    """
    have = {r[0]: r[1] for r in df.groupBy(stratum).count().collect() if r[0] in wanted}
    take = {s: min(have.get(s, 0), round(size * w)) for s, w in wanted.items()}
    missing = min(size, sum(have.values())) - sum(take.values())
    for s in sorted(wanted, key=lambda s: (-(have.get(s, 0) - take[s]), s)):
        extra = max(0, min(missing, have.get(s, 0) - take[s]))
        take[s] += extra
        missing -= extra
    order = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{salt}")), 256)
    r = df.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key)))
    limit = F.create_map(*[F.lit(x) for s in sorted(take) for x in (s, take[s])])[F.col(stratum)]
    return r.filter(F.col("__r") <= limit).drop("__r")


# --- classifiers -----------------------------------------------------------------------------------------------------

MODELS = ("logistic", "forest", "boosting")


def classifier(kind: str, **parameters):
    from pyspark.ml import classification as c

    make = {"logistic": lambda: c.LogisticRegression(maxIter=30, **parameters), "forest": lambda: c.RandomForestClassifier(seed=7, **({"numTrees": 20, "maxDepth": 6} | parameters)), "boosting": lambda: c.GBTClassifier(seed=7, **({"maxIter": 10, "maxDepth": 4} | parameters)), "svm": lambda: c.LinearSVC(maxIter=30, **parameters)}
    return make[kind]()


def with_features(df: DataFrame, numbers: Sequence[str], label: Column, missing: float = 0.0) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.select(*df.columns, label.cast("double").alias("label")).fillna(missing, list(numbers))
    return VectorAssembler(inputCols=list(numbers), outputCol="features").transform(filled)


def predicted(model, df: DataFrame, name: str = "p") -> DataFrame:
    """Adds the probability of label 1 (for models without one, the sigmoid of the margin)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    p = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.withColumn(name, p).drop("probability", "rawPrediction", "prediction")


def voted(columns: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    weights = weights or [1.0] * len(columns)
    return sum((F.col(c) * w for c, w in zip(columns, weights, strict=True)), F.lit(0.0)) / sum(weights)


def stacked(train: DataFrame, columns: Sequence[str]):
    """A logistic model over the probabilities of other models; fit it on rows those were not trained on."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="stack"), LogisticRegression(featuresCol="stack", labelCol="label", maxIter=30)]).fit(train)


def binary_metrics(df: DataFrame, p: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1, brier, log_loss, auc and the confusion counts.

    The area under the curve comes from average ranks of distinct scores, without sorting the table in one task.
    """
    r = ranks(df.select(F.col(p).alias("p"), F.col(label).cast("double").alias("y")), "p", descending=False)
    hit = F.col("p") >= threshold
    tp, fp, fn, tn = (F.count_if(a & (F.col("y") == y)) for a, y in ((hit, 1), (hit, 0), (~hit, 1), (~hit, 0)))
    clipped = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    n1, n0 = F.sum("y"), F.sum(1 - F.col("y"))
    out = r.agg(
        F.count("*").alias("n"), F.avg(((F.col("p") >= threshold).cast("double") == F.col("y")).cast("double")).alias("accuracy"), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier"),
        F.avg(-(F.col("y") * F.log(clipped) + (1 - F.col("y")) * F.log(1 - clipped))).alias("log_loss"), F.try_divide(F.sum(F.col("y") * F.col("average_rank")) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
    )
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


# --- calibration -----------------------------------------------------------------------------------------------------


def isotonic(train: DataFrame, p: str, label: str):
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=p, labelCol=label, predictionCol="calibrated").fit(train)


def with_temperature(p: Column, temperature: float) -> Column:
    logit = F.log(p / (1 - p)) / temperature
    return 1 / (1 + F.exp(-logit))


def best_temperature(df: DataFrame, p: str, label: str, grid: Sequence[float] = tuple(0.25 * i for i in range(1, 25))) -> float:
    """The temperature of the grid with the least log loss: all of them in one aggregate."""
    x = F.greatest(F.least(F.col(p), F.lit(1 - 1e-9)), F.lit(1e-9))

    def loss(t: float) -> Column:
        q = F.greatest(F.least(with_temperature(x, t), F.lit(1 - 1e-12)), F.lit(1e-12))
        return F.avg(-(F.col(label) * F.log(q) + (1 - F.col(label)) * F.log(1 - q)))

    row = df.agg(*[loss(t).alias(str(i)) for i, t in enumerate(grid)]).first()
    return min(zip(row, grid, strict=True))[1]


# --- oversampling, explanation ---------------------------------------------------------------------------------------


def oversampled(rows: DataFrame, key: str, features: str, copies: int, k: int = 5) -> DataFrame:
    """(key, copy, neighbor, features): `copies` synthetic rows a row of a rare class, on the line to one of its k nearest.

    Neighbour and place on the line are drawn by hash, the same on every run. A row without neighbours gets none. `rows` has
    one class only and unique keys; the search for neighbours is `exact_knn`, in blocks.
    """
    near = exact_knn(rows.select(key, features), key, features, k, metric="euclid").select(F.col("id").alias(key), "neighbor", "rank")
    lists = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor"))).alias("__near"))
    made = rows.select(key, F.col(features).alias("__a")).join(lists, key).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    pick = F.floor(uniform(F.col(key), F.col("copy"), F.lit("which")) * F.size("__near")).cast("int")
    made = made.withColumn("neighbor", F.element_at("__near", pick + 1)["neighbor"])
    made = made.join(rows.select(F.col(key).alias("neighbor"), F.col(features).alias("__b")), "neighbor").withColumn("__u", uniform(F.col(key), F.col("copy"), F.lit("where")))
    gaps = F.array_repeat(F.col("__u"), F.size("__a"))
    step = F.zip_with(F.zip_with("__a", "__b", lambda a, b: b - a), gaps, lambda d, u: d * u)
    return made.select(key, "copy", "neighbor", F.zip_with("__a", step, lambda a, d: a + d).alias(features))


def linear_shapley(rows: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Adds `shap_<feature>`, the exact Shapley values of a linear score (or of the log odds of a logistic model) with
    independent features: weight times distance from the mean. A missing feature stands at the mean. Their sum is the
    row's score less the mean score."""
    means = rows.agg(*[F.avg(c).alias(f"__m_{c}") for c in weights])
    out = rows.join(F.broadcast(means))
    return out.withColumns({f"shap_{c}": F.coalesce(F.lit(w) * (F.col(c) - F.col(f"__m_{c}")), F.lit(0.0)) for c, w in weights.items()}).drop(*means.columns)


def network(inputs: int, hidden: Sequence[int] = (16, 8), rounds: int = 60, seed: int = 7):
    """A feed-forward network of two classes, trained by Spark on distributed rows (features, label)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, 2], maxIter=rounds, seed=seed, blockSize=128)
