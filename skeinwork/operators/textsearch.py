"""TF-IDF and search in long form: (doc, term, weight) rows, no matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def terms(text: Column, longest: int = 2) -> Column:
    """Words and pairs of neighbouring words, repeats kept."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1)
    out = words
    if longest > 1:
        rest = F.greatest(F.size(words) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))
        out = F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))
    return out


def tf_idf(docs: DataFrame, doc: str, text: str, min_docs: int = 5, max_share: float = 0.6, max_terms: int = 200_000, longest: int = 2) -> tuple[DataFrame, DataFrame]:
    """((doc, term, weight), (term, docs, idf)): smooth idf, vectors of length 1.

    Terms of fewer than `min_docs` documents or more than `max_share` of them go; of the others the `max_terms` most frequent
    stay (ties by term). Counts cover all documents. Null and empty texts have no terms.
    """
    tf = docs.select(F.col(doc).alias("doc"), F.explode(terms(F.col(text), longest)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    n = docs.select(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("total"))
    vocabulary = df.join(F.broadcast(n)).filter((F.col("docs") >= min_docs) & (F.col("docs") <= F.col("n") * max_share))
    vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_terms).select("term", "docs", (F.log((1 + F.col("n")) / (1 + F.col("docs"))) + 1).alias("idf"))
    raw = tf.join(vocabulary, "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, "doc").select("doc", "term", (F.col("w") / F.col("length")).alias("weight")), vocabulary


def search(weights: DataFrame, vocabulary: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, doc, score, rank) of the k documents nearest each (query, text) by cosine."""
    q = queries.select("query", F.explode(terms(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("tf")).join(vocabulary, "term").withColumn("q", F.col("tf") * F.col("idf"))
    length = q.groupBy("query").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
    scored = q.join(length, "query").join(weights, "term").groupBy("query", "doc").agg(F.sum(F.col("q") / F.col("length") * F.col("weight")).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
