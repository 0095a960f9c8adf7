"""Text, vectors, recommendations and their evaluation over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions import arrays
from skeinwork.io import load
from skeinwork.operators import ordered, recommend, textsearch
from skeinwork.plans.aggregation import valid_ratings
from skeinwork.plans.registry import Registry
from skeinwork.plans.windows import _DEDUPED, one_rating
from skeinwork.session import cut, default_parallelism, drop_cut, shared_file

query = Registry()

_TERMS = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) > 1) AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT doc_id AS doc, term, count(*) AS tf FROM t GROUP BY 1, 2),
v AS (SELECT term, count(*) AS docs, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tf GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.6 * (SELECT count(*) FROM documents)),
r AS (SELECT doc, term, tf * idf AS w FROM tf JOIN v USING (term)), l AS (SELECT doc, sqrt(sum(w * w)) AS l FROM r GROUP BY 1)"""


def _weights(spark, d):
    return textsearch.tf_idf(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(f"WITH {_TERMS} SELECT doc, term, round(w / l, 6) AS weight FROM r JOIN l USING (doc)")
def l01_tf_idf(spark, d):
    """L1."""
    return _weights(spark, d)[0].withColumn("weight", F.round("weight", 6))


_ASKED = (("q1", "oil price demand"), ("q2", "the film and its ending"), ("q3", "midfielder goal match"), ("q4", "founder of the company"), ("q5", "salary remote"))
_ASKED_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _ASKED)


@query(f"""WITH {_TERMS}, q0 AS (SELECT query, list_filter(regexp_split_to_array(text, '[^a-z]+'), lambda x: length(x) > 1) AS w FROM (VALUES {_ASKED_SQL}) t(query, text)),
q1 AS (SELECT query, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM q0), q2 AS (SELECT query, term, count(*) * any_value(idf) AS w FROM q1 JOIN v USING (term) GROUP BY 1, 2), ql AS (SELECT query, sqrt(sum(w * w)) AS ql FROM q2 GROUP BY 1),
s AS (SELECT query, doc, round(sum(q2.w / ql * r.w / l), 9) AS score FROM q2 JOIN ql USING (query) JOIN r USING (term) JOIN l USING (doc) GROUP BY 1, 2)
SELECT query, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""")
def l02_search(spark, d):
    """L2: five queries against all documents."""
    weights, vocabulary = _weights(spark, d)
    q = spark.createDataFrame(list(_ASKED), "query string, text string")
    return textsearch.search(weights, vocabulary, q, 10).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS x FROM embeddings), p AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, round(round(list_cosine_similarity(a.x, b.x), 9), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.x, b.x), 9) DESC, b.vec_id) AS rank FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT id, neighbor, score, rank FROM p WHERE rank <= 50""")
def l03_exact_knn(spark, d):
    """L3 at the reference's k of 50."""
    return recommend.exact_knn(load(spark, d, "embeddings"), "vec_id", "embedding", 50).withColumn("score", F.round("score", 6))


def _neighbours(spark, d):
    n = load(spark, d, "movies_neighbors_k50").filter("movie_id <> neighbor_id and score is not null and not isnan(score)").groupBy("movie_id", "neighbor_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("movie_id").orderBy(F.desc("score"), "neighbor_id")
    return n.withColumn("rank", F.row_number().over(w)).filter("rank <= 50")


_NB = "n AS (SELECT * FROM (SELECT movie_id, neighbor_id, max(score) AS score, row_number() OVER (PARTITION BY movie_id ORDER BY max(score) DESC, neighbor_id) AS rank FROM movies_neighbors_k50 WHERE movie_id <> neighbor_id AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2) WHERE rank <= 50)"
_SEED = f"s AS (SELECT user_index AS user, canonical_id AS item FROM (SELECT *, row_number() OVER (PARTITION BY user_index ORDER BY rating DESC, rated_at DESC, canonical_id) AS r FROM {_DEDUPED}) WHERE r <= 20)"


SEEDS = 20


def _rated(spark, d):
    """Each user's one rating of a film, written once for all that a query asks of it."""
    return cut(one_rating(spark, d), "rated")


def _seeds(r):
    return ordered.first_rows(r, ["user_index"], [F.desc("rating"), F.desc("rated_at"), F.asc("canonical_id")], SEEDS).select(F.col("user_index").alias("user"), F.col("canonical_id").alias("item"))


@query(f"""WITH {_NB}, {_SEED}, f AS (SELECT user, neighbor_id AS item, count(*) AS hits, max(score) AS best, list_avg(list_sort(list(score), 'DESC')[1:10]) AS m FROM s JOIN n ON s.item = n.movie_id GROUP BY 1, 2)
SELECT user, item, hits, round(best, 6) AS best, round(m, 10) AS mean_top10 FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user = f.user AND s.item = f.item)""")
def l05_content_expansion(spark, d):
    """The twenty favourites of every user, spread to their neighbours."""
    e = recommend.expand_by_neighbours(cut(_seeds(one_rating(spark, d)), "seeds"), _neighbours(spark, d))
    return e.withColumns({"best": F.round("best", 6), "mean_top10": F.round("mean_top10", 10)})


_BLEND = f"""{_NB}, {_SEED}, c AS (SELECT user, neighbor_id AS item, max(score) AS content FROM s JOIN n ON s.item = n.movie_id GROUP BY 1, 2), g AS (SELECT canonical_id AS item, avg(rating) / 5 AS popular, count(*) AS votes FROM {_DEDUPED} GROUP BY 1), h AS (SELECT user_index AS user, count(*) AS history FROM {_DEDUPED} GROUP BY 1),
b AS (SELECT user, item, CASE WHEN popular IS NULL THEN content ELSE a * content + (1 - a) * popular END + 0.05 * coalesce(least(votes / 100.0, 1), 0) + 0.03 * coalesce((greatest(least(y, 2030), 1900) - 1900) / 130.0, 0.5) + 0.02 * coalesce(CAST(linked AS INT), 0) AS score FROM (SELECT *, CASE WHEN history <= 2 THEN 0.8 WHEN history <= 10 THEN 0.6 WHEN history <= 100 THEN 0.4 ELSE 0.2 END AS a FROM c LEFT JOIN g USING (item) JOIN h USING (user)
  LEFT JOIN (SELECT canonical_id AS item, max(year_norm) AS y FROM movies_master GROUP BY 1) USING (item) LEFT JOIN (SELECT canonical_id AS item, bool_or(has_tmdb) AS linked FROM id_bridge WHERE canonical_id IS NOT NULL GROUP BY 1) USING (item))),
r AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY round(score, 9) DESC, item) AS rank FROM b)"""


def _films(spark, d, ratings):
    """What the blend asks of a film: popularity, votes, year, link."""
    g = ratings.groupBy(F.col("canonical_id").alias("item")).agg((F.avg("rating") / 5).alias("popular"), F.count("*").alias("votes"))
    years = load(spark, d, "movies_master", "canonical_id", "year_norm").groupBy(F.col("canonical_id").alias("item")).agg(F.max("year_norm").alias("y"))
    links = load(spark, d, "id_bridge", "canonical_id", "has_tmdb").filter("canonical_id is not null").groupBy(F.col("canonical_id").alias("item")).agg(F.bool_or("has_tmdb").alias("linked"))
    return g.join(years, "item", "full").join(links, "item", "full")


def _boosts():
    recent = F.coalesce((F.greatest(F.least("y", F.lit(2030)), F.lit(1900)) - 1900) / 130.0, F.lit(0.5))
    return [(F.least(F.col("votes") / 100, F.lit(1.0)), 0.05), (recent, 0.03), (F.col("linked").cast("double"), 0.02)]


def _recs(spark, d, k=10, ratings=None):
    """The k best of every user (all if None): content and popularity, with small boosts for votes, recency and links."""
    ratings = _rated(spark, d) if ratings is None else ratings
    c = _seeds(ratings).join(_neighbours(spark, d), F.col("item") == F.col("movie_id")).groupBy("user", F.col("neighbor_id").alias("item")).agg(F.max("score").alias("content"))
    h = ratings.groupBy(F.col("user_index").alias("user")).agg(F.count("*").alias("history"))
    score = recommend.blended(F.col("content"), F.col("popular"), recommend.cohort_alpha(F.col("history")), _boosts())
    s = c.join(_films(spark, d, ratings), "item", "left").join(h, "user").select("user", "item", F.round(score, 9).alias("score"))
    w = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    s = s.withColumn("rank", F.row_number().over(w))
    return s if k is None else s.filter(F.col("rank") <= k)


@query(f"WITH {_BLEND} SELECT user, item, round(round(score, 9), 6) AS score, rank FROM r WHERE rank <= 10")
def l06_hybrid(spark, d):
    """Content and popularity blended with the user's cohort weight."""
    return _recs(spark, d).withColumn("score", F.round("score", 6))


def _vectors(spark, d):
    v = load(spark, d, "movies_embedding_v1", "canonical_id", "embedding").filter("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return v.groupBy(F.col("canonical_id").alias("item")).agg(F.min("embedding").alias("embedding"))


def _mmr_joined(spark, d):
    """`l09_mmr` by joins: every candidate travels with its vector."""
    return recommend.mmr(_recs(spark, d, 500).join(_vectors(spark, d), "item"), "user", "item", "score", "embedding", 20, pool=500)


@query()
def l09_mmr(spark, d):
    """The hybrid list made diverse with the films' vectors. All that a film brings is written once into a file, from
    which each user's candidates are made and re-ranked in one go; only seeds and results travel."""
    path = shared_file(spark, "films")
    if path is None:
        return _mmr_joined(spark, d)
    n = default_parallelism(spark)
    one = valid_ratings(spark, d).repartition("user_index").groupBy("user_index", "canonical_id").agg(F.max(F.struct("rated_at", "rating")).alias("m")).select("user_index", "canonical_id", "m.rating", "m.rated_at")
    user = Window.partitionBy("user_index")
    place = F.row_number().over(user.orderBy(F.desc("rating"), F.desc("rated_at"), F.asc("canonical_id")))
    rated = cut(one.withColumns({"place": place, "history": F.count("*").over(user)}).select("user_index", "canonical_id", "rating", "place", "history"), "rated")
    near = cut(_neighbours(spark, d).select("movie_id", "neighbor_id", F.col("score").cast("double").alias("score")), "neighbours")
    codes = recommend.ordered_codes(near.select(F.explode(F.array("movie_id", "neighbor_id")).alias("item")), "item", n)
    lists = near.join(codes.withColumnRenamed("item", "neighbor_id"), "neighbor_id").groupBy(F.col("movie_id").alias("item")).agg(F.collect_list(F.struct("code", "score")).alias("near"))
    v = _vectors(spark, d)
    films = codes.join(_films(spark, d, rated), "item", "left").join(v, "item", "left").join(lists, "item", "left")
    boosts = F.array(*[F.coalesce(c, F.lit(0.0)) * w for c, w in _boosts()])
    record = recommend.item_record(50, 3, 64, dict(v.dtypes)["embedding"] == "array<float>")
    recommend.write_items(films.select("code", F.col("near.code").alias("near"), F.col("near.score").alias("score"), "popular", boosts.alias("boosts"), F.col("embedding").alias("x")), path, record)
    drop_cut(near)
    seeds = rated.filter(F.col("place") <= SEEDS).join(codes.withColumnRenamed("item", "canonical_id"), "canonical_id").repartition(n, "user_index")
    users = seeds.groupBy(F.col("user_index").alias("user")).agg(recommend.cohort_alpha(F.first("history")).alias("alpha"), F.collect_list("code").alias("seeds"))
    return recommend.mmr_of_seeds(users, path, record, 20, pool=500).join(codes, "code").select("user", "item", "rank")


@query(f"WITH u AS (SELECT DISTINCT user_index FROM {_DEDUPED}) SELECT count(*) AS users, min(i) AS low, max(i) AS high, count(DISTINCT i) AS indices FROM (SELECT row_number() OVER (ORDER BY user_index) - 1 AS i FROM u)")
def l14_matrix_indices(spark, d):
    """Dense indices, whose set is what SQL can check."""
    i = recommend.dense_indices(one_rating(spark, d), "user_index")
    return i.agg(F.count("*").alias("users"), F.min("index").alias("low"), F.max("index").alias("high"), F.countDistinct("index").alias("indices"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS l FROM v) SELECT vec_id, round((x[1] / l + CASE WHEN vec_id % 2 = 0 THEN 0.5 * x[2] ELSE 0 END) / (1 + CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE 0 END), 6) AS first, round(list_sum(list_transform(x, lambda y: y / l)) , 5) AS total FROM n""")
def l15_weighted_vectors(spark, d):
    """The unit vector and, where there is one, a shifted second vector."""
    e = load(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    shifted = F.when(F.col("vec_id") % 2 == 0, F.concat(F.slice(x, 2, 63), F.slice(x, 1, 1)))
    m = arrays.weighted_mean_vector([(arrays.unit(x), 1.0), (shifted, 0.5)], 64)
    total = F.aggregate(arrays.unit(x), F.lit(0.0), lambda a, v: a + v)
    return e.select("vec_id", F.round(m[0], 6).alias("first"), F.round(total, 5).alias("total"))


@query(f"""WITH {_NB} SELECT count(*) AS rows, count(*) FILTER (score < 0 OR score > 1) AS out_of_range, count(*) FILTER (movie_id = neighbor_id) AS self, (SELECT count(*) FROM (SELECT movie_id FROM n GROUP BY 1 HAVING max(rank) <> count(*))) AS gaps, (SELECT count(*) FROM n a JOIN n b ON a.movie_id = b.neighbor_id AND a.neighbor_id = b.movie_id WHERE a.movie_id < b.movie_id) AS mutual, (SELECT round(avg(abs(a.score - b.score)), 6) FROM n a JOIN n b ON a.movie_id = b.neighbor_id AND a.neighbor_id = b.movie_id WHERE a.movie_id < b.movie_id) AS asymmetry FROM n""")
def l17_neighbour_quality(spark, d):
    """L17 L17b."""
    n = _neighbours(spark, d)
    one = n.agg(F.count("*").alias("rows"), F.count_if((F.col("score") < 0) | (F.col("score") > 1)).alias("out_of_range"), F.count_if(F.col("movie_id") == F.col("neighbor_id")).alias("self"))
    gaps = n.groupBy("movie_id").agg(F.max("rank").alias("m"), F.count("*").alias("c")).agg(F.count_if(F.col("m") != F.col("c")).alias("gaps"))
    back = n.select(F.col("neighbor_id").alias("movie_id"), F.col("movie_id").alias("neighbor_id"), F.col("score").alias("back"))
    mutual = n.join(back, ["movie_id", "neighbor_id"]).filter("movie_id < neighbor_id").agg(F.count("*").alias("mutual"), F.round(F.avg(F.abs(F.col("score") - F.col("back"))), 6).alias("asymmetry"))
    return one.join(gaps).join(mutual)


_TRUTH = f"truth AS (SELECT user_index AS user, canonical_id AS item FROM (SELECT *, row_number() OVER (PARTITION BY user_index ORDER BY rated_at DESC, canonical_id) AS r, count(*) OVER (PARTITION BY user_index) AS n FROM {_DEDUPED}) WHERE r <= greatest(1, n // 5))"


def _truth(ratings):
    r = ratings.withColumn("at", F.unix_micros(F.col("rated_at").cast("timestamp")))
    return ordered.tail_holdout(r, ["user_index"], "at", [F.desc("at"), F.asc("canonical_id")]).filter("held_out").select(F.col("user_index").alias("user"), F.col("canonical_id").alias("item"))


_EVAL = f"""WITH {_BLEND}, {_TRUTH}, z AS (SELECT user, count(*) AS size FROM truth GROUP BY 1), h2 AS (SELECT r.user, r.rank, CASE WHEN t.item IS NOT NULL THEN 1 ELSE 0 END AS hit FROM r LEFT JOIN truth t ON r.user = t.user AND r.item = t.item WHERE rank <= 10),
c2 AS (SELECT *, sum(hit) OVER (PARTITION BY user ORDER BY rank) / rank AS so_far FROM h2), m AS (SELECT user, sum(hit) AS hits, sum(hit * so_far) AS ap, sum(hit / log2(rank + 1)) AS dcg FROM c2 GROUP BY 1),
e AS (SELECT user, hits / size AS recall, hits / 10.0 AS precision, ap / size AS average_precision, dcg / list_sum(list_transform(range(1, least(size, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM m JOIN z USING (user))"""


@query(f"{_EVAL} SELECT count(*) AS users, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(average_precision), 6) AS average_precision, round(avg(ndcg), 6) AS ndcg FROM e")
def e01_ranking_metrics(spark, d):
    """E1 E2 E3 E4 E7 W23."""
    r = _rated(spark, d)
    m = recommend.mean_metrics(recommend.per_user_metrics(_recs(spark, d, ratings=r), _truth(r), 10))
    return m.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "average_precision", "ndcg")})


@query(f"WITH {_BLEND} SELECT (SELECT round(count(DISTINCT user) / CAST((SELECT count(*) FROM h) AS DOUBLE), 6) FROM r WHERE rank <= 10) AS user_coverage, (SELECT round(count(DISTINCT item) / CAST((SELECT count(DISTINCT canonical_id) FROM movies_master) AS DOUBLE), 6) FROM r WHERE rank <= 10 AND item IN (SELECT canonical_id FROM movies_master)) AS item_coverage")
def e06_coverage(spark, d):
    """E6."""
    r = _rated(spark, d)
    c = recommend.coverage(_recs(spark, d, ratings=r), r.select(F.col("user_index").alias("user")), load(spark, d, "movies_master").select(F.col("canonical_id").alias("item")))
    return c.withColumns({x: F.round(x, 6) for x in ("user_coverage", "item_coverage")})


def _tags(spark, d):
    m = load(spark, d, "movies_master", "canonical_id", "genres_norm").filter("genres_norm <> ''").groupBy(F.col("canonical_id").alias("item")).agg(F.min("genres_norm").alias("g"))
    return m.select("item", F.split("g", r"\|").alias("tags"))


@query(f"""WITH {_BLEND}, g2 AS (SELECT canonical_id AS item, string_split(min(genres_norm), '|') AS tags FROM movies_master WHERE genres_norm <> '' GROUP BY 1), x AS (SELECT user, rank, tags FROM r JOIN g2 USING (item) WHERE rank <= 10)
SELECT a.user, round(1 - avg(coalesce(len(list_intersect(a.tags, b.tags)) / CAST(len(list_distinct(list_concat(a.tags, b.tags))) AS DOUBLE), 0)), 6) AS diversity FROM x a JOIN x b ON a.user = b.user AND a.rank < b.rank GROUP BY 1""")
def e08_diversity(spark, d):
    """E8 J20."""
    return recommend.list_diversity(_recs(spark, d), _tags(spark, d)).withColumn("diversity", F.round("diversity", 6))


@query(f"""WITH {_BLEND}, p AS (SELECT item, (rank() OVER (ORDER BY votes) - 1) / CAST(count(*) OVER () AS DOUBLE) AS pop FROM g) SELECT user, round(1 - avg(pop), 6) AS novelty FROM r JOIN p USING (item) WHERE rank <= 10 GROUP BY 1""")
def e09_novelty(spark, d):
    """E9."""
    r = _rated(spark, d)
    g = r.groupBy(F.col("canonical_id").alias("item")).agg(F.count("*").alias("votes"))
    p = ordered.ranks(g, "votes", descending=False).select("item", "strict_percentile")
    return _recs(spark, d, ratings=r).join(p, "item").groupBy("user").agg(F.round(1 - F.avg("strict_percentile"), 6).alias("novelty"))


@query(f"""WITH {_BLEND}, v AS (SELECT canonical_id AS item, CAST(min(embedding) AS DOUBLE[]) AS x FROM movies_embedding_v1 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 GROUP BY 1)
SELECT r.user, round(1 - avg(coalesce(CASE WHEN list_dot_product(a.x, a.x) > 0 AND list_dot_product(b.x, b.x) > 0 THEN list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) END, 0)), 5) AS serendipity FROM r JOIN s ON r.user = s.user JOIN v a ON a.item = r.item JOIN v b ON b.item = s.item WHERE rank <= 10 GROUP BY 1""")
def e10_serendipity(spark, d):
    """Against the user's favourites."""
    v = load(spark, d, "movies_embedding_v1", "canonical_id", "embedding").filter("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))").groupBy("canonical_id").agg(F.min("embedding").alias("x"))
    rated = _rated(spark, d)
    r = _recs(spark, d, ratings=rated).join(v.select(F.col("canonical_id").alias("item"), F.col("x").alias("a")), "item")
    s = _seeds(rated).join(v.select(F.col("canonical_id").alias("item"), F.col("x").alias("b")), "item").select("user", "b")
    return r.join(s, "user").groupBy("user").agg(F.round(1 - F.avg(arrays.cosine(F.col("a"), F.col("b"))), 5).alias("serendipity"))


@query(f"""{_EVAL} SELECT CASE WHEN history <= 10 THEN 'light' WHEN history <= 100 THEN 'medium' ELSE 'heavy' END AS cohort, count(*) AS users, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(average_precision), 6) AS average_precision, round(avg(ndcg), 6) AS ndcg FROM e JOIN h USING (user) GROUP BY 1""")
def e11_by_cohort(spark, d):
    """E11 G17."""
    r = _rated(spark, d)
    h = r.groupBy(F.col("user_index").alias("user")).agg(F.count("*").alias("history"))
    cohort = F.when(F.col("history") <= 10, "light").when(F.col("history") <= 100, "medium").otherwise("heavy")
    m = recommend.mean_metrics(recommend.per_user_metrics(_recs(spark, d, ratings=r), _truth(r), 10).join(h, "user").withColumn("cohort", cohort), ["cohort"])
    return m.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "average_precision", "ndcg")})


_GRID = f"""WITH {_BLEND}, {_TRUTH}, z AS (SELECT user, count(*) AS size FROM truth GROUP BY 1), gs AS (SELECT user, item, alpha, round(CASE WHEN popular IS NULL THEN content ELSE alpha * content + (1 - alpha) * popular END, 9) AS score FROM c LEFT JOIN g USING (item), (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (1.0::DOUBLE)) t(alpha)),
gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user, alpha ORDER BY score DESC, item) AS rank FROM gs) WHERE rank <= 10), h2 AS (SELECT gr.user, alpha, gr.rank, CASE WHEN t.item IS NOT NULL THEN 1 ELSE 0 END AS hit FROM gr LEFT JOIN truth t ON gr.user = t.user AND gr.item = t.item),
c2 AS (SELECT *, sum(hit) OVER (PARTITION BY user, alpha ORDER BY rank) / rank AS so_far FROM h2), m AS (SELECT user, alpha, sum(hit) AS hits, sum(hit * so_far) AS ap, sum(hit / log2(rank + 1)) AS dcg FROM c2 GROUP BY 1, 2),
e AS (SELECT alpha, count(*) AS users, avg(hits / size) AS recall, avg(hits / 10.0) AS precision, avg(ap / size) AS average_precision, avg(dcg / list_sum(list_transform(range(1, least(size, 10) + 1), lambda i: 1 / log2(i + 1)))) AS ndcg FROM m JOIN z USING (user) GROUP BY 1)"""


@query(f"""{_GRID} SELECT alpha, users, round(recall, 6) AS recall, round(precision, 6) AS precision, round(average_precision, 6) AS average_precision, round(ndcg, 6) AS ndcg, alpha = (SELECT alpha FROM e ORDER BY average_precision DESC, ndcg DESC, recall DESC LIMIT 1) AS is_best, round((average_precision / nullif((SELECT average_precision FROM e WHERE alpha = 0), 0) - 1) * 100, 4) AS lift_percent FROM e""")
def e12_alpha_grid(spark, d):
    """Every weight is scored anew; the best by MAP, then NDCG, then recall, and its lift over pure popularity."""
    ratings = _rated(spark, d)
    c = _seeds(ratings).join(_neighbours(spark, d), F.col("item") == F.col("movie_id")).groupBy("user", F.col("neighbor_id").alias("item")).agg(F.max("score").alias("content"))
    g = ratings.groupBy(F.col("canonical_id").alias("item")).agg((F.avg("rating") / 5).alias("popular"))
    grid = c.join(g, "item", "left").withColumn("alpha", F.explode(F.array(*map(F.lit, (0.0, 0.3, 0.5, 0.7, 1.0)))))
    s = grid.select(F.concat_ws(":", "user", "alpha").alias("user"), "item", F.round(recommend.blended(F.col("content"), F.col("popular"), F.col("alpha")), 9).alias("score"))
    recs = s.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item"))).filter("rank <= 10")
    truth = _truth(ratings).withColumn("alpha", F.explode(F.array(*map(F.lit, (0.0, 0.3, 0.5, 0.7, 1.0))))).select(F.concat_ws(":", "user", "alpha").alias("user"), "item")
    m = recommend.mean_metrics(recommend.per_user_metrics(recs, truth, 10).withColumn("alpha", F.substring_index("user", ":", -1).cast("double")), ["alpha"])
    best = m.agg(F.max_by("alpha", F.struct("average_precision", "ndcg", "recall")).alias("best"), F.max_by("average_precision", -F.col("alpha")).alias("base"))
    lift = F.try_divide(F.col("average_precision"), F.col("base")) - 1
    return m.join(F.broadcast(best)).select("alpha", "users", *[F.round(x, 6).alias(x) for x in ("recall", "precision", "average_precision", "ndcg")], (F.col("alpha") == F.col("best")).alias("is_best"), F.round(lift * 100, 4).alias("lift_percent"))


@query(f"""WITH {_BLEND}, {_TRUTH}, o AS (SELECT t.user, count(r.item) / CAST(count(*) AS DOUBLE) AS reachable FROM truth t LEFT JOIN r ON r.user = t.user AND r.item = t.item GROUP BY 1) SELECT count(*) AS users, round(avg(reachable), 6) AS oracle_recall FROM o""")
def e15_oracle_recall(spark, d):
    """How much of the truth is anywhere among the candidates."""
    r = _rated(spark, d)
    c = _recs(spark, d, None, r).select("user", "item", F.lit(1).alias("x"))
    o = _truth(r).join(c, ["user", "item"], "left").groupBy("user").agg((F.count("x") / F.count("*")).alias("reachable"))
    return o.agg(F.count("*").alias("users"), F.round(F.avg("reachable"), 6).alias("oracle_recall"))


@query(f"""WITH {_NB}, p AS (SELECT movie_id, neighbor_id, row_number() OVER (PARTITION BY movie_id ORDER BY n.score * coalesce(v.votes, 0) DESC, neighbor_id) AS rank FROM n LEFT JOIN (SELECT canonical_id, max(num_votes) AS votes FROM movies_master GROUP BY 1) v ON v.canonical_id = neighbor_id)
SELECT a.movie_id AS user, count(p.neighbor_id) / 10.0 AS overlap FROM n a LEFT JOIN p ON p.movie_id = a.movie_id AND p.neighbor_id = a.neighbor_id AND p.rank <= 10 WHERE a.rank <= 10 GROUP BY 1""")
def e16_overlap(spark, d):
    """Neighbours by similarity against the same weighted by votes."""
    n = _neighbours(spark, d)
    v = load(spark, d, "movies_master", "canonical_id", "num_votes").groupBy(F.col("canonical_id").alias("neighbor_id")).agg(F.max("num_votes").alias("votes"))
    w = Window.partitionBy("movie_id").orderBy(F.desc(F.col("score") * F.coalesce("votes", F.lit(0))), "neighbor_id")
    b = n.join(v, "neighbor_id", "left").select(F.col("movie_id").alias("user"), F.col("neighbor_id").alias("item"), F.row_number().over(w).alias("rank"))
    return recommend.overlap_at(n.select(F.col("movie_id").alias("user"), F.col("neighbor_id").alias("item"), "rank"), b, 10)


@query(f"""WITH {_BLEND}, m AS (SELECT canonical_id AS item, max(num_votes) AS v, max(year_norm) AS y, bool_or(coalesce(regexp_matches(lower(title_norm), '\\b([2-9]|ii|iii|iv)\\b'), false)) AS fr FROM movies_master GROUP BY 1), x AS (SELECT * FROM r LEFT JOIN m USING (item) WHERE rank <= 10)
SELECT user, CAST(avg(CAST(coalesce(v > 100000, false) AS INT)) > 0.7 AS INT) AS popularity_bias, CAST(avg(CAST(coalesce(v < 1000, false) AS INT)) < 0.2 AS INT) AS no_tail, CAST(coalesce(max(y) - min(y), 0) > 20 AS INT) AS drift, CAST(avg(CAST(coalesce(y < 2000, false) AS INT)) > 0.5 AS INT) AS stale, CAST(sum(CAST(coalesce(fr, false) AS INT)) > 2 AS INT) AS franchise FROM x GROUP BY 1""")
def e14_error_taxonomy(spark, d):
    """E14."""
    fr = F.coalesce(F.lower("title_norm").rlike(r"\b([2-9]|ii|iii|iv)\b"), F.lit(False))
    m = load(spark, d, "movies_master").groupBy(F.col("canonical_id").alias("item")).agg(F.max("num_votes").alias("v"), F.max("year_norm").alias("y"), F.bool_or(fr).alias("fr"))
    x = _recs(spark, d).join(m, "item", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return x.groupBy("user").agg((F.avg(flag(F.col("v") > 100000)) > 0.7).cast("int").alias("popularity_bias"), (F.avg(flag(F.col("v") < 1000)) < 0.2).cast("int").alias("no_tail"), (F.coalesce(F.max("y") - F.min("y"), F.lit(0)) > 20).cast("int").alias("drift"), (F.avg(flag(F.col("y") < 2000)) > 0.5).cast("int").alias("stale"), (F.sum(flag(F.col("fr"))) > 2).cast("int").alias("franchise"))


@query(f"""WITH {_NB}, {_SEED}, f AS (SELECT user, neighbor_id AS item, count(*) AS hits, max(score) AS best FROM s JOIN n ON s.item = n.movie_id GROUP BY 1, 2), h AS (SELECT user_index AS user, count(*) AS history FROM {_DEDUPED} GROUP BY 1),
x AS (SELECT f.*, history, row_number() OVER (PARTITION BY user ORDER BY hits DESC, round(best, 9) DESC, item) AS place FROM f JOIN h USING (user) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user = f.user AND s.item = f.item))
SELECT user, item, place FROM x WHERE place <= CASE WHEN history <= 2 THEN 200 WHEN history <= 10 THEN 500 ELSE 1000 END""")
def l05c_capped_candidates(spark, d):
    """Candidates by hits and best score, as many as the user's cohort may have."""
    r = _rated(spark, d)
    h = r.groupBy(F.col("user_index").alias("user")).agg(F.count("*").alias("history"))
    e = recommend.expand_by_neighbours(cut(_seeds(r), "seeds"), _neighbours(spark, d)).join(h, "user")
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("hits"), F.desc(F.round("best", 9)), "item"))
    return e.withColumn("place", place).filter(F.col("place") <= recommend.candidate_cap(F.col("history"))).select("user", "item", "place")


_VEC = "v AS (SELECT canonical_id AS item, CAST(min(embedding) AS DOUBLE[]) AS x FROM movies_embedding_v1 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 GROUP BY 1), tg AS (SELECT canonical_id AS item, list_sort(list_distinct(string_split(min(genres_norm), '|'))) AS tags FROM movies_master WHERE genres_norm <> '' GROUP BY 1)"


@query(f"""WITH {_BLEND}, {_VEC}, a AS (SELECT user, item AS anchor FROM (SELECT user_index AS user, canonical_id AS item, row_number() OVER (PARTITION BY user_index ORDER BY rating DESC, rated_at DESC, canonical_id) AS q FROM {_DEDUPED}) WHERE q = 1),
seen AS (SELECT user_index AS user, list_distinct(flatten(list(tags))) AS seen FROM {_DEDUPED} JOIN tg ON canonical_id = item GROUP BY 1)
SELECT r.user, r.item, anchor, round(CASE WHEN list_dot_product(vi.x, vi.x) > 0 AND list_dot_product(va.x, va.x) > 0 THEN list_dot_product(vi.x, va.x) / (sqrt(list_dot_product(vi.x, vi.x)) * sqrt(list_dot_product(va.x, va.x))) END, 5) AS cosine, round(sqrt(list_dot_product(vi.x, vi.x)), 4) AS item_norm, n.rank AS neighbour_rank,
CASE WHEN ti.tags IS NOT NULL AND ta.tags IS NOT NULL THEN CAST(len(list_intersect(ti.tags, ta.tags)) AS INT) END AS shared_genres, round(CASE WHEN ti.tags IS NOT NULL AND ta.tags IS NOT NULL THEN 1 END * len(list_intersect(ti.tags, ta.tags)) / CAST(len(list_distinct(list_concat(ti.tags, ta.tags))) AS DOUBLE), 6) AS genre_jaccard, round(CASE WHEN ti.tags IS NOT NULL AND seen IS NOT NULL THEN 1 END - len(list_intersect(ti.tags, seen)) / CAST(len(ti.tags) AS DOUBLE), 6) AS new_genre_share, CASE WHEN n.rank IS NOT NULL THEN 'anchor' WHEN popular IS NULL THEN 'content' ELSE 'blend' END AS path
FROM r JOIN a USING (user) LEFT JOIN g ON g.item = r.item LEFT JOIN v vi ON vi.item = r.item LEFT JOIN v va ON va.item = anchor LEFT JOIN tg ti ON ti.item = r.item LEFT JOIN tg ta ON ta.item = anchor LEFT JOIN n ON n.movie_id = anchor AND n.neighbor_id = r.item LEFT JOIN seen ON seen.user = r.user WHERE r.rank <= 10""")
def l06b_attribution(spark, d):
    """Why an item was recommended: its likeness to the user's favourite in vector, genres and neighbour lists."""
    ratings = _rated(spark, d)
    anchors = ordered.first_rows(ratings, ["user_index"], [F.desc("rating"), F.desc("rated_at"), F.asc("canonical_id")]).select(F.col("user_index").alias("user"), F.col("canonical_id").alias("anchor"))
    v = load(spark, d, "movies_embedding_v1", "canonical_id", "embedding").filter("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))").groupBy(F.col("canonical_id").alias("item")).agg(F.min("embedding").alias("x"))
    tags = _tags(spark, d).withColumn("tags", F.array_distinct("tags"))
    seen = ratings.select(F.col("user_index").alias("user"), F.col("canonical_id").alias("item")).join(tags, "item").select("user", F.explode("tags").alias("tag")).distinct().groupBy("user").agg(F.collect_list("tag").alias("seen"))
    popular = ratings.select(F.col("canonical_id").alias("item"), F.lit(True).alias("rated")).distinct()
    out = recommend.attributed(_recs(spark, d, ratings=ratings), anchors, v, tags, _neighbours(spark, d), seen)
    path = F.when(F.col("neighbour_rank").isNotNull(), "anchor").when(F.col("rated").isNull(), "content").otherwise("blend")
    return out.join(popular, "item", "left").select("user", "item", "anchor", F.round("cosine", 5).alias("cosine"), F.round("item_norm", 4).alias("item_norm"), "neighbour_rank", "shared_genres", F.round("genre_jaccard", 6).alias("genre_jaccard"), F.round("new_genre_share", 6).alias("new_genre_share"), path.alias("path"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), f AS (SELECT vec_id, [x[1:16], x[17:32], x[33:40], x[41:48], x[49:64]] AS f FROM v),
u AS (SELECT vec_id, flatten(list_transform([1, 2, 3, 4, 5], lambda i: list_transform(f[i], lambda y: y * [0.5, 0.2, 0.15, 0.05, 0.1][i] / CASE WHEN list_dot_product(f[i], f[i]) > 0 THEN sqrt(list_dot_product(f[i], f[i])) ELSE 1 END))) AS c FROM f)
SELECT a.vec_id, 64 AS dims, round(list_cosine_similarity(a.c, b.c), 5) AS cosine FROM u a JOIN u b ON b.vec_id = a.vec_id + 1""")
def l15_composite(spark, d):
    """Five families of unit length, weighted, turned by an orthogonal projection, of unit length again. The projection
    keeps angles, which is what SQL checks on neighbouring rows."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    families = [(F.slice(x, at, n), w) for at, n, w in ((1, 16, 0.5), (17, 16, 0.2), (33, 8, 0.15), (41, 8, 0.05), (49, 16, 0.1))]
    c = load(spark, d, "embeddings").select("vec_id", recommend.composite(families, 64).alias("c"))
    b = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("c").alias("next"))
    return c.join(b, "vec_id").select("vec_id", F.size("c").alias("dims"), F.round(F.aggregate(F.zip_with("c", "next", lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y), 5).alias("cosine"))


QUERIES, SQL = query.queries, query.sql
