"""Aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.io import load
from skeinwork.operators import aggregates as agg
from skeinwork.plans.registry import Registry
from skeinwork.plans.relational import PANEL_SQL, panel

query = Registry()
VALID_SQL = "(SELECT * FROM ratings_long_format WHERE user_index IS NOT NULL AND canonical_id IS NOT NULL AND NOT isnan(rating) AND rating BETWEEN 0.5 AND 5)"


def valid_ratings(spark, d, *columns):
    r = load(spark, d, "ratings_long_format", *(columns or ("user_index", "canonical_id", "rating", "rated_at")))
    return r.filter("user_index is not null and canonical_id is not null and not isnan(rating) and rating between 0.5 and 5")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, round(avg(l_quantity), 5) AS avg_qty, round(avg(l_extendedprice), 3) AS avg_price, min(l_tax) AS low_tax, max(l_tax) AS high_tax, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""")
def a01_group_aggregates(spark, d):
    """A1 A2."""
    li = load(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"), F.round(F.avg("l_quantity"), 5).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 3).alias("avg_price"), F.min("l_tax").alias("low_tax"), F.max("l_tax").alias("high_tax"), F.count("*").alias("n"))


@query("""SELECT position, count(*) AS rows, count(xp) AS with_xp, count(DISTINCT player_id) AS players, max(CAST(availability_status = 'i' AS INT)) AS any_injured, count(*) FILTER (is_home AND total_points > 5) AS home_returns,
  max(CASE position WHEN 'FWD' THEN 3 WHEN 'MID' THEN 2 ELSE 1 END) AS level FROM fpl_merged GROUP BY position""")
def a03_counts_and_flags(spark, d):
    """A3 A4 A7 A8 A16."""
    m = load(spark, d, "fpl_merged")
    level = F.when(F.col("position") == "FWD", 3).when(F.col("position") == "MID", 2).otherwise(1)
    return m.groupBy("position").agg(F.count("*").alias("rows"), F.count("xp").alias("with_xp"), F.countDistinct("player_id").alias("players"), F.bool_or(F.col("availability_status") == "i").cast("int").alias("any_injured"), F.count_if(F.col("is_home") & (F.col("total_points") > 5)).alias("home_returns"), F.max(level).alias("level"))


_SKETCHED = ("user_index", "canonical_id", "rating", "rated_at")


@query(" UNION ALL ".join(f"SELECT '{c}' AS counted, count(DISTINCT {c}) AS exact, true AS within FROM ratings_long_format" for c in _SKETCHED))
def a05_approximate_distinct(spark, d):
    """A5: sketches instead of exact counts for very many columns or values; here each is held against the exact count."""
    r = load(spark, d, "ratings_long_format", *_SKETCHED)
    # Apart from the exact counts: in one aggregate each distinct value would get sketches of its own.
    one = r.agg(*[F.approx_count_distinct(c, 0.01).alias(f"{c}_about") for c in _SKETCHED])
    for c in _SKETCHED:
        one = one.join(r.agg(F.countDistinct(c).alias(c)))
    rows = F.array(*[F.struct(F.lit(c).alias("counted"), F.col(c).alias("exact"), (F.abs(F.col(f"{c}_about") - F.col(c)) <= 0.05 * F.col(c)).alias("within")) for c in _SKETCHED])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query("SELECT row_id, cities FROM people_df JOIN (SELECT person_uuid, count(DISTINCT person_city) AS cities FROM people_df GROUP BY 1) USING (person_uuid)")
def a06_distinct_joined_back(spark, d):
    """A6."""
    return agg.distinct_joined_back(load(spark, d, "people_df", "row_id", "person_uuid", "person_city"), ["person_uuid"], "person_city", "cities").select("row_id", "cities")


@query(f"""SELECT player_id, arg_min(total_points, season || lpad(CAST(gameweek AS VARCHAR), 2, '0')) AS first_points, arg_max(total_points, season || lpad(CAST(gameweek AS VARCHAR), 2, '0')) AS last_points,
  coalesce((SELECT availability_status FROM {PANEL_SQL} q WHERE q.player_id = p.player_id AND availability_status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), 'Unknown') AS usual_status FROM {PANEL_SQL} p GROUP BY player_id""")
def a09_first_last_mode(spark, d):
    """A9 A10."""
    at = F.concat("season", F.lpad(F.col("gameweek").cast("string"), 2, "0"))
    return panel(spark, d).groupBy("player_id").agg(F.min_by("total_points", at).alias("first_points"), F.max_by("total_points", at).alias("last_points"), F.coalesce(F.mode("availability_status", True), F.lit("Unknown")).alias("usual_status"))


@query("""SELECT lang, string_agg(source, ', ' ORDER BY n DESC, source) AS top_source FROM (SELECT lang, source, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS r FROM (SELECT lang, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2)) WHERE r <= 5 GROUP BY lang""")
def a12_top_values(spark, d):
    """A12."""
    return agg.top_values(load(spark, d, "documents", "lang", "source"), ["lang"], "source", 5)


@query("SELECT kind, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 8) AS share FROM documents GROUP BY kind")
def a13_value_counts(spark, d):
    """A13."""
    return agg.shares(load(spark, d, "documents", "kind"), ["kind"]).withColumn("share", F.round("share", 8))


@query("""SELECT c_nationkey, """ + ", ".join(f"round(avg(c_acctbal) FILTER (c_mktsegment = '{s}'), 4) AS {s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer GROUP BY 1")
def a14_pivot(spark, d):
    """With the values named, so no pass to find them."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    p = load(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", segments).agg(F.round(F.avg("c_acctbal"), 4))
    return p.withColumnsRenamed({s: s.lower() for s in segments})


@query(f"""WITH s AS (SELECT player_id, season, avg(total_points) AS ppg, dense_rank() OVER (PARTITION BY player_id ORDER BY season DESC) AS r FROM {PANEL_SQL} GROUP BY 1, 2)
SELECT player_id, round(sum(ppg * CASE r WHEN 1 THEN 0.6 ELSE 0.4 END) / sum(CASE r WHEN 1 THEN 0.6 ELSE 0.4 END), 6) AS form FROM s WHERE r <= 2 GROUP BY 1""")
def a17_weighted_seasons(spark, d):
    """A17."""
    from pyspark.sql.window import Window

    s = panel(spark, d).groupBy("player_id", "season").agg(F.avg("total_points").alias("ppg"))
    s = s.withColumn("r", F.dense_rank().over(Window.partitionBy("player_id").orderBy(F.desc("season")))).filter("r <= 2").withColumn("w", F.when(F.col("r") == 1, 0.6).otherwise(0.4))
    return s.groupBy("player_id").agg(F.round(F.sum(F.col("ppg") * F.col("w")) / F.sum("w"), 6).alias("form"))


@query(f"""WITH p AS (SELECT team_id, season, CAST(sum(total_points) AS DOUBLE) AS points, count(*) * 90 AS minutes, count(*) FILTER (availability_status = 'i') * 7 AS days FROM {PANEL_SQL} GROUP BY 1, 2)
SELECT team_id, round(sum(points) / sum(minutes) * 90, 6) AS per_90, round(avg(days / (38.0 * 90 * 14) * 1000), 6) AS injury_rate, count(*) AS seasons FROM p GROUP BY team_id""")
def a18_rates(spark, d):
    """A18 A19 A20."""
    p = panel(spark, d).groupBy("team_id", "season").agg(F.sum("total_points").cast("double").alias("points"), (F.count("*") * 90).alias("minutes"), (F.count_if(F.col("availability_status") == "i") * 7).alias("days"))
    return p.groupBy("team_id").agg(F.round(F.sum("points") / F.sum("minutes") * 90, 6).alias("per_90"), F.round(F.avg(F.col("days") / (38.0 * 90 * 14) * 1000), 6).alias("injury_rate"), F.count("*").alias("seasons"))


@query("""WITH g AS (SELECT unnest(string_split(genres_norm, '|')) AS g, canonical_id, num_votes FROM (SELECT DISTINCT canonical_id, genres_norm, num_votes FROM movies_master WHERE genres_norm <> '')),
s AS (SELECT g, CAST(sum(num_votes) AS DOUBLE) AS v FROM g GROUP BY g), m AS (SELECT g, (v - (SELECT min(v) FROM s)) / ((SELECT max(v) FROM s) - (SELECT min(v) FROM s)) AS score FROM s)
SELECT canonical_id, round(avg(score), 6) AS genre_score FROM g JOIN m USING (g) GROUP BY canonical_id""")
def a21_explode_scale_mean(spark, d):
    """A21."""
    m = load(spark, d, "movies_master", "canonical_id", "genres_norm", "num_votes").distinct().filter("genres_norm <> ''")
    g = m.select("canonical_id", "num_votes", F.explode(F.split("genres_norm", r"\|")).alias("g"))
    s = g.groupBy("g").agg(F.sum("num_votes").cast("double").alias("v"))
    s = s.join(F.broadcast(s.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))).select("g", ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("score"))
    return g.join(F.broadcast(s), "g").groupBy("canonical_id").agg(F.round(F.avg("score"), 6).alias("genre_score"))


_CORR = ("xp", "form", "price", "total_points")


@query("SELECT " + ", ".join(f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 5) AS {a}__{b}" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]) + " FROM fpl_merged WHERE xp IS NOT NULL AND form IS NOT NULL AND price IS NOT NULL AND total_points IS NOT NULL")
def a23_correlations(spark, d):
    """A23."""
    m = load(spark, d, "fpl_merged", *_CORR).dropna().select(*[F.col(c).cast("double").alias(c) for c in _CORR])
    return m.agg(*[F.round(F.corr(a, b), 5).alias(f"{a}__{b}") for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]])


@query("""WITH y AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), f AS (SELECT p, regr_slope(v, y) AS a, regr_intercept(v, y) AS b FROM y GROUP BY p)
SELECT p, CAST(t AS INT) AS year, round(a * t + b, 2) AS forecast FROM f, range(2002, 2005) r(t)""")
def a24_regression_forecast(spark, d):
    """A24."""
    y = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").cast("double").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    f = y.groupBy("p").agg(F.regr_slope("v", "y").alias("a"), F.regr_intercept("v", "y").alias("b"))
    return f.withColumn("year", F.explode(F.array(*map(F.lit, (2002, 2003, 2004))))).select("p", "year", F.round(F.col("a") * F.col("year") + F.col("b"), 2).alias("forecast"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def a25_percentiles(spark, d):
    """A25."""
    return load(spark, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", q), 6).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def _sql_profile(c, t):
    return f"SELECT '{c}' AS column, count({c}) AS n, count(*) - count({c}) AS nulls, round(min(CAST({c} AS DOUBLE)), 5) AS low, round(max(CAST({c} AS DOUBLE)), 5) AS high, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS spread, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 5) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 5) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 5) AS q75 FROM {t}"


@query(" UNION ALL ".join(_sql_profile(c, "fpl_merged") for c in ("xp", "price", "form", "rest_days", "total_points")))
def a26_profile(spark, d):
    """A26."""
    p = agg.profile(load(spark, d, "fpl_merged"), ["xp", "price", "form", "rest_days", "total_points"])
    return p.withColumns({c: F.round(c, 5) for c in ("low", "high", "mean", "spread", "q25", "q50", "q75")})


_PEOPLE = ("row_id", "person_uuid", "person_name", "person_rank", "person_country_code", "person_city", "person_gender", "person_featured_job_title")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 8) AS share FROM people_df" for c in _PEOPLE))
def a27_null_report(spark, d):
    """A27 A41."""
    return agg.null_report(load(spark, d, "people_df", *_PEOPLE)).withColumn("share", F.round("share", 8))


@query("SELECT position, round(avg(abs(xp - total_points)), 6) AS mae, round(sqrt(avg(pow(xp - total_points, 2))), 6) AS rmse, round(avg(pow(xp - total_points, 2)), 6) AS mse, round(avg(CASE WHEN total_points <> 0 THEN abs((xp - total_points) / total_points) END * 100), 5) AS mape FROM fpl_merged GROUP BY 1")
def a28_errors(spark, d):
    """A28 E5."""
    e = agg.errors(F.col("total_points"), F.col("xp"))
    return load(spark, d, "fpl_merged", "position", "xp", "total_points").groupBy("position").agg(*e).select("position", *[F.round(c, 5 if c == "mape" else 6).alias(c) for c in ("mae", "rmse", "mse", "mape")])


@query("SELECT o_orderpriority, round(100 * (avg(o_totalprice) FILTER (year(o_orderdate) = 1998) / avg(o_totalprice) FILTER (year(o_orderdate) = 1997) - 1), 2) AS change FROM orders GROUP BY 1")
def a29_percentage_change(spark, d):
    """A29."""
    mean = lambda y: F.avg(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")))
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(100 * (mean(1998) / mean(1997) - 1), 2).alias("change"))


@query("SELECT row_id, annual_wages FROM fpl_merged JOIN (SELECT position, avg(annual_wages) AS m, stddev_samp(annual_wages) AS s FROM fpl_merged GROUP BY 1) USING (position) WHERE abs(annual_wages - m) <= 2 * s")
def a30_sigma_filter(spark, d):
    """A30."""
    return agg.within_sigma(load(spark, d, "fpl_merged", "row_id", "position", "annual_wages"), ["position"], "annual_wages", 2).select("row_id", "annual_wages")


@query("SELECT row_id, xp FROM fpl_merged JOIN (SELECT position, quantile_cont(xp, 0.25) AS a, quantile_cont(xp, 0.75) AS b FROM fpl_merged GROUP BY 1) USING (position) WHERE xp BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def a31_fence_filter(spark, d):
    """A31."""
    return agg.within_fences(load(spark, d, "fpl_merged", "row_id", "position", "xp"), ["position"], "xp").select("row_id", "xp")


@query(f"""SELECT user_index, canonical_id, count(*) AS n FROM {VALID_SQL} WHERE user_index IN (SELECT user_index FROM {VALID_SQL} GROUP BY 1 HAVING count(*) >= 3) AND canonical_id IN (SELECT canonical_id FROM {VALID_SQL} GROUP BY 1 HAVING count(*) >= 5) GROUP BY 1, 2""")
def a32_frequency_core(spark, d):
    """A32."""
    return agg.frequent(valid_ratings(spark, d, "user_index", "canonical_id", "rating"), "user_index", "canonical_id").groupBy("user_index", "canonical_id").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT season, gameweek, position, avg(total_points) AS v FROM {PANEL_SQL} GROUP BY 1, 2, 3) SELECT a.position, round(avg(CAST(a.v > b.v AS INT)), 6) AS win_rate, count(*) AS weeks FROM p a JOIN p b USING (season, gameweek) WHERE b.position = 'GKP' AND a.position <> 'GKP' GROUP BY 1""")
def a33_win_rate(spark, d):
    """A33."""
    p = panel(spark, d).groupBy("season", "gameweek", "position").agg(F.avg("total_points").alias("v"))
    base = p.filter("position = 'GKP'").select("season", "gameweek", F.col("v").alias("b"))
    return p.filter("position <> 'GKP'").join(base, ["season", "gameweek"]).groupBy("position").agg(F.round(F.avg((F.col("v") > F.col("b")).cast("int")), 6).alias("win_rate"), F.count("*").alias("weeks"))


@query("""WITH r AS (SELECT confidence, total_points, row_number() OVER (ORDER BY confidence, row_id) AS rn, (SELECT count(*) FROM fpl_merged WHERE confidence IS NOT NULL) AS n FROM fpl_merged WHERE confidence IS NOT NULL)
SELECT CAST(least(floor((rn - 1) / greatest(floor(n / 10), 1)) + 1, 10) AS BIGINT) AS bin, count(*) AS n, round(avg(confidence), 6) AS predicted, round(avg(CAST(total_points > 2 AS INT)), 6) AS actual FROM r GROUP BY 1""".replace("floor((rn - 1) / greatest(floor(n / 10), 1))", "((rn - 1) // greatest(n // 10, 1))").replace("floor(n / 10)", "(n // 10)"))
def a34_equal_count_bins(spark, d):
    """A34."""
    m = load(spark, d, "fpl_merged", "row_id", "confidence", "total_points").filter("confidence is not null").withColumn("hit", (F.col("total_points") > 2).cast("int"))
    b = agg.equal_count_bins(m, "confidence", "row_id", "hit", 10)
    return b.select(F.col("bin").cast("long").alias("bin"), "n", F.round("predicted", 6).alias("predicted"), F.round("actual", 6).alias("actual"))


@query("""SELECT CAST(floor(confidence * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(confidence), 6) AS predicted, round(avg(CAST(total_points > 2 AS INT)), 6) AS actual, round(pow(avg(confidence) - avg(CAST(total_points > 2 AS INT)), 2), 6) AS squared_error FROM fpl_merged WHERE confidence * 10 < 10 GROUP BY 1""")
def a35_equal_width_bins(spark, d):
    """A35."""
    m = load(spark, d, "fpl_merged", "confidence", "total_points").filter("confidence is not null").withColumn("hit", (F.col("total_points") > 2).cast("int"))
    b = agg.equal_width_bins(m, "confidence", "hit")
    return b.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("predicted", "actual", "squared_error")])


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, 1.5 + s_acctbal / 1000 + (CASE WHEN s_acctbal < 0 THEN 2 ELSE 0 END) AS odds FROM supplier) SELECT s_suppkey, round((1 / odds) / sum(1 / odds) OVER (PARTITION BY s_nationkey), 8) AS probability FROM s""")
def a36_overround(spark, d):
    """A36."""
    s = load(spark, d, "supplier").withColumn("odds", 1.5 + F.col("s_acctbal") / 1000 + F.when(F.col("s_acctbal") < 0, 2).otherwise(0))
    return agg.without_overround(s, ["s_nationkey"], "odds").select("s_suppkey", F.round("probability", 8).alias("probability"))


@query("""WITH s AS (SELECT s_suppkey AS team, 0.7 * (1500 + s_acctbal / 100) + 0.3 * (s_nationkey * 10) AS x FROM supplier WHERE s_suppkey % 7 <> 0), e AS (SELECT team, exp((x - (SELECT avg(x) FROM s)) / 100) AS e FROM s), p AS (SELECT team, e / (SELECT sum(e) FROM e) AS prior FROM e),
a AS (SELECT team, prior FROM p UNION ALL SELECT s_suppkey, (SELECT min(prior) * 0.5 FROM p) FROM supplier WHERE s_suppkey NOT IN (SELECT team FROM p)) SELECT team, round(prior / (SELECT sum(prior) FROM a), 8) AS prior FROM a""")
def a37_priors(spark, d):
    """A37 A38."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("team"), (1500 + F.col("s_acctbal") / 100).alias("elo"), (F.col("s_nationkey") * 10).alias("value"))
    p = agg.strength_prior(s.filter("team % 7 <> 0"), "elo", "value").select("team", "prior")
    return agg.with_missing_members(p, s, "team", "prior").withColumn("prior", F.round("prior", 8))


@query("SELECT lang, count(*) AS n, round((SELECT count(*) FROM documents WHERE lang IS NOT NULL) / CAST((SELECT count(DISTINCT lang) FROM documents) * count(*) AS DOUBLE), 8) AS weight FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def a39_class_weights(spark, d):
    """A39."""
    return agg.class_weights(load(spark, d, "documents", "lang").filter("lang is not null"), "lang").withColumn("weight", F.round("weight", 8))


@query(f"SELECT count(*) AS nnz, count(DISTINCT user_index) AS users, count(DISTINCT canonical_id) AS items, round(count(*) / (count(DISTINCT user_index) * CAST(count(DISTINCT canonical_id) AS DOUBLE)), 10) AS density FROM (SELECT DISTINCT user_index, canonical_id FROM {VALID_SQL})")
def a40_density(spark, d):
    """A40."""
    r = valid_ratings(spark, d, "user_index", "canonical_id", "rating").select("user_index", "canonical_id").distinct()
    n = r.agg(F.count("*").alias("nnz"), F.countDistinct("user_index").alias("users"), F.countDistinct("canonical_id").alias("items"))
    return n.withColumn("density", F.round(F.col("nnz") / (F.col("users") * F.col("items").cast("double")), 10))


@query("SELECT coalesce(kind, '*') AS kind, coalesce(lang, '*') AS lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang IS NOT NULL GROUP BY CUBE (kind, lang)")
def a42_cube(spark, d):
    """Grouping sets."""
    c = load(spark, d, "documents", "kind", "lang", "n_chars").filter("lang is not null").cube("kind", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return c.fillna("*", ["kind", "lang"])


QUERIES, SQL = query.queries, query.sql
