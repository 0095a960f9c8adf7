"""Windows, ranks, top-k, duplicates and sets over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.io import load
from skeinwork.operators import ordered, sports
from skeinwork.plans.aggregation import VALID_SQL, valid_ratings
from skeinwork.plans.registry import Registry
from skeinwork.plans.relational import MATCHES_SQL, PANEL_SQL, matches, panel

query = Registry()
BY = ["player_id"]


def order():
    return [F.col("season"), F.col("gameweek")]


_W = "PARTITION BY player_id ORDER BY season, gameweek"


@query(f"""SELECT row_id, lag(total_points, 1) OVER w AS lag1, lag(total_points, 2) OVER w AS lag2, lag(total_points, 3) OVER w AS lag3, total_points - lag(total_points) OVER w AS step,
  round(avg(total_points) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3, round(avg(total_points) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS mean6, round(stddev_samp(total_points) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS spread3
  FROM {PANEL_SQL} WINDOW w AS ({_W})""")
def w01_lags_and_rolling(spark, d):
    """One sort of each player's weeks serves them all."""
    w = Window.partitionBy(*BY).orderBy(*order())
    p = F.col("total_points")
    r3, r6 = ordered.rolling(BY, order(), 3), ordered.rolling(BY, order(), 6)
    return panel(spark, d).select("row_id", *[F.lag(p, i).over(w).alias(f"lag{i}") for i in (1, 2, 3)], (p - F.lag(p).over(w)).alias("step"), F.round(F.avg(p).over(r3), 6).alias("mean3"), F.round(F.avg(p).over(r6), 6).alias("mean6"), F.round(F.stddev_samp(p).over(r3), 6).alias("spread3"))


@query(f"""WITH p AS (SELECT row_id, player_id, xp, row_number() OVER ({_W}) AS i FROM {PANEL_SQL})
SELECT a.row_id, round(sum(b.xp * pow(0.5, (a.i - b.i) / 3.0)) / sum(CASE WHEN b.xp IS NOT NULL THEN pow(0.5, (a.i - b.i) / 3.0) END), 5) AS ewm FROM p a JOIN p b ON a.player_id = b.player_id AND b.i <= a.i GROUP BY a.row_id""")
def w05_ewm(spark, d):
    """W5."""
    return ordered.ewm_mean(panel(spark, d), "xp", BY, order(), 3.0, "ewm").select("row_id", F.round("ewm", 5).alias("ewm"))


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC, gameweek DESC) AS r, avg(total_points) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS trail, count(*) OVER (PARTITION BY player_id) AS n FROM {PANEL_SQL})
SELECT player_id, round(avg(CAST(total_points >= trail AS INT)), 6) AS consistency FROM p WHERE r <= 6 AND n >= 7 GROUP BY 1""")
def w06_consistency(spark, d):
    """Of players with seven weeks or more."""
    w = Window.partitionBy(*BY)
    back = w.orderBy(F.desc("season"), F.desc("gameweek"))
    p = panel(spark, d).withColumns({"r": F.row_number().over(back), "trailing": F.avg("total_points").over(ordered.rolling(BY, order(), 6, 1)), "n": F.count("*").over(w)})
    return p.filter("r <= 6 and n >= 7").groupBy("player_id").agg(F.round(F.avg((F.col("total_points") >= F.col("trailing")).cast("int")), 6).alias("consistency"))


@query(f"""SELECT row_id, CASE WHEN count(*) OVER w = 6 THEN round(avg(CAST(is_home AS INT)) OVER w, 6) END AS home_ratio, round(price / median(price) OVER (PARTITION BY season, gameweek, position), 6) AS price_ratio FROM {PANEL_SQL} WINDOW w AS ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def w07_home_and_price_ratio(spark, d):
    """The group's median is an aggregate joined back, so no group is sorted whole in memory."""
    p = panel(spark, d)
    w = ordered.rolling(BY, order(), 6, 1)
    home = F.when(F.count("*").over(w) == 6, F.round(F.avg(F.col("is_home").cast("int")).over(w), 6))
    m = p.groupBy("season", "gameweek", "position").agg(F.median("price").alias("m"))
    return p.withColumn("home_ratio", home).join(m, ["season", "gameweek", "position"]).select("row_id", "home_ratio", F.round(F.col("price") / F.col("m"), 6).alias("price_ratio"))


@query(f"""WITH t AS (SELECT team_id, season, gameweek, sum(total_points) AS points FROM {PANEL_SQL} WHERE team_id IS NOT NULL GROUP BY 1, 2, 3) SELECT team_id, season, gameweek, round(avg(points) OVER (PARTITION BY team_id ORDER BY season, gameweek ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS team_form FROM t""")
def w09_rolling_of_groups(spark, d):
    """W9."""
    t = panel(spark, d).filter("team_id is not null").groupBy("team_id", "season", "gameweek").agg(F.sum("total_points").alias("points"))
    return t.select("team_id", "season", "gameweek", F.round(F.avg("points").over(ordered.rolling(["team_id"], order(), 3)), 6).alias("team_form"))


@query(f"""WITH m AS {MATCHES_SQL}, l AS (SELECT match_id, day, home AS team, home_goals AS s, away_goals AS c FROM m UNION ALL SELECT match_id, day, away, away_goals, home_goals FROM m), p AS (SELECT *, CASE WHEN s > c THEN 3 WHEN s = c THEN 1 ELSE 0 END AS points FROM l)
SELECT team, match_id, round(coalesce(avg(points) OVER w5, 0), 3) AS ppg, round(coalesce(avg(s - c) OVER w5, 0), 3) AS goal_difference, round(coalesce(avg(s) OVER w10, 0), 3) AS goals_for, round(coalesce(avg(c) OVER w10, 0), 3) AS goals_against, CAST(coalesce(sum(points) OVER w5, 0) AS BIGINT) AS recent_points, row_number() OVER (PARTITION BY team ORDER BY day, match_id) AS match_no FROM p
WINDOW w5 AS (PARTITION BY team ORDER BY day, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w10 AS (PARTITION BY team ORDER BY day, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def w10_form(spark, d):
    """W10 W11 W14."""
    f = sports.form(sports.team_log(matches(spark, d)))
    return f.select("team", "match_id", "ppg", "goal_difference", "goals_for", "goals_against", "recent_points", "match_no")


_SEEN = lambda m, t: f"coalesce(map_extract(r.{m}, m.{t})[1], 1500.0)"


@query(f"""WITH RECURSIVE m AS (SELECT match_id, home, away, home_goals, away_goals, s_nationkey AS league, row_number() OVER (PARTITION BY s_nationkey ORDER BY day, match_id) AS i FROM {MATCHES_SQL} JOIN supplier ON s_suppkey = home),
r AS (SELECT DISTINCT league, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS match_id, CAST(0 AS DOUBLE) AS a1, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS a2, CAST(0 AS DOUBLE) AS b2, MAP(CAST([] AS BIGINT[]), CAST([] AS DOUBLE[])) AS ea, MAP(CAST([] AS BIGINT[]), CAST([] AS DOUBLE[])) AS eb FROM m
UNION ALL SELECT league, i, match_id, a1, b1, a2, b2, map_concat(ea, MAP([home, away], [a1 + s1, b1 - s1])), map_concat(eb, MAP([home, away], [a2 + s2, b2 - s2])) FROM (
  SELECT *, 20 * (ln(abs(home_goals - away_goals) + 1) + 1) * (res - 1 / (1 + pow(10, (b1 - a1 - 60) / 400))) AS s1, 32 * (res - 1 / (1 + pow(10, (b2 - a2) / 400))) AS s2 FROM (
    SELECT m.league, m.i, CAST(m.match_id AS BIGINT) AS match_id, CAST(m.home AS BIGINT) AS home, CAST(m.away AS BIGINT) AS away, home_goals, away_goals, r.ea, r.eb, {_SEEN('ea', 'home')} AS a1, {_SEEN('ea', 'away')} AS b1, {_SEEN('eb', 'home')} AS a2, {_SEEN('eb', 'away')} AS b2, CASE WHEN home_goals > away_goals THEN 1.0 WHEN home_goals = away_goals THEN 0.5 ELSE 0.0 END AS res
    FROM r JOIN m ON m.league = r.league AND m.i = r.i + 1)))
SELECT league, match_id, round(a1, 4) AS home_elo_goals, round(b1, 4) AS away_elo_goals, round(a2, 4) AS home_elo, round(b2, 4) AS away_elo FROM r WHERE i > 0""")
def w12_elo(spark, d):
    """Both variants, a league for each nation of the home side."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("home"), F.col("s_nationkey").alias("league"))
    m = matches(spark, d).join(s, "home")
    a = sports.elo(m, "league").withColumnsRenamed({"home_elo": "home_elo_goals", "away_elo": "away_elo_goals"})
    b = sports.elo(m, "league", k=32.0, home_edge=0.0, goals_matter=False)
    return a.join(b, ["league", "match_id"]).select("league", "match_id", *[F.round(c, 4).alias(c) for c in ("home_elo_goals", "away_elo_goals", "home_elo", "away_elo")])


@query(f"""SELECT row_id, rank() OVER w + (count(*) OVER (PARTITION BY season, gameweek, total_points) - 1) / 2.0 AS average_place, row_number() OVER (PARTITION BY season, gameweek ORDER BY total_points DESC, player_id) AS place FROM {PANEL_SQL} WINDOW w AS (PARTITION BY season, gameweek ORDER BY total_points DESC)""")
def w15_ranks(spark, d):
    """W15 W16."""
    by = ["season", "gameweek"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total_points"), "player_id"))
    return panel(spark, d).select("row_id", ordered.average_rank(by, F.desc("total_points"), ["total_points"]).alias("average_place"), place.alias("place"))


@query("""WITH m AS (SELECT DISTINCT canonical_id, num_votes FROM movies_master), r AS (SELECT *, rank() OVER (ORDER BY num_votes) AS rk, count(*) OVER (PARTITION BY num_votes) AS same, count(*) OVER () AS n FROM m)
SELECT canonical_id, round((rk + (same - 1) / 2.0) / n, 8) AS percentile, round((rk - 1) / CAST(n AS DOUBLE), 8) AS strict_percentile, round((rk + (same - 1) / 2.0 - 1) / (n - 1), 8) AS rank_scaled FROM r""")
def w17_percentiles(spark, d):
    """W17 W18 W27 E9, without sorting the table in one task."""
    r = ordered.ranks(load(spark, d, "movies_master", "canonical_id", "num_votes").distinct(), "num_votes", descending=False)
    return r.select("canonical_id", *[F.round(c, 8).alias(c) for c in ("percentile", "strict_percentile", "rank_scaled")])


@query(f"""WITH g AS (SELECT user_index, count(*) AS n, min(rating) AS lo, max(rating) AS hi FROM {VALID_SQL} GROUP BY 1), p AS (SELECT DISTINCT user_index, canonical_id, max(rating) AS rating FROM {VALID_SQL} GROUP BY 1, 2)
SELECT user_index, canonical_id, round(CASE WHEN hi = lo THEN 0.5 ELSE (rating - lo) / (hi - lo) END, 6) AS scaled FROM p JOIN g USING (user_index)""")
def w19_min_max_per_user(spark, d):
    """The user's range is an aggregate joined back; a user with a tenth of all rows is no larger than any other."""
    r = valid_ratings(spark, d)
    g = r.groupBy("user_index").agg(F.min("rating").alias("lo"), F.max("rating").alias("hi"))
    p = r.groupBy("user_index", "canonical_id").agg(F.max("rating").alias("rating")).join(g, "user_index")
    return p.select("user_index", "canonical_id", F.round(F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("rating") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("scaled"))


@query(f"""WITH m AS {MATCHES_SQL}, u AS (SELECT home AS team, day, match_id FROM m UNION ALL SELECT away, day, match_id FROM m), n AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, match_id) AS i FROM u WHERE day >= DATE '2000-01-01')
SELECT team, match_id, i, coalesce(date_diff('day', lag(day) OVER (PARTITION BY team ORDER BY i), day), 7) AS rest, count(*) OVER (PARTITION BY team, week(day), isoyear(day)) AS in_week FROM n WHERE i <= 5""")
def w20_next_fixtures(spark, d):
    """W20 W21."""
    u = sports.team_log(matches(spark, d)).filter(F.col("day") >= F.lit("2000-01-01").cast("date"))
    w = Window.partitionBy("team").orderBy("day", "match_id")
    n = u.withColumn("i", F.row_number().over(w)).filter("i <= 5")
    rest = F.coalesce(F.datediff("day", F.lag("day").over(w)), F.lit(7)).cast("long")
    return n.select("team", "match_id", "i", rest.alias("rest"), F.count("*").over(Window.partitionBy("team", F.weekofyear("day"), F.extract(F.lit("YEAROFWEEK"), "day"))).alias("in_week"))


@query(f"""WITH p AS (SELECT row_id, list(total_points) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS x, lead(total_points) OVER ({_W}) AS y FROM {PANEL_SQL}) SELECT row_id, CAST(list_sum(x) AS BIGINT) AS window_sum, x[1] AS oldest, y FROM p WHERE len(x) = 10 AND y IS NOT NULL""")
def w22_supervised_windows(spark, d):
    """W22."""
    s = ordered.supervised_windows(panel(spark, d), BY, order(), ["total_points"], "total_points", 10)
    total = F.aggregate(F.col("window"), F.lit(0).cast("long"), lambda a, x: a + x["total_points"])
    return s.select("row_id", total.alias("window_sum"), F.col("window")[0]["total_points"].alias("oldest"), "y")


_DEDUPED = f"(SELECT user_index, canonical_id, rating, rated_at FROM (SELECT *, row_number() OVER (PARTITION BY user_index, canonical_id ORDER BY rated_at DESC, rating DESC) AS q FROM {VALID_SQL}) WHERE q = 1)"


def one_rating(spark, d):
    return valid_ratings(spark, d).groupBy("user_index", "canonical_id").agg(F.max(F.struct("rated_at", "rating")).alias("m")).select("user_index", "canonical_id", "m.rating", "m.rated_at")


@query(f"""SELECT user_index, canonical_id, r <= greatest(1, n // 5) AS held_out FROM (SELECT *, row_number() OVER (PARTITION BY user_index ORDER BY rated_at DESC, canonical_id) AS r, count(*) OVER (PARTITION BY user_index) AS n FROM {_DEDUPED})""")
def w24_tail_holdout(spark, d):
    """W24."""
    r = one_rating(spark, d).withColumn("at", F.unix_micros(F.col("rated_at").cast("timestamp")))
    return ordered.tail_holdout(r, ["user_index"], "at", [F.desc("at"), F.asc("canonical_id")]).select("user_index", "canonical_id", "held_out")


@query(f"""SELECT user_index, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY user_index ORDER BY rating DESC, canonical_id) AS r FROM {_DEDUPED}) WHERE r = 1""")
def w26_best_item(spark, d):
    """W26 W25 T3 T5."""
    return ordered.first_rows(one_rating(spark, d), ["user_index"], [F.desc("rating"), F.asc("canonical_id")]).select("user_index", "canonical_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def t01_top(spark, d):
    """T1 T2."""
    return load(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("(SELECT s_suppkey, 'top' AS side FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10) UNION ALL (SELECT s_suppkey, 'bottom' FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 10)")
def t04_top_and_bottom(spark, d):
    """T4."""
    s = load(spark, d, "supplier")
    top = s.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select("s_suppkey", F.lit("top").alias("side"))
    return top.unionByName(s.orderBy("s_acctbal", "s_suppkey").limit(10).select("s_suppkey", F.lit("bottom").alias("side")))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 50")
def t06_frequent_categories(spark, d):
    """T6."""
    return load(spark, d, "part", "p_name").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(50)


@query("SELECT canonical_id, link_method, match_score FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY CASE link_method WHEN 'via_links' THEN 0 WHEN 'fuzzy' THEN 1 ELSE 2 END, match_score DESC NULLS LAST, link_method, movieid, tconst, tmdbid, linked_at) AS r FROM (SELECT * REPLACE (CASE WHEN isnan(match_score) THEN NULL ELSE match_score END AS match_score) FROM id_bridge) WHERE canonical_id IS NOT NULL) WHERE r = 1")
def t07_dedupe_by_priority(spark, d):
    """T7 T8."""
    b = load(spark, d, "id_bridge").filter("canonical_id is not null").withColumn("match_score", F.when(~F.isnan("match_score"), F.col("match_score")))
    rank = F.when(F.col("link_method") == "via_links", 0).when(F.col("link_method") == "fuzzy", 1).otherwise(2)
    return ordered.first_rows(b, ["canonical_id"], [rank.asc(), F.desc_nulls_last("match_score"), F.asc_nulls_last("link_method"), F.asc_nulls_last("movieid"), F.asc_nulls_last("tconst"), F.asc_nulls_last("tmdbid"), F.asc_nulls_last("linked_at")]).select("canonical_id", "link_method", "match_score")


@query(f"""SELECT row_id, row_number() OVER (PARTITION BY season, gameweek, team_id ORDER BY position = 'GKP', xp DESC NULLS LAST, player_name, row_id) AS place FROM {PANEL_SQL} WHERE team_id IS NOT NULL AND position IS NOT NULL""")
def t15_bench_order(spark, d):
    """Each club's players of a week as a bench: by expected points, then name, keepers last."""
    p = panel(spark, d).filter("team_id is not null and position is not null")
    return sports.bench_order(p, ["season", "gameweek", "team_id"], "xp", ["player_name", "row_id"]).select("row_id", "place")


@query("SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM movies_master)) AS distinct_rows, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM movies_master GROUP BY canonical_id HAVING count(*) > 1)) AS in_doubled_keys FROM movies_master")
def t09_duplicates(spark, d):
    """T9 T10."""
    m = load(spark, d, "movies_master")
    doubled = m.groupBy("canonical_id").count().filter("count > 1").agg(F.sum("count").alias("in_doubled_keys"))
    return m.agg(F.count("*").alias("rows")).join(m.distinct().agg(F.count("*").alias("distinct_rows"))).join(doubled)


_SEEDS = f"""WITH cf AS (SELECT user_index, canonical_id, 1 AS stage, row_number() OVER (PARTITION BY user_index ORDER BY rating DESC, canonical_id) AS pos FROM {_DEDUPED}), pop AS (SELECT canonical_id, row_number() OVER (ORDER BY n DESC, canonical_id) AS pos FROM (SELECT canonical_id, count(*) AS n FROM {_DEDUPED} GROUP BY 1) ORDER BY n DESC, canonical_id LIMIT 20),
u AS (SELECT * FROM cf WHERE pos <= 5 UNION ALL SELECT DISTINCT user_index, p.canonical_id, 2, p.pos FROM cf, pop p WHERE cf.pos = 1), f AS (SELECT *, row_number() OVER (PARTITION BY user_index, canonical_id ORDER BY stage, pos) AS q FROM u)
SELECT user_index, canonical_id, CAST(stage AS INT) AS stage FROM (SELECT *, row_number() OVER (PARTITION BY user_index ORDER BY stage, pos) AS r FROM f WHERE q = 1) WHERE r <= 10"""


@query(_SEEDS)
def t11_union_with_provenance(spark, d):
    """Own favourites, then what is popular; the first stage that has an item wins."""
    r = one_rating(spark, d)
    own = Window.partitionBy("user_index").orderBy(F.desc("rating"), "canonical_id")
    cf = r.withColumn("pos", F.row_number().over(own)).filter("pos <= 5").select("user_index", "canonical_id", F.lit(1).alias("stage"), "pos")
    top = r.groupBy("canonical_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "canonical_id").limit(20)
    pop = top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "canonical_id"))).select("canonical_id", F.lit(2).alias("stage"), "pos")
    every = cf.unionByName(r.select("user_index").distinct().join(F.broadcast(pop)).select("user_index", "canonical_id", "stage", "pos"))
    first = every.groupBy("user_index", "canonical_id").agg(F.min(F.struct("stage", "pos")).alias("s")).select("user_index", "canonical_id", "s.stage", "s.pos")
    return ordered.first_rows(first, ["user_index"], [F.col("stage"), F.col("pos")], 10).select("user_index", "canonical_id", "stage")


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT canonical_id FROM movies_master INTERSECT SELECT canonical_id FROM ratings_long_format) UNION ALL SELECT 'only_known', count(*) FROM (SELECT canonical_id FROM movies_master EXCEPT SELECT canonical_id FROM ratings_long_format) UNION ALL SELECT 'either', count(*) FROM (SELECT canonical_id FROM movies_master UNION SELECT canonical_id FROM ratings_long_format)""")
def t13_sets(spark, d):
    """T13 T14."""
    a, b = load(spark, d, "movies_master", "canonical_id"), load(spark, d, "ratings_long_format", "canonical_id")
    n = lambda part, df: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return n("both", a.intersect(b)).unionByName(n("only_known", a.subtract(b))).unionByName(n("either", a.union(b).distinct()))


@query("""SELECT movie_id, neighbor_id FROM (SELECT movie_id, neighbor_id, row_number() OVER (PARTITION BY movie_id ORDER BY max(score) DESC, neighbor_id) AS r FROM movies_neighbors_k50 WHERE movie_id <> neighbor_id AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2) WHERE r <= 3""")
def t16_exclude_self(spark, d):
    """T16."""
    n = load(spark, d, "movies_neighbors_k50").filter("movie_id <> neighbor_id and score is not null and not isnan(score)").groupBy("movie_id", "neighbor_id").agg(F.max("score").alias("score"))
    return ordered.first_rows(n, ["movie_id"], [F.desc("score"), F.asc("neighbor_id")], 3).select("movie_id", "neighbor_id")


QUERIES, SQL = query.queries, query.sql
