"""Projections, filters, null handling and joins over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions import strings
from skeinwork.io import load
from skeinwork.operators import relational as rel
from skeinwork.plans.registry import Registry

query = Registry()

#: One row per player, season and gameweek: the one delivered last.
PANEL_SQL = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season, gameweek ORDER BY loaded_at DESC, row_id DESC) AS rn FROM fpl_merged) WHERE rn = 1)"


def panel(spark, d):
    w = Window.partitionBy("player_id", "season", "gameweek").orderBy(F.desc("loaded_at"), F.desc("row_id"))
    return load(spark, d, "fpl_merged").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


@query("SELECT o_orderkey AS x_o_orderkey, o_custkey AS x_o_custkey, o_orderstatus AS x_o_orderstatus, o_totalprice AS x_o_totalprice FROM orders")
def pr01_select_prefix(spark, d):
    """P1 P2."""
    return rel.prefixed(rel.keep(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "missing"]), "x_")


@query("SELECT row_id, player_name AS name, team_id AS team, gameweek AS round, price AS cost FROM fpl_merged")
def pr03_synonyms(spark, d):
    """P3 P4 S-level renaming."""
    m = rel.standard_names(load(spark, d, "fpl_merged"), {"name": ["Player_Name", "player"], "team": ["club", "TEAM_ID"], "round": ["gw", "gameweek"], "cost": ["now_cost", "price"]})
    return rel.keep(m, ["row_id", *rel.columns_like(m, "name")[:1], "team", "round", "cost"])


@query("SELECT row_id, coalesce(company_name, website, 'nobody') AS shown FROM df_traction")
def pr05_fallback_chain(spark, d):
    """P5 P19."""
    t = load(spark, d, "df_traction")
    return t.select("row_id", rel.first_of(t, "trading_name", "company_name", "website", default="nobody").alias("shown"))


@query("SELECT row_id, xp, price FROM fpl_merged WHERE xp BETWEEN 1 AND 6 AND price >= 5 AND (rest_days IS NULL OR rest_days BETWEEN 1 AND 365) AND position IN ('MID', 'FWD') AND coalesce(availability_status NOT IN ('i', 's'), true)")
def pr06_filters(spark, d):
    """All of it reaches the scan as pushed filters."""
    m = load(spark, d, "fpl_merged", "row_id", "xp", "price", "rest_days", "position", "availability_status")
    return m.filter(F.col("xp").between(1, 6) & (F.col("price") >= 5) & (F.col("rest_days").isNull() | F.col("rest_days").between(1, 365)) & F.col("position").isin("MID", "FWD") & F.coalesce(~F.col("availability_status").isin("i", "s"), F.lit(True))).select("row_id", "xp", "price")


@query("""WITH p AS (SELECT DISTINCT canonical_id, original_language AS lang, genres_norm AS g, num_votes AS v, runtime_minutes AS r FROM movies_master),
c AS (SELECT lang, count(*) FILTER (g LIKE '%Drama%' AND r > 150) AS n1, count(*) FILTER (g LIKE '%Drama%') AS n2 FROM p GROUP BY lang),
s AS (SELECT p.*, CASE WHEN n1 >= 50 THEN 1 WHEN n2 >= 50 THEN 2 ELSE 3 END AS stage FROM p JOIN c USING (lang)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY v DESC NULLS LAST, canonical_id) AS rn FROM s WHERE (stage = 1 AND g LIKE '%Drama%' AND r > 150) OR (stage = 2 AND g LIKE '%Drama%') OR stage = 3)
SELECT canonical_id, lang, CAST(stage AS INT) AS stage FROM k WHERE rn <= 200""")
def pr11_relaxed_filter(spark, d):
    """P11."""
    p = load(spark, d, "movies_master").select("canonical_id", F.col("original_language").alias("lang"), F.col("genres_norm").alias("g"), F.col("num_votes").alias("v"), F.col("runtime_minutes").alias("r")).distinct()
    drama = F.col("g").contains("Drama")
    return rel.relaxed(p, ["lang"], [drama & (F.col("r") > 150), drama, F.lit(True)], 50, 200, [F.desc_nulls_last("v"), F.asc("canonical_id")]).select("canonical_id", "lang", F.col("stage").cast("int").alias("stage"))


@query("""SELECT row_id, CASE WHEN total_points >= 10 THEN 'haul' WHEN total_points >= 5 THEN 'return' ELSE 'blank' END AS outcome, CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN 2 ELSE 9 END AS line,
  CASE availability_status WHEN 'a' THEN 'available' WHEN 'd' THEN 'doubtful' ELSE availability_status END AS status, coalesce(availability_status, 'none') AS status_filled, coalesce(rest_days, 7.0) AS rest,
  CAST(is_home AS INT) + CAST(total_points > 5 AS INT) AS flag_sum, (CASE WHEN xp IS NULL THEN 0 ELSE 1 END) + (CASE WHEN form IS NULL THEN 0 ELSE 1 END) + (CASE WHEN rest_days IS NULL THEN 0 ELSE 1 END) AS known,
  CASE WHEN xp IS NULL AND is_home THEN 2.0 WHEN xp IS NULL THEN 1.0 ELSE xp END AS xp_filled FROM fpl_merged""")
def pr12_case_recode_fill(spark, d):
    """P12 P13 P14 P15 P21 P24 P28 P29."""
    m = load(spark, d, "fpl_merged")
    p = F.col("total_points")
    known = sum(F.col(c).isNotNull().cast("int") for c in ("xp", "form", "rest_days"))
    return m.select(
        "row_id", F.when(p >= 10, "haul").when(p >= 5, "return").otherwise("blank").alias("outcome"), rel.recoded(F.col("position"), {"GKP": 1, "DEF": 2}, 9).alias("line"), rel.recoded(F.col("availability_status"), {"a": "available", "d": "doubtful"}, F.col("availability_status")).alias("status"),
        F.coalesce("availability_status", F.lit("none")).alias("status_filled"), F.coalesce("rest_days", F.lit(7.0)).alias("rest"), (F.col("is_home").cast("int") + (p > 5).cast("int")).alias("flag_sum"), known.alias("known"),
        F.when(F.col("xp").isNull() & F.col("is_home"), 2.0).when(F.col("xp").isNull(), 1.0).otherwise(F.col("xp")).alias("xp_filled"),
    )


@query("""SELECT row_id, round(coalesce(xp, (SELECT median(xp) FROM fpl_merged)), 6) AS xp, round(coalesce(rest_days, (SELECT avg(rest_days) FROM fpl_merged)), 6) AS rest_days,
  coalesce(availability_status, (SELECT availability_status FROM fpl_merged WHERE availability_status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS availability_status FROM fpl_merged""")
def pr16_fill_statistics(spark, d):
    """P16 P17 P18."""
    m = load(spark, d, "fpl_merged", "row_id", "xp", "rest_days", "availability_status")
    m = rel.fill_from_statistic(rel.fill_from_statistic(rel.fill_from_statistic(m, "xp", "median", 0.0), "rest_days", "mean"), "availability_status", "mode")
    return m.withColumns({c: F.round(c, 6) for c in ("xp", "rest_days")})


@query(f"""SELECT row_id, coalesce(last_value(xp IGNORE NULLS) OVER (PARTITION BY player_id ORDER BY season, gameweek ROWS UNBOUNDED PRECEDING), first_value(xp IGNORE NULLS) OVER (PARTITION BY player_id ORDER BY season, gameweek ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS xp FROM {PANEL_SQL}""")
def pr20_fill_along(spark, d):
    """P20."""
    return panel(spark, d).select("row_id", rel.filled_along("xp", ["player_id"], [F.col("season"), F.col("gameweek")]).alias("xp"))


@query("""SELECT n_nationkey, coalesce(n, 0) AS customers, coalesce(rich, '0') AS rich FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, max(CASE WHEN c_acctbal > 9900 THEN c_name END) AS rich FROM customer WHERE c_acctbal > 5000 GROUP BY 1) ON n_nationkey = c_nationkey""")
def pr23_zero_fill(spark, d):
    """P22 P23."""
    c = load(spark, d, "customer").dropna(subset=["c_nationkey"]).filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.max(F.when(F.col("c_acctbal") > 9900, F.col("c_name"))).alias("rich"))
    return rel.zeros_for_nulls(load(spark, d, "nation").select("n_nationkey").join(c, "n_nationkey", "left"), ["n_nationkey"])


@query("SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS row_no FROM embeddings")
def pr26_row_numbers(spark, d):
    """P26."""
    return load(spark, d, "embeddings", "vec_id", "label").select("vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("row_no"))


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def j01_inner_left(spark, d):
    """J1 J2 J8."""
    o, c, n = load(spark, d, "orders", "o_custkey", "o_totalprice"), load(spark, d, "customer", "c_custkey", "c_nationkey"), load(spark, d, "nation", "n_nationkey", "n_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH p AS {PANEL_SQL} SELECT a.row_id, a.player_id, b.total_points AS total_points_right FROM p a LEFT JOIN (SELECT player_id, season, gameweek + 1 AS gameweek, total_points FROM p) b USING (player_id, season, gameweek)""")
def j03_composite_key(spark, d):
    """Last week's points looked up by a key of three columns that must be unique."""
    p = panel(spark, d).select("row_id", "player_id", "season", "gameweek", "total_points")
    last = p.select("player_id", "season", (F.col("gameweek") + 1).alias("gameweek"), "total_points")
    return rel.lookup_join(p, last, ["player_id", "season", "gameweek"]).select("row_id", "player_id", "total_points_right")


@query("""WITH c AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1), r AS (SELECT o_custkey AS k, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT c_custkey AS k, c_mktsegment, orders, quantity FROM customer LEFT JOIN c ON c.k = c_custkey LEFT JOIN r ON r.k = c_custkey""")
def j04_left_chain(spark, d):
    """J4."""
    return _chain(spark, d)[0]


def _chain(spark, d):
    o, li = load(spark, d, "orders", "o_orderkey", "o_custkey"), load(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_returnflag")
    counts = o.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    returned = li.filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("l_quantity").alias("quantity"))
    return rel.join_chain(load(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), [("orders", counts), ("returned", returned)], ["k"])


@query("""SELECT round(avg(CAST(c_custkey IN (SELECT o_custkey FROM orders) AS INT)), 6) AS orders, round(avg(CAST(c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') AS INT)), 6) AS returned FROM customer""")
def j04_match_rates(spark, d):
    """J4, the match rates of the chain."""
    return _chain(spark, d)[1].select(*[F.round(c, 6).alias(c) for c in ("orders", "returned")])


@query("""SELECT coalesce(a.day, b.day)::VARCHAR AS day, coalesce(views, 0) AS views, coalesce(errors, 0) AS errors FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS views FROM events WHERE event_type = 'view' AND value > 250 GROUP BY 1) a FULL JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 250 GROUP BY 1) b ON a.day = b.day""")
def j05_full_outer(spark, d):
    """J5."""
    e = load(spark, d, "events").filter("value > 250").withColumn("day", F.to_date("ts").cast("string"))
    one = lambda kind, name: e.filter(F.col("event_type") == kind).groupBy("day").agg(F.count("*").alias(name))
    return one("view", "views").join(one("error", "errors"), "day", "full_outer").fillna(0)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j09_semi(spark, d):
    """J9 P7."""
    o = load(spark, d, "orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'P'")
    return load(spark, d, "customer", "c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT DISTINCT canonical_id FROM id_bridge r WHERE canonical_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM movies_master m WHERE m.canonical_id = r.canonical_id)")
def j10_anti(spark, d):
    """Linked films that the master table lacks."""
    r = load(spark, d, "id_bridge", "canonical_id").filter("canonical_id is not null").distinct()
    return r.join(load(spark, d, "movies_master", "canonical_id"), "canonical_id", "left_anti")



_STEM = "trim(regexp_replace(lower({c}), '( [0-9]+|,.*|:.*|\\(.*)$', ''))"
_RT_YEAR = "TRY_CAST(nullif(regexp_extract(releasedatetheaters, '(18|19|20)[0-9][0-9]'), '') AS INT)"


@query(f"""WITH a AS (SELECT DISTINCT canonical_id, {_STEM.format(c='title_norm')} AS t, year_norm AS y, runtime_minutes AS r FROM movies_master), b AS (SELECT DISTINCT id AS rt_id, {_STEM.format(c='title')} AS t, {_RT_YEAR} AS y, runtimeminutes AS r FROM rt_movies)
SELECT canonical_id, rt_id, count(*) AS ways FROM a JOIN b USING (t) WHERE t <> '' AND (a.y IS NULL OR b.y IS NULL OR abs(a.y - b.y) <= 1) AND (a.r IS NULL OR b.r IS NULL OR abs(a.r - b.r) <= 5) GROUP BY 1, 2""")
def j13_band(spark, d):
    """Films and records of one title stem within a year and five minutes."""
    stem = lambda c: F.trim(F.regexp_replace(F.lower(c), r"( [0-9]+|,.*|:.*|\(.*)$", ""))
    year = F.regexp_extract("releasedatetheaters", "(18|19|20)[0-9][0-9]", 0).try_cast("int")
    x = load(spark, d, "movies_master").select("canonical_id", stem("title_norm").alias("t"), F.col("year_norm").alias("y"), F.col("runtime_minutes").alias("r")).distinct()
    z = load(spark, d, "rt_movies").select(F.col("id").alias("rt_id"), stem("title").alias("t"), year.alias("y2"), F.col("runtimeminutes").alias("r2")).distinct()
    j = rel.band_join(x.filter("t <> ''"), z, ["t"], [(x["y"], z["y2"], 1), (x["r"], z["r2"], 5)])
    return j.groupBy("canonical_id", "rt_id").agg(F.count("*").alias("ways"))


@query()
def j11_fuzzy_theta(spark, d):
    """Titles of the two film tables, near years, running times within five minutes where known; a record with one
    best film is matched, one with several is a conflict. Only lengths that can reach the score are compared. Where a year is
    missing on either side the titles' sorted words must be equal."""
    m = load(spark, d, "movies_master").select("canonical_id", F.lower(F.trim("title_norm")).alias("t"), F.col("year_norm").alias("y"), F.col("runtime_minutes").alias("r")).distinct()
    from skeinwork.functions.dates import year_of

    k = load(spark, d, "rt_movies").select(F.col("id").alias("rt_id"), strings.title_key_without_year(F.col("title")).alias("t2"), year_of(F.col("releasedatetheaters")).alias("y2"), F.col("runtimeminutes").alias("r2")).distinct()
    words = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    near = F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1))
    reach = F.abs(F.length("t") - F.length("t2")) <= 0.1 * (F.length("t") + F.length("t2"))
    dated = m.filter("y is not null").withColumn("near", near).join(k.filter("y2 is not null"), F.col("near") == F.col("y2")).filter(reach).drop("near")
    undated = m.withColumn("w", words("t")).join(k.withColumn("w", words("t2")), "w").filter("y is null or y2 is null").drop("w")
    pairs = dated.unionByName(undated).filter("r is null or r2 is null or abs(r - r2) <= 5")
    scored = pairs.withColumn("score", rel.fuzzy_score(F.col("t"), F.col("t2"), "token_sort")).filter("score >= 90")
    best = Window.partitionBy("rt_id").orderBy(F.desc("score"))
    top = scored.withColumn("rk", F.rank().over(best)).filter("rk = 1").groupBy("rt_id").agg(F.countDistinct("canonical_id").alias("films"), F.min("canonical_id").alias("canonical_id"), F.max("score").alias("score"))
    return top.select("rt_id", F.when(F.col("films") == 1, F.col("canonical_id")).alias("canonical_id"), F.round("score", 3).alias("score"), F.when(F.col("films") == 1, "matched").otherwise("conflict").alias("outcome"))


@query()
def j12_blocked_fuzzy(spark, d):
    """J12 F24."""
    from skeinwork.functions.dates import year_of

    m = load(spark, d, "movies_master").select("canonical_id", F.lower(F.trim("title_norm")).alias("t"), F.col("year_norm").alias("y")).distinct()
    k = load(spark, d, "rt_movies").select("id", strings.title_key_without_year(F.col("title")).alias("t"), year_of(F.col("releasedatetheaters")).alias("y")).distinct()
    return rel.blocked_fuzzy_match(k, m, "id", "canonical_id", "t", "y")


@query("""SELECT k, CASE WHEN k IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'pending' WHEN k IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'open' ELSE 'unresolved' END AS source FROM (SELECT c_custkey AS k FROM customer)""")
def j14_cascade(spark, d):
    """J14."""
    o = load(spark, d, "orders", "o_custkey", "o_orderstatus").withColumnRenamed("o_custkey", "k")
    return rel.cascade_match(load(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k", [("pending", o.filter("o_orderstatus = 'P'")), ("open", o.filter("o_orderstatus = 'O'"))])


MATCHES_SQL = "(SELECT l_orderkey AS match_id, min(l_suppkey) AS home, max(l_suppkey) AS away, CAST(min(l_quantity) AS INT) % 5 AS home_goals, CAST(max(l_quantity) AS INT) % 4 AS away_goals, CAST(max(l_shipdate) AS DATE) AS day FROM lineitem GROUP BY 1 HAVING min(l_suppkey) < max(l_suppkey))"


def matches(spark, d):
    """Synthetic matches: two suppliers of an order meet."""
    li = load(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_shipdate")
    m = li.groupBy(F.col("l_orderkey").alias("match_id")).agg(F.min("l_suppkey").alias("home"), F.max("l_suppkey").alias("away"), (F.min("l_quantity").cast("int") % 5).alias("home_goals"), (F.max("l_quantity").cast("int") % 4).alias("away_goals"), F.to_date(F.max("l_shipdate")).alias("day"))
    return m.filter("home < away")


@query(f"""WITH m AS {MATCHES_SQL}, u AS (SELECT home AS team, home_goals AS goals, day, match_id FROM m UNION ALL SELECT away, away_goals, day, match_id FROM m)
SELECT team, match_id, goals, date_diff('day', lag(day) OVER (PARTITION BY team ORDER BY day, match_id), day) AS rest FROM u""")
def j15_either_side(spark, d):
    """A team's matches home or away, and days since the last."""
    m = matches(spark, d)
    u = rel.sides(m, "home", "away", ["match_id", "home_goals", "away_goals", "day"]).withColumn("goals", F.when(F.col("is_home"), F.col("home_goals")).otherwise(F.col("away_goals")))
    w = Window.partitionBy("team").orderBy("day", "match_id")
    return u.select("team", "match_id", "goals", F.datediff("day", F.lag("day").over(w)).cast("long").alias("rest"))


@query(f"""WITH p AS {PANEL_SQL} SELECT t.team_id, CAST(t.loaded_at AS VARCHAR) AS loaded, f.row_id AS asof_row_id FROM fpl_teams t ASOF LEFT JOIN (SELECT CAST(team_id AS INT) AS team_id, kickoff_time, max(row_id) AS row_id FROM p GROUP BY 1, 2) f ON t.team_id = f.team_id AND f.kickoff_time <= t.loaded_at + INTERVAL 1000 DAY""")
def j17_as_of(spark, d):
    """The last appearance for each team 1,000 days after it was loaded."""
    f = panel(spark, d).groupBy("team_id", "kickoff_time").agg(F.max("row_id").alias("row_id"))
    t = load(spark, d, "fpl_teams", "team_id", "loaded_at").withColumn("cutoff", F.col("loaded_at") + F.expr("interval 1000 days"))
    return rel.as_of_join(t, f, ["team_id"], "cutoff", "kickoff_time", ["row_id"]).select("team_id", F.col("loaded_at").cast("string").alias("loaded"), "asof_row_id")


@query("SELECT s_suppkey, round(s_acctbal / (SELECT sum(s_acctbal) FROM supplier), 8) AS share, round(s_acctbal - (SELECT avg(s_acctbal) FROM supplier), 4) AS above FROM supplier")
def j18_scalars_on_rows(spark, d):
    """J18."""
    s = load(spark, d, "supplier")
    one = s.agg(F.sum("s_acctbal").alias("total"), F.avg("s_acctbal").alias("mean"))
    return s.join(F.broadcast(one)).select("s_suppkey", F.round(F.col("s_acctbal") / F.col("total"), 8).alias("share"), F.round(F.col("s_acctbal") - F.col("mean"), 4).alias("above"))


@query("""WITH f AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1) SELECT l_orderkey, count(*) AS pairs, sum(y - x) AS apart FROM (SELECT l_orderkey, unnest(p) AS x, p FROM f) a, unnest(a.p) AS t(y) WHERE x < y GROUP BY 1""".replace("sum(y - x)", "CAST(sum(y - x) AS BIGINT)"))
def j20_pairs_in_lists(spark, d):
    """Pairs inside each order's short list of parts, i before j."""
    f = load(spark, d, "lineitem", "l_orderkey", "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    x = f.select("l_orderkey", "p", F.posexplode("p").alias("i", "x"))
    y = x.select("l_orderkey", "x", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("y"))
    return y.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.sum(F.col("y") - F.col("x")).alias("apart"))


@query("""SELECT (SELECT count(DISTINCT canonical_id) FROM ratings_long_format WHERE canonical_id IN (SELECT canonical_id FROM movies_master)) AS shared, (SELECT count(DISTINCT canonical_id) FROM ratings_long_format) AS rated, (SELECT count(DISTINCT canonical_id) FROM movies_master) AS known""")
def j22_overlap(spark, d):
    """J22."""
    r, m = load(spark, d, "ratings_long_format", "canonical_id").filter("canonical_id is not null").distinct(), load(spark, d, "movies_master", "canonical_id").distinct()
    shared = r.join(m, "canonical_id", "left_semi").agg(F.count("*").alias("shared"))
    return shared.join(r.agg(F.count("*").alias("rated"))).join(m.agg(F.count("*").alias("known")))


@query("""SELECT r_name, n_name, c_mktsegment, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, count(DISTINCT p_brand) AS brands, count(DISTINCT s_nationkey) AS supplier_nations, coalesce(max(e.n), 0) AS busiest FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON user_id = c_custkey GROUP BY 1, 2, 3""")
def j23_snowflake(spark, d):
    """Eight tables."""
    t = {n: load(spark, d, n) for n in ("region", "nation", "customer", "orders", "lineitem", "part", "supplier")}
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    e = load(spark, d, "events", "user_id").groupBy("user_id").agg(F.count("*").alias("n"))
    j = j.join(e, F.col("c_custkey") == F.col("user_id"), "left")
    return j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"), F.countDistinct("p_brand").alias("brands"), F.countDistinct("s_nationkey").alias("supplier_nations"), F.coalesce(F.max("n"), F.lit(0)).alias("busiest"))


@query("""WITH m AS (SELECT canonical_id, max(num_votes) AS votes FROM movies_master GROUP BY 1), r AS (SELECT canonical_id, avg(CAST(rating AS DOUBLE)) AS rating FROM ratings_long_format WHERE rating BETWEEN 0.5 AND 5 AND NOT isnan(rating) GROUP BY 1), n AS (SELECT movie_id AS canonical_id, count(*) AS links FROM movies_neighbors_k50 GROUP BY 1)
SELECT canonical_id, votes, round(rating, 5) AS rating, links FROM m JOIN r USING (canonical_id) JOIN n USING (canonical_id)""")
def j24_three_features(spark, d):
    """J24."""
    m = load(spark, d, "movies_master", "canonical_id", "num_votes").groupBy("canonical_id").agg(F.max("num_votes").alias("votes"))
    r = load(spark, d, "ratings_long_format", "canonical_id", "rating").filter("rating between 0.5 and 5 and not isnan(rating)").groupBy("canonical_id").agg(F.round(F.avg(F.col("rating").cast("double")), 5).alias("rating"))
    n = load(spark, d, "movies_neighbors_k50", "movie_id").groupBy(F.col("movie_id").alias("canonical_id")).agg(F.count("*").alias("links"))
    return m.join(r, "canonical_id").join(n, "canonical_id")


@query("""WITH a AS (SELECT canonical_id, max(num_votes) AS votes FROM movies_master GROUP BY 1), b AS (SELECT canonical_id, count(*) AS n FROM ratings_long_format GROUP BY 1) SELECT count(*) AS films, round(corr(ln(1 + votes), CAST(n AS DOUBLE)), 5) AS r FROM a JOIN b USING (canonical_id) WHERE votes IS NOT NULL""")
def j25_join_correlation(spark, d):
    """J25 A22."""
    a = load(spark, d, "movies_master", "canonical_id", "num_votes").groupBy("canonical_id").agg(F.max("num_votes").alias("votes"))
    b = load(spark, d, "ratings_long_format", "canonical_id").groupBy("canonical_id").agg(F.count("*").cast("double").alias("n"))
    return a.join(b, "canonical_id").filter("votes is not null").agg(F.count("*").alias("films"), F.round(F.corr(F.log1p("votes"), "n"), 5).alias("r"))


QUERIES, SQL = query.queries, query.sql
