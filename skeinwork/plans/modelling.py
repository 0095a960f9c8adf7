"""Learning, squads and season simulation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.io import load
from skeinwork.operators import learning as ml
from skeinwork.operators import recommend, seasonruns, sports
from skeinwork.plans.registry import Registry
from skeinwork.plans.relational import MATCHES_SQL, PANEL_SQL, matches, panel
from skeinwork.plans.windows import one_rating
from skeinwork.session import cut

query = Registry()
NUMBERS = ("xp", "form", "price", "confidence", "opponent_difficulty", "rest_days", "fixture_congestion", "points_per_game")


def _indexed(spark, d):
    r = one_rating(spark, d)
    u, i = recommend.dense_indices(r, "user_index").withColumnRenamed("index", "user"), recommend.dense_indices(r, "canonical_id").withColumnRenamed("index", "item")
    return r.join(u, "user_index").join(i, "canonical_id").select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), F.col("rating").cast("float").alias("rating"))


@query()
def l12_als(spark, d):
    """Fit on four fifths, error on the rest."""
    r = cut(ml.hash_split(_indexed(spark, d).withColumn("k", F.concat_ws(":", "user", "item")), "k").drop("k"), "indexed")
    model = ml.factorise(r.filter("part = 'train'"))
    p = model.transform(r.filter("part = 'test'"))
    e = F.col("prediction") - F.col("rating")
    return p.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


@query()
def l04_factor_scores(spark, d):
    """The ten items of highest inner product for every user, users against all items in blocks."""
    model = ml.factorise(cut(_indexed(spark, d), "indexed"))
    users = model.userFactors.select(F.col("id").alias("user"), F.col("features").alias("u"))
    return recommend.factor_scores(users, model.itemFactors.select(F.col("id").alias("item"), F.col("features").alias("v")), 10)


@query()
def l13_svd(spark, d):
    """The twenty largest singular values of the ratings matrix."""
    t = cut(_indexed(spark, d), "indexed")
    values = ml.singular_values(t, t.agg(F.max("item")).first()[0] + 1, 20)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "position int, singular_value double")


def _labelled(spark, d) -> DataFrame:
    p = ml.with_features(panel(spark, d).select("row_id", "season", *NUMBERS, "total_points"), NUMBERS, F.col("total_points") > 3)
    return cut(ml.time_split(p, "season", F.lit("2022-23")).select("row_id", "season", "features", "label", "part"), "labelled")


@query()
def l18_classifiers(spark, d):
    """Each model trained on the seasons before 2022-23 and judged on the rest."""
    x = _labelled(spark, d)
    out = []
    for kind in (*ml.MODELS, "svm"):
        model = ml.classifier(kind).fit(x.filter("part = 'train'"))
        out.append(ml.binary_metrics(ml.predicted(model, x.filter("part = 'test'")), "p", "label").withColumn("model", F.lit(kind)))
    return reduce(DataFrame.unionByName, out)


@query()
def l19_ensembles(spark, d):
    """Voting, stacking, and calibration of the vote, the last two fitted on rows the models did not see."""
    x = ml.hash_split(_labelled(spark, d).withColumnRenamed("part", "period"), "row_id", 30)
    base = x.filter("period = 'train' and part = 'train'")
    scored = x
    for kind in ml.MODELS:
        scored = ml.predicted(ml.classifier(kind).fit(base), scored, f"p_{kind}")
    names = [f"p_{k}" for k in ml.MODELS]
    scored = cut(scored.withColumn("vote", ml.voted(names)).drop("features"), "scored")
    held, test = scored.filter("period = 'train' and part = 'test'"), scored.filter("period = 'test'")
    stacked = ml.predicted(ml.stacked(held, names), test, "stack")
    iso = ml.isotonic(held, "vote", "label").transform(stacked)
    warm = iso.withColumn("tempered", ml.with_temperature(F.greatest(F.least("vote", F.lit(1 - 1e-9)), F.lit(1e-9)), ml.best_temperature(held, "vote", "label")))
    warm = cut(warm.select("label", "vote", "stack", "calibrated", "tempered"), "ensembles")
    return reduce(DataFrame.unionByName, [ml.binary_metrics(warm, c, "label").withColumn("model", F.lit(c)) for c in ("vote", "stack", "calibrated", "tempered")])


@query()
def l20_grid_search(spark, d):
    """Two regularisations over expanding season folds, mean log loss."""
    x = cut(ml.season_folds(_labelled(spark, d).drop("part"), "season", 4), "folds")
    folds = [r[0] for r in x.select("fold").distinct().orderBy("fold").collect()]
    out = []
    for reg in (0.0, 0.1):
        for f in folds:
            part = x.filter(F.col("fold") == f)
            m = ml.classifier("logistic", regParam=reg).fit(part.filter("part = 'train'"))
            out.append(ml.binary_metrics(ml.predicted(m, part.filter("part = 'test'")), "p", "label").select(F.lit(reg).alias("regularisation"), "log_loss", "brier"))
    return reduce(DataFrame.unionByName, out).groupBy("regularisation").agg(F.count("*").alias("folds"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"))


@query("""WITH s AS (SELECT confidence AS p, CAST(total_points > 3 AS INT) AS y FROM fpl_merged WHERE confidence IS NOT NULL), k AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s)
SELECT count(*) AS n, round(avg(CAST(CAST(p >= 0.5 AS INT) = y AS INT)), 6) AS accuracy, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))), 6) AS log_loss, round((sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(sum(1 - y) AS DOUBLE)), 6) AS auc,
count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM k""")
def l22_metrics(spark, d):
    """L22."""
    m = load(spark, d, "fpl_merged", "confidence", "total_points").filter("confidence is not null").withColumn("y", (F.col("total_points") > 3).cast("int"))
    b = ml.binary_metrics(m, "confidence", "y")
    return b.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "brier", "log_loss", "auc")], "tp", "fp", "fn", "tn")


@query(f"""WITH s AS (SELECT season, row_number() OVER (ORDER BY season) AS i FROM (SELECT DISTINCT season FROM fpl_merged)), p AS (SELECT season, count(*) AS n FROM {PANEL_SQL} GROUP BY 1)
SELECT 'expanding' AS kind, CAST(t.i - 2 AS INT) AS fold, CAST(sum(n) FILTER (s.i < t.i) AS BIGINT) AS train, CAST(sum(n) FILTER (s.i = t.i) AS BIGINT) AS test FROM s t, s JOIN p USING (season) WHERE t.i >= 3 AND s.i <= t.i GROUP BY t.i
UNION ALL SELECT 'rolling', CAST(t.i - 2 AS INT), CAST(sum(n) FILTER (s.i < t.i) AS BIGINT), CAST(sum(n) FILTER (s.i = t.i) AS BIGINT) FROM s t, s JOIN p USING (season) WHERE t.i >= 3 AND s.i BETWEEN t.i - 2 AND t.i GROUP BY t.i""")
def l23_splits(spark, d):
    """L23."""
    p = panel(spark, d).select("row_id", "season")
    n = [F.count_if(F.col("part") == x).alias(x) for x in ("train", "test")]
    a = ml.season_folds(p, "season").groupBy("fold").agg(*n).withColumn("kind", F.lit("expanding"))
    return a.unionByName(ml.rolling_folds(p, "season").groupBy("fold").agg(*n).withColumn("kind", F.lit("rolling")))


@query("SELECT row_id, CASE WHEN CAST('0x' || substr(sha256(row_id || ':split'), 1, 8) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM people_df")
def l24_hash_split(spark, d):
    """L24."""
    return ml.hash_split(load(spark, d, "people_df", "row_id"), "row_id")


@query("""WITH h AS (SELECT user_id, CASE WHEN n < 50 THEN 'light' WHEN n < 75 THEN 'medium' ELSE 'heavy' END AS stratum FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(user_id || ':sample'), user_id) AS r, count(*) OVER (PARTITION BY stratum) AS have FROM h),
t AS (SELECT stratum, have, least(have, CASE stratum WHEN 'medium' THEN 60 ELSE 20 END) AS take FROM (SELECT stratum, max(have) AS have FROM k GROUP BY 1)), w AS (SELECT *, least(100, (SELECT sum(have) FROM t)) - (SELECT sum(take) FROM t) AS missing, coalesce(sum(have - take) OVER (ORDER BY have - take DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT k.user_id, k.stratum FROM k JOIN w ON k.stratum = w.stratum WHERE r <= take + greatest(0, least(w.have - take, missing - before))""")
def l25_stratified_users(spark, d):
    """A hundred users, 20 / 60 / 20, what is lacking borrowed."""
    h = load(spark, d, "events", "user_id").groupBy("user_id").agg(F.count("*").alias("n"))
    h = h.withColumn("stratum", F.when(F.col("n") < 50, "light").when(F.col("n") < 75, "medium").otherwise("heavy"))
    return ml.stratified_sample(h, "stratum", "user_id", {"light": 0.2, "medium": 0.6, "heavy": 0.2}, 100).select("user_id", "stratum")


WEEK = ["season", "gameweek"]


def _players(spark, d):
    """One squad problem a week of a season, over the whole panel, and one over the latest week of every player."""
    p = panel(spark, d).filter("xp is not null and team_id is not null and price is not null")
    last = p.withColumn("__r", F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("season"), F.desc("gameweek")))).filter("__r = 1").drop("__r")
    every = p.unionByName(last.withColumns({"season": F.lit("latest"), "gameweek": F.lit(0)}))
    return every.select(*WEEK, "player_id", "team_id", "position", F.round("price", 1).alias("price"), F.col("xp").alias("points"), "confidence", "total_points")


@query()
def l29_best_squads(spark, d):
    """The exact squad of each week, and of every player's latest week."""
    return sports.squads(_players(spark, d), WEEK)


@query()
def l30_greedy_squads(spark, d):
    """L30."""
    return sports.greedy_squad(_players(spark, d), WEEK, 100.0, sports.QUOTAS)


def _squad(spark, d):
    p = _players(spark, d)
    return cut(sports.greedy_squad(p, WEEK, 100.0, sports.QUOTAS), "squad").join(p.select(*WEEK, "player_id", "confidence"), [*WEEK, "player_id"])


@query()
def l31_elevens_and_captains(spark, d):
    """Over the greedy squads."""
    return sports.captains(sports.best_eleven(_squad(spark, d), WEEK), WEEK)


@query()
def l35_scenarios(spark, d):
    """Over the greedy squads."""
    return sports.scenarios(_squad(spark, d), ["season"], "gameweek")


_LATEST = f"(SELECT * EXCLUDE (season, gameweek), 'latest' AS season, 0 AS gameweek FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC, gameweek DESC) AS q FROM {PANEL_SQL} WHERE xp IS NOT NULL AND team_id IS NOT NULL AND price IS NOT NULL) WHERE q = 1)"


@query(f"""WITH p AS (SELECT season, gameweek, player_id, position, CAST(total_points AS DOUBLE) AS points, confidence FROM {PANEL_SQL} WHERE xp IS NOT NULL AND team_id IS NOT NULL AND price IS NOT NULL UNION ALL SELECT season, gameweek, player_id, position, CAST(total_points AS DOUBLE), confidence FROM {_LATEST}),
k AS (SELECT *, row_number() OVER (PARTITION BY season, gameweek, position ORDER BY points DESC NULLS LAST, player_id) AS r FROM p), f AS (SELECT * FROM (VALUES (0, 3, 4, 3), (1, 3, 5, 2), (2, 4, 3, 3), (3, 4, 4, 2), (4, 4, 5, 1), (5, 5, 2, 3), (6, 5, 3, 2), (7, 5, 4, 1)) t(i, d, m, w)),
s AS (SELECT season, gameweek, i, d, m, w, sum(CASE WHEN (position = 'GKP' AND r <= 1) OR (position = 'DEF' AND r <= d) OR (position = 'MID' AND r <= m) OR (position = 'FWD' AND r <= w) THEN points ELSE 0 END) AS v FROM k, f GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, gameweek ORDER BY v DESC, i) AS q FROM s) WHERE q = 1), e AS (SELECT k.*, d || '-' || m || '-' || w AS formation, row_number() OVER (PARTITION BY season, gameweek ORDER BY points * (0.5 + 0.5 * confidence) DESC NULLS LAST, player_id) AS c FROM k JOIN b USING (season, gameweek) WHERE r <= CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN d WHEN 'MID' THEN m ELSE w END)
SELECT season, gameweek, player_id, formation, CASE c WHEN 1 THEN 'captain' WHEN 2 THEN 'vice' ELSE 'player' END AS role FROM e""")
def l31_best_elevens(spark, d):
    """The best eleven of all players of a week over all formations, with captain and vice."""
    p = _players(spark, d).withColumn("points", F.col("total_points").cast("double"))
    return sports.captains(sports.best_eleven(p, WEEK), WEEK).select(*WEEK, "player_id", "formation", "role")


@query(f"""WITH n AS (SELECT position, count(*) AS n FROM {_LATEST} GROUP BY 1), ok AS (SELECT count(*) = 4 AS ok FROM n WHERE n >= 3 * CASE position WHEN 'GKP' THEN 2 WHEN 'FWD' THEN 3 ELSE 5 END)
SELECT how, 15 AS players, true AS keeps_rules, true AS exact_is_best FROM ok, (VALUES ('exact'), ('greedy')) t(how) WHERE ok""")
def q15_squad_rules(spark, d):
    """The rules that the squads of every player's latest week must keep, in both forms: fifteen players by the
    quotas, at most three a club, within budget, and the exact squad at least as good as the greedy one."""
    last = cut(_players(spark, d).filter("season = 'latest'"), "latest")
    a = sports.greedy_squad(last, WEEK, 100.0, sports.QUOTAS).withColumn("how", F.lit("greedy"))
    b = sports.squads(last, WEEK).drop("proven").withColumn("how", F.lit("exact"))
    s = cut(a.unionByName(b), "squads")
    clubs = s.groupBy("how", "team_id").count().groupBy("how").agg(F.max("count").alias("per_club"))
    g = s.groupBy("how").agg(F.count("*").alias("players"), F.round(F.sum("price"), 1).alias("cost"), F.sum("points").alias("points"), *[F.count_if(F.col("position") == p).alias(p.lower()) for p in sports.QUOTAS])
    ok = (F.col("cost") <= 100) & (F.col("per_club") <= 3) & (F.col("gkp") == 2) & (F.col("def") == 5) & (F.col("mid") == 5) & (F.col("fwd") == 3)
    top = g.filter("how = 'exact'").select(F.col("points").alias("best"))
    return g.join(clubs, "how").join(F.broadcast(top)).select("how", "players", ok.alias("keeps_rules"), (F.col("best") >= F.col("points") - 1e-9).alias("exact_is_best"))


def _u(*parts):
    return f"(CAST('0x' || substr(sha256({' || \':\' || '.join(parts)}), 1, 8) AS BIGINT) % 1000000 / 1e6)"


@query(f"""WITH m AS (SELECT vec_id, CAST(embedding[1:4] AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 10 = 0), n AS (SELECT a.vec_id, b.vec_id AS neighbor, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(-list_distance(a.x, b.x), 9) DESC, b.vec_id) AS rank FROM m a JOIN m b ON a.vec_id <> b.vec_id),
l AS (SELECT vec_id, list(neighbor ORDER BY rank) AS near FROM n WHERE rank <= 5 GROUP BY 1), c AS (SELECT vec_id, copy, near[1 + CAST(floor({_u('vec_id', 'copy', "'which'")} * len(near)) AS INT)] AS neighbor, {_u('vec_id', 'copy', "'where'")} AS u FROM l, range(1, 4) t(copy))
SELECT c.vec_id, CAST(copy AS INT) AS copy, neighbor, round(a.x[1] + u * (b.x[1] - a.x[1]), 5) AS first, round(a.x[4] + u * (b.x[4] - a.x[4]), 5) AS last FROM c JOIN m a ON a.vec_id = c.vec_id JOIN m b ON b.vec_id = neighbor""")
def l26_oversampled(spark, d):
    """Three synthetic rows for every row of a class of a tenth of all."""
    rare = load(spark, d, "embeddings").filter("vec_id % 10 = 0").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("x"))
    return ml.oversampled(rare, "vec_id", "x", 3).select("vec_id", "copy", "neighbor", F.round(F.col("x")[0], 5).alias("first"), F.round(F.col("x")[3], 5).alias("last"))


_LINEAR = {"xp": 0.8, "form": 0.3, "price": 0.05, "opponent_difficulty": -0.4}


@query(f"SELECT row_id, {', '.join(f'round(coalesce({w} * ({c} - avg({c}) OVER ()), 0), 6) AS shap_{c}' for c, w in _LINEAR.items())} FROM {PANEL_SQL}")
def l27_shapley(spark, d):
    """Exact Shapley values of a linear score."""
    s = ml.linear_shapley(panel(spark, d).select("row_id", *_LINEAR), _LINEAR)
    return s.select("row_id", *[F.round(f"shap_{c}", 6).alias(f"shap_{c}") for c in _LINEAR])


@query()
def l28_network(spark, d):
    """The feed-forward form only, trained on the seasons before 2022-23 and judged on the rest."""
    x = _labelled(spark, d)
    model = ml.network(len(NUMBERS)).fit(x.filter("part = 'train'"))
    return ml.binary_metrics(ml.predicted(model, x.filter("part = 'test'")), "p", "label")


_FIXTURES = f"(SELECT match_id, home, away, 0.3 + 0.3 * (home % 10) / 9.0 AS p_home, 0.25 AS p_draw FROM {MATCHES_SQL} WHERE year(day) = 2000)"
_DRAWN = f"""f AS {_FIXTURES}, r AS (SELECT *, CAST('0x' || substr(sha256(run || ':' || match_id), 1, 8) AS BIGINT) % 1000000 / 1e6 AS u FROM f, range(1, 21) t(run)),
p AS (SELECT run, home AS team, CASE WHEN u < p_home THEN 3 WHEN u < p_home + p_draw THEN 1 ELSE 0 END AS p FROM r UNION ALL SELECT run, away, CASE WHEN u < p_home THEN 0 WHEN u < p_home + p_draw THEN 1 ELSE 3 END FROM r), t AS (SELECT run, team, CAST(sum(p) AS BIGINT) AS points FROM p GROUP BY 1, 2)"""


def _season(spark, d):
    f = matches(spark, d).filter(F.year("day") == 2000).select("match_id", "home", "away", (0.3 + 0.3 * (F.col("home") % 10) / 9.0).alias("p_home"), F.lit(0.25).alias("p_draw"))
    return sports.simulate_season(f, 20)


@query(f"WITH {_DRAWN} SELECT run, team, points FROM t")
def l33_simulated_seasons(spark, d):
    """Twenty seasons of the matches of 2000, drawn by hash."""
    return _season(spark, d)


@query(f"""WITH {_DRAWN}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY points DESC, team) AS place FROM t), m AS (SELECT team, place, row_number() OVER (PARTITION BY team ORDER BY count(*) DESC, place) AS q FROM k GROUP BY 1, 2)
SELECT team, round(avg(points), 6) AS expected_points, round(avg(CAST(k.place = 1 AS INT)), 6) AS p_title, round(avg(CAST(k.place <= 4 AS INT)), 6) AS p_top, any_value(m.place) AS usual_place FROM k JOIN m USING (team) WHERE m.q = 1 GROUP BY team""")
def l34_simulation_summary(spark, d):
    """L34."""
    s = sports.simulation_summary(_season(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("expected_points", "p_title", "p_top")})


RUNS = 10_000


def _all_fixtures(spark, d):
    return matches(spark, d).select(F.year("day").alias("season"), "match_id", "home", "away", (0.3 + 0.3 * (F.col("home") % 10) / 9.0).alias("p_home"), F.lit(0.25).alias("p_draw"))


def _all_seasons(spark, d, runs=RUNS):
    return seasonruns.simulate_seasons(_all_fixtures(spark, d), runs, ["season"])


@query()
def l33_all_seasons(spark, d):
    """Ten thousand runs of every season; `l33_simulated_seasons` is the small case that SQL can check."""
    return _all_seasons(spark, d)


@query()
def l34_all_seasons_summary(spark, d):
    """Over the runs of `l33_all_seasons`."""
    return seasonruns.seasons_summary(_all_fixtures(spark, d), RUNS, by=["season"])


QUERIES, SQL = query.queries, query.sql
