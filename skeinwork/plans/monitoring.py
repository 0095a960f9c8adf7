"""Quality gates, telemetry and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions.strings import bucket_of
from skeinwork.io import load
from skeinwork.operators import quality as q
from skeinwork.operators import telemetry as tm
from skeinwork.plans.registry import Registry
from skeinwork.plans.relational import PANEL_SQL, panel
from skeinwork.streaming import telemetry as st

query = Registry()


def _events(spark, d):
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _fpl_checks():
    return [
        q.completeness("player_id"), q.completeness("xp"), q.completeness("availability_status"), q.null_rate("rest_days"), q.null_rate("availability_status", 0.05), q.unique("row_id"), q.unique("player_id", "season", "gameweek"),
        q.in_range("gameweek", 1, 38), q.in_range("confidence", 0, 1), q.in_set("position", ["GKP", "DEF", "MID", "FWD"]), q.finite("xp"), q.recomputed("annual_wages", F.col("annual_wages"), F.regexp_replace("weekly_wages", "[^0-9]", "").try_cast("double") * 52, 1.0),
    ]


_R = "CASE WHEN {ok} THEN 'PASSED' ELSE '{bad}' END"


def _sql_check(name, value, ok, bad="FAILED", t="fpl_merged"):
    return f"SELECT '{name}' AS check, round(CAST({value} AS DOUBLE), 8) AS value, CASE WHEN {ok.format(v=f'CAST({value} AS DOUBLE)')} THEN 'PASSED' ELSE '{bad}' END AS status FROM {t}"


_full = lambda c: f"avg(CAST({c} IS NOT NULL AS INT))"
_CHECKS = " UNION ALL ".join([
    *[_sql_check(f"complete:{c}", _full(c), "{v} >= 0.95") for c in ("player_id", "xp", "availability_status")],
    _sql_check("nulls:rest_days", "avg(CAST(rest_days IS NULL AS INT))", "{v} <= 0.2", "WARNING"), _sql_check("nulls:availability_status", "avg(CAST(availability_status IS NULL AS INT))", "{v} <= 0.05", "WARNING"),
    _sql_check("unique:row_id", "count(*) / CAST(count(DISTINCT row_id) AS DOUBLE)", "{v} <= 1"), _sql_check("unique:player_id,season,gameweek", "count(*) / CAST(count(DISTINCT (player_id, season, gameweek)) AS DOUBLE)", "{v} <= 1"),
    _sql_check("range:gameweek", "avg(CAST(gameweek NOT BETWEEN 1 AND 38 AS INT))", "{v} <= 0"), _sql_check("range:confidence", "avg(CAST(confidence NOT BETWEEN 0 AND 1 AS INT))", "{v} <= 0"),
    _sql_check("domain:position", "avg(CAST(position NOT IN ('GKP', 'DEF', 'MID', 'FWD') AS INT))", "{v} <= 0"), _sql_check("finite:xp", "count(*) FILTER (isnan(xp) OR isinf(xp))", "{v} <= 0"),
    _sql_check("derived:annual_wages", "max(abs(annual_wages - TRY_CAST(regexp_replace(weekly_wages, '[^0-9]', '', 'g') AS DOUBLE) * 52))", "{v} <= 1"),
])


@query(_CHECKS)
def q01_gates(spark, d):
    """Q1 Q2 Q4 Q6 Q8 Q10 Q11 Q13 Q14: twelve checks, one pass."""
    return q.run_checks(load(spark, d, "fpl_merged"), _fpl_checks()).withColumn("value", F.round("value", 8))


@query(f"SELECT count(*) AS checks, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'WARNING') AS warnings, CASE WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'FAILED' WHEN count(*) FILTER (status = 'WARNING') > 0 THEN 'WARNING' ELSE 'PASSED' END AS status FROM ({_CHECKS})")
def q05_roll_up(spark, d):
    """Q5."""
    return q.rolled_up(q.run_checks(load(spark, d, "fpl_merged"), _fpl_checks()))


@query("SELECT team_id AS key, count(*) AS n FROM fpl_merged WHERE team_id IS NOT NULL AND team_id NOT IN (SELECT team_id FROM fpl_teams) GROUP BY 1")
def q03_foreign_keys(spark, d):
    """Q3."""
    return q.missing_references(load(spark, d, "fpl_merged", "team_id"), "team_id", load(spark, d, "fpl_teams"), "team_id")


_TYPES = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE column_type END"


@query(f"""SELECT w.c AS "column", wanted, found, CASE WHEN found IS NULL THEN 'FAILED' WHEN found = wanted THEN 'PASSED' ELSE 'WARNING' END AS status FROM (VALUES ('player_id', 'bigint'), ('gameweek', 'int'), ('xp', 'double'), ('position', 'string'), ('kickoff_time', 'timestamp_ntz'), ('xg', 'double')) w(c, wanted) LEFT JOIN (SELECT column_name, {_TYPES} AS found FROM (DESCRIBE fpl_merged)) ON column_name = c""")
def q04_schema(spark, d):
    """Q4 Q12: columns and types."""
    return q.schema_report(load(spark, d, "fpl_merged"), {"player_id": "bigint", "gameweek": "int", "xp": "double", "position": "string", "kickoff_time": "timestamp_ntz", "xg": "double"})


@query(f"SELECT season, gameweek, max(r) AS highest, count(*) AS rows, count(DISTINCT r) = max(r) AS ranks_complete, round(sum(share), 6) AS total FROM (SELECT season, gameweek, row_number() OVER (PARTITION BY season, gameweek ORDER BY total_points DESC, player_id) AS r, (total_points + 5.0) / sum(total_points + 5.0) OVER (PARTITION BY season, gameweek) AS share FROM {PANEL_SQL}) GROUP BY 1, 2")
def q07_shares_and_ranks(spark, d):
    """Q7 Q9: shares sum to 1, ranks run from 1 to n."""
    w = Window.partitionBy("season", "gameweek")
    p = panel(spark, d).withColumns({"r": F.row_number().over(w.orderBy(F.desc("total_points"), "player_id")), "share": (F.col("total_points") + 5.0) / F.sum(F.col("total_points") + 5.0).over(w)})
    return p.groupBy("season", "gameweek").agg(F.max("r").alias("highest"), F.count("*").alias("rows"), (F.countDistinct("r") == F.max("r")).alias("ranks_complete"), F.round(F.sum("share"), 6).alias("total"))


@query(" UNION ALL ".join(f"SELECT '{c.lower()}' AS \"column\", count(*) AS total FROM movies_master WHERE list_contains(string_split(genres_norm, '|'), '{c}') HAVING count(*) = 0" for c in ("Drama", "Action", "Musical", "Noir")))
def q12_empty_indicators(spark, d):
    """Q12: genre columns that nothing has."""
    from skeinwork.functions.arrays import multi_hot

    m = load(spark, d, "movies_master", "genres_norm").select(*multi_hot(F.split("genres_norm", r"\|"), ["Drama", "Action", "Musical", "Noir"]))
    return q.all_zero_columns(m, m.columns)


@query("SELECT 'fpl_merged' AS table_name, count(*) AS rows, true AS repeated, true AS sensitive FROM fpl_merged UNION ALL SELECT 'movies_master', count(*), true, true FROM movies_master")
def q16_fingerprints(spark, d):
    """Q16: hashes of two tables that a second run over shuffled rows reproduces, and that one changed value changes."""

    def judged(name, key):
        t = load(spark, d, name)
        one, again = q.fingerprint(t), q.fingerprint(t.repartition(5, key)).select(F.col("rows").alias("n"), F.col("hash").alias("h"))
        smallest = t.agg(F.min(key).alias("__least"))
        changed = q.fingerprint(t.join(F.broadcast(smallest)).withColumn(key, F.when(F.col(key) == F.col("__least"), F.lit(None)).otherwise(F.col(key))).select(*t.columns)).select(F.col("hash").alias("c"))
        return one.join(again).join(changed).select(F.lit(name).alias("table_name"), "rows", ((F.col("hash") == F.col("h")) & (F.col("rows") == F.col("n"))).alias("repeated"), (F.col("hash") != F.col("c")).alias("sensitive"))

    return judged("fpl_merged", "row_id").unionByName(judged("movies_master", "canonical_id"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, round(avg(CAST(regexp_matches(trim({c}), '^[£€$]\\s*[0-9]') AS INT)), 6) AS money, round(avg(CAST(regexp_matches(trim({c}), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})$') AS INT)), 6) AS date, round(avg(CAST(regexp_matches(trim({c}), '^-?[0-9][0-9.,]*$') AS INT)), 6) AS number FROM {t} WHERE {c} IS NOT NULL" for c, t in (("weekly_wages", "fpl_merged"), ("stadium_capacity", "fpl_merged"), ("releasedatetheaters", "rt_movies"))))
def f25_column_content(spark, d):
    """F25 over all values."""
    parts = [q.looks_like(load(spark, d, t, c), c) for c, t in (("weekly_wages", "fpl_merged"), ("stadium_capacity", "fpl_merged"), ("releasedatetheaters", "rt_movies"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumns({c: F.round(c, 6) for c in ("money", "date", "number")})


_KINDS = "count(*) AS events, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases"


@query("""SELECT CAST(day AS VARCHAR) AS day, round(avg(CAST(value >= 50 AS INT)), 6) AS coverage, round(100 * avg(CAST(value < 50 AS INT)), 4) AS underfill FROM (SELECT CAST(ts AS DATE) AS day, value, ts, max(ts) OVER (PARTITION BY CAST(ts AS DATE)) AS newest FROM events WHERE event_type = 'view') WHERE ts > newest - INTERVAL 10 MINUTE GROUP BY 1""")
def r01_coverage_guardrail(spark, d):
    """The last ten minutes of every day."""
    e = _events(spark, d).filter("event_type = 'view'").withColumn("day", F.to_date("ts").cast("string"))
    newest = e.groupBy("day").agg(F.max("ts").alias("newest"))
    last = e.join(newest, "day").filter(F.col("ts") > F.col("newest") - F.expr("interval 10 minutes"))
    return last.groupBy("day").agg(F.round(F.avg((F.col("value") >= 50).cast("int")), 6).alias("coverage"), F.round(100 * F.avg((F.col("value") < 50).cast("int")), 4).alias("underfill"))


_ARM = "CASE WHEN b < 20 THEN 'control' WHEN b < 60 THEN 'A' ELSE 'B' END"
_BUCKETED = "(SELECT *, CAST('0x' || substr(sha256(user_id || ':exp1'), 1, 8) AS BIGINT) % 100 AS b FROM events)"


@query(f"SELECT {_ARM} AS arm, event_type, round(quantile_cont(value, 0.95), 5) AS p95, count(*) AS n FROM {_BUCKETED} GROUP BY 1, 2")
def r02_latency_by_arm(spark, d):
    """R2 R15."""
    e = load(spark, d, "events").withColumn("arm", tm.arm_of(F.col("user_id"), "exp1"))
    return e.groupBy("arm", "event_type").agg(F.round(F.percentile("value", 0.95), 5).alias("p95"), F.count("*").alias("n"))


@query("SELECT json_extract_string(props, '$.k') AS k, round(1000.0 * count(*) FILTER (event_type = 'error') / count(DISTINCT event_id), 5) AS errors_per_1k FROM events GROUP BY 1")
def r03_error_rate(spark, d):
    """R3."""
    e = load(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k"))
    return e.agg(F.round(1000 * F.count_if(F.col("event_type") == "error") / F.countDistinct("event_id"), 5).alias("errors_per_1k"))


@query("""SELECT 'pre' AS period, round(avg(value), 6) AS mean_value, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE ts < TIMESTAMP '2024-01-15' UNION ALL SELECT 'post', round(avg(value), 6), count(*) FILTER (event_type = 'error') FROM events WHERE ts >= TIMESTAMP '2024-01-15'""")
def r04_before_and_after(spark, d):
    """R4 T14."""
    period = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), "pre").otherwise("post")
    return _events(spark, d).groupBy(period.alias("period")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("event_type") == "error").alias("errors"))


def _sql_roll(p):
    return f"SELECT '{p}' AS period, CAST(CAST(date_trunc('{p}', ts) AS DATE) AS VARCHAR) AS start, {_KINDS}, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, round(count(*) FILTER (event_type = 'click') / CAST(count(*) FILTER (event_type = 'view') AS DOUBLE), 6) AS ctr, round(count(*) FILTER (event_type = 'error') * 1000 / CAST(count(*) FILTER (event_type = 'view') AS DOUBLE), 6) AS errors_per_1k, round(count(*) / CAST(count(DISTINCT user_id) AS DOUBLE), 6) AS depth FROM events GROUP BY ALL"


@query(" UNION ALL ".join(map(_sql_roll, ("day", "week", "month"))))
def r06_roll_ups(spark, d):
    """R6."""
    out = None
    for p in ("day", "week", "month"):
        r = tm.roll_up(_events(spark, d), p).withColumn("start", F.to_date("start").cast("string")).withColumn("period", F.lit(p))
        out = r if out is None else out.unionByName(r)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_value", "ctr", "errors_per_1k", "depth")})


@query("""WITH e AS (SELECT *, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS view_no FROM events)
SELECT user_id, view_no, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, min(ts) = min(ts) FILTER (event_type = 'view') AS chronological FROM e WHERE view_no > 0 GROUP BY 1, 2""")
def r07_journeys(spark, d):
    """R7 R8."""
    return tm.journeys(_events(spark, d)).select("user_id", "view_no", "clicks", "purchases", "chronological")


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS s, {_KINDS} FROM events GROUP BY 1) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, events, errors, sum(CAST(errors > 0 AS INT)) OVER (PARTITION BY CAST(s AS DATE) ORDER BY s ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS alert FROM w""")
def r09_windows_and_alerts(spark, d):
    """Five-minute windows, an alert where two in a row have errors."""
    w = tm.sustained(tm.windowed(_events(spark, d)), F.col("errors") > 0)
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "errors", "alert")


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, avg(n) AS m, stddev_samp(n) AS s FROM d GROUP BY 1) SELECT event_type, CAST(day AS VARCHAR) AS day, round((n - m) / s, 5) AS z, coalesce(abs((n - m) / s) > 2, false) AS anomalous FROM d JOIN s USING (event_type)""")
def r10_anomalies(spark, d):
    """R10."""
    daily = _events(spark, d).groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return tm.anomalies(daily, "n", "event_type").select("event_type", "day", F.round("z", 5).alias("z"), "anomalous")


@query(f"""WITH a AS (SELECT {_ARM} AS arm, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'click') / CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS ctr FROM {_BUCKETED} GROUP BY 1)
SELECT arm, users, round(ctr, 6) AS ctr, round((ctr / (SELECT ctr FROM a WHERE arm = 'control') - 1) * 100, 4) AS lift_percent, round(users / CAST((SELECT sum(users) FROM a) AS DOUBLE), 6) AS traffic FROM a""")
def r11_lift(spark, d):
    """R11."""
    e = load(spark, d, "events").withColumn("arm", tm.arm_of(F.col("user_id"), "exp1")).groupBy("arm").agg(*tm.kind_counts(), F.countDistinct("user_id").alias("users"))
    return tm.lift(tm.rates(e), "ctr").select("arm", "users", F.round("ctr", 6).alias("ctr"), F.round("lift_percent", 4).alias("lift_percent"), F.round("traffic", 6).alias("traffic"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, count(DISTINCT no) AS sessions, count(*) AS events, round(count(*) / CAST(count(DISTINCT no) AS DOUBLE), 6) AS depth FROM s GROUP BY 1""")
def r13_session_depth(spark, d):
    """R13."""
    s = tm.sessions(_events(spark, d))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("depth").alias("events"), F.round(F.avg("depth"), 6).alias("depth"))


@query("SELECT sha256(CAST(user_id AS VARCHAR)) AS user_id, count(*) AS n FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') <= 14 GROUP BY 1")
def r14_anonymised(spark, d):
    """R14."""
    return tm.anonymised(_events(spark, d), 14, F.lit("2024-01-31").cast("date")).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"SELECT user_id, CAST(any_value(b) AS INT) AS bucket, any_value({_ARM}) AS arm, CASE WHEN count(*) <= 2 THEN 0.2 WHEN count(*) <= 10 THEN 0.4 WHEN count(*) <= 100 THEN 0.6 ELSE 0.8 END AS alpha FROM {_BUCKETED} GROUP BY 1")
def r15_assignment(spark, d):
    """R15."""
    u = load(spark, d, "events", "user_id").groupBy("user_id").agg(F.count("*").alias("n"))
    return u.select("user_id", bucket_of(F.concat(F.col("user_id").cast("string"), F.lit(":exp1"))).alias("bucket"), tm.arm_of(F.col("user_id"), "exp1").alias("arm"), tm.alpha_of(F.col("n")).alias("alpha"))


@query("""WITH e AS (SELECT value, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'cold' ELSE 'warm' END AS phase FROM events) SELECT phase, count(*) AS n, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95, round(quantile_cont(value, 0.99), 5) AS p99, round(count(*) / CAST((SELECT count(*) FROM e) AS DOUBLE), 6) AS share FROM e GROUP BY 1""")
def r16_cold_and_warm(spark, d):
    """R16."""
    c = tm.cold_and_warm(_events(spark, d))
    return c.withColumns({x: F.round(x, 6 if x == "share" else 5) for x in ("p50", "p95", "p99", "share")})


@query(f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {_KINDS} FROM events GROUP BY 1")
def r05_stream_daily(spark, d):
    """R5 R6 as a stream with a watermark of two days, worked off to the end."""
    s = st.windowed_stream(st.read_events(spark, d), "1 day")
    out = st.run_to_end(s, "daily", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "events", "views", "clicks", "errors", "purchases")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def r05_stream_deduplicated(spark, d):
    """A stream that delivers everything twice, each event kept once."""
    e = st.read_events(spark, d)
    out = st.run_to_end(st.deduplicated_stream(e.unionByName(e)), "once")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


_NEXT = """CASE WHEN bad THEN CASE r.state WHEN 'healthy' THEN 'watching' WHEN 'watching' THEN 'degraded' WHEN 'degraded' THEN 'rolling_back' WHEN 'recovering' THEN 'degraded' ELSE 'rolled_back' END
  ELSE CASE r.state WHEN 'degraded' THEN 'watching' WHEN 'rolling_back' THEN 'rolled_back' WHEN 'rolled_back' THEN 'recovering' ELSE 'healthy' END END"""


@query(f"""WITH RECURSIVE e AS (SELECT 'c' || user_id % 5 AS component, CAST(floor(epoch(ts)) AS BIGINT) AS minute, value > 100 AS bad, row_number() OVER (PARTITION BY user_id % 5 ORDER BY CAST(floor(epoch(ts)) AS BIGINT), value > 100) AS i FROM events WHERE event_type = 'error'),
r AS (SELECT DISTINCT component, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS minute, 'healthy' AS state FROM e UNION ALL SELECT e.component, e.i, e.minute, {_NEXT} FROM r JOIN e ON e.component = r.component AND e.i = r.i + 1)
SELECT component, minute, state FROM r WHERE i > 0""")
def r12_rollback_states(spark, d):
    """The state machine over each component's daily error readings, as a stream."""
    e = st.read_events(spark, d).filter("event_type = 'error'").select(F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("component"), F.unix_seconds("ts").alias("minute"), (F.col("value") > 100).alias("bad"))
    return st.run_to_end(st.rollback_states(e), "states")


QUERIES, SQL = query.queries, query.sql
