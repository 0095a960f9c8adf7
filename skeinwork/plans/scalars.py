"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions import arrays, dates, numeric, strings
from skeinwork.io import load
from skeinwork.plans.registry import Registry

query = Registry()
GENRES = ("Action", "Animation", "Comedy", "Crime", "Documentary", "Drama", "Family", "Horror", "Romance", "Sci-Fi", "Thriller", "Western")
_WORD = r"[^\p{L}\p{N}_\s]"


def _sql_key(c):
    return f"nullif(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), '')"


@query(f"""SELECT canonical_id, title_norm, {_sql_key('title_norm')} AS key_a,
  nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '\\s*\\([0-9]{{4}}\\)\\s*$', ''), '{_WORD}', ' ', 'g'), '\\s+', ' ', 'g')), '') AS key_b,
  trim(regexp_replace(regexp_replace(t, '\\([0-9]{{4}}\\)', '', 'g'), '\\s+', ' ', 'g')) AS key_d,
  trim(regexp_replace(t, '[(\\[d{{4}})\\]]', '', 'g')) AS key_e,
  TRY_CAST(regexp_extract(t, '\\(([0-9]{{4}})\\)', 1) AS INT) AS title_year,
  coalesce(regexp_matches(lower(title_norm), '\\b(part|chapter|episode|volume|returns|sequel|saga|[2-9]|ii|iii|iv)\\b'), false) AS franchise,
  substr(sha1(concat_ws('|', title_norm, CAST(year_norm AS VARCHAR))), 1, 12) AS short_id
  FROM (SELECT *, title_norm || ' (' || year_norm || ')' AS t FROM movies_master)""")
def f01_title_forms(spark, d):
    """F1 F2 F4 F5 F6 F19 F23."""
    m = load(spark, d, "movies_master", "canonical_id", "title_norm", "year_norm")
    t = F.concat(F.col("title_norm"), F.lit(" ("), F.col("year_norm").cast("string"), F.lit(")"))
    c = F.col("title_norm")
    return m.select("canonical_id", "title_norm", strings.title_key(c).alias("key_a"), strings.title_key_without_year(t).alias("key_b"), strings.title_without_years(t).alias("key_d"), strings.title_without_year_marks(t).alias("key_e"), strings.year_in_title(t).alias("title_year"), strings.is_franchise(c).alias("franchise"), strings.sha1_id(c, F.col("year_norm").cast("string")).alias("short_id"))


@query(f"SELECT id, title, {_sql_key("regexp_replace(strip_accents(title), '[^\\x00-\\x7F]', '', 'g')")} AS key_c FROM rt_movies WHERE title IS NOT NULL")
def f03_title_ascii(spark, d):
    """F3."""
    return load(spark, d, "rt_movies", "id", "title").filter("title is not null").select("id", "title", strings.title_key_ascii(F.col("title")).alias("key_c"))


@query(f"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '<[^>]*>', ' ', 'g'), '{_WORD}', ' ', 'g'), '\\b(the|a|of|and)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'unknown_text') AS cleaned FROM documents WHERE regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F]*', 's')""")
def f07_clean_text(spark, d):
    """F7 over the documents of plain ASCII, where word boundaries mean the same to both engines."""
    docs = load(spark, d, "documents", "doc_id", "text").filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x00-\x7F]"))
    return docs.select("doc_id", strings.clean_text(F.col("text"), ("the", "a", "of", "and")).alias("cleaned"))


ALIASES = {"sumath rovers": "Sumath", "taves united": "Taves Utd"}


@query("SELECT team_id, loaded_at::VARCHAR AS loaded, CASE lower(trim(name)) WHEN 'sumath rovers' THEN 'Sumath' WHEN 'taves united' THEN 'Taves Utd' ELSE array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(trim(name), ' ')], ' ') END AS team FROM fpl_teams")
def f08_team_names(spark, d):
    """F8."""
    t = load(spark, d, "fpl_teams", "team_id", "name", "loaded_at")
    return t.select("team_id", F.col("loaded_at").cast("string").alias("loaded"), strings.canonical_name(F.col("name"), ALIASES).alias("team"))


_MONEY = "lower(regexp_replace({c}, '[£€$,\\s]', '', 'g'))"


def _sql_money(c):
    t = _MONEY.format(c=c)
    return f"TRY_CAST(regexp_replace({t}, '(bn|b|m|k)$', '') AS DOUBLE) * CASE WHEN regexp_matches({t}, 'bn?$') THEN 1e9 WHEN {t} LIKE '%m' THEN 1e6 WHEN {t} LIKE '%k' THEN 1e3 ELSE 1.0 END"


@query(f"SELECT row_id, round({_sql_money('weekly_wages')}, 2) AS wages, round({_sql_money('club_value')}, 2) AS club, TRY_CAST(regexp_replace(stadium_capacity, '[,.]', '', 'g') AS BIGINT) AS capacity FROM fpl_merged")
def f09_money(spark, d):
    """F9 F10."""
    m = load(spark, d, "fpl_merged", "row_id", "weekly_wages", "club_value", "stadium_capacity")
    return m.select("row_id", F.round(strings.money(F.col("weekly_wages")), 2).alias("wages"), F.round(strings.money(F.col("club_value")), 2).alias("club"), strings.whole_number(F.col("stadium_capacity")).alias("capacity"))


@query("""SELECT row_id, CASE WHEN manager_tenure > 0 THEN round(floor(manager_tenure / 365) * 12 + floor((manager_tenure % 365) / 30) + ((manager_tenure % 365) % 30) / 30.0, 4) END AS months,
  lpad(CAST(hour(kickoff_time) AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute(kickoff_time) AS VARCHAR), 2, '0') AS at FROM fpl_merged""")
def f11_spans_and_clocks(spark, d):
    """F11 F12 on texts made of the tables' numbers."""
    m = load(spark, d, "fpl_merged", "row_id", "manager_tenure", "kickoff_time")
    t = F.col("manager_tenure").cast("long")
    text = F.concat((t / 365).cast("long").cast("string"), F.lit(" years "), ((t % 365) / 30).cast("long").cast("string"), F.lit(" months "), (t % 365 % 30).cast("string"), F.lit(" days"))
    at = F.concat(F.hour("kickoff_time").cast("string"), F.lit("."), F.minute("kickoff_time").cast("string"))
    return m.select("row_id", F.round(strings.tenure_months(text), 4).alias("months"), strings.clock(at).alias("at"))


@query("""SELECT movieid, tconst, CASE WHEN n <> '' THEN 'tt' || CASE WHEN length(n) >= 7 THEN n ELSE lpad(n, 7, '0') END END AS imdb_id,
  md5(array_to_string(list_sort(list_filter([canonical_id, CAST(movieid AS VARCHAR), CAST(tmdbid AS VARCHAR)], lambda x: x IS NOT NULL)), '|')) AS combined
  FROM (SELECT *, regexp_replace(regexp_extract(tconst, '([0-9]+)', 1), '^0+(.)', '\\1') AS n FROM id_bridge)""")
def f13_ids(spark, d):
    """F13 F20."""
    b = load(spark, d, "id_bridge", "movieid", "tconst", "canonical_id", "tmdbid")
    return b.select("movieid", "tconst", strings.padded_id(F.col("tconst")).alias("imdb_id"), strings.combined_id(F.col("canonical_id"), F.col("movieid").cast("string"), F.col("tmdbid").cast("string")).alias("combined"))


TITLES = {"founder": "founder", "chief": r"\bc[eft]o\b", "sales": "sales"}


@query("""SELECT row_id, CAST(coalesce(regexp_matches(lower(person_featured_job_title), 'founder'), false) AS INT) AS founder, CAST(coalesce(regexp_matches(lower(person_featured_job_title), '\\bc[eft]o\\b'), false) AS INT) AS chief,
  CAST(coalesce(regexp_matches(lower(person_featured_job_title), 'sales'), false) AS INT) AS sales, split_part(person_name || ' - ' || person_city, ' - ', 1) AS who FROM people_df""")
def f14_flags(spark, d):
    """F14 F15 P9."""
    p = load(spark, d, "people_df", "row_id", "person_name", "person_city", "person_featured_job_title")
    who = strings.before_dash(F.concat("person_name", F.lit(" - "), "person_city"))
    return p.select("row_id", *[c.alias(n) for n, c in strings.flags(F.col("person_featured_job_title"), TITLES).items()], who.alias("who"))


@query("""SELECT g AS genre, count(*) AS n, string_agg(DISTINCT originallanguage, '|' ORDER BY originallanguage) AS languages FROM (SELECT trim(unnest(string_split(genre, ','))) AS g, originallanguage FROM rt_movies) WHERE g <> '' GROUP BY g""")
def f16_split_explode_join(spark, d):
    """F16 F17 A11."""
    r = load(spark, d, "rt_movies", "genre", "originallanguage")
    g = r.select(F.explode(strings.split_trimmed(F.col("genre"))).alias("genre"), "originallanguage")
    return g.groupBy("genre").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("originallanguage")), "|").alias("languages"))


@query("""SELECT user_id, CAST(CAST('0x' || substr(sha256(user_id || ':exp1'), 1, 8) AS BIGINT) % 100 AS INT) AS bucket, sha256(CAST(user_id AS VARCHAR)) AS hashed,
  'events=' || array_to_string(list_sort(list_distinct(list(event_type))), ',') AS signature FROM events GROUP BY user_id""")
def f21_hashes(spark, d):
    """F21 F22 R14."""
    e = load(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    u = F.col("user_id").cast("string")
    return e.select("user_id", strings.bucket_of(F.concat(u, F.lit(":exp1"))).alias("bucket"), F.sha2(u, 256).alias("hashed"), strings.filter_signature(events=F.col("kinds")).alias("signature"))


@query("SELECT canonical_id, concat_ws(' ', title_norm, replace(genres_norm, '|', ' ')) AS search_text FROM movies_master")
def f18_search_text(spark, d):
    """F18."""
    return load(spark, d, "movies_master", "canonical_id", "title_norm", "genres_norm").select("canonical_id", F.concat_ws(" ", "title_norm", F.replace("genres_norm", F.lit("|"), F.lit(" "))).alias("search_text"))


_SQL_DATE = "CAST(coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%b %-d, %Y')) AS DATE)"


@query(f"""SELECT id, CAST(dt AS VARCHAR) AS released, CAST(coalesce(year(dt), TRY_CAST(regexp_extract(releasedatetheaters, '\\b((?:18|19|20)[0-9]{{2}})\\b', 1) AS INT)) AS INT) AS release_year,
  CASE WHEN month(dt) >= 8 THEN year(dt) || '/' || lpad(CAST((year(dt) + 1) % 100 AS VARCHAR), 2, '0') ELSE (year(dt) - 1) || '/' || lpad(CAST(year(dt) % 100 AS VARCHAR), 2, '0') END AS season,
  date_diff('day', dt, CAST(scraped_at AS DATE)) AS age_days, week(dt) AS week FROM (SELECT *, {_SQL_DATE.format(c='releasedatetheaters')} AS dt FROM rt_movies)""")
def g01_dates(spark, d):
    """G1 G2 G3 G4 G6."""
    r = load(spark, d, "rt_movies", "id", "releasedatetheaters", "scraped_at").withColumn("dt", dates.parsed_date(F.col("releasedatetheaters")))
    return r.select("id", F.col("dt").cast("string").alias("released"), dates.year_of(F.col("releasedatetheaters")).alias("release_year"), dates.season_of(F.col("dt")).alias("season"), F.datediff("scraped_at", "dt").cast("long").alias("age_days"), F.weekofyear("dt").cast("long").alias("week"))


@query("""SELECT season, count(*) AS n, CAST(CAST(substr(season, 1, 4) AS INT) - 1 AS VARCHAR) || '-' || substr(season, 3, 2) AS previous, min(CAST(to_timestamp(epoch(kickoff_time)) AS TIMESTAMP)::DATE)::VARCHAR AS first_day FROM fpl_merged GROUP BY season""")
def g05_epochs_and_seasons(spark, d):
    """G5 G31."""
    m = load(spark, d, "fpl_merged", "season", "kickoff_time")
    at = dates.from_epoch(F.unix_timestamp(F.col("kickoff_time").cast("timestamp")))
    return m.groupBy("season").agg(F.count("*").alias("n"), F.min(F.to_date(at)).cast("string").alias("first_day")).withColumn("previous", dates.season_shifted(F.col("season"), -1))


@query("""SELECT canonical_id, round(ln(1 + num_votes), 6) AS log_votes, round(sqrt(num_votes), 6) AS root_votes, round(exp(-num_votes / 1000.0), 6) AS decay, round(pow(runtime_minutes, 2), 6) AS squared,
  CASE WHEN runtime_minutes IS NOT NULL THEN greatest(least(runtime_minutes, 180), 60) END AS runtime_clipped, CASE WHEN year_norm IS NOT NULL THEN round(greatest(least((year_norm - 1900) / CAST(130 AS DOUBLE), CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE)), 6) END AS year_scaled, runtime_minutes / nullif(num_votes, 0) AS ratio FROM movies_master""")
def g07_math(spark, d):
    """G7 G14 P25."""
    m = load(spark, d, "movies_master", "canonical_id", "num_votes", "runtime_minutes", "year_norm")
    v, r = F.col("num_votes"), F.col("runtime_minutes")
    return m.select("canonical_id", F.round(F.log1p(v), 6).alias("log_votes"), F.round(F.sqrt(v), 6).alias("root_votes"), F.round(F.exp(-v / 1000), 6).alias("decay"), F.round(F.pow(r, F.lit(2)), 6).alias("squared"), numeric.clipped(r, 60, 180).alias("runtime_clipped"), F.round(numeric.fixed_range(F.col("year_norm"), 1900, 2030), 6).alias("year_scaled"), numeric.safe_ratio(r, v).alias("ratio"))


@query("""SELECT canonical_id, round((runtime_minutes - avg(runtime_minutes) OVER ()) / stddev_samp(runtime_minutes) OVER () + (ln(1 + num_votes) - avg(ln(1 + num_votes)) OVER ()) / stddev_samp(ln(1 + num_votes)) OVER (), 5) AS z_sum,
  round(CASE WHEN max(num_votes) OVER (PARTITION BY original_language) = min(num_votes) OVER (PARTITION BY original_language) THEN 0.5 ELSE (num_votes - min(num_votes) OVER (PARTITION BY original_language)) / CAST(max(num_votes) OVER (PARTITION BY original_language) - min(num_votes) OVER (PARTITION BY original_language) AS DOUBLE) END, 6) AS scaled
  FROM (SELECT DISTINCT canonical_id, runtime_minutes, num_votes, original_language FROM movies_master)""")
def g08_scores(spark, d):
    """G8 G13 G15. Means and deviations are one aggregate joined back: no window over the whole table in one task."""
    m = load(spark, d, "movies_master", "canonical_id", "runtime_minutes", "num_votes", "original_language").distinct()
    lv = F.log1p("num_votes")
    s = m.agg(F.avg("runtime_minutes").alias("mr"), F.stddev_samp("runtime_minutes").alias("sr"), F.avg(lv).alias("mv"), F.stddev_samp(lv).alias("sv"))
    b = m.groupBy(F.col("original_language").alias("__l")).agg(F.min("num_votes").alias("low"), F.max("num_votes").alias("high"))
    j = m.join(F.broadcast(s)).join(F.broadcast(b), F.col("original_language").eqNullSafe(F.col("__l")))
    z = (F.col("runtime_minutes") - F.col("mr")) / F.col("sr") + (lv - F.col("mv")) / F.col("sv")
    scaled = F.when(F.col("high") == F.col("low"), 0.5).otherwise((F.col("num_votes") - F.col("low")) / (F.col("high") - F.col("low")))
    return j.select("canonical_id", F.round(z, 5).alias("z_sum"), F.round(scaled, 6).alias("scaled"))


@query("""WITH s AS (SELECT quantile_cont(CAST(num_votes AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(num_votes AS DOUBLE), 0.99) AS hi FROM movies_master),
w AS (SELECT canonical_id, greatest(least(CAST(num_votes AS DOUBLE), hi), lo) AS v, lo, hi FROM movies_master, s),
a AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM w)
SELECT canonical_id, round(100 * (v - lo) / (hi - lo), 4) AS winsorised, round((v - m) / sd, 4) AS robust_z FROM w, a""")
def g09_winsorised(spark, d):
    """G9 G10."""
    m = load(spark, d, "movies_master", "canonical_id", "num_votes").withColumn("v", F.col("num_votes").cast("double"))
    s = m.agg(F.percentile("v", 0.01).alias("lo"), F.percentile("v", 0.99).alias("hi"))
    w = m.join(F.broadcast(s)).withColumn("v", numeric.clipped(F.col("v"), F.col("lo"), F.col("hi")))
    a = w.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    return w.join(F.broadcast(a)).select("canonical_id", F.round(100 * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), 4).alias("winsorised"), F.round((F.col("v") - F.col("m")) / F.col("sd"), 4).alias("robust_z"))


@query("""WITH r AS (SELECT canonical_id, avg(rating) AS mean_rating, count(*) AS votes FROM ratings_long_format WHERE canonical_id IS NOT NULL AND NOT isnan(rating) AND rating BETWEEN 0.5 AND 5 GROUP BY 1)
SELECT canonical_id, round((votes * mean_rating + 2500 * 3.5) / (votes + 2500), 6) AS weighted, round((0.5 * mean_rating + 0.3 * ln(1 + votes) + 0.2 * 0) / 1.0, 5) AS composite,
  CASE WHEN votes <= 2 THEN 'sparse' WHEN votes <= 10 THEN 'thin' WHEN votes <= 100 THEN 'solid' ELSE 'rich' END AS cohort,
  CASE WHEN mean_rating > 0 AND mean_rating <= 2 THEN 'low' WHEN mean_rating > 2 AND mean_rating <= 3.5 THEN 'mid' WHEN mean_rating > 3.5 AND mean_rating <= 5 THEN 'high' END AS band FROM r""")
def g11_bayesian(spark, d):
    """G11 G12 G16 G17."""
    r = load(spark, d, "ratings_long_format", "canonical_id", "rating").filter("canonical_id is not null and not isnan(rating) and rating between 0.5 and 5")
    g = r.groupBy("canonical_id").agg(F.avg("rating").alias("mean_rating"), F.count("*").alias("votes"))
    m, v = F.col("mean_rating"), F.col("votes")
    return g.select("canonical_id", F.round(numeric.bayesian_average(m, v, 3.5), 6).alias("weighted"), F.round(numeric.weighted_composite([(m, 0.5), (F.log1p(v), 0.3), (F.lit(None).cast("double"), 0.2)]), 5).alias("composite"), numeric.cohort(v, [(2, "sparse"), (10, "thin"), (100, "solid")], "rich").alias("cohort"), numeric.binned(m, [0, 2, 3.5, 5], ["low", "mid", "high"]).alias("band"))


@query("""WITH r AS (SELECT canonical_id, count(*) AS votes FROM ratings_long_format WHERE canonical_id IS NOT NULL GROUP BY 1), p AS (SELECT quantile_cont(CAST(votes AS DOUBLE), 0.9) AS p90, quantile_cont(CAST(votes AS DOUBLE), 0.5) AS p50 FROM r)
SELECT canonical_id, CASE WHEN votes >= p90 THEN 'head' WHEN votes >= p50 THEN 'mid' ELSE 'long_tail' END AS tier FROM r, p""")
def g18_popularity_tier(spark, d):
    """G18."""
    r = load(spark, d, "ratings_long_format", "canonical_id").filter("canonical_id is not null").groupBy("canonical_id").agg(F.count("*").cast("double").alias("votes"))
    p = r.agg(F.percentile("votes", 0.9).alias("p90"), F.percentile("votes", 0.5).alias("p50"))
    return r.join(F.broadcast(p)).select("canonical_id", F.when(F.col("votes") >= F.col("p90"), "head").when(F.col("votes") >= F.col("p50"), "mid").otherwise("long_tail").alias("tier"))


_HOT = ", ".join(f"CAST(coalesce(list_contains(g, '{w}'), false) AS INT) AS g_{w.lower().replace('-', '_')}" for w in GENRES)


@query(f"""SELECT canonical_id, {_HOT}, array_to_string(g, '|') AS genres_shown, CAST(coalesce(original_language = 'en', false) AS INT) AS l_en, CAST(coalesce(original_language = 'fr', false) AS INT) AS l_fr,
  CAST(coalesce(list_contains(g, 'Drama') AND original_language = 'en', false) AS INT) AS en_drama, coalesce(len(list_intersect(g, ['Action', 'Crime', 'Thriller'])) > 0, false) AS any_tense
  FROM (SELECT *, CASE WHEN genres_norm IS NOT NULL THEN string_split(genres_norm, '|') END AS g FROM movies_master)""")
def g21_multi_hot(spark, d):
    """G19 G21 G22 G23 P10 P27."""
    m = load(spark, d, "movies_master", "canonical_id", "genres_norm", "original_language").withColumn("g", F.split("genres_norm", r"\|"))
    en_drama = F.coalesce(F.array_contains("g", "Drama") & (F.col("original_language") == "en"), F.lit(False)).cast("int")
    return m.select("canonical_id", *arrays.multi_hot(F.col("g"), GENRES, "g_"), F.array_join(F.array_distinct("g"), "|").alias("genres_shown"), *arrays.one_hot(F.col("original_language"), ["en", "fr"], "l_"), en_drama.alias("en_drama"), F.coalesce(F.arrays_overlap("g", F.array(*map(F.lit, ("Action", "Crime", "Thriller")))), F.lit(False)).alias("any_tense"))


@query("""SELECT canonical_id, array_to_string(list_transform(string_split(genres_norm, '|'), lambda x: CASE x WHEN 'Sci-Fi' THEN 'Science Fiction' WHEN 'Family' THEN 'Children' ELSE x END), '|') AS mapped FROM movies_master WHERE genres_norm IS NOT NULL""")
def g20_mapped_lists(spark, d):
    """G20."""
    m = load(spark, d, "movies_master", "canonical_id", "genres_norm").filter("genres_norm is not null")
    return m.select("canonical_id", F.array_join(arrays.mapped_list(F.split("genres_norm", r"\|"), {"Sci-Fi": "Science Fiction", "Family": "Children"}), "|").alias("mapped"))


@query("""WITH m AS (SELECT canonical_id, title_norm, string_split(any_value(genres_norm), '|') AS g FROM movies_master WHERE genres_norm IS NOT NULL AND genres_norm <> '' GROUP BY 1, 2)
SELECT a.canonical_id AS a, b.canonical_id AS b, round(len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE), 6) AS jaccard FROM m a JOIN m b ON a.title_norm = b.title_norm AND a.canonical_id < b.canonical_id""")
def g24_jaccard(spark, d):
    """Genre overlap of films of one title."""
    m = load(spark, d, "movies_master", "canonical_id", "title_norm", "genres_norm").filter("genres_norm is not null and genres_norm <> ''")
    m = m.groupBy("canonical_id", "title_norm").agg(F.split(F.min("genres_norm"), r"\|").alias("g"))
    a, b = m.toDF("a", "title_norm", "ga"), m.toDF("b", "title_norm", "gb")
    return a.join(b, "title_norm").filter("a < b").select("a", "b", F.round(arrays.jaccard(F.col("ga"), F.col("gb")), 6).alias("jaccard"))


@query("""WITH c AS (SELECT label, [avg(embedding[i]) for i in range(1, 65)] AS x FROM embeddings GROUP BY label), k AS (SELECT label, list(v ORDER BY i) AS centre FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS length, round(list_dot_product(CAST(embedding AS DOUBLE[]), centre), 5) AS dot, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 5) AS cosine FROM embeddings JOIN k USING (label)""".replace("c AS (SELECT label, [avg(embedding[i]) for i in range(1, 65)] AS x FROM embeddings GROUP BY label), ", ""))
def g25_vectors(spark, d):
    """Each vector against the centre of its label."""
    e = load(spark, d, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    k = long.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centre"))
    j = e.join(k, "label")
    x, c = F.col("embedding"), F.col("centre")
    return j.select("vec_id", F.round(arrays.norm(x), 5).alias("length"), F.round(arrays.dot(x, c), 5).alias("dot"), F.round(arrays.cosine(x, c), 5).alias("cosine"))


@query("""SELECT c_custkey, round(exp((c_acctbal - max(c_acctbal) OVER w) / 2000.0) / sum(exp(c_acctbal / 2000.0 - mx / 2000.0)) OVER w, 8) AS share FROM (SELECT *, max(c_acctbal) OVER (PARTITION BY c_mktsegment, c_nationkey) AS mx FROM customer) WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey)""")
def g27_softmax(spark, d):
    """G27."""
    w = Window.partitionBy("c_mktsegment", "c_nationkey")
    return load(spark, d, "customer").select("c_custkey", F.round(numeric.softmax(F.col("c_acctbal"), w, 2000.0), 8).alias("share"))


@query("""SELECT s_suppkey, round(1 / (1 + pow(10, (4500 - s_acctbal - 60) / 400.0)), 8) AS expected, round(CASE WHEN s_acctbal > 1 THEN 1 / s_acctbal END, 8) AS implied FROM supplier""")
def g28_expectations(spark, d):
    """G28 G29."""
    a = F.col("s_acctbal")
    return load(spark, d, "supplier").select("s_suppkey", F.round(numeric.elo_expectation(a, F.lit(4500.0), 60), 8).alias("expected"), F.round(numeric.implied_probability(a), 8).alias("implied"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def g30_json(spark, d):
    """G30."""
    e = load(spark, d, "events", "event_type", "props")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


QUERIES, SQL = query.queries, query.sql
