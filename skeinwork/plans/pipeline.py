"""Queries of the general data-cleaning problems: orphan references, hot-deck filling, rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.missing import present, sql_present, uuid_key
from skeinwork.io import load
from skeinwork.operators.hotdeck import Fill, binned, by_distance, hot_deck
from skeinwork.operators.orphans import Reference, orphan_counts, orphan_rows
from skeinwork.operators.recordparse import parse_files, parse_records


def references(spark: SparkSession, d: str) -> list[Reference]:
    return [
        Reference("fpl_merged", load(spark, d, "fpl_merged"), "row_id", F.col("team_id").cast("string"), "kickoff_time", F.concat_ws("-GW", "season", "gameweek"), load(spark, d, "fpl_teams"), F.col("team_id").cast("string"), "loaded_at", "removed_at"),
        Reference("df_traction", load(spark, d, "df_traction"), "row_id", uuid_key("cb_uuid"), "period_start", F.date_format("period_start", "yyyy-MM"), load(spark, d, "organizations"), uuid_key("org_uuid"), "loaded_at", "removed_at"),
    ]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = map(orphan_rows, references(spark, d))
    return a.unionByName(b)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    a, b = map(orphan_counts, references(spark, d))
    return a.unionByName(b)


PERSON, ORG = "person_uuid", "person_featured_job_organization_uuid"
P4 = {"person_gender": PERSON, "person_city": ORG, "person_country_code": ORG}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the person or organisation are the nearest donors: the group key is the one observed feature."""
    people = load(spark, d, "people_df", "row_id", PERSON, ORG, *P4)
    parts = [hot_deck(people, "row_id", Fill(c, present(c), [[present(g)]])) for c, g in P4.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("row_id", "field_name", "filled_value")


#: By field: kind, required feature, optional features and their weights; of all, what is given up from near to far.
DECK = {
    "person_gender": ("category", PERSON, {}),
    "person_city": ("category", ORG, {"person_country_code": 2.0, "person_region": 1.5, "created": 1.0}),
    "person_country_code": ("category", ORG, {"person_region": 2.0, "person_city": 1.5, "created": 1.0}),
    "person_rank": ("number", ORG, {"person_featured_job_title": 2.0, "created": 1.0}),
}
_WEIGHED = ("person_country_code", "person_region", "person_city", "person_gender")


def p4_hot_deck(spark: SparkSession, d: str) -> DataFrame:
    """Mixed features: the donors of the same person or organisation that agree on the most; fuller records weigh more."""
    people = load(spark, d, "people_df")
    feature = lambda c: binned(F.year("person_created_at"), 3) if c == "created" else present(c)
    weight = F.lit(1) + sum((present(c).isNotNull().cast("int") for c in _WEIGHED), F.lit(0))
    parts = []
    for name, (kind, required, optional) in DECK.items():
        levels, distances = by_distance([feature(required)], [(feature(c), w) for c, w in optional.items()])
        value = F.col(name) if kind == "number" else present(name)
        parts.append(hot_deck(people, "row_id", Fill(name, value, levels, kind, weight, distances)).withColumn("filled_value", F.col("filled_value").cast("string")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_records(load(spark, d, "raw_records")).filter("reason is not null").select("line_id", "reason")


def p7_errors(spark: SparkSession, d: str) -> DataFrame:
    return parse_records(load(spark, d, "raw_records")).filter("reason is not null").select("line_id", "feed", "reason", "error_at", "error_column")


def p7_loaded(spark: SparkSession, d: str) -> DataFrame:
    return parse_records(load(spark, d, "raw_records")).filter("reason is null").drop("reason", "error_at", "error_column")


def p7_recovered(spark: SparkSession, d: str) -> DataFrame:
    """The broken records of whole files, where records are found again after a broken quote at validated record starts."""
    return parse_files(load(spark, d, "raw_records", "line_id", "feed", "file_name", "raw_line"))


def _sql_uuid(c: str) -> str:
    return f"regexp_replace(regexp_replace({sql_present(c)}, '^urn:uuid:', ''), '[{{}}\\s-]', '', 'g')"


_REFS = f"""
refs AS (
  SELECT 'fpl_merged' AS table_name, row_id, CAST(team_id AS VARCHAR) AS k, kickoff_time AS t, season || '-GW' || gameweek AS period FROM fpl_merged WHERE team_id IS NOT NULL
  UNION ALL SELECT 'df_traction', row_id, {_sql_uuid('cb_uuid')}, period_start, strftime(period_start, '%Y-%m') FROM df_traction WHERE {sql_present('cb_uuid')} IS NOT NULL),
parents AS (
  SELECT 'fpl_merged' AS table_name, CAST(team_id AS VARCHAR) AS k, loaded_at, removed_at FROM fpl_teams
  UNION ALL SELECT 'df_traction', {_sql_uuid('org_uuid')}, loaded_at, removed_at FROM organizations),
judged AS (
  SELECT r.*, NOT EXISTS (SELECT 1 FROM parents p WHERE p.table_name = r.table_name AND p.k = r.k AND p.loaded_at <= r.t AND (p.removed_at IS NULL OR p.removed_at > r.t)) AS orphan FROM refs r)
"""


def _sql_p4(c: str, g: str) -> str:
    return f"""
SELECT row_id, '{c}' AS field_name, v AS filled_value FROM
  (SELECT row_id, {sql_present(g)} AS g FROM people_df WHERE {sql_present(c)} IS NULL) m
  JOIN (SELECT g, v FROM (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY n DESC, v) AS r FROM
    (SELECT {sql_present(g)} AS g, {sql_present(c)} AS v, count(*) AS n FROM people_df GROUP BY 1, 2) WHERE g IS NOT NULL AND v IS NOT NULL) WHERE r = 1) USING (g)"""


def _sql_deck(name: str) -> str:
    from itertools import product

    kind, required, optional = DECK[name]
    feature = lambda c: "CAST(floor(year(person_created_at) / 3.0) AS BIGINT)" if c == "created" else sql_present(c)
    sets = sorted((sum(w for k, w in zip(keep, optional.values(), strict=True) if not k), -sum(k << i for i, k in enumerate(keep)), [required, *[c for k, c in zip(keep, optional, strict=True) if k]]) for keep in product((0, 1), repeat=len(optional)))
    value = name if kind == "number" else sql_present(name)
    weight = " + ".join(["1", *[f"CAST({sql_present(c)} IS NOT NULL AS INT)" for c in _WEIGHED]])
    placed = " UNION ALL ".join(f"SELECT row_id, {i} AS level, CAST({w} AS DOUBLE) AS distance, CASE WHEN {' AND '.join(f'{feature(c)} IS NOT NULL' for c in cs)} THEN [{', '.join(f'CAST({feature(c)} AS VARCHAR)' for c in cs)}] END AS block, {value} AS v, {weight} AS w FROM people_df" for i, (w, _, cs) in enumerate(sets, 1))
    pick = "row_number() OVER (PARTITION BY level, block ORDER BY w DESC, v)" if kind == "category" else "row_number() OVER (PARTITION BY level, block ORDER BY CASE WHEN 2 * upto >= total THEN 0 ELSE 1 END, v)"
    return f"""SELECT row_id, '{name}' AS field_name, CAST(filled AS VARCHAR) AS filled_value, level, distance, n_donors, donor_id FROM (
  WITH x AS MATERIALIZED ({placed}), t AS (SELECT level, block, v, count(*) AS n, sum(w) AS w, min(row_id) AS donor_id FROM x WHERE block IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2, 3),
  c AS (SELECT *, sum(w) OVER (PARTITION BY level, block ORDER BY v) AS upto, sum(w) OVER (PARTITION BY level, block) AS total, CAST(sum(n) OVER (PARTITION BY level, block) AS BIGINT) AS n_donors FROM t), b AS (SELECT * FROM (SELECT *, {pick} AS r FROM c) WHERE r = 1)
  SELECT x.row_id, b.v AS filled, x.level, x.distance, n_donors, donor_id, row_number() OVER (PARTITION BY x.row_id ORDER BY x.level) AS q FROM x JOIN b ON x.level = b.level AND x.block = b.block WHERE x.v IS NULL) WHERE q = 1"""


_QUOTED = '"([^"]|"")*"'
_FIELD = f'({_QUOTED}|[^",]*)'
_BOX = r"(\$?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?[KMBkmb]?)?"
_P7 = f"""
SELECT line_id, reason FROM (SELECT line_id, CASE
    WHEN feed = 'rt_movies' AND NOT regexp_full_match(s, '{_FIELD}(,{_FIELD})*', 's') THEN 'quoting'
    WHEN feed = 'rt_movies' AND length(regexp_replace(regexp_replace(s, '{_QUOTED}', 'q', 'gs'), '[^,]', '', 'gs')) <> 9 THEN 'column_count'
    WHEN feed = 'rt_movies' AND NOT regexp_full_match(trim(regexp_extract(s, '^({_FIELD},){{8}}({_FIELD}),', 4, 's'), '"'), '{_BOX}') THEN 'invalid_value'
    WHEN feed = 'title.basics' AND length(s) - length(replace(s, chr(9), '')) <> 8 THEN 'column_count'
    WHEN feed = 'title.basics' AND NOT (split_part(s, chr(9), 6) = '\\N' OR (regexp_full_match(split_part(s, chr(9), 6), '[0-9]{{4}}') AND TRY_CAST(split_part(s, chr(9), 6) AS INT) BETWEEN 1870 AND 2030)) THEN 'invalid_value'
    WHEN feed = 'title.basics' AND NOT (split_part(s, chr(9), 8) = '\\N' OR (regexp_full_match(split_part(s, chr(9), 8), '[0-9]{{1,9}}') AND TRY_CAST(split_part(s, chr(9), 8) AS INT) BETWEEN 1 AND 1440)) THEN 'invalid_value'
  END AS reason FROM (SELECT line_id, feed, regexp_replace(raw_line, '\\r$', '') AS s FROM raw_records)) WHERE reason IS NOT NULL"""

_F = '(?:"(?:[^"]|"")*"|[^",]*)'


def _sql_field(i: int) -> str:
    raw = f"regexp_extract(s, '^(?:{_F},){{{i}}}({_F})', 1, 's')"
    return f"CASE WHEN starts_with({raw}, '\"') THEN replace({raw}[2:-2], '\"\"', '\"') ELSE {raw} END"


_tab = lambda i: f"nullif(split_part(s, chr(9), {i}), '\\N')"
_int = lambda x: f"CASE WHEN regexp_full_match({x}, '[0-9]{{1,9}}') THEN CAST({x} AS INT) END"
_dec = lambda x: rf"CASE WHEN regexp_full_match({x}, '[0-9]+(\.[0-9]+)?') THEN CAST({x} AS DOUBLE) END"
_MONEY = f"CAST(nullif(regexp_replace({_sql_field(8)}, '[$,KMBkmb]', '', 'g'), '') AS DOUBLE) * CASE lower(right({_sql_field(8)}, 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END"
_LOADED = f"""WITH bad AS ({_P7}), r AS (SELECT line_id, feed, regexp_replace(raw_line, '\r$', '') AS s FROM raw_records WHERE line_id NOT IN (SELECT line_id FROM bad))
SELECT line_id, feed, {_tab(1)} AS record_id, {_tab(3)} AS title, {_tab(4)} AS original_title, {_tab(2)} AS title_type, CASE {_tab(5)} WHEN '0' THEN false WHEN '1' THEN true END AS is_adult, {_int(_tab(6))} AS start_year, {_int(_tab(7))} AS end_year, {_int(_tab(8))} AS runtime_minutes, {_tab(9)} AS genres, CAST(NULL AS DOUBLE) AS audience_score, CAST(NULL AS DOUBLE) AS tomato_meter, CAST(NULL AS VARCHAR) AS release_date, CAST(NULL AS VARCHAR) AS director, CAST(NULL AS DOUBLE) AS box_office, CAST(NULL AS VARCHAR) AS distributor FROM r WHERE feed = 'title.basics'
UNION ALL SELECT line_id, feed, {_sql_field(0)}, {_sql_field(1)}, NULL, NULL, NULL, NULL, NULL, {_int(_sql_field(5))}, {_sql_field(6)}, {_dec(_sql_field(2))}, {_dec(_sql_field(3))}, {_sql_field(4)}, {_sql_field(7)}, {_MONEY}, {_sql_field(9)} FROM r WHERE feed = 'rt_movies'"""

QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p4_found": p4_found, "p4_hot_deck": p4_hot_deck, "p7_found": p7_found, "p7_errors": p7_errors, "p7_loaded": p7_loaded, "p7_recovered": p7_recovered}
SQL = {
    "p2_found": f"WITH {_REFS} SELECT table_name, row_id FROM judged WHERE orphan",
    "p2_counts": f"WITH {_REFS} SELECT table_name, period, count(*) AS n_references, count(*) FILTER (orphan) AS n_orphans, count(DISTINCT k) FILTER (orphan) AS n_orphan_keys FROM judged GROUP BY 1, 2",
    "p4_found": " UNION ALL ".join(_sql_p4(c, g) for c, g in P4.items()),
    "p4_hot_deck": " UNION ALL ".join(map(_sql_deck, DECK)),
    "p7_found": _P7,
    "p7_loaded": _LOADED,
}
