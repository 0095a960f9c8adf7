"""Queries of the training-data problems and the SQL that checks them."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.io import load
from skeinwork.llm.components import components, shared_key_edges
from skeinwork.llm.linkage import additions, described, genres, match, people
from skeinwork.llm.mixture import mix, share_report
from skeinwork.llm.neighbors import nearest, similar_pairs, unpacked, usable
from skeinwork.llm.packing import pack, packing_report
from skeinwork.llm.tokens import token_counts
from skeinwork.llm.topn import top_n
from skeinwork.llm.unify import LOOK_ALIKES, same_look_pairs, unified
from skeinwork.operators.recommend import exact_knn
from skeinwork.session import cut

CAPACITY = 2048
LANGUAGES = ("en", "fr", "de", "es")


def films(spark: SparkSession, d: str, added: Sequence[str] = ()) -> DataFrame:
    c = F.col
    return described(load(spark, d, "movies_master"), c("canonical_id"), c("title_norm"), c("year_norm"), c("runtime_minutes"), people(c("director_name")), genres(c("genres_norm"), r"\|"), c("original_language"), added)


def tomatoes(spark: SparkSession, d: str, added: Sequence[str] = ()) -> DataFrame:
    """The year is that of the theatre release; a running time well below those of nearly all films is a damaged number."""
    c = F.col
    year = F.regexp_extract("releasedatetheaters", r"((?:18|19|20)\d\d)", 1).try_cast("int")
    language = F.create_map(*[F.lit(x) for x in ("English", "en", "French", "fr", "German", "de", "Spanish", "es")])[c("originallanguage")]
    shortest = load(spark, d, "movies_master", "runtime_minutes").agg(F.percentile_approx("runtime_minutes", 0.001, 10_000)).first()[0] or 0
    return described(load(spark, d, "rt_movies"), c("id"), c("title"), year, F.when(c("runtimeminutes") >= 0.9 * shortest, c("runtimeminutes")), people(c("director")), genres(c("genre"), ","), language, added)


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with a confidence of one half or more."""
    added = additions(load(spark, d, "movies_master", "title_norm"), load(spark, d, "rt_movies", "title"))
    found = match(films(spark, d, added), tomatoes(spark, d, added)).filter("probability >= 0.5")
    return found.select(F.col("e").alias("canonical_id"), F.col("r").alias("rt_id"), F.round("probability", 6).alias("confidence"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("canonical_id", "rt_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_pairs(load(spark, d, "movies_embedding_v1", "canonical_id", "embedding"), "canonical_id", "embedding", 64)
    return pairs.select(F.col("a").alias("canonical_id_a"), F.col("b").alias("canonical_id_b"))


def p3_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Without a floor more cells are searched, as far films have neighbours anywhere."""
    return nearest(load(spark, d, "movies_embedding_v1", "canonical_id", "embedding"), "canonical_id", "embedding", 64, probes=32)


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of one id in twenty against brute force over all rows: how many were asked, and whether nine in ten of
    their true neighbours were found."""
    vectors = cut(usable(load(spark, d, "movies_embedding_v1", "canonical_id", "embedding"), "canonical_id", "embedding", 64), "usable")
    plain = vectors.select("id", unpacked("vec").alias("v"))
    asked = plain.filter(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 20 == 0)
    true = exact_knn(plain, "id", "v", 10, asked=asked).select("id", "neighbor")
    found = p3_neighbors(spark, d).select("id", "neighbor", F.lit(1).alias("hit"))
    hits = true.join(found, ["id", "neighbor"], "left").agg(F.count("hit").alias("hits"), F.count("*").alias("all"))
    return asked.agg(F.count("*").alias("asked")).join(hits).select("asked", (F.col("hits") >= 0.9 * F.col("all")).alias("enough"))


def scored_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "movies_neighbors_k50", "movie_id", "neighbor_id", "score")
    return rows.filter("movie_id is not null and neighbor_id is not null and score is not null and not isnan(score) and movie_id <> neighbor_id")


def neighbour_pairs(rows: DataFrame) -> DataFrame:
    """Each pair once with its highest score."""
    return rows.groupBy("movie_id", "neighbor_id").agg(F.max("score").alias("score"))


def valid_ratings(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "ratings_long_format", "user_index", "canonical_id", "rating", "rated_at")
    return rows.filter("user_index is not null and canonical_id is not null and not isnan(rating) and rating between 0.5 and 5")


def latest_ratings(rows: DataFrame) -> DataFrame:
    """Each pair once with its latest rating, then the higher one."""
    best = rows.groupBy("user_index", "canonical_id").agg(F.max(F.struct("rated_at", "rating")).alias("m"))
    return best.select("user_index", "canonical_id", "m.rating", "m.rated_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    scored, rated = scored_neighbours(spark, d), valid_ratings(spark, d)
    films = top_n(neighbour_pairs(scored), "movie_id", "score", [F.desc("score"), F.asc("neighbor_id")], scanned=scored)
    users = top_n(latest_ratings(rated), "user_index", "rating", [F.desc("rating"), F.desc_nulls_last("rated_at"), F.asc("canonical_id")], scanned=rated)
    a = films.select(F.lit("movies_neighbors_k50").alias("table_name"), F.col("movie_id").alias("group_key"), F.col("neighbor_id").alias("item_key"))
    b = users.select(F.lit("ratings_long_format").alias("table_name"), F.col("user_index").cast("string").alias("group_key"), F.col("canonical_id").alias("item_key"))
    return a.unionByName(b)


def title_links(spark: SparkSession, d: str) -> DataFrame:
    """(number, canonical_id): the number in a tconst without leading zeros; none for zero."""
    number = F.regexp_replace(F.regexp_extract("tconst", "([0-9]+)", 1), "^0+", "")
    return load(spark, d, "id_bridge", "tconst", "canonical_id").select(F.when(number != "", number).alias("number"), "canonical_id").dropna()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components(shared_key_edges(title_links(spark, d), "number", "canonical_id")).select("group_id", F.col("member").alias("canonical_id"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text"), CAPACITY)


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every document is there, none is over-full, only documents beyond the capacity are
    split, every text's pieces follow each other, and the containers are at most 3 % (and 2) more than the fewest possible."""
    p = cut(p8_packed(spark, d), "packed")
    r = packing_report(p, CAPACITY)
    by = p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("size"), F.sum("start_token").alias("starts"))
    ok = (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("size") / CAPACITY))) & (F.col("starts") == CAPACITY * F.col("pieces") * (F.col("pieces") - 1) / 2)
    docs = by.agg(F.count("*").alias("docs"), F.bool_and(ok).alias("split_only_if_long"))
    return docs.join(r).select("docs", "split_only_if_long", (F.col("fullest") <= CAPACITY).alias("none_over_full"), (F.col("containers") <= 1.03 * F.col("fewest_possible") + 2).alias("few_containers"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p8_packed(spark, d), CAPACITY)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut(token_counts(load(spark, d, "documents", "doc_id", "text", "source", "lang"), "doc_id", "text", "source", "lang"), "sized")


def _mixed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources at their target shares, the languages as they are in the documents of those sources."""
    spoken = sized.join(F.broadcast(targets.select("source")), "source").filter(F.col("lang").isin(*LANGUAGES)).groupBy("lang").agg(F.sum("n_tokens").alias("t")).collect()
    every = sum(r["t"] for r in spoken)
    return mix(sized, targets, families={"lang": {r["lang"]: r["t"] / every for r in spoken if r["t"]}})


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(_sized(spark, d), load(spark, d, "source_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = _sized(spark, d), load(spark, d, "source_targets")
    return share_report(_mixed(sized, targets), sized, targets)


def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture, by source: no document beyond its cap, and the share that can be reached is met to
    within a document."""
    shares = p9_shares(spark, d)
    shares = shares.withColumn("all", F.sum("tokens_used").over(Window.partitionBy()))  # one row a target source
    met = F.col("tokens_used") + F.col("longest_there") >= F.col("reachable_share") * F.col("all")
    return shares.select("source", "target_share", "max_repeats", "docs_there", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), met.alias("share_met"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return same_look_pairs(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", unified("text").alias("form"), unified("text", fold=True).alias("compare_key"))


# Characters whose compatibility form is one other character, in fonts, widths and blanks: from Unicode's own tables.
_ONE = [(c, k) for c in map(chr, range(0x80, 0x1F000)) if unicodedata.decomposition(c).startswith(("<font>", "<wide>", "<narrow>", "<noBreak>", "<compat>")) and len(k := unicodedata.normalize("NFKC", c)) == 1 and k not in "' " and c != "\u017f"]
_BLANKS = [c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs"]
_LIGATURES = {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0xFB00, 0xFB06))}
_ALIKE = [(c, k) for c, k in LOOK_ALIKES.items()]
# Accented letters of other alphabets are taken apart, mapped and composed again.
_COMPOSED = [(c, unicodedata.normalize("NFC", LOOK_ALIKES[p[0]] + p[1:])) for c in map(chr, range(0x370, 0x530)) if len(p := unicodedata.normalize("NFD", c)) > 1 and p[0] in LOOK_ALIKES]
_PAIRS = [*_ONE, *_ALIKE, *[(c, k) for c, k in _COMPOSED if len(k) == 1], *[(c, " ") for c in _BLANKS]]
_LOOK = "text"
for _c, _k in _LIGATURES.items():
    _LOOK = f"replace({_LOOK}, '{_c}', '{_k}')"
_LOOK = f"nfc_normalize(translate(regexp_replace({_LOOK}, '[\\x{{00AD}}\\x{{034F}}\\x{{061C}}\\x{{115F}}\\x{{1160}}\\x{{180B}}-\\x{{180F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{3164}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g'), '{''.join(c for c, _ in _PAIRS)}', '{''.join(k for _, k in _PAIRS)}'))"

QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p3_found": p3_found, "p3_neighbors": p3_neighbors, "p3_recall": p3_recall, "p5_found": p5_found, "p6_found": p6_found, "p8_packed": p8_packed, "p8_report": p8_report, "p8_rules": p8_rules, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_rules": p9_rules, "p10_found": p10_found, "p10_forms": p10_forms}
SQL = {
    "p3_found": """
WITH v AS (SELECT canonical_id AS id, CAST(min(embedding) AS DOUBLE[]) AS x FROM movies_embedding_v1 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0 GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.x, b.x), 6) AS s FROM v a JOIN v b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM p)
SELECT DISTINCT least(a, b) AS canonical_id_a, greatest(a, b) AS canonical_id_b FROM r WHERE n <= 10 AND s >= 0.85""",
    "p5_found": """
SELECT 'movies_neighbors_k50' AS table_name, movie_id AS group_key, neighbor_id AS item_key FROM (
  SELECT movie_id, neighbor_id, row_number() OVER (PARTITION BY movie_id ORDER BY s DESC, neighbor_id) AS r FROM (
    SELECT movie_id, neighbor_id, max(score) AS s FROM movies_neighbors_k50 WHERE score IS NOT NULL AND NOT isnan(score) AND movie_id <> neighbor_id GROUP BY 1, 2)) WHERE r <= 10
UNION ALL
SELECT 'ratings_long_format', CAST(user_index AS VARCHAR), canonical_id FROM (
  SELECT user_index, canonical_id, row_number() OVER (PARTITION BY user_index ORDER BY rating DESC, rated_at DESC NULLS LAST, canonical_id) AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY user_index, canonical_id ORDER BY rated_at DESC NULLS LAST, rating DESC) AS q FROM ratings_long_format
    WHERE user_index IS NOT NULL AND canonical_id IS NOT NULL AND NOT isnan(rating) AND rating BETWEEN 0.5 AND 5) WHERE q = 1) WHERE r <= 10""",
    "p6_found": """
WITH RECURSIVE t AS (SELECT DISTINCT ltrim(regexp_extract(tconst, '[0-9]+'), '0') AS k, canonical_id AS c FROM id_bridge WHERE canonical_id IS NOT NULL AND ltrim(regexp_extract(tconst, '[0-9]+'), '0') <> ''),
e AS (SELECT DISTINCT a.c AS u, b.c AS v FROM t a JOIN t b USING (k) WHERE a.c <> b.c),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT least(u, min(v)) AS group_id, u AS canonical_id FROM r GROUP BY u""",
    "p9_rules": """
SELECT t.source, target_share, max_repeats, count(d.doc_id) FILTER (text <> '') AS docs_there, true AS within_cap, true AS share_met
FROM source_targets t LEFT JOIN documents d USING (source) GROUP BY ALL""",
    "p3_recall": """
SELECT count(DISTINCT canonical_id) FILTER (CAST('0x' || substr(md5(canonical_id), 1, 8) AS BIGINT) % 20 = 0) AS asked, true AS enough
FROM movies_embedding_v1 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0""",
    "p8_rules": "SELECT count(*) AS docs, true AS split_only_if_long, true AS none_over_full, true AS few_containers FROM documents",
    "p10_found": f"""
WITH x AS MATERIALIZED (SELECT doc_id, text, md5({_LOOK}) AS f FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text""",
}
