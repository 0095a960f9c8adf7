"""Sources and sinks: tables written in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skeinwork.io import load
from skeinwork.plans.registry import Registry
from skeinwork.session import cut, shared_dir
from skeinwork.sources import files
from skeinwork.sources.http import PagedSource, stub

query = Registry()


def _at(spark, name):
    return f"{shared_dir(spark)}/source-{name}-{uuid.uuid4().hex}"


_RT = "id string, title string, audiencescore float, runtimeminutes int, genre string"


@query("SELECT id, title, audiencescore, runtimeminutes, genre FROM rt_movies")
def s01_csv(spark, d):
    """Quoted commas, nulls and non-ASCII titles survive."""
    at = _at(spark, "csv")
    files.write_csv(load(spark, d, "rt_movies", "id", "title", "audiencescore", "runtimeminutes", "genre"), at)
    return files.read_csv(spark, at, _RT)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 1000 AND o_totalprice IS NOT NULL")
def s05_first_rows(spark, d):
    """The first thousand keys of a scan, as a filter that reaches the files and not as a cut of unordered rows."""
    at = _at(spark, "orders")
    load(spark, d, "orders", "o_orderkey", "o_totalprice").write.parquet(at)
    return spark.read.parquet(at).filter("o_orderkey < 1000 and o_totalprice is not null")


@query("SELECT 'n_' || n_nationkey AS key, n_name FROM nation")
def s02_latin1(spark, d):
    """Another encoding, the separator sniffed."""
    at = _at(spark, "latin1")
    n = load(spark, d, "nation").select(F.concat(F.lit("n_"), "n_nationkey").alias("key"), "n_name")
    n.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(at)
    return files.read_csv(spark, at, "key string, n_name string", files.sniffed_separator(spark, at), "ISO-8859-1")


@query("SELECT canonical_id, year_norm FROM movies_master")
def s03_tsv(spark, d):
    """Nulls as \\N; of three columns two are read."""
    at = _at(spark, "tsv")
    load(spark, d, "movies_master", "canonical_id", "director_name", "year_norm").write.option("header", True).option("sep", "\t").option("nullValue", "\\N").option("emptyValue", "").option("quote", "").csv(at)
    return files.read_tsv(spark, at, "canonical_id string, director_name string, year_norm int", ["canonical_id", "year_norm"])


@query("SELECT count(*) AS lines, count(*) FILTER (n_nationkey % 5 = 0) AS broken FROM nation")
def s08_malformed(spark, d):
    """Lines whose number is no number are kept as they were."""
    at = _at(spark, "broken")
    key = F.when(F.col("n_nationkey") % 5 == 0, F.lit("five")).otherwise(F.col("n_nationkey").cast("string"))
    load(spark, d, "nation").select(key.alias("k"), "n_name").write.option("header", True).csv(at)
    df = files.read_csv(spark, at, "k int, n_name string", keep_broken=True)
    return cut(df, "lines").agg(F.count("*").alias("lines"), F.count(files.BROKEN).alias("broken"))


@query("SELECT season, count(*) AS n FROM fpl_merged GROUP BY 1")
def s09_files_with_provenance(spark, d):
    """One directory a season, the season read from the path."""
    at = _at(spark, "lake")
    files.write_lake(load(spark, d, "fpl_merged", "row_id", "season"), at, ["season"])
    raw = spark.read.option("recursiveFileLookup", True).parquet(at)
    return files.with_file_name(raw, r"season=([^/]+)/", "season").groupBy("season").agg(F.count("*").alias("n"))


@query("SELECT 3 AS version, count(*) AS n FROM region")
def s10_latest_file(spark, d):
    """Of three versions the last by name."""
    at = _at(spark, "versions")
    for v in (1, 2, 3):
        load(spark, d, "region").withColumn("version", F.lit(v)).write.parquet(f"{at}/v{v}")
    return spark.read.parquet(files.latest_path(spark, f"{at}/v*")).groupBy("version").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, o_custkey AS buyer_key, o_orderstatus AS buyer_status, 'a,b' AS tags FROM orders")
def s16_flattened_json(spark, d):
    """Nested JSON lines flattened."""
    at = _at(spark, "json")
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("buyer"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    o.write.json(at)
    return files.flattened(spark.read.schema(o.schema).json(at))


@query("SELECT r_name, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def s17_object_of_objects(spark, d):
    """S17."""
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    obj = n.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name"))))).alias("m"))
    return files.rows_of_object(obj.select("r_name", F.to_json("m").alias("j")), "j", "name string")


@query("SELECT o_custkey, string_agg(name, ', ' ORDER BY o_orderkey) AS finished FROM (SELECT o_custkey, o_orderkey, 'o' || o_orderkey AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r <= 10 GROUP BY 1")
def s18_names_of_nested(spark, d):
    """S18."""
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("o_orderstatus").alias("job"), F.concat(F.lit("o"), "o_orderkey").alias("name")))).alias("crew"))
    return o.select("o_custkey", files.joined_names(F.col("crew"), "name", "job", "F").alias("finished")).filter("finished <> ''")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def s11_parquet_orc(spark, d):
    """Through Parquet and ORC."""
    a, b = _at(spark, "parquet"), _at(spark, "orc")
    load(spark, d, "lineitem", "l_returnflag", "l_quantity").write.parquet(a)
    spark.read.parquet(a).write.orc(b)
    return spark.read.orc(b).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT count(*) AS rows, round(sum(list_sum(embedding)), 2) AS total, 64 AS dims FROM embeddings")
def s13_npy(spark, d):
    """Vectors through .npy shards."""
    at = _at(spark, "npy")
    files.write_npy(load(spark, d, "embeddings", "embedding"), "embedding", at)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return files.read_npy(spark, at).agg(F.count("*").alias("rows"), F.round(F.sum(total), 2).alias("total"), F.max(F.size("vector")).alias("dims"))


@query("SELECT n_nationkey, n_name FROM nation")
def s14_paged_source(spark, d):
    """Pages of a web service that fails at first, read with growing waits; here a stub on the driver."""
    import json

    nations = load(spark, d, "nation", "n_nationkey", "n_name").orderBy("n_nationkey").toPandas().to_dict("records")  # a fixed table of 25 rows
    spark.dataSource.register(PagedSource)
    server, url = stub([json.dumps(nations[i : i + 4]) for i in range(0, len(nations), 4)], spark.conf.get("spark.driver.host", "127.0.0.1"))
    pages = spark.read.format("paged").option("pages", -(-len(nations) // 4)).option("wait", 0.02).option("per_second", 100).load(url)
    out = cut(pages.select(F.explode(F.from_json("body", "array<struct<n_nationkey: bigint, n_name: string>>")).alias("r")).select("r.*"), "pages")
    server.shutdown()
    return out


@query("SELECT 'nation' AS \"table\", count(*) AS rows, true AS in_markdown FROM nation UNION ALL SELECT 'orders', count(*), true FROM orders")
def s21_manifest(spark, d):
    """A manifest as JSON and as Markdown."""
    at = _at(spark, "manifest")
    files.write_manifest(spark, at, {n: load(spark, d, n) for n in ("nation", "orders")})
    lines = spark.read.text(f"{at}/manifest.md").agg(F.collect_list("value").alias("lines"))
    entries = spark.read.schema("table string, rows long, columns array<string>").json(f"{at}/manifest.json")
    return entries.join(lines).select("table", "rows", F.exists("lines", lambda x: x.startswith(F.concat(F.lit("| "), "table", F.lit(" | "), F.col("rows").cast("string")))).alias("in_markdown"))


@query("SELECT n_regionkey AS batch, n_nationkey, n_name FROM nation")
def s22_appended_batches(spark, d):
    """A table of JSON lines grown batch by batch, one of them delivered twice."""
    at = _at(spark, "jsonl")
    n = load(spark, d, "nation", "n_regionkey", "n_nationkey", "n_name")
    for batch in (0, 1, 2, 3, 4, 1):
        files.append_jsonl(n.filter(F.col("n_regionkey") == batch).drop("n_regionkey"), at, str(batch))
    return spark.read.schema("n_nationkey bigint, n_name string, batch bigint").json(at)


QUERIES, SQL = query.queries, query.sql
