"""Readers and writers of delimited text, JSON, Parquet and arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
except ImportError:  # older Spark
    DataSource = DataSourceReader = InputPartition = object

BROKEN = "broken_line"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, separator: str = ",", encoding: str = "UTF-8", null: str = "", keep_broken: bool = False, header: bool = True) -> DataFrame:
    """Delimited text with a declared schema, so nothing is read twice to infer one.

    Values that do not fit their type become null; with `keep_broken` the whole line is kept in `broken_line`.
    """
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("header", header).option("sep", separator).option("encoding", encoding).option("nullValue", null).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", False)
    if keep_broken:
        s = T.StructType([*s.fields, T.StructField(BROKEN, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", BROKEN)
    return reader.schema(s).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] = ()) -> DataFrame:
    """Tab-separated with `\\N` for null and no quoting; only the named columns are kept by the scan."""
    df = spark.read.schema(schema).option("header", True).option("sep", "\t").option("nullValue", "\\N").option("quote", "").csv(path)
    return df.select(*columns) if columns else df


def sniffed_separator(spark: SparkSession, path: str, candidates: str = ",;\t|") -> str:
    """The candidate that the first line holds most often; of equals the first. A comma if there is none."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(candidates, key=lambda c: (line.count(c), -candidates.index(c))) if any(c in line for c in candidates) else ","


def with_file_name(df: DataFrame, pattern: str = r"([^/]+)$", name: str = "file_name") -> DataFrame:
    """Adds what the pattern's group finds in each row's file name, such as a season."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def latest_path(spark: SparkSession, pattern: str) -> str:
    """The last path by name that the pattern matches, on any file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    names = sorted(f.getPath().toString() for f in found) if found else []
    if not names:
        raise FileNotFoundError(pattern)
    return names[-1]


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Fields of structs as columns of dotted names; lists of plain values joined by commas, other lists as JSON."""

    def walk(field: T.StructField, path: str, name: str) -> Iterator[Column]:
        c, t = F.col(path), field.dataType
        if isinstance(t, T.StructType):
            for f in t.fields:
                yield from walk(f, f"{path}.`{f.name}`", f"{name}{separator}{f.name}")
        elif isinstance(t, T.ArrayType):
            plain = not isinstance(t.elementType, (T.StructType, T.ArrayType, T.MapType))
            yield (F.array_join(c.cast("array<string>"), ",") if plain else F.to_json(c)).alias(name)
        else:
            yield c.alias(name)

    return df.select(*[c for f in df.schema.fields for c in walk(f, f"`{f.name}`", f.name)])


def rows_of_object(df: DataFrame, column: str, value_schema: str, key: str = "id") -> DataFrame:
    """A JSON object of objects as rows: each name becomes the key, each object's fields columns."""
    parsed = F.from_json(F.col(column), f"map<string, struct<{value_schema}>>")
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(parsed).alias(key, "__v")).select(*others, key, "__v.*")


def joined_names(people: Column, name: str, role: str | None = None, of: str | None = None, most: int = 10) -> Column:
    """Names of a list of structs, of one role if given, the first few, joined by commas."""
    chosen = F.filter(people, lambda p: p[role] == of) if role else people
    return F.array_join(F.transform(F.slice(chosen, 1, most), lambda p: p[name]), ", ")


def write_csv(df: DataFrame, path: str, preview: int | None = None, encoding: str = "UTF-8") -> None:
    (df.limit(preview) if preview else df).write.mode("overwrite").option("header", True).option("encoding", encoding).option("escape", '"').csv(path)


def write_lake(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Parquet in one directory per value of the keys; rows are put together by key first, so few files are written."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


class NpyReader(DataSourceReader):
    """Rows of a two-dimensional .npy file, read by ranges through a memory map."""

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        import numpy as np

        n = np.load(self.path, mmap_mode="r").shape[0]
        return [_Range(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [_Range(0, 0)]

    def read(self, partition):
        import numpy as np

        data = np.load(self.path, mmap_mode="r")
        for i in range(partition.a, partition.b):
            yield i, [float(v) for v in data[i]]


class _Range(InputPartition):
    def __init__(self, a: int, b: int):
        self.a, self.b = a, b


class NpySource(DataSource):
    """spark.read.format("npy").option("rows", 65536).load(path) -> (row, vector); register with spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema):
        return NpyReader(self.options["path"], int(self.options.get("rows", 65_536)))


def write_npy(df: DataFrame, vector: str, uri: str) -> int:
    """One .npy shard a task, written through the file system that the URI names; returns the number of rows."""

    def run(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pandas as pd
        from pyarrow import fs

        parts = [np.stack(b[vector].to_numpy()).astype(np.float32) for b in batches if len(b)]
        if parts:
            system, path = fs.FileSystem.from_uri(uri)
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/{uuid.uuid4().hex}.npy") as out:
                np.save(out, np.concatenate(parts))
            yield pd.DataFrame({"rows": [sum(map(len, parts))]})

    return df.select(vector).mapInPandas(run, "rows long").agg(F.sum("rows")).first()[0] or 0


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, vector) of two-dimensional .npy shards, through Spark's own file systems. A shard is read by one task and
    must be under 2 GB; the `npy` source below reads a larger file in ranges where it lies on a mounted folder."""

    def run(batches: Iterator) -> Iterator:
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                x = np.load(io.BytesIO(content))
                for at in range(0, len(x), 8192):
                    part = x[at : at + 8192]
                    yield pd.DataFrame({"file": name, "row": range(at, at + len(part)), "vector": list(part.astype(np.float32))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, row long, vector array<float>")


def append_jsonl(df: DataFrame, path: str, batch: str) -> None:
    """Adds one batch to a table of JSON lines. A batch that is written again replaces itself, so a retry adds nothing twice."""
    df.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side document on any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_manifest(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
    """manifest.json and manifest.md: name, rows and columns of each table."""
    import json

    entries = [{"table": n, "rows": df.count(), "columns": df.columns} for n, df in sorted(tables.items())]
    write_text(spark, f"{path}/manifest.json", json.dumps(entries))
    lines = ["| table | rows | columns |", "|-|-|-|", *[f"| {e['table']} | {e['rows']} | {', '.join(e['columns'])} |" for e in entries]]
    write_text(spark, f"{path}/manifest.md", "\n".join(lines) + "\n")
