"""Data-quality gates: every check is one row (check, value, limit, status), all of a table in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """`value` is an aggregate; it passes from `least` to `most`. A missed check fails, or warns if `warning`."""

    name: str
    value: Column
    least: float | None = None
    most: float | None = None
    warning: bool = False


def completeness(column: str, least: float = 0.95, warning: bool = False) -> Check:
    return Check(f"complete:{column}", F.avg(F.col(column).isNotNull().cast("double")), least, None, warning)


def null_rate(column: str, most: float = 0.2) -> Check:
    return Check(f"nulls:{column}", F.avg(F.col(column).isNull().cast("double")), None, most, True)


def unique(*columns: str) -> Check:
    """Rows per distinct key."""
    return Check(f"unique:{','.join(columns)}", F.count("*") / F.count_distinct(F.struct(*columns)), None, 1.0)


def in_range(column: str, low: float, high: float) -> Check:
    """Share of known values outside."""
    return Check(f"range:{column}", F.coalesce(F.avg((~F.col(column).between(low, high)).cast("double")), F.lit(0.0)), None, 0.0)


def in_set(column: str, values: Sequence) -> Check:
    return Check(f"domain:{column}", F.coalesce(F.avg((~F.col(column).isin(*values)).cast("double")), F.lit(0.0)), None, 0.0)


def finite(column: str) -> Check:
    return Check(f"finite:{column}", F.count_if(F.isnan(column) | (F.abs(F.col(column)) == float("inf"))), None, 0)


def recomputed(name: str, stored: Column, derived: Column, tolerance: float = 1e-3) -> Check:
    return Check(f"derived:{name}", F.coalesce(F.max(F.abs(stored - derived)), F.lit(0.0)), None, tolerance)


def sums_to(name: str, value: Column, total: float = 1.0, tolerance: float = 0.01) -> Check:
    return Check(f"sum:{name}", F.sum(value), total - tolerance, total + tolerance)


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check, value, status) with status PASSED, WARNING or FAILED; a null value fails."""
    one = df.agg(*[c.value.cast("double").alias(f"c{i}") for i, c in enumerate(checks)])
    rows = []
    for i, c in enumerate(checks):
        v = F.col(f"c{i}")
        ok = v.isNotNull()
        if c.least is not None:
            ok = ok & (v >= c.least - 1e-12)
        if c.most is not None:
            ok = ok & (v <= c.most + 1e-12)
        rows.append(F.struct(F.lit(c.name).alias("check"), v.alias("value"), F.when(ok, "PASSED").otherwise("WARNING" if c.warning else "FAILED").alias("status")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def rolled_up(results: DataFrame) -> DataFrame:
    """One row: FAILED if anything failed, else WARNING if anything warned, else PASSED."""
    failed, warned = F.count_if(F.col("status") == "FAILED"), F.count_if(F.col("status") == "WARNING")
    return results.agg(F.count("*").alias("checks"), failed.alias("failed"), warned.alias("warnings"), F.when(failed > 0, "FAILED").when(warned > 0, "WARNING").otherwise("PASSED").alias("status"))


def schema_report(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """(column, wanted, found, status): types as Spark writes them; a missing column fails, another type warns."""
    found = dict(df.dtypes)
    rows = [(c, t, found.get(c), "FAILED" if c not in found else "PASSED" if found[c] == t else "WARNING") for c, t in wanted.items()]
    return df.sparkSession.createDataFrame(rows, "column string, wanted string, found string, status string")


def missing_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, n): keys of the child that the parent lacks, counted before the join."""
    k = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    p = parent.select(F.col(parent_key).alias("key")).distinct()
    return k.join(p, "key", "left_anti")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, hash) that does not depend on the order of rows: equal for equal tables on every run.

    Row hashes are split in three parts that are summed apart, so no sum overflows below 10^12 rows.
    """
    h = F.xxhash64(*sorted(df.columns))
    parts = [F.shiftrightunsigned(h, s).bitwiseAND((1 << 22) - 1) for s in (0, 22, 44)]
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", *[F.sum(p).cast("string") for p in parts]).alias("hash"))


def all_zero_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, total): indicator columns without a single 1."""
    one = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("total")) for c in columns])).alias("r")).select("r.*").filter("total = 0")


def looks_like(df: DataFrame, column: str) -> DataFrame:
    """One row: the share of known values that read as money, as a date and as a number."""
    v = df.filter(F.col(column).isNotNull()).select(F.trim(column).alias("v"))
    share = lambda p: F.coalesce(F.avg(F.col("v").rlike(p).cast("double")), F.lit(0.0))
    return v.agg(F.lit(column).alias("column"), share(r"^[£€$]\s*[0-9]").alias("money"), share(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$").alias("date"), share(r"^-?[0-9][0-9.,]*$").alias("number"))
